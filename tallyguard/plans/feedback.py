"""Graph risk fed back into scoring through a change log of node deltas.

The risk of a window of edges is published under the time it was computed at. The log is
append-only; a transaction reads the newest delta of its node at its own time, so scores
can be recomputed later with what was known then. Compaction keeps what any time from a
given one on can still read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyguard.operators.asof import latest_per_key, risk_delta_lookup
from tallyguard.operators.graph import WINDOW_EDGES
from tallyguard.plans.graph_risk import window_risk
from tallyguard.schema import MICROS
from tallyguard.sources.sinks import publish_deltas

LOG = "vpa_hash string, risk_delta double, reason string, _timestamp bigint"


def publish_window(edges: DataFrame, at_us: int, log: str, size: int = WINDOW_EDGES) -> int:
    """Publish the risk of the newest ``size`` edges before ``at_us``; returns its second.

    The deltas hold from the next whole second on, so none is read before it was known.
    """
    at_s = at_us // MICROS + 1
    publish_deltas(window_risk(edges.where(F.col("us") < at_us), size), log, at_s)
    return at_s


def read_log(spark: SparkSession, log: str) -> DataFrame:
    """The change log as updates (vpa_hash, us, seq, risk_delta, reason)."""
    rows = spark.read.schema(LOG).parquet(log)
    return rows.select("vpa_hash", (F.col("_timestamp") * MICROS).alias("us"), F.lit(0).cast("bigint").alias("seq"), "risk_delta", "reason")


def compact(spark: SparkSession, log: str, since_s: int, into: str) -> None:
    """Write to ``into`` the newest delta per node up to ``since_s`` and all later ones."""
    rows = spark.read.schema(LOG).parquet(log)
    old = latest_per_key(rows.where(F.col("_timestamp") <= since_s), ["vpa_hash"], ["_timestamp", "reason", "risk_delta"])
    old.unionByName(rows.where(F.col("_timestamp") > since_s)).write.mode("overwrite").parquet(into)


def with_feedback(rows: DataFrame, log: DataFrame, node: str, ttl_s: int) -> DataFrame:
    """``rows`` (us and others) with ``graph_delta`` and ``graph_reason`` of ``node`` at their time."""
    renamed = log.withColumnRenamed("vpa_hash", "_node")
    found = risk_delta_lookup(rows.withColumn("_node", F.col(node)), renamed, "_node", ttl_s)
    return found.drop("_node")
