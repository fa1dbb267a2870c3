"""Streaming jobs built from the state processors and the batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyguard.functions.scoring import verdict_band
from tallyguard.operators.graph import WINDOW_EDGES, detections, last_edges, node_risk
from tallyguard.operators.selection import order_statistics
from tallyguard.plans.live import topology_flags
from tallyguard.session import scratch_path
from tallyguard.streaming.panes import GROUP, GROUPS, KEY, ReceiverFeatures, SenderFeatures
from tallyguard.streaming.state import RateWindow, RiskCache

WATERMARK = "10 minutes"


# --- replay -------------------------------------------------------------------
def write_replay(df: DataFrame, path: str, slices: int, files: int = 2, us: str = "us") -> None:
    """Write rows as consecutive time slices, ``files`` files each, oldest first."""
    n = df.count()
    ranks = [n * i // slices for i in range(1, slices)]
    cuts = [v for v, _ in order_statistics(df, us, ranks).values()] if ranks else []
    edges = [None, *sorted(set(cuts)), None]
    for lo, hi in zip(edges, edges[1:]):
        part = df
        part = part if lo is None else part.where(F.col(us) >= lo)
        part = part if hi is None else part.where(F.col(us) < hi)
        part.repartition(files).write.mode("append").parquet(path)


def read_replay(
    spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 2
) -> DataFrame:
    """A file stream in arrival order, a fixed number of files per micro-batch."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(path)
    )


def run_to_table(
    stream: DataFrame, label: str, mode: str = "append", folder: str | None = None
) -> DataFrame:
    """Drain the available input into a parquet table and return it.

    ``folder`` keeps the table and the checkpoint (``data`` and ``checkpoint`` in it): a
    later call with the same folder goes on where the last one ended. Without it both
    are new.
    """
    spark = stream.sparkSession
    folder = folder or scratch_path(spark, label)
    query = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start(f"{folder}/data")
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/data")


def run_batches(
    stream: DataFrame,
    label: str,
    each: Callable[[DataFrame, int], None],
    mode: str = "append",
    checkpoint: str | None = None,
) -> None:
    """Drain the available input through ``each(batch, id)``.

    With a ``checkpoint`` folder a later call goes on with the next batch id.
    """
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint or scratch_path(stream.sparkSession, f"{label}-checkpoint"))
        .trigger(availableNow=True)
        .foreachBatch(each)
        .start()
    )
    query.awaitTermination()


# --- stateful features ----------------------------------------------------------
def _extend(schema: StructType, fields: str) -> StructType:
    added = StructType.fromDDL(fields)
    return StructType(list(schema.fields) + list(added.fields))


def _keyed(df: DataFrame, key: str, processor, time: str | None = None) -> DataFrame:
    options = {"eventTimeColumnName": time} if time else {}
    return df.groupBy(key).transformWithStateInPandas(
        statefulProcessor=processor,
        outputStructType=_extend(df.schema, processor.fields),
        outputMode="Append",
        timeMode="eventTime" if time else "None",
        **options,
    )


def _keyed_rows(df: DataFrame, key: str, processor, columns: list[str], time: str | None = None) -> DataFrame:
    """``processor`` on plain rows, for keys with few in a batch; it gives ``columns`` of ``df`` and its own fields."""
    options = {"eventTimeColumnName": time} if time in columns else {}
    return df.groupBy(key).transformWithState(
        statefulProcessor=processor,
        outputStructType=_extend(df.select(*columns).schema, processor.fields),
        outputMode="Append",
        timeMode="eventTime" if time else "None",
        **options,
    )


def _grouped(df: DataFrame, key: str, processor, time: str) -> DataFrame:
    """``processor`` on groups of keys: a call costs as much as many rows, and most keys have few in a batch."""
    text = F.col(key).cast("string")
    dealt = df.withColumns({GROUP: F.pmod(F.xxhash64(text), F.lit(GROUPS)).cast("int"), KEY: text})
    return _keyed(dealt, GROUP, processor, time).drop(GROUP, KEY)


def stateful_features(
    stream: DataFrame,
    mean: float,
    std: float,
    sender: str = "sender_id",
    receiver: str = "receiver_id",
    ts: str = "ts",
    hold: bool = False,
) -> DataFrame:
    """Sender pass, then receiver pass; features see only earlier rows.

    With ``hold`` a row comes out when the watermark has passed it, with the features of
    the batch windows whatever the order of arrival within the watermark. Without it a
    row comes out at once, and a late one is put in its place.
    """
    timed = stream.withWatermark(ts, WATERMARK)
    by_sender = _grouped(timed, sender, SenderFeatures(mean, std, hold), ts)
    # what the sender pass lets out together is complete up to the watermark
    return _grouped(by_sender, receiver, ReceiverFeatures(sender), ts)


def topology_stream(features: DataFrame) -> DataFrame:
    """Ten-minute fan-in and velocity rules on the stateful features."""
    return topology_flags(features, "receiver_unique_senders_10m", "device_txn_count_10m")


def rate_limit_stream(
    stream: DataFrame, key: str, max_requests: int, window_s: int, ts: str | None = None
) -> DataFrame:
    """Requests with ``allowed`` and ``retry_after_s``.

    With an event time ``ts`` a window's state is removed once the watermark has passed
    its end, which no later request can tell from a window that is over.
    """
    timed = stream.withWatermark(ts, WATERMARK) if ts else stream
    columns = timed.columns
    return _keyed_rows(timed, key, RateWindow(columns, max_requests, window_s, bool(ts)), columns, ts)


def risk_cache_stream(
    reads: DataFrame, writes: DataFrame, key: str, ttl_s: int, ts: str | None = None
) -> DataFrame:
    """Reads answered from the last write of their key within the time limit.

    With an event time ``ts`` (in both streams) entries are removed once the watermark is
    past twice the time limit.
    """
    time = [ts] if ts else []
    left = writes.select(key, "us", "seq", *time, F.lit(0).alias("kind"), "risk_delta", "reason")
    right = reads.select(
        key,
        "us",
        "seq",
        *time,
        F.lit(1).alias("kind"),
        F.lit(None).cast("double").alias("risk_delta"),
        F.lit(None).cast("string").alias("reason"),
    )
    both = left.unionByName(right)
    timed = both.withWatermark(ts, WATERMARK) if ts else both
    kept = [key, "us", "seq"]
    return _keyed_rows(timed, key, RiskCache(timed.columns, kept, ttl_s, bool(ts)), kept, ts)


# --- stateless and built-in stateful ---------------------------------------------
def dedupe_stream(stream: DataFrame, key: str) -> DataFrame:
    """First row of every key; keys are kept for good, so that no later repeat comes through.

    The state grows with the number of keys. Where repeats come within the watermark only,
    ``dropDuplicatesWithinWatermark`` bounds it.
    """
    return stream.dropDuplicates([key])


def merge_streams(*streams: DataFrame) -> DataFrame:
    merged = streams[0]
    for other in streams[1:]:
        merged = merged.unionByName(other)
    return merged


def verdict_count_stream(stream: DataFrame) -> DataFrame:
    """Running count per verdict (update or complete mode)."""
    return stream.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def verdict_minutes(stream: DataFrame, ts: str = "ts", width: str = "1 minute") -> DataFrame:
    """Count per verdict and tumbling window (update or complete mode).

    Without a watermark on ``stream`` every minute stays in state; with one, minutes that
    the watermark has passed are dropped (update mode).
    """
    return (
        stream.groupBy(F.window(ts, width), "verdict")
        .agg(F.count(F.lit(1)).alias("n"))
    )


# --- foreachBatch jobs --------------------------------------------------------------
def graph_window_job(
    stream: DataFrame, deltas_path: str, size: int = WINDOW_EDGES, folder: str | None = None
) -> None:
    """Keep the newest ``size`` edges across batches and publish node risk per batch.

    Eviction counts edges of all nodes, so it is not keyed: each batch is reduced
    to its own newest edges and merged with the bounded window table. Windows
    are written per batch id, so a repeated batch starts from the same state. ``folder``
    keeps the windows and the checkpoint; a later call with it goes on from there.
    """
    spark = stream.sparkSession
    base = folder or scratch_path(spark, "graph-window")
    schema = stream.select("src", "dst", "us", "seq").schema

    def each(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.select("src", "dst", "us", "seq")
        if batch_id:
            kept = spark.read.schema(schema).parquet(f"{base}/windows/{batch_id - 1}")
            fresh = last_edges(fresh, size).unionByName(kept)
        last_edges(fresh, size).write.mode("overwrite").parquet(f"{base}/windows/{batch_id}")
        window = spark.read.schema(schema).parquet(f"{base}/windows/{batch_id}")
        risk = node_risk(detections(window)).withColumn("batch", F.lit(batch_id))
        risk.write.mode("overwrite").parquet(f"{deltas_path}/batch={batch_id}")

    run_batches(stream, "graph-window", each, checkpoint=f"{base}/checkpoint")


def audit_job(stream: DataFrame, path: str, event: str, checkpoint: str | None = None) -> None:
    """Append audit lines of each micro-batch; a repeated batch overwrites its own."""

    def each(batch: DataFrame, batch_id: int) -> None:
        target = f"{path}/batch-{batch_id}"
        line = F.to_json(F.struct(F.lit(event).alias("event"), *batch.columns))
        batch.select(line.alias("value")).write.mode("overwrite").text(target)

    run_batches(stream, "audit", each, checkpoint=checkpoint)


def policy_job(stream: DataFrame, policies: Callable[[int], DataFrame], out: str) -> None:
    """Band each micro-batch with the policy table as it is when the batch runs.

    ``policies(batch_id)`` re-reads the table; its newest row (by ``us``) applies.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        newest = policies(batch_id).orderBy(F.col("us").desc()).limit(1).first()
        banded = batch.withColumn(
            "verdict",
            verdict_band("score", F.lit(newest["allow_threshold"]), F.lit(newest["block_threshold"])),
        )
        banded.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(
            f"{out}/batch={batch_id}"
        )

    run_batches(stream, "policy", each)

