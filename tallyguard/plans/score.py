"""Batch scoring: canonical rows to verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyguard.functions.scoring import fuse_gauntlet, verdict_band
from tallyguard.operators.running import first_seen
from tallyguard.plans.live import topology_signal


def rule_probability(amount: str, new_device: str) -> Column:
    """A supervised-score stand-in from amount and device novelty (no model needed)."""
    return F.least(
        F.lit(1.0), F.col(amount) / 400.0 + F.when(F.col(new_device) == 1, 0.25).otherwise(0.0)
    )


def rule_anomaly(zscore: str) -> Column:
    return F.least(F.lit(1.0), F.abs(F.col(zscore)) / 10.0)


def verdicts(df: DataFrame, supervised, anomaly, topology: str = "high_confidence") -> DataFrame:
    """Add risk_score and verdict from score columns and the topology flag."""
    return df.withColumn("risk_score", fuse_gauntlet(supervised, anomaly, topology)).withColumn(
        "verdict", verdict_band("risk_score")
    )


def score_batch(
    tx: DataFrame,
    supervised: Column | None = None,
    anomaly: Column | None = None,
    sender: str = "sender_id",
    receiver: str = "receiver_id",
) -> DataFrame:
    """Topology, novelty, scores, fusion and verdict for every transaction."""
    rows = topology_signal(first_seen(tx, [sender], "is_new_device"), sender, receiver)
    p = rule_probability("amount", "is_new_device") if supervised is None else supervised
    a = F.least(F.lit(1.0), F.col("sender_txn_10m") / 20.0) if anomaly is None else anomaly
    return verdicts(rows.withColumn("lgbm_score", p).withColumn("anomaly_score", a),
                    "lgbm_score", "anomaly_score")
