"""Scoring with fitted models: features to probabilities, anomaly, fusion, verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tallyguard.functions.scoring import anomaly_from_raw
from tallyguard.operators.forest import score_forest
from tallyguard.operators.training import score_supervised
from tallyguard.plans.live import topology_flags
from tallyguard.plans.score import verdicts


def score_with_models(features: DataFrame, model, forest: DataFrame) -> DataFrame:
    """Add lgbm_score, anomaly_score, risk_score and verdict to a feature table.

    The topology flag comes from the ten-minute features in the table.
    """
    out = score_supervised(features, model, score="lgbm_score")
    out = score_forest(out, forest).withColumn("anomaly_score", anomaly_from_raw("anomaly_raw"))
    flagged = topology_flags(out, "receiver_unique_senders_10m", "device_txn_count_10m")
    return verdicts(flagged, "lgbm_score", "anomaly_score").drop("anomaly_raw")
