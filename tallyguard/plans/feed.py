"""Scored feed rows from normalised statements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyguard.functions.scoring import statement_rule


def scored_feed(statements: DataFrame, tier: str = "cloud") -> DataFrame:
    """One row shape for all sources: parties, amount, verdict and scores.

    Uses the rule scorer, which needs no model; ``plans.modelled`` scores feature
    tables with fitted models.
    """
    rule = statement_rule("amount_inr", "receiver_vpa", "transaction_id")
    return statements.select(
        "source",
        "transaction_id",
        "sender_vpa",
        "receiver_vpa",
        F.round("amount_inr", 2).alias("amount_inr"),
        "merchant_category",
        rule["verdict"].alias("verdict"),
        *[F.round(rule[c], 4).alias(c) for c in ("risk_score", "lgbm_score", "anomaly_score")],
        F.lit(None).cast("string").alias("graph_reason"),
        F.col("local_ts").alias("ts"),
        F.lit(tier).alias("tier"),
    )
