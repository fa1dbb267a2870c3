"""Operational summaries and data diagnostics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

VERDICTS = ["ALLOW", "FLAG", "BLOCK"]


def _count(test) -> F.Column:
    return F.coalesce(F.sum(F.when(test, 1).otherwise(0)), F.lit(0))


def verdict_counts(df: DataFrame) -> DataFrame:
    """Rows and percentage per verdict; the three verdicts always appear."""
    one = df.agg(*[_count(F.col("verdict") == v).alias(v) for v in VERDICTS])
    total = sum((F.col(v) for v in VERDICTS[1:]), F.col(VERDICTS[0]))
    return one.select(
        total.alias("total"),
        F.explode(
            F.array(*[F.struct(F.lit(v).alias("verdict"), F.col(v).alias("n")) for v in VERDICTS])
        ).alias("v"),
    ).select("v.verdict", "v.n", (F.col("v.n") * 100.0 / F.greatest("total", F.lit(1))).alias("pct"))


def batch_summary(df: DataFrame, size: int, order: list) -> DataFrame:
    """Verdict counts and mean risk over the first ``size`` rows."""
    return df.orderBy(*order).limit(size).agg(
        F.count(F.lit(1)).alias("processed"),
        *[_count(F.col("verdict") == v).alias(v.lower()) for v in VERDICTS],
        F.avg("risk_score").alias("avg_risk"),
    )


def source_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"),
        _count(F.col("verdict") == "FLAG").alias("flagged"),
        _count(F.col("verdict") == "BLOCK").alias("blocked"),
    )


def latest_rows(df: DataFrame, size: int, order: str = "seq") -> DataFrame:
    return df.orderBy(F.col(order).desc()).limit(size)


def network_monitor(edges: DataFrame, size: int = 40) -> DataFrame:
    """Flagged and blocked flows and distinct endpoints among the newest edges."""
    newest = latest_rows(edges, size)
    return newest.agg(
        _count(F.col("verdict").isin("FLAG", "BLOCK")).alias("flagged"),
        _count(F.col("verdict") == "BLOCK").alias("blocked"),
        F.size(
            F.array_union(F.collect_set("src"), F.collect_set("dst"))
        ).alias("unique_nodes"),
    )


def recent_endpoints(edges: DataFrame, side: str, window: int = 40, size: int = 8) -> DataFrame:
    """The first ``size`` distinct endpoints by recency among the newest edges."""
    return (
        latest_rows(edges, window)
        .groupBy(F.col(side).alias("endpoint"))
        .agg(F.max("seq").alias("last_seq"))
        .orderBy(F.col("last_seq").desc())
        .limit(size)
    )


def split_profile(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"),
        _count(F.col("fraud_flag") == 1).alias("fraud"),
        _count(F.col("fraud_flag") != 1).alias("legit"),
        (100.0 * _count(F.col("fraud_flag") == 1) / F.count(F.lit(1))).alias("fraud_pct"),
        F.min("us").alias("min_us"),
        F.max("us").alias("max_us"),
    )


def fraud_value_counts(df: DataFrame, features: list[str], top: int = 10) -> DataFrame:
    """The ``top`` most frequent values of each feature among fraud rows."""
    pairs = F.explode(
        F.array(
            *[
                F.struct(F.lit(f).alias("feature"), F.col(f).cast("bigint").alias("value"))
                for f in features
            ]
        )
    )
    counted = (
        df.where("fraud_flag = 1").select(pairs.alias("p")).select("p.*")
        .groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    )
    rank = F.row_number().over(Window.partitionBy("feature").orderBy(F.col("n").desc(), "value"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= top)


def entity_overlap(df: DataFrame, key: str, fraud_only: bool = False) -> DataFrame:
    """Entities per split, in both, and new in holdout: one pre-aggregated row per entity."""
    rows = df.where("fraud_flag = 1") if fraud_only else df
    sides = rows.groupBy(key).agg(
        F.max(F.when(F.col("split") == "train", 1).otherwise(0)).alias("t"),
        F.max(F.when(F.col("split") == "holdout", 1).otherwise(0)).alias("h"),
    )
    return sides.agg(
        _count(F.col("t") == 1).alias("train_entities"),
        _count(F.col("h") == 1).alias("holdout_entities"),
        _count((F.col("t") == 1) & (F.col("h") == 1)).alias("both"),
        _count((F.col("t") == 0) & (F.col("h") == 1)).alias("new_in_holdout"),
    )


def leakage_checks(df: DataFrame, device: str, feature: str) -> DataFrame:
    """One row per diagnostic rule with whether it fired."""
    overlap = entity_overlap(df, device)
    facts = df.where("split = 'holdout'").agg(
        F.count_distinct(F.when(F.col("fraud_flag") == 1, F.col(feature))).alias("values"),
        F.avg((F.col("fraud_flag") == 1).cast("double")).alias("rate"),
    )
    one = facts.select(
        "*",
        overlap.select("holdout_entities").scalar().alias("devices"),
        overlap.select("new_in_holdout").scalar().alias("new"),
    )
    rules = [
        ("identical_fraud_feature", "critical", F.col("values") == 1),
        ("no_new_devices", "critical", F.col("new") == 0),
        ("few_new_devices", "warning", F.col("new") < F.col("devices") * 0.1),
        ("low_fraud_rate", "warning", F.col("rate") < 0.01),
    ]
    return one.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(n).alias("check"), F.lit(s).alias("severity"), t.alias("fired")
                    )
                    for n, s, t in rules
                ]
            )
        ).alias("r")
    ).select("r.*")


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
