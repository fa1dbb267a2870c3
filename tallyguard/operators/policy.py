"""Policies: override resolution, versions over time, deployment tiers, erasure."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyguard.operators.asof import last_update
from tallyguard.operators.encode import BROADCAST_ROWS
from tallyguard.operators.skew import match_on
from tallyguard.schema import TIERS


def resolve_policy(manifest: DataFrame, override: DataFrame, key: str) -> DataFrame:
    """Thresholds per policy key: override before manifest default.

    ``l3_ml_threshold`` wins over ``allow_threshold`` for the ALLOW bound.
    """
    joined = match_on(
        manifest.select(
            key,
            F.col("allow_threshold").alias("_allow"),
            F.col("flag_threshold").alias("_flag"),
            F.col("block_threshold").alias("_block"),
        ),
        override,
        [key],
        "left",
    )
    return joined.select(
        key,
        F.coalesce("l3_ml_threshold", "allow_threshold", "_allow").alias("allow_threshold"),
        F.coalesce("flag_threshold", "_flag").alias("flag_threshold"),
        F.coalesce("block_threshold", "_block").alias("block_threshold"),
    )


def policy_at(rows: DataFrame, versions: DataFrame, us: str = "us", local_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Add the policy columns in force at each row's time (null before the first).

    ``versions`` has ``us`` and the policy columns. Of versions of one time the last in
    the order of the policy columns holds. Up to ``local_rows`` versions are sorted as one
    fetched list of change points, which every row is looked up in by binary search; more
    are merged with the rows in time order, in chunks of bounded size.
    """
    payload = [c for c in versions.columns if c != us]
    rank = F.row_number().over(Window.partitionBy(us).orderBy(*[F.col(c).desc() for c in payload]))
    last = versions.where(F.col(us).isNotNull()).select(F.col(us), *payload, rank.alias("_nth")).where("_nth = 1")
    fetched = last.limit(local_rows + 1).collect()
    if len(fetched) > local_rows:
        updates = last.withColumn("_nth", F.lit(0)).withColumn("_all", F.lit(0))
        found = last_update(rows.withColumn("_all", F.lit(0)), updates, ["_all"], us, "_nth")
        return found.select(*rows.columns, *[F.col(f"update.{c}").alias(c) for c in payload])
    fetched.sort(key=lambda r: r[us])
    shared = rows.sparkSession.sparkContext.broadcast(np.array([r[us] for r in fetched], np.int64))

    @F.pandas_udf("int")
    def place(times: pd.Series) -> pd.Series:
        known = times.to_numpy(np.float64, na_value=np.nan)
        exact = times.fillna(0).to_numpy(np.int64)
        at = np.searchsorted(shared.value, exact, side="right") - 1
        return pd.Series(np.where(np.isnan(known), -1, at).astype(np.int32))

    kinds = ", ".join(f"`{c}` {versions.schema[c].dataType.simpleString()}" for c in payload)
    table = rows.sparkSession.createDataFrame([(i, *[r[c] for c in payload]) for i, r in enumerate(fetched)], f"_place int, {kinds}")
    placed = rows.withColumn("_place", place(F.col(us)))
    return placed.join(F.broadcast(table), "_place", "left").select(*rows.columns, *payload)


def tier_profiles(spark) -> DataFrame:
    return spark.createDataFrame(
        TIERS, "tier string, cache_ttl_s int, rate_max int, anomaly_on boolean"
    )


def with_tier_profile(rows: DataFrame, tier: str = "tier") -> DataFrame:
    """Add cache_ttl_s, rate_max and anomaly_on; unknown tiers are on_prem."""
    known = F.lower(tier).isin([t[0] for t in TIERS])
    named = rows.withColumn(tier, F.when(known, F.lower(tier)).otherwise("on_prem"))
    return named.join(F.broadcast(tier_profiles(rows.sparkSession)), tier, "left")


def erase(
    requests: DataFrame, deltas: DataFrame, vectors: DataFrame, key: str
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(receipts, remaining deltas, remaining vectors) for erasure requests."""
    asked = requests.select(key).distinct()
    had_delta = deltas.select(key).distinct().withColumn("removed_delta", F.lit(True))
    had_vector = vectors.select(key).distinct().withColumn("removed_feature", F.lit(True))
    receipts = match_on(match_on(asked, had_delta, [key], "left"), had_vector, [key], "left")
    return (
        receipts.select(
            key,
            F.coalesce("removed_delta", F.lit(False)).alias("removed_delta"),
            F.coalesce("removed_feature", F.lit(False)).alias("removed_feature"),
        ),
        match_on(deltas, asked, [key], "left_anti"),
        match_on(vectors, asked, [key], "left_anti"),
    )

