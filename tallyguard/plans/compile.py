"""The 24-feature table: split, fit on train, window features, encodings, assembly."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyguard.functions.calendar import calendar_features
from tallyguard.functions.identity import hash_pii
from tallyguard.operators.encode import (
    amount_stats,
    corridor_fit,
    corridor_flag,
    ordinal_encode,
    ordinal_fit,
)
from tallyguard.operators.running import first_seen
from tallyguard.operators.split import temporal_split
from tallyguard.operators.trailing import trailing_distinct, trailing_windows
from tallyguard.schema import (
    CATEGORICALS,
    CORRIDOR_RATE,
    DAY,
    EPSILON,
    FEATURE_ORDER,
    HOUR,
    LABEL,
    MINUTE,
)

DEVICE_COUNTS = {
    "device_txn_count_10m": 10 * MINUTE,
    "device_txn_count_1h": HOUR,
    "device_txn_count_6h": 6 * HOUR,
    "device_txn_count_24h": DAY,
}
RECEIVER_COUNTS = {"receiver_txn_count_1h": HOUR, "receiver_txn_count_24h": DAY}
RECEIVER_SENDERS = {
    "receiver_unique_senders_10m": 10 * MINUTE,
    "receiver_unique_senders_1h": HOUR,
}


@dataclass(frozen=True)
class Fitted:
    """Train-only statistics, each a small table."""

    amounts: DataFrame
    codes: DataFrame
    corridors: DataFrame


def fit(train: DataFrame, corridor_rate: float = CORRIDOR_RATE) -> Fitted:
    return Fitted(
        amount_stats(train), ordinal_fit(train, CATEGORICALS), corridor_fit(train, corridor_rate)
    )


def device_zscore(df: DataFrame, clip: float = 10.0) -> DataFrame:
    """Add device_amount_zscore_24h from the 24h moments; 0 below two prior rows."""
    n = F.col("_d24_n")
    std = F.when(n >= 2, F.sqrt(F.col("_d24_m2") / (n - 1))).otherwise(0.0)
    z = (F.col("amount") - F.col("_d24_mean")) / (std + F.lit(EPSILON))
    bounded = F.greatest(F.lit(-clip), F.least(F.lit(clip), z))
    return df.withColumn(
        "device_amount_zscore_24h",
        F.when(F.col("device_txn_count_24h") >= 2, bounded).otherwise(0.0),
    ).drop("_d24_n", "_d24_mean", "_d24_m2")


def sender_features(df: DataFrame, keys: list[str], rows: int | None = None) -> DataFrame:
    """Velocity counts, z-score and first-seen flag; one shuffle on the sender."""
    # First-seen first: its sort by (us, seq) also serves the time windows.
    seen = first_seen(df, keys, "is_new_device", rows=rows)
    timed = trailing_windows(seen, keys, DEVICE_COUNTS, "amount", {"_d24": DAY}, rows=rows)
    return device_zscore(timed)


def receiver_features(
    df: DataFrame, keys: list[str], sender: str, rows: int | None = None
) -> DataFrame:
    """Receiver counts, distinct senders (earlier tied rows included) and first-seen flag."""
    distinct = trailing_distinct(df, keys, sender, RECEIVER_SENDERS, rows=rows)
    seen = first_seen(distinct, keys, "is_new_receiver", rows=rows)
    return trailing_windows(seen, keys, RECEIVER_COUNTS, rows=rows)


def behavioural(
    df: DataFrame,
    scope: list[str],
    sender: str = "sender_hash",
    receiver: str = "receiver_hash",
) -> DataFrame:
    """Calendar and window features; ``scope`` columns restart every window."""
    rows = df.count()
    by_sender = sender_features(calendar_features(df), scope + [sender], rows)
    return receiver_features(by_sender, scope + [receiver], sender, rows)


def fitted_amounts(amounts: DataFrame) -> tuple[Column, Column]:
    """Mean and deviation from one scalar subquery."""
    pair = amounts.select(F.struct("global_mean", "global_std").alias("s")).scalar()
    return pair.getField("global_mean"), pair.getField("global_std")


def global_zscore(df: DataFrame, amounts: DataFrame) -> DataFrame:
    mean, std = fitted_amounts(amounts)
    return df.withColumn(
        "amount_zscore_global", (F.col("amount") - mean) / (std + F.lit(EPSILON))
    )


def encode(df: DataFrame, fitted: Fitted) -> DataFrame:
    coded = ordinal_encode(global_zscore(df, fitted.amounts), fitted.codes, CATEGORICALS)
    return corridor_flag(coded, fitted.corridors)


def assemble(df: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Contract columns in order as float, then the label; missing columns are an error."""
    missing = [c for c in FEATURE_ORDER if c not in df.columns]
    if missing:
        raise ValueError(f"missing features: {missing}")
    return df.select(
        *(extra or []),
        *[F.col(c).cast("float").alias(c) for c in FEATURE_ORDER],
        F.col(LABEL).cast("tinyint").alias(LABEL),
    )


def compile_features(
    tx: DataFrame,
    fraction: float = 0.8,
    corridor_rate: float = CORRIDOR_RATE,
    restart_at_split: bool = True,
) -> DataFrame:
    """Canonical transactions to the unassembled feature table with its ``split``."""
    rows = temporal_split(hash_pii(tx), fraction)
    fitted = fit(rows.where("split = 'train'"), corridor_rate)
    return encode(behavioural(rows, ["split"] if restart_at_split else []), fitted)
