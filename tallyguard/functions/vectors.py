"""Feature-vector expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyguard.schema import FEATURE_ORDER

# --- fixed values: reference amounts and codes of request vectors ------------
STATEMENT_AMOUNT = (3200.0, 8500.0, 5.0)
REQUEST_AMOUNT = (3000.0, 12000.0, 5.0)
TXN_TYPE_CODES = {"Bill Payment": 0, "P2M": 1, "P2P": 2, "Recharge": 3}
DEVICE_CODES = {"Android": 0, "Harmony OS": 1, "iOS": 2}
REQUEST_DEVICE_CODES = {"ANDROID": 0, "IOS": 2, "HARMONY": 1}


def fixed_zscore(amount: str | Column, mean: float, std: float, clip: float) -> Column:
    col = F.col(amount) if isinstance(amount, str) else amount
    z = (col - F.lit(mean)) / F.lit(max(std, 1e-6))
    return F.greatest(F.lit(-clip), F.least(F.lit(clip), z))


def code_of(column: Column, codes: dict[str, int], default: int) -> Column:
    (name, code), *rest = codes.items()
    chain = F.when(column == name, code)
    for name, code in rest:
        chain = chain.when(column == name, code)
    return chain.otherwise(default)


def feature_vector(df: DataFrame, names: list[str] = FEATURE_ORDER) -> Column:
    """Ordered float array of the named features; missing columns are an error."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing features: {missing}")
    return F.array(*[F.col(n).cast("float") for n in names])


def resize_vector(vector: str | Column, amount: str | Column, length: int) -> Column:
    """Pad with zeros or cut to ``length`` and put the amount first."""
    zeros = F.array_repeat(F.lit(0.0).cast("float"), length)
    rest = F.slice(F.concat(vector, zeros), 2, length - 1)
    head = F.col(amount) if isinstance(amount, str) else amount
    return F.concat(F.array(head.cast("float")), rest)


def split_by_length(df: DataFrame, vector: str, length: int) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) rows by vector length."""
    fits = F.coalesce(F.size(vector) == length, F.lit(False))
    return df.where(fits), df.where(~fits)


def request_vector() -> Column:
    """24-vector of a scoring request (17 request columns)."""
    day = F.col("transactions_last_24h").cast("double")
    z = F.col("amount_zscore")
    kind = code_of(
        F.upper("transaction_type"), {k.upper(): v for k, v in TXN_TYPE_CODES.items()}, 2
    )
    one, zero = F.lit(1.0), F.lit(0.0)
    parts = [
        F.col("amount"),
        F.col("hour_of_day"),
        F.col("day_of_week"),
        (F.col("day_of_week") >= 5).cast("int"),
        one,
        F.col("transactions_last_1h"),
        F.floor(day / 4),
        day,
        z,
        one,
        one,
        day,
        one,
        z,
        F.col("is_new_device").cast("int"),
        F.col("is_new_merchant").cast("int"),
        kind,
        code_of(F.upper("device_type"), REQUEST_DEVICE_CODES, 0),
        zero,
        zero,
        zero,
        zero,
        day,
        one,
    ]
    return F.array(*[p.cast("double") for p in parts])


def statement_vector() -> Column:
    """24-vector of a normalised statement row."""
    zero = F.lit(0.0)
    parts = [
        F.col("amount_inr"),
        F.hour("local_ts"),
        F.weekday("local_ts"),
        (F.weekday("local_ts") >= 5).cast("int"),
        F.col("device_txn_count_10m"),
        F.col("device_txn_count_1h"),
        F.col("device_txn_count_6h"),
        F.col("device_txn_count_24h"),
        F.col("device_amount_zscore_24h"),
        F.col("receiver_unique_senders_10m"),
        F.col("receiver_txn_count_1h"),
        F.col("receiver_txn_count_24h"),
        F.col("receiver_unique_senders_1h"),
        fixed_zscore("amount_inr", *STATEMENT_AMOUNT),
        F.col("is_new_device").cast("int"),
        F.col("is_new_receiver").cast("int"),
        code_of(F.col("transaction_type"), TXN_TYPE_CODES, 2),
        code_of(F.col("device_type"), DEVICE_CODES, 0),
        zero,
        zero,
        zero,
        zero,
        F.col("txn_frequency"),
        F.col("days_since_last_txn"),
    ]
    return F.array(*[p.cast("double") for p in parts])
