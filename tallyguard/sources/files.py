"""File scans with explicit schemas, and their column checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyguard.operators.graph import last_edges
from tallyguard.schema import FEATURE_ORDER, LABEL

# --- fixed values: demo traffic CSV, 19 columns in order ----------------------
DEMO_COLUMNS = [
    "transaction_id", "timestamp", "transaction_type", "merchant_category", "amount",
    "status", "sender_age_group", "receiver_age_group", "sender_state", "sender_bank",
    "receiver_bank", "device_type", "network_type", "fraud_flag", "hour_of_day",
    "day_of_week", "is_weekend", "device_surrogate", "corridor_surrogate",
]
DEMO_NUMBERS = ["amount", "fraud_flag", "hour_of_day"]


def scan_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, every column as text; typing happens in canonicalisation.

    Only the header is looked at; there is no inference pass over the data.
    """
    return spark.read.csv(path, header=True, inferSchema=False)


def scan_demo_csv(spark: SparkSession, path: str) -> DataFrame:
    """Demo traffic rows: lines with fewer than 19 fields dropped, bad numbers as 0."""
    lines = spark.read.csv(
        path, schema="line string", header=True, sep="\u0001", quote="", enforceSchema=True
    )
    fields = lines.select(F.split("line", ",").alias("f")).where(
        F.size("f") >= len(DEMO_COLUMNS)
    )
    return fields.select(
        *[
            F.coalesce(F.col("f")[i].try_cast("double"), F.lit(0.0)).alias(name)
            if name in DEMO_NUMBERS
            else F.col("f")[i].alias(name)
            for i, name in enumerate(DEMO_COLUMNS)
        ]
    )


def require_columns(df: DataFrame, names: list[str], what: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns in {what}: {missing}")
    return df


def scan_features(spark: SparkSession, path: str) -> DataFrame:
    """Feature table in contract order, with its label."""
    wanted = FEATURE_ORDER + [LABEL]
    return require_columns(spark.read.parquet(path), wanted, path).select(*wanted)


def scan_recent_edges(
    spark: SparkSession,
    path: str,
    size: int,
    sender: str = "sender_bank",
    receiver: str = "receiver_bank",
    amount: str = "amount",
    us: str = "us",
    seq: str = "seq",
) -> DataFrame:
    """The newest ``size`` edges of a parquet table; only the needed columns are read."""
    scan = spark.read.parquet(path).select(
        F.col(sender).cast("string").alias("src"),
        F.col(receiver).cast("string").alias("dst"),
        F.coalesce(F.col(amount).cast("double"), F.lit(0.0)).alias("amount"),
        us,
        seq,
    )
    return last_edges(scan, size, us, seq)
