"""Request fields for replaying labelled demo rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyguard.functions.vectors import REQUEST_AMOUNT, fixed_zscore

# --- fixed values: (labelled fraud, otherwise) per request field --------------
LABEL_FIELDS = {
    "transactions_last_1h": (12, 1),
    "transactions_last_24h": (28, 3),
    "gps_delta_km": (48.0, 1.2),
    "is_new_device": (True, False),
    "is_new_merchant": (True, False),
    "previous_failed_attempts": (3, 0),
    "transfer_cashout_flag": (1, 0),
}
ACCOUNT_AGE_DAYS = 420


def demo_payload(df: DataFrame, label: str = "fraud_flag") -> DataFrame:
    """Add or replace the request fields; amounts are at least 1."""
    fraud = F.col(label) == 1
    rows = df.withColumn("amount", F.greatest(F.lit(1.0), F.col("amount")))
    for name, (yes, no) in LABEL_FIELDS.items():
        rows = rows.withColumn(name, F.when(fraud, yes).otherwise(no))
    drain = F.least(F.lit(1.0), F.col("amount") / 100000.0)
    return (
        rows.withColumn("balance_drain_ratio", F.when(fraud, 0.92).otherwise(drain))
        .withColumn("amount_zscore", fixed_zscore("amount", *REQUEST_AMOUNT))
        .withColumn("account_age_days", F.lit(ACCOUNT_AGE_DAYS))
        .withColumn("transaction_type", F.lit("DEBIT"))
        .withColumn(
            "device_type",
            F.when(F.upper("device_type").contains("IOS"), "IOS").otherwise("ANDROID"),
        )
    )
