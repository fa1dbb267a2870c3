"""Bank-statement documents (two providers) to the normalised transaction record."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyguard.functions.identity import slug
from tallyguard.functions.narration import (
    balance_drain,
    bank_of,
    category_txn_type,
    narration_category,
    narration_vpa,
    plaid_category,
    plaid_txn_type,
)
from tallyguard.operators.skew import match_on
from tallyguard.schema import PLAID_PAGE, SETU_STATEMENT

# --- fixed values -------------------------------------------------------------
USD_TO_INR = 83.5
DEFAULT_BALANCE = 50_000.0
DEFAULT_HISTORY = {
    "device_txn_count_24h": 5,
    "device_txn_count_6h": 2,
    "device_txn_count_1h": 1,
    "device_txn_count_10m": 1,
}
DEFAULT_CONTEXT = {
    "receiver_txn_count_24h": 1,
    "receiver_txn_count_1h": 1,
    "receiver_unique_senders_1h": 1,
    "receiver_unique_senders_10m": 1,
}


def scan_setu(spark: SparkSession, path: str) -> DataFrame:
    """One row per statement entry, with the account it belongs to."""
    docs = spark.read.schema(SETU_STATEMENT).json(path)
    accounts = docs.select(F.explode("accounts").alias("a"))
    return accounts.select(
        F.coalesce("a.maskedAccNumber", F.lit("unknown")).alias("account_id"),
        F.explode("a.transactions").alias("t"),
    ).select("account_id", "t.*")


def scan_plaid(spark: SparkSession, path: str) -> DataFrame:
    docs = spark.read.schema(PLAID_PAGE).json(path)
    return docs.select(F.explode("transactions").alias("t")).select("t.*")


def same_day_history(raw: DataFrame) -> DataFrame:
    """Add velocity counts from the statement itself: entries of the account that day.

    Counted by a map-side combining aggregation, so a very busy account-day does
    not gather its rows in one task.
    """
    day = F.substring("date", 1, 10)
    rows = raw.withColumn("_day", day)
    per_day = rows.groupBy("account_id", "_day").agg(F.count(F.lit(1)).alias("_n"))
    six = F.greatest(F.lit(1), F.expr("_n div 4"))
    return match_on(rows, per_day, ["account_id", "_day"], "inner", null_safe=True).select(
        *raw.columns,
        F.col("_n").cast("bigint").alias("device_txn_count_24h"),
        six.cast("bigint").alias("device_txn_count_6h"),
        F.greatest(F.lit(1), F.floor(six / 6)).cast("bigint").alias("device_txn_count_1h"),
        F.lit(1).cast("bigint").alias("device_txn_count_10m"),
    )


def outflows(raw: DataFrame) -> DataFrame:
    """Debits with a positive amount; everything else is not scored."""
    debit = F.upper(F.coalesce("type", F.lit("DEBIT"))) == "DEBIT"
    return raw.where(debit & (F.coalesce("amount", F.lit(0.0)) > 0))


def normalise_setu(raw: DataFrame, with_history: bool = True) -> DataFrame:
    """Statement entries as normalised transactions (outflows only)."""
    if with_history:
        rows = same_day_history(raw)
    else:
        rows = raw.select(
            "*", *[F.lit(v).cast("bigint").alias(k) for k, v in DEFAULT_HISTORY.items()]
        )
    rows = outflows(rows).withColumn("narration", F.coalesce("narration", F.lit("UPI/")))
    rows = rows.withColumn("_category", narration_category("narration"))
    local = F.coalesce(
        F.substring("date", 1, 19).try_cast("timestamp"), F.current_timestamp()
    )
    return rows.withColumn(
        "_balance", F.coalesce("currentBalance", F.lit(DEFAULT_BALANCE))
    ).select(
        F.lit("setu").alias("source"),
        F.coalesce(
            "txnId", F.concat(F.lit("setu-"), F.xxhash64("narration").cast("string"))
        ).alias("transaction_id"),
        F.col("account_id").alias("raw_device_id"),
        F.concat("account_id", F.lit("@upi")).alias("sender_vpa"),
        narration_vpa("narration").alias("receiver_vpa"),
        F.col("amount").alias("amount_inr"),
        local.alias("local_ts"),
        F.col("_category").alias("merchant_category"),
        category_txn_type("_category").alias("transaction_type"),
        F.lit("Android").alias("device_type"),
        F.lit(False).alias("is_new_receiver"),
        F.lit(False).alias("is_new_device"),
        bank_of("account_id").alias("sender_bank"),
        bank_of("narration").alias("receiver_bank"),
        *DEFAULT_HISTORY,
        F.lit(0.0).alias("device_amount_zscore_24h"),
        *[F.lit(v).cast("bigint").alias(k) for k, v in DEFAULT_CONTEXT.items()],
        # Without history the record keeps its default frequency of one.
        F.col("device_txn_count_24h").alias("txn_frequency"),
        F.lit(1.0).alias("days_since_last_txn"),
        balance_drain("amount", "_balance").alias("balance_drain"),
    )


def normalise_plaid(raw: DataFrame) -> DataFrame:
    """Card-feed entries as normalised transactions, amounts in INR."""
    merchant = F.lower(
        F.coalesce(
            F.nullif("merchant_name", F.lit("")), F.nullif("name", F.lit("")), F.lit("merchant")
        )
    )
    rows = raw.withColumn("_merchant", merchant)
    handle = F.coalesce(
        F.nullif(F.substring(slug("_merchant"), 1, 14), F.lit("")), F.lit("merchant")
    )
    account = F.coalesce("account_id", F.lit("plaid_acc"))
    local = F.coalesce(F.col("date").try_cast("timestamp"), F.current_timestamp())
    return rows.select(
        F.lit("plaid").alias("source"),
        F.coalesce(
            "transaction_id",
            F.concat_ws("-", F.lit("plaid"), F.xxhash64("_merchant").cast("string"), "date"),
        ).alias("transaction_id"),
        account.alias("raw_device_id"),
        F.concat(F.lit("user."), F.substring(account, 1, 8), F.lit("@upi")).alias("sender_vpa"),
        F.concat(handle, F.lit("@upi")).alias("receiver_vpa"),
        (F.abs(F.coalesce("amount", F.lit(0.0))) * USD_TO_INR).alias("amount_inr"),
        local.alias("local_ts"),
        plaid_category("category").alias("merchant_category"),
        plaid_txn_type("payment_channel", "category").alias("transaction_type"),
        F.when(F.col("_merchant").contains("apple"), "iOS").otherwise("Android").alias("device_type"),
        F.lit(False).alias("is_new_receiver"),
        F.lit(False).alias("is_new_device"),
        F.lit("UNKNOWN").alias("sender_bank"),
        F.lit("UNKNOWN").alias("receiver_bank"),
        *[F.lit(v).cast("bigint").alias(k) for k, v in DEFAULT_HISTORY.items()],
        F.lit(0.0).alias("device_amount_zscore_24h"),
        *[F.lit(v).cast("bigint").alias(k) for k, v in DEFAULT_CONTEXT.items()],
        F.lit(1).cast("bigint").alias("txn_frequency"),
        F.lit(1.0).alias("days_since_last_txn"),
        F.lit(0.0).alias("balance_drain"),
    )


def union_sources(setu: DataFrame, plaid: DataFrame, source: str = "both") -> DataFrame:
    """Both feeds, or only the named one."""
    if source == "setu":
        return setu
    if source == "plaid":
        return plaid
    return setu.unionByName(plaid)
