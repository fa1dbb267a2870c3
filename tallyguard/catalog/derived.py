"""Documents and files that Spark derives from the given tables, for the source queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyguard.catalog.base import table, tx
from tallyguard.session import scratch_path

_BANKS = ["axis", "hdfc", "icici", "sbi", "kotak", "yes", "paytm", "gpay"]
# own samples: for each keyword rule one text that meets it, and some that meet none
_NARRATIONS = [
    "UPI/ZOMATO#@OKAXIS/dinner", "UPI/WATER.BOARD@OKSBI/march", "UPI/FLIPKART.SHOP@YBL/parcel",
    "UPI/UBER.RIDES@HDFC/trip #", "UPI/KIRAN.#@YESB/thanks", "RTGS/RENT/FLAT 12",
    "POS bet shop #", "to agent # by wallet", "UPI/BOOKS@ICICI/novels", "?? ..",
]
_MERCHANTS = ["Joe''s Diner", "Orchard Phones", "Bank Wire", "Coin Exchange", "", "B-Tel"]
_CATEGORIES = [
    ["Food and Drink", "Restaurants"], ["Service", "Cable"], ["Transfer", "Third Party"],
    ["Recreation", "Gyms"], ["Service", "Telecommunication Services"], ["Travel"],
]
_CHANNELS = ["in_store", "online", "other"]


def _sql_list(values) -> str:
    return "[" + ", ".join(
        _sql_list(v) if isinstance(v, list) else f"'{v}'" for v in values
    ) + "]"


SETU_RAW = f"""setu_raw AS (
SELECT event_id AS seq, 'acc_' || ({_sql_list(_BANKS)})[user_id % 8 + 1] || '_' || user_id AS account_id,
  'S' || event_id AS "txnId", round(value * 100, 2) AS amount,
  replace(({_sql_list(_NARRATIONS)})[event_id % 10 + 1], '#', json_extract_string(props, '$.k')) AS narration,
  CASE WHEN event_id % 6 = 5 THEN 'CREDIT' ELSE 'DEBIT' END AS type,
  (event_id % 1000) * 50.0::DOUBLE AS "currentBalance", date_trunc('second', ts) AS local_ts,
  strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+05:30' AS date FROM events)"""

PLAID_RAW = f"""plaid_raw AS (
SELECT event_id AS seq, 'P' || event_id AS transaction_id,
  CASE WHEN event_id % 2 = 0 THEN value * 10 ELSE -value * 10 END AS amount,
  ({_sql_list(_MERCHANTS)})[event_id % 6 + 1] AS merchant_name,
  CASE WHEN event_id % 12 = 4 THEN NULL ELSE 'Shop ' || event_type END AS name,
  ({_sql_list(_CATEGORIES)})[event_id // 6 % 6 + 1] AS category, strftime(ts, '%Y-%m-%d') AS date,
  ({_sql_list(_CHANNELS)})[event_id % 3 + 1] AS payment_channel, 'plaid_acc_' || user_id AS account_id
  FROM events)"""


def _pick(values, index):
    nested = isinstance(values[0], list)
    items = [
        F.array(*[F.lit(x) for x in v]) if nested else F.lit(v.replace("''", "'")) for v in values
    ]
    return F.get(F.array(*items), index.cast("int"))


def setu_raw(spark: SparkSession, sf: str) -> DataFrame:
    e, i = table(spark, sf, "events"), F.col("event_id")
    return e.select(
        i.alias("seq"),
        F.concat(
            F.lit("acc_"), _pick(_BANKS, F.col("user_id") % 8), F.lit("_"),
            F.col("user_id").cast("string"),
        ).alias("account_id"),
        F.concat(F.lit("S"), i.cast("string")).alias("txnId"),
        F.round(F.col("value") * 100, 2).alias("amount"),
        F.replace(
            _pick(_NARRATIONS, i % 10), F.lit("#"), F.get_json_object("props", "$.k")
        ).alias("narration"),
        F.when(i % 6 == 5, "CREDIT").otherwise("DEBIT").alias("type"),
        ((i % 1000) * 50.0).alias("currentBalance"),
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+05:30")).alias("date"),
    )


def plaid_raw(spark: SparkSession, sf: str) -> DataFrame:
    e, i = table(spark, sf, "events"), F.col("event_id")
    return e.select(
        i.alias("seq"),
        F.concat(F.lit("P"), i.cast("string")).alias("transaction_id"),
        F.when(i % 2 == 0, F.col("value") * 10).otherwise(-F.col("value") * 10).alias("amount"),
        _pick(_MERCHANTS, i % 6).alias("merchant_name"),
        F.when(i % 12 != 4, F.concat(F.lit("Shop "), "event_type")).alias("name"),
        _pick(_CATEGORIES, F.expr("event_id div 6 % 6")).alias("category"),
        F.date_format("ts", "yyyy-MM-dd").alias("date"),
        _pick(_CHANNELS, i % 3).alias("payment_channel"),
        F.concat(F.lit("plaid_acc_"), F.col("user_id").cast("string")).alias("account_id"),
    )


def setu_documents(spark: SparkSession, sf: str) -> str:
    """Statement documents of at most twenty entries each; returns the folder."""
    doc = F.expr("seq div 20")
    accounts = (
        setu_raw(spark, sf)
        .groupBy(doc.alias("doc"), F.col("account_id").alias("maskedAccNumber"))
        .agg(
            F.collect_list(
                F.struct("txnId", "amount", "narration", "type", "currentBalance", "date")
            ).alias("transactions")
        )
    )
    docs = accounts.groupBy("doc").agg(
        F.collect_list(F.struct("maskedAccNumber", "transactions")).alias("accounts")
    )
    path = scratch_path(spark, "setu")
    docs.select("accounts").write.json(path)
    return path


def plaid_documents(spark: SparkSession, sf: str) -> str:
    raw = plaid_raw(spark, sf)
    docs = raw.groupBy(F.expr("seq div 20").alias("doc")).agg(
        F.collect_list(F.struct(*[c for c in raw.columns if c != "seq"])).alias("transactions")
    )
    path = scratch_path(spark, "plaid")
    docs.select("transactions").write.json(path)
    return path


def traffic_csv(spark: SparkSession, sf: str) -> str:
    """Transactions as a CSV with the column names of a public traffic export."""
    rows = tx(spark, sf).select(
        F.col("transaction_id").alias("transaction id"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"),
        F.col("transaction_type").alias("transaction type"),
        F.col("amount").alias("amount (INR)"),
        F.col("sender_id").alias("Device_Surrogate"),
        "sender_bank",
        "receiver_bank",
        "device_type",
        "fraud_flag",
    )
    path = scratch_path(spark, "traffic-csv")
    rows.write.option("header", True).csv(path)
    return path


def demo_lines(spark: SparkSession, sf: str) -> str:
    """Demo traffic lines, some with missing fields or bad numbers."""
    e, i = table(spark, sf, "events"), F.col("event_id")
    text = [
        F.concat(F.lit("TXN"), i.cast("string")), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
        F.lit("P2P"), F.col("event_type"),
        F.when(i % 13 == 0, "abc").otherwise(F.col("value").cast("string")), F.lit("SUCCESS"),
        F.lit("26-35"), F.lit("36-45"), F.lit("Gujarat"), F.lit("Kotak"), F.lit("PNB"),
        F.lit("Android"), F.lit("4G"), F.when(F.col("event_type") == "error", "1").otherwise("0"),
        F.hour("ts").cast("string"), F.date_format("ts", "EEEE"), F.lit("0"),
        F.sha2(F.col("user_id").cast("string"), 256), F.sha2("props", 256),
    ]
    line = F.when(i % 17 == 0, F.concat_ws(",", *text[:10])).otherwise(F.concat_ws(",", *text))
    path = scratch_path(spark, "demo-lines")
    e.select(line.alias("line")).write.option("header", True).option("sep", "\u0001").option(
        "quote", ""
    ).csv(path)
    return path


def parquet_copy(df: DataFrame, label: str) -> str:
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return path
