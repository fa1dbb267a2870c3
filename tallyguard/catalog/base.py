"""Registry of runnable queries, each with its ANSI-SQL counterpart, and their inputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, ctes: str | None = None):
    """Register a query; ``ctes`` are prepended to ``sql`` as a WITH list."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = f"WITH {ctes} {sql}" if ctes else sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def tx(spark: SparkSession, sf: str) -> DataFrame:
    """Events as canonical transactions."""
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k")
    return e.select(
        F.col("event_id").cast("string").alias("transaction_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
        F.concat(F.lit("D"), F.col("user_id").cast("string")).alias("sender_id"),
        F.concat(F.lit("M"), k).alias("receiver_id"),
        F.col("value").alias("amount"),
        F.col("event_type").alias("transaction_type"),
        F.when(F.col("user_id") % 3 == 0, "Android")
        .when(F.col("user_id") % 3 == 1, "iOS")
        .otherwise("Harmony OS")
        .alias("device_type"),
        F.lit("UNKNOWN").alias("network_type"),
        F.concat(F.lit("B"), (F.col("user_id") % 8).cast("string")).alias("sender_bank"),
        F.concat(F.lit("B"), (k.cast("bigint") % 8).cast("string")).alias("receiver_bank"),
        (F.col("event_id") % 5).cast("double").alias("txn_frequency"),
        ((F.col("event_id") % 3) / 2.0).alias("days_since_last_txn"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("fraud_flag"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
    )


def hourly(df: DataFrame) -> DataFrame:
    """The same rows with times cut to the hour: many equal timestamps."""
    return df.withColumn("ts", F.date_trunc("hour", "ts")).withColumn(
        "us", F.unix_micros("ts")
    )


def payments(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as customer-to-supplier payments."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"
    )
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("sender_id"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("receiver_id"),
        F.col("l_extendedprice").alias("amount"),
        F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("us"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
    )


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """Events as edges of one node namespace, so that cycles exist."""
    k = F.get_json_object("props", "$.k")
    return table(spark, sf, "events").select(
        F.concat(F.lit("N"), F.col("user_id").cast("string")).alias("src"),
        F.concat(F.lit("N"), k).alias("dst"),
        F.col("value").alias("amount"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        F.col("event_id").alias("seq"),
    )


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Transactions with given score columns, for fusion, band and metric queries."""
    return tx(spark, sf).select(
        "transaction_id",
        "seq",
        "us",
        "ts",
        "sender_id",
        "receiver_id",
        "amount",
        "transaction_type",
        "fraud_flag",
        F.least(F.lit(1.0), F.col("amount") / 128.0).alias("p"),
        (F.col("seq") % 101 / 100.0).alias("a"),
        (F.col("seq") % 7 == 0).alias("topo"),
        (F.col("seq") % 11 / 10.0).alias("delta"),
    )


def r6(column) -> F.Column:
    """Rounded to six digits, without negative zero."""
    return F.round(F.col(column) if isinstance(column, str) else column, 6) + F.lit(0.0)


def r9(column) -> F.Column:
    """Rounded to nine digits: for ratios of two-digit amounts that tie at the seventh."""
    return F.round(F.col(column) if isinstance(column, str) else column, 9) + F.lit(0.0)


TX = """tx AS (
SELECT cast(event_id AS VARCHAR) AS transaction_id, ts, event_id AS seq,
       'D' || user_id AS sender_id, 'M' || json_extract_string(props, '$.k') AS receiver_id,
       value AS amount, event_type AS transaction_type,
       CASE user_id % 3 WHEN 0 THEN 'Android' WHEN 1 THEN 'iOS' ELSE 'Harmony OS' END AS device_type,
       'UNKNOWN' AS network_type, 'B' || (user_id % 8) AS sender_bank,
       'B' || (cast(json_extract_string(props, '$.k') AS BIGINT) % 8) AS receiver_bank,
       cast(event_id % 5 AS DOUBLE) AS txn_frequency, (event_id % 3) / 2.0::DOUBLE AS days_since_last_txn,
       CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS fraud_flag, epoch_us(ts) AS us
FROM events)"""

TIES = TX + """, th AS (SELECT * REPLACE (date_trunc('hour', ts) AS ts,
       epoch_us(date_trunc('hour', ts)) AS us) FROM tx)"""

PAY = """pay AS (
SELECT 'C' || o_custkey AS sender_id, 'S' || l_suppkey AS receiver_id, l_extendedprice AS amount,
       epoch_us(o_orderdate) AS us, l_orderkey * 10 + l_linenumber AS seq
FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

EDGES = """edges AS (
SELECT 'N' || user_id AS src, 'N' || json_extract_string(props, '$.k') AS dst, value AS amount,
       epoch_us(ts) AS us, event_id AS seq FROM events)"""

SCORED = TX + """, scored AS (
SELECT transaction_id, seq, us, ts, sender_id, receiver_id, amount, transaction_type, fraud_flag,
       least(1.0::DOUBLE, amount / 128.0::DOUBLE) AS p, (seq % 101) / 100.0::DOUBLE AS a,
       seq % 7 = 0 AS topo, (seq % 11) / 10.0::DOUBLE AS delta FROM tx)"""
