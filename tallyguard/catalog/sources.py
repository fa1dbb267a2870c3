"""Scan, sink and canonicalisation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyguard.catalog.base import EDGES, TX, edges, query, r6, table, tx
from tallyguard.catalog.derived import (
    PLAID_RAW,
    SETU_RAW,
    demo_lines,
    parquet_copy,
    plaid_documents,
    plaid_raw,
    setu_documents,
    setu_raw,
    traffic_csv,
)
from tallyguard.functions.calendar import calendar_features
from tallyguard.functions.identity import hash_pii
from tallyguard.functions.narration import (
    balance_drain,
    bank_of,
    narration_category,
    narration_vpa,
    plaid_category,
    plaid_txn_type,
)
from tallyguard.functions.vectors import statement_vector
from tallyguard.operators.encode import amount_stats
from tallyguard.operators.split import temporal_split
from tallyguard.plans.feed import scored_feed
from tallyguard.session import scratch_path
from tallyguard.sources.canonical import canonicalise, coerce_types, resolve_aliases
from tallyguard.sources.files import (
    require_columns,
    scan_csv,
    scan_demo_csv,
    scan_recent_edges,
)
from tallyguard.sources.sinks import (
    append_events,
    audit_lines,
    publish_deltas,
    read_document,
    read_events,
    write_csv,
    write_document,
    write_features,
)
from tallyguard.sources.statements import (
    normalise_plaid,
    normalise_setu,
    outflows,
    same_day_history,
    scan_plaid,
    scan_setu,
    union_sources,
)

@query(
    "s01_csv_scan",
    """SELECT transaction_id AS txn, us, amount, sender_id, receiver_bank AS receiver_id, fraud_flag,
      transaction_type, receiver_bank, 'UNKNOWN' AS network_type, 0.0::DOUBLE AS txn_frequency FROM tx""",
    TX,
)
def s01(spark, sf):
    rows = canonicalise(scan_csv(spark, traffic_csv(spark, sf)))
    return rows.select(
        F.col("transaction id").alias("txn"), "us", "amount", "sender_id", "receiver_id",
        "fraud_flag", "transaction_type", "receiver_bank", "network_type", "txn_frequency",
    )


@query(
    "s03_csv_drop_malformed",
    """SELECT 'TXN' || event_id AS transaction_id, CASE WHEN event_id % 13 = 0 THEN 0.0 ELSE value END AS amount,
      CASE WHEN event_type = 'error' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS fraud_flag,
      hour(ts)::DOUBLE AS hour_of_day, sha256(cast(user_id AS VARCHAR)) AS device_surrogate
    FROM events WHERE event_id % 17 <> 0""",
)
def s03(spark, sf):
    return scan_demo_csv(spark, demo_lines(spark, sf)).select(
        "transaction_id", "amount", "fraud_flag", "hour_of_day", "device_surrogate"
    )


@query(
    "s04_parquet_scan",
    "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type",
)
def s04(spark, sf):
    rows = require_columns(table(spark, sf, "events"), ["event_type", "value"], "events")
    return rows.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")
    )


@query(
    "s05_pruned_parquet_scan",
    "SELECT src, dst, amount, us, seq FROM edges ORDER BY us DESC, seq DESC LIMIT 5000",
    EDGES,
)
def s05(spark, sf):
    path = parquet_copy(edges(spark, sf).withColumn("unused", F.lit("x")), "edges")
    return scan_recent_edges(spark, path, 5000, "src", "dst")


@query(
    "s06_parquet_sink",
    """SELECT split, count(*) AS n, sum(fraud_flag)::BIGINT AS fraud FROM (SELECT fraud_flag,
      CASE WHEN row_number() OVER (ORDER BY us, seq) <= cast(floor(0.8 * count(*) OVER ()) AS BIGINT)
      THEN 'train' ELSE 'holdout' END AS split FROM tx) GROUP BY split""",
    TX,
)
def s06(spark, sf):
    path = scratch_path(spark, "features")
    write_features(temporal_split(tx(spark, sf)), path)
    return (
        spark.read.parquet(path)
        .groupBy(F.col("split").cast("string").alias("split"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("fraud_flag").alias("fraud"))
    )


@query(
    "s07_csv_sink",
    "SELECT transaction_id, amount, sender_bank FROM tx",
    TX,
)
def s07(spark, sf):
    path = scratch_path(spark, "out-csv")
    write_csv(tx(spark, sf).select("transaction_id", "amount", "sender_bank"), path)
    return scan_csv(spark, path).select(
        "transaction_id", F.col("amount").cast("double").alias("amount"), "sender_bank"
    )


@query(
    "s08_stats_document_io",
    "SELECT round(avg(amount), 6) AS global_mean, round(stddev_samp(amount), 6) AS global_std FROM tx",
    TX,
)
def s08(spark, sf):
    path = scratch_path(spark, "stats")
    write_document(amount_stats(tx(spark, sf)), path)
    back = read_document(spark, path, "global_mean double, global_std double")
    return back.select(r6("global_mean").alias("global_mean"), r6("global_std").alias("global_std"))


@query(
    "s09_setu_json_scan",
    """SELECT account_id, "txnId", amount, narration, type, "currentBalance", date FROM setu_raw""",
    SETU_RAW,
)
def s09(spark, sf):
    return scan_setu(spark, setu_documents(spark, sf))


@query(
    "s10_plaid_json_scan",
    """SELECT transaction_id, amount, merchant_name, name, array_to_string(category, '/') AS categories,
      date, payment_channel, account_id FROM plaid_raw""",
    PLAID_RAW,
)
def s10(spark, sf):
    rows = scan_plaid(spark, plaid_documents(spark, sf))
    return rows.withColumn("categories", F.array_join("category", "/")).drop("category")


@query(
    "s13_audit_jsonl_append",
    """SELECT 'graph_update' AS event, us // 1000000 AS at_s, sha256(sender_id) AS vpa_hash,
      least(amount / 100.0, 1.0) AS risk_delta, transaction_type AS reason,
      'graph | ' || transaction_type || ' | delta=' || printf('%.4f', least(amount / 100.0, 1.0)) AS audit_reason
    FROM tx WHERE fraud_flag = 1""",
    TX,
)
def s13(spark, sf):
    path = scratch_path(spark, "audit")
    deltas = tx(spark, sf).where("fraud_flag = 1").select(
        F.expr("us div 1000000").alias("at_s"),
        F.sha2("sender_id", 256).alias("vpa_hash"),
        (F.col("amount") / 100.0).alias("risk_delta"),
        F.col("transaction_type").alias("reason"),
    )
    append_events(audit_lines(deltas), path, "graph_update")
    return read_events(
        spark, path,
        "event string, at_s bigint, vpa_hash string, risk_delta double, reason string, audit_reason string",
    )


@query(
    "s14_graph_delta_publish",
    """SELECT sha256(sender_id) AS vpa_hash, least(sum(amount) / 10000.0, 1.0) >= 0.25 AS strong,
      'sum' AS reason, max(us) // 1000000 AS _timestamp FROM tx GROUP BY sender_id""",
    TX,
)
def s14(spark, sf):
    path = scratch_path(spark, "deltas")
    risk = tx(spark, sf).groupBy(F.sha2("sender_id", 256).alias("vpa_hash")).agg(
        (F.sum("amount") / 10000.0).alias("risk_delta"), F.lit("sum").alias("reason"),
        F.expr("max(us) div 1000000").alias("at"),
    )
    publish_deltas(risk, path, F.col("at"))
    return spark.read.parquet(path).select(
        "vpa_hash", (F.col("risk_delta") >= 0.25).alias("strong"), "reason", "_timestamp"
    )


@query(
    "p01_alias_resolve",
    """SELECT transaction_id, us, amount, sender_bank AS sender_id, receiver_bank AS receiver_id, receiver_bank,
      fraud_flag, transaction_type, device_type FROM tx""",
    TX,
)
def p01(spark, sf):
    raw = tx(spark, sf).select(
        "transaction_id",
        F.col("ts").alias("Trans_Date_Trans_Time"),
        F.col("amount").alias("AMT"),
        F.col("sender_bank").alias("From_Account"),
        F.col("receiver_bank").alias("Receiver_Bank"),
        F.col("transaction_type").alias("Trans_Type"),
        F.col("device_type").alias("Device_OS"),
        F.col("fraud_flag").alias("Class"),
    )
    return resolve_aliases(raw).select(
        "transaction_id", F.unix_micros("timestamp").alias("us"), "amount", "sender_id",
        "receiver_id", "receiver_bank", "fraud_flag", "transaction_type", "device_type",
    )


@query(
    "p02_date_time_concat",
    "SELECT transaction_id, epoch_us(date_trunc('second', ts)) AS us FROM tx",
    TX,
)
def p02(spark, sf):
    raw = tx(spark, sf).select(
        "transaction_id", "amount", "sender_id", "receiver_id", "fraud_flag",
        F.date_format("ts", "yyyy-MM-dd").alias("Date"),
        F.date_format("ts", "HH:mm:ss").alias("Time"),
    )
    return canonicalise(raw).select("transaction_id", "us")


@query(
    "p03_step_to_timestamp",
    """SELECT transaction_id, epoch_us(TIMESTAMP '2024-01-01 00:00:00') + (seq % 720) * 3600000000 AS us
    FROM tx""",
    TX,
)
def p03(spark, sf):
    raw = tx(spark, sf).drop("ts", "us").withColumn("step", (F.col("seq") % 720).cast("int"))
    return canonicalise(raw).select("transaction_id", "us")


@query(
    "p04_timestamp_coerce_drop",
    "SELECT transaction_id, us FROM tx WHERE seq % 10 <> 0",
    TX,
)
def p04(spark, sf):
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    raw = tx(spark, sf).withColumn("timestamp", F.when(F.col("seq") % 10 == 0, "not a time").otherwise(text))
    return coerce_types(raw.drop("ts", "us")).select(
        "transaction_id", F.unix_micros("ts").alias("us")
    )


@query(
    "p05_numeric_coerce",
    """SELECT transaction_id, CASE WHEN seq % 9 = 0 THEN 0.0 ELSE amount END AS amount,
      CASE WHEN seq % 4 = 0 THEN 0 ELSE fraud_flag END AS fraud_flag FROM tx""",
    TX,
)
def p05(spark, sf):
    raw = tx(spark, sf).select(
        "transaction_id", F.col("ts").alias("timestamp"), "sender_id", "receiver_id",
        F.when(F.col("seq") % 9 == 0, "n/a").otherwise(F.col("amount").cast("string")).alias("amount"),
        F.when(F.col("seq") % 4 != 0, F.col("fraud_flag").cast("string")).alias("fraud_flag"),
    )
    return canonicalise(raw).select("transaction_id", "amount", "fraud_flag")


@query(
    "p06_fill_missing_optional",
    """SELECT transaction_id, 'UNKNOWN' AS device_type, 'UNKNOWN' AS network_type,
      CASE WHEN seq % 3 = 0 THEN NULL ELSE sender_bank END AS sender_bank,
      0.0::DOUBLE AS txn_frequency, 0.0::DOUBLE AS days_since_last_txn FROM tx""",
    TX,
)
def p06(spark, sf):
    raw = tx(spark, sf).select(
        "transaction_id", F.col("ts").alias("timestamp"), "sender_id", "receiver_id", "amount",
        "fraud_flag", F.when(F.col("seq") % 3 != 0, F.col("sender_bank")).alias("sender_bank"),
    )
    return canonicalise(raw).select(
        "transaction_id", "device_type", "network_type", "sender_bank", "txn_frequency",
        "days_since_last_txn",
    )


@query(
    "p07_hash_pii",
    """SELECT transaction_id, substr(sha256(sender_id), 1, 12) AS sender_hash,
      substr(sha256(CASE WHEN seq % 50 = 0 THEN 'nan' ELSE receiver_id END), 1, 12) AS receiver_hash FROM tx""",
    TX,
)
def p07(spark, sf):
    gaps = tx(spark, sf).withColumn(
        "receiver_id", F.when(F.col("seq") % 50 != 0, F.col("receiver_id"))
    )
    return hash_pii(gaps).select("transaction_id", "sender_hash", "receiver_hash")


@query(
    "p09_calendar_features",
    """SELECT transaction_id, hour(ts) AS hour_of_day, isodow(ts) - 1 AS day_of_week,
      CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS is_weekend FROM tx""",
    TX,
)
def p09(spark, sf):
    return calendar_features(tx(spark, sf)).select(
        "transaction_id", "hour_of_day", "day_of_week", "is_weekend"
    )


_CAT = """CASE WHEN regexp_matches(upper(narration), 'ZOMATO|SWIGGY|FOOD|RESTAU|CAFE|HOTEL|BHOJAN') THEN 'FOOD'
 WHEN regexp_matches(upper(narration), 'ELECTRIC|WATER|GAS|BILL|BSNL|JIO|AIRTEL|DTH|RECHARGE') THEN 'UTILITY'
 WHEN regexp_matches(upper(narration), 'AMAZON|FLIPKART|MYNTRA|AJIO|MEESHO|SHOP|STORE|MART') THEN 'ECOM'
 WHEN regexp_matches(upper(narration), 'TRAVEL|IRCTC|RAILWAY|REDBUS|MAKEMYTRIP|OLA|UBER|RAPIDO') THEN 'TRAVEL'
 WHEN regexp_matches(upper(narration), 'GAMEZ?|RUMMY|DREAM11|MPL|LOTTERY|CASINO|BET') THEN 'GAMBLING'
 ELSE 'P2P' END"""
_VPA = r"""coalesce(nullif(lower(regexp_extract(narration, 'UPI/([A-Za-z0-9._@-]+)/?', 1)), ''),
 coalesce(nullif(substr(regexp_replace(lower(narration), '[^a-z0-9]', '', 'g'), 1, 12), ''), 'merchant') || '@upi')"""


def _bank(c: str) -> str:
    pairs = [("AXIS", "axisbank"), ("HDFC", "okhdfc"), ("ICICI", "okicici"), ("SBI", "sbi"),
             ("KOTAK", "kotak"), ("YES", "yesbank"), ("PAYTM", "paytm"), ("GPAY", "okicici")]
    return "CASE " + " ".join(f"WHEN contains(upper({c}), '{k}') THEN '{v}'" for k, v in pairs) + " ELSE 'UNKNOWN' END"


_DAY_N = "count(*) OVER (PARTITION BY account_id, substr(date, 1, 10))"


@query(
    "p17_setu_normalize",
    f"""SELECT "txnId" AS transaction_id, account_id || '@upi' AS sender_vpa, {_VPA} AS receiver_vpa,
      amount AS amount_inr, epoch_us(local_ts) AS local_us, {_CAT} AS merchant_category,
      CASE WHEN {_CAT} = 'P2P' THEN 'P2P' ELSE 'P2M' END AS transaction_type,
      {_bank('account_id')} AS sender_bank, {_bank('narration')} AS receiver_bank, n AS device_txn_count_24h
    FROM (SELECT *, {_DAY_N} AS n FROM setu_raw) WHERE type = 'DEBIT' AND amount > 0""",
    SETU_RAW,
)
def p17(spark, sf):
    return normalise_setu(setu_raw(spark, sf).drop("seq")).select(
        "transaction_id", "sender_vpa", "receiver_vpa", "amount_inr",
        F.unix_micros("local_ts").alias("local_us"), "merchant_category", "transaction_type",
        "sender_bank", "receiver_bank", "device_txn_count_24h",
    )


_PCAT = """CASE c WHEN 'Food and Drink' THEN 'FOOD' WHEN 'Restaurants' THEN 'FOOD' WHEN 'Fast Food' THEN 'FOOD'
 WHEN 'Travel' THEN 'TRAVEL' WHEN 'Airlines and Aviation Services' THEN 'TRAVEL' WHEN 'Taxi' THEN 'TRAVEL'
 WHEN 'Utilities' THEN 'UTILITY' WHEN 'Phone' THEN 'UTILITY' WHEN 'Internet' THEN 'UTILITY'
 WHEN 'Recreation' THEN 'GAMBLING' WHEN 'Gambling' THEN 'GAMBLING' WHEN 'Shops' THEN 'ECOM'
 WHEN 'Digital Purchase' THEN 'ECOM' WHEN 'Clothing and Accessories' THEN 'ECOM' END"""
_PCATEGORY = (
    f"coalesce(list_filter(list_transform(category, lambda c: {_PCAT}), lambda x: x IS NOT NULL)[1], 'ECOM')"
)
_MERCHANT = "lower(coalesce(nullif(merchant_name, ''), nullif(name, ''), 'merchant'))"
_PTYPE = "CASE WHEN list_contains(category, 'Transfer') OR payment_channel = 'other' THEN 'P2P' ELSE 'P2M' END"


@query(
    "p18_plaid_normalize",
    f"""SELECT transaction_id, 'user.' || substr(account_id, 1, 8) || '@upi' AS sender_vpa,
      coalesce(nullif(substr(regexp_replace({_MERCHANT}, '[^a-z0-9]', '', 'g'), 1, 14), ''), 'merchant') || '@upi'
        AS receiver_vpa, round(abs(amount) * 83.5, 4) AS amount_inr, {_PCATEGORY} AS merchant_category,
      {_PTYPE} AS transaction_type,
      CASE WHEN contains({_MERCHANT}, 'apple') THEN 'iOS' ELSE 'Android' END AS device_type FROM plaid_raw""",
    PLAID_RAW,
)
def p18(spark, sf):
    return normalise_plaid(plaid_raw(spark, sf).drop("seq")).select(
        "transaction_id", "sender_vpa", "receiver_vpa",
        F.round("amount_inr", 4).alias("amount_inr"), "merchant_category", "transaction_type",
        "device_type",
    )


@query(
    "p16_normalized_vector",
    f"""SELECT "txnId" AS transaction_id, amount AS f0, hour(local_ts)::DOUBLE AS f1,
      (isodow(local_ts) - 1)::DOUBLE AS f2, CASE WHEN isodow(local_ts) >= 6 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS f3,
      greatest(1, greatest(1, n // 4) // 6)::DOUBLE AS f5, greatest(1, n // 4)::DOUBLE AS f6, n::DOUBLE AS f7,
      round(greatest(-5.0, least(5.0, (amount - 3200.0) / 8500.0)), 6) + 0.0 AS f13,
      CASE WHEN {_CAT} = 'P2P' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS f16, n::DOUBLE AS f22, 24 AS length
    FROM (SELECT *, {_DAY_N} AS n FROM setu_raw) WHERE type = 'DEBIT' AND amount > 0""",
    SETU_RAW,
)
def p16(spark, sf):
    v = normalise_setu(setu_raw(spark, sf).drop("seq")).withColumn("v", statement_vector())
    picked = [F.col("v")[i].alias(f"f{i}") for i in (0, 1, 2, 3, 5, 6, 7, 16, 22)]
    return v.select(
        "transaction_id", *picked, r6(F.col("v")[13]).alias("f13"), F.size("v").alias("length")
    )


@query(
    "p19_narration_category", f"SELECT seq, {_CAT} AS category FROM setu_raw", SETU_RAW
)
def p19(spark, sf):
    return setu_raw(spark, sf).select("seq", narration_category("narration").alias("category"))


@query("p20_narration_vpa", f"SELECT seq, {_VPA} AS vpa FROM setu_raw", SETU_RAW)
def p20(spark, sf):
    return setu_raw(spark, sf).select("seq", narration_vpa("narration").alias("vpa"))


@query(
    "p21_bank_detect",
    f"SELECT seq, {_bank('account_id')} AS sender_bank, {_bank('narration')} AS receiver_bank FROM setu_raw",
    SETU_RAW,
)
def p21(spark, sf):
    return setu_raw(spark, sf).select(
        "seq", bank_of("account_id").alias("sender_bank"), bank_of("narration").alias("receiver_bank")
    )


@query(
    "p22_outflow_filter",
    "SELECT seq, amount FROM setu_raw WHERE type = 'DEBIT' AND amount > 0",
    SETU_RAW,
)
def p22(spark, sf):
    return outflows(setu_raw(spark, sf)).select("seq", "amount")


@query(
    "p23_txn_type_rules",
    f"SELECT seq, {_PTYPE} AS transaction_type FROM plaid_raw",
    PLAID_RAW,
)
def p23(spark, sf):
    return plaid_raw(spark, sf).select(
        "seq", plaid_txn_type("payment_channel", "category").alias("transaction_type")
    )


@query(
    "p24_balance_drain",
    """SELECT seq, round(CASE WHEN amount > 0 THEN least(1.0, amount / greatest("currentBalance", 1.0))
      ELSE 0.0 END, 6) + 0.0 AS drain FROM setu_raw""",
    SETU_RAW,
)
def p24(spark, sf):
    return setu_raw(spark, sf).select(
        "seq", r6(balance_drain("amount", "currentBalance")).alias("drain")
    )


@query(
    "j07_plaid_category_map",
    f"SELECT seq, {_PCATEGORY} AS category FROM plaid_raw",
    PLAID_RAW,
)
def j07(spark, sf):
    return plaid_raw(spark, sf).select("seq", plaid_category("category").alias("category"))


@query(
    "a25_same_day_history",
    f"""SELECT seq, n AS c24, greatest(1, n // 4) AS c6, greatest(1, greatest(1, n // 4) // 6) AS c1
    FROM (SELECT seq, {_DAY_N} AS n FROM setu_raw)""",
    SETU_RAW,
)
def a25(spark, sf):
    return same_day_history(setu_raw(spark, sf)).select(
        "seq",
        F.col("device_txn_count_24h").alias("c24"),
        F.col("device_txn_count_6h").alias("c6"),
        F.col("device_txn_count_1h").alias("c1"),
    )


@query(
    "u01_union_sources",
    """SELECT 'setu' AS source, count(*) AS n, round(sum(amount), 2) AS total FROM setu_raw
      WHERE type = 'DEBIT' AND amount > 0
    UNION ALL SELECT 'plaid', count(*), round(sum(abs(amount) * 83.5), 2) FROM plaid_raw""",
    SETU_RAW + ", " + PLAID_RAW,
)
def u01(spark, sf):
    both = union_sources(
        normalise_setu(setu_raw(spark, sf).drop("seq")),
        normalise_plaid(plaid_raw(spark, sf).drop("seq")),
    )
    return both.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("amount_inr"), 2).alias("total")
    )


_RULE = "CASE WHEN a > 40000 OR contains(v, 'agent') OR contains(v, 'cash') THEN {0} WHEN a > 10000 OR contains(v, 'wallet') OR contains(v, 'crypto') THEN {1} ELSE {2} END"


@query(
    "u01_scored_feed",
    f"""SELECT source, transaction_id, {_RULE.format("'BLOCK'", "'FLAG'", "'ALLOW'")} AS verdict,
      {_RULE.format("0.89::DOUBLE", "0.58::DOUBLE", "0.1::DOUBLE")} AS lgbm_score FROM (
      SELECT 'setu' AS source, "txnId" AS transaction_id, amount AS a, {_VPA} AS v FROM setu_raw
        WHERE type = 'DEBIT' AND amount > 0
      UNION ALL SELECT 'plaid', transaction_id, abs(amount) * 83.5,
        coalesce(nullif(substr(regexp_replace({_MERCHANT}, '[^a-z0-9]', '', 'g'), 1, 14), ''), 'merchant') || '@upi' FROM plaid_raw)""",
    SETU_RAW + ", " + PLAID_RAW,
)
def u01_feed(spark, sf):
    both = union_sources(
        normalise_setu(setu_raw(spark, sf).drop("seq")),
        normalise_plaid(plaid_raw(spark, sf).drop("seq")),
    )
    return scored_feed(both).select("source", "transaction_id", "verdict", "lgbm_score")
