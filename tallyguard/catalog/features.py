"""Encoding, feature-table, vector and split queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyguard.catalog.base import TX, query, r6, r9, tx
from tallyguard.functions.identity import bank_to_vpa, first_filled, hash_id, mask_vpa
from tallyguard.functions.vectors import (
    REQUEST_AMOUNT,
    STATEMENT_AMOUNT,
    feature_vector,
    fixed_zscore,
    request_vector,
    resize_vector,
    split_by_length,
)
from tallyguard.operators.encode import (
    amount_stats,
    corridor_fit,
    corridor_flag,
    ordinal_encode,
    ordinal_fit,
)
from tallyguard.operators.split import temporal_split
from tallyguard.plans.compile import assemble, compile_features, global_zscore
from tallyguard.schema import CATEGORICALS, FEATURE_ORDER, NUMERIC_OPTIONALS

SPLIT = TX + """, sp AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY us, seq)
  <= cast(floor(0.8 * count(*) OVER ()) AS BIGINT) THEN 'train' ELSE 'holdout' END AS split FROM tx),
  tr AS (SELECT * FROM sp WHERE split = 'train')"""
RATE = 0.20


def _split(spark, sf):
    return temporal_split(tx(spark, sf))


def _train(spark, sf):
    return _split(spark, sf).where("split = 'train'")


@query(
    "p08_hash_full",
    """SELECT transaction_id, sha256(transaction_id) AS txn_hash, sha256(sender_id) AS device_hash FROM tx""",
    TX,
)
def p08(spark, sf):
    return tx(spark, sf).select(
        "transaction_id",
        hash_id("transaction_id").alias("txn_hash"),
        hash_id("sender_id").alias("device_hash"),
    )


@query(
    "p10_amount_zscore_global",
    """SELECT transaction_id, round((amount - m) / (s + 1e-9), 6) + 0.0 AS z,
      round(greatest(-5.0, least(5.0, (amount * 200 - 3200.0) / 8500.0)), 9) + 0.0 AS z_statement,
      round(greatest(-5.0, least(5.0, (amount * 200 - 3000.0) / 12000.0)), 9) + 0.0 AS z_request
    FROM tx CROSS JOIN (SELECT avg(amount) AS m, stddev_samp(amount) AS s FROM tr)""",
    SPLIT,
)
def p10(spark, sf):
    out = global_zscore(tx(spark, sf), amount_stats(_train(spark, sf)))
    large = F.col("amount") * 200
    return out.select(
        "transaction_id",
        r6("amount_zscore_global").alias("z"),
        r9(fixed_zscore(large, *STATEMENT_AMOUNT)).alias("z_statement"),
        r9(fixed_zscore(large, *REQUEST_AMOUNT)).alias("z_request"),
    )


def _code(c: str) -> str:
    return f"""coalesce((SELECT k FROM codes WHERE codes.c = '{c}' AND codes.v = b.{c}), -1)"""


_CODES = "codes AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS c, {c} AS v, row_number() OVER (ORDER BY {c}) - 1 AS k FROM "
    f"(SELECT DISTINCT {c} FROM tr)"
    for c in CATEGORICALS
) + ")"
_RISKY = f"""risky AS (SELECT sender_bank, receiver_bank FROM tr GROUP BY ALL
  HAVING sum(fraud_flag) / count(*)::DOUBLE > {RATE})"""


def _w(key: str, w: int, fn: str = "count(*)") -> str:
    return (
        f"{fn} OVER (PARTITION BY split, {key} ORDER BY us "
        f"RANGE BETWEEN {w} PRECEDING AND 1 PRECEDING)"
    )


_M10, _H1, _H6, _D1 = 600_000_000, 3_600_000_000, 21_600_000_000, 86_400_000_000
_FEATURES = {
    "amount": "amount",
    "hour_of_day": "hour(ts)",
    "day_of_week": "isodow(ts) - 1",
    "is_weekend": "CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END",
    "device_txn_count_10m": _w("sender_id", _M10),
    "device_txn_count_1h": _w("sender_id", _H1),
    "device_txn_count_6h": _w("sender_id", _H6),
    "device_txn_count_24h": _w("sender_id", _D1),
    "device_amount_zscore_24h": (
        f"CASE WHEN {_w('sender_id', _D1)} >= 2 THEN greatest(-10.0, least(10.0, "
        f"(amount - {_w('sender_id', _D1, 'avg(amount)')}) / "
        f"(coalesce({_w('sender_id', _D1, 'stddev_samp(amount)')}, 0.0) + 1e-9))) ELSE 0.0 END"
    ),
    "receiver_unique_senders_10m": _w("receiver_id", _M10, "count(DISTINCT sender_id)"),
    "receiver_txn_count_1h": _w("receiver_id", _H1),
    "receiver_txn_count_24h": _w("receiver_id", _D1),
    "receiver_unique_senders_1h": _w("receiver_id", _H1, "count(DISTINCT sender_id)"),
    "amount_zscore_global": "(amount - gm) / (gs + 1e-9)",
    "is_new_device": "CASE WHEN row_number() OVER (PARTITION BY split, sender_id ORDER BY us, seq) = 1 THEN 1 ELSE 0 END",
    "is_new_receiver": "CASE WHEN row_number() OVER (PARTITION BY split, receiver_id ORDER BY us, seq) = 1 THEN 1 ELSE 0 END",
    **{f"enc_{c}": _code(c) for c in CATEGORICALS},
    "is_high_risk_corridor": (
        "CASE WHEN (sender_bank, receiver_bank) IN (SELECT (sender_bank, receiver_bank) FROM risky) "
        "THEN 1 ELSE 0 END"
    ),
    "txn_frequency": "txn_frequency",
    "days_since_last_txn": "days_since_last_txn",
}


@query(
    "p11_assemble_features",
    "SELECT seq, split, "
    + ", ".join(f"round(cast(cast({e} AS FLOAT) AS DOUBLE), 4) + 0.0 AS {n}" for n, e in _FEATURES.items())
    + """, fraud_flag FROM sp b
      CROSS JOIN (SELECT avg(amount) AS gm, stddev_samp(amount) AS gs FROM tr)""",
    SPLIT + ", " + _CODES + ", " + _RISKY,
)
def p11(spark, sf):
    wide = compile_features(tx(spark, sf), corridor_rate=RATE)
    table = assemble(wide, ["seq", "split"])
    # Stored as FLOAT; shown as four-digit doubles for the value comparison.
    return table.select(
        "seq",
        "split",
        *[(F.round(F.col(c).cast("double"), 4) + F.lit(0.0)).alias(c) for c in FEATURE_ORDER],
        F.col("fraud_flag").cast("int").alias("fraud_flag"),
    )


@query(
    "p12_feature_vector",
    """SELECT seq, amount::FLOAT::DOUBLE AS f0, txn_frequency AS f1, days_since_last_txn AS f2, 3 AS length FROM tx""",
    TX,
)
def p12(spark, sf):
    df = tx(spark, sf)
    v = df.withColumn("v", feature_vector(df, ["amount", "txn_frequency", "days_since_last_txn"]))
    return v.select(
        "seq", *[F.col("v")[i].cast("double").alias(f"f{i}") for i in range(3)], F.size("v").alias("length")
    )


def _short_vector(df):
    n = (F.col("seq") % 11).cast("int")
    ones = F.transform(F.sequence(F.lit(1), F.lit(11)), lambda i: (i * 2).cast("float"))
    return df.withColumn("v", F.slice(ones, F.lit(1), n))


@query(
    "p13_vector_resize_inject",
    "SELECT seq, amount::FLOAT::DOUBLE AS v1, "
    + ", ".join(
        f"CASE WHEN {i} <= seq % 11 THEN {2 * i}.0::DOUBLE ELSE 0.0::DOUBLE END AS v{i}" for i in range(2, 9)
    )
    + ", 8 AS length FROM tx",
    TX,
)
def p13(spark, sf):
    out = _short_vector(tx(spark, sf)).withColumn("r", resize_vector("v", "amount", 8))
    return out.select(
        "seq", *[F.col("r")[i - 1].cast("double").alias(f"v{i}") for i in range(1, 9)],
        F.size("r").alias("length"),
    )


@query(
    "p14_vector_length_check",
    """SELECT seq % 11 = 8 AS accepted, count(*) AS n FROM tx GROUP BY 1""",
    TX,
)
def p14(spark, sf):
    good, bad = split_by_length(_short_vector(tx(spark, sf)), "v", 8)
    both = good.select(F.lit(True).alias("accepted")).unionByName(
        bad.select(F.lit(False).alias("accepted"))
    )
    return both.groupBy("accepted").agg(F.count(F.lit(1)).alias("n"))


def _requests(spark, sf):
    df = tx(spark, sf)
    return df.select(
        "seq",
        "amount",
        F.when(F.col("seq") % 3 == 0, "p2m").when(F.col("seq") % 3 == 1, "DEBIT").otherwise("Recharge").alias("transaction_type"),
        F.when(F.col("seq") % 2 == 0, "ios").otherwise("web").alias("device_type"),
        F.hour("ts").alias("hour_of_day"),
        F.weekday("ts").alias("day_of_week"),
        (F.col("seq") % 6).alias("transactions_last_1h"),
        (F.col("seq") % 31).alias("transactions_last_24h"),
        fixed_zscore("amount", *REQUEST_AMOUNT).alias("amount_zscore"),
        (F.col("seq") % 4 == 0).alias("is_new_device"),
        (F.col("seq") % 5 == 0).alias("is_new_merchant"),
    )


@query(
    "p15_api_payload_vector",
    """SELECT seq, amount AS f0, hour(ts)::DOUBLE AS f1, CASE WHEN isodow(ts) >= 6 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS f3,
      (seq % 6)::DOUBLE AS f5, ((seq % 31) // 4)::DOUBLE AS f6, (seq % 31)::DOUBLE AS f7,
      CASE WHEN seq % 4 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS f14,
      CASE seq % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 3.0::DOUBLE END AS f16,
      CASE WHEN seq % 2 = 0 THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END AS f17, 24 AS length FROM tx""",
    TX,
)
def p15(spark, sf):
    out = _requests(spark, sf).withColumn("v", request_vector())
    return out.select(
        "seq", *[F.col("v")[i].alias(f"f{i}") for i in (0, 1, 3, 5, 6, 7, 14, 16, 17)],
        F.size("v").alias("length"),
    )


@query(
    "p31_mask_vpa",
    """SELECT seq, CASE WHEN seq % 3 = 0 THEN '98****' || printf('%02d', seq % 100) || '@ybl'
      WHEN seq % 3 = 1 THEN 'ravi.kumar@axisbank' ELSE '9876543210' END AS masked FROM tx""",
    TX,
)
def p31(spark, sf):
    phone = F.format_string("98765432%02d@ybl", F.col("seq") % 100)
    vpa = (
        F.when(F.col("seq") % 3 == 0, phone)
        .when(F.col("seq") % 3 == 1, "ravi.kumar@axisbank")
        .otherwise("9876543210")
    )
    return tx(spark, sf).select("seq", mask_vpa(vpa).alias("masked"))


@query(
    "p32_bank_to_vpa",
    """SELECT seq, regexp_replace(lower('Bank of ' || sender_bank), '[^a-z0-9]', '', 'g') || '.' ||
      CASE WHEN seq % 7 = 0 THEN 'demo' ELSE substr(sha256(sender_id), 1, 6) END || '@upi' AS vpa FROM tx""",
    TX,
)
def p32(spark, sf):
    surrogate = F.when(F.col("seq") % 7 == 0, "").otherwise(hash_id("sender_id"))
    return tx(spark, sf).select(
        "seq", bank_to_vpa(F.concat(F.lit("Bank of "), "sender_bank"), surrogate).alias("vpa")
    )


@query(
    "p33_coalesce_endpoint",
    """SELECT seq, CASE WHEN seq % 4 = 0 THEN sender_bank WHEN seq % 4 = 1 THEN 'unknown_sender' ELSE sender_id END AS sender
    FROM tx""",
    TX,
)
def p33(spark, sf):
    m = F.col("seq") % 4
    rows = tx(spark, sf).select(
        "seq",
        F.when(m == 0, "").when(m != 1, F.col("sender_id")).alias("sender_vpa"),
        F.when(m != 1, F.col("sender_bank")).alias("sender_bank"),
    )
    return rows.select(
        "seq", first_filled(["sender_vpa", "sender_bank"], "unknown_sender").alias("sender")
    )


@query(
    "j01_ordinal_encode",
    "SELECT seq, " + ", ".join(f"{_code(c)}::DOUBLE AS enc_{c}" for c in CATEGORICALS) + " FROM sp b",
    SPLIT + ", " + _CODES,
)
def j01(spark, sf):
    rows = _split(spark, sf)
    maps = ordinal_fit(rows.where("split = 'train'"), CATEGORICALS)
    return ordinal_encode(rows, maps).select("seq", *[f"enc_{c}" for c in CATEGORICALS])


@query(
    "j02_corridor_flag",
    """SELECT seq, CASE WHEN (sender_bank, receiver_bank) IN (SELECT (sender_bank, receiver_bank) FROM risky)
      THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS is_high_risk_corridor FROM tx""",
    SPLIT + ", " + _RISKY,
)
def j02(spark, sf):
    risky = corridor_fit(_train(spark, sf), RATE)
    return corridor_flag(tx(spark, sf), risky).select("seq", "is_high_risk_corridor")


@query(
    "a01_global_amount_stats",
    "SELECT round(avg(amount), 6) AS global_mean, round(stddev_samp(amount), 6) AS global_std FROM tr",
    SPLIT,
)
def a01(spark, sf):
    return amount_stats(_train(spark, sf)).select(
        r6("global_mean").alias("global_mean"), r6("global_std").alias("global_std")
    )


_ALL_CODES = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", v AS category, row_number() OVER (ORDER BY v) - 1 AS code FROM "
    f"(SELECT DISTINCT cast({c} AS VARCHAR) AS v FROM tr)"
    for c in CATEGORICALS + NUMERIC_OPTIONALS
)


@query("a02_ordinal_fit", _ALL_CODES, SPLIT)
def a02(spark, sf):
    return ordinal_fit(_train(spark, sf))


@query(
    "a03_corridor_fit",
    f"""SELECT sender_bank, receiver_bank, sum(fraud_flag)::BIGINT AS frauds, count(*) AS txns,
      round(sum(fraud_flag) / count(*)::DOUBLE, 6) AS fraud_rate FROM tr GROUP BY sender_bank, receiver_bank
      HAVING sum(fraud_flag) / count(*)::DOUBLE > {RATE}""",
    SPLIT,
)
def a03(spark, sf):
    return corridor_fit(_train(spark, sf), RATE).select(
        "sender_bank", "receiver_bank", "frauds", "txns", r6("fraud_rate").alias("fraud_rate")
    )


@query("o01_chronological_sort", "SELECT seq, us, amount FROM tx ORDER BY us, seq", TX)
def o01(spark, sf):
    return tx(spark, sf).select("seq", "us", "amount").orderBy("us", "seq")


@query("o02_temporal_split_80_20", "SELECT seq, split FROM sp", SPLIT)
def o02(spark, sf):
    return _split(spark, sf).select("seq", "split")


@query(
    "o03_inner_validation_split",
    """SELECT seq, CASE WHEN row_number() OVER (ORDER BY us, seq) <= cast(floor(0.8 * count(*) OVER ()) AS BIGINT)
      THEN 'inner_train' ELSE 'inner_val' END AS part FROM tr""",
    SPLIT,
)
def o03(spark, sf):
    inner = temporal_split(
        _train(spark, sf), names=("inner_train", "inner_val"), column="part"
    )
    return inner.select("seq", "part")


@query(
    "o10_sorted_corridors",
    "SELECT sender_bank || '|' || receiver_bank AS corridor FROM risky ORDER BY corridor",
    SPLIT + ", " + _RISKY,
)
def o10(spark, sf):
    return corridor_fit(_train(spark, sf), RATE).select("corridor").orderBy("corridor")

