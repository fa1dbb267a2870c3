"""Window queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyguard.catalog.base import PAY, TIES, TX, hourly, payments, query, r6, tx
from tallyguard.operators.encode import amount_stats
from tallyguard.operators.running import (
    first_seen,
    neighbour_times,
    prior_count,
    prior_moments,
    running_amounts,
)
from tallyguard.operators.trailing import trailing_distinct, trailing_windows
from tallyguard.plans.compile import (
    DEVICE_COUNTS,
    RECEIVER_COUNTS,
    RECEIVER_SENDERS,
    device_zscore,
)
from tallyguard.plans.live import burst_patterns, live_features, topology_signal
from tallyguard.schema import DAY

M10, H1, H6, D1 = 600_000_000, 3_600_000_000, 21_600_000_000, 86_400_000_000


def _cnt(key: str, w: int, name: str) -> str:
    return (
        f"count(*) OVER (PARTITION BY {key} ORDER BY us "
        f"RANGE BETWEEN {w} PRECEDING AND 1 PRECEDING) AS {name}"
    )


@query(
    "w01_device_txn_count",
    f"""SELECT transaction_id, {_cnt('sender_id', M10, 'device_txn_count_10m')},
    {_cnt('sender_id', H1, 'device_txn_count_1h')}, {_cnt('sender_id', H6, 'device_txn_count_6h')},
    {_cnt('sender_id', D1, 'device_txn_count_24h')} FROM tx""",
    TX,
)
def w01(spark, sf):
    out = trailing_windows(tx(spark, sf), ["sender_id"], DEVICE_COUNTS)
    return out.select("transaction_id", *DEVICE_COUNTS)


@query(
    "w01_payments_scale",
    f"""SELECT seq, {_cnt('sender_id', 7 * D1, 'c7d')}, {_cnt('sender_id', 30 * D1, 'c30d')} FROM pay""",
    PAY,
)
def w01_pay(spark, sf):
    out = trailing_windows(payments(spark, sf), ["sender_id"], {"c7d": 7 * DAY, "c30d": 30 * DAY})
    return out.select("seq", "c7d", "c30d")


@query(
    "w02_device_amount_zscore",
    f"""SELECT transaction_id, round(CASE WHEN n >= 2 THEN greatest(-10.0, least(10.0,
      (amount - m) / (coalesce(s, 0.0) + 1e-9))) ELSE 0.0 END, 6) + 0.0 AS device_amount_zscore_24h
    FROM (SELECT transaction_id, amount, count(*) OVER w AS n, avg(amount) OVER w AS m,
      stddev_samp(amount) OVER w AS s FROM tx WINDOW w AS (PARTITION BY sender_id ORDER BY us
      RANGE BETWEEN {D1} PRECEDING AND 1 PRECEDING))""",
    TX,
)
def w02(spark, sf):
    out = trailing_windows(
        tx(spark, sf), ["sender_id"], {"device_txn_count_24h": DAY}, "amount", {"_d24": DAY}
    )
    return device_zscore(out).select(
        "transaction_id", r6("device_amount_zscore_24h").alias("device_amount_zscore_24h")
    )


@query(
    "w03_receiver_txn_count",
    f"""SELECT transaction_id, {_cnt('receiver_id', H1, 'receiver_txn_count_1h')},
    {_cnt('receiver_id', D1, 'receiver_txn_count_24h')} FROM tx""",
    TX,
)
def w03(spark, sf):
    out = trailing_windows(tx(spark, sf), ["receiver_id"], RECEIVER_COUNTS)
    return out.select("transaction_id", *RECEIVER_COUNTS)


def _uniq_row(view: str, w: int, name: str, alias: str) -> str:
    return f"""{alias} AS (SELECT x.seq, count(DISTINCT y.sender_id) AS {name} FROM {view} x
    LEFT JOIN {view} y ON y.receiver_id = x.receiver_id AND y.us BETWEEN x.us - {w} AND x.us
      AND (y.us < x.us OR y.seq < x.seq) GROUP BY x.seq)"""


@query(
    "w04_receiver_unique_senders",
    """SELECT u1.seq, receiver_unique_senders_10m, receiver_unique_senders_1h
    FROM u1 JOIN u2 ON u1.seq = u2.seq""",
    TIES
    + ", "
    + _uniq_row("th", M10, "receiver_unique_senders_10m", "u1")
    + ", "
    + _uniq_row("th", H1, "receiver_unique_senders_1h", "u2"),
)
def w04(spark, sf):
    out = trailing_distinct(hourly(tx(spark, sf)), ["receiver_id"], "sender_id", RECEIVER_SENDERS)
    return out.select("seq", *RECEIVER_SENDERS)


@query(
    "w04_unique_senders_strict",
    f"""SELECT seq, count(DISTINCT sender_id) OVER (PARTITION BY receiver_id ORDER BY us
      RANGE BETWEEN {D1} PRECEDING AND 1 PRECEDING) AS senders_24h FROM th""",
    TIES,
)
def w04_strict(spark, sf):
    out = trailing_distinct(
        hourly(tx(spark, sf)), ["receiver_id"], "sender_id", {"senders_24h": DAY}, ties="strict"
    )
    return out.select("seq", "senders_24h")


@query(
    "w05_first_seen",
    """SELECT transaction_id,
      CASE WHEN row_number() OVER (PARTITION BY sender_id ORDER BY us, seq) = 1 THEN 1 ELSE 0 END AS is_new_device,
      CASE WHEN row_number() OVER (PARTITION BY receiver_id ORDER BY us, seq) = 1 THEN 1 ELSE 0 END AS is_new_receiver
    FROM tx""",
    TX,
)
def w05(spark, sf):
    out = first_seen(tx(spark, sf), ["sender_id"], "is_new_device")
    out = first_seen(out, ["receiver_id"], "is_new_receiver")
    return out.select("transaction_id", "is_new_device", "is_new_receiver")


def _row_cnt(key: str, w: int, name: str) -> str:
    """Rows since t - w that come before the row in (us, seq) order."""
    return (
        f"row_number() OVER (PARTITION BY {key} ORDER BY us, seq) - 1 - count(*) OVER "
        f"(PARTITION BY {key} ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND {w + 1} PRECEDING) AS {name}"
    )


@query(
    "w06_live_features",
    f"""SELECT b.seq, b.device_txn_count_10m, b.device_txn_count_1h, b.device_txn_count_6h,
      b.device_txn_count_24h, b.receiver_txn_count_1h, b.receiver_txn_count_24h,
      u1.receiver_unique_senders_10m, u2.receiver_unique_senders_1h,
      b.is_new_device, b.is_new_receiver,
      round((b.amount - CASE WHEN n = 0 THEN g.gm ELSE m END)
        / (CASE WHEN n = 0 THEN g.gs WHEN n = 1 THEN 1e-9 ELSE s END + 1e-9), 3) + 0.0 AS device_amount_zscore_24h
    FROM (SELECT seq, amount, {_row_cnt('sender_id', M10, 'device_txn_count_10m')},
      {_row_cnt('sender_id', H1, 'device_txn_count_1h')}, {_row_cnt('sender_id', H6, 'device_txn_count_6h')},
      {_row_cnt('sender_id', D1, 'device_txn_count_24h')}, {_row_cnt('receiver_id', H1, 'receiver_txn_count_1h')},
      {_row_cnt('receiver_id', D1, 'receiver_txn_count_24h')},
      CASE WHEN row_number() OVER (PARTITION BY sender_id ORDER BY us, seq) = 1 THEN 1 ELSE 0 END AS is_new_device,
      CASE WHEN row_number() OVER (PARTITION BY receiver_id ORDER BY us, seq) = 1 THEN 1 ELSE 0 END AS is_new_receiver
      FROM th) b
    JOIN u1 ON b.seq = u1.seq JOIN u2 ON b.seq = u2.seq
    JOIN (SELECT x.seq, count(y.amount) AS n, avg(y.amount) AS m, stddev_samp(y.amount) AS s FROM th x
      LEFT JOIN th y ON y.sender_id = x.sender_id AND y.us BETWEEN x.us - {D1} AND x.us
        AND (y.us < x.us OR y.seq < x.seq) GROUP BY x.seq) z ON b.seq = z.seq
    CROSS JOIN (SELECT avg(amount) AS gm, stddev_samp(amount) AS gs FROM th) g""",
    TIES
    + ", "
    + _uniq_row("th", M10, "receiver_unique_senders_10m", "u1")
    + ", "
    + _uniq_row("th", H1, "receiver_unique_senders_1h", "u2"),
)
def w06(spark, sf):
    rows = hourly(tx(spark, sf))
    out = live_features(rows, amount_stats(rows), "sender_id", "receiver_id")
    z = F.round("device_amount_zscore_24h", 3) + F.lit(0.0)
    return out.select(
        "seq",
        *DEVICE_COUNTS,
        *RECEIVER_COUNTS,
        *RECEIVER_SENDERS,
        "is_new_device",
        "is_new_receiver",
        z.alias("device_amount_zscore_24h"),
    )


@query(
    "w07_prior_txn_frequency",
    """SELECT transaction_id, row_number() OVER (PARTITION BY sender_id ORDER BY us, seq) - 1 AS prior_txns
    FROM tx""",
    TX,
)
def w07(spark, sf):
    return prior_count(tx(spark, sf), ["sender_id"], "prior_txns").select(
        "transaction_id", "prior_txns"
    )


@query(
    "w08_days_since_last_txn",
    """SELECT transaction_id, round(coalesce((us - lag(us) OVER (PARTITION BY sender_id ORDER BY us, seq))
      / 86400000000.0::DOUBLE, 0.0), 6) + 0.0 AS days_since FROM tx""",
    TX,
)
def w08(spark, sf):
    gap = (F.col("us") - F.col("prev_us")) / F.lit(float(DAY))
    return neighbour_times(tx(spark, sf), ["sender_id"]).select(
        "transaction_id", r6(F.coalesce(gap, F.lit(0.0))).alias("days_since")
    )


@query(
    "w09_amount_deviation",
    """SELECT seq, round(CASE WHEN n < 2 OR s <= 1e-9 THEN 0.0 ELSE (amount - m) / s END, 6) + 0.0 AS deviation
    FROM (SELECT seq, amount, count(*) OVER w AS n, avg(amount) OVER w AS m, stddev_pop(amount) OVER w AS s
      FROM tx WINDOW w AS (PARTITION BY sender_id ORDER BY us, seq
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
    TX,
)
def w09(spark, sf):
    out = prior_moments(tx(spark, sf), ["sender_id"], "amount")
    std = F.sqrt(F.col("prior_m2") / F.col("prior_n"))
    z = F.when((F.col("prior_n") < 2) | (std <= 1e-9), 0.0).otherwise(
        (F.col("amount") - F.col("prior_mean")) / std
    )
    return out.select("seq", r6(z).alias("deviation"))


@query(
    "w10_topology_signal",
    f"""SELECT t.seq, fan_in_10m, sender_txn_10m, fan_in_10m >= 10 AS fan_in_flag,
      sender_txn_10m >= 12 AS velocity_flag, fan_in_10m >= 10 OR sender_txn_10m >= 12 AS high_confidence
    FROM (SELECT seq, {_row_cnt('sender_id', M10, 'sender_txn_10m')} FROM th) t JOIN u1 ON t.seq = u1.seq""",
    TIES + ", " + _uniq_row("th", M10, "fan_in_10m", "u1"),
)
def w10(spark, sf):
    return topology_signal(hourly(tx(spark, sf)), "sender_id", "receiver_id").select(
        "seq", "fan_in_10m", "sender_txn_10m", "fan_in_flag", "velocity_flag", "high_confidence"
    )


@query(
    "w11_running_amount_stats",
    """SELECT seq, count(*) OVER w AS n, round(avg(amount) OVER w + 1e-10, 6) + 0.0 AS mean,
      round(coalesce(stddev_samp(amount) OVER w, 1e-9), 6) + 0.0 AS std
    FROM tx WINDOW w AS (ORDER BY us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    TX,
)
def w11(spark, sf):
    # means of two-digit amounts can lie half-way between two sixth digits: both sides move off it
    out = running_amounts(tx(spark, sf), "amount").withColumn("running_mean", F.col("running_mean") + 1e-10)
    return out.select("seq", F.col("running_n").alias("n"), r6("running_mean").alias("mean"),
                      r6("running_std").alias("std"))


@query(
    "w12_burst_patterns",
    f"""SELECT t.seq, burst_txns, u.burst_senders, u.burst_senders >= 15 AS mule_burst,
      burst_txns >= 20 AS velocity_burst
    FROM (SELECT seq, row_number() OVER (PARTITION BY sender_id ORDER BY us, seq) - count(*) OVER
      (PARTITION BY sender_id ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND {H1 // 12 + 1} PRECEDING)
      AS burst_txns FROM th) t
    JOIN (SELECT x.seq, count(DISTINCT y.sender_id) AS burst_senders FROM th x JOIN th y
      ON y.receiver_id = x.receiver_id AND y.us BETWEEN x.us - {M10} AND x.us
        AND (y.us < x.us OR y.seq <= x.seq) GROUP BY x.seq) u ON t.seq = u.seq""",
    TIES,
)
def w12(spark, sf):
    return burst_patterns(hourly(tx(spark, sf)), "sender_id", "receiver_id").select(
        "seq", "burst_txns", "burst_senders", "mule_burst", "velocity_burst"
    )
