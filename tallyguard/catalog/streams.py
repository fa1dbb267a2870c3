"""Streaming queries: rows are replayed in time order and drained into a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyguard.catalog.base import EDGES, SCORED, TIES, TX, edges, hourly, query, r6, scored, tx
from tallyguard.catalog.graphs import WINDOW, _DEG, _FAN_IN, _FAN_OUT
from tallyguard.catalog.scoring import _ASOF, _DELTAS, TTL, _deltas, _reads
from tallyguard.catalog.windows import D1, H1, H6, M10, _row_cnt, _uniq_row
from tallyguard.functions.scoring import verdict_band
from tallyguard.session import scratch_path
from tallyguard.streaming.jobs import (
    audit_job,
    dedupe_stream,
    graph_window_job,
    merge_streams,
    policy_job,
    rate_limit_stream,
    read_replay,
    risk_cache_stream,
    run_batches,
    run_to_table,
    stateful_features,
    topology_stream,
    verdict_count_stream,
    verdict_minutes,
    write_replay,
)

GLOBAL = (50.0, 50.0)
SLICES = 4


def _replayed(df, label: str, slices: int = SLICES):
    path = scratch_path(df.sparkSession, f"replay-{label}")
    write_replay(df, path, slices)
    return read_replay(df.sparkSession, path, df.schema)


def _features(spark, sf):
    rows = hourly(tx(spark, sf)).select("seq", "ts", "us", "sender_id", "receiver_id", "amount")
    return stateful_features(_replayed(rows, "tx"), *GLOBAL)


def _feature_table(spark, sf):
    """The drained feature stream."""
    return run_to_table(_features(spark, sf), "features")


_CTES = (
    TIES
    + ", "
    + _uniq_row("th", M10, "receiver_unique_senders_10m", "u1")
    + ", "
    + _uniq_row("th", H1, "receiver_unique_senders_1h", "u2")
)


@query(
    "t01_stateful_features",
    f"""SELECT b.*, u1.receiver_unique_senders_10m, u2.receiver_unique_senders_1h, round((x.amount - CASE WHEN n = 0 THEN 50.0 ELSE m END)
      / (CASE WHEN n = 0 THEN 50.0 WHEN n = 1 THEN 1e-9 ELSE s END + 1e-9), 3) + 0.0 AS device_amount_zscore_24h
    FROM (SELECT seq, {_row_cnt('sender_id', M10, 'device_txn_count_10m')},
      {_row_cnt('sender_id', H1, 'device_txn_count_1h')}, {_row_cnt('sender_id', H6, 'device_txn_count_6h')},
      {_row_cnt('sender_id', D1, 'device_txn_count_24h')}, {_row_cnt('receiver_id', H1, 'receiver_txn_count_1h')},
      {_row_cnt('receiver_id', D1, 'receiver_txn_count_24h')} FROM th) b
    JOIN th x ON b.seq = x.seq JOIN u1 ON b.seq = u1.seq JOIN u2 ON b.seq = u2.seq
    JOIN (SELECT x.seq, count(y.amount) AS n, avg(y.amount) AS m, stddev_samp(y.amount) AS s FROM th x
      LEFT JOIN th y ON y.sender_id = x.sender_id AND y.us BETWEEN x.us - {D1} AND x.us
        AND (y.us < x.us OR y.seq < x.seq) GROUP BY x.seq) z ON b.seq = z.seq""",
    _CTES,
)
def t01(spark, sf):
    out = _feature_table(spark, sf)
    names = [f"device_txn_count_{w}" for w in ("10m", "1h", "6h", "24h")]
    names += ["receiver_txn_count_1h", "receiver_txn_count_24h"]
    names += ["receiver_unique_senders_10m", "receiver_unique_senders_1h"]
    z = F.round("device_amount_zscore_24h", 3) + F.lit(0.0)
    return out.select("seq", *names, z.alias("device_amount_zscore_24h"))


def _shuffled(spark, sf):
    """Rows whose arrival differs from their times by up to nine minutes, then one that moves the watermark on."""
    rows = hourly(tx(spark, sf)).select("seq", "ts", "us", "sender_id", "receiver_id", "amount")
    rows = rows.withColumn("us", F.col("us") + F.col("seq") * 7919 % 3_600 * 1_000_000).withColumn("ts", F.timestamp_micros("us"))
    end = rows.agg(F.max("us").alias("us")).select(
        F.lit(-1).cast("bigint").alias("seq"), (F.col("us") + 4 * D1).alias("us"), F.lit("end").alias("sender_id"),
        F.lit("end").alias("receiver_id"), F.lit(0.0).alias("amount"),
    ).withColumn("ts", F.timestamp_micros("us"))
    arrival = F.col("us") + F.col("seq") * 104_729 % 540 * 1_000_000
    return rows.withColumn("at", arrival).unionByName(end.withColumn("at", F.col("us")))


@query(
    "t01_shuffled_arrival",
    f"""SELECT seq, {_row_cnt('sender_id', M10, 'device_txn_count_10m')}, {_row_cnt('sender_id', D1, 'device_txn_count_24h')},
      {_row_cnt('receiver_id', H1, 'receiver_txn_count_1h')}, {_row_cnt('receiver_id', D1, 'receiver_txn_count_24h')},
      CASE WHEN row_number() OVER (PARTITION BY sender_id ORDER BY us, seq) = 1 THEN 1 ELSE 0 END AS is_new_device,
      CASE WHEN row_number() OVER (PARTITION BY receiver_id ORDER BY us, seq) = 1 THEN 1 ELSE 0 END AS is_new_receiver FROM sh""",
    TIES + ", sh AS (SELECT * REPLACE (us + seq * 7919 % 3600 * 1000000 AS us) FROM th)",
)
def t01_shuffled(spark, sf):
    """Rows that arrive out of order are held until the watermark and get the batch features."""
    path = scratch_path(spark, "replay-shuffled")
    rows = _shuffled(spark, sf)
    write_replay(rows, path, 12, us="at")
    stream = stateful_features(read_replay(spark, path, rows.schema), *GLOBAL, hold=True)
    names = ["device_txn_count_10m", "device_txn_count_24h", "receiver_txn_count_1h", "receiver_txn_count_24h"]
    out = run_to_table(stream, "shuffled").where("seq >= 0")
    return out.select("seq", *names, "is_new_device", "is_new_receiver")


@query(
    "t02_cold_start_state",
    """SELECT seq, CASE WHEN row_number() OVER (PARTITION BY sender_id ORDER BY us, seq) = 1 THEN 1 ELSE 0 END AS is_new_device,
      CASE WHEN row_number() OVER (PARTITION BY receiver_id ORDER BY us, seq) = 1 THEN 1 ELSE 0 END AS is_new_receiver FROM th""",
    TIES,
)
def t02(spark, sf):
    return _feature_table(spark, sf).select(
        "seq", "is_new_device", "is_new_receiver"
    )


@query(
    "t03_topology_stream",
    f"""SELECT t.seq, f >= 10 AS fan_in_flag, v >= 12 AS velocity_flag, f >= 10 OR v >= 12 AS high_confidence
    FROM (SELECT seq, {_row_cnt('sender_id', M10, 'v')} FROM th) t JOIN u ON t.seq = u.seq""",
    TIES + ", " + _uniq_row("th", M10, "f", "u"),
)
def t03(spark, sf):
    return run_to_table(topology_stream(_features(spark, sf)), "topology").select(
        "seq", "fan_in_flag", "velocity_flag", "high_confidence"
    )


@query(
    "t04_state_eviction",
    f"""SELECT seq, c > 0 AS has_history, c = 0 AND rn > 1 AS returned_idle FROM (SELECT seq, {_row_cnt('sender_id', D1, 'c')},
      row_number() OVER (PARTITION BY sender_id ORDER BY us, seq) AS rn FROM th)""",
    TIES,
)
def t04(spark, sf):
    """Idle keys come back with an empty history but are not new."""
    count = F.col("device_txn_count_24h")
    return _feature_table(spark, sf).select(
        "seq",
        (count > 0).alias("has_history"),
        ((count == 0) & (F.col("is_new_device") == 0)).alias("returned_idle"),
    )


@query(
    "t05_rate_limit_stream",
    """, walk AS (SELECT sender_id, rn, seq, sec, sec AS start, 1 AS used, true AS allowed FROM req WHERE rn = 1
      UNION ALL SELECT r.sender_id, r.rn, r.seq, r.sec,
        CASE WHEN r.sec - w.start >= 86400 THEN r.sec ELSE w.start END,
        CASE WHEN r.sec - w.start >= 86400 THEN 1 WHEN w.used < 2 THEN w.used + 1 ELSE w.used END,
        r.sec - w.start >= 86400 OR w.used < 2
      FROM walk w JOIN req r ON r.sender_id = w.sender_id AND r.rn = w.rn + 1)
    SELECT seq, allowed, CASE WHEN allowed THEN 0 ELSE 86400 - (sec - start) END AS retry_after_s FROM walk""",
    "RECURSIVE " + TX + """, req AS (SELECT sender_id, seq, us // 1000000 AS sec,
      row_number() OVER (PARTITION BY sender_id ORDER BY us, seq) AS rn FROM tx)""",
)
def t05_stream(spark, sf):
    rows = tx(spark, sf).select("seq", "us", "ts", "sender_id")
    out = run_to_table(rate_limit_stream(_replayed(rows, "requests"), "sender_id", 2, 86_400, "ts"), "rate")
    return out.select("seq", "allowed", "retry_after_s")


@query(
    "t06_ttl_cache_stream",
    f"""SELECT a.seq, a.graph_delta, a.graph_reason, CASE WHEN age IS NULL THEN 'miss' WHEN age <= {TTL} THEN 'hit'
      WHEN age <= {2 * TTL} AND row_number() OVER (PARTITION BY sender_id, w, age > {TTL} ORDER BY us, seq) = 1 THEN 'expired'
      ELSE 'miss' END AS outcome
    FROM ({_ASOF}) a JOIN (SELECT r.seq, r.sender_id, r.us, d.us AS w, r.us // 1000000 - d.us // 1000000 AS age
      FROM reads r ASOF LEFT JOIN deltas d ON r.sender_id = d.sender_id AND r.us >= d.us) b USING (seq)""",
    TX + ", " + _DELTAS,
)
def t06(spark, sf):
    rows = tx(spark, sf).select("seq", "us", "ts", "sender_id", "amount", "fraud_flag")
    stream = _replayed(rows, "cache")
    writes = _deltas(stream, "ts")
    answered = risk_cache_stream(_reads(stream, "ts"), writes, "sender_id", TTL, "ts")
    return run_to_table(answered, "cache").select(
        "seq", r6("graph_delta").alias("graph_delta"), "graph_reason", "outcome"
    )


@query(
    "t07_dedupe_stream",
    "SELECT transaction_id, amount FROM tx",
    TX,
)
def t07_stream(spark, sf):
    rows = tx(spark, sf).select("transaction_id", "ts", "us", "amount")
    stream = _replayed(rows.unionByName(rows), "duplicates")
    return run_to_table(dedupe_stream(stream, "transaction_id"), "deduped").select(
        "transaction_id", "amount"
    )


@query(
    "t08_merge_streams",
    """SELECT CASE WHEN seq % 2 = 0 THEN 'setu' ELSE 'plaid' END AS source, count(*) AS n, round(sum(amount), 2) AS total
    FROM tx GROUP BY 1""",
    TX,
)
def t08(spark, sf):
    rows = tx(spark, sf).select("seq", "us", "amount")
    parts = [
        _replayed(rows.where(F.col("seq") % 2 == i).withColumn("source", F.lit(name)), name, 2)
        for i, name in enumerate(("setu", "plaid"))
    ]
    out = run_to_table(merge_streams(*parts), "merged")
    return out.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("amount"), 2).alias("total")
    )


@query(
    "t09_sliding_graph_window",
    f"""SELECT node, count(*) AS events FROM (SELECT node FROM ({_FAN_OUT}) UNION ALL SELECT node FROM ({_FAN_IN})) GROUP BY node""",
    EDGES
    + f", win AS (SELECT * FROM edges ORDER BY us DESC, seq DESC LIMIT {WINDOW})"
    + _DEG.format(e="win"),
)
def t09(spark, sf):
    rows = edges(spark, sf).select("src", "dst", "us", "seq")
    out = scratch_path(spark, "stream-deltas")
    graph_window_job(_replayed(rows, "edges", 2), out, WINDOW)
    risk = spark.read.parquet(out)
    newest = risk.select(F.max("batch").alias("b")).scalar()
    fans = F.size(F.filter(F.split("reason", r"\+"), lambda r: r.startswith("fan_")))
    return (
        risk.where(F.col("batch") == newest)
        .select(F.col("vpa_hash").alias("node"), fans.cast("bigint").alias("events"))
        .where("events > 0")
    )


_VERDICTS = """SELECT CASE WHEN p < 0.46 THEN 'ALLOW' WHEN p >= 0.75 THEN 'BLOCK' ELSE 'FLAG' END AS verdict"""


@query(
    "t10_running_verdict_counts",
    f"SELECT verdict, count(*) AS n FROM ({_VERDICTS} FROM scored) GROUP BY verdict",
    SCORED,
)
def t10(spark, sf):
    rows = scored(spark, sf).select("us", verdict_band("p").alias("verdict"))
    out = scratch_path(spark, "verdict-counts")

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    run_batches(verdict_count_stream(_replayed(rows, "verdicts")), "counts", keep, "complete")
    counts = spark.read.parquet(out)
    newest = counts.select(F.max("batch").alias("b")).scalar()
    return counts.where(F.col("batch") == newest).select("verdict", "n")


@query(
    "t10_verdict_minutes",
    f"""SELECT epoch_us(date_trunc('minute', ts)) AS start_us, verdict, count(*) AS n
    FROM ({_VERDICTS}, ts FROM scored) GROUP BY ALL""",
    SCORED,
)
def t10_minutes(spark, sf):
    rows = scored(spark, sf).select("us", "ts", verdict_band("p").alias("verdict"))
    out = scratch_path(spark, "verdict-minutes")

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    run_batches(verdict_minutes(_replayed(rows, "minutes")), "minutes", keep, "complete")
    counts = spark.read.parquet(out)
    newest = counts.select(F.max("batch").alias("b")).scalar()
    return counts.where(F.col("batch") == newest).select(F.unix_micros("window.start").alias("start_us"), "verdict", "n")


@query(
    "t11_audit_stream",
    "SELECT 'graph_update' AS event, seq, sender_id, round(amount, 6) AS amount FROM tx WHERE fraud_flag = 1",
    TX,
)
def t11(spark, sf):
    rows = tx(spark, sf).where("fraud_flag = 1").select("seq", "us", "sender_id", "amount")
    path = scratch_path(spark, "audit-stream")
    audit_job(_replayed(rows, "updates").drop("us"), path, "graph_update")
    return spark.read.schema("event string, seq bigint, sender_id string, amount double").json(
        f"{path}/*"
    )


@query(
    "t12_policy_refresh",
    f"""SELECT seq, CASE WHEN p < t THEN 'ALLOW' WHEN p >= 0.8 THEN 'BLOCK' ELSE 'FLAG' END AS verdict FROM
      (SELECT seq, p, CASE WHEN us < (SELECT us FROM scored ORDER BY us LIMIT 1 OFFSET (SELECT count(*) // 2 FROM scored))
        THEN 0.4 ELSE 0.5 END AS t FROM scored)""",
    SCORED,
)
def t12(spark, sf):
    rows = scored(spark, sf).select("seq", "us", F.col("p").alias("score"))
    path, out = scratch_path(spark, "policies"), scratch_path(spark, "banded")
    spec = "us bigint, allow_threshold double, block_threshold double"
    spark.createDataFrame([(0, 0.4, 0.8)], spec).write.mode("append").parquet(path)

    def policies(batch_id):
        if batch_id == 1:  # a reload that arrives before the second micro-batch
            spark.createDataFrame([(1, 0.5, 0.8)], spec).write.mode("append").parquet(path)
        return spark.read.schema(spec).parquet(path)

    policy_job(_replayed(rows, "policy", 2), policies, out)
    return spark.read.parquet(out).select("seq", "verdict")


@query(
    "s11_replay_stream",
    "SELECT transaction_id, us, amount FROM tx",
    TX,
)
def s11(spark, sf):
    rows = tx(spark, sf).select("transaction_id", "us", "amount")
    return run_to_table(_replayed(rows, "plain"), "replayed")


@query(
    "s12_verdict_sink",
    f"SELECT seq, verdict FROM (SELECT seq, v.verdict FROM scored, LATERAL ({_VERDICTS}) v)",
    SCORED,
)
def s12(spark, sf):
    rows = scored(spark, sf).select("seq", "us", "p")
    path = scratch_path(spark, "verdict-events")
    banded = _replayed(rows, "sink").select("seq", verdict_band("p").alias("verdict"))
    audit_job(banded, path, "verdict")
    return spark.read.schema("seq bigint, verdict string").json(f"{path}/*")
