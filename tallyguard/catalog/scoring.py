"""Policy, as-of, scoring and alert queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyguard.catalog.base import SCORED, TIES, TX, hourly, query, r6, r9, scored, table, tx
from tallyguard.functions.alerts import (
    BLOCK_TEXT,
    FLAG_TEXT,
    LANGUAGES,
    SOURCE_REASON,
    alert_text,
    evidence_record,
    incidents,
    language_fanout,
)
from tallyguard.functions.calendar import bucket_to_hour, day_name_to_index
from tallyguard.functions.payload import demo_payload
from tallyguard.functions.scoring import (
    anomaly_from_raw,
    consortium_label,
    edge_block_rule,
    feed_rule,
    fuse_gateway,
    fuse_gauntlet,
    injection_rule,
    label_boost,
    statement_rule,
    verdict_band,
)
from tallyguard.functions.vectors import REQUEST_AMOUNT, fixed_zscore
from tallyguard.operators.asof import (
    cache_outcomes,
    feature_vector_lookup,
    latest_per_key,
    risk_delta_lookup,
)
from tallyguard.operators.policy import erase, policy_at, resolve_policy, with_tier_profile
from tallyguard.operators.profile import entity_overlap
from tallyguard.operators.ratelimit import rate_limit
from tallyguard.operators.split import temporal_split
from tallyguard.plans.online import decide_requests
from tallyguard.plans.score import score_batch

TTL = 86_400


def _band(x: str, allow="0.46", block="0.75") -> str:
    return f"CASE WHEN {x} < {allow} THEN 'ALLOW' WHEN {x} >= {block} THEN 'BLOCK' ELSE 'FLAG' END"


@query(
    "p25_verdict_band",
    f"""SELECT seq, {_band('p')} AS verdict, {_band('p', '0.5', '0.8')} AS bar, {_band('p', '0.4', '0.75')} AS cache
    FROM scored""",
    SCORED,
)
def p25(spark, sf):
    return scored(spark, sf).select(
        "seq",
        verdict_band("p").alias("verdict"),
        verdict_band("p", 0.5, 0.8).alias("bar"),
        verdict_band("p", 0.4, 0.75).alias("cache"),
    )


@query(
    "p26_consortium_label",
    """SELECT seq, CASE WHEN p >= 0.75 THEN 'TAINTED' WHEN p >= 0.4 THEN 'SUSPECT' ELSE 'CLEAN' END AS label
    FROM scored""",
    SCORED,
)
def p26(spark, sf):
    return scored(spark, sf).select("seq", consortium_label("p").alias("label"))


_VPAS = "(['cash.agent.1@paytm', 'wallet.x@ybl', 'Crypto.y@upi', 'kirana@okhdfc', 'merchant@upi'])[seq % 5 + 1]"


def _rule_rows(spark, sf):
    names = ["cash.agent.1@paytm", "wallet.x@ybl", "Crypto.y@upi", "kirana@okhdfc", "merchant@upi"]
    return tx(spark, sf).select(
        "seq",
        "transaction_id",
        (F.col("amount") * 400).alias("amount"),
        F.get(F.array(*[F.lit(n) for n in names]), (F.col("seq") % 5).cast("int")).alias("vpa"),
        (F.col("seq") % 3 == 0).alias("new_device"),
        F.when(F.col("seq") % 4 == 0, "GAMBLING").otherwise("FOOD").alias("category"),
        (F.col("seq") % 24).alias("hour"),
        F.when(F.col("seq") % 50 == 0, "copied handle").otherwise("").alias("hint"),
    )


@query(
    "p27_rule_score_fallback",
    f"""SELECT seq, CASE WHEN a > 40000 OR contains(v, 'agent') OR contains(v, 'cash') THEN 'BLOCK'
        WHEN a > 10000 OR contains(v, 'wallet') OR contains(v, 'crypto') THEN 'FLAG' ELSE 'ALLOW' END AS statement_verdict,
      CASE WHEN a > 50000 AND seq % 3 = 0 THEN 'BLOCK' WHEN a > 30000 OR (seq % 3 = 0 AND a > 10000) THEN 'FLAG'
        ELSE 'ALLOW' END AS feed_verdict,
      round(CASE WHEN a > 50000 AND seq % 3 = 0 THEN 0.91 WHEN a > 30000 OR (seq % 3 = 0 AND a > 10000)
        THEN 0.55 + (seq % 3) * 0.08 ELSE 0.08 + (seq % 7) * 0.05 END::DOUBLE, 6) AS feed_risk,
      CASE WHEN a > 45000 AND seq % 3 = 0 THEN 0.92::DOUBLE WHEN a > 18000 OR seq % 3 = 0 OR seq % 4 = 0 THEN 0.66::DOUBLE
        ELSE 0.18::DOUBLE END AS injection_risk
    FROM (SELECT seq, amount * 400 AS a, lower({_VPAS}) AS v FROM tx)""",
    TX,
)
def p27(spark, sf):
    feed = feed_rule("amount", "new_device", "seq")
    return _rule_rows(spark, sf).select(
        "seq",
        statement_rule("amount", "vpa", "transaction_id")["verdict"].alias("statement_verdict"),
        feed["verdict"].alias("feed_verdict"),
        r6(feed["risk_score"]).alias("feed_risk"),
        injection_rule("amount", "new_device", "category")["risk_score"].alias("injection_risk"),
    )


@query(
    "p28_edge_block_rule",
    f"""SELECT seq, a >= 50000 OR (regexp_matches(v, 'cash|agent|crypto|wallet') AND a >= 15000)
      OR ((seq % 24 <= 5 OR seq % 24 >= 23) AND a >= 12000) OR seq % 50 = 0 AS blocked
    FROM (SELECT seq, amount * 400 AS a, lower({_VPAS}) AS v FROM tx)""",
    TX,
)
def p28(spark, sf):
    return _rule_rows(spark, sf).select(
        "seq", edge_block_rule("amount", "vpa", "hour", "hint").alias("blocked")
    )


@query(
    "p29_label_boost",
    f"""SELECT seq, CASE WHEN fraud_flag = 1 AND p < 0.45 THEN 'FLAG' ELSE {_band('p')} END AS verdict,
      CASE WHEN fraud_flag = 1 AND p < 0.45 THEN greatest(p, 0.58) ELSE p END AS risk_score,
      fraud_flag = 1 AND p < 0.45 AS label_boost FROM scored""",
    SCORED,
)
def p29(spark, sf):
    rows = scored(spark, sf).withColumn("v", verdict_band("p"))
    boosted = label_boost("fraud_flag", "v", "p")
    return rows.select("seq", *[c.alias(n) for n, c in boosted.items()])


_INC = """inc AS (SELECT seq, transaction_id, sender_id, receiver_id, amount, us, ts, transaction_type AS merchant_category,
  p AS risk_score, CASE WHEN p < 0.46 THEN 'ALLOW' WHEN p >= 0.75 THEN 'BLOCK' ELSE 'FLAG' END AS verdict, a, delta FROM scored)"""


def _verdict_rows(spark, sf):
    return scored(spark, sf).select(
        "seq", "transaction_id", "sender_id", "receiver_id", "amount", "us", "ts",
        F.col("transaction_type").alias("merchant_category"),
        F.col("p").alias("risk_score"), verdict_band("p").alias("verdict"),
        F.col("p").alias("lgbm_score"), F.col("a").alias("anomaly_score"),
        F.col("delta").alias("graph_delta"),
        F.when(F.col("seq") % 2 == 0, "fan_in").alias("graph_reason"),
    )


@query(
    "p30_incident_filter",
    f"""SELECT transaction_id, verdict, risk_score, '{SOURCE_REASON}; Category=' || merchant_category
      || '; Risk=' || printf('%.2f', risk_score) AS reasons FROM inc WHERE verdict IN ('FLAG', 'BLOCK')""",
    SCORED + ", " + _INC,
)
def p30(spark, sf):
    return incidents(_verdict_rows(spark, sf)).select(
        "transaction_id", "verdict", "risk_score", F.array_join("reasons", "; ").alias("reasons")
    )


@query(
    "p34_demo_payload_enrich",
    """SELECT seq, greatest(1.0, amount) AS amount, CASE WHEN fraud_flag = 1 THEN 12 ELSE 1 END AS transactions_last_1h,
      CASE WHEN fraud_flag = 1 THEN 28 ELSE 3 END AS transactions_last_24h,
      CASE WHEN fraud_flag = 1 THEN 48.0::DOUBLE ELSE 1.2::DOUBLE END AS gps_delta_km,
      round(CASE WHEN fraud_flag = 1 THEN 0.92 ELSE least(1.0, greatest(1.0, amount) / 100000.0) END::DOUBLE, 9) AS balance_drain_ratio,
      CASE WHEN fraud_flag = 1 THEN 3 ELSE 0 END AS previous_failed_attempts,
      round(greatest(-5.0, least(5.0, (greatest(1.0, amount) - 3000.0) / 12000.0)), 9) + 0.0 AS amount_zscore,
      isodow(ts) % 7 AS day_of_week, CASE WHEN lower(device_type) LIKE '%ios%' THEN 'IOS' ELSE 'ANDROID' END AS device_type,
      CASE seq % 5 WHEN 0 THEN 8 WHEN 1 THEN 14 WHEN 2 THEN 20 WHEN 3 THEN 23 ELSE 3 END AS bucket_hour FROM tx""",
    TX,
)
def p34(spark, sf):
    buckets = ["06:00-09:00", "09:00-18:00", "18:00-22:00", "22:00-02:00", "other"]
    rows = tx(spark, sf).withColumn("day_name", F.date_format("ts", "EEEE")).withColumn(
        "bucket", F.get(F.array(*[F.lit(b) for b in buckets]), (F.col("seq") % 5).cast("int"))
    )
    return demo_payload(rows).select(
        "seq", "amount", "transactions_last_1h", "transactions_last_24h", "gps_delta_km",
        r9("balance_drain_ratio").alias("balance_drain_ratio"), "previous_failed_attempts",
        r9("amount_zscore").alias("amount_zscore"),
        day_name_to_index("day_name").alias("day_of_week"), "device_type",
        bucket_to_hour("bucket").alias("bucket_hour"),
    )


def _text(template: str) -> str:
    return template.format(brand="Payment").replace("'", "''")


_ALERT = f"""alerts AS (SELECT transaction_id, CASE WHEN verdict = 'BLOCK'
  THEN printf('{_text(BLOCK_TEXT)}', amount::VARCHAR, coalesce(m, 'an unnamed receiver'), 'risk rule')
  ELSE printf('{_text(FLAG_TEXT)}', amount::VARCHAR, coalesce(m, 'an unnamed receiver'), 'risk rule') END AS text
  FROM (SELECT *, CASE WHEN seq % 5 <> 0 THEN receiver_id END AS m FROM inc WHERE verdict <> 'ALLOW'))"""


def _alerts(spark, sf):
    rows = incidents(_verdict_rows(spark, sf)).select(
        "transaction_id", "verdict", "amount",
        F.when(F.col("seq") % 5 != 0, F.col("receiver_id")).alias("merchant"),
        F.lit("risk rule").alias("reason"),
    )
    return rows.select(
        "transaction_id", alert_text("verdict", "amount", "merchant", "reason").alias("text")
    )


@query(
    "p35_alert_text",
    "SELECT transaction_id, text FROM alerts",
    SCORED + ", " + _INC + ", " + _ALERT,
)
def p35(spark, sf):
    return _alerts(spark, sf)


@query(
    "p36_evidence_record",
    """SELECT transaction_id || '-' || verdict AS case_ref,
      CASE WHEN verdict = 'BLOCK' THEN 'blocked' ELSE 'held for review' END AS classification,
      strftime(ts + INTERVAL 330 MINUTE, '%d/%m/%Y %H:%M:%S') AS time_ist,
      'graph: ' || CASE WHEN seq % 2 = 0 THEN 'fan_in' ELSE 'n/a' END AS signal_4,
      'risk ' || printf('%.2f', risk_score) || ' from model ' || printf('%.2f', risk_score) ||
      ', anomaly ' || printf('%.2f', a) || ', graph ' || printf('%.2f', delta) AS signal_5
    FROM inc WHERE verdict <> 'ALLOW'""",
    SCORED + ", " + _INC,
)
def p36(spark, sf):
    return evidence_record(incidents(_verdict_rows(spark, sf))).select(
        "case_ref", "classification", "time_ist",
        F.col("signals")[3].alias("signal_4"), F.col("signals")[4].alias("signal_5"),
    )


@query(
    "j12_language_fanout",
    "SELECT transaction_id, lang, voice, 'alert_' || transaction_id || '_' || lang AS output_key FROM alerts CROSS JOIN (VALUES "
    + ", ".join(f"('{c}', '{v}')" for c, _, v in LANGUAGES)
    + ") l(lang, voice)",
    SCORED + ", " + _INC + ", " + _ALERT,
)
def j12(spark, sf):
    return language_fanout(_alerts(spark, sf), "transaction_id").select(
        "transaction_id", "lang", "voice", "output_key"
    )


# --- as-of --------------------------------------------------------------------
_DELTAS = """deltas AS (SELECT sender_id, us, seq, least(amount / 500.0, 1.0) AS risk_delta, 'r' || seq % 7 AS reason
  FROM tx WHERE fraud_flag = 1), reads AS (SELECT seq, sender_id, us FROM tx WHERE fraud_flag = 0)"""


def _deltas(df, *extra):
    return df.where("fraud_flag = 1").select(
        "sender_id", "us", "seq", *extra, F.least(F.col("amount") / 500.0, F.lit(1.0)).alias("risk_delta"),
        F.concat(F.lit("r"), (F.col("seq") % 7).cast("string")).alias("reason"),
    )


def _reads(df, *extra):
    return df.where("fraud_flag = 0").select("seq", "sender_id", "us", *extra)


_ASOF = f"""SELECT r.seq, CASE WHEN r.us // 1000000 - d.us // 1000000 <= {TTL} THEN round(d.risk_delta, 6) ELSE 0.0 END AS graph_delta,
  CASE WHEN r.us // 1000000 - d.us // 1000000 <= {TTL} THEN d.reason ELSE 'cold' END AS graph_reason
  FROM reads r ASOF LEFT JOIN deltas d ON r.sender_id = d.sender_id AND r.us >= d.us"""


@query("j03_graph_delta_asof", _ASOF, TX + ", " + _DELTAS)
def j03(spark, sf):
    df = tx(spark, sf)
    return risk_delta_lookup(_reads(df), _deltas(df), "sender_id", TTL).select(
        "seq", r6("graph_delta").alias("graph_delta"), "graph_reason"
    )


@query(
    "j04_feature_cache_lookup",
    """SELECT r.seq, coalesce(d.amount::FLOAT::DOUBLE, 0.0) AS v0, coalesce(d.txn_frequency, 0.0) AS v1, 2 AS length
    FROM (SELECT * FROM tx WHERE fraud_flag = 0) r ASOF LEFT JOIN (SELECT * FROM tx WHERE fraud_flag = 1) d
    ON r.sender_id = d.sender_id AND r.us >= d.us""",
    TX,
)
def j04(spark, sf):
    df = tx(spark, sf)
    vectors = df.where("fraud_flag = 1").select(
        "sender_id", "us", "seq",
        F.array(F.col("amount").cast("float"), F.col("txn_frequency").cast("float")).alias("features"),
    )
    out = feature_vector_lookup(_reads(df), vectors, "sender_id", 2)
    return out.select(
        "seq", F.col("features")[0].cast("double").alias("v0"),
        F.col("features")[1].cast("double").alias("v1"), F.size("features").alias("length"),
    )


@query(
    "j04_latest_vector_snapshot",
    "SELECT sender_id, arg_max(amount, us) AS amount, max(us) AS us FROM tx WHERE fraud_flag = 1 GROUP BY sender_id",
    TX,
)
def j04_snapshot(spark, sf):
    writes = tx(spark, sf).where("fraud_flag = 1").select("sender_id", "amount", "us", "seq")
    return latest_per_key(writes, ["sender_id"], ["us", "seq"]).select("sender_id", "amount", "us")


@query(
    "a21_cache_outcomes",
    f"""SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN age IS NULL THEN 'miss' WHEN age <= {TTL} THEN 'hit'
      WHEN row_number() OVER (PARTITION BY sender_id, w, age > {TTL} ORDER BY us, seq) = 1 THEN 'expired' ELSE 'miss' END AS outcome
      FROM (SELECT r.sender_id, r.us, r.seq, d.us AS w, r.us // 1000000 - d.us // 1000000 AS age
        FROM reads r ASOF LEFT JOIN deltas d ON r.sender_id = d.sender_id AND r.us >= d.us)) GROUP BY outcome""",
    TX + ", " + _DELTAS,
)
def a21(spark, sf):
    df = tx(spark, sf)
    seen = cache_outcomes(_reads(df), _deltas(df), "sender_id", TTL)
    return seen.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


_SPLIT = TX + """, sp AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY us, seq)
  <= cast(floor(0.8 * count(*) OVER ()) AS BIGINT) THEN 'train' ELSE 'holdout' END AS split FROM tx)"""


@query(
    "j05_entity_overlap",
    """SELECT k, sum(t)::BIGINT AS train_entities, sum(h)::BIGINT AS holdout_entities, sum(t * h)::BIGINT AS both_sides,
      sum((1 - t) * h)::BIGINT AS new_in_holdout FROM (
      SELECT 'all' AS k, sender_id, max((split = 'train')::INT) AS t, max((split = 'holdout')::INT) AS h FROM sp GROUP BY sender_id
      UNION ALL SELECT 'fraud', sender_id, max((split = 'train')::INT), max((split = 'holdout')::INT) FROM sp
        WHERE fraud_flag = 1 GROUP BY sender_id) GROUP BY k""",
    _SPLIT,
)
def j05(spark, sf):
    rows = temporal_split(tx(spark, sf))
    every = entity_overlap(rows, "sender_id").withColumn("k", F.lit("all"))
    fraud = entity_overlap(rows, "sender_id", fraud_only=True).withColumn("k", F.lit("fraud"))
    return every.unionByName(fraud).withColumnRenamed("both", "both_sides")


@query(
    "j08_erasure",
    """SELECT sender_id, max(CASE WHEN fraud_flag = 1 AND amount > 100 THEN 1 ELSE 0 END) = 1 AS removed_delta,
      max(CASE WHEN fraud_flag = 0 AND amount > 150 THEN 1 ELSE 0 END) = 1 AS removed_feature
    FROM tx GROUP BY sender_id HAVING max(CASE WHEN transaction_type = 'signup' AND amount > 120 THEN 1 ELSE 0 END) = 1""",
    TX,
)
def j08(spark, sf):
    df = tx(spark, sf)
    receipts, _, _ = erase(
        df.where("transaction_type = 'signup' AND amount > 120"),
        df.where("fraud_flag = 1 AND amount > 100"),
        df.where("fraud_flag = 0 AND amount > 150"),
        "sender_id",
    )
    return receipts


@query(
    "j08_erasure_remaining",
    """SELECT seq, sender_id FROM tx WHERE fraud_flag = 1 AND sender_id NOT IN
      (SELECT sender_id FROM tx WHERE transaction_type = 'signup' AND amount > 120)""",
    TX,
)
def j08_rest(spark, sf):
    df = tx(spark, sf)
    _, deltas, _ = erase(
        df.where("transaction_type = 'signup' AND amount > 120"),
        df.where("fraud_flag = 1").select("sender_id", "seq"),
        df.where("fraud_flag = 0").select("sender_id", "seq"),
        "sender_id",
    )
    return deltas.select("seq", "sender_id")


@query(
    "j09_policy_resolve",
    """SELECT c_custkey AS policy, CASE WHEN c_custkey % 4 = 0 THEN 0.5 WHEN c_custkey % 3 = 0 THEN 0.42 ELSE 0.46 END::DOUBLE AS allow_threshold,
      CASE WHEN c_custkey % 2 = 0 THEN 0.7 ELSE 0.75 END::DOUBLE AS flag_threshold,
      CASE WHEN c_custkey % 5 = 0 THEN 0.9 ELSE 0.75 END::DOUBLE AS block_threshold FROM customer""",
)
def j09(spark, sf):
    banks = table(spark, sf, "customer").select(F.col("c_custkey").alias("policy"))
    manifest = banks.select(
        "policy", F.lit(0.46).alias("allow_threshold"), F.lit(0.75).alias("flag_threshold"),
        F.lit(0.75).alias("block_threshold"),
    )
    k = F.col("policy")
    override = banks.select(
        "policy", F.when(k % 4 == 0, 0.5).alias("l3_ml_threshold"),
        F.when(k % 3 == 0, 0.42).alias("allow_threshold"),
        F.when(k % 2 == 0, 0.7).alias("flag_threshold"),
        F.when(k % 5 == 0, 0.9).alias("block_threshold"),
    )
    return resolve_policy(manifest, override, "policy")


_VERSIONS = """versions AS (SELECT min(us) + 1 AS us, 0.4 + (day % 5) / 20.0::DOUBLE AS allow, 0.75 + (day % 3) / 20.0::DOUBLE AS block
  FROM (SELECT us, us // 86400000000 AS day FROM tx) WHERE day % 4 = 0 GROUP BY day)"""


@query(
    "j10_policy_versioning",
    """SELECT t.seq, CASE WHEN v.us IS NULL THEN NULL WHEN p < v.allow THEN 'ALLOW' WHEN p >= v.block THEN 'BLOCK' ELSE 'FLAG' END AS verdict
    FROM scored t ASOF LEFT JOIN versions v ON t.us >= v.us""",
    SCORED + ", " + _VERSIONS,
)
def j10(spark, sf):
    rows = scored(spark, sf)
    day = F.expr("us div 86400000000")
    versions = (
        rows.select("us", day.alias("day")).where("day % 4 = 0").groupBy("day")
        .agg((F.min("us") + 1).alias("us"))
        .select("us", (0.4 + F.col("day") % 5 / 20.0).alias("allow"), (0.75 + F.col("day") % 3 / 20.0).alias("block"))
    )
    out = policy_at(rows, versions)
    return out.select(
        "seq", F.when(F.col("allow").isNotNull(), verdict_band("p", "allow", "block")).alias("verdict")
    )


@query(
    "j11_tier_profile",
    """SELECT seq, CASE seq % 4 WHEN 0 THEN 180 WHEN 1 THEN 60 ELSE 300 END AS cache_ttl_s,
      CASE seq % 4 WHEN 0 THEN 100 WHEN 1 THEN 20 ELSE 500 END AS rate_max, seq % 4 <> 1 AS anomaly_on FROM tx""",
    TX,
)
def j11(spark, sf):
    m = F.col("seq") % 4
    tier = F.when(m == 0, "Cloud").when(m == 1, "edge").when(m == 2, "on_prem").otherwise("other")
    return with_tier_profile(tx(spark, sf).select("seq", tier.alias("tier"))).select(
        "seq", "cache_ttl_s", "rate_max", "anomaly_on"
    )


@query(
    "t05_rate_limit",
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
def t05(spark, sf):
    return rate_limit(tx(spark, sf), "sender_id", 2, 86_400).select(
        "seq", "allowed", "retry_after_s"
    )


# --- the whole decision ---------------------------------------------------------
@query(
    "m07_online_decision",
    f""", walk AS (SELECT sender_id, rn, seq, sec, sec AS start, 1 AS used, true AS allowed FROM req WHERE rn = 1
      UNION ALL SELECT r.sender_id, r.rn, r.seq, r.sec,
        CASE WHEN r.sec - w.start >= 86400 THEN r.sec ELSE w.start END,
        CASE WHEN r.sec - w.start >= 86400 THEN 1 WHEN w.used < 2 THEN w.used + 1 ELSE w.used END,
        r.sec - w.start >= 86400 OR w.used < 2
      FROM walk w JOIN req r ON r.sender_id = w.sender_id AND r.rn = w.rn + 1),
    held AS (SELECT r.seq, r.amount, r.us, coalesce(d.txn_frequency, 0.0) AS f,
      CASE WHEN r.us // 1000000 - d.us // 1000000 <= {TTL} THEN least(d.amount / 500.0, 1.0) ELSE 0.0 END AS delta,
      CASE WHEN r.us // 1000000 - d.us // 1000000 <= {TTL} THEN 'r' || d.seq % 7 END AS reason
      FROM (SELECT * FROM tx WHERE fraud_flag = 0) r ASOF LEFT JOIN (SELECT * FROM tx WHERE fraud_flag = 1) d
      ON r.sender_id = d.sender_id AND r.us >= d.us),
    ruled AS (SELECT h.*, coalesce(v.allow, 0.46) AS allow, coalesce(v.block, 0.75) AS block,
      round(greatest(0.0, least(1.0, 0.6 * least(1.0, h.amount::FLOAT::DOUBLE / 160.0) + 0.3 * (f::FLOAT::DOUBLE / 5.0) + 0.1 * delta)), 9) AS risk
      FROM held h ASOF LEFT JOIN versions v ON h.us >= v.us)
    SELECT w.seq, w.allowed, CASE WHEN w.allowed THEN 0 ELSE 86400 - (w.sec - w.start) END AS retry_after_s,
      CASE WHEN w.allowed THEN risk END AS risk_score, CASE WHEN w.allowed THEN reason END AS graph_reason,
      CASE WHEN NOT w.allowed THEN NULL WHEN risk < allow THEN 'ALLOW' WHEN risk >= block THEN 'BLOCK' ELSE 'FLAG' END AS verdict
    FROM walk w JOIN ruled r ON w.seq = r.seq""",
    "RECURSIVE " + TX + ", " + _VERSIONS + """, req AS (SELECT sender_id, seq, us // 1000000 AS sec,
      row_number() OVER (PARTITION BY sender_id ORDER BY us, seq) AS rn FROM tx WHERE fraud_flag = 0)""",
)
def m07_online(spark, sf):
    """Rate limit, feature cache, live graph delta, policy and fusion for every request."""
    df = tx(spark, sf)
    vectors = df.where("fraud_flag = 1").select(
        "sender_id", "us", "seq",
        F.array(F.col("amount").cast("float"), F.col("txn_frequency").cast("float")).alias("features"),
    )
    day = F.expr("us div 86400000000")
    versions = (
        df.select("us", day.alias("day")).where("day % 4 = 0").groupBy("day").agg((F.min("us") + 1).alias("us"))
        .select("us", (0.4 + F.col("day") % 5 / 20.0).alias("allow"), (0.75 + F.col("day") % 3 / 20.0).alias("block"))
    )

    def score(v):
        return F.least(F.lit(1.0), v[0].cast("double") / 160.0), v[1].cast("double") / 5.0

    out = decide_requests(
        _reads(df, "amount"), vectors, _deltas(df), versions, score, "sender_id", length=2, rate=(2, 86_400), ttl_s=TTL
    )
    band = F.col("verdict")
    return out.select("seq", "allowed", "retry_after_s", r9("risk_score").alias("risk_score"), "graph_reason", band)


# --- fusion -------------------------------------------------------------------
_BASE = "greatest(0.0, least(1.0, 0.6 * p + 0.3 * a + CASE WHEN topo THEN 0.1 ELSE 0.0 END::DOUBLE))"
_GAUNTLET = f"""CASE WHEN topo AND p >= 0.46 THEN greatest({_BASE}, 0.56, 0.75) WHEN topo AND p >= 0.25
  THEN greatest({_BASE}, 0.56) ELSE {_BASE} END"""


@query(
    "m06_fuse_gauntlet",
    f"SELECT seq, round(r, 9) AS risk, {_band('round(r, 9)')} AS verdict FROM (SELECT seq, {_GAUNTLET} AS r FROM scored)",
    SCORED,
)
def m06(spark, sf):
    rows = scored(spark, sf).withColumn("r", fuse_gauntlet("p", "a", "topo"))
    # Nine digits before banding: the weighted sum may differ in the last binary digit.
    return rows.select(
        "seq", r9("r").alias("risk"), verdict_band(F.round("r", 9)).alias("verdict")
    )


@query(
    "m07_fuse_gateway",
    """SELECT seq, round(greatest(0.0, least(1.0, 0.6 * p + 0.3 * a + 0.1 * delta)), 9) AS risk,
      round(greatest(0.0, least(1.0, 0.6 * p + 0.1 * delta)), 9) AS edge_risk FROM scored""",
    SCORED,
)
def m07(spark, sf):
    return scored(spark, sf).select(
        "seq",
        r9(fuse_gateway("p", "a", "delta")).alias("risk"),
        r9(fuse_gateway("p", "a", "delta", F.lit(False))).alias("edge_risk"),
    )


@query(
    "m04_anomaly_normalise",
    "SELECT seq, round(greatest(0.0, least(1.0, 0.5 - (a - 0.5))), 6) AS anomaly FROM scored",
    SCORED,
)
def m04_column(spark, sf):
    return scored(spark, sf).select(
        "seq", r6(anomaly_from_raw(F.col("a") - 0.5)).alias("anomaly")
    )


_LIVE = TIES + """, base AS (SELECT seq, amount, sender_id, row_number() OVER (PARTITION BY sender_id ORDER BY us, seq) AS rn,
   row_number() OVER (PARTITION BY sender_id ORDER BY us, seq) - 1 - count(*) OVER (PARTITION BY sender_id ORDER BY us
   RANGE BETWEEN UNBOUNDED PRECEDING AND 600000001 PRECEDING) AS n10 FROM th),
 fan AS (SELECT x.seq, count(DISTINCT y.sender_id) AS f10 FROM th x LEFT JOIN th y ON y.receiver_id = x.receiver_id
   AND y.us BETWEEN x.us - 600000000 AND x.us AND (y.us < x.us OR y.seq < x.seq) GROUP BY x.seq),
 s AS (SELECT base.seq, least(1.0, amount / 400.0 + CASE WHEN rn = 1 THEN 0.25 ELSE 0.0 END) AS p,
   least(1.0, n10 / 20.0::DOUBLE) AS a, f10 >= 10 OR n10 >= 12 AS topo FROM base JOIN fan ON base.seq = fan.seq)"""


@query(
    "m10_score_batch",
    f"""SELECT seq, round(r, 6) AS risk_score, {_band('round(r, 9)')} AS verdict, topo AS high_confidence
    FROM (SELECT seq, topo, {_GAUNTLET} AS r FROM s)""",
    _LIVE,
)
def m10(spark, sf):
    out = score_batch(hourly(tx(spark, sf)))
    return out.select(
        "seq", r6("risk_score").alias("risk_score"),
        verdict_band(F.round("risk_score", 9)).alias("verdict"), "high_confidence",
    )


@query(
    "p10_request_zscore",
    "SELECT seq, round(greatest(-5.0, least(5.0, (amount - 3000.0) / 12000.0)), 9) + 0.0 AS z FROM tx",
    TX,
)
def p10_request(spark, sf):
    return tx(spark, sf).select("seq", r9(fixed_zscore("amount", *REQUEST_AMOUNT)).alias("z"))
