"""Metric, profile, top-list and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyguard.catalog.base import SCORED, TX, query, r6, r9, scored, tx
from tallyguard.functions.scoring import verdict_band
from tallyguard.operators.asof import latest_per_key
from tallyguard.operators.metrics import (
    best_candidate,
    class_balance,
    holdout_report,
    operating_point,
    pr_auc,
    roc_auc,
    score_quantiles,
    threshold_metrics,
)
from tallyguard.operators.profile import (
    batch_summary,
    fraud_value_counts,
    latest_rows,
    leakage_checks,
    network_monitor,
    recent_endpoints,
    source_counts,
    split_profile,
    verdict_counts,
)
from tallyguard.operators.split import temporal_split
from tallyguard.operators.trailing import trailing_windows
from tallyguard.plans.manifest import build_manifest, read_manifest, score_from_manifest, write_manifest
from tallyguard.plans.score import rule_anomaly
from tallyguard.schema import DAY
from tallyguard.session import scratch_path

_SPLIT = SCORED + """, sp AS (SELECT tx.*, CASE WHEN row_number() OVER (ORDER BY us, seq)
  <= cast(floor(0.8 * count(*) OVER ()) AS BIGINT) THEN 'train' ELSE 'holdout' END AS split FROM tx)"""
# A score that carries some signal about the label, with many ties.
_RANKED = SCORED + """, ranked AS (SELECT seq, fraud_flag, CASE WHEN fraud_flag = 1 THEN (p + a) / 2 ELSE p * a END AS score FROM scored)"""


def _ranked(spark, sf):
    p, a = F.col("p"), F.col("a")
    score = F.when(F.col("fraud_flag") == 1, (p + a) / 2).otherwise(p * a)
    return scored(spark, sf).select("seq", "us", "fraud_flag", score.alias("score"))


@query(
    "a04_class_balance",
    """SELECT sum(fraud_flag)::BIGINT AS positives, sum(1 - fraud_flag)::BIGINT AS negatives,
      round(sum(1 - fraud_flag) / greatest(sum(fraud_flag), 1)::DOUBLE, 6) AS scale_pos_weight FROM tx""",
    TX,
)
def a04(spark, sf):
    return class_balance(tx(spark, sf)).withColumn("scale_pos_weight", r6("scale_pos_weight"))


_CELLS = """SELECT sum((score >= {t} AND fraud_flag = 1)::INT)::BIGINT AS tp, sum((score >= {t} AND fraud_flag = 0)::INT)::BIGINT AS fp,
  sum((score < {t} AND fraud_flag = 0)::INT)::BIGINT AS tn, sum((score < {t} AND fraud_flag = 1)::INT)::BIGINT AS fn FROM ranked"""
_RATES = f"""SELECT *, CASE WHEN 0.25 * precision + recall > 0 THEN 1.25 * precision * recall / (0.25 * precision + recall)
  ELSE 0.0 END AS f0_5 FROM (SELECT *, tp / greatest(tp + fp, 1)::DOUBLE AS precision, tp / greatest(tp + fn, 1)::DOUBLE AS recall
  FROM ({_CELLS}))"""
_ROUNDED = "tp, fp, tn, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f0_5, 6) AS f0_5"


def _metric_columns(df):
    return df.select(
        "tp", "fp", "tn", "fn", *[r6(c).alias(c) for c in ("precision", "recall", "f0_5")]
    )


@query("a05_threshold_metrics", f"SELECT {_ROUNDED} FROM ({_RATES.format(t=0.46)})", _RANKED)
def a05(spark, sf):
    return _metric_columns(threshold_metrics(_ranked(spark, sf)))


_AUC = """SELECT round((sum(r * fraud_flag) - P * (P + 1) / 2) / (P * N), 6) AS roc_auc FROM
  (SELECT fraud_flag, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS r FROM ranked),
  (SELECT sum(fraud_flag)::DOUBLE AS P, sum(1 - fraud_flag)::DOUBLE AS N FROM ranked) GROUP BY P, N"""
_AP = """SELECT round(sum(tp * ctp / cn::DOUBLE) / max(ctp)::DOUBLE, 6) AS pr_auc FROM (SELECT tp,
  sum(tp) OVER (ORDER BY score DESC)::DOUBLE AS ctp, sum(n) OVER (ORDER BY score DESC)::DOUBLE AS cn
  FROM (SELECT score, sum(fraud_flag) AS tp, count(*) AS n FROM ranked GROUP BY score))"""


@query("a06_roc_auc", _AUC, _RANKED)
def a06(spark, sf):
    return roc_auc(_ranked(spark, sf)).select(r6("roc_auc").alias("roc_auc"))


@query("a07_pr_auc", _AP, _RANKED)
def a07(spark, sf):
    return pr_auc(_ranked(spark, sf)).select(r6("pr_auc").alias("pr_auc"))


_Q = {"q00": 0.0, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q90": 0.9, "q99": 0.99, "q100": 1.0}
_QUANTILES = ", ".join(f"round(quantile_cont(score, {q}), 9) AS {n}" for n, q in _Q.items())


@query("a08_score_quantiles", f"SELECT {_QUANTILES} FROM ranked", _RANKED)
def a08(spark, sf):
    return score_quantiles(_ranked(spark, sf)).select(*[r9(n).alias(n) for n in _Q])


_LABEL = """CASE WHEN precision >= 0.95 AND recall >= 0.9 THEN 'strong' WHEN precision >= 0.9 AND recall >= 0.8 THEN 'good'
  ELSE 'needs_tuning' END AS operating_point"""


@query(
    "a09_operating_point",
    f"SELECT round(precision, 6) AS precision, round(recall, 6) AS recall, {_LABEL} FROM ({_RATES.format(t=0.46)})",
    _RANKED,
)
def a09(spark, sf):
    out = operating_point(threshold_metrics(_ranked(spark, sf)))
    return out.select(r6("precision").alias("precision"), r6("recall").alias("recall"), "operating_point")


@query(
    "m08_holdout_evaluation",
    f"SELECT {_ROUNDED}, {_LABEL}, roc_auc, pr_auc, {', '.join(_Q)} FROM ({_RATES.format(t=0.46)}), ({_AUC}), ({_AP}), "
    f"(SELECT {_QUANTILES} FROM ranked)",
    _RANKED,
)
def m08(spark, sf):
    out = holdout_report(_ranked(spark, sf))
    return out.select(
        "tp", "fp", "tn", "fn", "operating_point",
        *[r6(c).alias(c) for c in ("precision", "recall", "f0_5", "roc_auc", "pr_auc")],
        *[r9(c).alias(c) for c in _Q],
    )


@query(
    "a17_verdict_counts",
    """SELECT verdict, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS pct FROM
      (SELECT CASE WHEN p < 0.46 THEN 'ALLOW' WHEN p >= 0.75 THEN 'BLOCK' ELSE 'FLAG' END AS verdict FROM scored) GROUP BY verdict""",
    SCORED,
)
def a17(spark, sf):
    counts = verdict_counts(scored(spark, sf).select(verdict_band("p").alias("verdict")))
    return counts.select("verdict", "n", r6("pct").alias("pct"))


_V = """v AS (SELECT seq, us, p AS risk_score, sender_id AS src, receiver_id AS dst,
  CASE WHEN seq % 2 = 0 THEN 'setu' ELSE 'plaid' END AS source,
  CASE WHEN p < 0.46 THEN 'ALLOW' WHEN p >= 0.75 THEN 'BLOCK' ELSE 'FLAG' END AS verdict FROM scored)"""


def _flows(spark, sf):
    return scored(spark, sf).select(
        "seq", "us", F.col("p").alias("risk_score"), F.col("sender_id").alias("src"),
        F.col("receiver_id").alias("dst"),
        F.when(F.col("seq") % 2 == 0, "setu").otherwise("plaid").alias("source"),
        verdict_band("p").alias("verdict"),
    )


@query(
    "a18_batch_risk_summary",
    """SELECT count(*) AS processed, sum((verdict = 'ALLOW')::INT)::BIGINT AS allow, sum((verdict = 'FLAG')::INT)::BIGINT AS flag,
      sum((verdict = 'BLOCK')::INT)::BIGINT AS block, round(avg(risk_score), 6) AS avg_risk
    FROM (SELECT * FROM v ORDER BY seq LIMIT 25)""",
    SCORED + ", " + _V,
)
def a18(spark, sf):
    return batch_summary(_flows(spark, sf), 25, ["seq"]).withColumn("avg_risk", r6("avg_risk"))


@query(
    "a19_source_counts",
    """SELECT source, count(*) AS n, sum((verdict = 'FLAG')::INT)::BIGINT AS flagged,
      sum((verdict = 'BLOCK')::INT)::BIGINT AS blocked FROM v GROUP BY source""",
    SCORED + ", " + _V,
)
def a19(spark, sf):
    return source_counts(_flows(spark, sf))


_L40 = ", l AS (SELECT * FROM v ORDER BY seq DESC LIMIT 40)"


@query(
    "a20_network_monitor",
    """SELECT sum((verdict <> 'ALLOW')::INT)::BIGINT AS flagged, sum((verdict = 'BLOCK')::INT)::BIGINT AS blocked,
      (SELECT count(*) FROM (SELECT src FROM l UNION SELECT dst FROM l)) AS unique_nodes FROM l""",
    SCORED + ", " + _V + _L40,
)
def a20(spark, sf):
    return network_monitor(_flows(spark, sf))


@query(
    "a22_split_profile",
    """SELECT split, count(*) AS n, sum(fraud_flag)::BIGINT AS fraud, sum(1 - fraud_flag)::BIGINT AS legit,
      round(100.0 * sum(fraud_flag) / count(*)::DOUBLE, 6) AS fraud_pct, min(us) AS min_us, max(us) AS max_us FROM sp GROUP BY split""",
    _SPLIT,
)
def a22(spark, sf):
    return split_profile(temporal_split(tx(spark, sf))).withColumn("fraud_pct", r6("fraud_pct"))


def _with_counts(spark, sf):
    rows = trailing_windows(
        temporal_split(tx(spark, sf)), ["sender_id"], {"device_txn_count_24h": DAY}
    )
    return trailing_windows(rows, ["receiver_id"], {"receiver_txn_count_24h": DAY})


_COUNTED = _SPLIT + """, counted AS (SELECT *,
  count(*) OVER (PARTITION BY sender_id ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND 1 PRECEDING) AS device_txn_count_24h,
  count(*) OVER (PARTITION BY receiver_id ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND 1 PRECEDING) AS receiver_txn_count_24h
  FROM sp)"""


@query(
    "a23_fraud_value_counts",
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY n DESC, value) AS rank FROM (
      SELECT 'device_txn_count_24h' AS feature, device_txn_count_24h AS value, count(*) AS n FROM counted WHERE fraud_flag = 1 GROUP BY ALL
      UNION ALL SELECT 'receiver_txn_count_24h', receiver_txn_count_24h, count(*) FROM counted WHERE fraud_flag = 1 GROUP BY ALL))
    WHERE rank <= 10""",
    _COUNTED,
)
def a23(spark, sf):
    return fraud_value_counts(
        _with_counts(spark, sf), ["device_txn_count_24h", "receiver_txn_count_24h"]
    )


@query(
    "a24_leakage_checks",
    """SELECT 'identical_fraud_feature' AS "check", 'critical' AS severity,
      (SELECT count(DISTINCT device_txn_count_24h) FROM counted WHERE split = 'holdout' AND fraud_flag = 1) = 1 AS fired
    UNION ALL SELECT 'no_new_devices', 'critical', n = 0 FROM fresh
    UNION ALL SELECT 'few_new_devices', 'warning', n < (SELECT count(DISTINCT sender_id) FROM sp WHERE split = 'holdout') * 0.1 FROM fresh
    UNION ALL SELECT 'low_fraud_rate', 'warning', (SELECT avg(fraud_flag) FROM sp WHERE split = 'holdout') < 0.01""",
    _COUNTED + """, fresh AS (SELECT count(DISTINCT sender_id) AS n FROM sp WHERE split = 'holdout' AND sender_id NOT IN
      (SELECT sender_id FROM sp WHERE split = 'train'))""",
)
def a24(spark, sf):
    return leakage_checks(_with_counts(spark, sf), "sender_id", "device_txn_count_24h")


@query(
    "o06_latest_rows",
    "SELECT seq, src, dst, verdict FROM v ORDER BY seq DESC LIMIT 60",
    SCORED + ", " + _V,
)
def o06(spark, sf):
    return latest_rows(_flows(spark, sf), 60).select("seq", "src", "dst", "verdict")


@query(
    "o07_recent_distinct_endpoints",
    "SELECT src AS endpoint, max(seq) AS last_seq FROM l GROUP BY src ORDER BY last_seq DESC LIMIT 8",
    SCORED + ", " + _V + _L40,
)
def o07(spark, sf):
    return recent_endpoints(_flows(spark, sf), "src")


@query(
    "o08_cache_snapshot",
    """SELECT sender_id, max(us) AS us, arg_max(amount, us) AS amount FROM tx WHERE fraud_flag = 1
      GROUP BY sender_id ORDER BY sender_id LIMIT 20""",
    TX,
)
def o08(spark, sf):
    writes = tx(spark, sf).where("fraud_flag = 1").select("sender_id", "us", "seq", "amount")
    entries = latest_per_key(writes, ["sender_id"], ["us", "seq"])
    return entries.orderBy("sender_id").limit(20).select("sender_id", "us", "amount")


_CANDIDATES = ["(p + a) / 2", "a", "p"]


@query(
    "o09_best_candidate",
    "SELECT candidate, round(f0_5, 6) AS f0_5, round(pr_auc, 6) AS pr_auc FROM ("
    + " UNION ALL ".join(
        f"SELECT {i} AS candidate, f0_5, pr_auc FROM ({_RATES.format(t=0.46)}), ({_AP})".replace(
            "FROM ranked", f"FROM (SELECT fraud_flag, {e} AS score FROM scored)"
        )
        for i, e in enumerate(_CANDIDATES)
    )
    + ") ORDER BY f0_5 DESC, pr_auc DESC, candidate LIMIT 1",
    SCORED,
)
def o09(spark, sf):
    rows = None
    for i, score in enumerate(_CANDIDATES):
        df = scored(spark, sf).select("fraud_flag", F.expr(score).alias("score"))
        one = threshold_metrics(df).select(
            F.lit(i).alias("candidate"), "f0_5", pr_auc(df).scalar().alias("pr_auc")
        )
        rows = one if rows is None else rows.unionByName(one)
    return best_candidate(rows).select(
        "candidate", r6("f0_5").alias("f0_5"), r6("pr_auc").alias("pr_auc")
    )


@query(
    "u03_intersect_devices",
    "SELECT sender_id FROM sp WHERE split = 'train' INTERSECT SELECT sender_id FROM sp WHERE split = 'holdout'",
    _SPLIT,
)
def u03(spark, sf):
    rows = temporal_split(tx(spark, sf))
    ids = [rows.where(F.col("split") == s).select("sender_id") for s in ("train", "holdout")]
    return ids[0].intersect(ids[1])


@query(
    "u04_except_devices",
    """SELECT receiver_id || sender_id AS device FROM sp WHERE split = 'holdout'
      EXCEPT SELECT receiver_id || sender_id FROM sp WHERE split = 'train'""",
    _SPLIT,
)
def u04(spark, sf):
    rows = temporal_split(tx(spark, sf)).withColumn(
        "device", F.concat("receiver_id", "sender_id")
    )
    ids = [rows.where(F.col("split") == s).select("device") for s in ("holdout", "train")]
    return ids[0].subtract(ids[1])


@query(
    "t07_dedupe_first_seen",
    "SELECT transaction_id, min(seq) AS seq FROM (SELECT transaction_id, seq FROM tx UNION ALL SELECT transaction_id, seq + 7 FROM tx) GROUP BY transaction_id",
    TX,
)
def t07(spark, sf):
    once = tx(spark, sf).select("transaction_id", "seq")
    twice = once.unionByName(once.withColumn("seq", F.col("seq") + 7))
    return latest_per_key(twice, ["transaction_id"], ["seq"], newest=False)


@query(
    "m09_manifest_build",
    """SELECT 24 AS n_features, round(avg(amount), 6) AS global_mean, round(stddev_samp(amount), 6) AS global_std,
      0.46::DOUBLE AS flag_from, 0.75::DOUBLE AS block_from,
      (SELECT count(*) FROM (SELECT 1 FROM sp WHERE split = 'train' GROUP BY sender_bank, receiver_bank
        HAVING sum(fraud_flag) / count(*)::DOUBLE > 0.2)) AS corridors,
      (SELECT count(DISTINCT transaction_type) FROM sp WHERE split = 'train') AS transaction_types
    FROM sp WHERE split = 'train'""",
    _SPLIT,
)
def m09(spark, sf):
    train = temporal_split(tx(spark, sf)).where("split = 'train'")
    manifest = build_manifest(train, corridor_rate=0.2)
    types = manifest.fitted.codes.where("column = 'transaction_type'").agg(F.count(F.lit(1)).alias("n"))
    corridors = manifest.fitted.corridors.agg(F.count(F.lit(1)).alias("n"))
    return manifest.document.select(
        "n_features", r6("global_mean").alias("global_mean"), r6("global_std").alias("global_std"),
        F.col("verdicts.FLAG")[0].alias("flag_from"), F.col("verdicts.BLOCK")[0].alias("block_from"),
        corridors.scalar().alias("corridors"), types.scalar().alias("transaction_types"),
    )


_STORED = """SELECT h.seq, coalesce(c.code, -1)::DOUBLE AS enc_transaction_type, (b.sender_bank IS NOT NULL)::INT::DOUBLE AS risky,
  0.6 * least(1.0, amount / 400.0::DOUBLE) + 0.3 * least(1.0, abs((amount - m) / (s + 1e-9)) / 10.0) AS r
  FROM (SELECT * FROM sp WHERE split = 'holdout') h,
    (SELECT avg(amount) AS m, stddev_samp(amount) AS s FROM sp WHERE split = 'train')
  LEFT JOIN (SELECT t, row_number() OVER (ORDER BY t) - 1 AS code FROM
    (SELECT DISTINCT coalesce(transaction_type, 'nan') AS t FROM sp WHERE split = 'train')) c
    ON c.t = coalesce(transaction_type, 'nan')
  LEFT JOIN (SELECT sender_bank, receiver_bank FROM sp WHERE split = 'train' AND sender_bank IS NOT NULL
    AND receiver_bank IS NOT NULL GROUP BY ALL HAVING sum(fraud_flag) / count(*)::DOUBLE > 0.2) b
    ON b.sender_bank = h.sender_bank AND b.receiver_bank = h.receiver_bank"""


@query(
    "m10_score_from_manifest",
    f"""SELECT seq, enc_transaction_type, risky, round(r, 6) AS risk_score, CASE WHEN round(r, 9) < 0.46 THEN 'ALLOW'
      WHEN round(r, 9) >= 0.75 THEN 'BLOCK' ELSE 'FLAG' END AS verdict FROM ({_STORED})""",
    _SPLIT,
)
def m10_manifest(spark, sf):
    rows = temporal_split(tx(spark, sf))
    path = scratch_path(spark, "manifest")
    write_manifest(build_manifest(rows.where("split = 'train'"), corridor_rate=0.2), path)
    out = score_from_manifest(
        rows.where("split = 'holdout'"),
        read_manifest(spark, path),
        F.least(F.lit(1.0), F.col("amount") / 400.0),
        rule_anomaly("amount_zscore_global"),
        F.lit(False),
    )
    return out.select(
        "seq", "enc_transaction_type", F.col("is_high_risk_corridor").alias("risky"),
        r6("risk_score").alias("risk_score"), verdict_band(F.round("risk_score", 9)).alias("verdict"),
    )
