"""Worked examples of graph risk, fusion, caches, limits, normalisers and metrics."""

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from conftest import SF
from tallyguard.catalog import base
from tallyguard.functions import scoring
from tallyguard.functions.identity import first_filled, hash_id, mask_vpa
from tallyguard.functions.rounding import fixed_text, round_exact
from tallyguard.operators.asof import cache_outcomes, last_update, risk_delta_lookup
from tallyguard.operators.graph import (
    WINDOW_EDGES,
    degrees,
    detections,
    graph_stats,
    last_edges,
    node_risk,
    simple_cycles,
)
from tallyguard.operators.metrics import (
    holdout_report,
    pr_auc,
    roc_auc,
    score_quantiles,
    threshold_metrics,
)
from tallyguard.operators.ratelimit import rate_limit
from tallyguard.operators.selection import order_statistics
from tallyguard.operators.split import temporal_split
from tallyguard.plans.manifest import (
    band_edges,
    build_manifest,
    read_manifest,
    score_from_manifest,
    write_manifest,
)
from tallyguard.schema import MICROS
from tallyguard.sources.statements import normalise_plaid, normalise_setu


def seed_graph(spark):
    edges = [(f"sender_{i}", "seed") for i in range(1, 9)]
    edges += [("seed", f"receiver_{i}") for i in range(1, 6)]
    edges += [("seed", "a"), ("a", "b"), ("b", "seed"), ("anchor", "seed")]
    edges += [("seed", f"scatter_{i}") for i in range(6, 12)]
    return spark.createDataFrame([(s, d, i, i) for i, (s, d) in enumerate(edges)],
                                 "src string, dst string, us bigint, seq bigint")


def test_seed_graph(spark):
    edges = seed_graph(spark)
    stats = graph_stats(edges, 500).first()
    assert (stats["nodes"], stats["edges"]) == (23, 23)
    risk = {r["vpa_hash"]: (r["risk_delta"], r["reason"]) for r in node_risk(detections(edges)).collect()}
    cycle = "cycle(k=1,min_len=3,sev=0.47)"
    assert risk == {
        "seed": (1.0, f"{cycle}+fan_in(n=10,sev=1.00)+fan_out(n=12,sev=1.00)"),
        "a": (0.3933, cycle),
        "b": (0.3933, cycle),
    }


def test_graph_queries_see_the_whole_window(spark):
    rows = base.edges(spark, SF).where("us IS NOT NULL").select("src", "dst").collect()
    assert 300 < len(rows) <= WINDOW_EDGES
    pairs = {(r["src"], r["dst"]) for r in rows if r["src"] != r["dst"]}
    got = {r["n"]: r["cycles"] for r in queries()["j06_edge_self_join"](spark, SF).collect()}
    assert got[2] == sum((b, a) in pairs for a, b in pairs) / 2


def test_cycles_equal_depth_first_search(spark):
    import random

    rng = random.Random(3)
    pairs = {(rng.randrange(9), rng.randrange(9)) for _ in range(34)}
    edges = spark.createDataFrame(
        [(f"n{a}", f"n{b}") for a, b in pairs] * 2, "src string, dst string"
    )
    got = sorted(tuple(r["path"]) for r in simple_cycles(edges).collect())
    out = {}
    for a, b in pairs:
        out.setdefault(f"n{a}", []).append(f"n{b}")
    expected = []

    def walk(path):
        for nxt in out.get(path[-1], []):
            if nxt == path[0] and len(path) >= 2:
                expected.append(tuple(path))
            elif nxt > path[0] and nxt not in path and len(path) < 5:
                walk(path + [nxt])

    for start in out:
        walk([start])
    assert got == sorted(expected)


def test_self_loop_counts_as_degree(spark):
    df = spark.createDataFrame([("x", "x"), ("x", "y")], "src string, dst string")
    got = {r["node"]: (r["out_deg"], r["in_deg"]) for r in degrees(df).collect()}
    assert got == {"x": (2, 1), "y": (0, 1)}


@pytest.mark.parametrize(
    "p,a,topo,risk,verdict",
    [
        (0.9, 0.4, True, 0.76, "BLOCK"),
        (0.3, 0.2, True, 0.56, "FLAG"),
        (0.5, 0.1, True, 0.75, "BLOCK"),
        (0.2, 0.2, True, 0.28, "ALLOW"),
        (0.5, 0.1, False, 0.33, "ALLOW"),
    ],
)
def test_gauntlet_fusion(spark, p, a, topo, risk, verdict):
    df = spark.createDataFrame([(p, a, topo)], "p double, a double, t boolean")
    row = df.select(scoring.fuse_gauntlet("p", "a", "t").alias("r")).select(
        "r", scoring.verdict_band("r").alias("v")
    ).first()
    assert row["r"] == pytest.approx(risk) and row["v"] == verdict


def test_gateway_fusion_and_bands(spark):
    df = spark.createDataFrame([(0.5, 0.1, 0.8)], "p double, a double, d double")
    row = df.select(
        scoring.fuse_gateway("p", "a", "d").alias("x"),
        scoring.fuse_gateway("p", "a", "d", F.lit(False)).alias("y"),
    ).first()
    assert row["x"] == pytest.approx(0.41) and row["y"] == pytest.approx(0.38)
    bands = spark.createDataFrame([(0.4599,), (0.46,), (0.75,)], "s double")
    got = [r["v"] for r in bands.select(scoring.verdict_band("s").alias("v")).collect()]
    assert got == ["ALLOW", "FLAG", "BLOCK"]
    assert band_edges(0.8)["BLOCK"] == (0.8, 1.0) and band_edges()["FLAG"] == (0.46, 0.75)


def test_rate_limit(spark):
    times = [0, 10, 20, 60, 61, 62, 125]
    rows = [(k, t * MICROS, i) for k in ("a", "b") for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "k string, us bigint, seq bigint")
    out = rate_limit(df, "k", 2, 60).orderBy("k", "us").collect()
    assert [r["allowed"] for r in out] == [True, True, False, True, True, False, True] * 2
    assert out[2]["retry_after_s"] == 40


def test_rate_limit_ranks_within_a_second(spark):
    df = spark.createDataFrame([("a", 5 * MICROS + i, i) for i in range(5)], "k string, us bigint, seq bigint")
    out = rate_limit(df, "k", 3, 60).orderBy("seq").collect()
    assert [r["allowed"] for r in out] == [True] * 3 + [False] * 2


@pytest.mark.parametrize("many", [False, True])
def test_cache_ttl(spark, request, many):
    if many:
        request.getfixturevalue("dense")
    writes = spark.createDataFrame(
        [(f"k{i}", 100 * MICROS, 0, 0.8, "fan_in") for i in range(12)],
        "k string, us bigint, seq bigint, risk_delta double, reason string",
    )
    reads = spark.createDataFrame(
        [(f"k{i}", t * MICROS, t) for i in range(12) for t in (50, 200, 280, 281, 290)],
        "k string, us bigint, seq bigint",
    )
    out = cache_outcomes(reads, writes, "k", 180).where("k = 'k3'").orderBy("us")
    assert [r["outcome"] for r in out.collect()] == ["miss", "hit", "hit", "expired", "miss"]
    found = risk_delta_lookup(reads, writes, "k", 180).where("k = 'k5'").orderBy("us").collect()
    assert [r["graph_delta"] for r in found] == [0.0, 0.8, 0.8, 0.0, 0.0]
    assert found[0]["graph_reason"] == "cold"


def test_last_update_on_dense_key(spark, dense):
    writes = spark.createDataFrame([("h", i * 100, i, i) for i in range(30)], "k string, us bigint, seq bigint, v int")
    reads = spark.createDataFrame([("h", t, t) for t in range(-5, 3100, 37)], "k string, us bigint, seq bigint")
    for r in last_update(reads, writes, ["k"]).collect():
        want = min(r["us"] // 100, 29) if r["us"] >= 0 else None
        assert (r["update"]["v"] if r["update"] else None) == want


def test_setu_golden(spark):
    spec = "account_id string, txnId string, amount double, narration string, type string, currentBalance double, date string"
    rows = [
        ("acc_axis_001", "S001", 320.0, "UPI/SWIGGY.MERCHANT@OKICICI/Order #482", "DEBIT", 84680.0, "2026-03-28T12:34:00+05:30"),
        ("acc_axis_001", "S002", 1250.0, "UPI/ZOMATO.GOLD@OKICICI/Subscription", "DEBIT", 83430.0, "2026-03-28T18:02:00+05:30"),
        ("acc_axis_001", "S005", 2799.0, "UPI/AMAZON.PAY@AMAOFICS/Order AMZ2803", "DEBIT", 75332.0, "2026-03-26T16:45:00+05:30"),
        ("acc_axis_001", "S009", 48000.0, "UPI/CASH.AGENT.77@YESB/Settlement", "DEBIT", 16293.0, "2026-03-29T02:15:00+05:30"),
        ("acc_axis_001", "S012", 55000.0, "NEFT/SALARY MARCH 2026/EMPLOYER LTD", "CREDIT", 56593.0, "2026-03-01T09:00:00+05:30"),
    ]
    out = {r["transaction_id"]: r for r in normalise_setu(spark.createDataFrame(rows, spec)).collect()}
    assert set(out) == {"S001", "S002", "S005", "S009"}
    first = out["S001"]
    assert (first["merchant_category"], first["transaction_type"]) == ("FOOD", "P2M")
    assert first["receiver_vpa"] == "swiggy.merchant@okicici"
    assert (first["sender_bank"], first["receiver_bank"]) == ("axisbank", "okicici")
    assert first["device_txn_count_24h"] == 2 and first["local_ts"].hour == 12
    assert (out["S009"]["merchant_category"], out["S009"]["receiver_bank"]) == ("P2P", "yesbank")
    assert (out["S005"]["merchant_category"], out["S005"]["receiver_bank"]) == ("ECOM", "UNKNOWN")


def test_plaid_golden(spark):
    spec = "transaction_id string, amount double, merchant_name string, name string, category array<string>, date string, payment_channel string, account_id string"
    rows = [
        ("P001", 38.5, "McDonald's", None, ["Food and Drink", "Fast Food"], "2026-03-28", "in_store", "plaid_acc_001"),
        ("P005", 94.2, "Comcast", None, ["Service", "Internet Services"], "2026-03-26", "online", "plaid_acc_001"),
        ("P006", 142.5, "T-Mobile", None, ["Service", "Phone"], "2026-03-26", "online", "plaid_acc_001"),
        ("P008", 234.0, "Apple", None, ["Shops", "Electronics"], "2026-03-25", "online", "plaid_acc_002"),
        ("P009", 4980.0, "Crypto Exchange", None, ["Transfer", "Digital Purchase"], "2026-03-29", "online", "plaid_acc_002"),
    ]
    out = {r["transaction_id"]: r for r in normalise_plaid(spark.createDataFrame(rows, spec)).collect()}
    p1 = out["P001"]
    assert p1["amount_inr"] == pytest.approx(3214.75) and p1["receiver_vpa"] == "mcdonalds@upi"
    assert (p1["merchant_category"], p1["transaction_type"], p1["device_type"]) == ("FOOD", "P2M", "Android")
    assert (out["P008"]["merchant_category"], out["P008"]["device_type"]) == ("ECOM", "iOS")
    p9 = out["P009"]
    assert p9["amount_inr"] == pytest.approx(415830.0)
    assert (p9["merchant_category"], p9["transaction_type"]) == ("ECOM", "P2P")
    assert p9["receiver_vpa"] == "cryptoexchange@upi"
    assert out["P006"]["merchant_category"] == "UTILITY"
    assert out["P005"]["merchant_category"] == "ECOM"


def test_masking_and_ids(spark):
    df = spark.createDataFrame(
        [("9876543210@ybl",), ("ravi.kumar@axisbank",), ("9876543210",)], "v string"
    )
    assert [r[0] for r in df.select(mask_vpa("v")).collect()] == [
        "98****10@ybl", "ravi.kumar@axisbank", "9876543210",
    ]
    ids = spark.createDataFrame([(None, ""), ("x", "y")], "a string, b string")
    rows = ids.select(hash_id("a", 12).alias("h"), first_filled(["b", "a"], "none").alias("e")).collect()
    assert len(rows[0]["h"]) == 12 and [r["e"] for r in rows] == ["none", "y"]


def test_threshold_metrics_golden(spark):
    cells = [(1, 0.9, 1164), (0, 0.9, 17), (0, 0.1, 47869), (1, 0.1, 31)]
    df = spark.createDataFrame(cells, "fraud_flag int, score double, n int").select(
        "fraud_flag", "score", F.explode(F.sequence(F.lit(1), "n"))
    )
    m = threshold_metrics(df).first()
    assert (m["tp"], m["fp"], m["tn"], m["fn"]) == (1164, 17, 47869, 31)
    assert m["precision"] == pytest.approx(0.985605, abs=1e-6)
    assert m["recall"] == pytest.approx(0.974059, abs=1e-6)
    assert m["f0_5"] == pytest.approx(0.983274, abs=1e-6)


def test_areas_against_pairs(spark):
    import random

    rng = random.Random(5)
    rows = [(int(rng.random() < 0.3), round(rng.random(), 1)) for _ in range(200)]
    df = spark.createDataFrame(rows, "fraud_flag int, score double")
    pos = [s for y, s in rows if y]
    neg = [s for y, s in rows if not y]
    wins = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
    assert roc_auc(df).first()[0] == pytest.approx(wins / len(pos) / len(neg))
    ap, found = 0.0, 0
    for s in sorted({s for _, s in rows}, reverse=True):
        gained = sum(1 for x in pos if x == s)
        found += gained
        ap += gained / len(pos) * found / sum(1 for _, x in rows if x >= s)
    assert pr_auc(df).first()[0] == pytest.approx(ap)
    report = holdout_report(df).first()
    assert report["roc_auc"] == pytest.approx(wins / len(pos) / len(neg))


def test_metrics_without_positives(spark):
    df = spark.createDataFrame([(0, 0.9), (0, 0.2)], "fraud_flag int, score double")
    m = threshold_metrics(df).first()
    assert (m["precision"], m["recall"], m["f0_5"]) == (0.0, 0.0, 0.0)
    assert roc_auc(df).first()[0] is None


def test_selection_and_quantiles(spark):
    import random

    rng = random.Random(11)
    values = [rng.choice([0.0, 1e-9, 3.5, -2.0, 1e6, rng.random()]) for _ in range(501)]
    df = spark.createDataFrame([(v,) for v in values], "score double")
    ordered = sorted(values)
    got = order_statistics(df, "score", [0, 13, 250, 400, 500])
    for rank, (value, below) in got.items():
        assert value == ordered[rank] and below == sum(v < value for v in values)
    q = score_quantiles(df).first()
    assert q["q50"] == ordered[250] and q["q00"] == ordered[0] and q["q100"] == ordered[500]


def test_report_leaves_out_missing_scores(spark):
    rows = [(i % 3 == 0, i / 200) for i in range(200)] + [(1, None), (0, None)]
    df = spark.createDataFrame([(int(y), s) for y, s in rows], "fraud_flag int, score double").repartition(7)
    report = holdout_report(df, 0.5).first()
    assert (report["tp"], report["fp"]) == (33, 67) and report["tn"] + report["fn"] == 100
    assert (report["q00"], report["q100"]) == (0.0, 199 / 200)
    assert report["q50"] == pytest.approx(0.4975) and report["q99"] == pytest.approx(0.98505)
    empty = holdout_report(df.where("score > 5")).first()
    assert (empty["tp"], empty["roc_auc"], empty["q50"]) == (0, None, None)


def test_manifest_read_back(spark, tmp_path):
    rows = [(i, float(i), f"t{i % 3}", "d", None, f"b{i % 2}", "b0", int(i % 2)) for i in range(20)]
    names = "seq bigint, amount double, transaction_type string, device_type string, network_type string"
    df = spark.createDataFrame(rows, names + ", sender_bank string, receiver_bank string, fraud_flag int")
    made = build_manifest(df, threshold=0.4, corridor_rate=0.2)
    write_manifest(made, str(tmp_path / "m"))
    back = read_manifest(spark, str(tmp_path / "m"))
    assert back.document.first() == made.document.first()
    codes = {(r["column"], r["category"]): r["code"] for r in back.fitted.codes.collect()}
    assert codes["transaction_type", "t2"] == 2 and codes["network_type", "nan"] == 0
    out = score_from_manifest(df, back, F.lit(0.6), F.lit(0.2), F.col("is_high_risk_corridor") == 1)
    got = {r["seq"]: (r["enc_transaction_type"], round(r["risk_score"], 6), r["verdict"]) for r in out.collect()}
    assert got[4] == (1.0, 0.42, "FLAG") and got[5] == (2.0, 0.75, "BLOCK")


def test_temporal_split_with_ties(spark):
    rows = [(i, (i // 7) * 10) for i in range(50)]
    df = spark.createDataFrame(rows, "seq bigint, us bigint").repartition(5)
    out = temporal_split(df, 0.8).where("split = 'train'")
    assert sorted(r["seq"] for r in out.collect()) == list(range(40))


@pytest.mark.parametrize("x", [0.125, 0.375, 0.145, 0.165, 0.4666666, 1.0, 0.0, 0.005, 0.995])
def test_text_rounding(spark, x):
    df = spark.createDataFrame([(x,)], "x double")
    row = df.select(fixed_text(F.col("x")).alias("t"), round_exact(F.col("x"), 4).alias("r")).first()
    assert row["t"] == f"{x:.2f}" and row["r"] == round(x, 4)


def test_newest_edges_of_a_large_table(spark, dense):
    rows = [("a", "b", (i * 37) % 100 // 4, i) for i in range(100)]
    df = spark.createDataFrame(rows, "src string, dst string, us bigint, seq bigint")
    got = [(r["us"], r["seq"]) for r in last_edges(df, 11).collect()]
    assert got == sorted(((u, s) for _, _, u, s in rows), reverse=True)[:11]
