"""Composed plans: online decision, graph feedback, order statistics."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from tallyguard.operators.policy import policy_at
from tallyguard.operators.selection import linear_quantiles, order_statistics
from tallyguard.plans.feedback import compact, publish_window, read_log, with_feedback
from tallyguard.plans.online import decide_requests
from tallyguard.schema import MICROS
from tallyguard.session import scratch_path

ROWS = "k string, us bigint, seq bigint, amount double"


def at(s):
    return s * MICROS


@pytest.mark.parametrize("keys", ["sparse", "dense"])
def test_online_decision_golden(spark, request, keys):
    if keys == "dense":
        request.getfixturevalue("dense")
    requests = [("a", at(100), 1, 50.0), ("a", at(101), 2, 50.0), ("a", at(102), 3, 50.0), ("b", at(103), 4, 500.0)]
    requests += [("a", at(500), 5, 90.0), (None, at(104), 6, 10.0)] + [("c", at(1_000 + i), 100 + i, 1.0) for i in range(30)]
    df = spark.createDataFrame(requests, ROWS)
    vectors = spark.createDataFrame([("a", at(90), 1, [1.0, 2.0]), ("a", at(101), 2, [1.0, 4.0])], "k string, us bigint, seq bigint, features array<float>")
    deltas = spark.createDataFrame([("a", at(99), 1, 1.0, "ring"), ("b", at(50), 2, 0.5, "fan")], "k string, us bigint, seq bigint, risk_delta double, reason string")
    policies = spark.createDataFrame([(at(400), 0.1, 0.2)], "us bigint, allow double, block double")
    out = decide_requests(
        df, vectors, deltas, policies, lambda v: (v[0].cast("double") / 100.0, v[1].cast("double") / 10.0),
        "k", length=2, rate=(2, 60), ttl_s=100,
    )
    got = {r["seq"]: r for r in out.collect()}
    assert len(got) == len(requests)
    assert [got[i]["allowed"] for i in (1, 2, 3, 4, 5, 6)] == [True, True, False, True, True, True]
    assert got[3]["verdict"] is None and got[3]["risk_score"] is None and got[3]["retry_after_s"] == 58
    assert got[1]["risk_score"] == pytest.approx(0.6 * 0.5 + 0.3 * 0.2 + 0.1) and got[1]["graph_reason"] == "ring"
    assert got[2]["risk_score"] == pytest.approx(0.6 * 0.5 + 0.3 * 0.4 + 0.1)  # the vector of its own second
    assert got[4]["risk_score"] == 1.0 and got[4]["verdict"] == "BLOCK" and got[4]["graph_reason"] == "fan"
    assert got[5]["graph_reason"] is None and got[5]["verdict"] == "BLOCK"  # delta too old, stricter policy
    assert got[6]["risk_score"] == pytest.approx(0.06) and got[6]["verdict"] == "ALLOW"
    assert sum(got[100 + i]["allowed"] for i in range(30)) == 2


def test_online_decision_edge_tier(spark):
    """The edge tier leaves the anomaly term out and has its own limits."""
    df = spark.createDataFrame([("a", at(i), i, 50.0) for i in range(25)], ROWS)
    none = df.where("false")
    out = decide_requests(
        df, none.withColumn("features", F.array().cast("array<float>")), none.withColumn("risk_delta", F.lit(0.0)).withColumn("reason", F.lit("")),
        spark.createDataFrame([], "us bigint, allow double, block double"), lambda v: (v[0].cast("double") / 100.0, F.lit(1.0)), "k", tier="edge",
    )
    rows = out.collect()
    assert sum(r["allowed"] for r in rows) == 20
    assert {round(r["risk_score"], 6) for r in rows if r["allowed"]} == {0.3}


@pytest.mark.parametrize("local_rows, budget", [(1_000, "1000000"), (0, "1000000"), (0, "20")])
def test_policy_lookup(spark, local_rows, budget):
    """Sorted change points and the chunked merge agree with a plain search; ties take the last policy."""
    drawn = random.Random(5)
    versions = [(drawn.randrange(0, 900, 3), drawn.randrange(4) / 10) for _ in range(200)] + [(30, None), (None, 0.9)]
    rows = [(i, drawn.randrange(-20, 1_000)) for i in range(300)] + [(999, None)]
    spark.conf.set("tallyguard.rowsPerChunk", budget)
    try:
        out = policy_at(
            spark.createDataFrame(rows, "seq bigint, us bigint"), spark.createDataFrame(versions, "us bigint, allow double"), local_rows=local_rows
        )
        got = {r["seq"]: r["allow"] for r in out.collect()}
    finally:
        spark.conf.unset("tallyguard.rowsPerChunk")
    known = sorted({us: max((a for u, a in versions if u == us and a is not None), default=None) for us, _ in versions if us is not None}.items())
    assert len(got) == len(rows)
    for seq, us in rows:
        before = [a for u, a in known if us is not None and u <= us]
        assert got[seq] == (before[-1] if before else None)


def test_feedback_reads_what_was_known(spark):
    """Rows before the publication are cold, rows after it carry it; compaction changes no later read."""
    edges = [(f"s{i}", "hub", 1.0, at(10 + i), i) for i in range(8)]
    edges += [("hub", f"t{i}", 1.0, at(30 + i), 20 + i) for i in range(4)] + [("hub", "late", 1.0, at(90), 40)]
    df = spark.createDataFrame(edges, "src string, dst string, amount double, us bigint, seq bigint")
    log, small = scratch_path(spark, "log"), scratch_path(spark, "compacted")
    first, second = publish_window(df, at(20), log), publish_window(df, at(50), log)
    got = {r["seq"]: r for r in with_feedback(df, read_log(spark, log), "src", 1_000).collect()}
    assert first == 21 and got[20]["graph_reason"] == "fan_in(n=8,sev=0.80)" and got[0]["graph_delta"] == 0.0
    assert got[40]["graph_reason"].startswith("fan_in") and "fan_out" in got[40]["graph_reason"]
    assert got[40]["graph_delta"] > got[20]["graph_delta"] > 0
    compact(spark, log, second, small)
    assert spark.read.parquet(small).count() < spark.read.parquet(log).count()
    again = {r["seq"]: r for r in with_feedback(df, read_log(spark, small), "src", 1_000).where(F.col("us") >= at(second)).collect()}
    assert again == {k: r for k, r in got.items() if r["us"] >= at(second)}


@pytest.mark.parametrize("listed", [100_000, 1])
def test_order_statistics(spark, listed):
    """Exact with heavy ties, few rows and skewed values, listed and by histograms."""
    drawn = random.Random(1)
    makes = [lambda: drawn.randrange(10**15), lambda: drawn.randrange(5), lambda: int(drawn.paretovariate(0.3)) % 10**12, lambda: 7]
    for n in (1, 2, 501, 30_000):
        for make in makes:
            xs = sorted(make() for _ in range(n))
            df = spark.createDataFrame([(x,) for x in [*xs, None]], "x bigint")
            ranks = sorted({0, n // 3, n // 2, n * 4 // 5, n - 1})
            want = {r: (xs[r], bisect.bisect_left(xs, xs[r])) for r in ranks}
            assert order_statistics(df, "x", ranks, listed=listed) == want
    assert linear_quantiles(df.limit(0), "x", [0.5]) == {}
    with pytest.raises(ValueError):
        order_statistics(df, "x", [50_000])
