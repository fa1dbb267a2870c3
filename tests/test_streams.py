"""State processors: late rows, idle history, restarts; outputs of foreachBatch jobs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF
from model import prior, tie_heavy_rows
from tallyguard.catalog.base import tx
from tallyguard.operators.forest import fit_forest
from tallyguard.operators.training import Candidate, fit_supervised
from tallyguard.plans.compile import compile_features
from tallyguard.plans.manifest import build_manifest
from tallyguard.plans.scorer import Scorer, read_scorer, score_job, score_table, write_scorer
from tallyguard.schema import DAY, HOUR, MINUTE
from tallyguard.session import scratch_path
from tallyguard.streaming.jobs import (
    graph_window_job,
    rate_limit_stream,
    read_replay,
    risk_cache_stream,
    run_to_table,
    stateful_features,
    write_replay,
)
from tallyguard.streaming.panes import _ROW, PANE, PaneHistory, distinct_since
from tallyguard.streaming.state import RateWindow, RiskCache, anchored_window, counts_since

DAY_S = 86_400
START_S = 1_700_000_000  # a stream's first watermark is the epoch, and earlier rows are late


def test_array_helpers_equal_brute_force():
    rows = sorted(tie_heavy_rows(80, 3), key=lambda r: (r["us"], r["seq"]))
    for i, r in enumerate(rows):
        r["seq"], r["rcv"] = i, "one"
    times = np.array([r["us"] for r in rows])
    items = np.array([r["snd"] for r in rows], dtype=object)
    for start in (0, 30):
        counts, distinct = counts_since(times, start, 50), distinct_since(times, items, start, 50)
        for r, c, d in zip(rows[start:], counts, distinct):
            before = prior(rows, r, "rcv", 50, "row")
            if start == 0:
                assert d == len({b["snd"] for b in before})
            assert c == len(before)


def test_idle_keys_are_evicted_but_stay_seen(spark):
    """A gap of several days empties the history; the first-seen flag survives."""
    rows = [(0, 0, "a"), (1, 60, "a"), (2, 5 * DAY_S, "b"), (3, 6 * DAY_S, "a"), (4, 6 * DAY_S + 30, "a")]
    df = spark.createDataFrame(
        [(s, (START_S + t) * 1_000_000, x, "r", 10.0) for s, t, x in rows],
        "seq bigint, us bigint, sender_id string, receiver_id string, amount double",
    ).withColumn("ts", F.timestamp_micros("us"))
    path = scratch_path(spark, "idle")
    write_replay(df, path, 5, 1)
    out = run_to_table(stateful_features(read_replay(spark, path, df.schema, 1), 0.0, 1.0), "idle")
    got = {r["seq"]: r for r in out.collect()}
    assert [got[i]["device_txn_count_24h"] for i in range(5)] == [0, 1, 0, 0, 1]
    assert [got[i]["is_new_device"] for i in range(5)] == [1, 0, 1, 0, 0]
    assert [got[i]["receiver_unique_senders_1h"] for i in range(5)] == [0, 1, 0, 0, 1]


def test_graph_window_keeps_newest_edges(spark):
    edges = [(f"s{i}", "hub", i, i) for i in range(12)]
    df = spark.createDataFrame(edges, "src string, dst string, us bigint, seq bigint")
    path, out = scratch_path(spark, "edges"), scratch_path(spark, "risk")
    write_replay(df, path, 3, 1)
    graph_window_job(read_replay(spark, path, df.schema, 1), out, 6)
    last = spark.read.parquet(out).where("batch = 2").collect()
    assert [(r["vpa_hash"], r["reason"]) for r in last] == [("hub", "fan_in(n=6,sev=0.40)")]


def random_arrivals(n=260, seed=4):
    """Rows of one key in a random order of arrival, with ties and missing amounts."""
    drawn = random.Random(seed)
    rows = [
        (drawn.randrange(0, 30 * HOUR, 7 * MINUTE) if drawn.random() < 0.5 else drawn.randrange(0, 30 * HOUR),
         i, drawn.choice([5.0, 20.1, 20.1, 20.1, 33.5, float("nan")]), drawn.choice("abcd"))
        for i in range(n)
    ]
    drawn.shuffle(rows)
    return rows


def test_rows_are_put_in_their_place():
    """Whatever the order of arrival, a row counts the earlier rows that have arrived."""
    past, arrived = PaneHistory(lambda p: (np.empty(0, _ROW), []), None), []
    for us, seq, value, item in random_arrivals():
        place = past.add(us // PANE, np.array([(us, seq, value)], _ROW), [item])
        for window in (10 * MINUTE, HOUR, DAY):
            before = [r for r in arrived if us - window <= r[0] and (r[0], r[1]) < (us, seq)]
            assert past.counts(us // PANE, place, window)[0] == len(before)
            if window < DAY:
                assert past.distinct(us // PANE, place, window)[0] == len({r[3] for r in before})
            values = [r[2] for r in before if not np.isnan(r[2])]
            n, mean, m2 = (x[0] for x in past.moments(us // PANE, place, window)[:3])
            assert n == len(values)
            if values:
                assert mean == pytest.approx(np.mean(values)) and m2 == pytest.approx(np.var(values) * n, abs=1e-9)
                assert len(set(values)) > 1 or (mean, m2) == (values[0], 0.0)
        arrived.append((us, seq, value, item))


def test_late_row_counts_one():
    """Times 100, 700 and then a late 650 s: only the first lies before it."""
    past = PaneHistory(lambda p: (np.empty(0, _ROW), []), None)
    found = []
    for seq, s in enumerate((100, 700, 650)):
        place = past.add(s * 1_000_000 // PANE, np.array([(s * 1_000_000, seq, 1.0)], _ROW), [])
        found.append(int(past.counts(s * 1_000_000 // PANE, place, 10 * MINUTE)[0]))
    assert found == [0, 1, 1]


def test_anchored_window_equals_steps():
    drawn = random.Random(3)
    for most, window in ((1, 5), (3, 10), (2, 1)):
        seconds = np.sort(np.array([drawn.randrange(60) for _ in range(80)]))
        used, start, want = 0, int(seconds[0]), []
        for now in seconds.tolist():
            if now - start >= window:
                used, start = 0, now
            ok = used < most
            used += ok
            want.append((ok, 0 if ok else max(0, window - (now - start))))
        cut, got, state = 33, [], (0, int(seconds[0]))
        for part in (seconds[:cut], seconds[cut:]):
            allowed, wait, *state = anchored_window(part, *state, most, window)
            got += list(zip(allowed.tolist(), wait.tolist()))
        assert got == want and tuple(state) == (used, start)


class _Handle:
    """State of one key in memory, with the trips to it counted."""

    def __init__(self):
        self.value, self.timers, self.trips = None, set(), 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.trips += 1
        return self.value

    def update(self, value):
        self.trips, self.value = self.trips + 1, value

    def clear(self):
        self.trips, self.value = self.trips + 1, None

    def registerTimer(self, at_ms):
        self.trips += 1
        self.timers.add(at_ms)

    def getCurrentWatermarkInMs(self):
        return self.now

    def fire(self, processor, now_ms):
        self.now = now_ms
        for at in sorted(t for t in self.timers if t <= now_ms):
            list(processor.handleExpiredTimer(None, self, None))
            self.timers.discard(at)


def test_a_cached_delta_takes_few_trips_to_the_state():
    """Rows of a key in parts, as plain rows, equal steps over all; a newer write keeps the timer."""
    columns, ttl = ["k", "us", "seq", "kind", "risk_delta", "reason"], 10
    drawn = random.Random(6)
    rows = []
    for seq in range(300):
        write = drawn.random() < 0.2
        rows.append(("a", drawn.randrange(900) * 1_000_000, seq, 0 if write else 1, drawn.random() if write else None, "w" if write else None))
    rows.sort(key=lambda r: (r[1], r[3], r[2]))
    want, last = [], None
    for k, us, seq, kind, delta, reason in rows:
        if kind == 0:
            last = (us // 1_000_000, delta, reason)
        elif last is None or us // 1_000_000 - last[0] > ttl:
            late = last is not None and us // 1_000_000 - last[0] <= 2 * ttl
            want.append((k, us, seq, 0.0, "cold", "expired" if late else "miss"))
            last = None
        else:
            want.append((k, us, seq, last[1], last[2], "hit"))
    processor, handle, got = RiskCache(columns, columns[:3], ttl, True), _Handle(), []
    processor.init(handle)
    for at in range(0, len(rows), 10):
        part, before = rows[at : at + 10], handle.trips
        got += [tuple(r) for r in processor.handleInputRows(("a",), iter(drawn.sample(part, len(part))), handle)]
        assert handle.trips - before <= 3  # it took nine
        assert handle.value is None or handle.timers  # an entry is always removed at last
        handle.fire(processor, part[-1][1] // 1000)
    assert got == want and {r[-1] for r in got} == {"hit", "miss", "expired"}
    handle.fire(processor, 10_000_000)
    assert handle.value is None and not handle.timers


def test_a_rate_window_takes_few_trips_to_the_state():
    processor, handle = RateWindow(["us", "seq"], 2, 60, True), _Handle()
    processor.init(handle)
    got = []
    for part in ([0, 20, 10], [30], [61, 62]):
        before = handle.trips
        got += list(processor.handleInputRows(("a",), iter([(s * 1_000_000, s) for s in part]), handle))
        assert handle.trips - before <= 3
    assert [(r["seq"], r["allowed"], r["retry_after_s"]) for r in got] == [
        (0, True, 0), (10, True, 0), (20, False, 40), (30, False, 30), (61, True, 0), (62, True, 0)
    ]
    assert handle.timers == {60_000}
    handle.fire(processor, 70_000)
    assert handle.timers == {121_000} and handle.value == (2, 61)
    handle.fire(processor, 121_000)
    assert handle.value is None and not handle.timers


STREAM = "seq bigint, us bigint, sender_id string, receiver_id string, amount double"


def _replay(spark, rows, slices, label):
    df = spark.createDataFrame(rows, STREAM).withColumn("ts", F.timestamp_micros("us"))
    path = scratch_path(spark, label)
    write_replay(df, path, slices, 1)
    return path, df.schema


def test_state_is_empty_after_idle_time(spark):
    """Rate windows and cached deltas of idle keys are removed once the watermark has passed them."""
    rows = [(i, (START_S + i) * 1_000_000, f"k{i}", "r", 1.0) for i in range(20)]
    rows += [(99, (START_S + 9 * DAY_S) * 1_000_000, "late", "r", 1.0)]
    path, schema = _replay(spark, rows, 3, "idle-entries")
    for label, job in (
        ("rate", lambda s: rate_limit_stream(s, "sender_id", 2, 3_600, "ts")),
        ("cache", lambda s: risk_cache_stream(
            s.where("seq < 0"), s.withColumn("risk_delta", F.lit(0.5)).withColumn("reason", F.lit("x")), "sender_id", 600, "ts")),
    ):
        folder = scratch_path(spark, label)
        run_to_table(job(read_replay(spark, path, schema, 1)), label, folder=folder)
        left = spark.read.format("statestore").option("stateVarName", "entry").load(f"{folder}/checkpoint")
        assert [r["key"]["sender_id"] for r in left.select("key").collect()] == ["late"]


def test_features_go_on_after_a_restart(spark):
    """Half of the files, then the rest with the same folder, equals one run over all."""
    drawn = random.Random(7)
    rows = [(i, (START_S + i * 211) * 1_000_000, drawn.choice("ab"), drawn.choice("rs"), drawn.random()) for i in range(60)]
    df = spark.createDataFrame(rows, STREAM).withColumn("ts", F.timestamp_micros("us"))
    folder, path = scratch_path(spark, "resumed"), scratch_path(spark, "resumed-input")
    for part in (df.where("seq < 30"), df.where("seq >= 30")):
        write_replay(part, path, 2, 1)
        out = run_to_table(stateful_features(read_replay(spark, path, df.schema, 1), 0.5, 0.2), "resumed", folder=folder)
    whole_path, schema = _replay(spark, rows, 4, "whole")
    whole = run_to_table(stateful_features(read_replay(spark, whole_path, schema, 1), 0.5, 0.2), "whole")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, whole.collect()))
    assert out.count() == 60


def test_graph_window_goes_on_after_a_restart(spark):
    edges = [(f"s{i}", "hub", i, i) for i in range(12)]
    df = spark.createDataFrame(edges, "src string, dst string, us bigint, seq bigint")
    path, out, folder = (scratch_path(spark, x) for x in ("edges", "risk", "windows"))
    for part in (df.where("seq < 6"), df.where("seq >= 6")):
        write_replay(part, path, 2, 1)
        graph_window_job(read_replay(spark, path, df.schema, 1), out, 6, folder)
    last = spark.read.parquet(out).where("batch = 3").collect()
    assert [(r["vpa_hash"], r["reason"]) for r in last] == [("hub", "fan_in(n=6,sev=0.40)")]


def test_scores_go_on_after_a_restart(spark):
    """The scored stream stopped half-way and started again equals the table scored at once."""
    rows = tx(spark, SF).where("seq < 200")
    train = compile_features(rows, corridor_rate=0.2)
    train = train.withColumn("fraud_flag", (F.col("amount") > 100).cast("int"))
    model = fit_supervised(train, Candidate(3, 3, 0.3))
    path = scratch_path(spark, "scorer")
    write_scorer(Scorer(build_manifest(rows, corridor_rate=0.2), model, fit_forest(train, trees=10)), path)
    scorer = read_scorer(spark, path)
    cut = rows.select(F.percentile_approx("us", 0.5)).first()[0]
    folder, files = scratch_path(spark, "scored"), scratch_path(spark, "scored-input")
    for part in (rows.where(F.col("us") < cut), rows.where(F.col("us") >= cut)):
        write_replay(part, files, 2, 1)
        out = score_job(read_replay(spark, files, rows.schema, 1), scorer, folder)
    got = {r["seq"]: (r["risk_score"], r["verdict"]) for r in out.collect()}
    want = {r["seq"]: (r["risk_score"], r["verdict"]) for r in score_table(rows, scorer).collect()}
    assert len(got) == out.count() == 200
    assert all(got[k][0] == pytest.approx(want[k][0], abs=1e-6) and got[k][1] == want[k][1] for k in want)


def test_a_group_of_keys_is_worked_on_at_once():
    """Rows of many keys in one history, written to the state after every part and read back, equal brute force."""
    drawn, stored, sums, arrived = random.Random(5), {}, None, []
    times = sorted(drawn.choice([drawn.randrange(0, 40 * HOUR), drawn.randrange(0, 40 * HOUR, 30 * MINUTE)]) for _ in range(600))
    rows = [(us + drawn.choice([0, 0, -5 * MINUTE]), drawn.randrange(500), drawn.choice([5.0, 20.1, 20.1, float("nan")]),
             drawn.choice(["a", "b", None]), drawn.randrange(7)) for us in times]
    for at in range(0, len(rows), 50):
        part = sorted(rows[at : at + 50], key=lambda r: (r[0], r[1]))
        past = PaneHistory(stored.__getitem__, sums)
        panes = np.array([r[0] // PANE for r in part])
        past.open(panes, [10 * MINUTE, HOUR, DAY], HOUR)
        place = past.add(panes, np.array([r[:3] for r in part], _ROW), [r[3] for r in part], np.array([r[4] for r in part]))
        arrived += part
        got = {w: past.counts(panes, place, w) for w in (10 * MINUTE, HOUR, DAY)}
        items = {w: past.distinct(panes, place, w) for w in (10 * MINUTE, HOUR)}
        n, mean, m2 = past.moments(panes, place, DAY)[:3]
        for i, r in enumerate(part):
            for w in got:
                before = [b for b in arrived if b[4] == r[4] and r[0] - w <= b[0] and (b[:2] < r[:2])]
                twins = [b for b in arrived if b[4] == r[4] and b[:2] == r[:2]]
                if len(twins) > 1:
                    continue  # equal rows are counted in the order of their arrival
                assert got[w][i] == len(before)
                if w in items:
                    assert items[w][i] == len({b[3] for b in before})
                else:
                    values = [b[2] for b in before if not np.isnan(b[2])]
                    assert n[i] == len(values)
                    if values:
                        assert mean[i] == pytest.approx(np.mean(values)) and m2[i] == pytest.approx(np.var(values) * n[i], abs=1e-9)
        for p, kept, things, keys in past.written(-10):
            stored[p] = (kept, things, keys)
        sums = past.sums
    assert 0 < len(stored) < 300 and int(sums["n"].sum()) == 600
