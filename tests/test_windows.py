"""Trailing and running operators against brute force, with and without dense keys."""

import pytest

from model import moments, prior, tie_heavy_rows
from tallyguard.operators.running import (
    first_seen,
    neighbour_times,
    prior_count,
    prior_moments,
    running_amounts,
)
from tallyguard.operators.trailing import trailing_distinct, trailing_windows

ROWS = tie_heavy_rows(160, 7)
SCHEMA = "seq bigint, us bigint, snd string, rcv string, amount double"


@pytest.fixture(params=["sparse", "dense"])
def frame(request, spark):
    if request.param == "dense":
        request.getfixturevalue("dense")
    return spark.createDataFrame([tuple(r.values()) for r in ROWS], SCHEMA)


def by_seq(df):
    rows = df.collect()
    assert len(rows) == len(ROWS)
    return {r["seq"]: r for r in rows}


@pytest.mark.parametrize("ties", ["strict", "row"])
def test_counts_and_moments(frame, ties):
    out = by_seq(
        trailing_windows(frame, ["snd"], {"c50": 50, "c200": 200}, "amount", {"m": 120}, ties)
    )
    for row in ROWS:
        got = out[row["seq"]]
        assert got["c50"] == len(prior(ROWS, row, "snd", 50, ties))
        assert got["c200"] == len(prior(ROWS, row, "snd", 200, ties))
        n, mean, m2 = moments([r["amount"] for r in prior(ROWS, row, "snd", 120, ties)])
        assert got["m_n"] == n
        if n:
            assert got["m_mean"] == pytest.approx(mean, abs=1e-9)
            assert got["m_m2"] == pytest.approx(m2, abs=1e-5)


@pytest.mark.parametrize("ties,through", [("strict", False), ("row", False), ("row", True)])
def test_distinct(frame, ties, through):
    out = by_seq(trailing_distinct(frame, ["rcv"], "snd", {"d50": 50, "d300": 300}, ties, through))
    for row in ROWS:
        for name, w in (("d50", 50), ("d300", 300)):
            seen = {r["snd"] for r in prior(ROWS, row, "rcv", w, ties)}
            if through:
                seen.add(row["snd"])
            assert out[row["seq"]][name] == len(seen)


def test_first_seen_and_prior_count(frame):
    out = by_seq(prior_count(first_seen(frame, ["snd"], "first"), ["snd"], "n"))
    for row in ROWS:
        before = [
            r for r in ROWS
            if r["snd"] == row["snd"] and (r["us"], r["seq"]) < (row["us"], row["seq"])
        ]
        assert out[row["seq"]]["n"] == len(before)
        assert out[row["seq"]]["first"] == int(not before)


def test_neighbours(frame):
    out = by_seq(neighbour_times(frame, ["rcv", "snd"]))
    for row in ROWS:
        same = sorted(
            (r["us"], r["seq"]) for r in ROWS if (r["rcv"], r["snd"]) == (row["rcv"], row["snd"])
        )
        at = same.index((row["us"], row["seq"]))
        assert out[row["seq"]]["prev_us"] == (same[at - 1][0] if at else None)
        assert out[row["seq"]]["next_us"] == (same[at + 1][0] if at + 1 < len(same) else None)


@pytest.mark.parametrize("through", [False, True])
def test_prior_moments(frame, through):
    out = by_seq(prior_moments(frame, ["snd"], "amount", through=through))
    for row in ROWS:
        me = (row["us"], row["seq"])
        values = [
            r["amount"] for r in ROWS
            if r["snd"] == row["snd"]
            and ((r["us"], r["seq"]) < me or (through and r["seq"] == row["seq"]))
        ]
        n, mean, m2 = moments(values)
        got = out[row["seq"]]
        assert got["prior_n"] == n
        if n:
            assert got["prior_mean"] == pytest.approx(mean, abs=1e-9)
            assert got["prior_m2"] == pytest.approx(m2, abs=1e-5)


def test_running_amounts(frame):
    out = by_seq(running_amounts(frame, "amount"))
    ordered = sorted(ROWS, key=lambda r: (r["us"], r["seq"]))
    for i, row in enumerate(ordered):
        n, mean, m2 = moments([r["amount"] for r in ordered[: i + 1]])
        got = out[row["seq"]]
        assert got["running_n"] == n
        assert got["running_mean"] == pytest.approx(mean)
        assert got["running_std"] == pytest.approx((m2 / (n - 1)) ** 0.5 if n > 1 else 1e-9)


@pytest.mark.parametrize("ties", ["strict", "row"])
def test_equal_amounts_after_a_busy_spell(spark, ties):
    """Nothing of a varied past is left in a window of equal amounts, whatever the budget."""
    day = 86_400_000_000
    rows = [(i, i * 20_000_000, "k", "r", 1.0 + (i * 7919 % 100_003) / 3.0) for i in range(3_000)]
    rows += [(3_000 + i, 40 * day + i * 60_000_000, "k", "r", 500.37) for i in range(6)]
    rows += [(4_000 + i, 50 * day, "k", "r", 20.1) for i in range(9)]
    df = spark.createDataFrame(rows, SCHEMA)
    seen = []
    for budget in (None, "5", "100"):
        for name in ("tallyguard.rowsPerChunk", "tallyguard.slidingRows"):
            spark.conf.set(name, budget) if budget else spark.conf.unset(name)
        out = trailing_windows(df, ["snd"], {"c": day}, "amount", {"d": day}, ties)
        seen.append({r["seq"]: (r["c"], r["d_n"], r["d_mean"], r["d_m2"]) for r in out.collect()})
    for name in ("tallyguard.rowsPerChunk", "tallyguard.slidingRows"):
        spark.conf.unset(name)
    for seq, (c, n, mean, m2) in seen[0].items():
        for other in seen[1:]:
            assert other[seq][:2] == (c, n)
            assert (other[seq][2], other[seq][3]) == pytest.approx((mean, m2), rel=1e-12) if n else other[seq][2:] == (None, None)
    for i in range(1, 6):
        assert all(s[3_000 + i][1:] == (i, 500.37, 0.0) for s in seen)
    assert all(s[4_008][1:] == ((8, 20.1, 0.0) if ties == "row" else (0, None, None)) for s in seen)


def test_tied_rows_golden(spark):
    """Window 600: two tied groups and a row just outside the first."""
    rows = [(0, 0, "A"), (1, 0, "B"), (2, 0, "A"), (3, 600, "C"), (4, 601, "C")]
    df = spark.createDataFrame([(s, t, x, "R") for s, t, x in rows], "seq bigint, us bigint, snd string, rcv string")

    def column(out, name):
        return [r[name] for r in out.orderBy("seq").collect()]

    assert column(trailing_windows(df, ["rcv"], {"c": 600}), "c") == [0, 0, 0, 3, 1]
    assert column(trailing_distinct(df, ["rcv"], "snd", {"d": 600}), "d") == [0, 1, 2, 2, 1]
    assert column(trailing_distinct(df, ["rcv"], "snd", {"d": 600}, "strict"), "d") == [0, 0, 0, 2, 1]


def test_features_do_not_look_ahead(spark):
    """Removing later rows leaves the features of earlier rows unchanged."""
    df = spark.createDataFrame([tuple(r.values()) for r in ROWS], SCHEMA)

    def features(rows):
        out = trailing_windows(rows, ["snd"], {"c": 100}, "amount", {"m": 100}, "row")
        out = trailing_distinct(out, ["rcv"], "snd", {"d": 100})
        return {r["seq"]: tuple(r) for r in out.collect()}

    full, early = features(df), features(df.where("us < 300"))
    assert early and all(full[k] == v for k, v in early.items())


def test_rows_with_missing_keys_stay(spark, dense):
    rows = [(i, i * 10, None if i % 3 == 0 else "a", "r", 1.0) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = trailing_windows(df, ["snd"], {"c": 1000})
    got = {r["seq"]: r["c"] for r in out.collect()}
    assert len(got) == 40
    assert got[39] == 13 and got[38] == 25
