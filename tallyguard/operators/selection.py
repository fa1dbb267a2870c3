"""Exact order statistics from sketched brackets.

One aggregation sketches the column (a mergeable quantile summary with a fixed rank error)
and gives a narrow bracket around every rank asked for. A second one counts what lies
below each bracket and the distinct values inside, which settles the ranks exactly, ties
included. Brackets too wide to list are narrowed by histograms first. Values are never
sorted or gathered beyond ``LISTED`` distinct ones.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LISTED = 100_000  # distinct values inside brackets that may be listed
_ACCURACY = 10_000  # the sketch's ranks are off by a share of 1 / _ACCURACY at most
_CELLS = 1024
_BESIDE = 5  # rows by which a rank may miss its share


def order_statistics(
    df: DataFrame,
    column: str,
    ranks: list[int] | Callable[[int], list[int]],
    near: list[float] | None = None,
    listed: int = LISTED,
) -> dict[int, tuple]:
    """{rank: (value, number of smaller values)} for 0-based ranks of non-null values.

    ``ranks`` may be a function of the number of values; ``near`` then has the shares of
    the rows below them (within a row), so that no count is needed first.
    """
    values = df.select(F.col(column).alias("x")).where("x is not null")
    if near is None:
        size = values.count()
        near = [r / max(size, 1) for r in (ranks(size) if callable(ranks) else ranks)]
    margin = 2.5 / _ACCURACY
    ends = sorted({min(1.0, max(0.0, p + m)) for p in near for m in (-margin, margin)})
    if not ends:
        return {}
    first = values.agg(
        F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("x").alias("n"),
        F.percentile_approx("x", ends, _ACCURACY).alias("q"),
    ).first()
    n = first["n"]
    asked = sorted(set(ranks(n) if callable(ranks) else ranks))
    if any(r < 0 or r >= n for r in asked):
        raise ValueError(f"ranks {asked} outside 0..{n - 1}")
    if not asked:
        return {}
    at = dict(zip(ends, first["q"]))
    spans = []
    for p in near:
        low, high = max(0.0, p - margin), min(1.0, p + margin)
        slack = 2 / max(n, 1)  # a rank may lie a row beside its share
        spans.append((first["lo"] if low <= slack else at[low], first["hi"] if high >= 1 - slack else at[high]))
    spans, inside = _disjoint(spans), n * len(spans) * 4 * margin
    if n * margin < _BESIDE:  # a bracket would be narrower than the rows beside a share
        spans, inside = [(first["lo"], first["hi"])], n
    if inside > listed:
        return _by_histograms(values, asked, _with_below(values, spans, asked))
    return _by_listing(values, asked, spans)


def _disjoint(spans: list[tuple]) -> list[tuple]:
    out: list[tuple] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def _segment(spans: list[tuple]):
    """2 i for values below span i and above the one before, 2 i + 1 inside it."""
    out = F.when(F.lit(False), -1)
    for i, (lo, hi) in enumerate(spans):
        out = out.when(F.col("x") < F.lit(lo), 2 * i).when(F.col("x") <= F.lit(hi), 2 * i + 1)
    return out.otherwise(2 * len(spans))


def _by_listing(values: DataFrame, ranks: list[int], spans: list[tuple]) -> dict[int, tuple]:
    """Ranks from the distinct values inside the spans and the counts between them."""
    part = values.select(_segment(spans).alias("s"), "x").select("s", F.when(F.col("s") % 2 == 1, F.col("x")).alias("x"))
    rows = sorted(
        ((r["s"], r["x"], r["n"]) for r in part.groupBy("s", "x").agg(F.count(F.lit(1)).alias("n")).collect()),
        key=lambda r: (r[0], r[1] is not None, r[1]),
    )
    starts, below = [], 0
    for _, _, n in rows:
        starts.append(below)
        below += n
    found = {}
    for rank in ranks:
        k = bisect_right(starts, rank) - 1
        if rows[k][1] is None:
            raise ArithmeticError(f"rank {rank} lies outside its bracket")
        found[rank] = (rows[k][1], starts[k])
    return found


def _with_below(values: DataFrame, spans: list[tuple], ranks: list[int]) -> dict[tuple, list[int]]:
    """{(lo, hi, number of smaller values): ranks inside} of the spans."""
    counted = values.groupBy(_segment(spans).alias("s")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    rows, below, out = sorted(counted.collect(), key=lambda r: r["s"]), 0, {}
    for r in rows:
        inside = [k for k in ranks if below <= k < below + r["n"]]
        if inside:
            out[r["lo"], r["hi"], below] = inside
        below += r["n"]
    return out


def _by_histograms(values: DataFrame, ranks: list[int], brackets: dict[tuple, list[int]]) -> dict[int, tuple]:
    """Ranks by repeated histograms of ``_CELLS`` cells per open bracket."""
    found: dict[int, tuple] = {}
    while brackets:
        for lo, hi, below in [b for b in brackets if b[0] == b[1]]:
            for rank in brackets.pop((lo, hi, below)):
                found[rank] = (lo, below)
        if not brackets:
            break
        opened = list(brackets)
        tests = [F.col("x").between(F.lit(lo), F.lit(hi)) for lo, hi, _ in opened]
        which = reduce(
            lambda acc, i: acc.when(tests[i], i), range(1, len(opened)), F.when(tests[0], 0)
        )
        cell = reduce(
            lambda acc, i: acc.when(tests[i], _cell(*opened[i][:2])),
            range(1, len(opened)),
            F.when(tests[0], _cell(*opened[0][:2])),
        )
        counted = (
            values.select("x", which.alias("b"), cell.alias("cell"))
            .where("b is not null")
            .groupBy("b", "cell")
            .agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
            .collect()
        )
        brackets = _narrow(sorted(counted, key=lambda r: (r["b"], r["cell"])), opened, brackets)
    return found


def _cell(lo, hi):
    share = (F.col("x") - F.lit(lo)).cast("double") / F.lit(float(hi - lo))
    return F.floor(share * _CELLS)


def _narrow(counted, opened, brackets) -> dict:
    narrowed: dict[tuple, list[int]] = {}
    below = [b[2] for b in opened]
    for row in counted:
        start = below[row["b"]]
        inside = [r for r in brackets[opened[row["b"]]] if start <= r < start + row["n"]]
        if inside:
            narrowed.setdefault((row["lo"], row["hi"], start), []).extend(inside)
        below[row["b"]] = start + row["n"]
    return narrowed


def linear_quantiles(df: DataFrame, column: str, fractions: list[float]) -> dict[float, float]:
    """Exact quantiles with linear interpolation between neighbouring values."""
    total = 0

    def ranks(n: int) -> list[int]:
        nonlocal total
        total = n
        spots = [int((n - 1) * q) for q in fractions] if n else []
        return sorted({r for p in spots for r in (p, min(p + 1, n - 1))})

    stats = order_statistics(df, column, ranks, near=fractions)
    if not total:
        return {}
    out = {}
    for q in fractions:
        p = (total - 1) * q
        low, high = stats[int(p)][0], stats[min(int(p) + 1, total - 1)][0]
        out[q] = low + (high - low) * (p - int(p))
    return out
