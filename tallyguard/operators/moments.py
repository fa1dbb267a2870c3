"""Mergeable moments: count, mean, squared deviations, least and largest value.

Two sets' moments are merged without subtracting anything large, so a window's spread is
exact to rounding whatever came before it. A fixed window of width ``w`` is the end of
one block of width ``w`` and the start of the next: moments run forwards and backwards
within blocks, and the two parts are merged. Blocks are cut into panes of bounded size,
whose totals are merged into the rows of the other panes of the block.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIELDS = ("n", "mean", "m2", "lo", "hi")
_TYPES = "n bigint, mean double, m2 double, lo double, hi double"
NONE = "named_struct('n', 0L, 'mean', 0D, 'm2', 0D, 'lo', CAST(NULL AS DOUBLE), 'hi', CAST(NULL AS DOUBLE))"


# --- columns ----------------------------------------------------------------------
def merged(a: Column, b: Column) -> Column:
    """Moments of two disjoint sets together, as a struct."""
    m, n = a["n"], b["n"]
    gap, total = b["mean"] - a["mean"], F.greatest(m + n, F.lit(1)).cast("double")
    lo, hi = F.least(a["lo"], b["lo"]), F.greatest(a["hi"], b["hi"])
    flat = lo == hi  # equal values have their value as mean, free of rounding
    mean = F.when(n == 0, a["mean"]).when(m == 0, b["mean"]).when(flat, lo).otherwise(a["mean"] + gap * (n / total))
    m2 = F.when(n == 0, a["m2"]).when(m == 0, b["m2"]).when(flat, F.lit(0.0)).otherwise(
        a["m2"] + b["m2"] + gap * gap * (m * (n / total))
    )
    return F.struct((m + n).alias("n"), mean.alias("mean"), m2.alias("m2"), lo.alias("lo"), hi.alias("hi"))


def folded(parts: Column) -> Column:
    """Moments of an array of moments."""
    return F.aggregate(parts, F.expr(NONE), merged)


def summarised(value: str, over=None) -> Column:
    """Moments of a column as a struct, over a group or a window; nulls do not count."""
    at = (lambda c: c.over(over)) if over is not None else (lambda c: c)
    n, lo, hi = at(F.count(value)), at(F.min(value)).cast("double"), at(F.max(value)).cast("double")
    flat = (n == 0) | (lo == hi)
    mean = F.when(flat, F.coalesce(lo, F.lit(0.0))).otherwise(at(F.avg(value)))
    m2 = F.when(flat, F.lit(0.0)).otherwise(at(F.var_pop(value)) * n)
    return F.struct(n.alias("n"), mean.alias("mean"), m2.alias("m2"), lo.alias("lo"), hi.alias("hi"))


def spelled(moments: str, name: str) -> list[Column]:
    """``name_n``, ``name_mean`` (null where empty) and ``name_m2`` (likewise) of a moments column."""
    n = F.col(f"{moments}.n")
    return [
        n.alias(f"{name}_n"),
        F.when(n > 0, F.col(f"{moments}.mean")).alias(f"{name}_mean"),
        F.when(n > 0, F.col(f"{moments}.m2")).alias(f"{name}_m2"),
    ]


# --- scans within one pane --------------------------------------------------------
def merge_arrays(a: tuple, b: tuple) -> tuple:
    """Elementwise ``merged`` of (n, mean, m2, lo, hi) arrays; empty sets have lo inf, hi -inf."""
    n = a[0] + b[0]
    total = np.maximum(n, 1)
    gap = np.where((a[0] > 0) & (b[0] > 0), b[1] - a[1], 0.0)
    lo, hi = np.minimum(a[3], b[3]), np.maximum(a[4], b[4])
    flat = lo == hi
    mean = np.where(b[0] == 0, a[1], np.where(a[0] == 0, b[1], a[1] + gap * (b[0] / total)))
    m2 = a[2] + b[2] + gap * gap * (a[0] * (b[0] / total))
    return n, np.where(flat, lo, mean), np.where(flat, 0.0, m2), lo, hi


def running(parts: tuple, block: np.ndarray | None = None) -> tuple:
    """Moments of the first, the first two, ... sets; pairs at doubling distance are merged.

    With ``block`` (numbers of sets that lie side by side) they start anew in every block.
    """
    out, step = parts, 1
    longest = len(out[0]) if block is None else _longest(block)
    while step < longest:
        later = merge_arrays(tuple(x[:-step] for x in out), tuple(x[step:] for x in out))
        if block is not None:
            same = block[:-step] == block[step:]
            later = tuple(np.where(same, y, x[step:]) for x, y in zip(out, later))
        out = tuple(np.concatenate([x[:step], y]) for x, y in zip(out, later))
        step *= 2
    return out


def _longest(block: np.ndarray) -> int:
    if not len(block):
        return 0
    ends = np.flatnonzero(np.append(block[1:] != block[:-1], True))
    return int(np.diff(ends, prepend=-1).max())


def empty_first(parts: tuple) -> tuple:
    """``parts`` with the moments of nothing in front."""
    nothing = (0, 0.0, 0.0, np.inf, -np.inf)
    return tuple(np.concatenate([np.array([e], x.dtype), x]) for e, x in zip(nothing, parts))


def _from_table(table: pa.Table) -> tuple:
    n, mean, m2, lo, hi = (table.column(c).to_numpy() for c in FIELDS)
    lo, hi = np.where(n > 0, lo, np.inf), np.where(n > 0, hi, -np.inf)
    return n.astype(np.int64), np.where(n > 0, mean, 0.0), np.where(n > 0, m2, 0.0), lo, hi


def _to_arrays(parts: tuple) -> list[pa.Array]:
    none = parts[0] == 0
    out = [pa.array(parts[0], pa.int64()), pa.array(parts[1]), pa.array(parts[2])]
    return out + [pa.array(x, pa.float64(), mask=none) for x in parts[3:]]


def _nullable(kind: pa.DataType) -> pa.DataType:
    """The type with every inner field nullable, as result schemas have it."""
    if pa.types.is_struct(kind):
        return pa.struct([pa.field(f.name, _nullable(f.type)) for f in kind])
    if pa.types.is_list(kind):
        return pa.list_(pa.field(kind.value_field.name, _nullable(kind.value_type)))
    return kind


def _with_columns(table: pa.Table, names: list[str], parts: tuple) -> pa.Table:
    kept = [table.column(c).cast(_nullable(table.column(c).type)) for c in names]
    return pa.table([*kept, *_to_arrays(parts)], names=[*names, *FIELDS])


def _scan_rows(names: list[str], order: list[str], through: bool) -> Callable[[pa.Table], pa.Table]:
    """Moments of the rows before each row of a pane (or through it), in ``order``."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in order])
        sums = running(_from_table(table))
        if not through:
            sums = tuple(x[:-1] for x in empty_first(sums))
        return _with_columns(table, names, sums)

    return run


def _scan_window(names: list[str]) -> Callable[[pa.Table], pa.Table]:
    """In one pane: for times (kind 0) the moments before them, for marks (kind 1) those from them on."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("_at", "ascending"), ("_kind", "ascending")])
        kind, at = table.column("_kind").to_numpy(), table.column("_at").to_numpy()
        rows = table.filter(pa.array(kind == 0))
        times, parts = at[kind == 0], _from_table(rows)
        before = empty_first(running(parts))
        back = tuple(x[::-1] for x in empty_first(running(tuple(x[::-1] for x in parts))))
        forward = np.searchsorted(times, at, "left")
        out = tuple(np.where(kind == 0, b[forward], f[forward]) for b, f in zip(before, back))
        return _with_columns(table, names, out)

    return run


# --- Spark side -------------------------------------------------------------------
def _ddl(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names) + f", {_TYPES}"


def _struct() -> Column:
    return F.struct(*FIELDS)


def moments_before(
    rows: DataFrame, keys: list[str], pane: str, order: list[str], value: str, through: bool = False
) -> DataFrame:
    """Add ``_moments`` of ``value`` over the rows of the key before each row (or through it).

    ``pane`` numbers rise with ``order`` within a key; a task sees one pane, and the panes'
    totals are merged into the rows of later panes. Missing values do not count.
    """
    present = F.col(value).isNotNull()
    x = F.coalesce(F.col(value).cast("double"), F.lit(0.0))
    single = {"n": present.cast("bigint"), "mean": x, "m2": F.lit(0.0), "lo": x, "hi": x}
    part = [*keys, pane]
    held = rows.select(*part, *order, F.struct(*rows.columns).alias("_row"), *[c.alias(n) for n, c in single.items()])
    names = [*part, "_row"]
    inside = held.groupBy(*part).applyInArrow(_scan_rows(names, order, through), _ddl(held, names))
    earlier = Window.partitionBy(*keys).orderBy(pane).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*part).agg(summarised(value).alias("_total"))
    totals = totals.select(*part, folded(F.collect_list("_total").over(earlier)).alias("_carried"))
    same = totals.select(*[F.col(c).alias(f"_m_{c}") for c in part], "_carried")
    joined = inside.join(same, [F.col(c).eqNullSafe(F.col(f"_m_{c}")) for c in part])
    return joined.select("_row.*", merged(F.col("_carried"), _struct()).alias("_moments"))


def _place(time: str, width: int, pane_width: str) -> list[Column]:
    """Block of a time, and its pane within the block; whole numbers throughout."""
    block = f"({time} div {width}L - if({time} % {width}L < 0, 1L, 0L))"
    return [F.expr(block).alias("_block"), F.expr(f"({time} - {block} * {width}L) div {pane_width}").alias("_pane")]


def window_moments(rows: DataFrame, keys: list[str], value: str, width: int, pane_width: str, us: str = "us") -> DataFrame:
    """Per (keys, us): ``_moments`` of the rows of the key from ``us - width`` up to before ``us``.

    ``pane_width`` is a column with the time span of a pane, constant per key. Rows of equal
    key and time are combined map-side before anything is ordered.
    """
    per_time = rows.groupBy(*keys, pane_width, us).agg(summarised(value).alias("_m"))
    kinds = F.array(
        F.struct(F.lit(0).alias("kind"), F.col(us).alias("at")), F.struct(F.lit(1).alias("kind"), (F.col(us) - width).alias("at"))
    )
    events = per_time.withColumn("_k", F.explode(kinds)).select(
        *keys,
        *_place("_k.at", width, pane_width),
        F.col("_k.at").alias("_at"),
        F.col("_k.kind").alias("_kind"),
        F.col(us).alias("_for"),
        *[F.col(f"_m.{f}").alias(f) for f in FIELDS],
    )
    part = [*keys, "_block", "_pane"]
    names = [*part, "_kind", "_for"]
    inside = events.groupBy(*part).applyInArrow(_scan_window(names), _ddl(events, names))
    placed = rows.select(*keys, *_place(us, width, pane_width), value)
    totals = placed.groupBy(*part).agg(summarised(value).alias("_total"))
    panes = events.select(*part, "_kind").distinct()
    return _across_panes(inside, panes, totals, keys).withColumnRenamed("_for", us)


def _across_panes(inside: DataFrame, panes: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """Times get the panes before theirs, marks those after theirs; then both parts of a time are merged."""
    whole = [*keys, "_block"]
    other = totals.select(*[F.col(c).alias(f"_m_{c}") for c in whole], F.col("_pane").alias("_other"), "_total")
    side = F.when(F.col("_kind") == 0, F.col("_other") < F.col("_pane")).otherwise(F.col("_other") > F.col("_pane"))
    carried = panes.join(other, [F.col(c) == F.col(f"_m_{c}") for c in whole]).where(side)
    carried = carried.groupBy(*whole, "_pane", "_kind").agg(folded(F.collect_list("_total")).alias("_carried"))
    joined = inside.join(carried, [*whole, "_pane", "_kind"], "left")
    none = F.expr(NONE)
    joined = joined.select(*keys, "_for", merged(F.coalesce("_carried", none), _struct()).alias("_part"))
    return joined.groupBy(*keys, "_for").agg(folded(F.collect_list("_part")).alias("_moments"))
