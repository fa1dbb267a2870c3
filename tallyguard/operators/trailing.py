"""Trailing-window counts, moments and distinct counts.

Every window reaches back ``w`` microseconds, lower bound included. ``strict``
ties count rows with a smaller timestamp only; ``row`` ties also count earlier
rows (by ``seq``) with the same timestamp.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyguard.operators.moments import merged, spelled, summarised, window_moments
from tallyguard.operators.running import (
    add_sums_before,
    add_tied_sums,
    neighbour_times,
    prior_sets,
    running_sums,
)
from tallyguard.operators.skew import (
    MARKS,
    ROWS_PER_CHUNK,
    SLIDING_ROWS,
    match_on,
    split_dense,
)


def _sparse_windows(df, keys, counts, value, moments, us) -> DataFrame:
    def reach(to: int):
        return (
            Window.partitionBy(*keys)
            .orderBy(us)
            .rangeBetween(Window.unboundedPreceding, to)
        )

    # Counts as a difference of two running counts: linear, unlike a sliding frame.
    columns = [
        (F.count(F.lit(1)).over(reach(-1)) - F.count(F.lit(1)).over(reach(-w - 1))).alias(name)
        for name, w in counts.items()
    ]
    for name, w in moments.items():
        spec = Window.partitionBy(*keys).orderBy(us).rangeBetween(-w, -1)
        columns.append(summarised(value, spec).alias(f"_of_{name}"))
    return df.select("*", *columns)


def _dense_windows(df, keys, counts, value, moments, us, columns) -> DataFrame:
    """Counts as running sums of entries and exits; moments merged from both ends of blocks."""
    names = list(counts)
    moves = [F.struct(F.lit(0).alias("kind"), F.col(us).alias("at"))]
    moves += [
        F.struct(F.lit(i).alias("kind"), (F.col(us) + F.lit(counts[n])).alias("at"))
        for i, n in enumerate(names, 1)
    ]
    out = df
    if names:
        events = df.select(*keys, *MARKS, F.explode(F.array(*moves)).alias("_move"))
        kind = F.col("_move.kind")
        signs = [
            F.when(kind == 0, 1).when(kind == i, -1).otherwise(0).cast("bigint").alias(n)
            for i, n in enumerate(names, 1)
        ]
        moved = events.select(*keys, *MARKS, F.col("_move.at").alias("_at"), *signs)
        out = add_sums_before(df, moved, keys, names, us)
    for n, w in moments.items():
        found = window_moments(df, keys, value, w, "_width", us)
        out = match_on(out, found.withColumnRenamed("_moments", f"_of_{n}"), keys + [us], "inner")
    return out.select(*columns, *names, *[f"_of_{n}" for n in moments])


def _tied_predecessors(df, keys, value, moments, us, seq, rows) -> DataFrame:
    """Add count and moments of the earlier rows of the same timestamp."""
    df = add_tied_sums(df, keys, {"_tn": F.lit(1).cast("bigint")}, "before", us, seq, rows)
    if not moments:
        return df
    return prior_sets(df, keys + [us], value, seq, seq, rows=rows).withColumnRenamed("_moments", "_tied")


def _merge_tied(df, columns, counts, moments) -> DataFrame:
    """Strictly earlier rows and tied predecessors together."""
    parts = [(F.col(n) + F.col("_tn")).alias(n) for n in counts]
    parts += [merged(F.col(f"_of_{m}"), F.col("_tied")).alias(f"_of_{m}") for m in moments]
    return df.select(*columns, *parts)


def trailing_windows(
    df: DataFrame,
    keys: list[str],
    counts: dict[str, int],
    value: str | None = None,
    moments: dict[str, int] | None = None,
    ties: str = "strict",
    us: str = "us",
    seq: str = "seq",
    rows: int | None = None,
) -> DataFrame:
    """Add trailing row counts and, per entry of ``moments``, ``_n``/``_mean``/``_m2``."""
    moments = moments or {}
    limit = SLIDING_ROWS if moments else ROWS_PER_CHUNK
    columns = df.columns
    if ties == "row":
        # First, so that its finer sort order also serves the windows below.
        df = _tied_predecessors(df, keys, value, moments, us, seq, rows)
    sparse, dense = split_dense(df, keys, us, limit, rows)
    out = _sparse_windows(sparse, keys, counts, value, moments, us)
    if dense is not None:
        out = out.unionByName(
            _dense_windows(dense, keys, counts, value, moments, us, df.columns)
        )
    if ties == "row":
        out = _merge_tied(out, columns, counts, moments)
    spelt = [c for m in moments for c in spelled(f"_of_{m}", m)]
    return out.select(*columns, *counts, *spelt)


def trailing_distinct(
    df: DataFrame,
    keys: list[str],
    item: str,
    windows: dict[str, int],
    ties: str = "row",
    through: bool = False,
    us: str = "us",
    seq: str = "seq",
    rows: int | None = None,
) -> DataFrame:
    """Add distinct counts of ``item`` per key and trailing window.

    An item is active from an occurrence until ``w`` after its last one, so the
    distinct count is a running sum of +1 where an active span opens and -1
    where it closes. No array of items is ever built. ``through`` counts the
    row's own item too.
    """
    names = list(windows)
    opened = {
        n: F.when(F.col("prev_us").isNull() | (F.col(us) - F.col("prev_us") > w), 1)
        .otherwise(0)
        .cast("bigint")
        for n, w in windows.items()
    }
    moves = [F.struct(F.lit(0).alias("kind"), F.col(us).alias("at"))]
    for i, (n, w) in enumerate(windows.items(), 1):
        ends = F.col("next_us").isNull() | (F.col("next_us") - F.col(us) > w)
        moves.append(
            F.when(ends, F.struct(F.lit(i).alias("kind"), (F.col(us) + w).alias("at")))
        )
    flags = [v.alias(f"_open_{n}") for n, v in opened.items()]
    change = {
        n: F.when(F.col("_move.kind") == 0, F.col(f"_open_{n}"))
        .when(F.col("_move.kind") == i, -1)
        .otherwise(0)
        .cast("bigint")
        .alias(f"_move_{n}")
        for i, n in enumerate(names, 1)
    }
    sparse, dense = split_dense(df, keys, us, rows=rows)
    frame = "through" if through else "before"

    # Sparse keys: rows and closings in one order, the row itself carried along.
    # Placing rows by key first serves both the pair order and the sweep.
    linked = neighbour_times(sparse.repartition(*keys), keys + [item], us, seq, rows=0)
    events = (
        linked.select("*", *flags)
        .withColumn("_move", F.explode(F.array_compact(F.array(*moves))))
        .select(
            *keys,
            F.col(seq).alias("_seq"),
            F.col("_move.at").alias("_at"),
            F.col("_move.kind").alias("_kind"),
            *change.values(),
            F.when(F.col("_move.kind") == 0, F.struct(*df.columns)).alias("_row"),
        )
        .withColumn("_late", (F.col("_kind") > 0).cast("int"))
    )
    swept = running_sums(
        events,
        keys,
        ["_at", "_late", "_seq"],
        {n: F.col(f"_move_{n}") for n in names},
        "earlier" if ties == "strict" else frame,
    )
    # Keys come from the event columns: their partitioning serves later windows too.
    out = swept.where("_kind = 0").select(
        *[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns], *names
    )
    if dense is None:
        return out

    # Dense keys: totals of earlier times, then openings at the same time.
    linked = neighbour_times(dense.drop(*MARKS), keys + [item], us, seq)
    _, dense = split_dense(linked.select("*", *flags), keys, us)
    moved = dense.withColumn("_move", F.explode(F.array_compact(F.array(*moves)))).select(
        *keys, *MARKS, F.col("_move.at").alias("_at"), *change.values()
    )
    busy = add_sums_before(dense, moved, keys, [f"_move_{n}" for n in names], us)
    if ties == "row":
        here = {f"_tied_{n}": F.col(f"_open_{n}") for n in names}
        busy = add_tied_sums(busy.drop(*MARKS), keys, here, frame, us, seq, rows)
    total = [
        (F.col(f"_move_{n}") + (F.col(f"_tied_{n}") if ties == "row" else 0)).alias(n) for n in names
    ]
    return out.unionByName(busy.select(*df.columns, *total))
