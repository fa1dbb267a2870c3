"""Running aggregates over time-ordered keys, exact also for keys cut into chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyguard.operators.moments import moments_before, spelled, summarised
from tallyguard.operators.skew import MARKS, OVERSPLIT, ROWS_PER_CHUNK, budget, chunk_id, match_on, split_dense
from tallyguard.schema import EPSILON
from tallyguard.session import settle

FRAMES = ("earlier", "before", "through")


def _frame(partition: list[str], order: list, frame: str):
    """earlier: strictly smaller first order column; before/through: row by row."""
    if frame == "earlier":
        return (
            Window.partitionBy(*partition)
            .orderBy(order[0])
            .rangeBetween(Window.unboundedPreceding, -1)
        )
    last = -1 if frame == "before" else 0
    return (
        Window.partitionBy(*partition)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, last)
    )


def running_sums(
    df: DataFrame,
    keys: list[str],
    order: list,
    sums: dict[str, Column],
    frame: str,
    chunk: str | None = None,
) -> DataFrame:
    """Add a running sum per entry of ``sums``.

    With ``chunk`` the window runs per (keys, chunk) and the totals of earlier
    chunks are joined in; the totals table has one row per chunk.
    """
    inputs = df.select("*", *[v.alias(f"_v_{n}") for n, v in sums.items()])
    part = keys + ([chunk] if chunk else [])
    spec = _frame(part, order, frame)
    if not chunk:
        return inputs.select(
            *df.columns,
            *[F.coalesce(F.sum(f"_v_{n}").over(spec), F.lit(0)).alias(n) for n in sums],
        )
    inside = inputs.select(
        *df.columns,
        *[F.coalesce(F.sum(f"_v_{n}").over(spec), F.lit(0)).alias(f"_in_{n}") for n in sums],
    )
    earlier_chunks = (
        Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = (
        inputs.groupBy(*part)
        .agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
        .select(
            *part,
            *[
                F.coalesce(F.sum(f"_t_{n}").over(earlier_chunks), F.lit(0)).alias(f"_c_{n}")
                for n in sums
            ],
        )
    )
    return match_on(inside, carried, part, "inner").select(
        *df.columns, *[(F.col(f"_in_{n}") + F.col(f"_c_{n}")).alias(n) for n in sums]
    )


def add_sums_before(
    rows: DataFrame, events: DataFrame, keys: list[str], names: list[str], us: str = "us"
) -> DataFrame:
    """Add to rows of dense keys the event totals of strictly earlier times.

    ``events`` has the keys, their chunk marks, ``_at`` and the value columns, and
    at least one event at each row's time. Events of equal key and time are
    combined before anything is ordered, so neither busy keys nor busy moments
    gather in one task.
    """
    per_time = (
        events.groupBy(*keys, *MARKS, "_at")
        .agg(*[F.sum(n).alias(f"_d_{n}") for n in names])
        .withColumn("_chunk", chunk_id("_at"))
    )
    totals = running_sums(
        per_time, keys, ["_at"], {n: F.col(f"_d_{n}") for n in names}, "before", "_chunk"
    ).select(*keys, F.col("_at").alias(us), *names)
    return match_on(rows, totals, keys + [us], "inner")


def add_tied_sums(
    df: DataFrame,
    keys: list[str],
    sums: dict[str, Column],
    frame: str = "before",
    us: str = "us",
    seq: str = "seq",
    rows: int | None = None,
) -> DataFrame:
    """Add running sums over the rows of the same key and time, in ``seq`` order."""
    part = keys + [us]
    sparse, dense = split_dense(df, part, seq, rows=rows)
    out = running_sums(sparse, part, [seq], sums, frame)
    if dense is None:
        return out
    cut = dense.withColumn("_chunk", chunk_id(seq))
    return out.unionByName(
        running_sums(cut, part, [seq], sums, frame, "_chunk").drop("_chunk", *MARKS)
    )


def neighbour_times(
    df: DataFrame, keys: list[str], us: str = "us", seq: str = "seq", rows: int | None = None
) -> DataFrame:
    """Add ``prev_us`` / ``next_us``: times of the neighbouring rows of the same key."""
    sparse, dense = split_dense(df, keys, us, rows=rows)
    spec = Window.partitionBy(*keys).orderBy(us, seq)
    out = sparse.select(
        "*", F.lag(us).over(spec).alias("prev_us"), F.lead(us).over(spec).alias("next_us")
    )
    if dense is None:
        return out
    cut = dense.withColumn("_chunk", chunk_id(us))
    part = keys + ["_chunk"]
    spec = Window.partitionBy(*part).orderBy(us, seq)
    inside = cut.select(
        *df.columns,
        "_chunk",
        F.lag(us).over(spec).alias("_p"),
        F.lead(us).over(spec).alias("_q"),
    )
    by_chunk = Window.partitionBy(*keys).orderBy("_chunk")
    edges = (
        cut.groupBy(*part)
        .agg(F.min(us).alias("_first"), F.max(us).alias("_last"))
        .select(
            *part,
            F.lag("_last").over(by_chunk).alias("_cp"),
            F.lead("_first").over(by_chunk).alias("_cq"),
        )
    )
    joined = match_on(inside, edges, part, "inner").select(
        *df.columns,
        F.coalesce("_p", "_cp").alias("prev_us"),
        F.coalesce("_q", "_cq").alias("next_us"),
    )
    return out.unionByName(joined)


def prior_sets(
    df: DataFrame,
    keys: list[str],
    value: str,
    us: str = "us",
    seq: str = "seq",
    through: bool = False,
    rows: int | None = None,
) -> DataFrame:
    """Add ``_moments`` of ``value`` over a key's earlier rows; ``through`` includes the row itself."""
    sparse, dense = split_dense(df, keys, us, rows=rows)
    spec = _frame(keys, [us, seq], "through" if through else "before")
    out = sparse.select("*", summarised(value, spec).alias("_moments"))
    if dense is None:
        return out
    order = [us] if us == seq else [us, seq]
    cut = dense.withColumn("_chunk", chunk_id(us))
    found = moments_before(cut, keys, "_chunk", order, value, through)
    return out.unionByName(found.select(*df.columns, "_moments"))


def prior_moments(
    df: DataFrame,
    keys: list[str],
    value: str,
    us: str = "us",
    seq: str = "seq",
    through: bool = False,
    rows: int | None = None,
) -> DataFrame:
    """Add ``prior_n``, ``prior_mean``, ``prior_m2`` of ``value`` over a key's history.

    ``m2`` is the sum of squared deviations. ``through`` includes the row itself.
    """
    found = prior_sets(df, keys, value, us, seq, through, rows)
    return found.select(*df.columns, *spelled("_moments", "prior"))


def prior_count(
    df: DataFrame,
    keys: list[str],
    name: str,
    us: str = "us",
    seq: str = "seq",
    rows: int | None = None,
) -> DataFrame:
    """Add the number of earlier rows of the key, in (us, seq) order."""
    sparse, dense = split_dense(df, keys, us, rows=rows)
    spec = Window.partitionBy(*keys).orderBy(us, seq)
    out = sparse.withColumn(name, F.row_number().over(spec).cast("bigint") - 1)
    if dense is None:
        return out
    counted = running_sums(
        dense.withColumn("_chunk", chunk_id(us)),
        keys,
        [us, seq],
        {name: F.lit(1).cast("bigint")},
        "before",
        "_chunk",
    )
    return out.unionByName(counted.drop("_chunk", *MARKS))


def first_seen(
    df: DataFrame,
    keys: list[str],
    name: str,
    us: str = "us",
    seq: str = "seq",
    rows: int | None = None,
) -> DataFrame:
    """Add 1 for the first row of each key in (us, seq) order, else 0."""
    sparse, dense = split_dense(df, keys, us, rows=rows)
    spec = Window.partitionBy(*keys).orderBy(us, seq)
    out = sparse.withColumn(name, (F.row_number().over(spec) == 1).cast("int"))
    if dense is None:
        return out
    # A dense key needs only its smallest position, which combines map-side.
    firsts = dense.groupBy(*keys).agg(F.min(F.struct(us, seq)).alias("_first"))
    flagged = match_on(dense, firsts, keys, "inner").withColumn(
        name, (F.struct(us, seq) == F.col("_first")).cast("int")
    )
    return out.unionByName(flagged.drop("_first", *MARKS))


def running_amounts(df: DataFrame, value: str, us: str = "us", seq: str = "seq") -> DataFrame:
    """Add ``running_n``, ``running_mean``, ``running_std`` over all rows so far.

    One global order, cut into sampled ranges of about equally many rows, whose moments
    are merged into the later ranges; so no task sees more than its range. One row so far has a spread of ``EPSILON``.
    """
    spark = df.sparkSession
    size = df.count()
    panes = max(1, -(-size * OVERSPLIT // budget(spark, ROWS_PER_CHUNK)))
    cut = df.repartitionByRange(panes, us, seq) if panes > 1 else df.coalesce(1)
    cut = settle(cut.withColumn("_all", F.lit(0)).withColumn("_chunk", F.spark_partition_id()), "running-panes")
    found = moments_before(cut, ["_all"], "_chunk", [us, seq], value, True)
    n, spread = F.col("_moments.n"), F.sqrt(F.col("_moments.m2") / (F.col("_moments.n") - 1))
    return found.select(
        *df.columns,
        n.alias("running_n"),
        F.when(n > 0, F.col("_moments.mean")).alias("running_mean"),
        F.when(n < 2, F.lit(EPSILON)).otherwise(spread).alias("running_std"),
    )
