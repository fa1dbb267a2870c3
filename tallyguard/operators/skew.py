"""Finding dense keys and cutting them into time chunks.

A window over one key runs in one task, so a key that holds a large share of
the rows must not be handled that way. Operators in this package send ordinary
("sparse") keys through plain window functions and cut dense keys into equal
time chunks; totals of earlier chunks are then carried into each chunk. The
dense keys stay a DataFrame: nothing is collected, and adaptive execution picks
the join strategy from their measured size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyguard.session import settle

ROWS_PER_CHUNK = "tallyguard.rowsPerChunk"
SLIDING_ROWS = "tallyguard.slidingRows"
_DEFAULTS = {ROWS_PER_CHUNK: 1_000_000, SLIDING_ROWS: 20_000}
# Time chunks are equal in width, not in rows; cutting finer than the budget
# leaves room for bursts.
OVERSPLIT = 4
MARKS = ["_lo", "_width"]


def budget(spark: SparkSession, name: str) -> int:
    return int(spark.conf.get(name, str(_DEFAULTS[name])))


def match_on(
    left: DataFrame, right: DataFrame, keys: list[str], how: str, null_safe: bool = False
) -> DataFrame:
    """Equi-join that keeps the left key columns only.

    Plain equality lets the join reuse a partitioning by the same keys; use
    ``null_safe`` where a key may be missing and its rows must still match.
    """
    renamed = right.select(
        *[F.col(k).alias(f"_m_{k}") for k in keys],
        *[c for c in right.columns if c not in keys],
    )
    pairs = [(F.col(k), F.col(f"_m_{k}")) for k in keys]
    same = reduce(
        lambda a, b: a & b, [a.eqNullSafe(b) if null_safe else a == b for a, b in pairs]
    )
    return left.join(renamed, same, how).drop(*[f"_m_{k}" for k in keys])


def split_dense(
    df: DataFrame,
    keys: list[str],
    us: str = "us",
    limit: str = ROWS_PER_CHUNK,
    rows: int | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """(rows of sparse keys, rows of dense keys with chunk marks or None).

    Dense means more rows than ``limit``. The second part carries ``_lo`` and
    ``_width`` (for :func:`chunk_id`). Rows with a missing key count as sparse. ``rows`` is the row count where the caller knows
    it. Small inputs and inputs without dense keys keep their plan; otherwise the
    input is written once, because several branches read it.
    """
    spark = df.sparkSession
    allowed = budget(spark, limit)
    if (df.count() if rows is None else rows) <= allowed:
        return df, None
    per_chunk = max(1, budget(spark, ROWS_PER_CHUNK) // OVERSPLIT)

    def dense_keys(source: DataFrame) -> DataFrame:
        return (
            source.groupBy(*keys)
            .agg(
                F.count(F.lit(1)).alias("_n"),
                F.min(us).alias("_lo"),
                F.max(us).alias("_hi"),
            )
            .where(F.col("_n") > allowed)
            .select(
                *keys,
                "_lo",
                F.expr(
                    "greatest(1L, (_hi - _lo) div "
                    f"cast(ceil(_n / {per_chunk}D) as bigint) + 1L)"
                ).alias("_width"),
            )
        )

    if dense_keys(df).isEmpty():
        return df, None
    df = settle(df, "dense-input")
    marks = settle(dense_keys(df), "dense-keys")
    return match_on(df, marks, keys, "left_anti"), match_on(df, marks, keys, "inner")


def chunk_id(us: str = "us"):
    """Chunk number of a time within its dense key (0 for times before the first row)."""
    return F.expr(f"greatest(0L, ({us} - _lo) div _width)")
