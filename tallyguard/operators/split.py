"""Exact chronological splits without a global sort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyguard.operators.selection import order_statistics


def temporal_cut(
    df: DataFrame, fraction: float = 0.8, us: str = "us", seq: str = "seq"
) -> tuple[int, int | None] | None:
    """(us, seq) of the first row after the earliest ``int(fraction * n)`` rows.

    ``seq`` is None where the time alone decides.
    """
    found: dict[str, int] = {}

    def rank(n: int) -> list[int]:
        found["cut"] = int(n * fraction)
        return [found["cut"]] if found["cut"] < n else []

    # a row without a time would be in no order: it counts as the earliest there is
    timed = df.select(F.coalesce(F.col(us), F.lit(-(1 << 62))).alias(us), seq)
    stats, cut = order_statistics(timed, us, rank, near=[fraction]), found.get("cut")
    if not stats:
        return None
    at, below = stats[cut]
    if below == cut:  # every row of this time is late
        return at, None
    tied = timed.where(F.col(us) == F.lit(at))
    return at, order_statistics(tied, seq, [cut - below])[cut - below][0]


def temporal_split(
    df: DataFrame,
    fraction: float = 0.8,
    us: str = "us",
    seq: str = "seq",
    names: tuple[str, str] = ("train", "holdout"),
    column: str = "split",
) -> DataFrame:
    """Add the split name: the earliest share by (us, seq) against the rest.

    The cut is found by order statistics, so the split itself is a row-wise
    comparison with two literals: no sort, no shuffle of the rows.
    """
    cut = temporal_cut(df, fraction, us, seq)
    if cut is None:
        return df.withColumn(column, F.lit(names[0]))
    early = F.col(us) < cut[0]
    if cut[1] is not None:
        early = early | ((F.col(us) == cut[0]) & (F.col(seq) < cut[1]))
    return df.withColumn(column, F.when(early, names[0]).otherwise(names[1]))
