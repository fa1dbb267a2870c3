"""Positions in a total order, and row numbers, without a single-task window."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyguard.session import settle

ROW = "__row_no"  # a name that input tables will not have
_SHIFT = 33  # monotonically_increasing_id keeps the partition above this bit


def numbered(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder, with a unique BIGINT ``ROW``.

    The written number is what later jobs read, so it stays the same for repeated
    rows, null ids and recomputed tasks.
    """
    return settle(df.withColumn(ROW, F.monotonically_increasing_id()), label)


def located(df: DataFrame, label: str) -> tuple[DataFrame, list[str]]:
    """``df`` with columns that name each row, and the names of these columns.

    Rows read from Parquet files already have a name: their file and their place in it,
    which stay the same for every column selection and recomputed task. The file's path
    goes in as two hashes (96 bits). Other tables are written once with a row number.
    """
    try:
        at = df.metadataColumn("_metadata")
        path = at.getField("file_path")
        keys = {f"{ROW}_f": F.xxhash64(path), f"{ROW}_g": F.crc32(path), f"{ROW}_i": at.getField("row_index")}
        out = df.select("*", *[c.alias(n) for n, c in keys.items()])
        out.schema  # noqa: B018  (resolves the names)
        return out, list(keys)
    except AnalysisException:
        return numbered(df, label), [ROW]


def content_hash(df: DataFrame) -> Column:
    """Hash of a row's columns (maps cannot be hashed and are left out), whatever file it is in."""
    return F.xxhash64(*[F.col(c) for c, t in df.dtypes if "map<" not in t])


def rejoin(rows: DataFrame, decided: DataFrame, keys: list[str]) -> DataFrame:
    """Wide ``rows`` with the columns of the narrow ``decided``, which has each key once.

    The wide rows are shuffled once and not sorted: each partition builds a table of its
    part of the decisions.
    """
    return rows.join(decided.hint("shuffle_hash"), keys)


def positioned(df: DataFrame, order: list[Column], name: str, label: str) -> tuple[DataFrame, int]:
    """Rows with their 0-based position in ``order``, and the number of rows.

    One range-partitioned sort; the sorted rows are written with their place inside
    the partition and the row counts of the partitions (as many numbers as there are
    partitions) are added up on the driver. ``df`` should be narrow, and read from
    files: the sort samples its input first. Equal rows of ``order`` are in any order.
    """
    spark = df.sparkSession
    rows = settle(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), label)
    part = F.shiftright("_at", _SHIFT).cast("int")
    counts = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect()
    total, starts = 0, []
    for r in counts:
        starts.append((r["_part"], total))
        total += r["n"]
    if not starts:
        return rows.select(*df.columns, F.col("_at").alias(name)), 0
    first = spark.createDataFrame(starts, "_part int, _start bigint")
    within = F.col("_at").bitwiseAND(F.lit((1 << _SHIFT) - 1))
    out = rows.withColumn("_part", part).join(F.broadcast(first), "_part")
    return out.select(*df.columns, (F.col("_start") + within).alias(name)), total
