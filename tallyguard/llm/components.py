"""Connected components of a link table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyguard.session import settle


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step over (u, v); u's minimum is found by aggregation."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    rows = both.join(low, "u")
    if large:
        out = rows.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = rows.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(rows.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(id, label) of every id in a link: label is the smallest id of its component.

    Large-star and small-star steps alternate until the edges no longer change. All
    tables stay distributed; each round is written to the shared folder. Links of an id
    with itself and null ids are ignored.
    """
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v").distinct()
    edges = settle(edges, "links")
    seen = None
    while True:
        edges = settle(_stars(_stars(edges, True), False), "stars")
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 999_983)).first()
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
    labels = edges.groupBy("u").agg(F.min("v").alias("label")).withColumnRenamed("u", "id")
    return labels.unionByName(labels.select(F.col("label").alias("id"), "label").distinct())
