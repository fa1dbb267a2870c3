"""Sharding by proportional stratified interleaving.

Rows of each source are shuffled by a seeded hash and ranked; row i of n gets the
fractional rank (i + 1/2) / n. Sorting all rows by fractional rank interleaves the
sources in proportion, so equal cuts of that order all have the mixture of the whole:
per source, a shard's count differs from its share by two rows at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyguard.llm.order import content_hash, located, positioned, rejoin
from tallyguard.session import settle

SHARDS = 24


def assign_shards(
    rows: DataFrame, shards: int = SHARDS, seed: int = 29, by: list[str] | None = None
) -> DataFrame:
    """``rows`` (``source`` and any others, narrow, read from files) with ``shard`` and ``slot``.

    Shards are 0 to ``shards`` - 1, their row counts at most one apart; ``slot`` counts
    from 0 within a shard. The order comes from a hash of the columns ``by`` (all columns
    where not given): it does not depend on partitioning, and rows equal in ``by`` are
    interchangeable. Equal texts get no common shard under this law. Null sources are
    one source. Both sorts are by range, so neither a large source nor repeated rows
    meet in one task.
    """
    kept = rows.columns
    shuffled = rows.withColumn("_h", F.xxhash64(F.lit(seed), *(by or kept)))
    ranked, n = positioned(
        shuffled, [F.col("source").asc_nulls_last(), F.col("_h"), *[F.col(c) for c in kept]], "_p", "shard-rank"
    )
    spans = ranked.groupBy("source").agg(F.min("_p").alias("_first"), F.count(F.lit(1)).alias("_n"))
    ranked = ranked.alias("r").join(spans.alias("s"), ranked["source"].eqNullSafe(spans["source"])).select("r.*", "_first", "_n")
    fraction = ((F.col("_p") - F.col("_first")) * 2 + 1) / (F.col("_n") * 2)
    woven, _ = positioned(
        ranked.select(*kept, "_h", "_p", fraction.alias("_f")), [F.col("_f"), F.col("_h"), F.col("_p")], "_q", "shard-weave"
    )
    shard = F.expr(f"cast(_q * {shards} div {max(n, 1)} AS int)")
    first = F.expr(f"(shard * {n}L + {shards - 1}) div {shards}")
    return woven.withColumn("shard", shard).withColumn("slot", F.col("_q") - first).select(*kept, "shard", "slot")


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: int = 29) -> DataFrame:
    """Pipeline stage form: every document with its ``shard`` and ``slot``.

    Needs ``source``; other columns pass through, whatever they are called (columns
    ``shard`` and ``slot`` of the input are replaced). Shards are decided on row names
    and sources alone; every text moves once, to its decision.
    """
    rows, keys = located(docs.drop("shard", "slot"), "shard-docs")
    content = content_hash(docs.drop("shard", "slot")).alias("__content")
    narrow = settle(rows.select(*keys, "source", content), "shard-rows")
    placed = assign_shards(narrow, shards, seed, ["__content"]).select(*keys, "shard", "slot")
    return rejoin(rows, placed, keys).drop(*keys)
