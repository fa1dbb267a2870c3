"""As-of lookups: the last update at or before each row, with or without a time limit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyguard.operators.skew import chunk_id, match_on, split_dense
from tallyguard.schema import MICROS


def _events(rows: DataFrame, updates: DataFrame, keys: list[str], us: str, order: str) -> DataFrame:
    """Rows and updates in one table; at equal times updates come first."""
    payload = [c for c in updates.columns if c not in keys]
    update_type = updates.select(F.struct(*payload).alias("u")).schema["u"].dataType
    row_type = rows.select(F.struct(*rows.columns).alias("r")).schema["r"].dataType
    left = updates.select(
        *keys,
        F.col(us).alias("_us"),
        F.lit(0).alias("_kind"),
        F.col(order).cast("bigint").alias("_ord"),
        F.struct(*payload).alias("_update"),
        F.lit(None).cast(row_type).alias("_row"),
    )
    right = rows.select(
        *keys,
        F.col(us).alias("_us"),
        F.lit(1).alias("_kind"),
        F.lit(0).cast("bigint").alias("_ord"),
        F.lit(None).cast(update_type).alias("_update"),
        F.struct(*rows.columns).alias("_row"),
    )
    return left.unionByName(right)


def last_update(
    rows: DataFrame, updates: DataFrame, keys: list[str], us: str = "us", order: str = "seq"
) -> DataFrame:
    """Add ``update``: the struct of the newest update with time <= the row's, or null.

    ``updates`` holds the keys, ``us``, ``order`` (ties among updates) and payload.
    """
    events = _events(rows, updates, keys, us, order)
    sparse, dense = split_dense(events, keys, "_us")
    position = ["_us", "_kind", "_ord"]

    def within(partition: list[str]):
        return (
            Window.partitionBy(*partition)
            .orderBy(*position)
            .rowsBetween(Window.unboundedPreceding, 0)
        )

    newest = F.last("_update", ignorenulls=True)
    out = (
        sparse.withColumn("update", newest.over(within(keys)))
        .where("_kind = 1")
        .select("_row.*", "update")
    )
    if dense is None:
        return out
    part = keys + ["_chunk"]
    cut = dense.withColumn("_chunk", chunk_id("_us"))
    earlier = (
        Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = (
        cut.groupBy(*part)
        .agg(F.max(F.when(F.col("_kind") == 0, F.struct("_us", "_ord", "_update"))).alias("_top"))
        .select(*part, F.last("_top", ignorenulls=True).over(earlier).alias("_carry"))
    )
    inside = cut.withColumn("_in", newest.over(within(part)))
    return out.unionByName(
        match_on(inside.where("_kind = 1"), carried, part, "inner").select(
            "_row.*", F.coalesce("_in", "_carry._update").alias("update")
        )
    )


def last_updates(
    rows: DataFrame, updates: dict[str, DataFrame], keys: list[str], us: str = "us", order: str = "seq"
) -> DataFrame:
    """Add one struct per entry of ``updates``: its newest row with time <= the row's, or null.

    All kinds of updates and the rows are one event table per key, answered in event
    order in one pass: one shuffle and one sort, however many kinds there are.
    """
    kinds = {
        name: df.select(F.struct(*[c for c in df.columns if c not in keys]).alias("u")).schema["u"].dataType
        for name, df in updates.items()
    }
    together = None
    for name, df in updates.items():
        fields = [
            (F.struct(*[c for c in df.columns if c not in keys]) if other == name else F.lit(None).cast(kind)).alias(other)
            for other, kind in kinds.items()
        ]
        part = df.select(*keys, F.col(us).alias("_at"), F.col(order).cast("bigint").alias("_nth"), *fields)
        together = part if together is None else together.unionByName(part)
    events = _events(rows.withColumn("_at", F.col(us)), together, keys, "_at", "_nth")
    sparse, dense = split_dense(events, keys, "_us")
    position, names = ["_us", "_kind", "_ord"], list(updates)

    def newest(partition: list[str]):
        spec = Window.partitionBy(*partition).orderBy(*position).rowsBetween(Window.unboundedPreceding, 0)
        return [F.last(f"_update.{n}", ignorenulls=True).over(spec).alias(f"_of_{n}") for n in names]

    columns = [F.col(f"_row.{c}") for c in rows.columns]
    found = sparse.select("*", *newest(keys)).where("_kind = 1")
    out = found.select(*columns, *[F.col(f"_of_{n}").alias(n) for n in names])
    if dense is None:
        return out
    part = keys + ["_chunk"]
    cut = dense.withColumn("_chunk", chunk_id("_us"))
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    tops = [
        F.max(F.when(F.col(f"_update.{n}").isNotNull(), F.struct("_us", "_ord", F.col(f"_update.{n}").alias("u")))).alias(f"_top_{n}")
        for n in names
    ]
    carried = cut.groupBy(*part).agg(*tops).select(
        *part, *[F.last(f"_top_{n}", ignorenulls=True).over(earlier).alias(f"_carry_{n}") for n in names]
    )
    inside = cut.select("*", *newest(part)).where("_kind = 1")
    return out.unionByName(
        match_on(inside, carried, part, "inner").select(
            *columns, *[F.coalesce(f"_of_{n}", f"_carry_{n}.u").alias(n) for n in names]
        )
    )


def last_update_within(
    rows: DataFrame,
    updates: DataFrame,
    keys: list[str],
    ttl_s: int,
    us: str = "us",
    order: str = "seq",
) -> DataFrame:
    """Like :func:`last_update` for updates at most ``ttl_s`` whole seconds old.

    A valid update lies in the row's own time slice or the one before, so each
    update is copied to two slices and no window spans more than one slice.
    """
    width = (ttl_s + 1) * MICROS
    own = F.expr(f"{us} div {width}L")
    found = last_update(
        rows.withColumn("_slice", own),
        updates.withColumn("_slice", F.explode(F.array(own, own + 1))),
        keys + ["_slice"],
        us,
        order,
    )
    age = F.expr(f"{us} div {MICROS}L - update.{us} div {MICROS}L")
    return found.withColumn("update", F.when(age <= ttl_s, F.col("update"))).drop("_slice")


def risk_delta_lookup(
    rows: DataFrame, deltas: DataFrame, key: str, ttl_s: int, us: str = "us"
) -> DataFrame:
    """Add ``graph_delta`` and ``graph_reason``; (0.0, 'cold') when absent or expired."""
    found = last_update_within(
        rows, deltas.select(key, us, "seq", "risk_delta", "reason"), [key], ttl_s, us
    )
    return found.select(
        *rows.columns,
        F.coalesce("update.risk_delta", F.lit(0.0)).alias("graph_delta"),
        F.coalesce("update.reason", F.lit("cold")).alias("graph_reason"),
    )


def feature_vector_lookup(
    rows: DataFrame, vectors: DataFrame, key: str, length: int, us: str = "us"
) -> DataFrame:
    """Add ``features``: the last vector written for the key, zeros where there is none."""
    found = last_update(rows, vectors.select(key, us, "seq", "features"), [key], us)
    zeros = F.array_repeat(F.lit(0.0).cast("float"), length)
    return found.select(*rows.columns, F.coalesce("update.features", zeros).alias("features"))


def cache_outcomes(
    reads: DataFrame, writes: DataFrame, key: str, ttl_s: int, us: str = "us", seq: str = "seq"
) -> DataFrame:
    """Add ``outcome`` to each read: hit, miss or expired.

    Expiry is lazy: the first read after the limit is ``expired`` and removes
    the entry, so later reads miss until the next write.
    """
    found = last_update(reads, writes.select(key, us, seq), [key], us, seq)
    age = F.expr(f"{us} div {MICROS}L - update.{us} div {MICROS}L")
    aged = found.withColumn("_age", age)
    # One row per expired write: its first late read. Combines map-side.
    removals = (
        aged.where(F.col("_age") > ttl_s)
        .groupBy(key, F.col(f"update.{us}").alias("_w_us"), F.col(f"update.{seq}").alias("_w_seq"))
        .agg(F.min(F.struct(us, seq)).alias("_at"))
        .select(key, F.col(f"_at.{us}").alias(us), F.col(f"_at.{seq}").alias(seq))
        .withColumn("_removes", F.lit(True))
    )
    return match_on(aged, removals, [key, us, seq], "left").select(
        *reads.columns,
        F.when(F.col("_age") <= ttl_s, "hit")
        .when(F.col("_removes"), "expired")
        .otherwise("miss")
        .alias("outcome"),
    )


def latest_per_key(
    df: DataFrame, keys: list[str], order: list[str], newest: bool = True
) -> DataFrame:
    """One row per key, the newest (or oldest) by ``order``; combines map-side."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if newest else F.min_by
    return (
        df.groupBy(*keys)
        .agg(pick(F.struct(*rest), F.struct(*order)).alias("_row"))
        .select(*keys, "_row.*")
        .select(*df.columns)
    )
