"""Train-only statistics and encoders: amounts, ordinal codes, risky corridors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyguard.operators.skew import match_on
from tallyguard.schema import CATEGORICALS, CORRIDOR_RATE, OPTIONALS
from tallyguard.session import settle

# Largest lookup side that may be broadcast, in rows.
BROADCAST_ROWS = 50_000
RANGE_ROWS = 200_000  # categories that one task ranks


def small_side(df: DataFrame) -> DataFrame:
    """Fix a lookup side that is small and hint its broadcast; leave larger ones alone.

    At most ``BROADCAST_ROWS`` + 1 rows are fetched. A side that fits becomes a
    local table, so its plan is not run again; a larger one keeps a shuffle join.
    """
    rows = df.limit(BROADCAST_ROWS + 1).collect()
    if len(rows) > BROADCAST_ROWS:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def amount_stats(train: DataFrame, amount: str = "amount") -> DataFrame:
    """One row: mean and sample standard deviation of the train amounts."""
    return train.agg(
        F.avg(amount).alias("global_mean"), F.stddev_samp(amount).alias("global_std")
    )


def as_text(column: str):
    """Text form of a category; missing values are the category 'nan'."""
    return F.coalesce(F.col(column).cast("string"), F.lit("nan"))


def ordinal_fit(
    train: DataFrame, columns: list[str] = OPTIONALS, local_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """(column, category, code): position of each category in sorted order.

    Up to ``local_rows`` distinct categories are numbered as one fetched list. More
    are ranked within sampled ranges with the sizes of earlier ranges added, so neither a
    column with very many categories nor names that start alike meet in one task.
    """
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column"), as_text(c).alias("category")) for c in columns])
    )
    distinct = train.select(pairs.alias("p")).select("p.*").distinct()
    fetched = distinct.limit(local_rows + 1).collect()
    if len(fetched) <= local_rows:
        names = {c: sorted(r["category"] for r in fetched if r["column"] == c) for c in columns}
        return train.sparkSession.createDataFrame(
            [(c, name, i) for c in columns for i, name in enumerate(names[c])],
            "column string, category string, code bigint",
        )
    # cut into ranges of about equally many names; a range's start is the sum of those before
    ranges = max(1, -(-distinct.count() // RANGE_ROWS))
    cut = distinct.repartitionByRange(ranges, "column", "category") if ranges > 1 else distinct.coalesce(1)
    cut = settle(cut.withColumn("_range", F.spark_partition_id()), "category-ranges")
    earlier = Window.partitionBy("column").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy("column", "_range").agg(F.count(F.lit(1)).alias("n"))
    starts = starts.select("column", "_range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("column", "_range").orderBy("category")
    return match_on(
        cut.withColumn("_at", F.row_number().over(inside)), starts, ["column", "_range"], "inner"
    ).select("column", "category", (F.col("_at") - 1 + F.col("_start")).cast("bigint").alias("code"))


def ordinal_encode(
    df: DataFrame, maps: DataFrame, columns: list[str] = CATEGORICALS
) -> DataFrame:
    """Add ``enc_<column>`` per column; categories not in the map get -1."""
    keep = df.columns
    maps = small_side(maps.where(F.col("column").isin(columns)))
    for c in columns:
        side = maps.where(F.col("column") == c).select(
            F.col("category").alias("_category"), F.col("code").alias("_code")
        )
        df = (
            df.join(side, as_text(c) == F.col("_category"), "left")
            .withColumn(f"enc_{c}", F.coalesce(F.col("_code").cast("double"), F.lit(-1.0)))
            .drop("_category", "_code")
        )
    return df.select(*keep, *[f"enc_{c}" for c in columns])


def corridor_key():
    return F.concat_ws("|", as_text("sender_bank"), as_text("receiver_bank"))


def corridor_rates(train: DataFrame) -> DataFrame:
    """Rows, frauds and fraud rate per (sender_bank, receiver_bank); null banks are left out."""
    return (
        train.where("sender_bank is not null and receiver_bank is not null")
        .groupBy("sender_bank", "receiver_bank")
        .agg(F.sum("fraud_flag").cast("bigint").alias("frauds"), F.count(F.lit(1)).alias("txns"))
        .withColumn("fraud_rate", F.col("frauds") / F.greatest(F.col("txns"), F.lit(1)))
    )


def corridor_fit(train: DataFrame, threshold: float = CORRIDOR_RATE) -> DataFrame:
    """Corridors whose fraud rate is above ``threshold``, with their 'a|b' name."""
    return (
        corridor_rates(train)
        .where(F.col("fraud_rate") > threshold)
        .withColumn("corridor", corridor_key())
    )


def corridor_flag(df: DataFrame, corridors: DataFrame) -> DataFrame:
    """Add ``is_high_risk_corridor`` (1.0/0.0) by membership in the risky set."""
    names = corridors.select(F.col("corridor").alias("_corridor")).distinct()
    return (
        df.join(small_side(names), corridor_key() == F.col("_corridor"), "left")
        .withColumn("is_high_risk_corridor", F.col("_corridor").isNotNull().cast("double"))
        .drop("_corridor")
    )
