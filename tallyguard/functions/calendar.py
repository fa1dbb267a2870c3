"""Time expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEP_ORIGIN = "2024-01-01 00:00:00"


def calendar_features(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Add hour_of_day, day_of_week (Monday = 0) and is_weekend."""
    return (
        df.withColumn("hour_of_day", F.hour(ts))
        .withColumn("day_of_week", F.weekday(ts))
        .withColumn("is_weekend", (F.weekday(ts) >= 5).cast("int"))
    )


def step_to_timestamp(step: str | Column) -> Column:
    """Whole hours since the fixed origin."""
    col = F.col(step) if isinstance(step, str) else step
    return F.timestamp_add("HOUR", col.cast("int"), F.lit(STEP_ORIGIN).cast("timestamp"))


def date_and_time(date: str, time: str) -> Column:
    return F.concat_ws(" ", F.col(date).cast("string"), F.col(time).cast("string"))


def parse_timestamp(text: str | Column) -> Column:
    """Timestamp of an ISO-like text, null where it cannot be read."""
    col = F.col(text) if isinstance(text, str) else text
    return col.cast("string").try_cast("timestamp")


def day_name_to_index(day: str | Column) -> Column:
    """Sunday = 0 .. Saturday = 6 from the first three letters; unknown gives 0."""
    head = F.lower(F.substring(F.trim(day), 1, 3))
    days = F.array(*[F.lit(d) for d in ("sun", "mon", "tue", "wed", "thu", "fri", "sat")])
    return F.greatest(F.array_position(days, head) - 1, F.lit(0)).cast("int")


def bucket_to_hour(bucket: str | Column) -> Column:
    """Representative hour of a time-of-day bucket label."""
    col = F.col(bucket) if isinstance(bucket, str) else bucket
    return (
        F.when(col == "06:00-09:00", 8)
        .when(col == "09:00-18:00", 14)
        .when(col == "18:00-22:00", 20)
        .when(col == "22:00-02:00", 23)
        .otherwise(3)
    )
