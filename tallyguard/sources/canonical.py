"""From an arbitrary transaction table to the canonical columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from tallyguard.functions.calendar import date_and_time, parse_timestamp, step_to_timestamp
from tallyguard.schema import ALIASES, NUMERIC_OPTIONALS, OPTIONALS, REQUIRED


def detect_column(columns: list[str], name: str) -> str | None:
    """The source column for a canonical name: first alias present, case ignored."""
    lowered = {c.lower(): c for c in columns}
    return next((lowered[a] for a in ALIASES[name] if a in lowered), None)


def resolve_aliases(df: DataFrame, labelled: bool = True) -> DataFrame:
    """One select that renames sources to canonical names.

    Required columns must be found. A source used for a required column is still
    available to an optional one. Optional columns absent from the source are
    filled: 'UNKNOWN' for categories, 0.0 for numbers; nulls inside present
    columns stay.
    """
    df = combine_date_time(df)
    wanted = [c for c in REQUIRED if labelled or c != "fraud_flag"]
    picked: list[Column] = []
    used: set[str] = set()
    for name in wanted:
        source = detect_column(df.columns, name)
        if source is None:
            raise ValueError(f"no column for {name!r}; expected one of {ALIASES[name]}")
        used.add(source)
        picked.append(F.col(f"`{source}`").alias(name))
    for name in OPTIONALS:
        source = detect_column(df.columns, name)
        if source is not None:
            used.add(source)
            picked.append(F.col(f"`{source}`").alias(name))
        else:
            fill = F.lit(0.0) if name in NUMERIC_OPTIONALS else F.lit("UNKNOWN")
            picked.append(fill.alias(name))
    others = [
        F.col(f"`{c}`") for c in df.columns if c not in used and c not in wanted + OPTIONALS
    ]
    return df.select(*picked, *others)


def combine_date_time(df: DataFrame) -> DataFrame:
    """Join separate date and time columns when there is no timestamp column."""
    lowered = {c.lower(): c for c in df.columns}
    if "date" in lowered and "time" in lowered and "timestamp" not in lowered:
        date, time = lowered["date"], lowered["time"]
        return df.withColumn("timestamp", date_and_time(date, time)).drop(date, time)
    return df


def coerce_types(
    df: DataFrame, step: bool | None = None, dropped: Observation | None = None
) -> DataFrame:
    """Typed canonical rows; rows without a readable timestamp are dropped.

    Texts of digits only are whole-number times, whatever the column was called.

    ``dropped`` counts them (metric ``bad_timestamps``) without another pass.
    """
    if step is None:
        step = isinstance(df.schema["timestamp"].dataType, NumericType)
    text = isinstance(df.schema["timestamp"].dataType, StringType)
    ts = step_to_timestamp("timestamp") if step else parse_timestamp("timestamp")
    if text and not step:
        whole = F.trim("timestamp").rlike("^[0-9]+$")
        ts = F.when(whole, step_to_timestamp("timestamp")).otherwise(ts)
    typed = df.withColumn("ts", ts).drop("timestamp")
    if dropped is not None:
        typed = typed.observe(
            dropped, F.sum(F.col("ts").isNull().cast("bigint")).alias("bad_timestamps")
        )
    typed = typed.where("ts is not null").withColumn("amount", number("amount", "double"))
    if "fraud_flag" in df.columns:
        typed = typed.withColumn("fraud_flag", number("fraud_flag", "double").cast("int"))
    for name in NUMERIC_OPTIONALS:
        typed = typed.withColumn(name, F.col(name).cast("string").try_cast("double"))
    return typed


def number(column: str, kind: str) -> Column:
    """Numeric value of a column, 0 where it cannot be read."""
    return F.coalesce(F.col(column).cast("string").try_cast(kind), F.lit(0).cast(kind))


def canonicalise(df: DataFrame, labelled: bool = True, step: bool | None = None) -> DataFrame:
    """Aliases, types and the ``us`` time key in one plan."""
    source = detect_column(combine_date_time(df).columns, "timestamp")
    if step is None and source is not None and source.lower() == "step":
        step = True
    typed = coerce_types(resolve_aliases(df, labelled), step)
    return typed.withColumn("us", F.unix_micros("ts"))
