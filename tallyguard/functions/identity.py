"""Identifier expressions: hashing, masking, synthetic handles, endpoint choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURE_HASH_LENGTH = 12


def hash_id(column: str | Column, length: int = 64) -> Column:
    """Leading ``length`` hex digits of SHA-256; a missing id hashes as 'nan'."""
    col = F.col(column) if isinstance(column, str) else column
    digest = F.sha2(F.coalesce(col.cast("string"), F.lit("nan")), 256)
    return digest if length == 64 else F.substring(digest, 1, length)


def hash_pii(df: DataFrame, length: int = FEATURE_HASH_LENGTH) -> DataFrame:
    """Replace sender_id / receiver_id by sender_hash / receiver_hash."""
    return (
        df.withColumn("sender_hash", hash_id("sender_id", length))
        .withColumn("receiver_hash", hash_id("receiver_id", length))
        .drop("sender_id", "receiver_id")
    )


def mask_vpa(vpa: str | Column) -> Column:
    """Mask the middle of a mobile-number handle (10 or more digits before '@')."""
    return F.regexp_replace(vpa, r"^(\d{2})\d{6,}(\d{2})@", "$1****$2@")


def slug(text: str | Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def bank_to_vpa(bank: str | Column, surrogate: str | Column) -> Column:
    """'<bank slug>.<first six of the surrogate>@upi'."""
    tail = F.coalesce(F.nullif(F.substring(surrogate, 1, 6), F.lit("")), F.lit("demo"))
    return F.concat(slug(bank), F.lit("."), tail, F.lit("@upi"))


def first_filled(columns: list[str | Column], default: str) -> Column:
    """First value that is neither null nor empty, else ``default``."""
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in cols], F.lit(default))
