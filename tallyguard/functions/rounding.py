"""Decimal rounding of the exact binary value, as text formatting does it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A double in [0, 128] times this is a whole number below 2**62, down to 2**-55.
_SCALE = 2**55


def _units(x: Column, digits: int, ties: str) -> Column:
    """``x`` in units of the last digit, rounded on its exact value ('even' or 'up')."""
    scaled = (x * F.lit(float(_SCALE))).cast("decimal(20,0)") * F.lit(10**digits).cast(
        "decimal(10,0)"
    )
    whole = F.call_function("div", scaled, F.lit(_SCALE).cast("decimal(20,0)"))
    rest = (scaled % F.lit(_SCALE).cast("decimal(20,0)")).cast("bigint")
    half = _SCALE // 2
    tie_up = F.lit(True) if ties == "up" else (whole % 2 == 1)
    return whole + F.when((rest > half) | ((rest == half) & tie_up), 1).otherwise(0)


def round_exact(x: Column, digits: int, ties: str = "even") -> Column:
    """Non-negative ``x`` (at most 128) rounded to ``digits`` decimals."""
    return _units(x, digits, ties) / F.lit(float(10**digits))


def fixed_text(x: Column, digits: int = 2, ties: str = "even") -> Column:
    """Text of non-negative ``x`` with exactly ``digits`` decimals."""
    units = _units(x, digits, ties).cast("bigint")
    whole = F.call_function("div", units, F.lit(10**digits)).cast("string")
    tail = F.lpad((units % 10**digits).cast("string"), digits, "0")
    return F.concat(whole, F.lit("."), tail)
