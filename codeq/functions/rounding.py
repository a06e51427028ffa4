"""Rounding from the exact binary value of a double.

Spark's ``round`` and ``bround`` round the shortest decimal text of a double, so 82.35, which is
stored a little below 82.35, becomes 82.4. Scores are averages of halves and meet such values all
the time, hence this one: it looks at the bits and gives 82.3.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_FRACTION_BITS = 52


def round_exact(value: Column, digits: int, ties: str = "even") -> Column:
    """Round a double >= 0 to ``digits`` decimals; an exact tie goes to the even digit or up.

    Give it a plain column where you can: the value is named several times.
    """
    scale = 10**digits
    whole = F.floor(value)
    bits = (value - whole) * float(2**_FRACTION_BITS)
    high = F.floor(bits)
    scaled = high * F.lit(scale)
    units = F.shiftright(scaled, _FRACTION_BITS)
    left = scaled - F.shiftleft(units, _FRACTION_BITS)
    excess = (left - F.lit(2 ** (_FRACTION_BITS - 1))).cast("double") + (bits - high) * scale
    floor_units = whole * F.lit(scale) + units
    on_tie = (floor_units % 2 == 1) if ties == "even" else F.lit(True)
    up = (excess > 0) | ((excess == 0) & on_tie)
    return (floor_units + up.cast("long")) / F.lit(float(scale))


def fixed_text(value: Column, digits: int) -> Column:
    """A double >= 0 as text with ``digits`` decimals, ties up."""
    return F.format_string(f"%.{digits}f", round_exact(value, digits, ties="up"))
