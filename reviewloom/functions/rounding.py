"""Rounding that agrees with IEEE round-half-even on the exact binary value.

Spark's ``round`` rounds the shortest decimal form of a double (0.15 -> 0.2),
while reports are defined by the exact value of the double (0.15 is slightly
below the tie, so it becomes 0.1).  ``round_exact`` finds the exact product of
the value and the power of ten with the two-product method, so ties are real
ties and go to the even neighbour.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewloom.functions.binding import let

_SPLITTER = 134217729.0  # 2**27 + 1, splits a double into two 26-bit halves


def round_exact(value: Column, digits: int, ties: str = "even") -> Column:
    """Round a double to ``digits`` decimals on its exact value.

    Ties go to the even neighbour, or with ``ties="up"`` to the larger one (the
    rule of the dashboard's number formats).
    """
    scale = F.lit(float(10**digits))

    def rounded(v: Column) -> Column:
        x = F.abs(v)
        t = x * F.lit(_SPLITTER)
        high = t - (t - x)
        low = x - high
        product = x * scale
        error = (high * scale - product) + low * scale
        whole = F.floor(product)
        rest = product - whole
        tie_up = F.lit(True) if ties == "up" else whole % 2 == 1
        up = (rest > 0.5) | ((rest == 0.5) & ((error > 0) | ((error == 0) & tie_up)))
        out = (whole + F.when(up, 1).otherwise(0)).cast("double") / scale
        return F.when(v < 0, -out).otherwise(out)

    return let(value.cast("double"), rounded)


def percent(part: Column, total: Column) -> Column:
    """``part / total * 100``, 0 for an empty total."""
    return F.when(total == 0, F.lit(0.0)).otherwise(
        part.cast("double") / F.when(total == 0, F.lit(1.0)).otherwise(total.cast("double")) * 100.0
    )


def percentage(part: Column, total: Column) -> Column:
    """Share in percent with two decimals, 0 for an empty total."""
    return round_exact(percent(part, total), 2)


def fixed(value: Column, digits: int = 1, ties: str = "even") -> Column:
    """Text with a fixed number of decimals, rounded on the exact value."""
    return F.format_string(f"%.{digits}f", round_exact(value, digits, ties))


def plain(value: Column) -> Column:
    """Shortest text of an already rounded double (``0.0``, ``12.5``)."""
    return value.cast("string")
