"""Compute a value once per row and use it several times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, build: Callable[[Column], Column]) -> Column:
    """``build(value)`` with the value bound once, as a transform over one element.

    Keeps formulas that mention a value many times from repeating its whole
    expression in the plan and in the generated code.
    """
    return F.get(F.transform(F.array(value), build), F.lit(0))
