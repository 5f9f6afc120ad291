"""Calendar days of the session for windows of a stream.

A window of one day follows the UTC day.  The clock is therefore shifted to
the session's wall time before the window and back after it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wall_clock(ts: Column) -> Column:
    return F.from_utc_timestamp(ts, F.current_timezone())


def day_of(window: str = "window") -> Column:
    return F.to_date(F.to_utc_timestamp(F.col(f"{window}.start"), F.current_timezone()))
