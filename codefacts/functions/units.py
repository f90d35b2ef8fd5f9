"""Units of measurements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds(micros: Column, places: int | None = None) -> Column:
    """Microseconds in seconds, rounded to a number of places if one is given."""
    return micros / 1e6 if places is None else F.round(micros / 1e6, places)
