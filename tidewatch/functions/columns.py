"""Small column helpers that pin down NULL handling in one place."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_REQDATE = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(\.\d+)?$"


def sum0(col: Column | str) -> Column:
    """Sum that is 0, not NULL, for a group without values."""
    return F.coalesce(F.sum(col), F.lit(0))


def ratio(part: Column | str, whole: Column | str) -> Column:
    """``part / whole`` as double; NULL where ``whole`` is 0."""
    part = F.col(part) if isinstance(part, str) else part
    whole = F.col(whole) if isinstance(whole, str) else whole
    return part.cast("double") / F.when(whole != 0, whole.cast("double"))


def parse_reqdate(col: Column | str) -> Column:
    """Request time text to TIMESTAMP_NTZ; anything else, date-only included, is NULL."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c.rlike(_REQDATE), c.try_cast("timestamp_ntz"))
