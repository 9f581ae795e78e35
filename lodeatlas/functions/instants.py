"""Instants written as RFC 3339 text, compared as points in time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def instant_micros(text: Column) -> Column:
    """Microseconds since the epoch of an RFC 3339 text; null if it is no instant.

    The zone offset in the text counts, so ``10:00:00+01:00`` is older than ``09:30:00Z``.
    """
    return F.unix_micros(F.try_to_timestamp(F.trim(text)))
