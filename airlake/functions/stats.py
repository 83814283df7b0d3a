"""Guarded statistics that behave under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pearson(x: Column | str, y: Column | str) -> Column:
    """Pearson r as covar_pop / (stddev_pop * stddev_pop); NULL when either
    side is constant or there is a single row (``corr`` raises under ANSI)."""
    x = F.col(x) if isinstance(x, str) else x
    y = F.col(y) if isinstance(y, str) else y
    den = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(den > 0, F.covar_pop(x, y) / den)
