"""Unit conversion of sensor values to the index basis."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from airlake.reference import PPB_FACTOR, PPM_TO_PPB


def convert_units(value: Column | str, pollutant: Column | str, unit: Column | str) -> Column:
    """ppm -> x1000 -> ppb; ppb x molecular factor (1.0 when unlisted); other
    units pass through. Unit compared case-insensitively; missing stays missing."""
    v = F.col(value) if isinstance(value, str) else value
    p = F.col(pollutant) if isinstance(pollutant, str) else pollutant
    u = F.lower(F.col(unit) if isinstance(unit, str) else unit)
    factor = None
    for label, f in PPB_FACTOR.items():
        factor = (F.when(p == label, F.lit(f)) if factor is None
                  else factor.when(p == label, F.lit(f)))
    factor = factor.otherwise(F.lit(1.0))
    ppb = F.when(u == "ppm", v * F.lit(PPM_TO_PPB)).otherwise(v)
    return F.when(u.isin("ppb", "ppm"), ppb * factor).otherwise(v)
