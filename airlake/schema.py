"""Canonical city-day schema and conformance helpers (NaN -> NULL, typed nulls)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airlake.reference import CITY_DAY_RENAME, CONC_COLUMNS, HOURLY_RENAME  # noqa: F401

CITY_DAY_COLUMNS: tuple[str, ...] = ("city", "date", *CONC_COLUMNS, "aqi", "aqi_bucket")

CITY_DAY_SCHEMA = T.StructType(
    [T.StructField("city", T.StringType()), T.StructField("date", T.DateType())]
    + [T.StructField(c, T.DoubleType()) for c in CONC_COLUMNS]
    + [T.StructField("aqi", T.DoubleType()), T.StructField("aqi_bucket", T.StringType())]
)


def nan_to_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Replace NaN by NULL in double columns (Spark treats NaN as a value)."""
    dbl = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    cols = [c for c in (columns or dbl) if c in dbl]
    return df.withColumns({c: F.when(~F.isnan(F.col(c)), F.col(c)) for c in cols}) if cols else df


def conform(df: DataFrame, columns: Sequence[str] = CITY_DAY_COLUMNS,
            schema: T.StructType = CITY_DAY_SCHEMA) -> DataFrame:
    """Project to the output schema; absent columns become typed NULLs."""
    types = {f.name: f.dataType for f in schema.fields}
    present = set(df.columns)
    return df.select([
        (F.col(c).cast(types[c]) if c in present else F.lit(None).cast(types[c])).alias(c)
        for c in columns
    ])
