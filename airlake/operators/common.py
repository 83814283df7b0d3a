"""Small helpers shared by the operators: city filter, value projection,
sorting by the reference's display orders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlake.functions.calendar import season_of_date, season_rank


def for_cities(df: DataFrame, cities: Sequence[str] | None) -> DataFrame:
    """Optional city filter (pushed down by Catalyst)."""
    return df if cities is None else df.where(F.col("city").isin(list(cities)))


def observed(df: DataFrame, col: str, cities: Sequence[str] | None = None,
             extra: Sequence[str] = ()) -> DataFrame:
    """(city, date, value) rows where ``col`` is present."""
    return (for_cities(df, cities)
            .select("city", "date", *extra, F.col(col).alias("value"))
            .where(F.col("value").isNotNull()))


def with_season(df: DataFrame, date_col: str = "date") -> DataFrame:
    return df.withColumn("season", season_of_date(date_col))


def season_sorted(df: DataFrame, *then: F.Column) -> DataFrame:
    return df.orderBy(F.col("city"), season_rank("season"), *then)


def estimated_bytes(df: DataFrame) -> int:
    """Optimizer size estimate of a plan (no job is run)."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(size if isinstance(size, int) else size.toString())


def broadcast_limit(spark) -> int:
    raw = spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760")
    try:
        return int(raw)
    except ValueError:  # e.g. "10MB"
        units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
        r = raw.strip().lower().rstrip("b")
        return int(float(r[:-1]) * units[r[-1]]) if r and r[-1] in units else 10 << 20


def broadcast_if_small(dim: DataFrame, probe: DataFrame | None = None) -> DataFrame:
    """Broadcast a dimension only when its measured size is under the
    broadcast threshold; otherwise return it unchanged, so the planner uses a
    shuffled join (and AQE may still convert it at run time).

    ``probe`` is the plan whose size bounds ``dim`` (e.g. the projected base
    table of an N:1 lookup): the planner's estimate for a join of dimensions
    is a product of sizes and would wrongly reject small lookups, and then
    pick the fact side to broadcast instead.
    """
    size = estimated_bytes(probe if probe is not None else dim)
    limit = broadcast_limit(dim.sparkSession)
    return F.broadcast(dim) if 0 <= size <= limit else dim
