"""Source attribution: sub-indices, responsible pollutant, shares by season,
dominant pollutant, a fixed season axis, and validation against the published
index (A12-A14, J8, P9-P12, W7, W8)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airlake.functions.aqi import largest, n_available, responsible_of, si_name, sub_index
from airlake.functions.stats import pearson
from airlake.reference import ATTRIBUTION_SET, MIN_SUB_INDICES, SEASON_ORDER, col_of
from airlake.operators.common import for_cities, season_sorted, with_season


def compute_sub_indices(df: DataFrame, pollutants: Sequence[str] = ATTRIBUTION_SET,
                        cities: Sequence[str] | None = None,
                        min_count: int = MIN_SUB_INDICES) -> DataFrame:
    """Per city-day: published ``aqi``, one ``si_*`` column per pollutant present,
    ``computed_aqi`` (max sub-index) and ``responsible`` (first max in table
    order). Days with fewer than ``min_count`` sub-indices are dropped. One
    narrow projection and filter: no shuffle."""
    present = [p for p in pollutants if col_of(p) in df.columns]
    sis = [sub_index(col_of(p), p).alias(si_name(p)) for p in present]
    enough = for_cities(df, cities).where(n_available([col_of(p) for p in present]) >= min_count)
    return (enough.select("city", "date", "aqi", *sis)
            .withColumn("computed_aqi", largest([si_name(p) for p in present]))
            .withColumn("responsible", responsible_of(present, "computed_aqi")))


def validate_computed_aqi(attrib: DataFrame) -> DataFrame:
    """Per city: n, Pearson r (guarded), MAE and share within 10% of the
    published AQI, over days where both are present."""
    both = attrib.where(F.col("aqi").isNotNull() & F.col("computed_aqi").isNotNull())
    err = F.col("computed_aqi") - F.col("aqi")
    return both.groupBy("city").agg(
        F.count(F.lit(1)).alias("n"),
        pearson("computed_aqi", "aqi").alias("correlation"),
        F.avg(F.abs(err)).alias("mae"),
        (F.avg((F.abs(err) <= F.lit(0.10) * F.col("aqi")).cast("double")) * 100.0).alias("within_10pct"),
    )


def seasonal_attribution(df: DataFrame, bad_only: bool = False, bad_threshold: float = 200.0,
                         cities: Sequence[str] | None = None, attrib: DataFrame | None = None,
                         order: bool = True) -> DataFrame:
    """Share (%) of days each pollutant is responsible, by city and season."""
    att = with_season(attrib if attrib is not None else compute_sub_indices(df, cities=cities))
    if bad_only:
        att = att.where(F.col("computed_aqi") > F.lit(float(bad_threshold)))
    counts = att.groupBy("city", "season", "responsible").agg(F.count(F.lit(1)).alias("n_days"))
    total = F.sum("n_days").over(Window.partitionBy("city", "season"))
    out = counts.withColumn("share_pct", F.col("n_days") * 100.0 / total)
    return season_sorted(out, F.desc("share_pct"), F.col("responsible")) if order else out


def dominant_pollutant_by_season(shares: DataFrame, order: bool = True) -> DataFrame:
    """Most responsible pollutant per (city, season); ties to the label order."""
    w = Window.partitionBy("city", "season").orderBy(F.desc("share_pct"), F.col("responsible"))
    out = (shares.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1)
           .select("city", "season", "responsible", "share_pct", "n_days"))
    return season_sorted(out) if order else out


def attribution_grid(shares: DataFrame, order: bool = True) -> DataFrame:
    """Every (city, pollutant seen) on all four seasons; missing shares stay
    NULL. One aggregate per (city, pollutant) collects its seasons into a map
    (at most four entries), then the fixed axis is exploded and looked up:
    no self-join, so the shares are computed once."""
    g = shares.groupBy("city", "responsible").agg(F.map_from_entries(F.collect_list(
        F.struct("season", F.struct("share_pct", "n_days")))).alias("_m"))
    axis = F.explode(F.array(*[F.lit(s) for s in SEASON_ORDER])).alias("season")
    x = g.select("city", "responsible", "_m", axis)
    out = x.select("city", "season", "responsible",
                   F.try_element_at("_m", F.col("season")).alias("_v")).select(
        "city", "season", "responsible", F.col("_v.share_pct").alias("share_pct"),
        F.col("_v.n_days").alias("n_days"))
    return season_sorted(out, F.col("responsible")) if order else out
