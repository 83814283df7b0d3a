"""Three-source splice by priority.

Sources are tagged and unioned, then reduced by one aggregate on
(city, date): one shuffle for any number of sources. (Two chained full outer
joins would cost more exchanges, since the coalesced key loses its
partitioning.) Every key of any source appears exactly once.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlake.functions.aqi import aqi_bucket, aqi_from_concentrations
from airlake.reference import CONC_COLUMNS, SPLICE_SET, TRUSTED_FEED, col_of
from airlake.schema import conform


def scan_bulletin(raw: DataFrame, cities: Sequence[str], after: dt.date) -> DataFrame:
    """Bulletin rows (date 'dd-MM-yyyy', area, aqi_value text) -> one row per
    (city, date) by mean; unparseable dates dropped, bad numbers missing."""
    d = F.to_date(F.try_to_timestamp(F.col("date"), F.lit("dd-MM-yyyy")))
    b = raw.select(F.col("area").alias("city"), d.alias("date"),
                   F.col("aqi_value").try_cast("double").alias("aqi"))
    b = b.where(F.col("city").isin(list(cities)) & F.col("date").isNotNull()
                & (F.col("date") > F.lit(after)))
    return b.groupBy("city", "date").agg(F.avg("aqi").alias("aqi"))


def _tagged(df: DataFrame, tag: str, cols: Sequence[str]) -> DataFrame:
    present = set(df.columns)
    return df.select("city", "date", F.lit(tag).alias("_src"), *[
        (F.col(c) if c in present else F.lit(None)).cast("double").alias(c) for c in cols])


def splice_sources(base: DataFrame, bulletin: DataFrame, recent: DataFrame,
                   trusted: Sequence[str] = TRUSTED_FEED, aqi_set: Sequence[str] = SPLICE_SET,
                   check_unique: bool = True) -> DataFrame:
    """Priority fill per (city, date):
    concentrations: base, then the recent feed for ``trusted`` pollutants only;
    AQI: base, then bulletin, then the AQI recomputed from the final
    concentrations (``aqi_set``), which fills every remaining hole.
    With ``check_unique``, a key repeated within base or recent fails the job
    (a silent pick would hide bad input)."""
    cols = [*CONC_COLUMNS, "aqi"]
    u = (_tagged(base, "base", cols).unionByName(_tagged(bulletin, "bulletin", cols))
         .unionByName(_tagged(recent, "recent", cols)))
    src = F.col("_src")
    trusted_cols = {col_of(p) for p in trusted}
    aggs = [F.max(F.when(src == "base", F.col(c))).alias(f"b_{c}") for c in cols]
    aggs += [F.max(F.when(src == "recent", F.col(c))).alias(f"r_{c}") for c in sorted(trusted_cols)]
    aggs += [F.max(F.when(src == "bulletin", F.col("aqi"))).alias("u_aqi"),
             F.count_if(src == "base").alias("_nb"), F.count_if(src == "recent").alias("_nr")]
    g = u.groupBy("city", "date").agg(*aggs)
    if check_unique:
        dup = (F.col("_nb") > 1) | (F.col("_nr") > 1)
        g = g.where(F.assert_true(~dup, F.lit("duplicate (city, date) in base or recent source")).isNull())
    conc = {c: (F.coalesce(F.col(f"b_{c}"), F.col(f"r_{c}")) if c in trusted_cols else F.col(f"b_{c}"))
            for c in CONC_COLUMNS}
    out = g.select("city", "date", *[v.alias(c) for c, v in conc.items()], "b_aqi", "u_aqi")
    out = out.withColumn("aqi", F.coalesce("b_aqi", "u_aqi", aqi_from_concentrations(aqi_set)))
    return conform(out.withColumn("aqi_bucket", aqi_bucket("aqi")))
