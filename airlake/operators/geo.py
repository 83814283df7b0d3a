"""Nearby active sensors per city.

Radius search as an equi-join on grid cells: each centre is expanded to the
cells its bounding box touches (a handful per centre), locations get their
own cell, the join is a hash join on (cell_lat, cell_lon), and the exact
haversine distance filters the candidates. No nested-loop join, and the
work is linear in locations.

Cells wrap around: their number along a parallel is fixed, and a longitude's
cell is taken modulo that number, so a radius across the 180th meridian finds
the cells on its other side. Where a radius comes within a degree of a pole, a
box has no bounded width in longitude, and the centre covers whole parallels.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airlake.operators.common import broadcast_limit, estimated_bytes
from airlake.reference import FEED_PARAMS, MAX_STATIONS, RADIUS_M

EARTH_RADIUS_M = 6371000.0
MIN_M_PER_DEG_LAT = 110574.0  # smallest metres per degree: the box never undershoots


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = (F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2)
         + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2))
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(a))


def nearby_sensors(locations: DataFrame, centers: DataFrame, active_from: dt.datetime,
                   radius_m: float = RADIUS_M, max_per_city: int = MAX_STATIONS,
                   cell_deg: float = 0.25) -> DataFrame:
    """Locations within ``radius_m`` of each city centre and seen since
    ``active_from``; newest ``max_per_city`` per city (ties by id)."""
    dlat = radius_m / MIN_M_PER_DEG_LAT
    around = round(360 / cell_deg)
    if abs(around * cell_deg - 360) > 1e-9:
        raise ValueError("cell_deg must divide 360 degrees")
    lat, lon = F.col("lat"), F.col("lon")
    reach = F.abs(lat) + F.lit(dlat)
    dlon = F.when(reach < 89, F.lit(dlat) / F.cos(F.radians(reach))).otherwise(F.lit(180.0))
    cell = F.lit(cell_deg)
    # centres -> covering cells: (#centres x a few cells, a circle of them at the poles) rows
    low = F.floor((lon - dlon) / cell)
    cc = centers.select(
        "city", F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon"),
        F.explode(F.sequence(F.floor((lat - dlat) / cell), F.floor((lat + dlat) / cell))).alias("cell_lat"),
        low.alias("_lo"), F.least(F.floor((lon + dlon) / cell), low + (around - 1)).alias("_hi"),
    ).select("city", "c_lat", "c_lon", "cell_lat", F.explode(F.sequence("_lo", "_hi")).alias("_cell"))
    cc = cc.select("city", "c_lat", "c_lon", "cell_lat", F.pmod("_cell", F.lit(around)).alias("cell_lon"))
    since = F.lit(str(active_from)).cast(locations.schema["last_seen"].dataType)
    locs = (locations.where(F.col("last_seen") >= since)
            .select("location_id", "lat", "lon", "last_seen", F.floor(lat / cell).alias("cell_lat"),
                    F.pmod(F.floor(lon / cell), F.lit(around)).alias("cell_lon")))
    # broadcast only if the cells, at most a circle of them in each row of cells, are under the threshold
    most_cells = (int(2 * dlat / cell_deg) + 2) * around
    small = estimated_bytes(centers) * most_cells <= broadcast_limit(centers.sparkSession)
    j = locs.join(F.broadcast(cc) if small else cc.hint("merge"), ["cell_lat", "cell_lon"])
    j = j.withColumn("distance_m", haversine_m(F.col("c_lat"), F.col("c_lon"), lat, lon))
    j = j.where(F.col("distance_m") <= F.lit(float(radius_m)))
    w = Window.partitionBy("city").orderBy(F.desc("last_seen"), F.col("location_id"))
    return (j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max_per_city)
            .select("city", "location_id", (F.col("distance_m") / 1000.0).alias("distance_km"),
                    "last_seen", "rank"))


def active_sensors(stations: DataFrame, sensors: DataFrame, active_from: dt.datetime) -> DataFrame:
    """Sensors of the ``nearby_sensors`` stations from the catalogue ``sensors``
    (location_id, sensor_id, param, unit, last_seen): supported parameters
    that were themselves seen since ``active_from``. Stations without such a
    sensor give no row."""
    since = F.lit(str(active_from)).cast(sensors.schema["last_seen"].dataType)
    label = F.create_map(*[F.lit(x) for pair in FEED_PARAMS.items() for x in pair])
    active = (sensors.where(F.col("param").isin(list(FEED_PARAMS)) & (F.col("last_seen") >= since))
              .select("location_id", "sensor_id", label[F.col("param")].alias("pollutant"), "unit", "last_seen"))
    return stations.select("city", "location_id", "rank").join(active, "location_id").select(
        "city", "location_id", "rank", "sensor_id", "pollutant", "unit", "last_seen")
