"""Radius search across the 180th meridian and at the poles, against all pairs."""

import datetime as dt
import math

import numpy as np
import pytest

from airlake.operators.geo import EARTH_RADIUS_M, nearby_sensors

SEEN = dt.datetime(2024, 1, 1)


def distance(a, b):
    la, lo, lb, lp = map(math.radians, (*a, *b))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2
    return 2 * EARTH_RADIUS_M * math.asin(min(1.0, math.sqrt(h)))


CENTERS = [("east", 10.0, 179.95), ("west", 10.0, -179.99), ("north", 89.9, 20.0), ("south", -89.99, -170.0),
           ("high", 88.6, 179.0), ("plain", 48.1, 9.2)]


@pytest.mark.parametrize("radius", [25_000.0, 200_000.0])
def test_equals_all_pairs(spark, radius):
    rng = np.random.default_rng(1)
    near = [(la + float(rng.normal(0, 1)), lo + float(rng.normal(0, 2))) for _, la, lo in CENTERS for _ in range(60)]
    spots = [(max(-90.0, min(90.0, la)), (lo + 180) % 360 - 180) for la, lo in near]
    spots += [(float(la), float(lo)) for la in (-90, -89.95, 89.95, 90) for lo in range(-180, 181, 30)]
    spots += [(10.0, -179.99), (10.0, 179.9), (10.0, 180.0), (10.0, -180.0), (10.05, 180.2)]
    spots += [(la, lo + 0.01) for _, la, lo in CENTERS]
    locs = spark.createDataFrame([(i, la, lo, SEEN) for i, (la, lo) in enumerate(spots)],
                                 "location_id long, lat double, lon double, last_seen timestamp_ntz")
    centers = spark.createDataFrame(CENTERS, "city string, lat double, lon double")
    got = {(r.city, r.location_id) for r in nearby_sensors(locs, centers, SEEN, radius, max_per_city=10_000).collect()}
    want = {(c, i) for c, la, lo in CENTERS for i, p in enumerate(spots) if distance((la, lo), p) <= radius}
    assert got == want and {c for c, _ in want} == {c for c, _, _ in CENTERS}
    assert nearby_sensors(locs, centers, SEEN, radius, max_per_city=10_000).count() == len(got)  # each pair once


def test_cells_must_divide_the_circle(spark):
    centers = spark.createDataFrame(CENTERS, "city string, lat double, lon double")
    locs = spark.createDataFrame([(1, 0.0, 0.0, SEEN)], "location_id long, lat double, lon double, last_seen timestamp_ntz")
    with pytest.raises(ValueError):
        nearby_sensors(locs, centers, SEEN, cell_deg=0.7)
