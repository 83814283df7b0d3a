import datetime as dt

from airlake.schema import CITY_DAY_COLUMNS, CITY_DAY_SCHEMA


def city_day(spark, records):
    """Hand-written city-day rows: dicts with any canonical columns."""
    rows = []
    for r in records:
        r = dict(r)
        if isinstance(r.get("date"), str):
            r["date"] = dt.date.fromisoformat(r["date"])
        rows.append(tuple(float(r[c]) if isinstance(r.get(c), int) and c not in ("city", "date", "aqi_bucket")
                          else r.get(c) for c in CITY_DAY_COLUMNS))
    return spark.createDataFrame(rows, CITY_DAY_SCHEMA)
