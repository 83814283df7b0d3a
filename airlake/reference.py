"""Reference tables: breakpoints, seasons, buckets, limits, calendars.

Everything here is a small, fixed dimension. Operators turn these into
literal expressions (breakpoints, seasons, buckets) or into tiny DataFrames
that are broadcast by construction (calendars, candidates, city centres);
their size does not grow with the data.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES. These must equal the published definitions for results to
# agree; they are stated plainly and in their natural order.
# ---------------------------------------------------------------------------

# National AQI breakpoints per pollutant:
# (conc_low, conc_high, index_low, index_high). Concentrations in ug/m3,
# except CO in mg/m3. Order of pollutants is also the tie-break order for
# the responsible pollutant.
BREAKPOINTS: dict[str, list[tuple[float, float, float, float]]] = {
    "PM2.5": [(0, 30, 0, 50), (30, 60, 50, 100), (60, 90, 100, 200),
              (90, 120, 200, 300), (120, 250, 300, 400), (250, 500, 400, 500)],
    "PM10": [(0, 50, 0, 50), (50, 100, 50, 100), (100, 250, 100, 200),
             (250, 350, 200, 300), (350, 430, 300, 400), (430, 600, 400, 500)],
    "NO2": [(0, 40, 0, 50), (40, 80, 50, 100), (80, 180, 100, 200),
            (180, 280, 200, 300), (280, 400, 300, 400), (400, 500, 400, 500)],
    "CO": [(0, 1, 0, 50), (1, 2, 50, 100), (2, 10, 100, 200),
           (10, 17, 200, 300), (17, 34, 300, 400), (34, 50, 400, 500)],
    "SO2": [(0, 40, 0, 50), (40, 80, 50, 100), (80, 380, 100, 200),
            (380, 800, 200, 300), (800, 1600, 300, 400), (1600, 2000, 400, 500)],
    "O3": [(0, 50, 0, 50), (50, 100, 50, 100), (100, 168, 100, 200),
           (168, 208, 200, 300), (208, 748, 300, 400), (748, 1000, 400, 500)],
    "NH3": [(0, 200, 0, 50), (200, 400, 50, 100), (400, 800, 100, 200),
            (800, 1200, 200, 300), (1200, 1800, 300, 400), (1800, 2400, 400, 500)],
}

# AQI buckets: upper edge (inclusive) and label; above the last edge: Severe.
AQI_BUCKETS: list[tuple[float, str]] = [
    (50, "Good"), (100, "Satisfactory"), (200, "Moderate"),
    (300, "Poor"), (400, "Very Poor"),
]
AQI_TOP_BUCKET = "Severe"

# Meteorological seasons by calendar month, and their display order.
SEASON_MONTHS: dict[str, tuple[int, ...]] = {
    "Winter": (12, 1, 2),
    "Summer": (3, 4, 5, 6),
    "Monsoon": (7, 8, 9),
    "Post-monsoon": (10, 11),
}
SEASON_ORDER: tuple[str, ...] = ("Winter", "Summer", "Monsoon", "Post-monsoon")

MONTH_NAMES: tuple[str, ...] = (
    "Jan", "Feb", "Mar", "Apr", "May", "Jun",
    "Jul", "Aug", "Sep", "Oct", "Nov", "Dec",
)

# Festival (Diwali, main day) dates per year.
FESTIVAL_DATES: dict[int, str] = {
    2015: "2015-11-11",
    2016: "2016-10-30",
    2017: "2017-10-19",
    2018: "2018-11-07",
    2019: "2019-10-27",
    2020: "2020-11-14",
    2021: "2021-11-04",
    2022: "2022-10-24",
}

# Lockdown window and the post-monsoon burning season.
LOCKDOWN_MONTHS: tuple[int, ...] = (4, 5)
LOCKDOWN_YEAR: int = 2020
STUBBLE_MONTHS: tuple[int, ...] = (10, 11)

# PM2.5 health limits (ug/m3) and the cigarette rule of thumb.
WHO_PM25_24H = 15.0
INDIA_PM25_24H = 60.0
WHO_PM25_ANNUAL = 5.0
INDIA_PM25_ANNUAL = 40.0
PM25_PER_CIGARETTE = 22.0

# Unit conversion for the sensor feed: ppb -> ug/m3 (CO -> mg/m3) at 25 C.
PPB_FACTOR: dict[str, float] = {"SO2": 2.62, "NO2": 1.88, "O3": 1.96, "NO": 1.23, "CO": 0.001145}
PPM_TO_PPB = 1000.0

# Sensor search: radius, activity cut-off, stations kept per city.
RADIUS_M = 25000.0
MAX_STATIONS = 20

# Forecast candidates: ((p, d, q), (P, D, Q, m)).
CANDIDATE_ORDERS: tuple[tuple[tuple[int, int, int], tuple[int, int, int, int]], ...] = (
    ((1, 1, 1), (0, 0, 0, 0)),
    ((2, 1, 2), (0, 0, 0, 0)),
    ((1, 1, 1), (1, 0, 1, 7)),
    ((2, 1, 1), (1, 0, 1, 7)),
    ((1, 1, 2), (0, 1, 1, 7)),
    ((2, 1, 2), (1, 0, 1, 7)),
)

# Minimum number of sub-indices for an AQI to be defined.
MIN_SUB_INDICES = 3

# Canonical pollutant label -> Spark column name (a dot needs backticks).
POLLUTANT_COLUMNS: dict[str, str] = {
    "PM2.5": "pm25", "PM10": "pm10", "NO": "no", "NO2": "no2", "NOx": "nox",
    "NH3": "nh3", "CO": "co", "SO2": "so2", "O3": "o3", "Benzene": "benzene",
}
CONC_COLUMNS: tuple[str, ...] = tuple(POLLUTANT_COLUMNS.values())

# AQI input sets (see the notes on the three sets in the README).
ATTRIBUTION_SET: tuple[str, ...] = tuple(BREAKPOINTS)  # all seven, table order
STATION_SET: tuple[str, ...] = ("PM2.5", "PM10", "NO2", "SO2", "NH3", "O3", "CO")
SPLICE_SET: tuple[str, ...] = ("PM2.5", "PM10", "NO2", "O3", "SO2", "CO")
FEED_SET: tuple[str, ...] = ("PM2.5", "PM10", "NO2", "SO2", "O3", "CO")
TRUSTED_FEED: tuple[str, ...] = ("PM2.5", "PM10", "NO2", "O3")

# Feed parameter name -> canonical label.
FEED_PARAMS: dict[str, str] = {
    "pm25": "PM2.5", "pm10": "PM10", "no2": "NO2", "no": "NO",
    "so2": "SO2", "co": "CO", "o3": "O3",
}

# Raw header names of the city-day CSV and of hourly station files -> ours.
CITY_DAY_RENAME = {
    "City": "city", "Date": "date", "PM2.5": "pm25", "PM10": "pm10", "NO": "no",
    "NO2": "no2", "NOx": "nox", "NH3": "nh3", "CO": "co", "SO2": "so2", "O3": "o3",
    "Benzene": "benzene", "AQI": "aqi", "AQI_Bucket": "aqi_bucket",
}
HOURLY_RENAME = {
    "PM2.5 (ug/m3)": "pm25", "PM10 (ug/m3)": "pm10", "NO (ug/m3)": "no",
    "NO2 (ug/m3)": "no2", "NOx (ppb)": "nox", "NH3 (ug/m3)": "nh3",
    "SO2 (ug/m3)": "so2", "CO (mg/m3)": "co", "Ozone (ug/m3)": "o3",
    "Benzene (ug/m3)": "benzene",
}

# ---------------------------------------------------------------------------
# End of fixed values.
# ---------------------------------------------------------------------------


def col_of(label: str) -> str:
    """Spark column name of a pollutant label (``PM2.5`` -> ``pm25``)."""
    return POLLUTANT_COLUMNS.get(label, label.lower())


def season_of_month(m: int) -> str:
    for name, months in SEASON_MONTHS.items():
        if m in months:
            return name
    raise ValueError(m)
