"""Column-expression helpers (JVM-side, codegen friendly)."""

from airlake.functions.aqi import (  # noqa: F401
    aqi_bucket, aqi_from_concentrations, aqi_of, n_available, responsible_of,
    si_name, sub_index, sub_index_sql,
)
from airlake.functions.calendar import (  # noqa: F401
    month_name, month_start, season_of, season_of_date, season_rank,
)
from airlake.functions.stats import pearson  # noqa: F401
from airlake.functions.units import convert_units  # noqa: F401
