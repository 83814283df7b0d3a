"""airlake: air-quality analytics as Spark DataFrame operators.

Every operator takes a city-day (or raw readings) DataFrame for all cities at
once and groups by city; per-city calls become an optional ``cities=`` filter.
"""

__version__ = "0.1.0"
