"""Defaults of the public functions; fixed values of the method."""

from __future__ import annotations

from dataclasses import dataclass, field

CELL = ("lat_idx", "lon_idx")


@dataclass(frozen=True)
class Settings:
    base_period: tuple[int, int] = (1983, 2012)
    min_duration: int = 5
    max_gap: int = 2
    percentile: float = 0.90
    land_percentile: float | None = None
    land_min_valid: int = 730
    max_distance: float = 0.5
    wet_bulb: float = 25.5
    specific_humidity: float = 19.0
    bootstraps: int = 1000
    interval: tuple[float, float] = (0.05, 0.95)
    thresholds: tuple[int, ...] = tuple(range(10, 100, 5))
    buffer_km: float = 100.0
    members: tuple[str, ...] = field(default_factory=lambda: tuple(f"{i:03d}" for i in range(1, 21)))


#: Boxes (name, lat0, lat1, lon0, lon1), inclusive.
COASTS = (("Mediterranean", 30.0, 45.0, 5.0, 35.0), ("BlackSea", 40.0, 47.0, 28.0, 42.0), ("Baltic", 53.0, 66.0, 10.0, 30.0), ("Atlantic", 35.0, 60.0, -10.0, 5.0))
PANELS = (("j", 30.0, 47.0, 5.0, 42.0), ("k", 53.0, 66.0, 10.0, 30.0), ("l", 30.0, 72.0, -15.0, 45.0))
EUROPE = ("Europe", 30.0, 72.0, -15.0, 45.0)
#: First and last year, and months, of trends.
TREND_YEARS = {"sst": (1994, 2023), "evaporation": (1991, 2020), "sh": (1994, 2023)}
TREND_MONTHS = (7, 8, 9)
MAP_YEARS = (2003, 2006, 2010, 2012, 2018, 2019, 2020, 2022, 2023)
EXPECTED_AXES = {"sst": (15340, 720, 1440), "t2m": (14245, 201, 464)}
EARTH_KM = 6371.0
