"""Schemas of the tables that stages exchange; an empty result keeps its schema."""

from pyspark.sql.types import DateType, DoubleType, IntegerType, LongType, StringType, StructField, StructType


def _schema(**kinds) -> StructType:
    return StructType([StructField(name, kind()) for name, kind in kinds.items()])


I, L, D, S, T = IntegerType, LongType, DoubleType, StringType, DateType
GRID = _schema(time=T, lat_idx=I, lon_idx=I, lat=D, lon=D, v=D)
CLIM = _schema(lat_idx=I, lon_idx=I, doy=I, thresh=D)
EVENTS = _schema(lat_idx=I, lon_idx=I, lat=D, lon=D, event_start=T, event_end=T, duration=I)
PAIRS = _schema(land_lat_idx=I, land_lon_idx=I, ocean_lat_idx=I, ocean_lon_idx=I, land_lat=D, land_lon=D, ocean_lat=D, ocean_lon=D, dist_deg=D)
DAILY = _schema(lat_idx=I, lon_idx=I, time=T)
ANNUAL = _schema(year=I, lat_idx=I, lon_idx=I, n_days=L)
REGIONS = _schema(name=S, lat0=D, lat1=D, lon0=D, lon1=D)
