"""Column expressions shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EARTH_KM


def missing_to_null(c: Column) -> Column:
    """NaN compares above every number in Spark, so missing values are null from the door on."""
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def unified_longitude(lon: Column) -> Column:
    """0-360 to -180-180; 180 stays."""
    return F.when(lon > 180, lon - 360).otherwise(lon)


def kelvin_to_celsius(c: Column) -> Column:
    return c - F.lit(273.15)


def cos_latitude(lat: Column) -> Column:
    return F.cos(F.radians(lat))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Missing values carry no weight; without weight the mean is null."""
    return F.try_divide(F.sum(value * weight), F.sum(F.when(value.isNotNull(), weight)))


def ratio(over: Column, under: Column) -> Column:
    """over / under where under is positive, else null."""
    return F.when(under > 0, over / under)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return F.lit(2 * EARTH_KM) * F.asin(F.least(F.sqrt(a), F.lit(1.0)))


def in_box(lat0, lat1, lon0, lon1, lat: Column, lon: Column) -> Column:
    return lat.between(lat0, lat1) & lon.between(lon0, lon1)


def same(keys, a: str, b: str) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{k}") == F.col(f"{b}.{k}") for k in keys])


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])
