"""Humidity and wet-bulb temperature from air temperature, dew point (both in Celsius) and pressure (Pa)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def vapour_pressure(t: Column) -> Column:
    return F.lit(6.112) * F.exp(F.lit(17.67) * t / (t + F.lit(243.5)))


def relative_humidity(t: Column, td: Column) -> Column:
    rh = vapour_pressure(td) / vapour_pressure(t) * F.lit(100.0)
    return F.when(rh.isNotNull(), F.greatest(F.least(rh, F.lit(100.0)), F.lit(0.0)))


def wet_bulb_stull(t: Column, td: Column) -> Column:
    rh = relative_humidity(t, td)
    return (
        t * F.atan(F.lit(0.151977) * F.sqrt(rh + F.lit(8.313659)))
        + F.atan(t + rh)
        - F.atan(rh - F.lit(1.676331))
        + F.lit(0.00391838) * F.pow(rh, F.lit(1.5)) * F.atan(F.lit(0.023101) * rh)
        - F.lit(4.686035)
    )


def wet_bulb_closed(t: Column, td: Column, sp: Column) -> Column:
    """The psychrometric form; an iteration over it never reads its previous value, so one step is all of them."""
    gamma = F.lit(0.00066) * (F.lit(1.0) + F.lit(0.00115) * vapour_pressure(td))
    return t - (t - td) / (F.lit(1.0) + gamma * (sp / F.lit(100.0)) / F.lit(10.0))


def wet_bulb(t: Column, td: Column, sp: Column, method: str = "iterative") -> Column:
    if method == "stull":
        return wet_bulb_stull(t, td)
    if method == "iterative":
        return wet_bulb_closed(t, td, sp)
    raise ValueError(f"unknown method: {method}")


def specific_humidity(td: Column, sp: Column) -> Column:
    e, p = vapour_pressure(td), sp / F.lit(100.0)
    return F.lit(1000.0) * (F.lit(0.622) * e / (p - F.lit(0.378) * e))
