"""Thresholds by cell and day of year, and the days that exceed them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CELL
from ..functions.columns import weighted_mean


def base_period(period: tuple[int, int], time: str = "time") -> Column:
    """As dates, so that the scan can prune."""
    return F.col(time).between(F.make_date(F.lit(period[0]), F.lit(1), F.lit(1)), F.make_date(F.lit(period[1]), F.lit(12), F.lit(31)))


def climatology(grid: DataFrame, period: tuple[int, int], percentile: float, keys: Sequence[str] = CELL, half_width: int = 0, approximate: int | None = None) -> DataFrame:
    """keys, doy, thresh: the linearly interpolated percentile of v in the base period, missing values skipped.

    half_width pools the days within so many days of the year (around its end). approximate: accuracy of
    percentile_approx, whose state is bounded, in place of the exact percentile; pooled ones are exact.
    """
    rows = grid.where(base_period(period)).select(*keys, F.dayofyear("time").alias("doy"), "v")
    if half_width:
        return _pooled(rows, percentile, keys, half_width)
    value = F.percentile_approx("v", percentile, approximate) if approximate else F.percentile("v", F.lit(percentile))
    return rows.groupBy(*keys, "doy").agg(value.alias("thresh"))


def _pooled(rows: DataFrame, percentile: float, keys: Sequence[str], half_width: int) -> DataFrame:
    """rows (keys, doy, v) to keys, doy, thresh over 2 * half_width + 1 days.

    Rows move once, to their cell. There each day's values are one array, and what a day needs are the arrays of its
    neighbours, which are dealt out and merged where they are.
    """
    days = rows.repartition(*keys).groupBy(*keys, "doy").agg(F.collect_list("v").alias("values"))
    around = F.transform(F.sequence(F.lit(-half_width), F.lit(half_width)), lambda k: F.pmod(F.col("doy") - 1 + k, F.lit(366)) + 1)
    merged = days.select(*keys, "values", F.explode(around).alias("doy")).groupBy(*keys, "doy").agg(F.array_sort(F.flatten(F.collect_list("values"))).alias("values"))
    return merged.select(*keys, "doy", quantile_of_sorted(F.col("values"), percentile).alias("thresh"))


def quantile_of_sorted(values: Column, q: float) -> Column:
    """The linearly interpolated quantile of a sorted array; null of an empty one."""
    at = (F.size(values) - 1) * F.lit(float(q))
    low, high = F.get(values, F.floor(at).cast("int")), F.get(values, F.ceil(at).cast("int"))
    return F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)


def threshold_slots(clim: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """keys, slots: the thresholds of a cell by day of year, 366 of them (null where it has none)."""
    by = clim.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("doy", "thresh"))).alias("_by"))
    return by.select(*keys, F.transform(F.sequence(F.lit(1), F.lit(366)), lambda d: F.try_element_at(F.col("_by"), d)).alias("slots"))


def exceedance(grid: DataFrame, clim: DataFrame, keys: Sequence[str] = CELL, placed: bool = False) -> DataFrame:
    """The rows of grid above their threshold, with doy and thresh; missing values never exceed.

    The day of year is held to the last one that clim has; placed: grid has it (doy) already, so that clim isn't gone
    through for it. Thresholds are joined by cell, one array each, so that rows which are to be grouped by cell
    afterwards move once.
    """
    rows = grid
    if not placed:
        last = clim.agg(F.max("doy").alias("_last"))
        rows = grid.crossJoin(F.broadcast(last)).withColumn("doy", F.least(F.dayofyear("time"), F.col("_last"))).drop("_last")  # one row
    found = rows.join(threshold_slots(clim, keys), list(keys)).withColumn("thresh", F.get("slots", F.col("doy") - 1)).drop("slots")
    return found.where(F.coalesce(F.col("v") > F.col("thresh"), F.lit(False)))


def enough_values(grid: DataFrame, least: int, keys: Sequence[str] = CELL) -> DataFrame:
    """The rows of cells with at least so many non-missing values."""
    if least <= 0:
        return grid
    return grid.join(grid.groupBy(*keys).agg(F.count("v").alias("_n")).where(F.col("_n") >= least).select(*keys), list(keys), "left_semi")


def regrid_mean(grid: DataFrame, size: float) -> DataFrame:
    """Means on a common grid of boxes of the given size."""
    box = {k: F.floor(F.col(c) / F.lit(size)).cast("int") for k, c in (("lat_idx", "lat"), ("lon_idx", "lon"))}
    return grid.groupBy("time", *[c.alias(k) for k, c in box.items()]).agg(F.avg("v").alias("v"))


def regrid_conservative(grid: DataFrame, size: float, step: tuple[float, float], by: Sequence[str] = ("time",)) -> DataFrame:
    """by, lat_idx, lon_idx, v, area: means on boxes of `size` degrees, weighted by the area that cells share with them.

    Cells are step[0] by step[1] degrees around lat, lon. Each goes to the boxes that it overlaps, a few, with the shared
    area on the unit sphere; sums are taken before anything moves. Boxes are counted from 0 degrees and from the poles
    inwards (lat_idx 0 begins at -90), longitudes go round. area is that of the parts with a value, so the sum of
    v * area over boxes is that of the cells; parts without a value have no weight.
    """
    size_, n = F.lit(float(size)), round(360 / size)
    if abs(n * size - 360) > 1e-9:
        raise ValueError("a whole number of boxes has to go round")
    south = F.greatest(F.col("lat") - F.lit(step[0] / 2), F.lit(-90.0))
    north = F.least(F.col("lat") + F.lit(step[0] / 2), F.lit(90.0))
    west, east = F.col("lon") - F.lit(step[1] / 2), F.col("lon") + F.lit(step[1] / 2)
    box = lambda c: F.floor(c / size_).cast("long")
    # A cell's far edge may lie on the edge of a box, of which it then has nothing: weight 0.
    rows = grid.select(*by, "v", south.alias("_s"), north.alias("_n"), west.alias("_w"), east.alias("_e"))
    rows = rows.withColumn("_y", F.explode(F.sequence(box(F.col("_s") + 90), box(F.col("_n") + 90)))).withColumn("_x", F.explode(F.sequence(box(F.col("_w")), box(F.col("_e")))))
    low, high = F.greatest(F.col("_s"), F.col("_y") * size_ - 90), F.least(F.col("_n"), (F.col("_y") + 1) * size_ - 90)
    wide = F.least(F.col("_e"), (F.col("_x") + 1) * size_) - F.greatest(F.col("_w"), F.col("_x") * size_)
    area = F.radians(wide) * (F.sin(F.radians(high)) - F.sin(F.radians(low)))
    held = rows.withColumn("_area", area).where("_area > 1e-15").select(*by, "v", "_area", F.col("_y").cast("int").alias("lat_idx"), F.pmod(F.col("_x"), F.lit(n)).cast("int").alias("lon_idx"))
    return held.groupBy(*by, "lat_idx", "lon_idx").agg(weighted_mean(F.col("v"), F.col("_area")).alias("v"), F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("_area"))), F.lit(0.0)).alias("area"))
