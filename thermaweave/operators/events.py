"""Events: runs of exceeding days that bridge short gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import CELL
from .climatology import base_period, exceedance


def time_axis(grid: DataFrame) -> DataFrame:
    """time, t_idx: positions on the axis that all cells share; one row a day, so the window sees few rows."""
    return grid.select("time").distinct().withColumn("t_idx", F.row_number().over(Window.orderBy("time")) - 1)


def on_axis(rows: DataFrame, axis: DataFrame, period: tuple[int, int] | None = None) -> DataFrame:
    """rows with t_idx and, for a base period, the day of year (doy) held to the last that its climatology has.

    The axis has a row for each day from first to last (a century: under 1 MB), so it goes to the rows, which stay where
    they are.
    """
    days = axis.select("time", "t_idx")
    if period:
        last = F.max(F.when(base_period(period), F.dayofyear("time"))).over(Window.partitionBy())
        days = days.withColumn("doy", F.least(F.dayofyear("time"), last))
    return rows.join(F.broadcast(days), "time")


def islands(exceeding: DataFrame, min_duration: int, max_gap: int, keys: Sequence[str] = CELL) -> DataFrame:
    """keys, lat, lon, event_start, event_end, duration from exceeding rows (keys, lat, lon, time, t_idx).

    A gap of up to max_gap positions is bridged; the span from first to last exceeding day, gaps included, has to be
    min_duration positions. One exchange on the keys serves the window and the aggregation.
    """
    along = Window.partitionBy(*keys).orderBy("t_idx")
    new = F.when(F.col("t_idx") - F.lag("t_idx").over(along) <= max_gap + 1, 0).otherwise(1)
    marked = exceeding.withColumn("_new", new).withColumn("_event", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    found = marked.groupBy(*keys, "_event").agg(F.first("lat").alias("lat"), F.first("lon").alias("lon"), F.min("time").alias("event_start"), F.max("time").alias("event_end"), (F.max("t_idx") - F.min("t_idx") + 1).cast("int").alias("duration"))
    return found.where(F.col("duration") >= min_duration).drop("_event")


def detect_events(grid: DataFrame, clim: DataFrame, min_duration: int = 5, max_gap: int = 2, min_valid: int = 0, keys: Sequence[str] = CELL, axis: DataFrame | None = None, period: tuple[int, int] | None = None) -> DataFrame:
    """All events of all cells in one job. A day without a row is a position of the axis that doesn't exceed.

    The grid moves once, to its cells, where thresholds, valid counts, runs and events are found. axis: positions of a
    larger source; period: that of clim, which then isn't gone through for its last day.
    """
    axis = time_axis(grid) if axis is None else axis
    rows = with_enough(on_axis(grid, axis, period).repartition(*keys), min_valid, keys)
    return islands(exceedance(rows, clim, keys, placed=bool(period)), min_duration, max_gap, keys)


def events_above_percentile(grid: DataFrame, period: tuple[int, int], percentile: float, min_duration: int = 5, max_gap: int = 2, min_valid: int = 0, keys: Sequence[str] = CELL, axis: DataFrame | None = None) -> DataFrame:
    """detect_events() against the climatology of the same grid, which is found on the way.

    Values are scanned once and move once: the percentile is a window of cell and day of year, runs are windows of the
    cell, and both find the rows in the cell's partition. Beside that the days alone are scanned for the axis.
    """
    axis = time_axis(grid) if axis is None else axis
    rows = on_axis(grid.select(*keys, "lat", "lon", "time", "v"), axis, period).repartition(*keys)
    limit = F.percentile(F.when(base_period(period), F.col("v")), F.lit(percentile)).over(Window.partitionBy(*keys, "doy"))
    above = with_enough(rows, min_valid, keys).withColumn("thresh", limit).where(F.coalesce(F.col("v") > F.col("thresh"), F.lit(False)))
    return islands(above, min_duration, max_gap, keys)


def with_enough(rows: DataFrame, least: int, keys: Sequence[str] = CELL) -> DataFrame:
    """enough_values() for rows that lie by cell: a window, no join."""
    if least <= 0:
        return rows
    return rows.withColumn("_valid", F.count("v").over(Window.partitionBy(*keys))).where(F.col("_valid") >= least).drop("_valid")


def restrict_to(grid: DataFrame, cells: DataFrame) -> DataFrame:
    """The rows of the given cells only (detection on paired sea cells)."""
    return grid.join(cells.select(*CELL).distinct(), list(CELL), "left_semi")
