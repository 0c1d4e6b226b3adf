"""Events to days to annual counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CELL


def events_to_days(events: DataFrame, axis: DataFrame, start: str = "event_start", end: str = "event_end", keys: Sequence[str] = CELL) -> DataFrame:
    """keys, time: the axis days of each event, once each."""
    days = events.select(*keys, F.explode(F.sequence(start, end)).alias("time"))
    return days.join(axis.select("time"), "time", "left_semi").select(*keys, "time").distinct()


def land_days(events: DataFrame, axis: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """Days of compound or stand-alone events by land cell (and what else keys name)."""
    named = events.withColumnsRenamed({"land_lat_idx": "lat_idx", "land_lon_idx": "lon_idx"})
    return events_to_days(named, axis, "thw_start", "thw_end", keys)


def union_days(*days: DataFrame) -> DataFrame:
    out = days[0]
    for d in days[1:]:
        out = out.unionByName(d)
    return out.distinct()


def annual_days(days: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    return days.groupBy(F.year("time").alias("year"), *keys).agg(F.count("*").alias("n_days"))


def densify(annual: DataFrame, years: DataFrame, cells: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """A row for every year and cell; years and cells are the result's own axes."""
    frame = years.select("year").distinct().crossJoin(cells.select(*keys).distinct())
    return frame.join(annual, ["year", *keys], "left").withColumn("n_days", F.coalesce("n_days", F.lit(0).cast("long")))


def annual_by_class(classified: DataFrame, axis: DataFrame, cells: DataFrame, years: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """year, keys, n_compound, n_standalone, n_thw for every year and cell, from events with their class.

    All three counts come from one pass over the classified events, so nothing upstream runs once for each of them.
    """
    kinds = classified.where(F.col("class").isin("compound", "standalone"))
    days = kinds.select(*keys, "class", F.explode(F.sequence("event_start", "event_end")).alias("time")).join(axis.select("time"), "time", "left_semi").distinct()
    counts = days.groupBy(F.year("time").alias("year"), *keys).agg(F.count_if(F.col("class") == "compound").alias("n_compound"), F.count_if(F.col("class") == "standalone").alias("n_standalone"), F.count_distinct("time").alias("n_thw"))
    frame = years.select("year").distinct().crossJoin(cells.select(*keys).distinct())  # the result's own axes
    return frame.join(counts, ["year", *keys], "left").fillna(0, ["n_compound", "n_standalone", "n_thw"])
