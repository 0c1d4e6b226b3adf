"""Land events against the sea events of their paired cells: containment, overlap, classes.

keys: columns beside the cell that both sides have (forcing and member of an ensemble); pairs hold for all of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def contains(outer_start: Column, outer_end: Column, start: Column, end: Column) -> Column:
    return (outer_start <= start) & (outer_end >= end)


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_end >= b_start) & (a_start <= b_end)


def paired_events(land: DataFrame, pairs: DataFrame) -> DataFrame:
    """Land events of paired cells with their sea cell; others go."""
    cells = pairs.select(F.col("land_lat_idx").alias("lat_idx"), F.col("land_lon_idx").alias("lon_idx"), "ocean_lat_idx", "ocean_lon_idx")
    named = land.withColumnsRenamed({"event_start": "thw_start", "event_end": "thw_end", "duration": "thw_duration"})
    return named.join(cells, ["lat_idx", "lon_idx"]).withColumnsRenamed({"lat_idx": "land_lat_idx", "lon_idx": "land_lon_idx", "lat": "land_lat", "lon": "land_lon"})


def sea_side(sea: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return sea.select(*keys, F.col("lat_idx").alias("ocean_lat_idx"), F.col("lon_idx").alias("ocean_lon_idx"), F.col("event_start").alias("mhw_start"), F.col("event_end").alias("mhw_end"), F.col("duration").alias("mhw_duration"))


_CELL = ["ocean_lat_idx", "ocean_lon_idx"]


def swept(land: DataFrame, sea: DataFrame, keys: Sequence[str] = (), start: str = "thw_start", end: str = "thw_end") -> DataFrame:
    """land (with the paired sea cell) with, from that cell's events: _m, of those that begin by its start the one that
    ends last, and _next, the first begin after its start.

    Events of both kinds lie in one ordered window of the sea cell; no pairs are made. As sea events of a cell are
    disjoint, _m is the only one that can hold a land event or reach its start, and an event that overlaps it but
    doesn't reach its start begins after it, no earlier than _next.
    """
    cell = [*_CELL, *keys]
    own = F.struct(*[F.col(c) for c in land.columns if c not in cell])
    theirs = F.struct("mhw_end", "mhw_start", "mhw_duration")
    both = land.select(*cell, F.col(start).alias("_at"), F.lit(1).alias("_kind"), own.alias("_land"), F.lit(None).cast("struct<mhw_end:date,mhw_start:date,mhw_duration:int>").alias("_sea"))
    both = both.unionByName(sea_side(sea, keys).select(*cell, F.col("mhw_start").alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast(land.select(own.alias("x")).schema["x"].dataType).alias("_land"), theirs.alias("_sea")))
    rising = Window.partitionBy(*cell).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    falling = Window.partitionBy(*cell).orderBy(F.desc("_at"), F.desc("_kind")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = both.withColumn("_m", F.max("_sea").over(rising)).withColumn("_next", F.min("_sea.mhw_start").over(falling))
    return swept.where("_kind = 1").select("_land.*", *cell, "_m", "_next").select(*land.columns, "_m", "_next")


def _inside(start: str, end: str) -> Column:
    return F.coalesce(contains(F.col("_m.mhw_start"), F.col("_m.mhw_end"), F.col(start), F.col(end)), F.lit(False))


def _touched(start: str, end: str) -> Column:
    return F.coalesce(F.col("_m.mhw_end") >= F.col(start), F.lit(False)) | F.coalesce(F.col("_next") <= F.col(end), F.lit(False))


def compound_events(sea: DataFrame, land: DataFrame, pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Land events that lie within a sea event of the paired cell, with that sea event. Sea events of a cell are disjoint."""
    a = paired_events(land, pairs)
    found = swept(a, sea, keys).where(_inside("thw_start", "thw_end"))
    return found.select(*a.columns, "_m.mhw_start", "_m.mhw_end", "_m.mhw_duration")


def standalone_events(sea: DataFrame, land: DataFrame, pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Paired land events that no sea event of the paired cell overlaps."""
    a = paired_events(land, pairs)
    return swept(a, sea, keys).where(~_touched("thw_start", "thw_end")).select(*a.columns)


def classify_events(sea: DataFrame, land: DataFrame, pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Every land event with its class: compound, partial, standalone, unpaired. A land cell has one sea cell at most."""
    cells = pairs.select(F.col("land_lat_idx").alias("lat_idx"), F.col("land_lon_idx").alias("lon_idx"), *_CELL)
    a = land.join(cells, ["lat_idx", "lon_idx"], "left")
    kind = F.when(_inside("event_start", "event_end"), "compound").when(_touched("event_start", "event_end"), "partial").otherwise("standalone")
    paired = swept(a.where(F.col(_CELL[0]).isNotNull()), sea, keys, "event_start", "event_end")
    alone = a.where(F.col(_CELL[0]).isNull()).select(*land.columns, F.lit("unpaired").alias("class"))
    return paired.select(*land.columns, kind.alias("class")).unionByName(alone)


def unpaired_events(land: DataFrame, pairs: DataFrame) -> DataFrame:
    return land.join(pairs.select(F.col("land_lat_idx").alias("lat_idx"), F.col("land_lon_idx").alias("lon_idx")), ["lat_idx", "lon_idx"], "left_anti")
