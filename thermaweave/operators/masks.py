"""Masks and neighbourhoods of cells. A mask is a table of its true cells."""

from __future__ import annotations

from functools import reduce
from math import pi, sin

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EARTH_KM
from ..functions.columns import haversine_km

CROSS = ((-1, 0), (1, 0), (0, -1), (0, 1))
SQUARE = tuple((a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b)


def valid_mask(grid: DataFrame, mode: str = "first") -> DataFrame:
    """Cells with a value on the first day, or on any day."""
    rows = grid.where(F.col("v").isNotNull())
    if mode == "first":
        first = grid.agg(F.min("time").alias("time"))
        rows = rows.join(first, "time", "left_semi")
    elif mode != "any":
        raise ValueError(f"unknown mode: {mode}")
    return rows.select("lat_idx", "lon_idx", "lat", "lon").distinct()


def edge(mask: DataFrame, neighbours=CROSS) -> DataFrame:
    """Cells that lack one of their neighbours; beyond the array there are none."""
    offsets = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in neighbours])
    around = mask.select(F.explode(offsets).alias("o"), "lat_idx", "lon_idx").select((F.col("lat_idx") + F.col("o.a")).alias("lat_idx"), (F.col("lon_idx") + F.col("o.b")).alias("lon_idx"))
    counts = around.groupBy("lat_idx", "lon_idx").agg(F.count("*").alias("_n"))
    return mask.join(counts, ["lat_idx", "lon_idx"], "left").where(F.coalesce("_n", F.lit(0)) < len(neighbours)).drop("_n")


def coastal_mask(land: DataFrame, sea: DataFrame) -> DataFrame:
    """Edges of both masks with all eight neighbours."""
    return edge(land, SQUARE).unionByName(edge(sea, SQUARE)).select("lat_idx", "lon_idx").distinct()


def _unit(lat: Column, lon: Column) -> list[Column]:
    """The place as a vector of length one."""
    a, b = F.radians(lat), F.radians(lon)
    return [F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a)]


def coastal_buffer(land: DataFrame, coast: DataFrame, km: float) -> DataFrame:
    """Land cells within so many km of a coast cell.

    Places are vectors of length one, dealt into cubes as wide as the chord of that distance; a coast cell goes to the
    27 cubes around its own, so the join is on equal cubes, whatever the grids' sizes. The sphere has no seam there:
    neither the antimeridian nor a pole is a case of its own, and longitudes may be written from -180 or from 0.
    """
    side = 2 * sin(min(km / EARTH_KM, pi) / 2) * (1 + 1e-9)
    axes = ("_x", "_y", "_z")
    cubes = lambda df, lat, lon: df.withColumns({c: F.floor(v / F.lit(side)).cast("long") for c, v in zip(axes, _unit(F.col(lat), F.col(lon)), strict=True)})
    spread = cubes(coast.select(F.col("lat").alias("_lat"), F.col("lon").alias("_lon")).distinct(), "_lat", "_lon")
    for c in axes:
        spread = spread.withColumn(c, F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1)))
    near = haversine_km(F.col("l.lat"), F.col("l.lon"), F.col("c._lat"), F.col("c._lon")) <= km
    on = reduce(lambda a, b: a & b, [F.col(f"l.{c}") == F.col(f"c.{c}") for c in axes], near)
    return cubes(land, "lat", "lon").alias("l").join(spread.alias("c"), on, "left_semi").drop(*axes)
