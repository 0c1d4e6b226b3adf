"""Pairs of land and sea cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import cos_latitude, unified_longitude
from .masks import CROSS


def _cells(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}_{c}") for c in ("lat_idx", "lon_idx", "lat", "lon")])


def nearest_pairs(land: DataFrame, sea: DataFrame, most: float = 0.5) -> DataFrame:
    """For each land cell the nearest sea cell in the plane (lat, lon * cos(own lat)), within `most`.

    The plane is dealt into boxes of that size. Sea cells go to the nine boxes around theirs, so the join is on equal
    boxes and near cells are found without comparing all with all. Ties: smallest sea index.
    """
    def plane(df: DataFrame, p: str) -> DataFrame:
        y = unified_longitude(F.col(f"{p}_lon")) if p == "ocean" else F.col(f"{p}_lon")
        return df.withColumns({f"_{p}_x": F.col(f"{p}_lat"), f"_{p}_y": y * cos_latitude(F.col(f"{p}_lat"))})

    box = lambda c: F.floor(F.col(c) / F.lit(most)).cast("long")
    own = plane(_cells(land, "land"), "land").withColumns({"_bx": box("_land_x"), "_by": box("_land_y")})
    around = lambda c: F.explode(F.sequence(box(c) - 1, box(c) + 1))
    spread = plane(_cells(sea, "ocean"), "ocean").withColumn("_bx", around("_ocean_x")).withColumn("_by", around("_ocean_y"))
    dx, dy = F.col("_land_x") - F.col("_ocean_x"), F.col("_land_y") - F.col("_ocean_y")
    near = own.join(spread, ["_bx", "_by"]).withColumn("dist_deg", F.sqrt(dx * dx + dy * dy)).where(F.col("dist_deg") <= most)
    best = F.min_by(F.struct("ocean_lat_idx", "ocean_lon_idx", "ocean_lat", "ocean_lon", "dist_deg"), F.struct("dist_deg", "ocean_lat_idx", "ocean_lon_idx")).alias("_o")
    return near.groupBy("land_lat_idx", "land_lon_idx", "land_lat", "land_lon").agg(best).select("land_lat_idx", "land_lon_idx", "_o.ocean_lat_idx", "_o.ocean_lon_idx", "land_lat", "land_lon", "_o.ocean_lat", "_o.ocean_lon", "_o.dist_deg")


def neighbour_pairs(land: DataFrame, sea: DataFrame, n_lat: int, n_lon: int) -> DataFrame:
    """On one grid: the first sea cell above, below, left or right of a land cell; cells of the border are left out."""
    inner = land.where(F.col("lat_idx").between(1, n_lat - 2) & F.col("lon_idx").between(1, n_lon - 2))
    offsets = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in CROSS])
    sides = inner.select(F.col("lat_idx").alias("land_lat_idx"), F.col("lon_idx").alias("land_lon_idx"), F.posexplode(offsets).alias("side", "o"))
    sides = sides.withColumns({"ocean_lat_idx": F.col("land_lat_idx") + F.col("o.a"), "ocean_lon_idx": F.col("land_lon_idx") + F.col("o.b")})
    cells = sea.select(F.col("lat_idx").alias("ocean_lat_idx"), F.col("lon_idx").alias("ocean_lon_idx"))
    found = sides.join(cells, ["ocean_lat_idx", "ocean_lon_idx"])
    return found.groupBy("land_lat_idx", "land_lon_idx").agg(F.min_by(F.struct("ocean_lat_idx", "ocean_lon_idx"), "side").alias("_o")).select("land_lat_idx", "land_lon_idx", "_o.*")
