"""Checks of a grid against what is expected of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EXPECTED_AXES


def profile_grid(grid: DataFrame, expected: tuple[int, int, int] | str | None = None, tolerance: int = 10) -> DataFrame:
    """One row: sizes of the axes, value range, share of missing values and a status (ok, warn, empty).

    expected: axes' lengths, or the name of a source that the configuration has them of.
    """
    expected = EXPECTED_AXES[expected] if isinstance(expected, str) else expected
    axes = [F.count_distinct(c).alias(n) for c, n in (("time", "n_times"), ("lat_idx", "n_lats"), ("lon_idx", "n_lons"))]
    out = grid.agg(F.count("*").alias("n_rows"), *axes, F.min("time").alias("first_day"), F.max("time").alias("last_day"), F.min("v").alias("min_value"), F.max("v").alias("max_value"), F.avg(F.when(F.col("v").isNull(), 1.0).otherwise(0.0)).alias("missing_share"))
    off = F.lit(False)
    for c, n in zip(("n_times", "n_lats", "n_lons"), expected or (), strict=False):
        off = off | (F.abs(F.col(c) - n) > tolerance)
    return out.withColumn("status", F.when(F.col("n_rows") == 0, "empty").when(off, "warn").otherwise("ok"))
