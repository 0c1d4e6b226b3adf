"""Annual ratios, regional series and the numbers behind figures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import CELL, COASTS
from ..functions.columns import cos_latitude, in_box, ratio, weighted_mean


def ratio_field(over: DataFrame, under: DataFrame, keys: Sequence[str] = ("year", *CELL)) -> DataFrame:
    """keys, value: over / under of two annual tables; a missing count is 0, the ratio is null where under is 0."""
    a = over.select(*keys, F.col("n_days").alias("_a"))
    b = under.select(*keys, F.col("n_days").alias("_b"))
    both = a.join(b, list(keys), "full_outer")
    return both.select(*keys, ratio(F.coalesce("_a", F.lit(0)), F.coalesce("_b", F.lit(0))).alias("value"))


def regions_table(spark: SparkSession, boxes=COASTS) -> DataFrame:
    return spark.createDataFrame([tuple(b) for b in boxes], "name string, lat0 double, lat1 double, lon0 double, lon1 double")


def spatial_mean(field: DataFrame, box=None, value: str = "value", by: Sequence[str] = ("year",), weighted: bool = True) -> DataFrame:
    """Mean of value by year in an inclusive box, weighted by cos(lat)."""
    rows = field.where(in_box(box[1], box[2], box[3], box[4], F.col("lat"), F.col("lon"))) if box else field
    weight = cos_latitude(F.col("lat")) if weighted else F.lit(1.0)
    return rows.groupBy(*by).agg(weighted_mean(F.col(value), weight).alias("value"))


def coastal_means(field: DataFrame, regions: DataFrame, value: str = "value", least_cells: int = 5) -> DataFrame:
    """name, year, value: in each (maybe overlapping) region the mean over cells of positive time mean; with fewer such
    cells than least_cells, over all cells. regions is a handful of boxes."""
    rows = field.join(F.broadcast(regions), in_box(F.col("lat0"), F.col("lat1"), F.col("lon0"), F.col("lon1"), F.col("lat"), F.col("lon"))).select("name", "year", *CELL, "lat", F.col(value).alias("v"))
    active = rows.groupBy("name", *CELL).agg((F.avg("v") > 0).alias("active"))
    enough = active.groupBy("name").agg((F.count_if("active") >= least_cells).alias("enough"))
    marked = rows.join(active, ["name", *CELL]).join(enough, "name")
    held = F.when(~F.col("enough") | F.coalesce("active", F.lit(False)), F.col("v"))
    return marked.groupBy("name", "year").agg(weighted_mean(held, cos_latitude(F.col("lat"))).alias("value"))


def field_summary(field: DataFrame, value: str = "value") -> DataFrame:
    return field.agg(F.avg(value).alias("mean_value"), F.max(value).alias("max_value"))


def mean_field(field: DataFrame, years: tuple[int, int] | None = None, value: str = "value", name: str = "value") -> DataFrame:
    rows = field.where(F.col("year").between(*years)) if years else field
    return rows.groupBy(*CELL).agg(F.avg(value).alias(name))


def selected_years(annual: DataFrame, years: Sequence[int]) -> DataFrame:
    return annual.where(F.col("year").isin(*years) & (F.col("n_days") > 0))


def positive_percentile(annual: DataFrame, share: float = 0.95) -> DataFrame:
    return annual.where("n_days > 0").agg(F.percentile("n_days", F.lit(share)).alias("value"))


def peak_years(series: DataFrame, n: int = 3, by: str = "name") -> DataFrame:
    """The years of the n largest values of each series; of equal ones the earlier year, missing ones last."""
    order = Window.partitionBy(by).orderBy(F.col("value").desc_nulls_last(), "year")
    return series.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def masked_annual(field: DataFrame, days: DataFrame, value: str, keys: Sequence[str] = CELL) -> DataFrame:
    """year, keys, mean and maximum of a daily field over the days that a mask has."""
    inside = field.join(days, ["time", *keys], "left_semi")
    return inside.groupBy(F.year("time").alias("year"), *keys).agg(F.avg(value).alias("mean_value"), F.max(value).alias("max_value"))


def years_with_days(annual: DataFrame, least: int = 1) -> DataFrame:
    return annual.groupBy("year").agg(F.sum("n_days").alias("n_days")).where(F.col("n_days") >= least)


def years_above_mean(annual: DataFrame) -> DataFrame:
    """Years whose days are at least the mean of all years; one row a year."""
    years = annual.groupBy("year").agg(F.sum("n_days").alias("n_days"))
    return years.withColumn("_m", F.avg("n_days").over(Window.partitionBy())).where("n_days >= _m").drop("_m")


def regional_days(days: DataFrame, cells: DataFrame, columns: Sequence[str]) -> DataFrame:
    """year and the mean of each column over the given cells (lat_idx, lon_idx, lat), weighted by cos(lat)."""
    rows = days.join(cells.select(*CELL, F.col("lat").alias("_lat")).distinct(), list(CELL))
    return rows.groupBy("year").agg(*[weighted_mean(F.col(c), cos_latitude(F.col("_lat"))).alias(c) for c in columns])


def threshold_days(field: DataFrame, limits: dict[str, float]) -> DataFrame:
    """year, cell, and for each value column the days that reach its limit."""
    counts: list[Column] = [F.sum(F.when(F.col(c) >= v, 1).otherwise(0)).alias(f"{c}_days") for c, v in limits.items()]
    return field.groupBy(F.year("time").alias("year"), *CELL).agg(*counts)


def wide_by_year(annual: DataFrame, years: Sequence[int]) -> DataFrame:
    """A column a year, for export."""
    return annual.groupBy(*CELL).pivot("year", list(years)).agg(F.first("n_days"))


def joined_fields(fields: Mapping[str, DataFrame], value: str, suffix: str = "") -> DataFrame:
    """lat_idx, lon_idx and a column of each field (name and suffix), for export; a cell that a field lacks is null there."""
    out = None
    for name, field in fields.items():
        one = field.select(*CELL, F.col(value).alias(f"{name}{suffix}"))
        out = one if out is None else out.join(one, list(CELL), "full_outer")
    if out is None:
        raise ValueError("no field to export")
    return out


def humid_statistics(split: DataFrame, periods: DataFrame) -> DataFrame:
    """statistic, threshold, value for export: mean threshold days of compound and other years, and return periods."""
    kind = F.when(F.col("is_compound"), "compound").otherwise("noncompound")
    days = split.select(F.explode(F.array(*[F.struct(F.concat(F.lit(f"{n}_"), kind, F.lit("_days")).alias("statistic"), F.col(f"{n}_days").cast("double").alias("value")) for n in ("wbt", "sh")])).alias("x"))
    rows = days.select("x.statistic", F.lit(None).cast("int").alias("threshold"), "x.value")
    return rows.unionByName(periods.select(F.concat("name", F.lit("_return_period")).alias("statistic"), F.col("threshold").cast("int").alias("threshold"), F.col("period").alias("value")))
