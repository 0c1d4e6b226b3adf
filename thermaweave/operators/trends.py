"""Trends, a constrained fit and return levels."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import log, pi, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CELL


def seasonal_trend(grid: DataFrame, months: Sequence[int] = (7, 8, 9), years: tuple[int, int] | None = None, time: str = "time", keys: Sequence[str] = CELL) -> DataFrame:
    """keys, slope: ordinary least squares of annual seasonal means on the year, for ten years."""
    rows = grid.where(F.month(time).isin(*months)) if months else grid
    rows = rows.where(F.year(time).between(*years)) if years else rows
    annual = rows.groupBy(*keys, F.year(time).alias("year")).agg(F.avg("v").alias("v"))
    return annual.groupBy(*keys).agg((F.regr_slope("v", "year") * 10).alias("slope"))


def convex_trend(series: DataFrame, by: str = "name", origin: int = 1983, least: int = 3) -> DataFrame:
    """by, a, b, c of the least squares fit a * x + b * x**2 + c, x = year - origin, with a, b >= 0.

    One aggregation gives central moments; a non-negative problem in two variables has four active sets, and the
    feasible one of least error is chosen by expressions. Series with fewer than `least` values are left out.
    """
    rows = series.where(F.col("value").isNotNull()).select(by, (F.col("year") - origin).cast("double").alias("x"), F.col("value").alias("y"))
    means = rows.groupBy(by).agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg(F.col("x") * F.col("x")).alias("mq"), F.avg("y").alias("my"))
    centred = rows.join(means.where(F.col("n") >= least), by).select(by, "mx", "mq", "my", (F.col("x") - F.col("mx")).alias("u"), (F.col("x") * F.col("x") - F.col("mq")).alias("w"), (F.col("y") - F.col("my")).alias("z"))
    s = lambda a, b: F.sum(F.col(a) * F.col(b))
    sums = centred.groupBy(by, "mx", "mq", "my").agg(s("u", "u").alias("uu"), s("w", "w").alias("ww"), s("u", "w").alias("uw"), s("u", "z").alias("uz"), s("w", "z").alias("wz"))
    det = F.col("uu") * F.col("ww") - F.col("uw") * F.col("uw")
    a2, b2 = F.try_divide(F.col("uz") * F.col("ww") - F.col("wz") * F.col("uw"), det), F.try_divide(F.col("wz") * F.col("uu") - F.col("uz") * F.col("uw"), det)
    zero = F.lit(0.0)
    options = [(a2, b2), (F.try_divide(F.col("uz"), F.col("uu")), zero), (zero, F.try_divide(F.col("wz"), F.col("ww"))), (zero, zero)]
    # The error less a constant.
    error = lambda a, b: a * a * F.col("uu") + b * b * F.col("ww") + 2 * a * b * F.col("uw") - 2 * a * F.col("uz") - 2 * b * F.col("wz")
    structs = [F.when((a >= 0) & (b >= 0), F.struct(error(a, b).alias("e"), a.alias("a"), b.alias("b"))) for a, b in options]
    best = F.array_min(F.filter(F.array(*structs), lambda x: x.isNotNull()))
    return sums.withColumn("_best", best).select(by, "_best.a", "_best.b", (F.col("my") - F.col("_best.a") * F.col("mx") - F.col("_best.b") * F.col("mq")).alias("c"))


def return_levels(series: DataFrame, thresholds: DataFrame, by: str = "name") -> DataFrame:
    """by, threshold, p, period: empirical exceedance of annual values."""
    p = F.avg(F.when(F.col("value") >= F.col("threshold"), 1.0).otherwise(0.0))
    out = series.where(F.col("value").isNotNull()).join(F.broadcast(thresholds)).groupBy(by, "threshold").agg(p.alias("p"))  # some dozen thresholds
    return out.withColumn("period", F.when(F.col("p") > 0, 1 / F.col("p")).otherwise(F.lit(float("inf"))))


#: Coefficients of Lanczos' series for the gamma function (g = 7, nine terms), and Euler's constant.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
EULER = 0.5772156649015329


def gamma_of_next(k: Column) -> Column:
    """gamma(1 + k) for k > -1."""
    t = k + 7.5
    series = reduce(lambda a, b: a + b, [F.lit(c) / (k + i) for i, c in enumerate(LANCZOS) if i], F.lit(LANCZOS[0]))
    return F.lit(sqrt(2 * pi)) * F.pow(t, k + 0.5) * F.exp(-t) * series


def gev(series: DataFrame, by: str | Sequence[str] = "name") -> DataFrame:
    """by, shape, scale, location of a generalised extreme value distribution by L-moments.

    Ranks and the three probability-weighted moments are windows and sums; what is left are closed forms. A series of
    fewer than three values has no row; one without spread, or whose moments no such distribution has, has nulls; where
    the shape vanishes, the distribution is Gumbel's.
    """
    keys = [by] if isinstance(by, str) else list(by)
    rank = Window.partitionBy(*keys).orderBy("value")
    n = Window.partitionBy(*keys)
    rows = series.where(F.col("value").isNotNull()).select(*keys, "value", (F.row_number().over(rank) - 1).alias("i"), F.count("*").over(n).alias("n")).where("n >= 3")
    moments = rows.groupBy(*keys).agg(F.avg("value").alias("b0"), F.avg(F.col("value") * F.col("i") / (F.col("n") - 1)).alias("b1"), F.avg(F.col("value") * F.col("i") * (F.col("i") - 1) / ((F.col("n") - 1) * (F.col("n") - 2))).alias("b2"))
    b0, l2, k = F.col("b0"), F.col("l2"), F.col("k")
    spread = 2 * F.col("b1") - b0
    moments = moments.withColumn("l2", F.when(spread > 1e-9 * F.greatest(F.abs(b0), F.lit(1e-9)), spread))
    c = F.try_divide(l2, 3 * F.col("b2") - b0) - F.lit(log(2) / log(3))
    shape = 7.8590 * c + 2.9554 * c * c
    moments = moments.withColumn("k", F.when(shape > -1, shape))
    flat, g = F.abs(k) < FLAT, gamma_of_next(k)
    scale = F.when(flat, l2 / F.lit(log(2))).otherwise(l2 * k / ((1 - F.pow(F.lit(2.0), -k)) * g))
    place = F.when(flat, b0 - F.lit(EULER) * F.col("scale")).otherwise(b0 - F.col("scale") * (1 - g) / k)
    return moments.withColumn("scale", scale).select(*keys, (-k).alias("shape"), "scale", place.alias("location"))


#: Shapes nearer to 0 are Gumbel's; rarer chances count as never.
FLAT, NEVER = 1e-6, 1e-9


def chance_above(x: Column, shape: Column, scale: Column, location: Column) -> Column:
    """Probability that a value of the distribution exceeds x: 1 below its lower end, 0 above its upper end."""
    z = (x - location) / scale
    inside = 1 + shape * z
    t = F.when(F.abs(shape) < FLAT, F.exp(-z)).when(inside > 0, F.pow(inside, -1 / shape))
    return F.when(t.isNotNull(), -F.expm1(-t)).when(shape > 0, 1.0).when(shape < 0, 0.0)


def value_at(p: Column, shape: Column, scale: Column, location: Column) -> Column:
    """The value that the distribution stays below with probability p: its inverse."""
    y = -F.log(p)
    return location + scale * F.when(F.abs(shape) < FLAT, -F.log(y)).otherwise((F.pow(y, -shape) - 1) / shape)


def period_of(p: Column) -> Column:
    return F.when(p < NEVER, F.lit(float("inf"))).otherwise(1 / p)


def fitted_levels(fit: DataFrame, years: Sequence[int] = (5, 10, 20, 50, 100), by: str = "name") -> DataFrame:
    """by, years, level: the value that the fitted distribution exceeds once in so many years."""
    each = fit.withColumn("years", F.explode(F.array(*[F.lit(int(y)) for y in years])))
    return each.select(by, "years", value_at(1 - 1 / F.col("years"), F.col("shape"), F.col("scale"), F.col("location")).alias("level"))


def fitted_periods(series: DataFrame, thresholds: DataFrame, by: str = "name", replicates: int = 200, interval: tuple[float, float] = (0.05, 0.95)) -> DataFrame:
    """by, threshold, period, period_low, period_high by the fitted distribution.

    The interval comes from a parametric bootstrap: of every fit as many values as its series has are drawn, replicates
    times, and fitted again, all series and replicates at once. What is drawn depends on series, replicate and slot
    alone, so a lost task draws it again. Thresholds are a list given by the caller. A series without a fit has null
    periods; one of fewer than three values has no rows.
    """
    fit = gev(series, by)
    sizes = series.where(F.col("value").isNotNull()).groupBy(by).agg(F.count("*").cast("int").alias("_n"))
    # A series without a fit draws nulls, which the second fit leaves out. Neither a filter on scale nor one that follows
    # from the value may stand here: either would be pushed down as the whole expression of the fit.
    slots = fit.join(sizes, by).withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("_slot", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    drawn = F.conv(F.substring(F.md5(F.concat_ws("-", F.col(by), F.col("replicate"), F.col("_slot"))), 1, 8), 16, 10).cast("double")
    value = value_at((drawn + 0.5) / F.lit(2.0**32), F.col("shape"), F.col("scale"), F.col("location"))
    parameters = [F.col(c) for c in ("shape", "scale", "location")]
    chances = lambda df: df.crossJoin(F.broadcast(thresholds)).withColumn("_p", chance_above(F.col("threshold").cast("double"), *parameters))
    value = F.when(F.col("scale").isNotNull(), value)
    again = chances(gev(slots.select(by, "replicate", value.alias("value")), (by, "replicate")))
    bounds = again.groupBy(by, "threshold").agg(*[F.percentile("_p", F.lit(q)).alias(n) for n, q in zip(("_low", "_high"), interval, strict=True)])
    found = chances(fit).join(bounds, [by, "threshold"], "left")
    return found.select(by, "threshold", period_of(F.col("_p")).alias("period"), period_of(F.col("_high")).alias("period_low"), period_of(F.col("_low")).alias("period_high"))
