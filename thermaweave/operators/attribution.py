"""Exceedance probabilities of ensembles, and their bootstrap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.risk import far, probability_ratio, return_period


def thresholds_table(spark: SparkSession, thresholds: Sequence[int]) -> DataFrame:
    return spark.createDataFrame([(int(t),) for t in thresholds], "threshold int")


def member_hits(annual: DataFrame, thresholds: DataFrame, keys: Sequence[str] = ("forcing", "member")) -> DataFrame:
    """keys, threshold, hits, total: what of the data a bootstrap needs; the data are read once, not once a replicate."""
    hit = F.sum(F.when(F.col("n_days") >= F.col("threshold"), 1).otherwise(0))
    return annual.crossJoin(F.broadcast(thresholds)).groupBy(*keys, "threshold").agg(hit.alias("hits"), F.count("*").alias("total"))  # thresholds: a list given by the caller


def probability(hits: DataFrame) -> DataFrame:
    """threshold, p_all, p_fix: shares of (member, year, cell) entries that reach the threshold; 0 without entries."""
    share = lambda f: F.coalesce(F.try_divide(F.sum(F.when(F.col("forcing") == f, F.col("hits"))).cast("double"), F.sum(F.when(F.col("forcing") == f, F.col("total"))).cast("double")), F.lit(0.0))
    return hits.groupBy("threshold").agg(share("ALL").alias("p_all"), share("FixGHG").alias("p_fix"))


def _drawn(n: Column, *parts: Column) -> Column:
    """A number from 0 to n - 1 that depends on the parts alone, so that a lost task draws the same again."""
    h = F.conv(F.substring(F.md5(F.concat_ws("-", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")
    return F.pmod(h, n)


def bootstrap(hits: DataFrame, replicates: int = 1000) -> DataFrame:
    """replicate, threshold, p_all, p_fix, far, pr: members drawn with replacement, independently for each forcing and threshold."""
    spark = hits.sparkSession
    members = hits.select("forcing", "member").distinct()
    numbered = members.withColumn("k", F.expr("row_number() OVER (PARTITION BY forcing ORDER BY member) - 1"))
    counts = members.groupBy("forcing").agg(F.count("*").alias("n"))
    draws = spark.range(replicates).select(F.col("id").cast("int").alias("replicate")).crossJoin(F.broadcast(counts)).crossJoin(F.broadcast(hits.select("threshold").distinct()))  # forcings and thresholds: a few dozen rows
    draws = draws.withColumn("slot", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).withColumn("k", _drawn(F.col("n"), F.col("replicate"), F.col("threshold"), F.col("forcing"), F.col("slot")))
    sampled = draws.join(numbered, ["forcing", "k"]).join(hits, ["forcing", "member", "threshold"])
    share = lambda f: F.coalesce(F.try_divide(F.sum(F.when(F.col("forcing") == f, F.col("hits"))).cast("double"), F.sum(F.when(F.col("forcing") == f, F.col("total"))).cast("double")), F.lit(0.0))
    out = sampled.groupBy("replicate", "threshold").agg(share("ALL").alias("p_all"), share("FixGHG").alias("p_fix"))
    return out.withColumns({"far": far(F.col("p_all"), F.col("p_fix")), "pr": probability_ratio(F.col("p_all"), F.col("p_fix"))})


def summary(boot: DataFrame, interval: tuple[float, float] = (0.05, 0.95)) -> DataFrame:
    """By threshold the mean and interval of far and pr; the mean of pr is infinite as soon as one draw's is."""
    bounds = [F.percentile(c, F.lit(q)).alias(f"{c}_{n}") for c in ("far", "pr") for n, q in zip(("low", "high"), interval, strict=True)]
    return boot.groupBy("threshold").agg(F.avg("far").alias("far_mean"), F.avg("pr").alias("pr_mean"), *bounds)


def return_periods(p: DataFrame) -> DataFrame:
    return p.select("threshold", return_period(F.col("p_all")).alias("period_all"), return_period(F.col("p_fix")).alias("period_fix"))


def period_levels(periods: DataFrame, years: Sequence[int] = (5, 10, 20, 50, 100)) -> DataFrame:
    """years, level_all, level_fix: the smallest threshold whose return period reaches so many years (null: none)."""
    each = periods.withColumn("years", F.explode(F.array(*[F.lit(int(y)) for y in years])))
    level = lambda c: F.min(F.when(F.col(c) >= F.col("years"), F.col("threshold")))
    return each.groupBy("years").agg(level("period_all").alias("level_all"), level("period_fix").alias("level_fix"))


def risk_curve(p: DataFrame, boot_summary: DataFrame) -> DataFrame:
    """By threshold the probabilities, and mean and interval of far and pr."""
    return p.join(boot_summary, "threshold")


def observed_risk(observed: DataFrame, curve: DataFrame) -> DataFrame:
    """observed (year, n_days) with the curve at the largest threshold not above n_days (null below the first)."""
    best = observed.join(F.broadcast(curve), curve["threshold"] <= observed["n_days"], "left")  # the curve has a row a threshold
    last = F.max_by(F.struct(*[curve[c] for c in curve.columns]), curve["threshold"]).alias("_c")
    return best.groupBy("year", "n_days").agg(last).select("year", "n_days", "_c.*")
