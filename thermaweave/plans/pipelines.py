"""Whole jobs: observations, figure tables, attribution, humid heat."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CELL, EUROPE, MAP_YEARS, PANELS, TREND_MONTHS, TREND_YEARS, Settings
from ..functions import humid
from ..functions.columns import cos_latitude, weighted_mean
from ..operators import attribution, climatology, compound, daily, events, masks, metrics, pairing, trends
from ..sources.grids import fingerprint, materialize, scaled


def run_observational(
    sst: DataFrame, t2m: DataFrame, settings: Settings = Settings(), store: str | None = None, coast_only: bool = True, thw_scope: str = "classified", mask: str = "first", keys: Sequence[str] = ()
) -> dict[str, DataFrame]:
    """Events, pairs, classes, days, annual counts and ratios from a sea and a land grid.

    Sea events are found on paired cells only. thw_scope: the days of land events that the co-occurrence is a share of,
    "classified" (compound and stand-alone) or "all_paired". store: a folder in which pairs, climatologies, events and
    annual tables are kept, each with a manifest of what it was made of, and from which a later run takes those that it
    would make alike: other settings, input files or code are found out and what follows from them is made anew. mask: the day by whose values cells count as land or
    sea ("first", or "any"). keys: columns of both grids beside the cell, as an ensemble's forcing and member.
    """
    spark = sst.sparkSession
    prints: dict[str, str] = {}

    def kept(name: str, make: Callable[[], DataFrame], *of: DataFrame | str, **settings) -> DataFrame:
        """A stage's table; `of` are the tables and stages that it depends on beside the settings."""
        if not store:
            return make()
        prints[name] = fingerprint(spark, [prints[x] if isinstance(x, str) else x for x in of], stage=name, keys=tuple(keys), **settings)
        return materialize(spark, make, f"{store}/{name}", prints[name])

    s, cell, share = settings, (*keys, *CELL), settings.land_percentile or settings.percentile
    runs = {"min_duration": s.min_duration, "max_gap": s.max_gap}
    land_cells = masks.valid_mask(t2m, mask)
    edge = masks.edge(land_cells) if coast_only else land_cells
    pairs = kept("pairs", lambda: pairing.nearest_pairs(edge, masks.valid_mask(sst, mask), s.max_distance), sst, t2m, coast_only=coast_only, mask=mask, most=s.max_distance)
    sea_cells = pairs.select(F.col("ocean_lat_idx").alias("lat_idx"), F.col("ocean_lon_idx").alias("lon_idx"))
    sea_grid = events.restrict_to(sst, sea_cells)
    sea_axis, axis = events.time_axis(sst), events.time_axis(t2m)  # the whole source's, also where its cells are restricted
    if store:
        limits = {"period": s.base_period}
        sea_limits = kept("sea_climatology", lambda: climatology.climatology(sea_grid, s.base_period, s.percentile, cell), sst, "pairs", share=s.percentile, **limits)
        sea = kept("sea_events", lambda: events.detect_events(sea_grid, sea_limits, s.min_duration, s.max_gap, 0, cell, sea_axis, s.base_period), sst, "sea_climatology", **runs)
        land_limits = kept("land_climatology", lambda: climatology.climatology(t2m, s.base_period, share, cell), t2m, share=share, **limits)
        land = kept("land_events", lambda: events.detect_events(t2m, land_limits, s.min_duration, s.max_gap, s.land_min_valid, cell, axis, s.base_period), t2m, "land_climatology", least=s.land_min_valid, **runs)
    else:
        sea = events.events_above_percentile(sea_grid, s.base_period, s.percentile, s.min_duration, s.max_gap, 0, cell, sea_axis)
        land = events.events_above_percentile(t2m, s.base_period, share, s.min_duration, s.max_gap, s.land_min_valid, cell, axis)
    classes = kept("classes", lambda: compound.classify_events(sea, land, pairs, keys), "sea_events", "land_events", "pairs")
    years, cells = t2m.select(F.year("time").alias("year")), t2m.select(*cell, "lat", "lon").distinct()
    placed = lambda df: df.join(cells, list(cell))
    # All annual counts come from one pass over the classified events.
    per = kept("annual", lambda: daily.annual_by_class(classes, axis, cells, years, cell), "classes", t2m)
    count = lambda c: placed(per.select("year", *cell, F.col(c).alias("n_days")))
    both, alone = compound.compound_events(sea, land, pairs, keys), compound.standalone_events(sea, land, pairs, keys)
    if thw_scope == "all_paired":
        all_days = daily.annual_days(daily.land_days(compound.paired_events(land, pairs), axis, cell), cell)
        all_annual = kept("thw_annual", lambda: placed(daily.densify(all_days, years, cells, cell)), "land_events", "pairs", t2m)
    elif thw_scope == "classified":
        all_annual = count("n_thw")
    else:
        raise ValueError(f"unknown scope: {thw_scope}")
    tables = {"compound": count("n_compound"), "standalone": count("n_standalone"), "thw": all_annual}
    ratio = placed(metrics.ratio_field(tables["compound"], tables["standalone"], ("year", *cell)))
    share = placed(metrics.ratio_field(tables["compound"], tables["thw"], ("year", *cell)))
    return {
        "pairs": pairs, "sea_events": sea, "land_events": land, "classes": classes, "compound_events": both, "standalone_events": alone, "compound_days": daily.land_days(both, axis, cell), "standalone_days": daily.land_days(alone, axis, cell),
        "compound_annual": tables["compound"], "standalone_annual": tables["standalone"], "thw_annual": tables["thw"], "ratio": ratio, "cooccurrence": share, "ratio_summary": metrics.field_summary(ratio),
    }


def panel_tables(found: Mapping[str, DataFrame], years: tuple[int, int] = (2003, 2023), map_years: Sequence[int] = MAP_YEARS, regions: DataFrame | None = None, trend_regions: Sequence[str] = ("j", "l")) -> dict[str, DataFrame]:
    """The numbers behind the figures' panels."""
    annual = found["compound_annual"]
    regions = metrics.regions_table(annual.sparkSession, PANELS) if regions is None else regions
    series = metrics.coastal_means(annual, regions, "n_days")
    return {
        "maps": metrics.selected_years(annual, map_years), "scale": metrics.positive_percentile(annual), "series": series, "peaks": metrics.peak_years(series),
        "trend": trends.convex_trend(series.where(F.col("name").isin(*trend_regions))), "cooccurrence_mean": metrics.mean_field(found["cooccurrence"]),
        "compound_mean": metrics.mean_field(annual, years, "n_days"), "standalone_mean": metrics.mean_field(found["standalone_annual"], years, "n_days"), "ratio_mean": metrics.mean_field(found["ratio"], years),
        "ratio_series": metrics.spatial_mean(found["ratio"], EUROPE),
    }


def run_attribution(annual: DataFrame, settings: Settings = Settings(), observed: DataFrame | None = None) -> dict[str, DataFrame]:
    """annual (forcing, member, year[, cell], n_days) to probabilities, bootstrap, return periods and the observed table."""
    hits = attribution.member_hits(annual, attribution.thresholds_table(annual.sparkSession, settings.thresholds))
    p, boot = attribution.probability(hits), attribution.bootstrap(hits, settings.bootstraps)
    out = {"probability": p, "samples": boot, "summary": attribution.summary(boot, settings.interval), "periods": attribution.return_periods(p)}
    out["levels"] = attribution.period_levels(out["periods"])
    if observed is not None:
        out["observed"] = attribution.observed_risk(observed, attribution.risk_curve(p, out["summary"]))
    return out


def run_ensemble(sst: DataFrame, t2m: DataFrame, settings: Settings = Settings(), observed: DataFrame | None = None, store: str | None = None, coast_only: bool = True, mask: str = "first") -> dict[str, DataFrame]:
    """Daily fields of all members (forcing, member, time, cell, v) to the attribution's tables.

    Detection, pairing and classes are those of the observations with forcing and member as keys; members that the
    settings don't name are left out.
    """
    keys = ("forcing", "member")
    sst, t2m = (df.where(F.col("member").isin(*settings.members)) for df in (sst, t2m))
    found = run_observational(sst, t2m, settings, store, coast_only, mask=mask, keys=keys)
    annual = found["compound_annual"].select(*keys, "year", *CELL, "n_days")
    return found | run_attribution(annual, settings, observed) | {"annual": annual}


def run_humid(
    fields: DataFrame, compound_days: DataFrame, land: DataFrame, coast: DataFrame, settings: Settings = Settings(), months: Sequence[int] = (6, 7, 8), evaporation: DataFrame | None = None, evaporation_factor: float = 1.0,
    trend_months: Sequence[int] = TREND_MONTHS, trend_years: Mapping[str, tuple[int, int]] = TREND_YEARS, sst: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """fields (time, cell, lat, lon, tmax, d2m, sp): maps on compound days, threshold days of compound and other years,
    return levels of the coastal buffer's mean series (empirical, and of the fitted distribution with intervals), and
    trends of specific humidity, of monthly evaporation and of the sea surface (v) where those are given.

    months: the season of threshold days and levels. Trends have months and years of their own. trend_fields and
    statistics are the flat tables for export.
    """
    t, td, sp = F.col("tmax"), F.col("d2m"), F.col("sp")
    wet = fields.select("time", *CELL, "lat", "lon", humid.wet_bulb(t, td, sp).alias("wbt"), humid.specific_humidity(td, sp).alias("sh"))
    near = masks.coastal_buffer(land, coast, settings.buffer_km).select(*CELL, "lat").distinct()
    summer = wet.where(F.month("time").isin(*months)).join(near.select(*CELL), list(CELL), "left_semi")
    names = ("wbt_days", "sh_days")
    by_year = metrics.regional_days(metrics.threshold_days(summer, {"wbt": settings.wet_bulb, "sh": settings.specific_humidity}), near, names)
    years = metrics.years_with_days(daily.annual_days(compound_days))
    split = by_year.join(years.select("year", F.lit(True).alias("_c")), "year", "left").groupBy(F.coalesce("_c", F.lit(False)).alias("is_compound")).agg(*[F.avg(c).alias(c) for c in names])
    weight = cos_latitude(F.col("lat"))
    means = summer.groupBy("time").agg(*[weighted_mean(F.col(c), weight).alias(c) for c in ("wbt", "sh")])
    tops = means.groupBy(F.year("time").alias("year")).agg(F.max("wbt").alias("wbt"), F.max("sh").alias("sh"))
    top = tops.select("year", F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in ("wbt", "sh")])).alias("x")).select("year", "x.*")
    limits = attribution.thresholds_table(fields.sparkSession, range(12, 29))  # 22 to 28 degrees, 12 to 28 g a kg
    asked = "name = 'sh' OR threshold >= 22"
    out = {"maps": metrics.masked_annual(wet, compound_days, "wbt"), "days": by_year, "split": split, "levels": trends.return_levels(top, limits).where(asked), "gev": trends.gev(top)}
    out["periods"] = trends.fitted_periods(top, limits, interval=settings.interval).where(asked)
    slope = lambda df, name: trends.seasonal_trend(df, trend_months, trend_years[name])
    out["sh_trend"] = slope(wet.select("time", *CELL, F.col("sh").alias("v")), "sh")
    if evaporation is not None:
        out["evaporation_trend"] = slope(scaled(evaporation, "v", evaporation_factor), "evaporation")
    if sst is not None:
        out["sst_trend"] = slope(sst, "sst")
    out["trend_fields"] = metrics.joined_fields({n: out[f"{n}_trend"] for n in ("sst", "evaporation", "sh") if f"{n}_trend" in out}, "slope", "_trend")
    out["statistics"] = metrics.humid_statistics(split, out["periods"])
    return out
