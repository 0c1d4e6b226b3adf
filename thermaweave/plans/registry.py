"""Registered queries over the driver's tables and their DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CELL
from ..functions import humid, risk
from ..functions.columns import ratio, rounded
from ..operators import attribution, climatology, compound, daily, events, masks, metrics, pairing, profile, trends
from ..sources import grids
from ..session import Files, shared_dir
from ..streaming.events import close_series, read_batches, run_to_end, session_events, timed_events
from . import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[name] = lambda spark, d: rounded(f(spark, d))
        if sql:
            _SQL[name] = fx.sql(sql)
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


_EVENT = "lat_idx, lon_idx, round(lat, 4) AS lat, round(lon, 4) AS lon, event_start, event_end, duration"


# Climatology and events


@_query("climatology_doy", "SELECT lat_idx, lon_idx, doy, round(thresh, 4) AS thresh FROM ocean_clim")
def _(spark, d):
    return fx.clim(fx.ocean(spark, d), fx.SEA_SHARE)


@_query("climatology_pooled", "SELECT lat_idx, lon_idx, ((dayofyear(time) - 1 + k + 366) % 366 + 1)::INT AS doy, round(quantile_cont(v, 0.9), 4) AS thresh FROM land CROSS JOIN (SELECT unnest(range(-2, 3)) AS k) p WHERE year(time) BETWEEN 1995 AND 1999 GROUP BY ALL")
def _(spark, d):
    return climatology.climatology(fx.land(spark, d), fx.BASE, 0.9, half_width=2)


@_query("exceedance_days", "SELECT lat_idx, lon_idx, time, round(v, 4) AS v, round(thresh, 4) AS thresh FROM land_exceed")
def _(spark, d):
    g = fx.land(spark, d)
    return climatology.exceedance(g, fx.clim(g, fx.LAND_SHARE)).select(*CELL, "time", "v", "thresh")


@_query("marine_events", f"SELECT {_EVENT} FROM ocean_events")
def _(spark, d):
    return fx.sea_events(spark, d)


@_query("land_events", f"SELECT {_EVENT} FROM land_events")
def _(spark, d):
    return fx.land_events(spark, d)


@_query("paired_marine_events", f"SELECT {_EVENT} FROM ocean_events e WHERE EXISTS (SELECT 1 FROM pairs p WHERE p.ocean_lat_idx = e.lat_idx AND p.ocean_lon_idx = e.lon_idx)")
def _(spark, d):
    """Detection on the paired sea cells only."""
    cells = fx.pairs(spark, d).select(F.col("ocean_lat_idx").alias("lat_idx"), F.col("ocean_lon_idx").alias("lon_idx"))
    g = events.restrict_to(fx.ocean(spark, d), cells)
    return events.detect_events(g, fx.clim(g, fx.SEA_SHARE), fx.MIN_DURATION, fx.MAX_GAP, period=fx.BASE)


@_query("min_valid_filter", "SELECT lat_idx, lon_idx, count(v) AS n_values FROM land GROUP BY ALL HAVING count(v) >= 530")
def _(spark, d):
    return climatology.enough_values(fx.land(spark, d), 530).groupBy(*CELL).agg(F.count("v").alias("n_values"))


@_query("pooled_point_events", """WITH one AS (SELECT * FROM land WHERE lat_idx = 2 AND lon_idx = 2),
c AS (SELECT ((dayofyear(time) - 1 + k + 366) % 366 + 1)::INT AS doy, quantile_cont(v, 0.7) AS thresh FROM one CROSS JOIN (SELECT unnest(range(-5, 6)) AS k) p WHERE year(time) BETWEEN 1995 AND 1999 GROUP BY ALL),
e AS (SELECT time, t_idx FROM one JOIN c ON c.doy = least(dayofyear(time), (SELECT max(doy) FROM c)) JOIN (SELECT time, row_number() OVER (ORDER BY time) - 1 AS t_idx FROM (SELECT DISTINCT time FROM one)) USING (time) WHERE v > thresh),
i AS (SELECT *, sum(new) OVER (ORDER BY t_idx ROWS UNBOUNDED PRECEDING) AS event FROM (SELECT *, CASE WHEN t_idx - lag(t_idx) OVER (ORDER BY t_idx) <= 3 THEN 0 ELSE 1 END AS new FROM e))
SELECT min(time) AS event_start, max(time) AS event_end, (max(t_idx) - min(t_idx) + 1)::INT AS duration FROM i GROUP BY event HAVING max(t_idx) - min(t_idx) + 1 >= 3""")
def _(spark, d):
    """One cell with a threshold pooled over eleven days."""
    g = fx.land(spark, d).where("lat_idx = 2 AND lon_idx = 2")
    return events.detect_events(g, climatology.climatology(g, fx.BASE, fx.LAND_SHARE, half_width=5), fx.MIN_DURATION, fx.MAX_GAP).select("event_start", "event_end", "duration")


@_query("regrid_mean", "SELECT time, floor(lat / 0.5::DOUBLE)::INT AS lat_idx, floor(lon / 0.5::DOUBLE)::INT AS lon_idx, round(avg(v), 4) AS v FROM land GROUP BY ALL")
def _(spark, d):
    return climatology.regrid_mean(fx.land(spark, d), 0.5)


_OVERLAP = """SELECT time, y::INT AS lat_idx, ((x % 900 + 900) % 900)::INT AS lon_idx, v, radians(least(e, (x + 1) * 0.4::DOUBLE) - greatest(w, x * 0.4::DOUBLE)) * (sin(radians(least(n, (y + 1) * 0.4::DOUBLE - 90))) - sin(radians(greatest(s, y * 0.4::DOUBLE - 90)))) AS area FROM (
  SELECT *, unnest(range(floor(w / 0.4::DOUBLE)::BIGINT, floor(e / 0.4::DOUBLE)::BIGINT + 1)) AS x FROM (
    SELECT *, unnest(range(floor((s + 90) / 0.4::DOUBLE)::BIGINT, floor((n + 90) / 0.4::DOUBLE)::BIGINT + 1)) AS y FROM (
      SELECT time, v, greatest(lat - 0.125::DOUBLE, -90.0) AS s, least(lat + 0.125::DOUBLE, 90.0) AS n, lon - 0.125::DOUBLE AS w, lon + 0.125::DOUBLE AS e FROM land)))"""


@_query("regrid_conservative", f"SELECT time, lat_idx, lon_idx, round(sum(v * area) / sum(CASE WHEN v IS NOT NULL THEN area END) / pi(), 4) AS v, round(coalesce(sum(CASE WHEN v IS NOT NULL THEN area END), 0.0) * 1e6, 4) AS area FROM ({_OVERLAP}) WHERE area > 1e-15 GROUP BY ALL")
def _(spark, d):
    """Quarter-degree cells on boxes of 0.4 degrees, which cut them; values over pi, so that none lies halfway between two roundings; area in millionths of a square radian."""
    return climatology.regrid_conservative(fx.land(spark, d), 0.4, (0.25, 0.25)).withColumns({"area": F.col("area") * 1e6, "v": F.col("v") / F.pi()})


# Masks and pairs

_FIRST = "SELECT DISTINCT lat_idx, lon_idx, round(lat, 4) AS lat, round(lon, 4) AS lon FROM land WHERE v IS NOT NULL"
_EDGE = "SELECT m.lat_idx, m.lon_idx FROM (SELECT DISTINCT lat_idx, lon_idx FROM {t}) m WHERE (SELECT count(*) FROM (SELECT DISTINCT lat_idx, lon_idx FROM {t}) n WHERE {near}) < {k}"
_CROSS = "abs(n.lat_idx - m.lat_idx) + abs(n.lon_idx - m.lon_idx) = 1"
_SQUARE = "greatest(abs(n.lat_idx - m.lat_idx), abs(n.lon_idx - m.lon_idx)) = 1"


@_query("mask_first", _FIRST + " AND time = (SELECT min(time) FROM land)")
def _(spark, d):
    return masks.valid_mask(fx.land(spark, d), "first")


@_query("mask_any", _FIRST)
def _(spark, d):
    return masks.valid_mask(fx.land(spark, d), "any")


@_query("land_edge", _EDGE.format(t="land", near=_CROSS, k=4))
def _(spark, d):
    return masks.edge(masks.valid_mask(fx.land(spark, d), "any")).select(*CELL)


@_query("coastal_mask", _EDGE.format(t="land", near=_SQUARE, k=8) + " UNION " + _EDGE.format(t="ocean", near=_SQUARE, k=8))
def _(spark, d):
    return masks.coastal_mask(masks.valid_mask(fx.land(spark, d), "any"), masks.valid_mask(fx.ocean(spark, d), "any"))


@_query("coastal_buffer", """SELECT DISTINCT l.lat_idx, l.lon_idx FROM (SELECT DISTINCT lat_idx, lon_idx, lat, lon FROM land) l JOIN (SELECT DISTINCT lat, lon FROM land WHERE lat_idx = 0) c
ON 2 * 6371.0::DOUBLE * asin(least(sqrt(sin(radians(c.lat - l.lat) / 2) ** 2 + cos(radians(l.lat)) * cos(radians(c.lat)) * sin(radians(c.lon - l.lon) / 2) ** 2), 1.0)) <= 60""")
def _(spark, d):
    m = masks.valid_mask(fx.land(spark, d), "any")
    return masks.coastal_buffer(m, m.where("lat_idx = 0"), 60.0).select(*CELL)


@_query("nearest_pairs", "SELECT land_lat_idx, land_lon_idx, ocean_lat_idx, ocean_lon_idx, round(land_lat, 4) AS land_lat, round(land_lon, 4) AS land_lon, round(ocean_lat, 4) AS ocean_lat, round(ocean_lon, 4) AS ocean_lon, round(dist_deg, 4) AS dist_deg FROM pairs")
def _(spark, d):
    return fx.pairs(spark, d)


_GRID4 = "SELECT DISTINCT lat_idx, lon_idx FROM land WHERE (lat_idx * 7 + lon_idx * 3) % 4 <> 0"


@_query("neighbour_pairs", f"""SELECT land_lat_idx, land_lon_idx, ocean_lat_idx, ocean_lon_idx FROM (
  SELECT l.lat_idx AS land_lat_idx, l.lon_idx AS land_lon_idx, o.lat_idx AS ocean_lat_idx, o.lon_idx AS ocean_lon_idx,
    row_number() OVER (PARTITION BY l.lat_idx, l.lon_idx ORDER BY CASE WHEN o.lat_idx < l.lat_idx THEN 0 WHEN o.lat_idx > l.lat_idx THEN 1 WHEN o.lon_idx < l.lon_idx THEN 2 ELSE 3 END) AS k
  FROM ({_GRID4}) l JOIN (SELECT DISTINCT lat_idx, lon_idx FROM land WHERE (lat_idx * 7 + lon_idx * 3) % 4 = 0) o ON abs(l.lat_idx - o.lat_idx) + abs(l.lon_idx - o.lon_idx) = 1
  WHERE l.lat_idx BETWEEN 1 AND 3 AND l.lon_idx BETWEEN 1 AND 3) WHERE k = 1""")
def _(spark, d):
    m = masks.valid_mask(fx.land(spark, d), "any")
    test = (F.col("lat_idx") * 7 + F.col("lon_idx") * 3) % 4 != 0
    return pairing.neighbour_pairs(m.where(test), m.where(~test), 5, 5)


# Compound events and days


@_query("compound_events", "SELECT land_lat_idx, land_lon_idx, round(land_lat, 4) AS land_lat, round(land_lon, 4) AS land_lon, thw_start, thw_end, thw_duration, ocean_lat_idx, ocean_lon_idx, mhw_start, mhw_end, mhw_duration FROM compound")
def _(spark, d):
    return compound.compound_events(fx.sea_events(spark, d), fx.land_events(spark, d), fx.pairs(spark, d))


@_query("standalone_events", "SELECT land_lat_idx, land_lon_idx, round(land_lat, 4) AS land_lat, round(land_lon, 4) AS land_lon, thw_start, thw_end, thw_duration, ocean_lat_idx, ocean_lon_idx FROM standalone")
def _(spark, d):
    return compound.standalone_events(fx.sea_events(spark, d), fx.land_events(spark, d), fx.pairs(spark, d))


_CLASSES = """SELECT class, count(*) AS n_events, sum(duration)::BIGINT AS n_days FROM (
  SELECT e.duration, CASE WHEN p.land_lat_idx IS NULL THEN 'unpaired'
    WHEN EXISTS (SELECT 1 FROM ocean_events o WHERE o.lat_idx = p.ocean_lat_idx AND o.lon_idx = p.ocean_lon_idx AND o.event_start <= e.event_start AND o.event_end >= e.event_end) THEN 'compound'
    WHEN EXISTS (SELECT 1 FROM ocean_events o WHERE o.lat_idx = p.ocean_lat_idx AND o.lon_idx = p.ocean_lon_idx AND o.event_end >= e.event_start AND o.event_start <= e.event_end) THEN 'partial'
    ELSE 'standalone' END AS class
  FROM land_events e LEFT JOIN {pairs} p ON e.lat_idx = p.land_lat_idx AND e.lon_idx = p.land_lon_idx) GROUP BY class"""


@_query("event_classes", _CLASSES.format(pairs="pairs"))
def _(spark, d):
    found = compound.classify_events(fx.sea_events(spark, d), fx.land_events(spark, d), fx.pairs(spark, d))
    return found.groupBy("class").agg(F.count("*").alias("n_events"), F.sum("duration").alias("n_days"))


@_query("coastal_event_classes", _CLASSES.format(pairs="(SELECT * FROM pairs JOIN (" + _EDGE.format(t="land", near=_CROSS, k=4) + ") b ON land_lat_idx = b.lat_idx AND land_lon_idx = b.lon_idx)"))
def _(spark, d):
    """With pairs of coastal land cells only; events of other cells are unpaired."""
    coast = masks.edge(masks.valid_mask(fx.land(spark, d), "any"))
    pairs = pairing.nearest_pairs(coast, masks.valid_mask(fx.ocean(spark, d), "any"), 0.5)
    found = compound.classify_events(fx.sea_events(spark, d), fx.land_events(spark, d), pairs)
    return found.groupBy("class").agg(F.count("*").alias("n_events"), F.sum("duration").alias("n_days"))


@_query("compound_daily", "SELECT * FROM compound_days")
def _(spark, d):
    return fx.compound_days(spark, d)


@_query("marine_daily", "SELECT DISTINCT lat_idx, lon_idx, time FROM ocean_events JOIN ocean_axis ON time BETWEEN event_start AND event_end")
def _(spark, d):
    return daily.events_to_days(fx.sea_events(spark, d), events.time_axis(fx.ocean(spark, d)))


@_query("thw_union_daily", "SELECT * FROM union_days")
def _(spark, d):
    return daily.union_days(fx.compound_days(spark, d), fx.standalone_days(spark, d))


@_query("annual_days", "SELECT year, lat_idx, lon_idx, n_days FROM compound_annual")
def _(spark, d):
    return fx.annual(spark, d)[0].select("year", *CELL, "n_days")


# Ratios and regional series


@_query("chr_annual", "SELECT year, lat_idx, lon_idx, round(value, 4) AS value FROM chr")
def _(spark, d):
    return fx.chr_field(spark, d).select("year", *CELL, "value")


@_query("cooccurrence", "SELECT c.year, c.lat_idx, c.lon_idx, round(CASE WHEN u.n_days > 0 THEN c.n_days / u.n_days END, 4) AS value FROM compound_annual c JOIN union_annual u USING (year, lat_idx, lon_idx)")
def _(spark, d):
    return fx.annual_classes(spark, d).select("year", *CELL, ratio(F.col("n_compound"), F.col("n_thw")).alias("value"))


@_query("spatial_mean", "SELECT year, round(sum(n_days * cos(radians(lat))) / sum(cos(radians(lat))), 4) AS value FROM compound_annual WHERE lat BETWEEN 40.25 AND 40.75 AND lon BETWEEN -0.5 AND 0.25 GROUP BY year")
def _(spark, d):
    return metrics.spatial_mean(fx.annual(spark, d)[0], ("box", 40.25, 40.75, -0.5, 0.25), "n_days")


@_query("ratio_series", "SELECT year, round(sum(value * cos(radians(lat))) / sum(CASE WHEN value IS NOT NULL THEN cos(radians(lat)) END), 4) AS value FROM chr GROUP BY year")
def _(spark, d):
    return metrics.spatial_mean(fx.chr_field(spark, d))


@_query("ratio_summary", "SELECT round(avg(value), 4) AS mean_value, round(max(value), 4) AS max_value FROM chr")
def _(spark, d):
    return metrics.field_summary(fx.chr_field(spark, d))


@_query("coastal_mean_regions", "SELECT name, year, round(value, 4) AS value FROM series")
def _(spark, d):
    return metrics.coastal_means(fx.annual(spark, d)[0], metrics.regions_table(spark, fx.BOXES), "n_days")


@_query("mean_fields", """SELECT lat_idx, lon_idx, round(avg(c.n_days), 4) AS compound, round(avg(s.n_days), 4) AS standalone, round(avg(r.value), 4) AS ratio
FROM compound_annual c JOIN standalone_annual s USING (year, lat_idx, lon_idx) JOIN chr r USING (year, lat_idx, lon_idx) WHERE year BETWEEN 1996 AND 2000 GROUP BY lat_idx, lon_idx""")
def _(spark, d):
    rows = fx.annual_classes(spark, d).where(F.col("year").between(1996, 2000))
    return rows.groupBy(*CELL).agg(F.avg("n_compound").alias("compound"), F.avg("n_standalone").alias("standalone"), F.avg(ratio(F.col("n_compound"), F.col("n_standalone"))).alias("ratio"))


@_query("selected_years", "SELECT year, lat_idx, lon_idx, n_days FROM compound_annual WHERE year IN (1996, 1998, 2000) AND n_days > 0")
def _(spark, d):
    return metrics.selected_years(fx.annual(spark, d)[0], (1996, 1998, 2000)).select("year", *CELL, "n_days")


@_query("positive_p95", "SELECT round(quantile_cont(n_days, 0.95), 4) AS value FROM compound_annual WHERE n_days > 0")
def _(spark, d):
    return metrics.positive_percentile(fx.annual(spark, d)[0])


@_query("peak_years", "SELECT name, year, round(value, 4) AS value, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY value DESC NULLS LAST, year) AS rank FROM series) WHERE rank <= 3")
def _(spark, d):
    return metrics.peak_years(metrics.coastal_means(fx.annual(spark, d)[0], metrics.regions_table(spark, fx.BOXES), "n_days"))


_CONVEX = """SELECT name, round(a, 4) AS a, round(b, 4) AS b, round(my - a * mx - b * mq, 4) AS c FROM (
  SELECT name, mx, mq, my, unnest([{'e': a * a * uu + b * b * ww + 2 * a * b * uw - 2 * a * uz - 2 * b * wz, 'a': a, 'b': b}], recursive := true), row_number() OVER (PARTITION BY name ORDER BY a * a * uu + b * b * ww + 2 * a * b * uw - 2 * a * uz - 2 * b * wz, a, b) AS k FROM (
    SELECT *, unnest([(uz * ww - wz * uw) / (uu * ww - uw * uw), uz / uu, 0.0, 0.0]) AS a, unnest([(wz * uu - uz * uw) / (uu * ww - uw * uw), 0.0, wz / ww, 0.0]) AS b FROM (
      SELECT name, any_value(mx) AS mx, any_value(mq) AS mq, any_value(my) AS my, sum(u * u) AS uu, sum(w * w) AS ww, sum(u * w) AS uw, sum(u * z) AS uz, sum(w * z) AS wz FROM (
        SELECT *, x - mx AS u, x * x - mq AS w, value - my AS z FROM (
          SELECT name, (year - 1983)::DOUBLE AS x, value, avg((year - 1983)::DOUBLE) OVER p AS mx, avg(((year - 1983) * (year - 1983))::DOUBLE) OVER p AS mq, avg(value) OVER p AS my FROM series WINDOW p AS (PARTITION BY name)))
      GROUP BY name)) WHERE a >= 0 AND b >= 0) WHERE k = 1"""


@_query("convex_trend", _CONVEX)
def _(spark, d):
    return trends.convex_trend(metrics.coastal_means(fx.annual(spark, d)[0], metrics.regions_table(spark, fx.BOXES), "n_days"))


@_query("annual_wide", "SELECT lat_idx, lon_idx, max(CASE WHEN year = 1996 THEN n_days END) AS \"1996\", max(CASE WHEN year = 1997 THEN n_days END) AS \"1997\", max(CASE WHEN year = 1998 THEN n_days END) AS \"1998\" FROM compound_annual GROUP BY lat_idx, lon_idx")
def _(spark, d):
    return metrics.wide_by_year(fx.annual(spark, d)[0], (1996, 1997, 1998))


# Humid heat

_ES = "(6.112 * exp(17.67 * {x} / ({x} + 243.5)))"
_RH = f"greatest(least({_ES.format(x='d2m')} / {_ES.format(x='tmax')} * 100.0, 100.0), 0.0)"
_STULL = f"(tmax * atan(0.151977 * sqrt({_RH} + 8.313659)) + atan(tmax + {_RH}) - atan({_RH} - 1.676331) + 0.00391838 * pow({_RH}, 1.5) * atan(0.023101 * {_RH}) - 4.686035)"
_CLOSED = f"(tmax - (tmax - d2m) / (1.0 + 0.00066 * (1.0 + 0.00115 * {_ES.format(x='d2m')}) * (sp / 100.0) / 10.0))"
_SH = f"(1000.0 * (0.622 * {_ES.format(x='d2m')} / (sp / 100.0 - 0.378 * {_ES.format(x='d2m')})))"
_KEY = ("l_orderkey", "l_linenumber", "time", *CELL)


def _humid(name: str, text: str, column) -> None:
    @_query(name, f"SELECT {', '.join(_KEY)}, round({text}, 4) AS value FROM humid")
    def _(spark, d):
        return fx.humid(spark, d).select(*_KEY, column().alias("value"))


_humid("relative_humidity", _RH, lambda: humid.relative_humidity(F.col("tmax"), F.col("d2m")))
_humid("wbt_stull", _STULL, lambda: humid.wet_bulb(F.col("tmax"), F.col("d2m"), F.col("sp"), "stull"))
_humid("wbt_closed", _CLOSED, lambda: humid.wet_bulb(F.col("tmax"), F.col("d2m"), F.col("sp")))
_humid("specific_humidity", _SH, lambda: humid.specific_humidity(F.col("d2m"), F.col("sp")))


def _wet(spark, d):
    t, td, sp = F.col("tmax"), F.col("d2m"), F.col("sp")
    return fx.humid_daily(spark, d).select("time", *CELL, humid.wet_bulb_stull(t, td).alias("wbt"), humid.specific_humidity(td, sp).alias("sh"))


_MASKED = f"SELECT year(h.time)::INT AS year, h.lat_idx, h.lon_idx, round(avg({_STULL}), 4) AS mean_value, round(max({_STULL}), 4) AS max_value FROM humid_daily h JOIN {{days}}_days c ON h.time = c.time AND h.lat_idx = c.lat_idx AND h.lon_idx = c.lon_idx GROUP BY ALL"


@_query("compound_wbt_map", _MASKED.format(days="compound"))
def _(spark, d):
    return metrics.masked_annual(_wet(spark, d), fx.compound_days(spark, d), "wbt")


@_query("masked_annual_mean", _MASKED.format(days="standalone"))
def _(spark, d):
    return metrics.masked_annual(_wet(spark, d), fx.standalone_days(spark, d), "wbt")


_WET_DAYS = f"SELECT year(time)::INT AS year, lat_idx, lon_idx, sum(({_STULL} >= 25.5)::INT) AS wbt_days, sum(({_SH} >= 19)::INT) AS sh_days FROM humid_daily WHERE month(time) IN (6, 7, 8) GROUP BY ALL"


_NEAR = "SELECT DISTINCT lat_idx, lon_idx, 40.0::DOUBLE + 0.25::DOUBLE * lat_idx AS lat FROM humid_daily WHERE lat_idx <= 1"


@_query("humid_stats", f"""SELECT y.year IS NOT NULL AS is_compound, round(avg(wbt_days), 4) AS wbt_days, round(avg(sh_days), 4) AS sh_days FROM (
SELECT year, sum(wbt_days * cos(radians(lat))) / sum(cos(radians(lat))) AS wbt_days, sum(sh_days * cos(radians(lat))) / sum(cos(radians(lat))) AS sh_days FROM ({_WET_DAYS}) JOIN ({_NEAR}) USING (lat_idx, lon_idx) GROUP BY year) d
LEFT JOIN (SELECT year FROM (SELECT year, sum(n_days) AS n FROM compound_annual GROUP BY year) QUALIFY n >= avg(n) OVER ()) y ON d.year = y.year GROUP BY ALL""")
def _(spark, d):
    """Years of at least the mean of compound days against the others, over the cells within 30 km of the southern row."""
    cells = fx.with_place(fx.humid_daily(spark, d).select(*CELL).distinct())
    near = masks.coastal_buffer(cells, cells.where("lat_idx = 0"), 30.0)
    summer = _wet(spark, d).where(F.month("time").isin(6, 7, 8))
    by_year = metrics.regional_days(metrics.threshold_days(summer, {"wbt": 25.5, "sh": 19.0}), near, ("wbt_days", "sh_days"))
    years = metrics.years_above_mean(fx.annual(spark, d)[0])
    return by_year.join(years, "year", "left").groupBy(F.col("n_days").isNotNull().alias("is_compound")).agg(F.avg("wbt_days").alias("wbt_days"), F.avg("sh_days").alias("sh_days"))


@_query("compound_years", "SELECT year, sum(n_days)::BIGINT AS n_days FROM compound_annual GROUP BY year HAVING sum(n_days) > 0")
def _(spark, d):
    return metrics.years_with_days(fx.annual(spark, d)[0])


@_query("jas_trend", "SELECT lat_idx, lon_idx, round(regr_slope(v, year) * 10, 4) AS slope FROM (SELECT lat_idx, lon_idx, year(time) AS year, avg(v) AS v FROM ocean WHERE month(time) IN (7, 8, 9) GROUP BY ALL) GROUP BY ALL")
def _(spark, d):
    return trends.seasonal_trend(fx.ocean(spark, d))


@_query("monthly_trend", "SELECT lat_idx, lon_idx, round(regr_slope(v, year) * 10, 4) AS slope FROM (SELECT lat_idx, lon_idx, year(time) AS year, avg(v) AS v FROM monthly GROUP BY ALL) GROUP BY ALL")
def _(spark, d):
    return trends.seasonal_trend(fx.monthly(spark, d), months=())


_MONTHLY = "SELECT lat_idx, lon_idx, year(time) AS year, avg(v * 0.1) AS v FROM monthly WHERE month(time) IN (7, 8, 9) AND year(time) BETWEEN 1991 AND 2020 GROUP BY ALL"
_SLOPE = "SELECT lat_idx, lon_idx, CASE WHEN slope = 0 THEN 0.0::DOUBLE ELSE slope END AS slope FROM (SELECT lat_idx, lon_idx, round(regr_slope(v, year) * 10, 4) AS slope FROM ({}) GROUP BY ALL)"


def _without_sign_of_zero(df, *columns):
    """A slope that rounds to zero is 0, whichever side of it the sums left it on."""
    return df.withColumns({c: F.when(F.round(c, 4) == 0, 0.0).otherwise(F.col(c)) for c in columns})
_SH_YEARS = f"SELECT lat_idx, lon_idx, year(time) AS year, avg({_SH}) AS v FROM humid_daily WHERE month(time) IN (7, 8, 9) AND year(time) BETWEEN 1994 AND 2023 GROUP BY ALL"
_SST_YEARS = "SELECT lat_idx, lon_idx, year(time) AS year, avg(v) AS v FROM ocean WHERE month(time) IN (7, 8, 9) AND year(time) BETWEEN 1994 AND 2023 GROUP BY ALL"


@_query("sh_trend", _SLOPE.format(_SH_YEARS))
def _(spark, d):
    return _without_sign_of_zero(_humid_run(spark, d)["sh_trend"], "slope")


@_query("evaporation_trend", _SLOPE.format(_MONTHLY))
def _(spark, d):
    """Monthly evaporation under a long name, picked, renamed and scaled."""
    raw = fx.monthly(spark, d).withColumnRenamed("v", "monthly_mean_evaporation")
    return _without_sign_of_zero(_humid_run(spark, d, grids.select_variable(raw, "monthly_mean_evaporation", "v"), 0.1)["evaporation_trend"], "slope")


@_query("short_trend", _SLOPE.format(_SST_YEARS.replace("1994 AND 2023", "1996 AND 1999").replace("(7, 8, 9)", "(1, 2)")))
def _(spark, d):
    """Months and years that leave part of the series out."""
    return _without_sign_of_zero(trends.seasonal_trend(fx.ocean(spark, d), (1, 2), (1996, 1999)), "slope")


@_query("trend_fields", f"""SELECT * FROM (SELECT lat_idx, lon_idx, slope AS sst_trend FROM ({_SLOPE.format(_SST_YEARS)})) FULL JOIN (SELECT lat_idx, lon_idx, slope AS evaporation_trend FROM ({_SLOPE.format(_MONTHLY)})) USING (lat_idx, lon_idx)
FULL JOIN (SELECT lat_idx, lon_idx, slope AS sh_trend FROM ({_SLOPE.format(_SH_YEARS)})) USING (lat_idx, lon_idx)""")
def _(spark, d):
    """The three trends as one table, a row a cell."""
    return _without_sign_of_zero(_humid_run(spark, d, fx.monthly(spark, d), 0.1, fx.ocean(spark, d))["trend_fields"], "sst_trend", "evaporation_trend", "sh_trend")


@_query("return_level", f"""SELECT name, threshold, round(p, 4) AS p, round(CASE WHEN p > 0 THEN 1 / p ELSE 'Infinity'::DOUBLE END, 4) AS period FROM (
SELECT 'lat' || lat_idx AS name, threshold, avg((value >= threshold)::INT)::DOUBLE AS p FROM (SELECT lat_idx, year(time) AS year, max({_STULL}) AS value FROM humid_daily GROUP BY ALL) CROSS JOIN (SELECT unnest(range(22, 36))::INT AS threshold) GROUP BY ALL)""")
def _(spark, d):
    series = _wet(spark, d).groupBy(F.concat(F.lit("lat"), F.col("lat_idx")).alias("name"), F.year("time").alias("year")).agg(F.max("wbt").alias("value"))
    return trends.return_levels(series, attribution.thresholds_table(spark, range(22, 36)))


def _gev(series: str, keys: str) -> str:
    """keys, shape, scale, location of each series (keys, value) by L-moments; unrounded."""
    return f"""SELECT {keys}, -k AS shape, scale, CASE WHEN abs(k) < 1e-6 THEN b0 - 0.5772156649015329 * scale ELSE b0 - scale * (1 - gamma(1 + k)) / k END AS location FROM (
SELECT *, CASE WHEN abs(k) < 1e-6 THEN l2 / ln(2) ELSE l2 * k / ((1 - pow(2.0, -k)) * gamma(1 + k)) END AS scale FROM (
SELECT *, CASE WHEN 7.8590 * c + 2.9554 * c * c > -1 THEN (7.8590 * c + 2.9554 * c * c)::DOUBLE END AS k FROM (
SELECT *, CASE WHEN 3 * b2 - b0 <> 0 THEN l2 / (3 * b2 - b0) - ln(2) / ln(3) END AS c FROM (
SELECT *, CASE WHEN 2 * b1 - b0 > 1e-9 * greatest(abs(b0), 1e-9) THEN 2 * b1 - b0 END AS l2 FROM (
SELECT {keys}, avg(value) AS b0, avg(value * i / (n - 1)) AS b1, avg(value * i * (i - 1) / ((n - 1) * (n - 2))) AS b2 FROM (
SELECT {keys}, value, row_number() OVER (PARTITION BY {keys} ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY {keys}) AS n FROM ({series}) WHERE value IS NOT NULL) WHERE n >= 3 GROUP BY {keys})))))"""


_CELLS_WET = f"SELECT 'cell' || lat_idx || '-' || lon_idx AS name, year(time) AS year, avg({_STULL}) AS value FROM humid_daily GROUP BY ALL"


@_query("gev_levels", f"SELECT name, round(shape, 4) AS shape, round(scale, 4) AS scale, round(location, 4) AS location FROM ({_gev(_CELLS_WET, 'name')})")
def _(spark, d):
    series = _wet(spark, d).groupBy(F.concat(F.lit("cell"), F.col("lat_idx"), F.lit("-"), F.col("lon_idx")).alias("name"), F.year("time").alias("year")).agg(F.avg("wbt").alias("value"))
    return trends.gev(series)


# Attribution


@_query("member_annual_days", "SELECT forcing, member, year, n_days FROM ensemble")
def _(spark, d):
    return fx.ensemble(spark, d)


@_query("member_events", """SELECT forcing, member, min(time) AS event_start, max(time) AS event_end, (max(t_idx) - min(t_idx) + 1)::INT AS duration FROM (
  SELECT *, sum(new) OVER (PARTITION BY forcing, member ORDER BY t_idx ROWS UNBOUNDED PRECEDING) AS event FROM (
    SELECT *, CASE WHEN t_idx - lag(t_idx) OVER (PARTITION BY forcing, member ORDER BY t_idx) <= 3 THEN 0 ELSE 1 END AS new FROM (
      SELECT forcing, member, time, t_idx FROM (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'ALL' ELSE 'FixGHG' END AS forcing, lpad((o_custkey % 20 + 1)::VARCHAR, 3, '0') AS member, o_orderdate::DATE AS time, max(o_totalprice) AS v FROM orders GROUP BY ALL)
      JOIN (SELECT time, row_number() OVER (ORDER BY time) - 1 AS t_idx FROM (SELECT DISTINCT o_orderdate::DATE AS time FROM orders)) USING (time) WHERE v > 300000))) GROUP BY forcing, member, event HAVING max(t_idx) - min(t_idx) + 1 >= 3""")
def _(spark, d):
    """The same detection with forcing and member as keys."""
    rows = fx.read(spark, d, "orders").select(F.when(F.col("o_orderkey") % 2 == 0, "ALL").otherwise("FixGHG").alias("forcing"), F.lpad((F.col("o_custkey") % 20 + 1).cast("string"), 3, "0").alias("member"), F.to_date("o_orderdate").alias("time"), F.col("o_totalprice").alias("v"))
    g = rows.groupBy("forcing", "member", "time").agg(F.max("v").alias("v")).withColumns({"lat": F.lit(0.0), "lon": F.lit(0.0)})
    return events.islands(g.where("v > 300000").join(events.time_axis(g), "time"), 3, 2, ("forcing", "member")).drop("lat", "lon")


@_query("exceed_probability", "SELECT threshold, round(p_all, 4) AS p_all, round(p_fix, 4) AS p_fix, round(CASE WHEN p_fix <= 0 THEN 1.0 WHEN p_all <= 0 THEN '-Infinity'::DOUBLE ELSE 1.0 - p_fix / p_all END::DOUBLE, 4) AS far, round(CASE WHEN p_fix <= 0 THEN 'Infinity'::DOUBLE ELSE p_all / p_fix END::DOUBLE, 4) AS pr FROM risk")
def _(spark, d):
    p = attribution.probability(attribution.member_hits(fx.ensemble(spark, d), attribution.thresholds_table(spark, range(10, 100, 5))))
    return p.withColumns({"far": risk.far(F.col("p_all"), F.col("p_fix")), "pr": risk.probability_ratio(F.col("p_all"), F.col("p_fix"))})


def _boot(spark, d):
    return attribution.bootstrap(attribution.member_hits(fx.ensemble(spark, d), attribution.thresholds_table(spark, range(10, 100, 5))), 200)


@_query("bootstrap_samples", "SELECT replicate, threshold, round(p_all, 4) AS p_all, round(p_fix, 4) AS p_fix, round(far, 4) AS far, round(pr, 4) AS pr FROM boot")
def _(spark, d):
    return _boot(spark, d)


def _bound(c: str, q: float) -> str:
    """Percentile of the sorted list c of n + 1 values; equal neighbours, infinite ones too, are not subtracted."""
    low, high = f"{c}[floor({q} * n)::INT + 1]", f"{c}[ceil({q} * n)::INT + 1]"
    return f"round(CASE WHEN {low} = {high} THEN {low} ELSE (ceil({q} * n) - {q} * n) * {low} + ({q} * n - floor({q} * n)) * {high} END::DOUBLE, 4)"


def _summary(boot: str) -> str:
    """By threshold mean and interval of far and pr over all draws; infinite values are values."""
    bounds = ", ".join(f"{_bound(c, q)} AS {c}_{n}" for c in ("far", "pr") for n, q in (("low", 0.05), ("high", 0.95)))
    return f"""SELECT threshold, round(far_mean, 4) AS far_mean, round(pr_mean, 4) AS pr_mean, {bounds} FROM (
SELECT threshold, CASE WHEN bool_or(isinf(far)) THEN '-Infinity'::DOUBLE ELSE avg(CASE WHEN NOT isinf(far) THEN far END) END AS far_mean, CASE WHEN bool_or(isinf(pr)) THEN 'Infinity'::DOUBLE ELSE avg(CASE WHEN NOT isinf(pr) THEN pr END) END AS pr_mean,
  list_sort(list(far)) AS far, list_sort(list(pr)) AS pr, (count(*) - 1)::DOUBLE AS n FROM {boot} GROUP BY threshold)"""


@_query("bootstrap_far_pr", f"""SELECT threshold, {_bound('far', 0.5)} AS far, {_bound('pr', 0.5)} AS pr, round(p_all, 4) AS p_all, round(p_fix_low, 4) AS p_fix_low, round(p_fix_high, 4) AS p_fix_high FROM (
SELECT threshold, median(p_all) AS p_all, quantile_cont(p_fix, 0.05) AS p_fix_low, quantile_cont(p_fix, 0.95) AS p_fix_high, list_sort(list(far)) AS far, list_sort(list(pr)) AS pr, (count(*) - 1)::DOUBLE AS n FROM boot GROUP BY threshold)""")
def _(spark, d):
    middle = [F.percentile(c, F.lit(0.5)).alias(c) for c in ("far", "pr", "p_all")]
    return _boot(spark, d).groupBy("threshold").agg(*middle, F.percentile("p_fix", F.lit(0.05)).alias("p_fix_low"), F.percentile("p_fix", F.lit(0.95)).alias("p_fix_high"))


@_query("bootstrap_intervals", _summary("boot"))
def _(spark, d):
    return attribution.summary(_boot(spark, d))


_PERIODS = "SELECT threshold, CASE WHEN p_all <= 0 THEN 'Infinity'::DOUBLE ELSE 1.0 / p_all END::DOUBLE AS period_all, CASE WHEN p_fix <= 0 THEN 'Infinity'::DOUBLE ELSE 1.0 / p_fix END::DOUBLE AS period_fix FROM risk"


def _periods(spark, d):
    return attribution.return_periods(attribution.probability(attribution.member_hits(fx.ensemble(spark, d), attribution.thresholds_table(spark, range(10, 100, 5)))))


@_query("return_period", f"SELECT threshold, round(period_all, 4) AS period_all, round(period_fix, 4) AS period_fix FROM ({_PERIODS})")
def _(spark, d):
    return _periods(spark, d)


@_query("period_levels", f"SELECT years::INT AS years, min(CASE WHEN period_all >= years THEN threshold END) AS level_all, min(CASE WHEN period_fix >= years THEN threshold END) AS level_fix FROM ({_PERIODS}) CROSS JOIN (SELECT unnest([5, 10, 20, 50, 100]) AS years) GROUP BY years")
def _(spark, d):
    return attribution.period_levels(_periods(spark, d))


_RISK = ("threshold", "p_all", "p_fix", "far_mean", "pr_mean", "far_low", "far_high", "pr_low", "pr_high")


@_query("observed_table", f"""SELECT year, n_days, {", ".join(f"arg_max({c}, threshold) AS {c}" for c in _RISK)} FROM (SELECT year, max(n_days)::BIGINT AS n_days FROM ensemble GROUP BY year)
LEFT JOIN (SELECT threshold, round(p_all, 4) AS p_all, round(p_fix, 4) AS p_fix, s.* EXCLUDE (threshold) FROM risk JOIN ({_summary("boot")}) s USING (threshold)) ON threshold <= n_days GROUP BY ALL""")
def _(spark, d):
    """The largest count of a year in the attribution curve: probabilities, FAR, PR and their intervals."""
    from ..config import Settings
    from .pipelines import run_attribution

    observed = fx.ensemble(spark, d).groupBy("year").agg(F.max("n_days").alias("n_days"))
    return run_attribution(fx.ensemble(spark, d), Settings(bootstraps=200), observed)["observed"].select("year", "n_days", *_RISK)


@_query("member_compound_annual", "SELECT * FROM member_annual")
def _(spark, d):
    """Detection, pairing, classes and days of every member, from its daily fields."""
    a = _members(spark, d)
    key = ["forcing", "member", "year", *CELL]
    return a["compound_annual"].select(*key, F.col("n_days").alias("n_compound")).join(a["standalone_annual"].select(*key, F.col("n_days").alias("n_standalone")), key)


@_query("attribution_from_fields", """SELECT threshold, round(avg((n_compound >= threshold)::INT) FILTER (WHERE forcing = 'ALL'), 4)::DOUBLE AS p_all, round(avg((n_compound >= threshold)::INT) FILTER (WHERE forcing = 'FixGHG'), 4)::DOUBLE AS p_fix
FROM member_annual CROSS JOIN (SELECT unnest([1, 3, 5, 10, 20, 40, 80])::INT AS threshold) GROUP BY threshold""")
def _(spark, d):
    return _members(spark, d)["probability"]


def _members(spark, d):
    from ..config import Settings
    from .pipelines import run_ensemble

    s = Settings(base_period=fx.BASE, min_duration=fx.MIN_DURATION, max_gap=fx.MAX_GAP, percentile=fx.MEMBER_SEA_SHARE, land_percentile=fx.MEMBER_LAND_SHARE, land_min_valid=0, thresholds=(1, 3, 5, 10, 20, 40, 80), bootstraps=50)
    return run_ensemble(fx.member_ocean(spark, d), fx.member_land(spark, d), s, mask="any")


# Sources, checks, streams


@_query("grid_profile", "SELECT count(*) AS n_rows, count(DISTINCT time) AS n_times, count(DISTINCT lat_idx) AS n_lats, count(DISTINCT lon_idx) AS n_lons, min(time) AS first_day, max(time) AS last_day, round(min(v), 4) AS min_value, round(max(v), 4) AS max_value, round(avg((v IS NULL)::INT), 4) AS missing_share, CASE WHEN abs(count(DISTINCT time) - 2499) > 10 THEN 'warn' ELSE 'ok' END AS status FROM ocean")
def _(spark, d):
    return profile.profile_grid(fx.ocean(spark, d), (2499, 5, 5))


@_query("merge_sources", "SELECT l_orderkey AS cell, l_linenumber AS line, l_shipdate::DATE AS time, round(l_quantity, 4) AS v FROM lineitem WHERE l_shipdate::DATE BETWEEN '1996-01-01' AND '2000-12-31'")
def _(spark, d):
    """Three year ranges with different column names, merged and clipped."""
    rows = fx.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("cell"), F.col("l_linenumber").alias("line"), F.col("l_shipdate").alias("time"), F.col("l_quantity").alias("v"))
    year = F.year("time")
    parts = [rows.where(year < 1997).withColumnRenamed("v", "tg"), rows.where((year >= 1997) & (year < 1999)).withColumnRenamed("v", "T2m"), rows.where(year >= 1999)]
    return grids.merge_sources(parts, "1996-01-01", "2000-12-31")


_RAW = """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN '1997-02-3' || (l_orderkey % 10) ELSE strftime(l_shipdate, '%Y-%m-%d') END AS time, CASE WHEN l_linenumber = 6 AND l_orderkey % 2 = 0 THEN ' ' WHEN l_quantity = 50 THEN 'n/a' ELSE (l_quantity::INT)::VARCHAR END AS v FROM lineitem"""


@_query("rows_set_aside", f"""SELECT l_orderkey, l_linenumber, time, v, list_aggregate(list_filter([CASE WHEN trim(time) <> '' AND try_cast(time AS DATE) IS NULL THEN 'time is no date' END, CASE WHEN trim(v) <> '' AND try_cast(v AS DOUBLE) IS NULL THEN 'v is no double' END], lambda x: x IS NOT NULL), 'string_agg', ', ') AS reasons
FROM ({_RAW}) WHERE (trim(time) <> '' AND try_cast(time AS DATE) IS NULL) OR (trim(v) <> '' AND try_cast(v AS DOUBLE) IS NULL)""")
def _(spark, d):
    """Rows with impossible days or with texts for values, from one pass over the table."""
    raw = fx.read(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.when(F.col("l_linenumber") == 7, F.concat(F.lit("1997-02-3"), (F.col("l_orderkey") % 10).cast("string"))).otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("time"),
        F.when((F.col("l_linenumber") == 6) & (F.col("l_orderkey") % 2 == 0), " ").when(F.col("l_quantity") == 50, "n/a").otherwise(F.col("l_quantity").cast("int").cast("string")).alias("v"))
    _, bad, _ = grids.set_aside(raw, f"{shared_dir(spark)}/aside-{uuid.uuid4().hex}", {"time": "date", "v": "double"}, ("time", "l_orderkey"))
    return bad.withColumn("reasons", F.array_join("reasons", ", "))


@_query("grid_round_trip", "SELECT time, lat_idx, lon_idx, round(lat, 4) AS lat, round(lon, 4) AS lon, round(v, 4) AS v FROM land")
def _(spark, d):
    """A grid written as text, read with its types, stored under a source's names, and loaded by a fallback pattern."""
    root, g = f"{shared_dir(spark)}/trip-{uuid.uuid4().hex}", fx.land(spark, d)
    columns = g.select("time", *CELL, "lat", "lon", "v")
    grids.write_table(columns, f"{root}/text", fmt="csv")
    typed = grids.read_table(spark, f"{root}/text", columns.schema)
    grids.write_table(typed.withColumnsRenamed({"v": "tg", "lat": "latitude", "lon": "longitude"}), f"{root}/raw")
    return grids.load_grid(spark, f"{root}/merged", f"{root}/ra[w]").select("time", *CELL, "lat", "lon", "v")


@_query("ensemble_files", """SELECT 'ALL' AS forcing, lpad((o_custkey % 3 + 1)::VARCHAR, 3, '0') AS member, o_orderdate::DATE AS time, round(max(o_totalprice) - 273.15, 4) AS "T2m" FROM orders GROUP BY ALL""")
def _(spark, d):
    """Members as folders of files; forcing is given, the member is cut from the path, Kelvin become Celsius."""
    root = f"{shared_dir(spark)}/members-{uuid.uuid4().hex}"
    rows = fx.read(spark, d, "orders").groupBy(F.lpad((F.col("o_custkey") % 3 + 1).cast("string"), 3, "0").alias("n"), F.to_date("o_orderdate").alias("time")).agg(F.max("o_totalprice").alias("TREFHT"))
    rows.repartition("n").write.partitionBy("n").parquet(root)
    return grids.load_ensemble(spark, f"{root}/n=*/*.parquet", "ALL", r"/n=(\d{3})/").select("forcing", "member", "time", "T2m")


@_query("stage_reuse", "SELECT stage, n FROM (SELECT 'made' AS stage, count(*) AS n FROM land_events UNION ALL SELECT 'read', count(*) FROM land_events UNION ALL SELECT 'changed', count(*) FROM land_events WHERE duration >= 5)")
def _(spark, d):
    """Events stored by a first run of a stage, taken by a second one, and made anew for a longer least duration."""
    place, g = f"{shared_dir(spark)}/reuse-{uuid.uuid4().hex}", fx.land(spark, d)

    def stage(least: int) -> DataFrame:
        make = lambda: events.events_above_percentile(g, fx.BASE, fx.LAND_SHARE, least, fx.MAX_GAP)
        return grids.materialize(spark, make, place, grids.fingerprint(spark, [g], least=least))

    counts = {name: stage(least).count() for name, least in (("made", fx.MIN_DURATION), ("read", fx.MIN_DURATION), ("changed", 5))}
    return spark.createDataFrame(list(counts.items()), "stage string, n long")


@_query("level_pick", "SELECT l_orderkey AS cell, round(arg_min(v, (abs(lev - 2.0), lev)), 4) AS v FROM (SELECT l_orderkey, l_linenumber - 1.0 AS lev, max(l_extendedprice) AS v FROM lineitem GROUP BY ALL) GROUP BY ALL")
def _(spark, d):
    rows = fx.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("cell"), (F.col("l_linenumber") - F.lit(1.0)).alias("lev")).agg(F.max("l_extendedprice").alias("v"))
    return grids.nearest_level(rows, at=2.0, keys=("cell",))


@_query("member_surface", "SELECT l_orderkey AS cell, 'ALL' AS forcing, '001' AS member, round(arg_min(v, lev) - 273.15, 4) AS \"SST\" FROM (SELECT l_orderkey, l_linenumber - 1.0 AS lev, max(l_quantity) + 273.15 AS v FROM lineitem GROUP BY ALL) GROUP BY ALL")
def _(spark, d):
    """A member's sea field in Kelvin with levels: its surface in Celsius."""
    rows = fx.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("cell"), (F.col("l_linenumber") - F.lit(1.0)).alias("lev")).agg((F.max("l_quantity") + F.lit(273.15)).alias("TEMP"))
    return grids.load_member(rows, "ALL", "001", keys=("cell",)).select("cell", "forcing", "member", "SST")


_SESSIONS = """SELECT user_id, min(day) AS event_start, max(day) AS event_end, (max(day) - min(day) + 1)::INT AS duration FROM (
  SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY day ROWS UNBOUNDED PRECEDING) AS event FROM (
    SELECT user_id, day, CASE WHEN day - lag(day) OVER (PARTITION BY user_id ORDER BY day) <= 2 THEN 0 ELSE 1 END AS new FROM (SELECT DISTINCT user_id, ts::DATE AS day FROM events WHERE value > 20)))
GROUP BY user_id, event HAVING max(day) - min(day) + 1 >= 3"""


@_query("stream_sessions", _SESSIONS)
def _(spark, d):
    """The stream's session rule over the stored table; tests hold the stream itself against it."""
    rows = fx.read(spark, d, "events").where("value > 20").select("user_id", F.to_date("ts").alias("time")).distinct()
    return session_events(rows, 3, 1, ("user_id",))


@_query("stream_timed_events", _SESSIONS)
def _(spark, d):
    """The stream itself: all of events in a first run; a second one takes up its state and is told that the series ends."""
    root = f"{shared_dir(spark)}/timed-{uuid.uuid4().hex}"
    Files(spark, f"{root}/clock").make()
    stored = fx.read(spark, d, "events")

    def found():
        rows = spark.readStream.schema(stored.schema).parquet(f"{d}/event[s].parquet").where("value > 20").select("user_id", F.col("ts").alias("time"))
        return timed_events(rows, 3, 1, ("user_id",), late="2 days", clock=spark.readStream.schema("time date").parquet(f"{root}/clock"))

    run_to_end(found(), f"{root}/events", f"{root}/checkpoint")
    last = stored.agg(F.max(F.to_date("ts")).cast("string")).first()[0]
    if last:
        close_series(spark, f"{root}/clock", last, 1 + 2 + 2)
        run_to_end(found(), f"{root}/events", f"{root}/checkpoint")
    return read_batches(spark, f"{root}/events", found().schema)


# Whole jobs


_COAST = "(lat_idx IN (0, 4) OR lon_idx IN (0, 4)) AND (lat_idx, lon_idx) IN (SELECT (lat_idx, lon_idx) FROM land GROUP BY lat_idx, lon_idx HAVING count(v) >= 500)"


@_query("observational_run", f"""SELECT year, sum(CASE WHEN coast THEN c.n_days ELSE 0 END)::BIGINT AS compound_days, sum(CASE WHEN coast THEN s.n_days ELSE 0 END)::BIGINT AS standalone_days, sum(CASE WHEN coast THEN u.n_days ELSE 0 END)::BIGINT AS thw_days, round(avg(CASE WHEN coast THEN r.value END), 4) AS mean_ratio
FROM (SELECT *, {_COAST} AS coast FROM compound_annual) c JOIN standalone_annual s USING (year, lat_idx, lon_idx) JOIN union_annual u USING (year, lat_idx, lon_idx) JOIN chr r USING (year, lat_idx, lon_idx) GROUP BY year""")
def _(spark, d):
    """The observational job's annual totals, with its coast and with a least number of valid days that some cells miss."""
    from ..config import Settings
    from .pipelines import run_observational

    s = Settings(base_period=fx.BASE, min_duration=fx.MIN_DURATION, max_gap=fx.MAX_GAP, percentile=fx.SEA_SHARE, land_percentile=fx.LAND_SHARE, land_min_valid=500)
    found = run_observational(fx.ocean(spark, d), fx.land(spark, d), s, mask="any")
    key = ["year", *CELL]
    c, a, t = (found[n].select(*key, F.col("n_days").alias(m)) for n, m in (("compound_annual", "compound_days"), ("standalone_annual", "standalone_days"), ("thw_annual", "thw_days")))
    rows = c.join(a, key).join(t, key).withColumn("value", ratio(F.col("compound_days"), F.col("standalone_days")))
    return rows.groupBy("year").agg(F.sum("compound_days").alias("compound_days"), F.sum("standalone_days").alias("standalone_days"), F.sum("thw_days").alias("thw_days"), F.avg("value").alias("mean_ratio"))


@_query("attribution_run", _summary("boot"))
def _(spark, d):
    from ..config import Settings
    from .pipelines import run_attribution

    return run_attribution(fx.ensemble(spark, d), Settings(bootstraps=200))["summary"]


@_query("attribution_summary", _summary("all_boot"))
def _(spark, d):
    """All thresholds over all draws of the defaults; infinite values are values."""
    from .pipelines import run_attribution

    return run_attribution(fx.ensemble(spark, d))["summary"]


def _humid_run(spark, d, evaporation=None, factor=1.0, sst=None):
    """The humid job; its coast is the southern row of cells, its buffer 30 km."""
    from ..config import Settings
    from .pipelines import run_humid

    fields = fx.with_place(fx.humid_daily(spark, d))
    cells = fields.select(*CELL, "lat", "lon").distinct()
    return run_humid(fields, fx.compound_days(spark, d), cells, cells.where("lat_idx = 0"), Settings(buffer_km=30.0), evaporation=evaporation, evaporation_factor=factor, sst=sst)


@_query("humid_run", f"""SELECT year, round(sum(wbt_days * cos(radians(lat))) / sum(cos(radians(lat))), 4) AS wbt_days, round(sum(sh_days * cos(radians(lat))) / sum(cos(radians(lat))), 4) AS sh_days FROM (
SELECT year(time)::INT AS year, lat_idx, lon_idx, sum(({_CLOSED} >= 25.5)::INT) AS wbt_days, sum(({_SH} >= 19)::INT) AS sh_days FROM humid_daily WHERE month(time) IN (6, 7, 8) GROUP BY ALL) JOIN ({_NEAR}) USING (lat_idx, lon_idx) GROUP BY year""")
def _(spark, d):
    return _humid_run(spark, d)["days"]


_TOPS = f"""SELECT unnest(['wbt', 'sh']) AS name, year, unnest([max(wbt), max(sh)]) AS value FROM (
SELECT time, year(time) AS year, sum({_CLOSED} * cos(radians(lat))) / sum(cos(radians(lat))) AS wbt, sum({_SH} * cos(radians(lat))) / sum(cos(radians(lat))) AS sh FROM humid_daily JOIN ({_NEAR}) USING (lat_idx, lon_idx) WHERE month(time) IN (6, 7, 8) GROUP BY ALL) GROUP BY year"""


@_query("humid_levels", f"""SELECT name, threshold, round(p, 4) AS p, round(CASE WHEN p > 0 THEN 1 / p ELSE 'Infinity'::DOUBLE END, 4) AS period FROM (SELECT name, threshold, avg((value >= threshold)::INT)::DOUBLE AS p FROM ({_TOPS})
CROSS JOIN (SELECT unnest(range(12, 29))::INT AS threshold) WHERE name = 'sh' OR threshold >= 22 GROUP BY ALL)""")
def _(spark, d):
    """Return levels of the coastal buffer's mean series."""
    return _humid_run(spark, d)["levels"]


def _chance(x: str) -> str:
    """Probability of a value above x by shape, scale and location; chances below 1e-9 count as never."""
    z = f"(({x} - location) / scale)"
    return f"CASE WHEN abs(shape) < 1e-6 THEN 1 - exp(-exp(-{z})) WHEN 1 + shape * {z} > 0 THEN 1 - exp(-pow(1 + shape * {z}, -1 / shape)) WHEN shape > 0 THEN 1.0 WHEN shape < 0 THEN 0.0 END"


def _log_period(p: str) -> str:
    """Periods cover many powers of ten, so what is compared is their logarithm; never: null."""
    return f"CASE WHEN {p} >= 1e-8 THEN round(-log10({p}), 4) END"


_DRAWN = "(('0x' || substr(md5(name || '-' || replicate || '-' || slot), 1, 8))::BIGINT + 0.5) / 4294967296.0::DOUBLE"
_AGAIN = f"""SELECT name, replicate, location + scale * CASE WHEN abs(shape) < 1e-6 THEN -ln(-ln(u)) ELSE (pow(-ln(u), -shape) - 1) / shape END AS value
FROM (SELECT *, {_DRAWN} AS u FROM (SELECT f.*, r.replicate, s.slot FROM fit f JOIN (SELECT name, count(value) AS n FROM tops GROUP BY name) USING (name) CROSS JOIN (SELECT unnest(range(1, 201)) AS replicate) r JOIN (SELECT unnest(range(1, 1001)) AS slot) s ON s.slot <= n WHERE scale IS NOT NULL))"""


@_query("humid_periods", f"""WITH tops AS ({_TOPS}), fit AS ({_gev("SELECT * FROM tops", "name")}), again AS ({_gev(_AGAIN, "name, replicate")}), asked AS (SELECT unnest(range(12, 29))::INT AS threshold),
ours AS (SELECT name, threshold, {_chance("threshold")} AS p FROM fit CROSS JOIN asked),
bounds AS (SELECT name, threshold, quantile_cont(p, 0.05) AS p_low, quantile_cont(p, 0.95) AS p_high FROM (SELECT name, replicate, threshold, ({_chance("threshold")})::DOUBLE AS p FROM again CROSS JOIN asked) GROUP BY ALL)
SELECT name, threshold, {_log_period("p")} AS log_period, {_log_period("p_high")} AS log_low, {_log_period("p_low")} AS log_high FROM ours LEFT JOIN bounds USING (name, threshold) WHERE name = 'sh' OR threshold >= 22""")
def _(spark, d):
    """Return periods by the fitted distribution with intervals of a parametric bootstrap, 22-28 degrees and 12-28 g a kg."""
    log = lambda c: F.when(F.col(c) <= 1e8, F.log10(c))
    return _humid_run(spark, d)["periods"].select("name", "threshold", log("period").alias("log_period"), log("period_low").alias("log_low"), log("period_high").alias("log_high"))


_CELL_YEARS = f"""SELECT name, round(location + scale * CASE WHEN abs(shape) < 1e-6 THEN -ln(-ln(1 - 1.0::DOUBLE / years)) ELSE (pow(-ln(1 - 1.0::DOUBLE / years), -shape) - 1) / shape END, 4) AS level, years::INT AS years
FROM ({_gev(_CELLS_WET, 'name')}) CROSS JOIN (SELECT unnest([5, 10, 20, 50, 100]) AS years)"""


@_query("fitted_levels", _CELL_YEARS)
def _(spark, d):
    """What each cell's fitted distribution exceeds once in so many years."""
    series = _wet(spark, d).groupBy(F.concat(F.lit("cell"), F.col("lat_idx"), F.lit("-"), F.col("lon_idx")).alias("name"), F.year("time").alias("year")).agg(F.avg("wbt").alias("value"))
    return trends.fitted_levels(trends.gev(series))


def _observed(spark, d, mask: str = "any", coast_only: bool = False):
    """The observational job on the fixture's grids."""
    from ..config import Settings
    from .pipelines import run_observational

    s = Settings(base_period=fx.BASE, min_duration=fx.MIN_DURATION, max_gap=fx.MAX_GAP, percentile=fx.SEA_SHARE, land_percentile=fx.LAND_SHARE, land_min_valid=0)
    return run_observational(fx.ocean(spark, d), fx.land(spark, d), s, coast_only=coast_only, mask=mask)


def _panels(spark, d):
    from .pipelines import panel_tables

    return panel_tables(_observed(spark, d), (1996, 2000), (1996, 1998, 2000), metrics.regions_table(spark, fx.BOXES))


_FIRST_DAY = "(SELECT DISTINCT lat_idx, lon_idx, lat, lon FROM {t} WHERE v IS NOT NULL AND time = (SELECT min(time) FROM {t}))"
_FIRST_PAIRS = f"""(SELECT land_lat_idx, land_lon_idx, ocean_lat_idx, ocean_lon_idx FROM (
  SELECT *, row_number() OVER (PARTITION BY land_lat_idx, land_lon_idx ORDER BY dist, ocean_lat_idx, ocean_lon_idx) AS k FROM (
    SELECT l.lat_idx AS land_lat_idx, l.lon_idx AS land_lon_idx, o.lat_idx AS ocean_lat_idx, o.lon_idx AS ocean_lon_idx,
      sqrt((l.lat - o.lat) ** 2 + (l.lon * cos(radians(l.lat)) - (CASE WHEN o.lon > 180 THEN o.lon - 360 ELSE o.lon END) * cos(radians(o.lat))) ** 2) AS dist
    FROM {_FIRST_DAY.format(t="land")} l JOIN ({_EDGE.format(t=_FIRST_DAY.format(t="land"), near=_CROSS, k=4)}) b ON l.lat_idx = b.lat_idx AND l.lon_idx = b.lon_idx
    CROSS JOIN {_FIRST_DAY.format(t="ocean")} o) WHERE dist <= 0.5) WHERE k = 1)"""


@_query("observational_first_day", _CLASSES.format(pairs=_FIRST_PAIRS))
def _(spark, d):
    """The job's classes with its default mask and coast: cells count as land or sea by their values on the first day,
    and only land cells that lack one of their four neighbours then have a pair."""
    return _observed(spark, d, "first", True)["classes"].groupBy("class").agg(F.count("*").alias("n_events"), F.sum("duration").alias("n_days"))


@_query("panel_ratio_means", "SELECT lat_idx, lon_idx, round(avg(value), 4) AS value FROM chr WHERE year BETWEEN 1996 AND 2000 GROUP BY ALL")
def _(spark, d):
    return _panels(spark, d)["ratio_mean"]


_PANELS = {
    "maps": "SELECT NULL AS name, year, lat_idx, lon_idx, n_days::DOUBLE AS value FROM compound_annual WHERE year IN (1996, 1998, 2000) AND n_days > 0",
    "scale": "SELECT NULL, NULL, NULL, NULL, quantile_cont(n_days, 0.95) FROM compound_annual WHERE n_days > 0",
    "series": "SELECT name, year, NULL, NULL, value FROM series",
    "peaks": "SELECT name, year, NULL, NULL, value FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY value DESC NULLS LAST, year) AS k FROM series) WHERE k <= 3",
    "cooccurrence_mean": "SELECT NULL, NULL, lat_idx, lon_idx, avg(CASE WHEN u.n_days > 0 THEN c.n_days / u.n_days END) FROM compound_annual c JOIN union_annual u USING (year, lat_idx, lon_idx) GROUP BY lat_idx, lon_idx",
    "compound_mean": "SELECT NULL, NULL, lat_idx, lon_idx, avg(n_days) FROM compound_annual WHERE year BETWEEN 1996 AND 2000 GROUP BY lat_idx, lon_idx",
    "standalone_mean": "SELECT NULL, NULL, lat_idx, lon_idx, avg(n_days) FROM standalone_annual WHERE year BETWEEN 1996 AND 2000 GROUP BY lat_idx, lon_idx",
    "ratio_mean": "SELECT NULL, NULL, lat_idx, lon_idx, avg(value) FROM chr WHERE year BETWEEN 1996 AND 2000 GROUP BY lat_idx, lon_idx",
    **{f"trend_{c}": f"SELECT name, NULL, NULL, NULL, {c} FROM ({_CONVEX}) WHERE name IN ('j', 'l')" for c in "abc"},
    "ratio_series": "SELECT NULL, year, NULL, NULL, sum(value * cos(radians(lat))) / sum(CASE WHEN value IS NOT NULL THEN cos(radians(lat)) END) FROM chr GROUP BY year",
}


@_query("panel_rows", "SELECT panel, name, year::INT AS year, lat_idx::INT AS lat_idx, lon_idx::INT AS lon_idx, round(value, 4)::DOUBLE AS value FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS panel, * FROM ({v})" for k, v in _PANELS.items()) + ")")
def _(spark, d):
    """The rows of all figure tables, from the observational job's own; a fitted trend has a row a coefficient."""
    tables = _panels(spark, d)
    tables |= {f"trend_{c}": tables["trend"].select("name", F.col(c).alias("value")) for c in "abc"}
    out = None
    for k in _PANELS:
        df = tables[k].withColumnRenamed("n_days", "value") if "n_days" in tables[k].columns else tables[k]
        part = df.select(F.lit(k).alias("panel"), *[F.col(n).cast(kind).alias(n) if n in df.columns else F.lit(None).cast(kind).alias(n) for n, kind in (("name", "string"), ("year", "int"), ("lat_idx", "int"), ("lon_idx", "int"), ("value", "double"))])
        out = part if out is None else out.unionByName(part)
    return out
