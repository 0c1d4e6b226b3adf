"""Grids, events and ensembles derived from the driver's tables, as DataFrames and as SQL for DuckDB."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.columns import ratio
from ..operators import climatology, compound, daily, events, masks, pairing
from ..session import shared_dir
from ..sources.grids import fingerprint, materialize

BASE = (1995, 1999)
SEA_SHARE, LAND_SHARE, MIN_DURATION, MAX_GAP = 0.5, 0.7, 3, 2
MEMBER_SEA_SHARE, MEMBER_LAND_SHARE = 0.1, 0.3
#: Regions over the fixture's cells (they overlap).
BOXES = (("j", 40.0, 40.5, -0.5, 0.5), ("k", 40.75, 41.0, -0.5, -0.25), ("l", 40.0, 41.0, -0.5, 0.5))


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _cell(key: str) -> dict:
    return {"lat_idx": F.floor(F.col(key) / 5.0).cast("int"), "lon_idx": (F.col(key) % 5).cast("int")}


def _grid(rows: DataFrame, time: str, key: str, value: str, lat0: float, lon0: float) -> DataFrame:
    x = F.lit(lon0) + F.lit(0.25) * F.col("lon_idx")
    out = rows.select(F.to_date(time).alias("time"), *[c.alias(n) for n, c in _cell(key).items()], F.col(value).alias("v")).groupBy("time", "lat_idx", "lon_idx").agg(F.max("v").alias("v"))
    lon = F.when(x < 0, x + 360).otherwise(x) if lon0 == -0.4 else x
    return out.withColumns({"lat": F.lit(lat0) + F.lit(0.25) * F.col("lat_idx"), "lon": lon})


#: Grids of this session: where they lie, and their columns.
_GRIDS: dict[tuple[str, str, str], tuple[str, StructType]] = {}


def _kept(spark: SparkSession, d: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The grid as a table of the shared folder, which a session makes once, unless another has left it there from the
    same input files: a query goes through its grids for values, days and masks."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _GRIDS:
        grid, place = make(), f"{shared_dir(spark)}/grids/{hashlib.sha256(d.encode()).hexdigest()[:16]}-{name}"
        materialize(spark, lambda: grid, place, fingerprint(spark, [grid], grid=name))
        _GRIDS[key] = (place, grid.schema)
    place, schema = _GRIDS[key]
    return spark.read.schema(schema).parquet(place)


def ocean(spark: SparkSession, d: str) -> DataFrame:
    rows = lambda: read(spark, d, "lineitem").join(read(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return _kept(spark, d, "ocean", lambda: _grid(rows(), "l_shipdate", "s_nationkey", "l_extendedprice", 40.1, -0.4))


def land(spark: SparkSession, d: str) -> DataFrame:
    rows = lambda: read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return _kept(spark, d, "land", lambda: _grid(rows(), "o_orderdate", "c_nationkey", "o_totalprice", 40.0, -0.5))


def clim(grid: DataFrame, share: float) -> DataFrame:
    return climatology.climatology(grid, BASE, share)


def sea_events(spark: SparkSession, d: str) -> DataFrame:
    return events.events_above_percentile(ocean(spark, d), BASE, SEA_SHARE, MIN_DURATION, MAX_GAP)


def land_events(spark: SparkSession, d: str) -> DataFrame:
    return events.events_above_percentile(land(spark, d), BASE, LAND_SHARE, MIN_DURATION, MAX_GAP)


def pairs(spark: SparkSession, d: str) -> DataFrame:
    return pairing.nearest_pairs(masks.valid_mask(land(spark, d), "any"), masks.valid_mask(ocean(spark, d), "any"), 0.5)


def land_axis(spark: SparkSession, d: str) -> DataFrame:
    return events.time_axis(land(spark, d))


def compound_days(spark: SparkSession, d: str) -> DataFrame:
    return daily.land_days(compound.compound_events(sea_events(spark, d), land_events(spark, d), pairs(spark, d)), land_axis(spark, d))


def standalone_days(spark: SparkSession, d: str) -> DataFrame:
    return daily.land_days(compound.standalone_events(sea_events(spark, d), land_events(spark, d), pairs(spark, d)), land_axis(spark, d))


def with_place(df: DataFrame) -> DataFrame:
    return df.withColumns({"lat": F.lit(40.0) + F.lit(0.25) * F.col("lat_idx"), "lon": F.lit(-0.5) + F.lit(0.25) * F.col("lon_idx")})


def dense(spark: SparkSession, d: str, days: DataFrame) -> DataFrame:
    g = land(spark, d)
    years = g.select(F.year("time").alias("year"))
    return with_place(daily.densify(daily.annual_days(days), years, g))


def annual(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Dense annual days: compound, stand-alone, both; all from one pass over the events."""
    per = annual_classes(spark, d)
    return tuple(per.select("year", "lat_idx", "lon_idx", "lat", "lon", F.col(c).alias("n_days")) for c in ("n_compound", "n_standalone", "n_thw"))


def annual_classes(spark: SparkSession, d: str) -> DataFrame:
    g = land(spark, d)
    found = compound.classify_events(sea_events(spark, d), land_events(spark, d), pairs(spark, d))
    return with_place(daily.annual_by_class(found, events.time_axis(g), g, g.select(F.year("time").alias("year"))))


def chr_field(spark: SparkSession, d: str) -> DataFrame:
    return annual_classes(spark, d).select("year", "lat_idx", "lon_idx", "lat", "lon", ratio(F.col("n_compound"), F.col("n_standalone")).alias("value"))


def humid(spark: SparkSession, d: str) -> DataFrame:
    """Daily maxima of temperature with dew point and pressure, by sea cell; one row an order line."""
    rows = read(spark, d, "lineitem").join(read(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    t = F.lit(10.0) + F.lit(0.5) * F.col("l_quantity")
    out = rows.select(F.to_date("l_shipdate").alias("time"), *[c.alias(n) for n, c in _cell("s_nationkey").items()], t.alias("tmax"), (t - F.lit(100.0) * F.col("l_discount")).alias("d2m"), (F.lit(101325.0) - F.lit(10000.0) * F.col("l_tax")).alias("sp"), "l_orderkey", "l_linenumber")
    return out


def humid_daily(spark: SparkSession, d: str) -> DataFrame:
    return humid(spark, d).groupBy("time", "lat_idx", "lon_idx").agg(F.max("tmax").alias("tmax"), F.max("d2m").alias("d2m"), F.max("sp").alias("sp"))


def monthly(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "lineitem").join(read(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.select(F.trunc(F.to_date("l_shipdate"), "month").alias("time"), *[c.alias(n) for n, c in _cell("s_nationkey").items()], F.col("l_quantity").alias("v")).groupBy("time", "lat_idx", "lon_idx").agg(F.max("v").alias("v"))


def ensemble(spark: SparkSession, d: str) -> DataFrame:
    """Annual days by forcing and member: distinct order dates."""
    rows = read(spark, d, "orders").select(
        F.when(F.col("o_orderkey") % 2 == 0, "ALL").otherwise("FixGHG").alias("forcing"), F.lpad((F.col("o_custkey") % 20 + 1).cast("string"), 3, "0").alias("member"), F.to_date("o_orderdate").alias("time"))
    return rows.groupBy("forcing", "member", F.year("time").alias("year")).agg(F.count_distinct("time").alias("n_days"))


MEMBER = ("forcing", "member")


def member_land(spark: SparkSession, d: str) -> DataFrame:
    """Daily land fields of two members for each forcing, on five cells."""
    rows = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return _member(rows, "o_orderkey", "o_custkey", "o_orderdate", "c_nationkey", "o_totalprice", 40.0, F.lit(-0.5) + F.lit(0.25) * F.col("lon_idx"))


def member_ocean(spark: SparkSession, d: str) -> DataFrame:
    x = F.lit(-0.4) + F.lit(0.25) * F.col("lon_idx")
    rows = read(spark, d, "lineitem").join(read(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return _member(rows, "l_orderkey", "l_partkey", "l_shipdate", "s_nationkey", "l_extendedprice", 40.1, F.when(x < 0, x + 360).otherwise(x))


def _member(rows: DataFrame, forcing: str, member: str, time: str, key: str, value: str, lat: float, lon) -> DataFrame:
    keys = [F.when(F.col(forcing) % 2 == 0, "ALL").otherwise("FixGHG").alias("forcing"), F.lpad((F.col(member) % 2 + 1).cast("string"), 3, "0").alias("member"), F.to_date(time).alias("time"), F.lit(0).alias("lat_idx"), (F.col(key) % 5).cast("int").alias("lon_idx")]
    return rows.groupBy(*keys).agg(F.max(value).alias("v")).withColumns({"lat": F.lit(lat), "lon": lon})


_LAT, _LON = "40.0::DOUBLE + 0.25::DOUBLE * lat_idx", "-0.5::DOUBLE + 0.25::DOUBLE * lon_idx"


def _island(grid: str, cell: str = "lat_idx, lon_idx") -> str:
    return f"""
SELECT {cell}, any_value(lat) AS lat, any_value(lon) AS lon, min(time) AS event_start, max(time) AS event_end, (max(t_idx) - min(t_idx) + 1)::INT AS duration
FROM (SELECT *, sum(new) OVER (PARTITION BY {cell} ORDER BY t_idx ROWS UNBOUNDED PRECEDING) AS event
  FROM (SELECT *, CASE WHEN t_idx - lag(t_idx) OVER (PARTITION BY {cell} ORDER BY t_idx) <= {MAX_GAP + 1} THEN 0 ELSE 1 END AS new FROM {grid}_exceed))
GROUP BY {cell}, event HAVING max(t_idx) - min(t_idx) + 1 >= {MIN_DURATION}"""


def _per_grid(grid: str, share: float, cell: str = "lat_idx, lon_idx") -> dict[str, str]:
    on = " AND ".join(f"g.{c} = c.{c}" for c in cell.split(", "))
    return {
        f"{grid}_clim": f"SELECT {cell}, dayofyear(time)::INT AS doy, quantile_cont(v, {share}) AS thresh FROM {grid} WHERE year(time) BETWEEN {BASE[0]} AND {BASE[1]} GROUP BY ALL",
        f"{grid}_axis": f"SELECT time, row_number() OVER (ORDER BY time) - 1 AS t_idx FROM (SELECT DISTINCT time FROM {grid})",
        f"{grid}_exceed": f"SELECT g.*, t_idx, c.doy, c.thresh FROM {grid} g JOIN {grid}_clim c ON {on} AND c.doy = least(dayofyear(g.time), (SELECT max(doy) FROM {grid}_clim)) JOIN {grid}_axis USING (time) WHERE g.v > c.thresh",
        f"{grid}_events": _island(grid, cell),
    }


_BY_MEMBER = "forcing, member, lat_idx, lon_idx"


def _member_sql(table: str, forcing: str, member: str, time: str, key: str, value: str, lat: float, lon: str) -> str:
    return f"""SELECT CASE WHEN {forcing} % 2 = 0 THEN 'ALL' ELSE 'FixGHG' END AS forcing, lpad(({member} % 2 + 1)::VARCHAR, 3, '0') AS member, {time}::DATE AS time, 0 AS lat_idx, ({key} % 5)::INT AS lon_idx,
  max({value}) AS v, {lat}::DOUBLE AS lat, {lon} AS lon FROM {table} GROUP BY ALL"""


#: Named subqueries, each after those it refers to.
CTES: dict[str, str] = {
    "ocean": """SELECT l_shipdate::DATE AS time, floor(s_nationkey / 5.0)::INT AS lat_idx, (s_nationkey % 5)::INT AS lon_idx, max(l_extendedprice) AS v,
  40.1::DOUBLE + 0.25::DOUBLE * floor(s_nationkey / 5.0)::INT AS lat, -0.4::DOUBLE + 0.25::DOUBLE * (s_nationkey % 5) + CASE WHEN s_nationkey % 5 < 2 THEN 360 ELSE 0 END AS lon
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL""",
    "land": f"""SELECT time, lat_idx, lon_idx, max(v) AS v, {_LAT} AS lat, {_LON} AS lon FROM (SELECT o_orderdate::DATE AS time, floor(c_nationkey / 5.0)::INT AS lat_idx, (c_nationkey % 5)::INT AS lon_idx, o_totalprice AS v
FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY time, lat_idx, lon_idx""",
    **_per_grid("ocean", SEA_SHARE),
    **_per_grid("land", LAND_SHARE),
    "pairs": """SELECT land_lat_idx, land_lon_idx, ocean_lat_idx, ocean_lon_idx, land_lat, land_lon, ocean_lat, ocean_lon, dist_deg FROM (
  SELECT *, row_number() OVER (PARTITION BY land_lat_idx, land_lon_idx ORDER BY dist_deg, ocean_lat_idx, ocean_lon_idx) AS k FROM (
    SELECT l.lat_idx AS land_lat_idx, l.lon_idx AS land_lon_idx, o.lat_idx AS ocean_lat_idx, o.lon_idx AS ocean_lon_idx, l.lat AS land_lat, l.lon AS land_lon, o.lat AS ocean_lat, o.lon AS ocean_lon,
      sqrt((l.lat - o.lat) ** 2 + (l.lon * cos(radians(l.lat)) - (CASE WHEN o.lon > 180 THEN o.lon - 360 ELSE o.lon END) * cos(radians(o.lat))) ** 2) AS dist_deg
    FROM (SELECT DISTINCT lat_idx, lon_idx, lat, lon FROM land) l CROSS JOIN (SELECT DISTINCT lat_idx, lon_idx, lat, lon FROM ocean) o) WHERE dist_deg <= 0.5) WHERE k = 1""",
    "paired": "SELECT p.*, e.event_start AS thw_start, e.event_end AS thw_end, e.duration AS thw_duration FROM land_events e JOIN pairs p ON e.lat_idx = p.land_lat_idx AND e.lon_idx = p.land_lon_idx",
    "compound": """SELECT land_lat_idx, land_lon_idx, land_lat, land_lon, thw_start, thw_end, thw_duration, ocean_lat_idx, ocean_lon_idx, mhw_start, mhw_end, mhw_duration FROM (
  SELECT p.*, e.event_start AS mhw_start, e.event_end AS mhw_end, e.duration AS mhw_duration, row_number() OVER (PARTITION BY land_lat_idx, land_lon_idx, thw_start ORDER BY e.event_start) AS k
  FROM paired p JOIN ocean_events e ON p.ocean_lat_idx = e.lat_idx AND p.ocean_lon_idx = e.lon_idx AND e.event_start <= thw_start AND e.event_end >= thw_end) WHERE k = 1""",
    "standalone": """SELECT land_lat_idx, land_lon_idx, land_lat, land_lon, thw_start, thw_end, thw_duration, ocean_lat_idx, ocean_lon_idx FROM paired p
WHERE NOT EXISTS (SELECT 1 FROM ocean_events e WHERE p.ocean_lat_idx = e.lat_idx AND p.ocean_lon_idx = e.lon_idx AND e.event_end >= thw_start AND e.event_start <= thw_end)""",
    "compound_days": "SELECT DISTINCT land_lat_idx AS lat_idx, land_lon_idx AS lon_idx, time FROM compound JOIN land_axis ON time BETWEEN thw_start AND thw_end",
    "standalone_days": "SELECT DISTINCT land_lat_idx AS lat_idx, land_lon_idx AS lon_idx, time FROM standalone JOIN land_axis ON time BETWEEN thw_start AND thw_end",
    "union_days": "SELECT * FROM compound_days UNION SELECT * FROM standalone_days",
    "frame": "SELECT year, lat_idx, lon_idx FROM (SELECT DISTINCT year(time)::INT AS year FROM land) CROSS JOIN (SELECT DISTINCT lat_idx, lon_idx FROM land)",
    **{f"{n}_annual": f"SELECT f.year, f.lat_idx, f.lon_idx, coalesce(n, 0)::BIGINT AS n_days, {_LAT.replace('lat_idx', 'f.lat_idx')} AS lat, {_LON.replace('lon_idx', 'f.lon_idx')} AS lon FROM frame f LEFT JOIN (SELECT year(time)::INT AS year, lat_idx, lon_idx, count(*) AS n FROM {n}_days GROUP BY ALL) a ON f.year = a.year AND f.lat_idx = a.lat_idx AND f.lon_idx = a.lon_idx" for n in ("compound", "standalone", "union")},
    "chr": "SELECT c.year, c.lat_idx, c.lon_idx, c.lat, c.lon, CASE WHEN s.n_days > 0 THEN c.n_days / s.n_days END AS value FROM compound_annual c JOIN standalone_annual s USING (year, lat_idx, lon_idx)",
    "boxes": "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)" for n, a, b, c, d in BOXES) + ") t(name, lat0, lat1, lon0, lon1)",
    "in_boxes": "SELECT name, year, lat_idx, lon_idx, lat, n_days AS v FROM compound_annual JOIN boxes ON lat BETWEEN lat0 AND lat1 AND lon BETWEEN lon0 AND lon1",
    "active": "SELECT name, lat_idx, lon_idx, avg(v) > 0 AS active FROM in_boxes GROUP BY ALL",
    "enough": "SELECT name, count(*) FILTER (WHERE active) >= 5 AS enough FROM active GROUP BY ALL",
    "series": """SELECT name, year, sum(CASE WHEN NOT enough OR active THEN v * cos(radians(lat)) END) / sum(CASE WHEN NOT enough OR active THEN cos(radians(lat)) END) AS value
FROM in_boxes JOIN active USING (name, lat_idx, lon_idx) JOIN enough USING (name) GROUP BY name, year""",
    "humid": """SELECT l_shipdate::DATE AS time, floor(s_nationkey / 5.0)::INT AS lat_idx, (s_nationkey % 5)::INT AS lon_idx, 10.0::DOUBLE + 0.5::DOUBLE * l_quantity AS tmax,
  10.0::DOUBLE + 0.5::DOUBLE * l_quantity - 100.0::DOUBLE * l_discount AS d2m, 101325.0::DOUBLE - 10000.0::DOUBLE * l_tax AS sp, l_orderkey, l_linenumber FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""",
    "humid_daily": "SELECT time, lat_idx, lon_idx, max(tmax) AS tmax, max(d2m) AS d2m, max(sp) AS sp FROM humid GROUP BY ALL",
    "monthly": "SELECT date_trunc('month', l_shipdate)::DATE AS time, floor(s_nationkey / 5.0)::INT AS lat_idx, (s_nationkey % 5)::INT AS lon_idx, max(l_quantity) AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL",
    "ensemble": "SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'ALL' ELSE 'FixGHG' END AS forcing, lpad((o_custkey % 20 + 1)::VARCHAR, 3, '0') AS member, year(o_orderdate)::INT AS year, count(DISTINCT o_orderdate::DATE) AS n_days FROM orders GROUP BY ALL",
    "limits": "SELECT unnest(range(10, 100, 5))::INT AS threshold",
    "member_land": _member_sql("orders JOIN customer ON o_custkey = c_custkey", "o_orderkey", "o_custkey", "o_orderdate", "c_nationkey", "o_totalprice", 40.0, "-0.5::DOUBLE + 0.25::DOUBLE * (c_nationkey % 5)"),
    "member_ocean": _member_sql("lineitem JOIN supplier ON l_suppkey = s_suppkey", "l_orderkey", "l_partkey", "l_shipdate", "s_nationkey", "l_extendedprice", 40.1, "-0.4::DOUBLE + 0.25::DOUBLE * (s_nationkey % 5)"),
    **_per_grid("member_land", MEMBER_LAND_SHARE, _BY_MEMBER),
    **_per_grid("member_ocean", MEMBER_SEA_SHARE, _BY_MEMBER),
    "member_classes": f"""SELECT l.forcing, l.member, l.lat_idx, l.lon_idx, l.event_start, l.event_end,
  CASE WHEN bool_or(coalesce(o.event_start <= l.event_start AND o.event_end >= l.event_end, false)) THEN 'compound' WHEN max(o.event_start) IS NOT NULL THEN 'partial' ELSE 'standalone' END AS class
FROM member_land_events l LEFT JOIN member_ocean_events o ON l.forcing = o.forcing AND l.member = o.member AND l.lon_idx = o.lon_idx AND o.event_start <= l.event_end AND o.event_end >= l.event_start GROUP BY ALL""",
    "member_days": "SELECT DISTINCT forcing, member, lat_idx, lon_idx, class, time FROM member_classes JOIN member_land_axis ON time BETWEEN event_start AND event_end WHERE class IN ('compound', 'standalone')",
    "member_annual": f"""SELECT forcing, member, year, lat_idx, lon_idx, coalesce(n_compound, 0)::BIGINT AS n_compound, coalesce(n_standalone, 0)::BIGINT AS n_standalone
FROM (SELECT DISTINCT year(time)::INT AS year FROM member_land) CROSS JOIN (SELECT DISTINCT {_BY_MEMBER} FROM member_land)
LEFT JOIN (SELECT forcing, member, year(time)::INT AS year, lat_idx, lon_idx, count(*) FILTER (WHERE class = 'compound') AS n_compound, count(*) FILTER (WHERE class = 'standalone') AS n_standalone FROM member_days GROUP BY ALL) USING (forcing, member, year, lat_idx, lon_idx)""",
    "hits": "SELECT forcing, member, threshold, sum((n_days >= threshold)::INT) AS hits, count(*) AS total FROM ensemble CROSS JOIN limits GROUP BY ALL",
    "risk": "SELECT threshold, coalesce(sum(hits) FILTER (WHERE forcing = 'ALL') / sum(total) FILTER (WHERE forcing = 'ALL'), 0.0)::DOUBLE AS p_all, coalesce(sum(hits) FILTER (WHERE forcing = 'FixGHG') / sum(total) FILTER (WHERE forcing = 'FixGHG'), 0.0)::DOUBLE AS p_fix FROM hits GROUP BY ALL",
    "numbered": "SELECT forcing, member, row_number() OVER (PARTITION BY forcing ORDER BY member) - 1 AS k FROM (SELECT DISTINCT forcing, member FROM hits)",
    "counts": "SELECT forcing, count(*) AS n FROM numbered GROUP BY ALL",
    "draws": """SELECT r.replicate, t.threshold, c.forcing, ('0x' || substr(md5(r.replicate || '-' || t.threshold || '-' || c.forcing || '-' || s.slot), 1, 8))::BIGINT % c.n AS k
FROM (SELECT unnest(range(200))::INT AS replicate) r CROSS JOIN limits t CROSS JOIN counts c JOIN (SELECT unnest(range(1, 41)) AS slot) s ON s.slot <= c.n""",
    "boot": """SELECT *, CASE WHEN p_fix <= 0 THEN 1.0 WHEN p_all <= 0 THEN '-Infinity'::DOUBLE ELSE 1.0 - p_fix / p_all END::DOUBLE AS far, CASE WHEN p_fix <= 0 THEN 'Infinity'::DOUBLE ELSE p_all / p_fix END::DOUBLE AS pr FROM (
  SELECT replicate, threshold, coalesce(sum(hits) FILTER (WHERE forcing = 'ALL') / sum(total) FILTER (WHERE forcing = 'ALL'), 0.0)::DOUBLE AS p_all, coalesce(sum(hits) FILTER (WHERE forcing = 'FixGHG') / sum(total) FILTER (WHERE forcing = 'FixGHG'), 0.0)::DOUBLE AS p_fix
  FROM draws JOIN numbered USING (forcing, k) JOIN hits USING (forcing, member, threshold) GROUP BY replicate, threshold)""",
}


#: All draws of the method; draws and boot are the 200 of the queries that compare samples.
CTES["all_draws"] = CTES["draws"].replace("range(200)", "range(1000)")
CTES["all_boot"] = CTES["boot"].replace("FROM draws", "FROM all_draws")


def sql(final: str) -> str:
    """`final` behind the subqueries that it needs, directly or through others."""
    import re

    needed: list[str] = []

    def add(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b(?:FROM|JOIN) {name}\b", text):
                add(CTES[name])
                if name not in needed:
                    needed.append(name)

    add(final)
    head = ",\n".join(f"{n} AS ({CTES[n]})" for n in CTES if n in needed)
    if head and final.startswith("WITH "):
        return f"WITH {head},\n{final[5:]}"
    return (f"WITH {head}\n" if head else "") + final
