"""Registered queries against their SQL on the smallest tables (the driver compares all of them on larger ones)."""

import duckdb
import pytest

import __spark_entry__
from thermaweave.plans import registry

SF = "/root/testdata/sf0.001"
NAMES = ["climatology_doy", "marine_events", "land_events", "event_classes", "coastal_mask", "nearest_pairs", "spatial_mean", "wbt_stull", "humid_stats", "bootstrap_samples", "observed_table", "level_pick", "merge_sources", "stream_sessions", "gev_levels", "member_compound_annual", "attribution_from_fields", "humid_levels", "member_surface", "panel_rows", "stream_timed_events", "regrid_conservative", "rows_set_aside", "humid_periods", "observational_first_day", "trend_fields"]


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(columns, found):
    """Sorted names, and the rows with their cells in that order; numbers as floats, dates as text."""
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    cell = lambda v: None if v is None or v != v else float(v) if isinstance(v, (bool, int, float)) else str(v)[:10] if hasattr(v, "year") else v
    return sorted(columns), sorted((tuple(cell(r[k]) for k in order) for r in found), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, tables, name):
    ours, theirs = registry.queries()[name](spark, SF), tables.sql(registry.oracle_sql()[name])
    assert rows(ours.columns, ours.collect()) == rows(theirs.columns, theirs.fetchall())


def test_first_day_with_inner_land_cells(spark, tmp_path):
    """All 25 cells have values on the first day, so nine land cells have all their neighbours and no pair; every cell has a hot week."""
    con = duckdb.connect()
    for t in "customer supplier orders lineitem".split():
        con.sql(f"CREATE TABLE {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    con.sql("UPDATE customer SET c_nationkey = c_custkey % 25")
    con.sql("INSERT INTO supplier SELECT t.* REPLACE (1000 + n AS s_suppkey, n AS s_nationkey) FROM (SELECT * FROM supplier LIMIT 1) t, (SELECT unnest(range(25)) AS n)")
    con.sql("INSERT INTO orders SELECT t.* REPLACE (c AS o_custkey, (SELECT min(o_orderdate) FROM orders) AS o_orderdate) FROM (SELECT * FROM orders LIMIT 1) t, (SELECT unnest(range(1, 26)) AS c)")
    con.sql("INSERT INTO orders SELECT t.* REPLACE (c AS o_custkey, DATE '1995-06-01' + (d + 366 * y)::INT AS o_orderdate, 1e6 * (y + 1) AS o_totalprice) FROM (SELECT * FROM orders LIMIT 1) t, (SELECT unnest(range(1, 26)) AS c), (SELECT unnest(range(9)) AS d), (SELECT unnest(range(2)) AS y)")
    con.sql("INSERT INTO lineitem SELECT t.* REPLACE (1000 + n AS l_suppkey, (SELECT min(l_shipdate) FROM lineitem) AS l_shipdate) FROM (SELECT * FROM lineitem LIMIT 1) t, (SELECT unnest(range(25)) AS n)")
    for t in "customer supplier orders lineitem".split():
        con.sql(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    ours, theirs = registry.queries()["observational_first_day"](spark, str(tmp_path)), con.sql(registry.oracle_sql()["observational_first_day"])
    found = ours.collect()
    assert rows(ours.columns, found) == rows(theirs.columns, theirs.fetchall())
    inner = con.sql(f"SELECT count(*) FROM ({registry.oracle_sql()['land_events']}) WHERE lat_idx BETWEEN 1 AND 3 AND lon_idx BETWEEN 1 AND 3").fetchall()[0][0]
    assert {r["class"]: r.n_events for r in found}["unpaired"] == inner > 0


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_summary_has_all_thresholds_and_draws(spark, tables):
    from thermaweave.operators import attribution
    from thermaweave.plans import fixtures as fx

    ours, theirs = registry.queries()["attribution_summary"](spark, SF), tables.sql(registry.oracle_sql()["attribution_summary"])
    found = ours.collect()
    assert rows(ours.columns, found) == rows(theirs.columns, theirs.fetchall())
    draws = attribution.bootstrap(attribution.member_hits(fx.ensemble(spark, SF), attribution.thresholds_table(spark, range(10, 100, 5))), 1000).collect()
    assert [r.threshold for r in sorted(found)] == list(range(10, 100, 5)) and any(r.pr_high == float("inf") for r in found)

    def at(values, q):
        values, k = sorted(values), q * (len(values) - 1)
        low, high = values[int(k)], values[min(int(k) + 1, len(values) - 1)]
        return low if low == high else (1 - k % 1) * low + k % 1 * high

    for r in found:
        far, pr = ([x[c] for x in draws if x.threshold == r.threshold] for c in ("far", "pr"))
        assert len(far) == 1000
        want = (sum(far) / 1000, sum(pr) / 1000, at(far, 0.05), at(far, 0.95), at(pr, 0.05), at(pr, 0.95))
        assert (r.far_mean, r.pr_mean, r.far_low, r.far_high, r.pr_low, r.pr_high) == pytest.approx(want, abs=1e-4)


def test_ensemble_folder(spark, tmp_path):
    import glob
    import shutil

    from thermaweave.sources import grids

    for k in (1, 2):
        spark.createDataFrame([(0, 0, "2000-01-01", 273.15 + k), (0, 1, "2000-01-01", 280.15)], "lat_idx int, lon_idx int, time string, TREFHT double").coalesce(1).write.parquet(str(tmp_path / f"raw{k}"))
        shutil.copy(glob.glob(str(tmp_path / f"raw{k}" / "*.parquet"))[0], tmp_path / f"{k:03d}.parquet")
    found = {(r.member, r.lon_idx): (r.forcing, round(r.T2m, 6)) for r in grids.load_ensemble(spark, str(tmp_path / "0*.parquet"), "ALL").collect()}
    assert found == {("001", 0): ("ALL", 1.0), ("002", 0): ("ALL", 2.0), ("001", 1): ("ALL", 7.0), ("002", 1): ("ALL", 7.0)}


def test_jobs_reuse_what_they_store(spark, tmp_path):
    from thermaweave.config import Settings
    from thermaweave.plans import fixtures as fx
    from thermaweave.plans.pipelines import run_observational

    s = Settings(base_period=fx.BASE, min_duration=1, max_gap=2, percentile=0.1, land_percentile=0.3, land_min_valid=10)
    ocean, land = fx.ocean(spark, SF).cache(), fx.land(spark, SF).cache()
    first = run_observational(ocean, land, s, str(tmp_path), mask="any")
    names = {p.name for p in tmp_path.iterdir()}
    assert {"pairs", "sea_climatology", "land_climatology", "sea_events", "land_events", "classes", "annual"} <= names
    written = lambda: {p.name: (p / "_SUCCESS").stat().st_mtime_ns for p in tmp_path.iterdir()}
    before = written()
    again = run_observational(ocean, land, s, str(tmp_path), mask="any")
    for n in ("classes", "sea_events", "pairs"):
        assert sorted(first[n].collect(), key=repr) == sorted(again[n].collect(), key=repr) != []
    assert written() == before
    # Counts of one pass over the classes are those of the two kinds of days.
    total = lambda df: df.selectExpr("sum(n_days)").first()[0] or 0
    assert total(first["compound_annual"]) == first["compound_days"].count() and total(first["standalone_annual"]) == first["standalone_days"].count()
    everything = run_observational(ocean, land, s, None, mask="any", thw_scope="all_paired")
    assert total(everything["thw_annual"]) >= total(first["thw_annual"])
