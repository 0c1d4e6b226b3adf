import datetime as dt

import pytest
from pyspark.sql import functions as F

from thermaweave.operators import attribution, compound, daily, metrics, trends

D = lambda n: dt.date(2000, 12, 20) + dt.timedelta(days=n)
EVENT = "lat_idx int, lon_idx int, lat double, lon double, event_start date, event_end date, duration int"


def evts(spark, rows):
    return spark.createDataFrame([(a, b, 40.0 + a, float(b), D(s), D(e), e - s + 1) for a, b, s, e in rows], EVENT)


@pytest.fixture(scope="module")
def setting(spark):
    land = evts(spark, [(0, 0, 2, 5), (0, 0, 10, 14), (0, 0, 30, 33), (9, 9, 0, 4), (1, 0, 0, 3)])
    sea = evts(spark, [(5, 5, 0, 6), (5, 5, 12, 20), (5, 5, 21, 24)])
    pairs = spark.createDataFrame([(0, 0, 5, 5), (1, 0, 6, 6)], "land_lat_idx int, land_lon_idx int, ocean_lat_idx int, ocean_lon_idx int")
    return sea, land, pairs


def test_classes(setting):
    got = {(r.lat_idx, r.event_start): r["class"] for r in compound.classify_events(*setting).collect()}
    assert got == {(0, D(2)): "compound", (0, D(10)): "partial", (0, D(30)): "standalone", (9, D(0)): "unpaired", (1, D(0)): "standalone"}
    assert {(r.land_lat_idx, r.thw_start, r.mhw_start, r.mhw_duration) for r in compound.compound_events(*setting).collect()} == {(0, D(2), D(0), 7)}
    assert {(r.land_lat_idx, r.thw_start) for r in compound.standalone_events(*setting).collect()} == {(0, D(30)), (1, D(0))}
    assert [r.lat_idx for r in compound.unpaired_events(setting[1], setting[2]).collect()] == [9]


@pytest.mark.parametrize("seed", range(3))
def test_sweep_same_as_all_pairs(spark, seed):
    import random

    r = random.Random(seed)

    def series(cell, n):
        at, out = r.randrange(4), []
        for _ in range(n):
            length = r.randrange(1, 9)
            out.append((*cell, at, at + length - 1))
            at += length + r.randrange(1, 6)  # disjoint, now and then neighbours
        return out

    sea = [e for c in range(3) for e in series((5, c), 25)]
    land = [e for c in range(8) for e in series((1, c), 20)]
    home = {c: c % 4 for c in range(6)}  # sea cell 3 has no events, land cells 6 and 7 no sea cell
    pairs = spark.createDataFrame([(1, c, 5, o) for c, o in home.items()], "land_lat_idx int, land_lon_idx int, ocean_lat_idx int, ocean_lon_idx int")
    args = (evts(spark, sea), evts(spark, land), pairs)
    classes, inside, alone = {}, {}, set()
    for _, c, a, z in land:
        near = [(s, e) for _, o, s, e in sea if o == home.get(c) and e >= a and s <= z]
        holds = [(s, e) for s, e in near if s <= a and e >= z]
        classes[c, D(a)] = "unpaired" if c not in home else "compound" if holds else "partial" if near else "standalone"
        if holds:
            inside[c, D(a)] = D(min(holds)[0])
        if c in home and not near:
            alone.add((c, D(a)))
    found = compound.classify_events(*args).collect()
    assert {(x.lon_idx, x.event_start): x["class"] for x in found} == classes and len(found) == len(land) and set(classes.values()) == {"unpaired", "compound", "partial", "standalone"}
    assert {(x.land_lon_idx, x.thw_start): x.mhw_start for x in compound.compound_events(*args).collect()} == inside
    assert {(x.land_lon_idx, x.thw_start) for x in compound.standalone_events(*args).collect()} == alone
    # The only join is that with the pairs; the sweep itself is a union and windows.
    assert compound.compound_events(*args)._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_days_split_at_new_year_and_overlap_once(spark):
    axis = spark.createDataFrame([(D(n),) for n in range(40) if n != 3], "time date")
    days = daily.events_to_days(evts(spark, [(0, 0, 2, 14), (0, 0, 13, 15)]), axis)
    annual = {r.year: r.n_days for r in daily.annual_days(days).collect()}
    assert annual == {2000: 9, 2001: 4}
    cells = spark.createDataFrame([(0, 0), (0, 1)], "lat_idx int, lon_idx int")
    dense = daily.densify(daily.annual_days(days), spark.createDataFrame([(2000,), (2001,), (2002,)], "year int"), cells)
    assert dense.count() == 6 and dense.agg({"n_days": "sum"}).first()[0] == 13


def test_ratio_and_means(spark):
    key = "year int, lat_idx int, lon_idx int, n_days long"
    a = spark.createDataFrame([(1, 0, 0, 3), (2, 0, 0, 1)], key)
    b = spark.createDataFrame([(1, 0, 0, 2), (2, 0, 0, 0), (3, 0, 0, 5)], key)
    assert {r.year: r.value for r in metrics.ratio_field(a, b).collect()} == {1: 1.5, 2: None, 3: 0.0}
    field = spark.createDataFrame([(1, 0, 0, 60.0, 0.0, 4.0), (1, 0, 1, 0.0, 0.0, 1.0), (2, 0, 0, 60.0, 0.0, None)], "year int, lat_idx int, lon_idx int, lat double, lon double, value double")
    got = {r.year: r.value for r in metrics.spatial_mean(field).collect()}
    assert got[1] == pytest.approx(2.0) and got[2] is None
    assert {r.year: r.value for r in metrics.spatial_mean(field, weighted=False).collect()}[1] == 2.5


def test_convex_fit_keeps_signs(spark):
    rows = [("up", 1983 + x, 1.0 + 0.5 * x + 0.25 * x * x) for x in range(8)] + [("down", 1983 + x, 9.0 - x) for x in range(8)] + [("line", 1983 + x, 3.0 * x - 0.01 * x * x) for x in range(8)] + [("two", 1983, 1.0), ("two", 1984, 2.0)]
    got = {r.name: r for r in trends.convex_trend(spark.createDataFrame(rows, "name string, year int, value double")).collect()}
    assert (got["up"].a, got["up"].b, got["up"].c) == pytest.approx((0.5, 0.25, 1.0))
    assert (got["down"].a, got["down"].b, got["down"].c) == pytest.approx((0, 0, 5.5))
    assert got["line"].b == 0 and got["line"].a > 2.8 and "two" not in got


def test_gev_of_a_gumbel_like_sample(spark):
    import numpy as np

    x = np.random.default_rng(0).gumbel(10.0, 2.0, 4000)
    got = trends.gev(spark.createDataFrame([("g", float(v)) for v in x], "name string, value double")).first()
    assert abs(got["shape"]) < 0.06 and got["scale"] == pytest.approx(2.0, abs=0.15) and got["location"] == pytest.approx(10.0, abs=0.15)


def test_attribution_invariants(spark):
    rows = [(f, f"{m:03d}", y, 20 + (m * 7 + y * 3) % 40 + (15 if f == "ALL" else 0)) for f in ("ALL", "FixGHG") for m in range(1, 21) for y in range(1990, 2000)]
    annual = spark.createDataFrame(rows, "forcing string, member string, year int, n_days long")
    hits = attribution.member_hits(annual, attribution.thresholds_table(spark, range(10, 100, 5)))
    p = attribution.probability(hits).orderBy("threshold").collect()
    assert all(a.p_all >= b.p_all and a.p_fix >= b.p_fix for a, b in zip(p, p[1:], strict=False)) and all(r.p_all >= r.p_fix for r in p)
    boot = attribution.bootstrap(hits, 100)
    assert boot.count() == 100 * 18 and sorted(boot.collect()) == sorted(attribution.bootstrap(hits.repartition(7), 100).collect())
    mean = {r.threshold: r.m for r in boot.groupBy("threshold").agg({"p_all": "avg"}).withColumnRenamed("avg(p_all)", "m").collect()}
    assert all(abs(mean[r.threshold] - r.p_all) < 0.05 for r in p)
    levels = {r.years: r for r in attribution.period_levels(attribution.return_periods(attribution.probability(hits))).collect()}
    assert levels[5].level_fix <= levels[5].level_all
    seen = attribution.observed_risk(spark.createDataFrame([(2022, 62), (1950, 3)], "year int, n_days long"), attribution.probability(hits)).collect()
    assert {r.year: r.threshold for r in seen} == {2022: 60, 1950: None}


def test_gev_of_series_without_spread(spark):
    rows = [(n, v) for n, vs in (("flat", [5.0] * 8), ("two", [1.0, 2.0]), ("pair", [0.0, 0.0, 0.0, 0.0, 9.0]), ("negative", [-3.0, -3.5, -3.2, -2.0, -3.1])) for v in vs]
    found = {r.name: r for r in trends.gev(spark.createDataFrame(rows, "name string, value double")).collect()}
    assert set(found) == {"flat", "pair", "negative"}
    assert found["flat"].scale is None and found["flat"].location is None
    assert found["negative"].scale > 0 and found["negative"].location < -2.5


def test_gamma(spark):
    from math import gamma

    for k in (-0.9, -0.5, -0.01, 0.0, 0.3, 1.0, 2.5):
        assert abs(spark.range(1).select(trends.gamma_of_next(F.lit(k))).first()[0] / gamma(1 + k) - 1) < 1e-12


def test_fitted_levels_and_chances_are_inverse(spark):
    fits = [("heavy", 0.2, 2.0, 10.0), ("flat", 0.0, 1.5, -3.0), ("bounded", -0.3, 1.0, 25.0), ("none", None, None, None)]
    fit = spark.createDataFrame(fits, "name string, shape double, scale double, location double")
    levels = {(r.name, r.years): r.level for r in trends.fitted_levels(fit, (2, 10, 1000)).collect()}
    parts = [F.col(c) for c in ("shape", "scale", "location")]
    for (name, years), level in levels.items():
        row = fit.where(F.col("name") == name).select(trends.period_of(trends.chance_above(F.lit(level), *parts)).alias("t")).first()
        assert (row.t is None and level is None) if name == "none" else row.t == pytest.approx(years)
    ends = fit.select("name", trends.chance_above(F.lit(29.0), *parts).alias("high"), trends.chance_above(F.lit(-50.0), *parts).alias("low")).collect()
    got = {r.name: (r.high, r.low) for r in ends}
    assert got["bounded"] == (0.0, 1.0) and got["heavy"][1] == 1.0 and got["none"] == (None, None)


def test_fitted_periods(spark):
    import numpy as np

    x = np.random.default_rng(4).gumbel(24.0, 1.0, 60)
    rows = [("sea", float(v)) for v in x] + [("flat", 5.0)] * 6 + [("few", 1.0)] * 2 + [("sea", None)]
    series = spark.createDataFrame(rows, "name string, value double")
    limits = attribution.thresholds_table(spark, (22, 25, 27, 40))
    found = {(r.name, r.threshold): r for r in trends.fitted_periods(series, limits, replicates=60).collect()}
    assert {n for n, _ in found} == {"sea", "flat"} and all(found["flat", t].period is None and found["flat", t].period_low is None for t in (22, 25, 27, 40))
    assert all(found["sea", t].period_low < found["sea", t].period < found["sea", t].period_high for t in (25, 27))
    assert found["sea", 25].period == pytest.approx(1 / np.mean(x > 25), rel=0.3)
    assert found["sea", 22].period == pytest.approx(1, abs=0.02) and found["sea", 40].period > 1e4
    again = {(r.name, r.threshold): r for r in trends.fitted_periods(series.repartition(5), limits, replicates=60).collect()}
    assert all(again[k].period_high == pytest.approx(r.period_high) for k, r in found.items() if r.period_high)
