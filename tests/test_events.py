import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from thermaweave.operators import climatology, events

DAY = dt.date(2000, 1, 1)


def table(spark, series):
    """series: {cell: string of T and F}; every day has a row, T is 1 and F is 0."""
    rows = [(0, c, DAY + dt.timedelta(days=i), 1.0 if x == "T" else 0.0, 50.0, 1.0) for c, s in series.items() for i, x in enumerate(s)]
    return spark.createDataFrame(rows, "lat_idx int, lon_idx int, time date, v double, lat double, lon double")


def limits(spark, cells):
    return spark.createDataFrame([(0, c, d, 0.5) for c in cells for d in range(1, 367)], "lat_idx int, lon_idx int, doy int, thresh double")


def loop(s, least, gap):
    """Events as (start, end) positions, end included, by walking along the series."""
    runs, at = [], None
    for i, x in enumerate(s):
        if x == "T":
            if at is not None and i - at[1] <= gap + 1:
                at[1] = i
            else:
                at = [i, i]
                runs.append(at)
    return [(a, z) for a, z in runs if z - a + 1 >= least]


def found(spark, series, least=5, gap=2):
    out = events.detect_events(table(spark, series), limits(spark, series), least, gap).collect()
    return sorted((r.lon_idx, (r.event_start - DAY).days, (r.event_end - DAY).days, r.duration) for r in out)


def test_hand_cases(spark):
    series = dict(enumerate(["TTTTT", "TTFFT", "TTFFFTTTTT", "TTTTTFF", "FFFFF", "TTTTFTF", "TFFTFFT"]))
    assert found(spark, series) == [(0, 0, 4, 5), (1, 0, 4, 5), (2, 5, 9, 5), (3, 0, 4, 5), (5, 0, 5, 6), (6, 0, 6, 7)]


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="TF", min_size=1, max_size=60), min_size=20, max_size=40), st.integers(1, 5), st.integers(0, 3))
def test_same_as_a_loop(spark, texts, least, gap):
    n = max(map(len, texts))
    series = {k: s.ljust(n, "F") for k, s in enumerate(texts)}
    want = sorted((k, a, z, z - a + 1) for k, s in series.items() for a, z in loop(s, least, gap))
    assert found(spark, series, least, gap) == want


def test_a_day_missing_for_one_cell_is_a_position(spark):
    g = table(spark, {0: "TTTTTTTT", 1: "TTTTTTTT"}).where("NOT (lon_idx = 1 AND day(time) IN (3, 4, 5))")
    assert [(r.lon_idx, r.duration) for r in events.detect_events(g, limits(spark, [0, 1]), 5, 2).collect()] == [(0, 8)]


def test_missing_never_exceeds(spark):
    g = spark.createDataFrame([(0, 0, DAY, None, 1.0, 1.0)], "lat_idx int, lon_idx int, time date, v double, lat double, lon double")
    assert climatology.exceedance(g, limits(spark, [0])).count() == 0


def test_late_days_of_year_are_held_to_the_last_threshold(spark):
    g = spark.createDataFrame([(0, 0, dt.date(2000, 12, 31), 1.0, 1.0, 1.0)], "lat_idx int, lon_idx int, time date, v double, lat double, lon double")
    assert climatology.exceedance(g, limits(spark, [0]).where("doy < 366")).count() == 1


def test_climatology_is_the_linear_quantile(spark):
    import numpy as np

    values = [3.0, 1.0, 10.0, 7.5, None]
    rows = [(0, 0, dt.date(1990 + k, 3, 1 if (1990 + k) % 4 else 1), v) for k, v in enumerate(values)]
    g = spark.createDataFrame(rows, "lat_idx int, lon_idx int, time date, v double")
    got = {r.doy: r.thresh for r in climatology.climatology(g, (1990, 1994), 0.9).collect()}
    assert got[60] == pytest.approx(np.quantile([3.0, 1.0, 7.5][:2] + [7.5], 0.9)) and got[61] == 10.0
    pooled = {r.doy: r.thresh for r in climatology.climatology(g, (1990, 1994), 0.9, half_width=1).collect()}
    assert pooled[60] == pytest.approx(np.quantile([3.0, 1.0, 10.0, 7.5], 0.9)) and set(pooled) == {59, 60, 61, 62}


def test_min_valid(spark):
    g = table(spark, {0: "TTTT", 1: "TT"})
    assert {r.lon_idx for r in climatology.enough_values(g, 3).collect()} == {0}


def test_empty_results_keep_their_columns(spark):
    out = events.detect_events(table(spark, {0: "F"}), limits(spark, [0]))
    assert out.count() == 0 and out.columns == ["lat_idx", "lon_idx", "lat", "lon", "event_start", "event_end", "duration"]


def exchanges(df):
    """Lines of the plan with an exchange of several partitions, and those of scans."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("\n")
    return [x for x in plan if "Exchange hashpartitioning" in x], [x for x in plan if "FileScan" in x]


def test_the_grid_moves_once(spark, tmp_path):
    table(spark, {c: "TTTTTFF" * 9 for c in range(6)}).write.parquet(str(tmp_path / "grid"))
    g = spark.read.parquet(str(tmp_path / "grid"))
    moved, scans = exchanges(events.events_above_percentile(g, (1990, 2010), 0.9, 5, 2, 3))
    assert len(moved) == 2 and sum("hashpartitioning(lat_idx" in x for x in moved) == 1 and sum("hashpartitioning(time" in x for x in moved) == 1
    assert len([x for x in scans if "v#" in x]) == 1 and all("FileScan parquet [time#" in x for x in scans if "v#" not in x) and len(scans) == 2
    limits(spark, range(6)).write.parquet(str(tmp_path / "limits"))
    moved, scans = exchanges(events.detect_events(g, spark.read.parquet(str(tmp_path / "limits")).hint("merge"), 5, 2, 3, period=(1990, 2010)))
    # The grid, its days, and the thresholds, which are one row a cell where they meet the grid.
    assert len(moved) == 3 and len([x for x in scans if ",v#" in x]) == 1


def test_thresholds_found_on_the_way_are_those_of_the_climatology(spark):
    import random

    r = random.Random(3)
    rows = [(0, c, dt.date(1998, 1, 1) + dt.timedelta(days=k), None if r.random() < 0.1 else float(r.randrange(50)), 50.0, 1.0) for c in range(4) for k in range(0, 1500 + 40 * c) if r.random() < 0.9]
    g = spark.createDataFrame(rows, "lat_idx int, lon_idx int, time date, v double, lat double, lon double")
    for period, least in (((1998, 1999), 0), ((1998, 2000), 1300), ((1999, 1999), 0), ((1950, 1960), 0)):
        clim = climatology.climatology(g, period, 0.6)
        by = lambda df: sorted(map(tuple, df.collect()))
        one = by(events.events_above_percentile(g, period, 0.6, 2, 1, least))
        assert one == by(events.detect_events(g, clim, 2, 1, least, period=period)) == by(events.detect_events(g, clim, 2, 1, least)) and bool(one) == (period[0] > 1990)


def test_pooled_thresholds_move_each_value_once(spark):
    import random

    import numpy as np

    r = random.Random(7)
    rows = [(0, c, dt.date(1999, 12, 1) + dt.timedelta(days=k), None if r.random() < 0.2 else r.random()) for c in range(2) for k in range(420) if r.random() < 0.5]
    rows += [(0, 9, dt.date(2000, 5, 1), None)]
    g = spark.createDataFrame(rows, "lat_idx int, lon_idx int, time date, v double")
    found = climatology.climatology(g, (1999, 2001), 0.9, half_width=3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")  # values are dealt out behind it
    values, days = {}, set()
    for _, c, d, v in rows:
        for k in range(-3, 4):
            doy = (d.timetuple().tm_yday - 1 + k) % 366 + 1
            days.add((c, doy))
            if v is not None:
                values.setdefault((c, doy), []).append(v)
    got = {(x.lon_idx, x.doy): x.thresh for x in found.collect()}
    assert set(got) == days and all((got[k] is None) == (k not in values) for k in days)
    assert all(got[k] == pytest.approx(np.quantile(v, 0.9)) for k, v in values.items())
