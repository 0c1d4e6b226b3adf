import dataclasses
import datetime as dt
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from thermaweave.config import Settings
from thermaweave.operators import events
from thermaweave.plans import fixtures as fx
from thermaweave.plans.pipelines import run_observational
from thermaweave.sources import grids

SF = "/root/testdata/sf0.001"
STAGES = {"pairs", "sea_climatology", "land_climatology", "sea_events", "land_events", "classes", "annual"}


def stages(folder):
    """When each stage's table was written."""
    return {p.name: (p / "_SUCCESS").stat().st_mtime_ns for p in folder.iterdir()}


def test_stages_are_made_anew_when_what_they_depend_on_has_changed(spark, tmp_path):
    for name, grid in (("sst", fx.ocean(spark, SF)), ("t2m", fx.land(spark, SF))):
        grid.write.parquet(str(tmp_path / name))
    store = tmp_path / "store"
    settings = Settings(base_period=fx.BASE, min_duration=1, max_gap=2, percentile=0.1, land_percentile=0.3, land_min_valid=10)

    def run(s=settings):
        sst, t2m = (spark.read.parquet(str(tmp_path / n)) for n in ("sst", "t2m"))
        found = run_observational(sst, t2m, s, str(store), mask="any")
        return found, stages(store)

    first, made = run()
    rows = sorted(first["classes"].collect(), key=repr)
    assert set(made) == STAGES and rows
    again, after = run()
    assert after == made and sorted(again["classes"].collect(), key=repr) == rows  # all was read
    changed = lambda x, y: {n for n in STAGES if x[n] != y[n]}
    _, longer = run(dataclasses.replace(settings, min_duration=2))
    assert changed(after, longer) == {"sea_events", "land_events", "classes", "annual"}
    other, limits = run(dataclasses.replace(settings, min_duration=2, land_percentile=0.4))
    assert changed(longer, limits) == {"land_climatology", "land_events", "classes", "annual"}
    # One more file with days of a land cell.
    more = spark.read.parquet(str(tmp_path / "t2m")).limit(5).selectExpr("date_add(time, 4000) AS time", "lat_idx", "lon_idx", "v", "lat", "lon")
    more.coalesce(1).write.mode("append").parquet(str(tmp_path / "t2m"))
    _, added = run(dataclasses.replace(settings, min_duration=2, land_percentile=0.4))
    assert changed(limits, added) == STAGES - {"sea_climatology", "sea_events"} | ({"sea_climatology", "sea_events"} & changed(limits, added)) and "land_events" in changed(limits, added)
    # A run that broke off before its manifest was written.
    os.remove(store / "classes" / grids.MANIFEST)
    _, mended = run(dataclasses.replace(settings, min_duration=2, land_percentile=0.4))
    assert "classes" in changed(added, mended) and not {"land_events", "pairs"} & changed(added, mended)


def test_rows_from_memory_are_never_taken_for_seen(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "a int")
    assert grids.fingerprint(spark, [df]) != grids.fingerprint(spark, [df])
    df.write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    assert grids.fingerprint(spark, [stored], x=1) == grids.fingerprint(spark, [spark.read.parquet(str(tmp_path / "t"))], x=1)
    assert len({grids.fingerprint(spark, [stored], x=1), grids.fingerprint(spark, [stored], x=2), grids.fingerprint(spark, [stored.where("a > 0")], x=1), grids.fingerprint(spark, [stored.cache()])}) == 4


def day_file(folder, day, value, name="sst_{:%Y%m%d}.parquet"):
    folder.mkdir(exist_ok=True)
    rows = {"lat_idx": pa.array([0, 1], pa.int32()), "lon_idx": pa.array([0, 0], pa.int32()), "lat": [40.0, 40.25], "lon": [1.0, 1.0], "sst": [value, float("nan")]}
    pq.write_table(pa.table(rows), folder / name.format(day))


def test_day_files(spark, tmp_path):
    raw, out = tmp_path / "raw", str(tmp_path / "grid")
    days = [dt.date(2000, 11, 1) + dt.timedelta(days=k) for k in range(300)]
    for k, d in enumerate(days):
        day_file(raw, d, float(k))
    pattern = f"{raw}/sst_*.parquet"
    table = lambda **a: sorted((r.time, r.lat_idx, r.v) for r in grids.read_days(spark, out, **a).collect())
    want = sorted((d, c, None if c else float(k)) for k, d in enumerate(days) for c in (0, 1))
    assert len(grids.ingest_days(spark, pattern, out)) == 300 and table() == want
    assert grids.ingest_days(spark, pattern, out) == []
    # A later file is read alone.
    day_file(raw, days[-1] + dt.timedelta(days=1), 300.0)
    assert [p.rsplit("_", 1)[-1] for p in grids.ingest_days(spark, pattern, out)] == ["20010828.parquet"]
    want += [(dt.date(2001, 8, 28), 0, 300.0), (dt.date(2001, 8, 28), 1, None)]
    assert table() == sorted(want)
    # Other years are not opened.
    part = grids.read_days(spark, out, "2001-01-01", "2001-02-28")
    assert "PartitionFilters: [" in (plan := part._jdf.queryExecution().executedPlan().toString()) and "year#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert {f.split("year=")[1][:4] for (f,) in part.selectExpr("input_file_name()").distinct().collect()} == {"2001"}
    assert table(start="2001-01-01", end="2001-02-28") == sorted(x for x in want if dt.date(2001, 1, 1) <= x[0] <= dt.date(2001, 2, 28))
    # A load that broke off before the manifest was written is written over.
    day_file(raw, dt.date(2001, 8, 29), 301.0)
    held = (tmp_path / "grid" / grids.DAYS).read_text()
    grids.ingest_days(spark, pattern, out)
    (tmp_path / "grid" / grids.DAYS).write_text(held)
    os.remove(tmp_path / "grid" / f".{grids.DAYS}.crc")
    assert table() == sorted(want)  # readers go by the manifest
    assert len(grids.ingest_days(spark, pattern, out)) == 1
    want += [(dt.date(2001, 8, 29), 0, 301.0), (dt.date(2001, 8, 29), 1, None)]
    assert table() == sorted(want)
    # A file that has changed, and one that has gone: their year alone is read again.
    day_file(raw, days[3], -1.0, "sst_{:%Y%m%d}.parquet")
    os.utime(raw / f"sst_{days[3]:%Y%m%d}.parquet", (1, 1))
    os.remove(raw / f"sst_{days[4]:%Y%m%d}.parquet")
    read = grids.ingest_days(spark, pattern, out)
    assert len(read) == 60 and all("_2000" in p for p in read)
    assert table() == sorted((d, c, -1.0 if d == days[3] and not c else v) for d, c, v in want if d != days[4])
    # Small loads of a year are put together in time.
    for k in range(3):
        day_file(raw, dt.date(2001, 9, 1 + k), float(k))
        read = grids.ingest_days(spark, pattern, out, most_loads=4)
    assert len(list((tmp_path / "grid" / "year=2001").iterdir())) == 2 or len(read) > 1
    assert len(table()) == len(want) - 2 + 6


def test_day_files_without_a_day_or_none_at_all(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        grids.ingest_days(spark, f"{tmp_path}/none/*.parquet", str(tmp_path / "grid"))
    day_file(tmp_path / "raw", dt.date(2000, 1, 1), 1.0, "sst.parquet")
    with pytest.raises(ValueError, match="without a day"):
        grids.ingest_days(spark, f"{tmp_path}/raw/*.parquet", str(tmp_path / "grid"))


def test_malformed_rows_are_set_aside(spark, tmp_path):
    good = [(str(dt.date(2000, 1, 1) + dt.timedelta(days=k)), "0", str(c), "50.0", "1.0", "1.0" if k % 9 < 6 else "0" if k % 2 else None) for c in range(2) for k in range(40)]
    bad = [("2000-13-01", "0", "0", "50", "1", "1"), ("soon", "0", "0", "50", "1", "x"), (None, "0", "1", "50", "1", "1"), ("2000-01-01", "", "1", "50", "1", "1"), ("2000-01-02", "0", "one", "50", "1", "1"), ("2000-01-03", "0", "1", "50", "1", "1,5")]
    fine = [("2000-03-01", "0", "0", "50", "1", "NaN"), ("2000-03-02", "0", "0", "50", "1", " ")]
    schema = "time string, lat_idx string, lon_idx string, lat string, lon string, v string"
    clean, aside, counts = grids.set_aside(spark.createDataFrame(good + bad + fine, schema), str(tmp_path / "rows"))
    assert counts == {"rows": len(good + bad + fine), "malformed": len(bad)}
    assert clean.count() == len(good + fine) and dict(clean.dtypes)["time"] == "date" and clean.where("v IS NOT NULL AND isnan(v)").count() == 0
    reasons = {(r.time, r.v): list(r.reasons) for r in aside.collect()}
    assert len(reasons) == len(bad) and reasons["soon", "x"] == ["time is no date", "v is no double"] and reasons[None, "1"] == ["time is missing"]
    assert {x for r in reasons.values() for x in r} == {"time is no date", "v is no double", "time is missing", "lat_idx is missing", "lon_idx is no int"}
    limits = spark.createDataFrame([(0, c, d, 0.5) for c in range(2) for d in range(1, 367)], "lat_idx int, lon_idx int, doy int, thresh double")
    alone = grids.set_aside(spark.createDataFrame(good + fine, schema), str(tmp_path / "good"))[0]
    found = lambda g: sorted(map(tuple, events.detect_events(g, limits, 5, 2).collect()))
    assert found(clean) == found(alone) != []
