import datetime as dt

from pyspark.sql import Row
from pyspark.sql import functions as F

from thermaweave.streaming import events as stream


def rows(spark, n_cells=6, n_days=90):
    out = [(c, 0, dt.date(2000, 1, 1) + dt.timedelta(days=t), t) for c in range(n_cells) for t in range(n_days) if (c * 7919 + t * 104729 + (c * t) % 613) % 1000 < 450]
    return spark.createDataFrame(out, "lat_idx int, lon_idx int, time date, t_idx long")


def loop(days, least, gap):
    runs = []
    for t in sorted(days):
        if runs and t - runs[-1][1] <= gap + 1:
            runs[-1][1] = t
        else:
            runs.append([t, t])
    return [tuple(r) for r in runs if r[1] - r[0] + 1 >= least]


def want(df, least=5, gap=2):
    by = {}
    for r in df.collect():
        by.setdefault(r.lat_idx, []).append(r.t_idx)
    return {(c, a, z) for c, d in by.items() for a, z in loop(d, least, gap)}, {c: max(d) for c, d in by.items()}


def run(spark, df, tmp_path, make, name):
    path = str(tmp_path / "in")
    for k in range(3):  # three files in order of time
        df.where(F.floor(F.col("t_idx") / 30) == k).coalesce(1).write.mode("append").parquet(path)
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    q = make(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.sql(f"SELECT * FROM {name}").collect()


def test_sessions_same_as_loop_in_batch(spark):
    df = rows(spark)
    got = {(r.lat_idx, (r.event_start - dt.date(2000, 1, 1)).days, (r.event_end - dt.date(2000, 1, 1)).days) for r in stream.session_events(df).collect()}
    assert got == want(df)[0]


def test_streamed_sessions_lack_open_tails_only(spark, tmp_path):
    df = rows(spark)
    got = {(r.lat_idx, (r.event_start - dt.date(2000, 1, 1)).days, (r.event_end - dt.date(2000, 1, 1)).days) for r in run(spark, df, tmp_path, stream.session_events, "sessions")}
    all_, _ = want(df)
    assert got <= all_ and all(z >= 90 - 9 for _, _, z in all_ - got)


def test_tracked_events_lack_each_cells_last_one_only(spark, tmp_path):
    df = rows(spark)
    got = {(r.lat_idx, r.start_idx, r.end_idx) for r in run(spark, df, tmp_path, stream.tracked_events, "tracked")}
    all_, last = want(df)
    assert got <= all_ and all(z == last[c] for c, _, z in all_ - got)


def test_flush_emits_open_events(spark, tmp_path):
    df = rows(spark)
    more = df.unionByName(stream.flush_rows(df, df.schema))
    path = str(tmp_path / "in")
    for k in range(3):
        df.where(F.floor(F.col("t_idx") / 30) == k).coalesce(1).write.mode("append").parquet(path)
    more.where("t_idx IS NULL").coalesce(1).write.mode("append").parquet(path)
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    q = stream.tracked_events(source).writeStream.format("memory").queryName("flushed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.lat_idx, r.start_idx, r.end_idx) for r in spark.sql("SELECT * FROM flushed").collect()}
    assert got == want(df)[0]


def put_file(spark, rows, path):
    spark.createDataFrame(rows, "lat_idx int, lon_idx int, time date").coalesce(1).write.mode("append").parquet(path)


def timed(spark, tmp_path, gap=2, least=5):
    """The stream over files taken one by one in order of their time, and what it has written."""
    (tmp_path / "clock").mkdir(exist_ok=True)
    source = spark.readStream.schema("lat_idx int, lon_idx int, time date").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "days"))
    return stream.timed_events(source, least, gap, late="3 days", clock=spark.readStream.schema("time date").parquet(str(tmp_path / "clock")))


def written(spark, tmp_path, schema):
    day = lambda d: (d - dt.date(2000, 1, 1)).days
    return sorted((r.lat_idx, day(r.event_start), day(r.event_end)) for r in stream.read_batches(spark, str(tmp_path / "out"), schema).collect())


def test_timers_close_every_event_and_a_restart_repeats_none(spark, tmp_path, monkeypatch):
    df = rows(spark, n_cells=5, n_days=100)
    all_, last = want(df)
    days = [(r.lat_idx, r.lon_idx, r.time) for r in df.collect()]
    for k in range(5):
        # A day comes with its file or, every third, with the next one, still within the allowed lateness.
        put_file(spark, [d for d in days if min(4, ((d[2] - dt.date(2000, 1, 1)).days + (d[2].day % 3 == 0)) // 20) == k], str(tmp_path / "days"))
    found = timed(spark, tmp_path)
    write, fails = stream.write_batch, [2]

    def failing(batch, path, number):
        write(batch, path, number)
        if number in fails:
            fails.remove(number)
            raise RuntimeError("lost after writing")

    monkeypatch.setattr(stream, "write_batch", failing)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    try:
        stream.run_to_end(found, out, checkpoint)
        raise AssertionError("the batch did not fail")
    except Exception as error:
        assert "lost after writing" in str(error)
    assert {p.name for p in (tmp_path / "out").iterdir()} == {"batch=0", "batch=1", "batch=2"}
    stream.run_to_end(timed(spark, tmp_path), out, checkpoint)
    got = written(spark, tmp_path, found.schema)
    assert len(got) == len(set(got)) and set(got) <= all_ and all(z >= 100 - 3 - 3 for _, _, z in all_ - set(got))
    stream.close_series(spark, str(tmp_path / "clock"), "2000-04-09", 2 + 2 + 3)
    stream.run_to_end(timed(spark, tmp_path), out, checkpoint)
    got = written(spark, tmp_path, found.schema)
    assert got == sorted(all_) and any(z == last[c] for c, _, z in got)


def test_rows_behind_the_watermark_are_dropped(spark, tmp_path):
    day = lambda k: dt.date(2000, 1, 1) + dt.timedelta(days=k)
    days = str(tmp_path / "days")
    put_file(spark, [(0, 0, day(k)) for k in range(5)] + [(1, 0, day(k)) for k in range(10, 13)], days)
    put_file(spark, [(1, 0, day(40))], days)
    # Cell 0 is closed by now, whatever comes for its gap; cell 1 still takes days within three of the last.
    put_file(spark, [(0, 0, day(6)), (1, 0, day(38)), (1, 0, day(39)), (1, 0, day(41)), (1, 0, day(42))], days)
    stream.close_series(spark, str(tmp_path / "clock"), "2000-03-01", 9)
    found = timed(spark, tmp_path)
    for clock in (tmp_path / "clock").iterdir():
        clock.rename(tmp_path / clock.name)  # not before the days
    stream.run_to_end(found, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert written(spark, tmp_path, found.schema) == [(0, 0, 4)]
    for clock in tmp_path.glob("*part-*"):
        clock.rename(tmp_path / "clock" / clock.name)
    stream.run_to_end(timed(spark, tmp_path), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert written(spark, tmp_path, found.schema) == [(0, 0, 4), (1, 38, 42)]


class Held:
    """A key's state and timers; each call counts."""

    def __init__(self):
        self.rows, self.timers, self.calls, self.watermark = [], set(), 0, 0

    def getListState(self, name, kind):
        return self

    def get(self):
        self.calls += 1
        return iter(self.rows)

    def put(self, rows):
        self.calls, self.rows = self.calls + 1, list(rows)

    def clear(self):
        self.calls, self.rows = self.calls + 1, []

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def getCurrentWatermarkInMs(self):
        return self.watermark

    def getExpiryTimeInMs(self):
        return min(self.timers)


def test_a_key_has_one_timer_however_many_runs():
    held, closing = Held(), stream._Closing(3, 1, ("user_id",))
    closing.init(held)
    days = [d for k in range(0, 200, 10) for d in (k, k + 1, k + 3)]
    assert list(closing.handleInputRows((7,), iter([Row(user_id=7, day_number=d) for d in days]), held)) == []
    assert len(held.rows) == 20 and held.timers == {6 * stream.DAY_MS} and held.calls == 3
    # The run that the timer is for grows meanwhile: nothing is closed before its new end.
    assert list(closing.handleInputRows((7,), iter([Row(user_id=7, day_number=5)]), held)) == [] and held.timers == {6 * stream.DAY_MS}
    got = []
    for day in (6, 8, 100, 400):
        held.watermark, before = day * stream.DAY_MS, held.calls
        while held.timers and min(held.timers) <= held.watermark:
            at = min(held.timers)
            got.append([tuple(r) for r in closing.handleExpiredTimer((7,), held, held)])
            held.timers.discard(at)
        assert held.calls - before <= 3
    assert [len(g) for g in got] == [0, 1, 9, 10] and held.rows == []
    assert sum(got, []) == [(7, 0, 5), *((7, k, k + 3) for k in range(10, 200, 10))]


def test_keys_are_kept_to_the_last_digit_beside_one_without(spark, tmp_path):
    big = 2**53 + 1
    days = [(k, dt.date(2000, 1, 1) + dt.timedelta(days=t)) for k in (big, big + 2, None) for t in range(3)]
    spark.createDataFrame(days, "user_id long, time date").coalesce(1).write.parquet(str(tmp_path / "days"))
    stream.close_series(spark, str(tmp_path / "clock"), "2000-01-03", 30)
    found = stream.timed_events(spark.readStream.schema("user_id long, time date").parquet(str(tmp_path / "days")), 3, 1, ("user_id",), clock=spark.readStream.schema("time date").parquet(str(tmp_path / "clock")))
    stream.run_to_end(found, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = stream.read_batches(spark, str(tmp_path / "out"), found.schema).collect()
    assert sorted(((r.user_id, r.duration) for r in got), key=repr) == [(big, 3), (big + 2, 3), (None, 3)]
