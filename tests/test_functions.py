import math

import pytest
from pyspark.sql import functions as F

from thermaweave.functions import humid, risk
from thermaweave.operators import profile
from thermaweave.sources import grids


def one(spark, c, **values):
    return spark.range(1).select(*[F.lit(v).cast("double").alias(k) for k, v in values.items()]).select(c.alias("x")).first().x


def es(x):
    return 6.112 * math.exp(17.67 * x / (x + 243.5))


def test_humid(spark):
    t, td, sp = F.col("t"), F.col("td"), F.col("sp")
    v = {"t": 30.0, "td": 22.0, "sp": 100000.0}
    rh = 100 * es(22) / es(30)
    assert one(spark, humid.relative_humidity(t, td), **v) == pytest.approx(rh)
    assert one(spark, humid.relative_humidity(td, t), **v) == 100.0
    stull = 30 * math.atan(0.151977 * math.sqrt(rh + 8.313659)) + math.atan(30 + rh) - math.atan(rh - 1.676331) + 0.00391838 * rh**1.5 * math.atan(0.023101 * rh) - 4.686035
    assert one(spark, humid.wet_bulb(t, td, sp, "stull"), **v) == pytest.approx(stull)
    g = 0.00066 * (1 + 0.00115 * es(22))
    assert one(spark, humid.wet_bulb(t, td, sp), **v) == pytest.approx(30 - 8 / (1 + g * 1000 / 10))
    assert one(spark, humid.specific_humidity(td, sp), **v) == pytest.approx(622 * es(22) / (1000 - 0.378 * es(22)))
    assert one(spark, humid.relative_humidity(t, td), t=None, td=1.0) is None
    with pytest.raises(ValueError):
        humid.wet_bulb(t, td, sp, "other")


def test_risk(spark):
    a, b = F.col("a"), F.col("b")
    assert one(spark, risk.far(a, b), a=0.4, b=0.1) == pytest.approx(0.75)
    assert one(spark, risk.far(a, b, "spec"), a=0.4, b=0.1) == pytest.approx(-3)
    assert one(spark, risk.far(a, b), a=0.4, b=0.0) == 1.0 and one(spark, risk.probability_ratio(a, b), a=0.4, b=0.0) == math.inf
    assert one(spark, risk.probability_ratio(a, b), a=0.4, b=0.1) == pytest.approx(4) and one(spark, risk.return_period(a), a=0.0) == math.inf


def test_sources(spark, tmp_path):
    raw = spark.createDataFrame([(1, "2000-01-01 12:00:00", 1.5, 0), (2, "2000-01-02 12:00:00", float("nan"), 0)], "lat_idx int, time string, sst double, zlev int").withColumn("time", F.to_timestamp("time"))
    raw.write.parquet(str(tmp_path / "raw"))
    g = grids.load_grid(spark, str(tmp_path / "merged"), str(tmp_path / "raw"))
    assert "zlev" not in g.columns and {r.lat_idx: r.v for r in g.collect()} == {1: 1.5, 2: None} and dict(g.dtypes)["time"] == "date"
    with pytest.raises(FileNotFoundError):
        grids.load_grid(spark, str(tmp_path / "merged"))
    other = spark.createDataFrame([("2001-05-05", 2.0)], "time string, tg double")
    assert grids.merge_sources([raw, other], "2000-01-02", "2001-12-31").count() == 2
    with pytest.raises(FileNotFoundError):
        grids.merge_sources([], "2000-01-01", "2001-01-01")
    made = []
    make = lambda: made.append(1) or spark.range(3)
    assert grids.materialize(spark, make, str(tmp_path / "stage")).count() == grids.materialize(spark, make, str(tmp_path / "stage")).count() == 3 and len(made) == 1
    levels = spark.createDataFrame([(0, 0, "d", 5.0, 280.0), (0, 0, "d", 0.0, 281.15)], "lat_idx int, lon_idx int, time string, lev double, TEMP double")
    assert [(r.SST, r.member) for r in grids.load_member(levels, "ALL", "001").collect()] == [(pytest.approx(8.0), "001")]
    grids.write_table(g, str(tmp_path / "csv"), fmt="csv")
    assert grids.read_table(spark, str(tmp_path / "csv"), g.schema).count() == 2


def test_profile(spark):
    g = spark.createDataFrame([("a", 0, 0, 1.0), ("b", 0, 1, None)], "time string, lat_idx int, lon_idx int, v double")
    r = profile.profile_grid(g, (100, 1, 2)).first()
    assert (r.n_rows, r.n_times, r.n_lons, r.missing_share, r.status) == (2, 2, 2, 0.5, "warn")
    assert profile.profile_grid(g, (5, 1, 2)).first().status == "ok" and profile.profile_grid(g.limit(0)).first().status == "empty"
