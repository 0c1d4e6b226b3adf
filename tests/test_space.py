import math
import random

import pytest

from thermaweave.functions.columns import unified_longitude
from thermaweave.operators import masks, pairing
from pyspark.sql import functions as F


def mask(spark, cells):
    return spark.createDataFrame([(a, b, float(a), float(b)) for a, b in cells], "lat_idx int, lon_idx int, lat double, lon double")


LAND = [(a, b) for a in range(40) for b in range(40) if (a * 7 + b * 3) % 4]


def test_edges(spark):
    cells = set(LAND)
    for offsets in (masks.CROSS, masks.SQUARE):
        want = {(a, b) for a, b in cells if any((a + x, b + y) not in cells for x, y in offsets)}
        assert {(r.lat_idx, r.lon_idx) for r in masks.edge(mask(spark, LAND), offsets).collect()} == want
    assert masks.edge(mask(spark, LAND)).count() == 839


def test_nearest_pairs_same_as_all_distances(spark):
    r = random.Random(2)
    land = [(i, 0, r.uniform(30, 60), r.uniform(-20, 20)) for i in range(300)]
    sea = [(j, 1, r.uniform(30, 60), r.uniform(-20, 20) % 360) for j in range(400)]
    schema = "lat_idx int, lon_idx int, lat double, lon double"
    got = {x.land_lat_idx: x.ocean_lat_idx for x in pairing.nearest_pairs(spark.createDataFrame(land, schema), spark.createDataFrame(sea, schema), 0.5).collect()}
    want = {}
    for i, _, y, x in land:
        best = min((math.hypot(y - b, x * math.cos(math.radians(y)) - (a - 360 if a > 180 else a) * math.cos(math.radians(b))), j) for j, _, b, a in sea)
        if best[0] <= 0.5:
            want[i] = best[1]
    assert got == want and want


def test_longitude(spark):
    got = spark.createDataFrame([(0.0,), (180.0,), (180.5,), (359.0,)], "x double").select(unified_longitude(F.col("x"))).collect()
    assert [r[0] for r in got] == [0.0, 180.0, -179.5, -1.0]


def test_neighbour_pairs(spark):
    land, sea = mask(spark, [(1, 1), (0, 0), (2, 2), (1, 2)]), mask(spark, [(0, 1), (2, 1), (1, 0)])
    got = {(r.land_lat_idx, r.land_lon_idx): (r.ocean_lat_idx, r.ocean_lon_idx) for r in pairing.neighbour_pairs(land, sea, 4, 4).collect()}
    assert got == {(1, 1): (0, 1), (2, 2): (2, 1)}


@pytest.mark.parametrize("km", [30.0, 150.0])
def test_buffer_same_as_all_distances(spark, km):
    r = random.Random(4)
    land = [(i, 0, r.uniform(-70, 72), r.uniform(-30, 30)) for i in range(400)]
    coast = [(j, 1, r.uniform(-70, 72), r.uniform(-30, 30)) for j in range(300)]
    schema = "lat_idx int, lon_idx int, lat double, lon double"

    def near(a, b):
        p, q = math.radians(a[2]), math.radians(b[2])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[3] - a[3]) / 2) ** 2
        return 2 * 6371 * math.asin(min(1, math.sqrt(h))) <= km

    want = {a[0] for a in land if any(near(a, b) for b in coast)}
    got = {x.lat_idx for x in masks.coastal_buffer(spark.createDataFrame(land, schema), spark.createDataFrame(coast, schema), km).collect()}
    assert got == want and want


def far(a, b):
    p, q = math.radians(a[2]), math.radians(b[2])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[3] - a[3]) / 2) ** 2
    return 2 * 6371 * math.asin(min(1, math.sqrt(h)))


@pytest.mark.parametrize("km", [40.0, 400.0])
def test_buffer_over_the_antimeridian_and_at_the_poles(spark, km):
    r = random.Random(8)
    places = lambda n, k: [(j, k, lat(), lon()) for lat, lon in ((lambda: r.uniform(-5, 5), lambda: r.choice([-180, 180]) + r.uniform(-3, 3)), (lambda: r.uniform(88.5, 90), lambda: r.uniform(0, 360)), (lambda: r.uniform(-90, -89), lambda: r.uniform(-180, 180))) for j in range(n)]
    land = [(j, *x[1:]) for j, x in enumerate([*places(150, 0), (0, 0, 90.0, 0.0), (0, 0, 89.0, 180.0), *((0, 0, r.uniform(-80, 80), r.uniform(-170, 170)) for _ in range(60))])]
    coast = [*places(40, 1), (0, 1, 89.0, -180.0)]
    schema = "lat_idx int, lon_idx int, lat double, lon double"
    got = sorted(x.lat_idx for x in masks.coastal_buffer(spark.createDataFrame(land, schema), spark.createDataFrame(coast, schema), km).collect())
    want = [a[0] for a in land if any(far(a, b) <= km for b in coast)]
    assert got == want and 0 < len(want) < len(land)


@pytest.mark.parametrize(("step", "size"), [((0.25, 0.25), 0.4), ((2.5, 3.75), 1.0), ((1.0, 1.0), 2.5)])
def test_regridding_conserves_the_field(spark, step, size):
    from thermaweave.operators import climatology

    r = random.Random(5)
    lats = [-90 + step[0] / 2 + step[0] * k for k in range(6)] + [90 - step[0] / 2 - step[0] * k for k in range(4)] + [41.3]
    lons = [-180 + step[1] / 2 + step[1] * k for k in range(5)] + [359.9, 0.05 + step[1]]
    rows = [(t, a, b, None if r.random() < 0.2 else r.uniform(-5, 30)) for t in range(2) for a in lats for b in lons]
    found = climatology.regrid_conservative(spark.createDataFrame(rows, "time int, lat double, lon double, v double"), size, step).collect()
    area = lambda a: math.radians(step[1]) * (math.sin(math.radians(min(90, a + step[0] / 2))) - math.sin(math.radians(max(-90, a - step[0] / 2))))
    for t in range(2):
        held = [(v, area(a)) for x, a, _, v in rows if x == t and v is not None]
        ours = [(x.v, x.area) for x in found if x.time == t and x.v is not None]
        assert sum(a for _, a in ours) == pytest.approx(sum(a for _, a in held))
        assert sum(v * a for v, a in ours) == pytest.approx(sum(v * a for v, a in held))
    n = round(360 / size)
    assert all(0 <= x.lon_idx < n and 0 <= x.lat_idx <= 180 / size for x in found)
    with pytest.raises(ValueError):
        climatology.regrid_conservative(spark.createDataFrame(rows, "time int, lat double, lon double, v double"), 0.7, step)
