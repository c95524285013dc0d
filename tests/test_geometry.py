"""Geometry against published values and plain arithmetic."""

import math

import pytest
from pyspark.sql import functions as F

from gridweave.functions import geo, naming
from gridweave.operators import route

#: Seven places (lat, lon); the first is the transition point.
PLACES = [(50.0, 7.0), (50.5, 7.0), (50.0, 8.0), (51.5, 7.5), (51.5, 8.5), (51.0, 9.0), (50.5, 8.5)]
#: Detours over 3, 4, 5, 6 between 1 and 2, then between the transition point and 1.
DETOURS = {
    (1, 2): [196992.47141155004, 233370.01575725118, 193026.02665479417, 81917.37382966773],
    (0, 1): [231691.1244341813, 295002.3707038793, 275916.25413375988, 170956.77165894924],
}


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_detours(spark):
    d = lambda i, j: geo.haversine(*PLACES[i], *PLACES[j])
    for (a, b), want in DETOURS.items():
        got = one(spark, *[d(a, n) + d(n, b) - d(a, b) for n in (3, 4, 5, 6)])
        assert list(got) == pytest.approx(want, rel=1e-11)
        ring = route.Ring(PLACES)
        assert [ring.detour(a, n, b) for n in (3, 4, 5, 6)] == pytest.approx(want, rel=1e-11)


def test_projection_and_snap(spark):
    point = lambda lat, lon, m: one(spark, geo.snap(lat, lon, 50.0, 7.0, 50.0, 8.0, m))[0]
    assert point(49.0, 7.5, 10.0)[:3] == (50.0, 7.5, "new")
    assert point(49.0, 7.5, 1e6)[:3] == (50.0, 8.0, "b")  # a tie goes to b
    assert point(49.0, 7.4, 1e6)[:3] == (50.0, 7.0, "a")
    assert point(49.0, 9.0, 10.0)[:3] == (50.0, 8.0, "b") and point(49.0, 6.0, 10.0)[:3] == (50.0, 7.0, "a")
    assert one(spark, geo.projection(1.0, 1.0, 2.0, 2.0, 2.0, 2.0))[0] == 0.0
    same = one(spark, geo.snap(1.0, 1.0, 2.0, 2.0, 2.0, 2.0, 0.0))[0]
    assert same[:3] == (2.0, 2.0, "b")


def ring(*points):
    return F.array(*[F.struct(F.lit(float(a)).alias("lat"), F.lit(float(o)).alias("lon")) for a, o in points])


def test_area_and_centroid(spark):
    square = ring((50, 7), (50, 7.01), (50.01, 7.01), (50.01, 7), (50, 7))
    area, centre, flat, none = one(spark, geo.ring_area_m2(square), geo.ring_centroid(square), geo.ring_centroid(ring((1, 1), (1, 2), (1, 1))), geo.ring_area_m2(ring((1, 1))))
    want = geo.RADIUS_M**2 * math.radians(0.01) * (math.sin(math.radians(50.01)) - math.sin(math.radians(50)))
    assert area == pytest.approx(want, rel=1e-9) and none == 0.0
    assert tuple(centre) == pytest.approx((50.005, 7.005)) and tuple(flat) == (1.0, 1.0)


def test_covers_and_contains(spark):
    r = ring((0, 0), (0, 4), (4, 4), (4, 2), (2, 2), (2, 0), (0, 0))
    for lat, lon, covers, contains in [(1, 1, 1, 1), (3, 1, 0, 0), (3, 3, 1, 1), (0, 2, 1, 0), (2, 1, 1, 0), (4, 4, 1, 0), (2, 2, 1, 0), (5, 5, 0, 0), (1, -1, 0, 0), (1, 5, 0, 0)]:
        got = one(spark, geo.ring_covers(r, lat, lon), geo.ring_contains(r, lat, lon))
        assert tuple(got) == (bool(covers), bool(contains)), (lat, lon)


CROSSINGS = [
    ((0, 0), (1, 1), (1, 1), (2, 0), False), ((0, 0), (0, 1), (1, 0), (1, 1), False), ((0, 0), (1, 1), (0, 1), (1, 0), True), ((0, 0), (2, 2), (0, 0), (1, 1), True),
    ((0, 0), (2, 2), (1, 1), (3, 0), False), ((0, 0), (2, 2), (1, 1), (3, 3), False), ((0, 0), (1, 1), (2, 2), (3, 3), False), ((0, 0), (1, 1), (0, 0), (1, 1), True),
]


def test_crossings(spark):
    for a, b, c, d, want in CROSSINGS:
        point = lambda p: [float(x) for x in p]
        assert one(spark, geo.segments_cross(point(a), point(b), point(c), point(d)))[0] == want, (a, b, c, d)
        assert route.cross(a, b, c, d) == want


def test_household_power(spark):
    assert list(one(spark, geo.household_kw(10.0, 5.0), geo.household_kw(10.0, 10.0), geo.household_kw(20.0, 10.0))) == [0.05, 0.1, 0.2]


def test_names(spark):
    from pyspark.sql import functions as F

    rows = [("new", 1, 2), ("a", 1, 2), ("b", 1, 2)]
    df = spark.createDataFrame(rows, "kind string, a long, b long").select(naming.highway_node_name(F.col("kind"), F.col("a"), F.col("b")).alias("x"))
    assert [r.x for r in df.collect()] == ["Highway node between: 1 and 2", "Highway node: 1", "Highway node: 2"]
    one = spark.range(1).select(naming.building_node_name(F.lit(7)), naming.load_name(F.lit(7)), naming.transformer_name(naming.mv_node_name(F.lit("x")), F.lit("x"))).first()
    assert list(one) == ["Building connection: 7", "Load of building: 7", "Transformer between Mv node to lv node x and x"]
    places = spark.createDataFrame([("", 1.5, 2.5), ("own", 1.5, 2.5), (None, 1.0, -2.0)], "name string, lat double, lon double")
    assert [r[0] for r in places.select(naming.coordinate_name(F.col("name"), F.col("lat"), F.col("lon"))).collect()] == ["Node (2.5 1.5)", "own", "Node (-2.0 1.0)"]
    assert naming.voltages(None, 0.4) == [0.4] and naming.voltages([], 0.4) == [0.4] and naming.voltages([10.0, 20.0], 10.0) == [10.0, 20.0]


def test_cell(spark):
    assert list(one(spark, geo.cell(0.5, 0.25), geo.cell(-0.1, 0.25))) == [2, -1]
