"""Grid operators against plain versions and published cases."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from gridweave.functions import geo
from gridweave.operators import cluster, components, graph, grid, merge, nearest, osm, region, route
from gridweave.operators.graph import GraphError
from tests.test_geometry import PLACES


def metres(a, b):
    return float(route.distances(np.array([a[0], b[0]]), np.array([a[1], b[1]]))[0, 1])


# --- entities ---


@pytest.fixture(scope="module")
def world(spark):
    nodes = [(1, 0.0, 0.0, {}), (2, 0.0, 1.0, {}), (3, 1.0, 1.0, {}), (4, 1.0, 0.0, {}), (80, 5.0, 5.0, {"power": "substation", "building": "service"}), (81, 5.0, 5.0, None)]
    ways = [(101, [1, 2, 3, 1], {"building": "yes"}), (102, [1, 2], {"building": "yes"}), (103, [3, 4, 99], {"highway": "motorway"}), (104, [], {"landuse": "farm"}), (2, [1, 2, 4, 1], {"power": "substation"})]
    relations = [(231, [(101, "way", "outer"), (232, "relation", ""), (7, "bound", "")], {"boundary": "administrative", "admin_level": "6"}), (232, [(103, "way", ""), (231, "relation", ""), (80, "Node", "")], {})]
    return (
        spark.createDataFrame(nodes, "node_id long, lat double, lon double, tags map<string,string>"),
        spark.createDataFrame(ways, "way_id long, nodes array<long>, tags map<string,string>"),
        spark.createDataFrame(relations, "rel_id long, members array<struct<id:long,type:string,role:string>>, tags map<string,string>"),
    )


def test_filters_and_roles(world):
    every = osm.entities(*world)
    ids = lambda df: sorted((r.type, r.id) for r in df.collect())
    assert ids(osm.filter_or(every, [osm.BUILDING])) == [("node", 80), ("way", 101), ("way", 102)]
    assert ids(osm.filter_or(every, [{"building": ["yes"]}, {"building": ["service"]}])) == [("node", 80), ("way", 101), ("way", 102)]  # filters of one key don't hide each other
    assert ids(osm.filter_or(every, [])) == []
    roles = sorted((r.role, r.type, r.id) for r in osm.with_roles(every).collect())
    assert roles == [("boundary", "relation", 231), ("building", "way", 101), ("highway", "way", 103), ("substation", "node", 80), ("substation", "way", 2)]
    assert ids(osm.closed_ways(every)) == [("way", 2), ("way", 101)]
    assert len(osm.substations_only(every).collect()) == 8


def test_members(world):
    nodes, ways, relations = world
    assert sorted((r.way_id, r.pos, r.node_id) for r in osm.way_members(ways, nodes).where("way_id = 103").collect()) == [(103, 0, 3), (103, 1, 4)]
    assert [r.lat for r in osm.way_members_or_null(ways, nodes).where("node_id = 99").collect()] == [None]
    got = sorted((r.rel_id, r.type, r.id) for r in osm.relation_members(relations, ways, nodes).collect())
    inner = [("node", 1), ("node", 2), ("node", 3), ("node", 4), ("node", 80), ("relation", 231), ("relation", 232), ("way", 101), ("way", 103)]
    assert got == [(r, t, i) for r in (231, 232) for t, i in inner]


def test_members_of_any_depth(spark):
    """A chain of 40 relations that ends in a node, and a ring of three."""
    members = "rel_id long, members array<struct<id:long,type:string,role:string>>, tags map<string,string>"
    rels = [(i, [(i + 1, "relation", "")], {}) for i in range(1, 40)] + [(40, [(7, "node", "")], {})] + [(100 + i, [(100 + (i + 1) % 3, "relation", "")], {}) for i in range(3)]
    nodes = spark.createDataFrame([(7, 0.0, 0.0, {})], "node_id long, lat double, lon double, tags map<string,string>")
    ways = spark.createDataFrame([], "way_id long, nodes array<long>, tags map<string,string>")
    got = {(r.rel_id, r.type, r.id) for r in osm.relation_members(spark.createDataFrame(rels, members), ways, nodes).collect()}
    want = {(i, "relation", j) for i in range(1, 41) for j in range(i + 1, 41)} | {(i, "node", 7) for i in range(1, 41)} | {(100 + i, "relation", 100 + j) for i in range(3) for j in range(3)}
    assert got == want
    assert osm.relation_members(spark.createDataFrame([], members), ways, nodes).count() == 0


def test_places_in_order(spark):
    from gridweave.operators.components import indexed

    df = spark.range(5000).selectExpr("(id * 7919) % 5003 AS k")
    got = {r.k: r.i for r in indexed(df, ["k"], "i").collect()}
    assert got == {k: i for i, k in enumerate(sorted(got))} and len(got) == 5000
    assert indexed(df.where("false"), ["k"], "i").count() == 0


def test_merge(world):
    every = osm.entities(*world)
    assert osm.merge((every, osm.ROLES), (every, osm.ROLES))[0].count() == 2 * every.count()
    assert osm.merge((every, osm.ROLES), (every, {})) is None and osm.merge_all([]) is None
    assert osm.merge_all([(every, {})] * 3)[0].count() == 3 * every.count()
    assert osm.merge_all([(every, {}), (every, osm.ROLES), (every, {})]) is None


# --- regions ---


def test_ring_cases():
    assert region.joined([1, 2, 3], [3, 4, 5]) == [1, 2, 3, 4, 5]
    assert region.joined([1, 2, 3], [5, 4, 3]) == [1, 2, 3, 4, 5]
    assert region.joined([3, 2, 1], [3, 4, 5]) == [1, 2, 3, 4, 5]
    assert region.joined([3, 2, 1], [5, 4, 3]) == [1, 2, 3, 4, 5]
    assert region.joined([1, 2, 3], [3, 4, 1]) == [1, 2, 3, 4, 1]
    assert region.joined([1, 2, 3], [1, 4, 3]) == [1, 2, 3, 4, 1]
    assert region.joined([1, 2, 1], [7, 8, 7]) == [1, 2, 1, 7, 8, 7]
    assert region.joined([], [1, 2]) == [1, 2] and region.joined([1, 2], []) == [1, 2]
    with pytest.raises(region.RingError):
        region.joined([1, 2], [3, 4])
    assert region.cut_rings([1, 2, 3, 1, 5, 6, 5]) == [[1, 2, 3, 1], [5, 6, 5]]
    assert region.cut_rings([1, 2, 3]) == [[1, 2, 3, 1]] and region.cut_rings([]) == []


def test_levels():
    assert [region.next_level(n) for n in (2, 4, 11, 12)] == [4, 5, 12, None]
    with pytest.raises(ValueError):
        region.partition(None, None, 8, 4)


def test_boundary_rings(spark):
    nodes = spark.createDataFrame([(61, 0.0, 0.0), (62, 0.0, 1.0), (63, 1.0, 1.0), (64, 1.0, 0.0)], "node_id long, lat double, lon double")
    ways = spark.createDataFrame([(131, [61, 62, 63]), (132, [61, 64, 63]), (133, [61, 62])], "way_id long, nodes array<long>")
    rel = lambda rows: spark.createDataFrame([(i, [(w, "way", "outer") for w in ws], {"admin_level": "8"}) for i, ws in rows], "rel_id long, members array<struct<id:long,type:string,role:string>>, tags map<string,string>")
    got = region.boundary_rings(rel([(231, [131, 132])]), ways, nodes, 8).first()
    assert got.area_id == 231 and [(p.lat, p.lon) for p in got.ring] == [(0, 0), (0, 1), (1, 1), (1, 0), (0, 0)]
    assert region.boundary_rings(rel([(231, [131, 132])]), ways, nodes, 6).count() == 0
    with pytest.raises(Exception, match="relation 5"):
        region.boundary_rings(rel([(5, [133])]), ways, nodes, 8).collect()
    told = region.boundary_rings(rel([(5, [133]), (231, [131, 132])]), ways, nodes, 8, strict=False)
    assert sorted((r.area_id, r.ring is None, r.problem) for r in told.collect()) == [(5, True, "relation 5 has no closed ring"), (231, False, None)]


def test_partition(spark):
    rect = lambda rows: region.rectangles(spark.createDataFrame(rows, "area_id long, lat0 double, lat1 double, lon0 double, lon1 double"), "area_id")
    points = [("building", 1, 0, 0.1, 0.1), ("building", 1, 1, 0.1, 0.9), ("building", 2, 0, 0.1, 1.5), ("building", 3, 0, 9.0, 9.0), ("highway", 7, 0, 0.1, 0.1), ("highway", 7, 1, 0.1, 1.5), ("highway", 8, 0, 0.1, 2.5)]
    df = spark.createDataFrame(points, "role string, id long, pos int, lat double, lon double")
    levels = {2: rect([(10, 0.0, 1.0, 0.0, 1.0), (11, 0.0, 1.0, 1.0, 2.0), (12, 0.0, 1.0, 2.0, 3.0)]), 4: rect([(20, 0.0, 1.0, 0.0, 0.5), (21, 0.0, 1.0, 0.5, 1.0)])}
    got = sorted((list(r.region), r.role, r.id) for r in region.partition(df, levels.get, 2, 4).collect())
    assert got == [([10, 20], "building", 1), ([10, 20], "highway", 7), ([11], "building", 2), ([11], "highway", 7)]
    assert sorted(r.id for r in region.partition(df, {}.get, 2, 8).collect()) == [1, 2, 3, 7, 8]


# --- graphs ---


def random_edges(seed, n=40, m=70):
    rnd = random.Random(seed)
    return {tuple(sorted(rnd.sample(range(n), 2))): round(rnd.uniform(1, 9), 3) for _ in range(m)}


def frame(spark, edges):
    return spark.createDataFrame([(a, b, d) for (a, b), d in edges.items()], "a_id long, b_id long, dist_m double")


def plain_contract(edges, keep):
    """One vertex after the other, as long as something changes."""
    edges = dict(edges)
    while True:
        at = {}
        for a, b in edges:
            at.setdefault(a, []).append((a, b))
            at.setdefault(b, []).append((a, b))
        v = next((v for v in sorted(at) if v not in keep and len(at[v]) <= 2), None)
        if v is None:
            return edges
        ends = [a if b == v else b for a, b in at[v]]
        total = sum(edges.pop(e) for e in at[v])
        if len(ends) == 2:
            key = tuple(sorted(ends))
            edges[key] = min(total, edges.get(key, total))


def test_contract(spark):
    chain = {(1, 2): 1.0, (2, 3): 2.0, (3, 4): 4.0, (4, 5): 1.0, (5, 6): 1.0, (4, 7): 3.0, (8, 9): 1.0, (4, 10): 1.0, (10, 11): 1.0, (4, 11): 1.0}
    df = frame(spark, chain)
    keep = graph.keep_set(df, spark.createDataFrame([(1,), (6,)], "node_id long"))
    assert {r.node_id for r in keep.collect()} == {1, 4, 6}
    assert {(r.a_id, r.b_id): r.dist_m for r in graph.contract(df, keep).collect()} == {(1, 4): 7.0, (4, 6): 2.0}
    for seed in range(3):
        edges = random_edges(seed, 60, 62)
        deg = {}
        for e in edges:
            for v in e:
                deg[v] = deg.get(v, 0) + 1
        kept = {v for v in deg if deg[v] > 2 or v % 11 == 0}
        got = graph.contract(frame(spark, edges), spark.createDataFrame([(v,) for v in kept], "node_id long"))
        want = {e: d for e, d in plain_contract(edges, kept).items() if set(e) <= kept}
        assert {(r.a_id, r.b_id): pytest.approx(r.dist_m) for r in got.collect()} == want


def test_shortest_paths(spark):
    edges = random_edges(5, 20, 60)
    d = np.full((20, 20), np.inf)
    np.fill_diagonal(d, 0)
    for (a, b), m in edges.items():
        d[a, b] = d[b, a] = m
    for k in range(20):
        d = np.minimum(d, d[:, k : k + 1] + d[k : k + 1])
    df = frame(spark, edges).selectExpr("1L AS grid_id", "*")
    got = graph.shortest_paths(df, spark.range(20).selectExpr("1L AS grid_id", "id AS node_id")).collect()
    assert len(got) == 380 and all(r.dist_m == pytest.approx(d[r.a_id, r.b_id]) for r in got)
    apart = spark.createDataFrame([(1, 1, 2, 1.0), (1, 3, 4, 1.0)], "grid_id long, a_id long, b_id long, dist_m double")
    with pytest.raises(Exception, match="no path"):
        graph.shortest_paths(apart, spark.createDataFrame([(1, 1)], "grid_id long, node_id long")).collect()


def test_street_graph(spark):
    nodes = spark.createDataFrame([(i, 50.0 + i / 1000, 7.0) for i in range(5)], "node_id long, lat double, lon double")
    refs = spark.createDataFrame([(1, p, n) for p, n in enumerate([0, 1, 2, 2, 1])] + [(2, 0, 3), (2, 1, 4), (3, 0, 0)], "way_id long, pos int, node_id long")
    got = {(r.a_id, r.b_id): r.dist_m for r in graph.street_graph(refs, nodes).collect()}
    assert set(got) == {(0, 1), (1, 2), (3, 4)} and got[0, 1] == pytest.approx(metres((50.0, 7.0), (50.001, 7.0)))
    with pytest.raises(graph.GraphError, match="9"):
        graph.sections(spark.createDataFrame([(1, 0, 9)], "way_id long, pos int, node_id long"), nodes)
    assert graph.total_length(frame(spark, {(1, 2): 1.5}).where("false")).first().total_m == 0.0
    assert graph.too_many_connections(frame(spark, {(1, 2): 1.0, (1, 3): 1.0, (1, 4): 1.0})) and not graph.too_many_connections(frame(spark, {(1, 2): 1.0}))


def test_components_prune_and_bypass(spark):
    df = frame(spark, {(1, 2): 1.0, (2, 3): 2.0, (7, 8): 5.0})
    parts = graph.graph_components(df)
    assert {r.node_id: r.component for r in parts.collect()} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7}
    only = lambda ids: {r.node_id for r in graph.prune_components(parts, spark.createDataFrame([(i,) for i in ids], "node_id long")).collect()}
    assert only([3]) == {1, 2, 3} and only([99]) == set()
    single = graph.graph_components(frame(spark, {(1, 2): 1.0}))
    assert graph.prune_components(single, spark.createDataFrame([(99,)], "node_id long")).count() == 2
    assert {(r.a_id, r.b_id): r.dist_m for r in graph.bypass(df, 2).collect()} == {(1, 3): 3.0, (7, 8): 5.0}
    assert graph.bypass(df, 1).count() == 3


def test_split_sections(spark):
    section = spark.createDataFrame([(1, 0, 10, 11, 50.0, 7.0, 50.0, 7.01)], "way_id long, pos int, a_id long, b_id long, a_lat double, a_lon double, b_lat double, b_lon double")
    points = spark.createDataFrame([(1, 0, 101, 0.7, 50.0, 7.007), (1, 0, 100, 0.3, 50.0, 7.003)], "way_id long, pos int, node_id long, t double, lat double, lon double")
    got = [(r.a_id, r.b_id) for r in graph.split_sections(section, points).collect()]
    assert sorted(got) == [(10, 100), (100, 101), (101, 11)]
    assert [(r.a_id, r.b_id) for r in graph.split_sections(section, points.where("false")).collect()] == [(10, 11)]


def test_crossings_in_graph(spark):
    """Which edges cross the two of {1-4, T-5}."""
    base = {"1-4": (1, 4), "T-5": (0, 5)}
    for (a, b), want in {(0, 1): False, (1, 2): True, (3, 4): False, (3, 6): True, (2, 3): True, (4, 5): False}.items():
        rows = [(k, *PLACES[i], *PLACES[j]) for k, (i, j) in enumerate([*base.values(), (a, b)])]
        df = spark.createDataFrame(rows, "edge_id long, a_lat double, a_lon double, b_lat double, b_lon double")
        crossed = [r for r in graph.edge_crossings(df, 0.5).collect() if 2 in (r.first, r.second)]
        assert bool(crossed) == want, (a, b)
        assert graph.edge_crossings(df, 0.03).count() == graph.edge_crossings(df, 0.5).count()


# --- nearest ---


def test_nearest_does_not_depend_on_the_cell(spark):
    rnd = random.Random(2)
    points = [(i, rnd.uniform(50, 50.3), rnd.uniform(7, 7.3)) for i in range(30)] + [(99, 52.0, 9.0)]
    nodes = [(i, rnd.uniform(50, 50.3), rnd.uniform(7, 7.3)) for i in range(80)]
    p, n = (spark.createDataFrame(x, f"{k} long, lat double, lon double") for x, k in ((points, "p_id"), (nodes, "node_id")))
    want = {i: min((round(metres((a, o), (b, q)), 6), j) for j, b, q in nodes)[1] for i, a, o in points}
    for size in (0.002, 0.05, 1.0):
        got = nearest.nearest_node(p, "p_id", n, size).collect()
        assert {r.p_id: r.node_id for r in got} == want
        used = [r.node_id for r in got]
        assert all(r.shared == (used.count(r.node_id) > 1) for r in got)
    assert nearest.nearest_node(p, "p_id", n.where("false"), 1.0).count() == 0


def test_no_point_is_too_far(spark):
    """A point with nothing near it, one across the earth, one at a pole; points whose group has nothing."""
    p = spark.createDataFrame([(1, 10.0, 10.0), (2, -40.0, -140.0), (3, 90.0, 0.0), (4, 40.0, 40.0), (5, -90.0, 7.0)], "p_id long, lat double, lon double")
    n = spark.createDataFrame([(8, 40.0, 40.0), (9, 41.0, 40.0)], "node_id long, lat double, lon double")
    got = {r.p_id: (r.node_id, r.dist_m) for r in nearest.nearest_node(p, "p_id", n).collect()}
    assert {k: v for k, (v, _) in got.items()} == {1: 8, 2: 9, 3: 9, 4: 8, 5: 8}
    assert got[1][1] == pytest.approx(metres((10.0, 10.0), (40.0, 40.0)))
    assert {r.node_id for r in route.voronoi_assign(p.withColumnRenamed("p_id", "node_id"), n.withColumnRenamed("node_id", "site_id")).collect()} == {1, 2, 3, 4, 5}
    grouped = lambda df: df.withColumn("grp", df[df.columns[0]] % 2)
    other = n.where("node_id = 8").selectExpr("node_id", "lat AS n_lat", "lon AS n_lon", "0L AS grp")
    measured = lambda df: df.withColumn("dist_m", geo.haversine("lat", "lon", "n_lat", "n_lon"))
    found = nearest.nearest(grouped(p), "p_id", other, ["n_lat", "n_lat"], ["n_lon", "n_lon"], measured, ["node_id"], 0.01, by=("grp",))
    assert {r.p_id for r in found.collect()} == {2, 4}


def test_pairs_of_points_and_things_are_not_shuffled(spark, monkeypatch):
    """A point's best is taken in the partition of its cell; near a pole cells reach farther to the side, so one round is enough."""
    rnd = random.Random(31)
    points = [(i, rnd.uniform(86, 86.01), rnd.uniform(7, 7.02)) for i in range(200)]
    nodes = [(i, rnd.uniform(86, 86.01), rnd.uniform(7, 7.02)) for i in range(200)]
    p, n = (spark.createDataFrame(x, f"{k} long, lat double, lon double") for x, k in ((points, "p_id"), (nodes, "node_id")))
    plans, write = [], nearest.stored
    monkeypatch.setattr(nearest, "stored", lambda df, name: (plans.append(df._jdf.queryExecution().toString()) if name == "ranked" else None, write(df, name))[1])
    got = {r.p_id: r.node_id for r in nearest.nearest_node(p, "p_id", n).collect()}
    assert got == {i: min((round(metres((a, o), (b, q)), 6), j) for j, b, q in nodes)[1] for i, a, o in points}
    assert len(plans) == 1 and "hashpartitioning(p_id" not in plans[0]


def test_things_are_entered_by_as_many_tasks_as_they_need(spark, monkeypatch):
    """A task's entries in cells are bounded by their counted number, as are its pairs; the answer is the same."""
    rnd = random.Random(33)
    points, nodes = ([(i, rnd.uniform(50, 50.05), rnd.uniform(7, 7.05)) for i in range(120)] for _ in range(2))
    p, n = (spark.createDataFrame(x, f"{k} long, lat double, lon double") for x, k in ((points, "p_id"), (nodes, "node_id")))
    plans, write = [], nearest.stored
    monkeypatch.setattr(nearest, "stored", lambda df, name: (plans.append(df._jdf.queryExecution().toString()) if name == "ranked" else None, write(df, name))[1])
    monkeypatch.setattr(nearest, "TASK_PAIRS", 50)
    monkeypatch.setattr(nearest, "TASK_ENTRIES", 100)
    got = {r.p_id: r.node_id for r in nearest.nearest_node(p, "p_id", n).collect()}
    assert got == {i: min((round(metres((a, o), (b, q)), 6), j) for j, b, q in nodes)[1] for i, a, o in points}
    assert len(plans) > 1 and "rangepartitioning(n_lat" in plans[0]


def test_votes_are_dealt_by_entity(spark, monkeypatch):
    """The number of partitions follows the points; an entity's votes are the same in any."""
    points = spark.createDataFrame([("building", i, k, 50 + i * 1e-3 + k * 4e-4, 7.0) for i in range(20) for k in range(3)], "role string, id long, pos int, lat double, lon double")
    boxes = spark.createDataFrame([(k, 50 + k * 5e-3, 50 + k * 5e-3 + 5e-3, 6.9, 7.1) for k in range(4)], "area_id long, lat0 double, lat1 double, lon0 double, lon1 double")
    rings = region.rectangles(boxes, "area_id")
    want = {tuple(r) for r in points.join(boxes, points.lat.between(boxes.lat0, boxes.lat1)).groupBy("role", "id", "area_id").count().collect()}
    monkeypatch.setattr(region, "TASK_POINTS", 5)
    voted = region.votes(points, rings)
    assert {tuple(r) for r in voted.collect()} == want
    assert "hashpartitioning(role" in voted._jdf.queryExecution().toString() and voted.rdd.getNumPartitions() >= 12


def test_votes_of_one_role_are_dealt_once(spark, monkeypatch):
    """A role that is a constant leaves the entities where they are; the places of points are dealt by their number too."""
    points = spark.range(20).selectExpr("'building' AS role", "id", "explode(sequence(0, 2)) AS pos", "50 + id * 1e-3D AS lat", "7D AS lon")
    rings = region.rectangles(spark.createDataFrame([(k, 50 + k * 5e-3, 50 + k * 5e-3 + 5e-3, 6.9, 7.1) for k in range(4)], "area_id long, lat0 double, lat1 double, lon0 double, lon1 double"), "area_id")
    monkeypatch.setattr(region, "TASK_POINTS", 5)
    monkeypatch.setattr(nearest, "TASK_POINTS", 5)
    won = region.assign(region.votes(points, rings))
    assert {(r.id, r.area_id) for r in won.collect()} == {(i, max(0, -(-i // 5) - 1)) for i in range(20)}
    assert won.rdd.getNumPartitions() == 60 // 5 + nearest.FEW
    assert nearest.point_in_rings(points, ["id", "pos"], rings, "area_id").rdd.getNumPartitions() == 60 // 5 + nearest.FEW


def test_closest_substations_by_place(spark):
    """As over all distances, without them: a substation of another grid nearer, ties, a grid without substation."""
    rnd = random.Random(32)
    nodes = [(i % 4, i, 50 + rnd.randrange(20) * 1e-3, 7 + rnd.randrange(20) * 1e-3) for i in range(120)]
    subs = [(i % 3, 900 + i, 50 + rnd.randrange(20) * 1e-3, 7 + rnd.randrange(20) * 1e-3) for i in range(9)]
    n, s = spark.createDataFrame(nodes, "grid_id long, node_id long, lat double, lon double"), spark.createDataFrame(subs, "grid_id long, substation_id long, s_lat double, s_lon double")
    got = {(r.grid_id, r.node_id, r.substation_id, r.dist_m) for r in cluster.closest_by_place(n, s).collect()}
    d = n.join(s, "grid_id").select("grid_id", n.node_id.alias("a_id"), F.col("substation_id").alias("b_id"), F.round(geo.haversine("lat", "lon", "s_lat", "s_lon"), 3).alias("dist_m"))
    assert got == {(r.grid_id, r.node_id, r.substation_id, r.dist_m) for r in cluster.closest_substation(n, s.select("grid_id", "substation_id"), d).collect()} and len(got) == 90


def test_nodes_meet_few_substations_of_their_area(spark, monkeypatch):
    """Of one area's 400 substations a node is measured to those in the cells about it."""
    rnd, seen = random.Random(33), []
    near = cluster.nearest

    def counted(points, key, things, lats, lons, measured, *more, **named):
        def watched(df):
            seen.append(Observation())
            return measured(df.observe(seen[-1], F.count(F.lit(1)).alias("n")))

        return near(points, key, things, lats, lons, watched, *more, **named)

    monkeypatch.setattr(cluster, "nearest", counted)
    place = lambda: (50 + rnd.random() * 2, 7 + rnd.random() * 2)
    n = spark.createDataFrame([(1, i, *place()) for i in range(400)], "grid_id long, node_id long, lat double, lon double")
    s = spark.createDataFrame([(1, 900 + i, *place()) for i in range(400)], "grid_id long, substation_id long, s_lat double, s_lon double")
    own = cluster.closest_by_place(n, s, 0.1)
    assert cluster.cluster_lengths(own).agg(F.sum("n_nodes")).first()[0] == 400
    assert sum(o.get["n"] for o in seen) < 400 * 400 / 8


def star(points, seed, lat, lon, radius, least=0.3):
    """A ring about a place, without crossings, its points on a grid of 1e-7 degrees."""
    rnd = random.Random(seed)
    ring = [(t, radius * rnd.uniform(least, 1)) for t in sorted(rnd.uniform(0, 2 * np.pi) for _ in range(points))]
    ring = [(round(float(lat + r * np.sin(t)), 7), round(float(lon + r * np.cos(t)), 7)) for t, r in ring]
    return [*ring, ring[0]]


def test_points_in_rings(spark):
    """Against a walk over every edge: stars, boxes on the cells' edges, points on borders and corners, in cells of several sizes."""
    rnd = random.Random(21)
    rings = {k: star(5 + 9 * k, 50 + k, 50 + rnd.random(), 7 + rnd.random(), 0.05 + 0.1 * k) for k in range(8)}
    rings[20] = [(50.0, 7.0), (50.0, 7.5), (50.5, 7.5), (50.5, 7.0), (50.0, 7.0)]
    rings[21] = [(50.2, 7.2), (50.2, 7.21), (50.21, 7.21), (50.21, 7.2), (50.2, 7.2)]
    rings[22] = [(50.0, 7.0), (50.6, 7.6), (50.0, 7.6), (50.0, 7.0)]
    points = [(round(rnd.uniform(49.8, 51.2), 3), round(rnd.uniform(6.8, 8.2), 3)) for _ in range(400)]
    points += [p for r in rings.values() for p in r[:6]] + [(50.25, 7.0), (50.25, 7.5), (50.5, 7.25), (50.3, 7.3), (50.2, 7.3), (50.0, 6.9), (50.5, 7.6), (50.5, 6.9)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "p_id long, lat double, lon double")
    table = spark.createDataFrame([(k, [{"lat": a, "lon": o} for a, o in r]) for k, r in rings.items()] + [(20, [{"lat": a, "lon": o} for a, o in rings[20]])], f"area_id long, ring {region.RING}")
    want = {(r.p_id, r.area_id) for r in df.crossJoin(table.where("ring is not null").dropDuplicates()).where(geo.ring_covers("ring", "lat", "lon")).collect()}
    for size in (0.005, 0.02, 0.1, 5.0):
        got = nearest.point_in_rings(df, "p_id", table, "area_id", size).collect()
        assert {(r.p_id, r.area_id) for r in got} == want and len(got) == len(want), size
    assert len(want) > 150 and nearest.point_in_rings(df, "p_id", table.where("false"), "area_id").count() == 0


def test_ring_of_a_country(spark):
    """50 000 points about eight degrees: cells hold a few edges each, and the answer is that of a walk over all."""
    ring = star(50_000, 3, 51.0, 10.0, 4.0, 0.997)
    table = spark.createDataFrame([(1, [{"lat": a, "lon": o} for a, o in ring])], f"area_id long, ring {region.RING}")
    rnd = random.Random(5)
    points = [(i, rnd.uniform(46, 56), rnd.uniform(5, 15)) for i in range(600)]
    lat, lon = np.array(ring).T
    inside = set()
    for i, a, o in points:
        straddles = (lat[:-1] > a) != (lat[1:] > a)
        x = (lon[1:] - lon[:-1])[straddles] * (a - lat[:-1][straddles]) / (lat[1:] - lat[:-1])[straddles] + lon[:-1][straddles]
        if (x > o).sum() % 2:
            inside.add(i)
    got = nearest.point_in_rings(spark.createDataFrame(points, "p_id long, lat double, lon double"), "p_id", table, "area_id", 0.02)
    assert {r.p_id for r in got.collect()} == inside and 50 < len(inside) < 550


def test_voronoi(spark):
    rnd = random.Random(3)
    sites = [(i, rnd.uniform(50, 51), rnd.uniform(7, 9)) for i in range(12)]
    nodes = [(i, rnd.uniform(50, 51), rnd.uniform(7, 9)) for i in range(60)]
    s, n = (spark.createDataFrame(x, f"{k} long, lat double, lon double") for x, k in ((sites, "site_id"), (nodes, "node_id")))
    got = {r.node_id: r.cell_id for r in route.voronoi_assign(n, s, 0.02).collect()}
    assert got == {i: min(((a - b) ** 2 + (o - q) ** 2, j) for j, b, q in sites)[1] for i, a, o in nodes}
    own = spark.createDataFrame(sites, "site_id long, lat double, lon double")
    rings = {r.site_id: [(p.lat, p.lon) for p in r.ring] for r in route.voronoi_polygons(own).collect()}
    for i, a, o in nodes:
        assert i >= 5 or spark.range(1).select(geo.ring_covers(ring_column(rings[got[i]]), a, o)).first()[0]


def plain_polygons(sites, margin):
    """Each site's box, cut by every other site."""
    lat, lon = [s[1] for s in sites], [s[2] for s in sites]
    m = margin * max(max(lat) - min(lat), max(lon) - min(lon), 1e-9)
    box = [(min(lat) - m, min(lon) - m), (min(lat) - m, max(lon) + m), (max(lat) + m, max(lon) + m), (max(lat) + m, min(lon) - m)]
    out = {}
    for key, a, o in sites:
        cell = box
        for _, a2, o2 in sites:
            if (a, o) != (a2, o2):
                cell = route.clipped(cell, (a, o), (a2, o2))
        out[key] = cell
    return out


def spread_of(corners):
    """Area and box of a polygon."""
    pairs = list(zip(corners, corners[1:] + corners[:1], strict=True))
    return [abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in pairs)) / 2, *(f(c[k] for c in corners) for k in (0, 1) for f in (min, max))]


def test_voronoi_polygons_against_all_sites(spark):
    """Scattered, crowded, on a line, at one place, on a lattice: the same polygons as cut by every other site."""
    rnd = random.Random(6)
    cases = {
        "scattered": [(i, 50 + rnd.random(), 7 + rnd.random()) for i in range(80)],
        "crowded": [(i, 50 + rnd.random() ** 6, 7 + rnd.random() ** 6) for i in range(60)] + [(90, 50.0, 7.0), (91, 50.0, 7.0), (92, 50.0, 8.0)],
        "line": [(i, 50.0, 7 + 0.1 * i) for i in range(7)],
        "lattice": [(5 * i + k, 50 + 0.1 * i, 7 + 0.1 * k) for i in range(5) for k in range(5)],
        "two": [(1, 50.0, 7.0), (2, 50.1, 7.2)],
    }
    for name, sites in cases.items():
        df = spark.createDataFrame(sites, "site_id long, lat double, lon double")
        got = {r.site_id: [(p.lat, p.lon) for p in r.ring] for r in route.voronoi_polygons(df).collect()}
        want = plain_polygons(sites, 1.0)
        assert set(got) == set(want), name
        for k, ring in got.items():
            assert ring[0] == ring[-1] and spread_of(ring[:-1]) == pytest.approx(spread_of(want[k]), rel=1e-6, abs=1e-9), (name, k)
    assert [route.voronoi_polygons(df.limit(k)).count() for k in (0, 1)] == [0, 0]


def test_cells_of_sites_on_a_line(spark, monkeypatch):
    """Corners far from all sites find theirs in one round, and rings have cells only where points are, however far they reach."""
    sites = [(i, 50 + 0.004 * i, 7.0) for i in range(60)]
    rounds, made, write, cut = [], [], nearest.stored, nearest.ring_cells
    monkeypatch.setattr(nearest, "stored", lambda df, name: (rounds.append(name), write(df, name))[1])
    monkeypatch.setattr(nearest, "ring_cells", lambda *args: (made.append(cut(*args)), made[-1])[1])
    rings = route.voronoi_polygons(spark.createDataFrame(sites, "site_id long, lat double, lon double"), margin=5000.0)
    found = {r.site_id: sorted({round(p.lat, 6) for p in r.ring}) for r in rings.collect()}
    assert all(found[i] == [round(50 + 0.004 * i + d, 6) for d in (-0.002, 0.002)] for i in range(1, 59)) and len(found) == 60
    assert rounds.count("ranked") == 1
    nodes = [(10 * i + k, 50 + 0.004 * i + 1e-3, 7.0 + 0.01 * k) for i in range(60) for k in range(3)]
    got = nearest.point_in_rings(spark.createDataFrame(nodes, "node_id long, lat double, lon double"), "node_id", rings, "site_id")
    assert {(r.node_id, r.site_id) for r in got.collect()} == {(10 * i + k, i) for i in range(60) for k in range(3)}
    assert made[0].count() < 1000


def ring_column(points):
    from tests.test_geometry import ring

    return ring(*points)


# --- clusters ---


def test_substation_count(spark):
    from pyspark.sql import functions as F

    got = spark.range(1).select(*[cluster.substation_count(F.lit(1300.0), f, 630.0) for f in (1, 0.5, 0.3)]).first()
    assert list(got) == [3, 2, 1]
    assert cluster.is_improvement(500, 450) and not cluster.is_improvement(500, 496)


def test_pam(spark):
    rnd = random.Random(6)
    points = {i: (50 + (i // 5) * 0.1 + rnd.random() * 0.01, 7 + rnd.random() * 0.01) for i in range(15)}
    d = [(1, a, b, metres(points[a], points[b])) for a, b in itertools.combinations(points, 2)]
    nodes = [(1, i, 100.0, i == 2) for i in points]
    got = cluster.pam(spark.createDataFrame(d, "grid_id long, a_id long, b_id long, dist_m double"), spark.createDataFrame(nodes, "grid_id long, node_id long, load_kva double, is_substation boolean"), 630.0, 1.0).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.substation_id, set()).add(r.node_id // 5)
    assert len(groups) == 3 and all(len(g) == 1 for g in groups.values()) and 2 in groups
    with pytest.raises(Exception, match="two"):
        cluster.pam(spark.createDataFrame([], "grid_id long, a_id long, b_id long, dist_m double"), spark.createDataFrame(nodes[:1], "grid_id long, node_id long, load_kva double, is_substation boolean"), 630.0, 1.0).collect()


def test_pam_by_place(spark, monkeypatch):
    """As over all pairs: ties, a grid whose substations are as many as needed or more, one that lacks some, one without any; only of the last two are pairs made."""
    rnd = random.Random(33)
    rows = [(g, 100 * g + i, 50 + rnd.randrange(12) * 1e-3, 7 + rnd.randrange(12) * 1e-3, 100.0, i % 9 < few) for g, few in ((1, 3), (2, 2), (3, 1), (4, 0)) for i in range(36)]
    nodes = spark.createDataFrame(rows, "grid_id long, node_id long, lat double, lon double, load_kva double, is_substation boolean")
    want = cluster.pam(graph.straight_connections(nodes, "grid_id"), nodes, 630.0, 1.3).collect()
    asked, pam = [], cluster.pam
    monkeypatch.setattr(cluster, "pam", lambda d, *args: (asked.append(d), pam(d, *args))[1])
    got = cluster.pam_by_place(nodes, 630.0, 1.3).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 144
    assert {r.grid_id for r in asked[0].select("grid_id").distinct().collect()} == {3, 4}


def plain_medoids(d, near, count, fixed, order):
    """The rounds of network_pam with a matrix of distances. near: edges (a, b): metres."""
    n = len(d)
    medoids = [*fixed, *(v for v in order if v not in fixed)][: max(count, len(fixed))]

    def assigned(chosen):
        chosen = sorted(chosen)
        owner = [min(chosen, key=lambda c: (d[v, c], c)) for v in range(n)]
        return owner, [d[v, owner[v]] for v in range(n)]

    owner, dist = assigned(medoids)
    for _ in range(50):
        moved = []
        for m in sorted(set(owner)):
            cell = [v for v in range(n) if owner[v] == m]
            inner = np.full((n, n), np.inf)
            np.fill_diagonal(inner, 0)
            rest = np.full(n, np.inf)
            for (a, b), x in near.items():
                for p, q in ((a, b), (b, a)):
                    if owner[p] == owner[q] == m:
                        inner[p, q] = min(x, inner[p, q])
                    elif owner[p] == m:
                        rest[p] = min(rest[p], dist[q] + x)
            for k in cell:
                inner = np.minimum(inner, inner[:, k : k + 1] + inner[k : k + 1])
            rest = np.array([min(rest[p] + inner[p, v] for p in cell) for v in range(n)])
            best = min(cell, key=lambda c: (round(sum(min(inner[c, v], rest[v]) for v in cell), 6), c != m, c))
            moved.append(m if m in fixed else best)
        new_owner, new_dist = assigned(moved)
        if set(moved) == set(owner) or sum(new_dist) > 0.99 * sum(dist):
            break
        owner, dist = new_owner, new_dist
    return owner, dist


def matrix(n, edges):
    d = np.full((n, n), np.inf)
    np.fill_diagonal(d, 0)
    for (a, b), m in edges.items():
        d[a, b] = d[b, a] = min(m, d[a, b])
    for k in range(n):
        d = np.minimum(d, d[:, k : k + 1] + d[k : k + 1])
    return d


NODES = "grid_id long, node_id long, load_kva double, is_substation boolean"


def test_components_by_rounds_and_in_one_task(spark):
    """A path in mixed order, random pairs, a star, a loop, repeated edges: the same components either way."""
    rnd = random.Random(1)
    path = rnd.sample(range(-300, 0), 300)
    edges = list(itertools.pairwise(path)) + [(1000 + rnd.randrange(300), 1000 + rnd.randrange(300)) for _ in range(250)] + [(5000, 5000 + i) for i in range(1, 400)] + [(9, 9), (2**62, 2**62 + 1), (2**62, 2**62 + 1)]
    label = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(400):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    df = spark.createDataFrame(edges, "a long, b long")
    for most in (components.TASK_EDGES, 0):
        got = components.components(df, task_edges=most).collect()
        assert {r.node: r.component for r in got} == label and len(got) == len(label)
        assert components.components(df.limit(0), task_edges=most).count() == 0


def test_components_of_ways(spark, monkeypatch):
    """The same parts as those of the sections, from an edge for each further way of a node: a mesh, a chain of ways, a way that meets none, one that passes a node twice."""
    rnd = random.Random(42)
    ways = {k: rnd.sample(range(200), 4) for k in range(1, 30)} | {100 + k: [1000 + 2 * k, 1001 + 2 * k, 1002 + 2 * k] for k in range(20, 0, -1)} | {500: [5000, 5001], 501: [6000, 6001, 6002, 6000]}
    df = spark.createDataFrame([(w, i, n) for w, nodes in ways.items() for i, n in enumerate(nodes)], "way_id long, pos long, node_id long")
    pairs = [(w, a, b) for w, nodes in ways.items() for a, b in itertools.pairwise(nodes)]
    parts = {r.node_id: r.component for r in graph.graph_components(spark.createDataFrame([p[1:] for p in pairs], "a_id long, b_id long")).collect()}
    least = {}
    for w, a, _ in pairs:
        least[parts[a]] = min(w, least.get(parts[a], w))
    asked, join = [], graph.components
    monkeypatch.setattr(graph, "components", lambda edges: (asked.append(edges.count()), join(edges))[1])
    got = graph.way_components(df).collect()
    assert {r.way_id: r.component for r in got} == {w: least[parts[a]] for w, a, _ in pairs} and len(got) == len(ways)
    at = {n: {w for w, nodes in ways.items() if n in nodes} for nodes in ways.values() for n in nodes}
    assert 19 < sum(len(x) - 1 for x in at.values()) <= asked[0] <= sum(len(x) for x in at.values() if len(x) > 1) < len(pairs)


def test_network_medoids(spark):
    """Two grids at once, against distances of all pairs; blocks of any size give the same."""
    n, edges = 60, {}
    for seed in range(2):
        edges[seed] = {k: float(round(m)) for k, m in random_edges(seed, n, 80).items()} | {(i, i + 1): 5.0 + i % 3 for i in range(n - 1)}
    rows = [(7 + g, a, b, m) for g, own in edges.items() for (a, b), m in own.items()]
    df = spark.createDataFrame(rows, "grid_id long, a_id long, b_id long, dist_m double")
    nodes = spark.createDataFrame([(7 + g, i, 60.0, g == 1 and i == 11) for g in edges for i in range(n)], NODES)
    order = [r.node_id for r in spark.range(n).withColumnRenamed("id", "node_id").orderBy(F.xxhash64("node_id"), "node_id").collect()]
    for block in (10_000, 40):
        got = {(r.grid_id - 7, r.node_id): (r.substation_id, r.dist_m) for r in cluster.network_pam(df, nodes, 630.0, 1.0, block).collect()}
        for g, own in edges.items():
            owner, dist = plain_medoids(matrix(n, own), own, 6, [11] if g else [], order)
            assert [got[g, i][0] for i in range(n)] == owner
            assert [got[g, i][1] for i in range(n)] == pytest.approx(dist)


def test_network_medoids_of_one_cell_and_errors(spark):
    df = frame(spark, {(i, i + 1): 5.0 for i in range(20)}).selectExpr("7L AS grid_id", "*")
    nodes = spark.createDataFrame([(7, i, 0.6, None) for i in range(21)], NODES)
    assert {r.substation_id for r in cluster.network_pam(df, nodes, 630.0, 1.0).collect()} == {10}
    assert {r.substation_id for r in cluster.network_pam(df, nodes, 0.1, 1.0, 5).collect()} == set(range(21))
    with pytest.raises(GraphError, match="no path"):
        cluster.network_pam(df.where("a_id > 2"), nodes, 630.0, 1.0)
    with pytest.raises(cluster.ClusterError, match="clusters need two"):
        cluster.network_pam(df, nodes.where("node_id = 1"), 630.0, 1.0)


def test_grids_are_searched_whole_or_by_blocks(spark, monkeypatch):
    """To the last bit the same either way, with ties, odd edges and given substations; grids of few vertices take few tables, however many rounds their medoids move."""
    rnd = random.Random(41)
    lattice = [(g, 100 * g + i, 100 * g + j, 1.0) for g in (1, 2) for i in range(36) for j in (i + 1, i + 6) if j < 36 and (j == i + 6 or j % 6)]
    odd = [(1, 105, 105, 0.0), (1, 101, 100, 0.5), (2, 205, 206, 9.9), (2, 206, 205, 3.3), (2, 7, 206, 0.1), (3, 301, 300, 2.0)]
    mixed = [(4, 400 + i, 400 + j, rnd.random()) for i in range(60) for j in (i + 1, rnd.randrange(60)) if j < 60]
    edges = spark.createDataFrame(lattice + odd + mixed, "grid_id long, a_id long, b_id long, dist_m double")
    of = {1: 36, 2: 36, 3: 2, 4: 60}
    nodes = spark.createDataFrame([(g, 100 * g + i, 60.0, g % 2 == 0 and i in (11, 12) or None) for g, n in of.items() for i in range(n)], NODES)
    tables, write = [], cluster.stored
    monkeypatch.setattr(cluster, "stored", lambda df, name: (tables.append(name), write(df, name))[1])
    read = lambda block: sorted(map(tuple, cluster.network_pam(edges, nodes, 400.0, 1.0, block).collect()))
    whole = read(10_000)
    assert len(tables) <= 4 and len(whole) == 134 and len({r[2] for r in whole}) == 6 + 6 + 1 + 9
    tables.clear()
    assert read(40) == whole and "labels" in tables  # one of the grids has more


def test_best_place_at_once():
    """The same as by searches that leave candidates out, to the last bit, with ties and borders."""
    for seed in range(40):
        rnd = random.Random(seed)
        n, unit = rnd.randrange(2, 40), seed % 2
        edges = {(i, rnd.randrange(i)): 1.0 if unit else rnd.random() for i in range(1, n)} | {(j, i): 1.0 if unit else rnd.random() for i, j in (sorted(rnd.sample(range(n), 2)) for _ in range(n // 2))}
        border = np.array([float(rnd.randrange(4)) if rnd.random() < 0.1 else np.inf for _ in range(n)])
        near = graph.adjacency(*zip(*edges, strict=True), edges.values())
        owner = rnd.randrange(n)
        assert cluster.best_at_once(owner, [near[v] for v in range(n)], border) == cluster.best_place(owner, list(range(n)), near, {v: d for v, d in enumerate(border.tolist()) if d < np.inf})


def test_paths_in_shares(spark):
    edges = random_edges(5, 30, 90)
    df = frame(spark, edges).selectExpr("1L AS grid_id", "*")
    sources = df.selectExpr("grid_id", "explode(array(a_id, b_id)) AS node_id").distinct()
    one, many = (sorted(map(tuple, graph.shortest_paths(df, sources, k).collect())) for k in (1000, 4))
    assert one == many and len(one) == sources.count() * (sources.count() - 1)


def test_paths_from_all_sources_at_once(spark, monkeypatch):
    """The same lengths, to the last bit, as source by source, which takes over where paths have many edges."""
    edges = {(k, k + 1): 7.7 for k in range(39)} | random_edges(7, 40, 90) | {(k, k + 1): 0.1 * k for k in range(40, 140)} | {(0, 40): 3.3}
    df = frame(spark, edges).selectExpr("1L AS grid_id", "*")
    sources = df.selectExpr("grid_id", "explode(array(a_id, b_id)) AS node_id").distinct()
    near = graph.adjacency(*zip(*[(*e, m) for e, m in edges.items()], strict=True))
    want = {(s, v): d for s in near for v, d in graph.dijkstra(near, s).items() if v != s}
    ends, metres_ = np.array(list(edges)), np.array(list(edges.values()))
    arrays = np.concatenate([ends[:, 0], ends[:, 1]]), np.concatenate([ends[:, 1], ends[:, 0]]), np.concatenate([metres_, metres_]), len(near), np.arange(len(near))
    assert graph.all_at_once(*arrays) is None
    assert {(r.a_id, r.b_id): r.dist_m for r in graph.shortest_paths(df, sources).collect()} == want
    monkeypatch.setattr(graph, "HOPS", 500)
    monkeypatch.setattr(graph, "AT_ONCE", 5000)
    d = graph.all_at_once(*arrays)
    assert {k: d[k] for k in want} == want and len(want) == len(near) * (len(near) - 1)


@pytest.mark.parametrize(("most", "size"), [(20, 90), (1, 13)])
def test_large_cells_have_one_ring(spark, most, size):
    """Made of the rings of parts: one ring a cell, none of its edges cross, and no node is lost."""
    rnd = random.Random(8)
    rows = [(1, i, 50 + rnd.random(), 7 + rnd.random(), i == 17) for i in range(max(18, size))] + [(2, 100 + i, 40 + rnd.random(), rnd.random(), False) for i in range(5)]
    rows += [(3, 200 + i, 50 + i * 1e-3, 7.0, None) for i in range(size // 2)] + [(4, 300 + i, 50 + (i // 8) * 0.1, 7 + (i % 8) * 0.1, False) for i in range(size)]
    df = spark.createDataFrame(rows, "cell_id long, node_id long, lat double, lon double, is_transition boolean")
    got = route.ring_routes(df, most).collect()
    place = {r[1]: r[2:4] for r in rows}
    for cell in (1, 2, 3, 4):
        own = [r for r in got if r.cell_id == cell]
        edges, left = {(r.a_id, r.b_id) for r in own if r.joined}, {r.a_id for r in own if not r.joined}
        at: dict[int, list[int]] = {}
        for x, y in edges:
            at.setdefault(x, []).append(y)
            at.setdefault(y, []).append(x)
        nodes = {r[1] for r in rows if r[0] == cell}
        assert set(at) | left == nodes and not set(at) & left
        if cell == 3:  # on a line every junction lies on an edge
            continue
        assert all(len(x) == 2 for x in at.values())
        walk, before = [min(at)], None
        while len(walk) == 1 or walk[-1] != walk[0]:
            before, step = walk[-1], next(n for n in at[walk[-1]] if n != before) if len(walk) > 1 else at[walk[0]][0]
            walk.append(step)
        assert set(walk) == set(at), "one ring"
        assert not any(route.cross(*(place[n] for n in (*e, *f))) for e, f in itertools.combinations(sorted(edges), 2))
        assert all(r.dist_m == pytest.approx(metres(place[r.a_id], place[r.b_id])) for r in own if r.joined)
    if most == 20:
        whole = lambda most: sorted((r.cell_id, r.a_id, r.b_id or 0) for r in route.ring_routes(df, most).collect())
        assert whole(90) == whole(10**6)


def test_rings_are_dealt_by_their_nodes(spark, monkeypatch):
    """Small cells are solved in as many tasks as their nodes ask for; the rings are the same in any."""
    rnd = random.Random(34)
    points = [(i % 6, i, 50 + rnd.random(), 7 + rnd.random(), False) for i in range(60)]
    df = spark.createDataFrame(points, "cell_id long, node_id long, lat double, lon double, is_transition boolean")
    tasks, write = [], route.stored
    monkeypatch.setattr(route, "stored", lambda d, name: (tasks.append(d.rdd.getNumPartitions()) if name == "rings" else None, write(d, name))[1])
    want = sorted(map(str, route.ring_routes(df).collect()))
    monkeypatch.setattr(route, "TASK_NODES", 5)
    assert sorted(map(str, route.ring_routes(df).collect())) == want and tasks == [8, 20]


def test_medoids_reach_the_best_single_swap():
    rnd = np.random.default_rng(1)
    p = rnd.random((12, 2))
    d = np.sqrt(((p[:, None] - p) ** 2).sum(2))
    chosen = cluster.medoids(d, [], 2)
    cost = lambda c: d[:, list(c)].min(1).sum()
    assert all(cost(chosen) * 0.99 < cost([chosen[0], i]) for i in range(12)) and len(set(chosen)) == 2


def test_cluster_members(spark):
    own = spark.createDataFrame([(1, 1, 9, 1.0), (1, 2, 9, 2.0), (1, 3, 8, 1.0), (1, 9, 9, 0.0), (1, 8, 8, 0.0)], "grid_id long, node_id long, substation_id long, dist_m double")
    lines = spark.createDataFrame([(1, 1, 2, 1.0), (1, 2, 3, 1.0), (1, 3, 8, 1.0)], "grid_id long, a_id long, b_id long, dist_m double")
    assert sorted((r.substation_id, r.a_id) for r in cluster.lines_within(lines, own).collect()) == [(8, 3), (9, 1)]
    assert {r.substation_id: (r.n_nodes, r.total_m) for r in cluster.cluster_lengths(own).collect()} == {9: (3, 3.0), 8: (2, 1.0)}


def test_vertices_are_not_broadcast(spark, monkeypatch):
    """What grows with a map's vertices doesn't pass the driver as a broadcast, however small Spark takes it for; grids and blocks may."""
    plans, write = [], cluster.stored
    tell = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(cluster, "stored", lambda df, name: (tell(df), write(df, name))[1])
    rows = [(g, 100 * g + i, 100 * g + i + 1, 1.0 + i % 3) for g in (1, 2) for i in range(19)]
    edges = write(spark.createDataFrame(rows, "grid_id long, a_id long, b_id long, dist_m double"), "edges")
    nodes = spark.createDataFrame([(g, 100 * g + i, 1.0, i == 7) for g in (1, 2) for i in range(20)], "grid_id long, node_id long, load_kva double, is_substation boolean")
    own = write(cluster.network_pam(edges, nodes, 5.0, 1.0, 8), "own")
    assert own.count() == 40
    held = len(plans)
    tell(cluster.lines_within(edges, own))
    tell(graph.contract(edges, own.where("node_id % 5 = 0").select("node_id")))
    tell(grid.lines(edges, own.withColumns({"lat": F.lit(50.0), "lon": F.lit(7.0)}), ""))
    joins = [line for p in plans for line in p.splitlines() if "BroadcastHashJoin" in line]
    assert held > 8 and not [j for j in joins if "BuildLeft" in j or re.search(r"Join \[[^]]*(node_id|a_id|b_id|owner|component)#", j)]


# --- rings ---


def test_published_ring(spark):
    edges, left = route.Ring(PLACES).solve()
    assert edges == {(0, 1), (1, 3), (3, 4), (4, 5), (5, 6), (2, 6), (0, 2)} and left == []
    df = spark.createDataFrame([(1, i, *p, i == 0) for i, p in enumerate(PLACES)] + [(2, 20, 50.0, 7.0, True)] + [(3, 30 + k, 50.0 + k, 7.0, k == 0) for k in range(2)], "cell_id long, node_id long, lat double, lon double, is_transition boolean")
    got = route.ring_routes(df).collect()
    assert {(r.a_id, r.b_id) for r in got if r.cell_id == 1} == edges and {(r.a_id, r.b_id) for r in got if r.cell_id == 3} == {(30, 31)}
    assert not [r for r in got if r.cell_id == 2] and all(r.joined for r in got)


def test_rings_neither_cross_nor_branch():
    rnd = random.Random(9)
    for _ in range(5):
        places = [(50 + rnd.random(), 7 + rnd.random()) for _ in range(25)]
        edges, left = route.Ring(places).solve()
        ends = [v for e in edges for v in e]
        assert all(ends.count(v) == 2 for v in set(ends)) and len(set(ends)) + len(left) == 25
        assert not any(route.cross(places[a], places[b], places[c], places[d]) for (a, b), (c, d) in itertools.combinations(edges, 2))


def test_hull(spark):
    assert set(route.hull([(0, 0), (0, 2), (2, 2), (2, 0), (1, 1), (0, 1)])) == {(0, 0), (0, 2), (2, 2), (2, 0)}
    df = spark.createDataFrame([(1, 10 + i, *p) for i, p in enumerate(PLACES[1:], 1)] + [(2, 5, 1.0, 1.0)], "grid_id long, node_id long, lat double, lon double")
    got = {r.grid_id: r.node_id for r in route.central_node(df).collect()}
    assert got == {1: 16, 2: 5}


# --- elements and numbers ---


def types(spark):
    return spark.createDataFrame([(1, "A", 20.0, 0.4), (2, "B", 10.0, 0.4), (3, "C", 110.0, 10.0), (4, "D", 10.0, 0.4)], "file_order int, id string, v_rated_a double, v_rated_b double")


def test_type_lookup(spark):
    assert grid.first_transformer_type(types(spark), 10.0, 0.4) == "B"
    with pytest.raises(grid.TypeLookupError):
        grid.first_transformer_type(types(spark), 30.0, 0.4)
    df = spark.createDataFrame([("x", "D", 10.0, 0.4), ("y", "A", 10.0, 0.4), ("z", None, 110.0, 10.0)], "uuid string, type string, v_a_kv double, v_b_kv double")
    assert {r.uuid: r.type for r in grid.update_transformers(df, types(spark)).collect()} == {"x": "D", "y": "B", "z": "C"}
    odd = spark.createDataFrame([("w", "A", 1.0, 2.0)], df.schema)
    with pytest.raises(grid.TypeLookupError, match="w"):
        grid.update_transformers(odd, types(spark))
    assert grid.update_transformers(odd, types(spark), strict=False).first().type is None
    three = spark.createDataFrame([("v", "Q", 110.0, 10.0, 0.4)], "uuid string, type string, v_a_kv double, v_b_kv double, v_c_kv double")
    kinds = spark.createDataFrame([(1, "Q", 110.0, 20.0, 0.4), (2, "R", 110.0, 10.0, 0.4)], "file_order int, id string, v_rated_a double, v_rated_b double, v_rated_c double")
    assert grid.update_transformers(three, kinds, 3).first().type == "R"


def test_shared_vertices(spark):
    rows = spark.createDataFrame([(1, 10, 2.0, False), (1, 11, 3.0, False), (2, 12, 4.0, True)], "node_id long, building_id long, power_kw double, is_substation boolean")
    assert {r.node_id: (r.n_buildings, r.power_kw, r.is_substation) for r in grid.vertex_loads(rows).collect()} == {1: (2, 5.0, False), 2: (0, 0.0, True)}


def test_dummy_hv(spark):
    centre = spark.createDataFrame([(1, 6, 50.5, 8.5, 1)], "grid_id long, node_id long, lat double, lon double, subnet int")
    hv, trafo = grid.dummy_hv_node(centre, 110.0, 10.0, "C")
    row = hv.first()
    assert (row.lat, row.lon, row.slack, row.v_rated_kv, row.subnet) == (50.5, 8.5, True, 110.0, 1001)
    assert (trafo.first().parallel, trafo.first().auto_tap) == (2, True)
    with pytest.raises(grid.GridError):
        grid.dummy_hv_node(centre.where("false"), 110.0, 10.0, "C")


def numbered(spark, n, offset):
    rows = [(g, f"{g}-{k}", 10.0 if k == 2 else 0.4, 1, False) for g in range(n) for k in range(3)]
    df = spark.createDataFrame(rows, "grid_id long, uuid string, v_rated_kv double, subnet int, slack boolean")
    out, following = merge.assign_subnets(df, offset)
    return {r.uuid: r.subnet for r in out.collect()}, following


def test_subnets(spark):
    one, following = numbered(spark, 1, 1)
    assert one == {"0-0": 1, "0-1": 1, "0-2": 3} and following == 3
    assert numbered(spark, 1, 42)[1] == 44
    eleven, following = numbered(spark, 11, 42)
    assert following == 54 and [eleven[f"{g}-0"] for g in range(11)] == list(range(42, 53)) and eleven["3-2"] == 54


def test_number_all(spark):
    cols = "grid_id long, uuid string, v_rated_kv double, subnet int, slack boolean"
    lv = spark.createDataFrame([(1, "a", 0.4, 1, False), (1, "b", 0.4, 1, False), (1, "m", 10.0, 100, True)], cols)
    mv = spark.createDataFrame([(9, "m", 10.0, 1, True), (9, "k", 10.0, 1, False)], cols)
    hv = spark.createDataFrame([(5, "h", 110.0, 1001, True), (5, "m", 10.0, 1, False)], cols)
    got = {r.uuid: r.subnet for r in merge.number_all(lv, mv, None, hv, hv_is_dummy=True).collect()}
    assert got == {"a": 1, "b": 1, "m": 3, "k": 3, "h": 5}
    changed = spark.createDataFrame([(9, "m", 20.0, 77, True), (9, "new", 20.0, 77, False)], cols)
    got = {r.uuid: (r.subnet, r.v_rated_kv) for r in merge.number_all(None, mv, changed, None).collect()}
    assert got == {"m": (1, 20.0), "k": (1, 10.0), "new": (77, 20.0)}
    assert merge.number_all(None, None, None, hv, hv_is_dummy=True).first().subnet == 100
    with pytest.raises(grid.GridError):
        merge.number_all(None, None, None, None)


def test_joint_and_check(spark):
    nodes = spark.createDataFrame([("a", 0.4, 1, True), ("b", 0.4, 1, False)], "uuid string, v_rated_kv double, subnet int, slack boolean")
    lines = spark.createDataFrame([("a", "b", 5.0), ("a", "x", -1.0)], "node_a string, node_b string, length_m double")
    assert {r.problem: r.n for r in merge.check({"nodes": nodes, "lines": lines}).collect()} == {"lines: unknown node_b": 1, "line of negative length": 1}
    assert merge.check({"nodes": nodes, "lines": lines.where("length_m > 0")}).count() == 0
    both = merge.joint([{"nodes": nodes}, {"nodes": nodes, "lines": lines}])
    assert both["nodes"].count() == 4 and both["lines"].count() == 2
    with pytest.raises(grid.GridError):
        merge.joint([])
    with pytest.raises(grid.GridError, match="several"):
        merge.summary(nodes.unionByName(spark.createDataFrame([("c", 10.0, 1, False)], nodes.schema)))
    row = merge.summary(nodes).first()
    assert (row.subnet, row.level, row.n_nodes, row.n_slack) == (1, "lv", 2, 1)
    with pytest.raises(grid.GridError):
        merge.merge_results({1}, {2: nodes})
    assert merge.merge_results({1, 2}, {1: nodes, 2: nodes}).count() == 4


