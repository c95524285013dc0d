"""Map files, type files, configuration and the whole run."""

import datetime
import random

import pytest

from gridweave import config
from gridweave.config import ConfigError
from gridweave.operators import merge
from gridweave.plans import pipeline
from gridweave.sources import assets, osm_pbf

LINE_TYPES = 'uuid,b,g,i_max,id,r,v_rated,x\nl1,1.0,0.0,235.0,LOW,0.3,0.4,0.07\nl2,1.0,0.0,535.0,MEDIUM,0.1,10.0,0.09\n'
TRAFOS = (
    "uuid,b_m,d_phi,d_v,g_m,id,r_sc,s_rated,tap_max,tap_min,tap_neutr,tap_side,v_rated_a,v_rated_b,x_sc\n"
    "t1,0,0,0.5,0,20/0.4,10,630,10,-10,0,false,20,0.4,23\nt2,0,0,2.5,0,10/0.4,1.7,63,2,-2,0,false,10,0.4,9\nt3,0,0,1.5,0,110/10,1,63000,5,-5,0,false,110,10,9\n"
)


@pytest.fixture
def types(tmp_path):
    (tmp_path / "line_type_input.csv").write_text(LINE_TYPES)
    (tmp_path / "transformer_2_w_type_input.csv").write_text(TRAFOS)
    return str(tmp_path)


# --- files ---


@pytest.mark.parametrize("dense", [True, False])
def test_pbf_round_trip(spark, tmp_path, dense):
    nodes = [(i, 50 + i * 1e-4, -7 + i * 1e-4, {"power": "pole", "name": f"é{i}"} if i % 3 == 0 else {}) for i in range(1, 50)] + [(1 << 40, -33.5, 151.25, {})]
    ways = [(7, [1, 2, 3, 1], {"building": "yes"}), (8, [], {})]
    relations = [(9, [(7, "way", "outer"), (3, "node", ""), (9, "relation", "x")], {"boundary": "administrative"})]
    path = str(tmp_path / "map.osm.pbf")
    osm_pbf.write(path, nodes, ways, relations, dense, per_block=20)
    assert len([b for b in osm_pbf.blobs(path) if b[0] == "OSMData"]) == 5
    n, w, r = osm_pbf.read(spark, path)
    got = {x.node_id: x for x in n.collect()}
    assert {i: (pytest.approx(got[i].lat, abs=1e-9), pytest.approx(got[i].lon, abs=1e-9), got[i].tags) for i in got} == {i: (a, o, t) for i, a, o, t in nodes}
    assert {x.way_id: (x.nodes, x.tags) for x in w.collect()} == {i: (refs, t) for i, refs, t in ways}
    row = r.first()
    assert (row.rel_id, [tuple(m) for m in row.members], row.tags) == relations[0]


@pytest.mark.parametrize("packing", ["raw", "zlib", "lzma", "zstd"])
def test_map_is_decoded_once(spark, tmp_path, packing):
    """Tables by type in the shared folder hold what the file holds; a read of one type takes that type's rows alone."""
    path = str(tmp_path / "map.pbf")
    osm_pbf.write(path, [(1, 50.0, 7.0, {"a": "b"}), (2, 50.1, 7.1, {})], [(1, [1, 2], {"highway": "x"})], [(1, [(1, "way", "outer")], {})], packing=packing)
    for one, other in zip(osm_pbf.read(spark, path), osm_pbf.read_once(spark, path), strict=True):
        assert one.schema == other.schema and sorted(map(str, one.collect())) == sorted(map(str, other.collect()))
    plan = osm_pbf.read_once(spark, path)[1]._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(type" in plan and "BatchScan" not in plan


def test_types_are_pushed_down(spark, tmp_path, monkeypatch):
    """A read of relations decodes no node: the plan shows the filter as taken, and a broken group of nodes goes unnoticed."""
    path = str(tmp_path / "map.pbf")
    osm_pbf.write(path, [(i, 50.0, 7.0, {"a": "b"}) for i in range(100)], [(1, [1, 2], {"highway": "x"})], [(1, [(1, "way", "outer")], {})], per_block=10)
    nodes, ways, relations = osm_pbf.read(spark, path)
    assert (nodes.count(), ways.count(), relations.count()) == (100, 1, 1)
    plan = relations._jdf.queryExecution().executedPlan().toString()
    assert "type" not in plan[plan.index("Filter") if "Filter" in plan else len(plan) :].split("BatchScan")[0].replace("isnotnull(type", "")
    block = next(osm_pbf.unpack(open(path, "rb").read()[at : at + size]) for kind, at, size in osm_pbf.blobs(path) if kind == "OSMData")
    assert sum(b.num_rows for b in osm_pbf.entities(block)) == 10
    monkeypatch.setattr(osm_pbf, "summed", lambda values: 1 / 0)
    assert list(osm_pbf.entities(block, frozenset({"relation"}))) == []
    reader = osm_pbf.PbfReader(path)
    left = list(reader.pushFilters([osm_pbf.EqualTo(("type",), "way"), osm_pbf.EqualTo(("id",), 3), osm_pbf.In(("type",), ("way", "node"))]))
    assert left == [osm_pbf.EqualTo(("id",), 3)] and reader.kinds == {"way"}


def test_varints_and_tags_in_numpy():
    rnd = random.Random(2)
    values = [rnd.randrange(1 << rnd.randrange(1, 65)) for _ in range(500)] + [0, 127, 128, (1 << 64) - 1]
    assert osm_pbf.varints(b"".join(map(osm_pbf.number_bytes, values))).tolist() == values and osm_pbf.varints(b"").tolist() == []
    with pytest.raises(osm_pbf.OsmReadError):
        osm_pbf.varints(b"\x01\x80")
    import numpy as np

    text = ["", "a", "b", "c"]
    for words, want in (([1, 2, 0, 0, 3, 1, 2, 2, 0], [{"a": "b"}, {}, {"c": "a", "b": "b"}]), ([1, 0, 0, 0, 0], [{"a": ""}, {}, {}]), ([], [{}, {}, {}])):
        assert [dict(t) for t in osm_pbf.tag_maps(np.array(words, np.uint64), 3, text).to_pylist()] == want


def test_folder_of_map_files(spark, tmp_path):
    """Written in tasks, read as one map."""
    nodes = spark.range(0, 1000, 1, 5).selectExpr("id AS node_id", "50 + id * 1e-4 AS lat", "7 + id * 1e-4 AS lon", "IF(id % 3 = 0, map('name', concat('é', id)), map()) AS tags")
    ways = spark.range(0, 40, 1, 3).selectExpr("id AS way_id", "array(id, id + 1) AS nodes", "map('highway', 'x') AS tags")
    relations = spark.range(2).selectExpr("id AS rel_id", "array(named_struct('id', id, 'type', 'way', 'role', 'outer')) AS members", "map('boundary', 'administrative') AS tags")
    path = str(tmp_path / "maps")
    osm_pbf.write_tables(nodes, ways, relations, path)
    n, w, r = osm_pbf.read(spark, path)
    got = {x.node_id: x for x in n.collect()}
    assert len(got) == 1000 and got[999].tags == {"name": "é999"} and got[1].tags == {} and got[500].lat == pytest.approx(50.05)
    assert sorted((x.way_id, x.nodes) for x in w.collect()) == [(i, [i, i + 1]) for i in range(40)]
    assert sorted((x.rel_id, [tuple(m) for m in x.members]) for x in r.collect()) == [(i, [(i, "way", "outer")]) for i in range(2)]


def test_broken_maps(spark, tmp_path):
    (tmp_path / "text.pbf").write_text("this is not a map")
    (tmp_path / "none.pbf").write_bytes(b"")
    good = tmp_path / "good.pbf"
    osm_pbf.write(str(good), [(1, 1.0, 1.0, {})])
    (tmp_path / "cut.pbf").write_bytes(good.read_bytes()[:-3])
    for name in ("text.pbf", "cut.pbf", "missing.pbf"):
        with pytest.raises(osm_pbf.OsmReadError, match="Reading failed due to"):
            osm_pbf.read(spark, str(tmp_path / name))
    with pytest.raises(osm_pbf.OsmReadError):
        osm_pbf.read(spark, "")
    assert osm_pbf.read(spark, str(tmp_path / "none.pbf"))[0].count() == 0
    raw = bytearray(good.read_bytes())
    raw[-4] ^= 255
    (tmp_path / "damaged.pbf").write_bytes(raw)
    with pytest.raises(Exception, match="Reading failed due to"):
        osm_pbf.read(spark, str(tmp_path / "damaged.pbf"))[0].collect()


def test_types(spark, types, tmp_path):
    got = assets.read_types(spark, types)
    assert [(r.id, r.file_order) for r in got["transformer_2_w_type_input"].orderBy("file_order").collect()] == [("20/0.4", 1), ("10/0.4", 2), ("110/10", 3)]
    (tmp_path / "global").mkdir()
    for f in ("line_type_input.csv", "transformer_2_w_type_input.csv"):
        (tmp_path / "global" / f).write_text((tmp_path / f).read_text().replace(",", ";"))
    assert assets.read_types(spark, types, ";", hierarchic=True)["line_type_input"].count() == 2
    for text in ("b,g\n1,2\n", LINE_TYPES.split("\n")[0] + "\n"):
        (tmp_path / "line_type_input.csv").write_text(text)
        with pytest.raises(assets.AssetError):
            assets.read_types(spark, types)
    with pytest.raises(assets.AssetError):
        assets.read_types(spark, types + "/nowhere")


def test_types_of_three_windings_and_broken_values(spark, types, tmp_path):
    assert assets.read_types(spark, types)["transformer_3_w_type_input"].count() == 0
    columns = [c.split()[0] for c in assets.TRANSFORMER_3W_TYPE.split(", ")]
    rows = [["x", *map(str, range(1, len(columns)))], ["y", *map(str, range(1, len(columns)))]]
    text = lambda rows: "\n".join(",".join(r) for r in [columns, *rows]) + "\n"
    (tmp_path / "transformer_3_w_type_input.csv").write_text(text(rows))
    got = assets.read_types(spark, types)["transformer_3_w_type_input"].orderBy("file_order").collect()
    assert [(r.uuid, r.v_rated_a, r.v_rated_b, r.v_rated_c, r.file_order) for r in got] == [("x", 15.0, 16.0, 17.0, 1), ("y", 15.0, 16.0, 17.0, 2)]
    rows[1][columns.index("v_rated_b")] = "20 kV"
    (tmp_path / "transformer_3_w_type_input.csv").write_text(text(rows))
    with pytest.raises(assets.AssetError, match="line 3: v_rated_b 20 kV"):
        assets.read_types(spark, types)


def test_written_grid_reads_back(spark, tmp_path):
    nodes = spark.createDataFrame([("a", 1.5, "x,y"), ("b", None, 'say "z"')], "uuid string, lat double, name string")
    for hierarchic in (False, True):
        paths = assets.write_grid({"nodes": nodes}, str(tmp_path / f"out{hierarchic}"), ";", hierarchic)
        back = assets.read_grid(spark, paths, {"nodes": "uuid string, lat double, name string"}, ";")["nodes"]
        assert sorted(map(tuple, back.select("uuid", "lat").collect()), key=str) == sorted([("a", 1.5), ("b", None)], key=str)
    assert assets.output_directory("d", "g", True, datetime.datetime(2024, 2, 3, 4, 5, 6)) == "d/g_2024-02-03_04-05-06" and assets.output_directory("d", "g", False) == "d/g"


# --- configuration ---


def good_config(**changes):
    values = {"input": {"pbf": "x.pbf", "asset": {"directory": "a"}}, "output": {"csv": {"directory": "o"}}, "lv": {"average_power_density": 10.0}} | changes
    return config.build(config.Config, values)


def test_config_rules(tmp_path):
    assert config.check(good_config()).lv.load_simultaneous_factor == 0.2
    for changes in (
        {"lv": None}, {"input": {"pbf": "", "asset": {"directory": "a"}}}, {"input": {"pbf": "x"}}, {"output": {}}, {"output": {"csv": {"directory": ""}}}, {"output": {"csv": {"directory": "o", "separator": ""}}},
        {"output": {"csv": {"directory": "o"}, "lv": False, "mv": False, "hv": False}}, {"lv": {"starting_level": 3}}, {"lv": {"starting_level": 9, "lowest_level": 8}}, {"lv": {"load_simultaneous_factor": 1.5}},
    ):
        with pytest.raises(ConfigError):
            config.check(good_config(**changes))
    assert config.check(good_config(output={}), listeners=1)
    assert config.check(good_config(lv=None, mv={})).with_defaults().lv.average_power_density == 12.5
    assert good_config(output={"hv": False}).with_defaults().mv.spawn_missing_hv_nodes is False
    with pytest.raises(ConfigError):
        good_config(lv={"unknown": 1})
    with pytest.raises(ConfigError):
        config.load("a\\b.toml")
    (tmp_path / "run.toml").write_text('[input]\npbf = "m.pbf"\n[input.asset]\ndirectory = "d"\n[output.csv]\ndirectory = "o"\n[lv.filter]\nhighway = ["residential"]\n[voltage.mv]\ndefault = 20.0\n')
    got = config.check(config.load(str(tmp_path / "run.toml")))
    assert got.lv.filter.highway == ["residential"] and got.voltage.mv.rated == [20.0] and got.voltage.lv.default == 0.4


# --- the whole run ---


def village(path, broken=()):
    """Two areas side by side, each with a ladder of streets, twelve houses and one substation; a landuse covers all but one house."""
    rnd = random.Random(4)
    nodes, ways, at = [], [], {}

    def node(lat, lon, tags=None):
        nodes.append((len(nodes) + 1, lat, lon, tags or {}))
        return len(nodes)

    for area in range(2):
        for y in range(4):
            for x in range(5):
                at[area, y, x] = node(51.0 + y * 1e-3, 7.0 + area * 0.02 + x * 1.5e-3)
        for y in range(4):
            ways.append((len(ways) + 1, [at[area, y, x] for x in range(5)], {"highway": "residential"}))
        for x in (0, 4):
            ways.append((len(ways) + 1, [at[area, y, x] for y in range(4)], {"highway": "service"}))
        for k in range(12):
            lat, lon, h = 51.0 + (k % 4) * 1e-3 + rnd.uniform(1, 3) * 1e-4, 7.0 + area * 0.02 + (k // 4) * 2e-3 + rnd.uniform(2, 9) * 1e-4, 5e-5
            corners = [node(lat + a * h, lon + o * h) for a, o in ((-1, -1), (-1, 1), (1, 1), (1, -1))]
            ways.append((len(ways) + 1, [*corners, corners[0]], {"building": "yes"}))
        node(51.0015, 7.0 + area * 0.02 + 0.003, {"power": "substation"})
    field = [node(50.99 + a, 6.99 + o) for a, o in ((0, 0), (0, 0.05), (0.05, 0.05), (0.05, 0))]
    ways.append((len(ways) + 1, [*field, field[0]], {"landuse": "residential"}))
    far = [node(52 + a * 1e-4, 9 + o * 1e-4) for a, o in ((0, 0), (0, 1), (1, 1), (1, 0))]
    ways.append((len(ways) + 1, [*far, far[0]], {"building": "yes"}))
    relations = []
    for area in range(2):
        c = [node(50.995 + a, 6.995 + area * 0.02 + o) for a, o in ((0, 0), (0, 0.02), (0.02, 0.02), (0.02, 0))]
        a, b = len(ways) + 1, len(ways) + 2
        ways += [(a, c[:3], {}), (b, [c[0], c[3], c[2]], {})]
        relations.append((area + 1, [(a, "way", "outer"), (b, "way", "outer")], {"boundary": "administrative", "admin_level": "8"}))
    relations += broken
    osm_pbf.write(path, nodes, ways, relations)


def test_broken_boundaries_are_told(spark, types, tmp_path):
    village(str(tmp_path / "village.pbf"), [(77, [(1, "way", "outer"), (9, "way", "outer")], {"boundary": "administrative", "admin_level": "6"})])
    cfg = good_config(
        input={"pbf": str(tmp_path / "village.pbf"), "asset": {"directory": types}}, output={"csv": {"directory": str(tmp_path / "out")}, "mv": False, "hv": False}, lv={"average_power_density": 500.0, "min_distance": 5.0}
    )
    _, problems, _ = pipeline.run_and_write(spark, cfg)
    assert [r.problem[:34] for r in problems.collect()] == ["boundary left out: relation 77: a "]


def test_whole_run(spark, types, tmp_path):
    village(str(tmp_path / "village.pbf"))
    cfg = good_config(
        input={"pbf": str(tmp_path / "village.pbf"), "asset": {"directory": types}}, output={"grid_name": "v", "add_timestamp": False, "csv": {"directory": str(tmp_path / "out")}},
        lv={"average_power_density": 500.0, "min_distance": 5.0},
    )
    seen = []
    paths, problems, summary = pipeline.run_and_write(spark, cfg, [seen.append])
    out = seen[0]
    assert problems.count() == 0, problems.collect()
    assert set(paths) == {"nodes", "lines", "loads", "transformers"} and all(p.startswith(str(tmp_path / "out" / "v")) for p in paths.values())
    assert out["loads"].count() == 24
    by_level = {}
    for r in summary.collect():
        by_level.setdefault(r.level, []).append(r)
    n_lv = out["transformers"].where("v_a_kv = 10").count()
    assert n_lv >= 2 and len(by_level["lv"]) == n_lv and len(by_level["hv"]) == 1 and sum(r.n_nodes for r in by_level["mv"]) == n_lv
    assert {r.type for r in out["lines"].select("type").distinct().collect()} == {"LOW", "MEDIUM"}
    assert out["nodes"].where("lat > 51.5").count() == 0
    back = spark.read.option("header", True).csv(paths["nodes"])
    assert back.count() == out["nodes"].count() and merge.summary(out["nodes"], strict=False).count() == summary.count()
    names = {k: {r.id.split(":")[0].split(" (")[0] for r in out[k].select("id").collect()} for k in ("nodes", "loads", "transformers")}
    assert names["nodes"] >= {"Building connection", "Node", "Mv node to lv node Node"} and names["loads"] == {"Load of building"} and names["transformers"] >= {"Transformer between Mv node to lv node Node"}
    houses = {r.id for r in out["loads"].select("id").collect()}
    assert len(houses) == 24 and all(0 < int(x.split(": ")[1]) < 100 for x in houses)
    assert out["lines"].where("geometry not rlike '^LINESTRING \\\\([-0-9.E]+ [-0-9.E]+, [-0-9.E]+ [-0-9.E]+\\\\)$'").count() == 0
    # both areas are separate grids: no low-voltage line joins them
    side = out["nodes"].where("kind <> 'mv' and kind <> 'hv'").selectExpr("uuid", "lon > 7.015 AS east")
    lines = out["lines"].where("type = 'LOW'")
    ends = lines.join(side.toDF("node_a", "ea"), "node_a").join(side.toDF("node_b", "eb"), "node_b")
    assert ends.count() == lines.count() and ends.where("ea <> eb").count() == 0


def test_missing_high_voltage(spark):
    from gridweave.operators.grid import GridError

    with pytest.raises(GridError, match="neither given"):
        pipeline.run(spark, good_config(mv={"spawn_missing_hv_nodes": False}))


def test_command_line(tmp_path):
    from gridweave.__main__ import main

    with pytest.raises(SystemExit):
        main([])
    (tmp_path / "bad.toml").write_text("[output]\nlv = false\n")
    with pytest.raises(ConfigError):
        main(["--config", str(tmp_path / "bad.toml")])


def test_house_connections_and_levels(spark, types, tmp_path):
    village(str(tmp_path / "village.pbf"))
    cfg = good_config(
        input={"pbf": str(tmp_path / "village.pbf"), "asset": {"directory": types}}, output={"csv": {"directory": str(tmp_path / "out")}, "mv": False, "hv": False},
        lv={"average_power_density": 500.0, "min_distance": 5.0, "consider_house_connection_points": True, "starting_level": 6},
    )
    out = pipeline.run(spark, cfg)
    assert out["loads"].count() == 24 and "hv" not in {r.kind for r in out["nodes"].select("kind").distinct().collect()}
    assert merge.check(out).count() == 0


