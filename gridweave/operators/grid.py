"""Grid elements: nodes, lines, loads, transformers, and the types they take.

Ids are made of the grid's and the vertex's keys, never drawn at random, so a run can be repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridweave.functions import geo, naming
from gridweave.operators.components import indexed
from gridweave.storage import dealt


class TypeLookupError(LookupError):
    """No equipment type fits."""


class GridError(ValueError):
    """A grid without what it needs."""


def uuid_of(*parts) -> F.Column:
    """A name-based id: the digest of its parts, written as a UUID."""
    h = F.md5(F.concat_ws("|", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def building_loads(buildings: DataFrame, density_w_m2: float) -> DataFrame:
    """(building_id, area_m2, power_kw, lat, lon) of buildings (building_id, ring): the place is the ring's centroid."""
    area = buildings.withColumn("area_m2", geo.ring_area_m2("ring")).withColumn("_c", geo.ring_centroid("ring"))
    return area.select("building_id", "area_m2", geo.household_kw("area_m2", density_w_m2).alias("power_kw"), F.col("_c.lat").alias("lat"), F.col("_c.lon").alias("lon"))


def vertex_loads(connections: DataFrame) -> DataFrame:
    """All loads of a vertex together: (node_id, n_buildings, power_kw, is_substation, building) of (node_id, building_id, power_kw, is_substation); building is the least of them. What is a substation and a building is a substation only."""
    power = F.when(F.col("is_substation"), F.lit(0.0)).otherwise(F.col("power_kw"))
    least = F.min(F.when(~F.col("is_substation"), F.col("building_id"))).alias("building")
    return connections.groupBy("node_id").agg(F.count_if(~F.col("is_substation")).alias("n_buildings"), F.sum(power).alias("power_kw"), F.max("is_substation").alias("is_substation"), least)


def optional(df: DataFrame, name: str, default: str) -> F.Column:
    """A column, or where df has none of that name another."""
    return F.col(name if name in df.columns else default)


def lv_nodes(vertices: DataFrame, v_rated_kv: float) -> DataFrame:
    """Nodes of vertices (grid_id, node_id, lat, lon, n_buildings, is_substation, degree): substations, buildings and crossings; others are none.

    Names: of a building by its id (building), of a crossing by its node's (street_node), of a substation
    by its place; a name that a vertex has (name) is kept. Without these columns the vertex's id serves.
    """
    kind = F.when(F.col("is_substation"), "substation").when(F.col("n_buildings") > 0, "building").when(F.col("degree") > 2, "crossing")
    chosen = vertices.withColumn("kind", kind).where("kind is not null")
    made = F.when(F.col("kind") == "building", naming.building_node_name(optional(vertices, "building", "node_id")))
    made = made.when(F.col("kind") == "crossing", naming.highway_node_name(F.lit("a"), optional(vertices, "street_node", "node_id"), F.lit(None)))
    name = F.coalesce(F.col("name"), made) if "name" in vertices.columns else made
    return chosen.select(
        uuid_of(F.lit("node"), "grid_id", "node_id").alias("uuid"), naming.coordinate_name(F.when(F.col("kind") != "substation", name), F.col("lat"), F.col("lon")).alias("id"),
        "grid_id", "node_id", "kind", "lat", "lon",
        F.lit(1.0).alias("v_target"), F.lit(False).alias("slack"), F.lit(float(v_rated_kv)).alias("v_rated_kv"), F.lit(1).alias("subnet"),
    )


def line_geometry() -> F.Column:
    """The straight line between the places a and b, as text."""
    place = lambda k: F.concat_ws(" ", F.col(f"{k}_lon").cast("string"), F.col(f"{k}_lat").cast("string"))
    return F.concat(F.lit("LINESTRING ("), place("a"), F.lit(", "), place("b"), F.lit(")"))


def lines(edges: DataFrame, nodes: DataFrame, line_type: str) -> DataFrame:
    """Lines of edges (grid_id, a_id, b_id, dist_m) between nodes (grid_id, node_id, lat, lon); one line in parallel, length in metres."""
    at = lambda k: nodes.select("grid_id", F.col("node_id").alias(f"{k}_id"), F.col("lat").alias(f"{k}_lat"), F.col("lon").alias(f"{k}_lon"))
    found = edges.join(dealt(at("a")), ["grid_id", "a_id"]).join(dealt(at("b")), ["grid_id", "b_id"])
    number = F.row_number().over(Window.partitionBy("grid_id").orderBy("a_id", "b_id"))
    return found.select(
        uuid_of(F.lit("line"), "grid_id", "a_id", "b_id").alias("uuid"), F.concat_ws("_", "grid_id", number).alias("id"), "grid_id", "a_id", "b_id",
        F.lit(1).alias("parallel"), F.lit(line_type).alias("type"), F.round("dist_m", 6).alias("length_m"), line_geometry().alias("geometry"),
    )


def loads(vertices: DataFrame) -> DataFrame:
    """A load for each vertex (grid_id, node_id, n_buildings, power_kw) with buildings: profile h0, cos phi 1; named by the building, as nodes are."""
    return vertices.where("n_buildings > 0").select(
        uuid_of(F.lit("load"), "grid_id", "node_id").alias("uuid"), naming.load_name(optional(vertices, "building", "node_id")).alias("id"), "grid_id", "node_id", F.lit("h0").alias("profile"),
        F.lit(0.0).alias("e_cons_wh"), F.col("power_kw").alias("s_rated_kva"), F.lit(1.0).alias("cos_phi"),
    )


def prune_grids(vertices: DataFrame) -> DataFrame:
    """Vertices of grids with a load and two nodes or more."""
    kept = vertices.groupBy("grid_id").agg(F.count_if(F.col("n_buildings") > 0).alias("n_loads"), F.count(F.lit(1)).alias("n")).where("n_loads > 0 and n >= 2").select("grid_id")
    return vertices.join(kept, "grid_id", "left_semi")


def substation_elements(substations: DataFrame, mv_kv: float, lv_kv: float, transformer_type: str, mv_subnet: int = 100) -> tuple[DataFrame, DataFrame]:
    """For each substation (grid_id, substation_id, lat, lon) a medium-voltage slack node at its place, and a transformer from it to the substation's node."""
    name = naming.coordinate_name(F.lit(""), F.col("lat"), F.col("lon"))
    mv = substations.select(
        uuid_of(F.lit("mv"), "grid_id", "substation_id").alias("uuid"), naming.mv_node_name(name).alias("id"), "grid_id", F.col("substation_id").alias("node_id"), F.lit("mv").alias("kind"), "lat", "lon",
        F.lit(1.0).alias("v_target"), F.lit(True).alias("slack"), F.lit(float(mv_kv)).alias("v_rated_kv"), F.lit(mv_subnet).alias("subnet"),
    )
    transformers = substations.select(
        uuid_of(F.lit("trafo"), "grid_id", "substation_id").alias("uuid"), naming.transformer_name(naming.mv_node_name(name), name).alias("id"), "grid_id", uuid_of(F.lit("mv"), "grid_id", "substation_id").alias("node_a"),
        uuid_of(F.lit("node"), "grid_id", "substation_id").alias("node_b"), F.lit(1).alias("parallel"), F.lit(transformer_type).alias("type"),
        F.lit(float(mv_kv)).alias("v_a_kv"), F.lit(float(lv_kv)).alias("v_b_kv"), F.lit(0).alias("tap_pos"), F.lit(False).alias("auto_tap"),
    )
    return mv, transformers


def first_transformer_type(types: DataFrame, high_kv: float, low_kv: float) -> str:
    """The id of the first type (file_order, id, v_rated_a, v_rated_b) of these voltages."""
    found = types.where((F.col("v_rated_a") == high_kv) & (F.col("v_rated_b") == low_kv)).orderBy("file_order").select("id").first()
    if found is None:
        raise TypeLookupError(f"no transformer type from {high_kv} to {low_kv} kV")
    return found.id


def first_line_type(types: DataFrame) -> str:
    """The id of the first line type, whatever its voltage."""
    found = types.orderBy("file_order").select("id").first()
    if found is None:
        raise TypeLookupError("no line type")
    return found.id


def line_type_by_voltage(types: DataFrame) -> DataFrame:
    """The first line type of each rated voltage: v_rated, type."""
    return types.groupBy("v_rated").agg(F.min_by("id", "file_order").alias("type"))


def with_line_types(lines_: DataFrame, types: DataFrame) -> DataFrame:
    """Lines with v_kv and the type of their voltage; a voltage without type raises TypeLookupError."""
    found = lines_.join(line_type_by_voltage(types).withColumnRenamed("v_rated", "v_kv"), "v_kv", "left")
    lost = found.where("type is null").select("v_kv").distinct().limit(5).collect()
    if lost:
        raise TypeLookupError(f"no line type for {sorted(r.v_kv for r in lost)} kV")
    return found


def update_transformers(transformers: DataFrame, types: DataFrame, windings: int = 2, strict: bool = True) -> DataFrame:
    """Transformers whose type's voltages (v_rated_a, v_rated_b, v_rated_c) aren't those of their nodes (v_a_kv, ...) take the first type that fits.

    One without such a type raises TypeLookupError, or has a null type where strict is off.
    """
    sides = "abc"[:windings]
    own = types.select(F.col("id").alias("type"), *[F.col(f"v_rated_{s}").alias(f"_own_{s}") for s in sides])
    by_voltage = types.groupBy(*[F.col(f"v_rated_{s}").alias(f"v_{s}_kv") for s in sides]).agg(F.min_by("id", "file_order").alias("_fit"))
    found = transformers.join(own, "type", "left").join(by_voltage, [f"v_{s}_kv" for s in sides], "left")
    right = F.lit(True)
    for s in sides:
        right = right & F.coalesce(F.col(f"_own_{s}") == F.col(f"v_{s}_kv"), F.lit(False))
    out = found.withColumn("type", F.when(right, F.col("type")).otherwise(F.col("_fit"))).select(*transformers.columns)
    if strict:
        lost = out.where("type is null").limit(5).collect()
        if lost:
            raise TypeLookupError(f"no transformer type for the voltages of {[r.uuid for r in lost]}")
    return out


def transformer_nodes(transformers: DataFrame, nodes: DataFrame, kv: list[float]) -> DataFrame:
    """Nodes (uuid, v_rated_kv, ...) at either side of transformers (node_a, node_b and perhaps node_c) with one of these voltages; a node of several transformers comes several times."""
    sides = [c for c in ("node_a", "node_b", "node_c") if c in transformers.columns]
    ends = transformers.select(F.explode(F.array(*sides)).alias("uuid"))
    return ends.join(nodes.where(F.col("v_rated_kv").isin(*kv)), "uuid")


def mv_grid(routes: DataFrame, nodes: DataFrame, types: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and lines of ring cells: routes (cell_id, a_id, b_id, dist_m), nodes (cell_id, node_id, lat, lon, v_rated_kv, is_transition). A cell's number is its subnet; the transition node is the slack."""
    order = indexed(nodes.select("cell_id").distinct(), ["cell_id"], "n").withColumn("n", (F.col("n") + 1).cast("int"))
    placed = nodes.join(order, "cell_id").select("cell_id", "node_id", "lat", "lon", "v_rated_kv", F.col("is_transition").alias("slack"), F.col("n").alias("subnet"))
    at = placed.select("cell_id", F.col("node_id").alias("a_id"), F.col("v_rated_kv").alias("v_kv"), F.col("subnet"))
    number = F.row_number().over(Window.partitionBy("cell_id").orderBy("a_id", "b_id"))
    joined = routes.where("b_id is not null").join(at, ["cell_id", "a_id"]).withColumn("id", F.concat_ws("_", "subnet", number))
    out = with_line_types(joined, types).select("cell_id", "id", "a_id", "b_id", F.round("dist_m", 6).alias("length_m"), "v_kv", "type", F.lit(1).alias("parallel"))
    return placed, out


def dummy_hv_node(centre: DataFrame, hv_kv: float, mv_kv: float, transformer_type: str) -> tuple[DataFrame, DataFrame]:
    """A high-voltage slack node at the place of the central medium-voltage node (grid_id, node_id, lat, lon, subnet), subnet raised by 1000, and two parallel transformers to it.

    Without a node there GridError is raised.
    """
    if centre.isEmpty():
        raise GridError("there is no medium-voltage node to feed")
    name = naming.coordinate_name(F.lit(""), F.col("lat"), F.col("lon"))
    hv = centre.select(
        uuid_of(F.lit("hv"), "node_id").alias("uuid"), name.alias("id"), F.lit("dummyHvGrid").alias("grid_name"), "node_id", "lat", "lon", F.lit(1.0).alias("v_target"), F.lit(True).alias("slack"),
        F.lit(float(hv_kv)).alias("v_rated_kv"), (F.col("subnet") + 1000).alias("subnet"),
    )
    transformer = centre.select(
        uuid_of(F.lit("hvmv"), "node_id").alias("uuid"), naming.transformer_name(name, name).alias("id"), uuid_of(F.lit("hv"), "node_id").alias("node_a"), F.col("node_id").cast("string").alias("node_b"), F.lit(2).alias("parallel"),
        F.lit(transformer_type).alias("type"), F.lit(float(hv_kv)).alias("v_a_kv"), F.lit(float(mv_kv)).alias("v_b_kv"), F.lit(0).alias("tap_pos"), F.lit(True).alias("auto_tap"),
    )
    return hv, transformer


def transition_nodes(mv_nodes: DataFrame, hv_mv_nodes: DataFrame | None, central: DataFrame | None) -> DataFrame:
    """Where rings begin: the medium-voltage nodes of high-voltage grids; else the dummy's; else the first medium-voltage node, as slack."""
    for given in (hv_mv_nodes, central):
        if given is not None and not given.isEmpty():
            return given.select("node_id", "lat", "lon").distinct()
    return mv_nodes.orderBy("node_id").limit(1).select("node_id", "lat", "lon")
