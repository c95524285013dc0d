"""Street graphs as edge tables.

An edge table has a_id < b_id, unique, and dist_m; a graph has at most one edge between two vertices
and none from a vertex to itself. Of parallel edges the shortest stays.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweave.functions import geo
from gridweave.operators.components import components
from gridweave.operators.nearest import cells_passed, line
from gridweave.storage import dealt, stored


class GraphError(ValueError):
    """A graph that can't be built or searched."""


def sections(way_nodes: DataFrame, nodes: DataFrame, strict: bool = True) -> DataFrame:
    """Consecutive nodes of each way (way_id, pos, node_id) with their places (node_id, lat, lon).

    strict: a node that has no place raises GraphError; else its sections are left out.
    """
    if strict:
        lost = way_nodes.join(dealt(nodes), "node_id", "left_anti").limit(5).collect()
        if lost:
            raise GraphError(f"ways refer to unknown nodes: {sorted({r.node_id for r in lost})}")
    pairs = way_nodes.withColumn("b_id", F.lead("node_id").over(Window.partitionBy("way_id").orderBy("pos"))).where("b_id is not null")
    pairs = pairs.select("way_id", "pos", F.col("node_id").alias("a_id"), "b_id")
    place = lambda k: nodes.select(F.col("node_id").alias(f"{k}_id"), F.col("lat").alias(f"{k}_lat"), F.col("lon").alias(f"{k}_lon"))
    return pairs.join(dealt(place("a")), "a_id").join(dealt(place("b")), "b_id").select("way_id", "pos", "a_id", "b_id", "a_lat", "a_lon", "b_lat", "b_lon")


def section_length() -> Column:
    return geo.haversine("a_lat", "a_lon", "b_lat", "b_lon")


def edges_of(pairs: DataFrame) -> DataFrame:
    """An edge table of pairs (a_id, b_id, dist_m) in any direction and number."""
    ordered = pairs.where("a_id <> b_id").select(F.least("a_id", "b_id").alias("a_id"), F.greatest("a_id", "b_id").alias("b_id"), "dist_m")
    return ordered.groupBy("a_id", "b_id").agg(F.min("dist_m").alias("dist_m"))


def street_graph(way_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges_of(sections(way_nodes, nodes).withColumn("dist_m", section_length()))


def both_directions(edges: DataFrame) -> DataFrame:
    """Each edge from either end; the pair table by which distances are looked up."""
    return edges.select("a_id", "b_id", "dist_m").union(edges.select("b_id", "a_id", "dist_m"))


def other_end(vertex: Column | str) -> Column:
    vertex = F.col(vertex) if isinstance(vertex, str) else vertex
    return F.when(F.col("a_id") == vertex, F.col("b_id")).when(F.col("b_id") == vertex, F.col("a_id"))


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("a_id", "b_id")).alias("node_id"))
    return ends.groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"))


def too_many_connections(edges: DataFrame, most: int = 2) -> bool:
    """Whether a vertex has more than so many edges."""
    return not degrees(edges).where(F.col("degree") > most).isEmpty()


def total_length(edges: DataFrame) -> DataFrame:
    """One row; 0 for a graph without edges."""
    return edges.agg(F.coalesce(F.sum("dist_m"), F.lit(0.0)).alias("total_m"))


def polyline_lengths(way_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Length of each way along its nodes."""
    return sections(way_nodes, nodes).groupBy("way_id").agg(F.sum(section_length()).alias("length_m"))


def neighbours(edges: DataFrame, n: int | None = None) -> DataFrame:
    """Each vertex's neighbours (node_id, neighbour_id, dist_m, rank), nearest first, ties by id; the n nearest where n is given."""
    order = Window.partitionBy("node_id").orderBy("dist_m", "neighbour_id")
    pairs = both_directions(edges).toDF("node_id", "neighbour_id", "dist_m").withColumn("rank", F.row_number().over(order))
    return pairs if n is None else pairs.where(F.col("rank") <= n)


def longest_edges(edges: DataFrame) -> DataFrame:
    """Each vertex's edges by falling length."""
    order = Window.partitionBy("node_id").orderBy(F.desc("dist_m"), "neighbour_id")
    return both_directions(edges).toDF("node_id", "neighbour_id", "dist_m").withColumn("rank", F.row_number().over(order))


def unique_pairs(points: DataFrame, by: str, key: str) -> DataFrame:
    """All unordered pairs within each group ``by``; groups have to be small, as what is returned is their square."""
    left = points.select(by, *[F.col(c).alias(f"a_{c}") for c in points.columns if c != by])
    right = points.select(by, *[F.col(c).alias(f"b_{c}") for c in points.columns if c != by])
    return left.join(right, by).where(F.col(f"a_{key}") < F.col(f"b_{key}"))


def straight_connections(points: DataFrame, by: str) -> DataFrame:
    """Great-circle distances between all pairs of points (by, node_id, lat, lon) of a group."""
    pairs = unique_pairs(points.select(by, "node_id", "lat", "lon"), by, "node_id")
    return pairs.select(by, F.col("a_node_id").alias("a_id"), F.col("b_node_id").alias("b_id"), geo.haversine("a_lat", "a_lon", "b_lat", "b_lon").alias("dist_m"))


def split_sections(sections_: DataFrame, connections: DataFrame) -> DataFrame:
    """The pieces of sections (way_id, pos, a_id, b_id, ends' places) at connection points (way_id, pos, node_id, t, lat, lon).

    Points are chained in the order of t, ties by node_id, so that the pieces of a section follow each
    other from a to b: way_id, pos, a_id, b_id, dist_m.
    """
    ends = sections_.select("way_id", "pos", F.col("a_id").alias("node_id"), F.lit(0.0).alias("t"), F.col("a_lat").alias("lat"), F.col("a_lon").alias("lon"), F.lit(0).alias("rank")).union(
        sections_.select("way_id", "pos", F.col("b_id"), F.lit(1.0), F.col("b_lat"), F.col("b_lon"), F.lit(2))
    )
    inner = connections.select("way_id", "pos", "node_id", "t", "lat", "lon", F.lit(1).alias("rank"))
    order = Window.partitionBy("way_id", "pos").orderBy("rank", "t", "node_id")
    chain = ends.union(inner).select("way_id", "pos", "node_id", "lat", "lon", *[F.lead(c).over(order).alias(f"n_{c}") for c in ("node_id", "lat", "lon")])
    return chain.where("n_node_id is not null").select("way_id", "pos", F.col("node_id").alias("a_id"), F.col("n_node_id").alias("b_id"), geo.haversine("lat", "lon", "n_lat", "n_lon").alias("dist_m"))


def house_connections(connections: DataFrame) -> DataFrame:
    """An edge from each building's centre to its connection point: building_id, a_id (the building's vertex), b_id, dist_m."""
    return connections.select(
        "building_id", F.col("building_vertex").alias("a_id"), F.col("node_id").alias("b_id"), geo.haversine("building_lat", "building_lon", "lat", "lon").alias("dist_m")
    )


def graph_components(edges: DataFrame) -> DataFrame:
    """Vertices with their component, named by its least vertex. Edges keep their lengths."""
    return components(edges.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))).withColumnRenamed("node", "node_id")


def way_components(way_nodes: DataFrame) -> DataFrame:
    """(way_id, component) of ways (way_id, node_id) that share nodes, directly or by others, component being the least of them: what graph_components tells of their sections, from an edge for each further way of a node."""
    at = way_nodes.select("node_id", "way_id").where("node_id is not null")
    least = at.groupBy("node_id").agg(F.min("way_id").alias("least"), F.max("way_id").alias("most")).where("least < most")
    found = components(at.join(dealt(least), "node_id").select(F.col("way_id").alias("a"), F.col("least").alias("b"))).withColumnRenamed("node", "way_id")
    return at.select("way_id").distinct().join(dealt(found), "way_id", "left").withColumn("component", F.coalesce("component", "way_id"))


def prune_components(vertices: DataFrame, connected: DataFrame) -> DataFrame:
    """Vertices (node_id, component) of components that hold a vertex of ``connected`` (node_id). A single component stays in any case."""
    kept = vertices.join(dealt(connected.select("node_id").distinct()), "node_id", "left_semi").select("component").distinct()
    single = vertices.agg((F.countDistinct("component") == 1).alias("single"))
    return vertices.join(F.broadcast(single)).join(kept.withColumn("held", F.lit(True)), "component", "left").where(F.col("held") | F.col("single")).select("node_id", "component")


def keep_set(edges: DataFrame, connections: DataFrame) -> DataFrame:
    """Vertices that contraction leaves: connection nodes, and those with more than two edges."""
    return connections.select("node_id").union(degrees(edges).where("degree > 2").select("node_id")).distinct()


def contract(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """The graph without vertices outside ``keep``, which have two edges at most: chains of them become one edge of their total length.

    Chains that end without a kept vertex, and those that return to the vertex they left, are dropped.
    """
    marked = edges
    for k in ("a", "b"):
        marked = marked.join(dealt(keep.select(F.col("node_id").alias(f"{k}_id"), F.lit(True).alias(f"{k}_kept"))), f"{k}_id", "left")
    marked = stored(marked.withColumns({f"{k}_kept": F.coalesce(f"{k}_kept", F.lit(False)) for k in ("a", "b")}), "marked")
    direct = marked.where("a_kept and b_kept").select("a_id", "b_id", "dist_m")
    inner = marked.where("not a_kept and not b_kept")
    border = marked.where("a_kept <> b_kept").select(
        F.when(F.col("a_kept"), F.col("a_id")).otherwise(F.col("b_id")).alias("kept"), F.when(F.col("a_kept"), F.col("b_id")).otherwise(F.col("a_id")).alias("node_id"), "dist_m"
    )
    chains = graph_components(inner)
    inside = inner.join(dealt(chains), F.col("a_id") == F.col("node_id")).groupBy("component").agg(F.sum("dist_m").alias("inner_m"))
    ends = border.join(dealt(chains), "node_id", "left").withColumn("component", F.coalesce("component", "node_id"))
    joined = ends.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min("kept").alias("a_id"), F.max("kept").alias("b_id"), F.sum("dist_m").alias("ends_m"))
    made = joined.where("n = 2 and a_id <> b_id").join(dealt(inside), "component", "left").select("a_id", "b_id", (F.col("ends_m") + F.coalesce("inner_m", F.lit(0.0))).alias("dist_m"))
    return edges_of(direct.union(made))


def polygon_subgraph(edges: DataFrame, covered: DataFrame) -> DataFrame:
    """Edges with both ends among ``covered`` (node_id); lengths stay."""
    for k in ("a", "b"):
        edges = edges.join(covered.select(F.col("node_id").alias(f"{k}_id")).distinct(), f"{k}_id", "left_semi")
    return edges.select("a_id", "b_id", "dist_m")


def edge_crossings(segments: DataFrame, cell_deg: float = 0.01) -> DataFrame:
    """Pairs (first, second) of segments (edge_id, a_lat, a_lon, b_lat, b_lon) that cross, first < second.

    Segments meet in the cells that they pass; cell_deg should be about a segment's length.
    """
    columns = ["edge_id", "a_lat", "a_lon", "b_lat", "b_lon"]
    placed = cells_passed(segments.select(columns), line(["a_lat", "b_lat"], ["a_lon", "b_lon"]), cell_deg)
    left, right = (placed.select("_y", "_x", *[F.col(c).alias(f"{side}_{c}") for c in columns]) for side in ("l", "r"))
    met = left.join(right, ["_y", "_x"]).where("l_edge_id < r_edge_id")
    point = lambda s, k: [F.col(f"{s}_{k}_lat"), F.col(f"{s}_{k}_lon")]
    crossing = geo.segments_cross(point("l", "a"), point("l", "b"), point("r", "a"), point("r", "b"))
    return met.where(crossing).select(F.col("l_edge_id").alias("first"), F.col("r_edge_id").alias("second")).distinct()


def adjacency(a_ids, b_ids, metres) -> dict[int, list[tuple[int, float]]]:
    near: dict[int, list[tuple[int, float]]] = {}
    for a, b, m in zip(a_ids, b_ids, metres, strict=True):
        near.setdefault(int(a), []).append((int(b), float(m)))
        near.setdefault(int(b), []).append((int(a), float(m)))
    return near


def dijkstra(near: dict[int, list[tuple[int, float]]], source: int) -> dict[int, float]:
    done: dict[int, float] = {}
    heap = [(0.0, source)]
    while heap:
        d, v = heapq.heappop(heap)
        if v not in done:
            done[v] = d
            for w, m in near.get(v, ()):
                if w not in done:
                    heapq.heappush(heap, (d + m, w))
    return done


#: Rounds in which many sources are searched from at once; grids whose paths have more edges are searched source by source.
HOPS = 64
#: Sources times edges that are looked at at once.
AT_ONCE = 1_000_000


def all_at_once(ends: np.ndarray, heads: np.ndarray, metres: np.ndarray, n: int, sources: np.ndarray) -> np.ndarray | None:
    """Path lengths from each source (rows) to each of n vertices, inf where there is no path, by edges ends to heads; None if that takes more than HOPS rounds.

    Lengths are summed from the source on, as in dijkstra, so they are the same to the last bit.
    """
    order = np.argsort(heads, kind="stable")
    ends, metres, (reached, first) = ends[order], metres[order], np.unique(heads[order], return_index=True)
    found = np.full((len(sources), n), np.inf)
    found[np.arange(len(sources)), sources] = 0.0
    some = max(1, AT_ONCE // len(ends))
    for k in range(0, len(sources), some):
        d = found[k : k + some]
        for _ in range(HOPS):
            shorter = np.minimum(d[:, reached], np.minimum.reduceat(d[:, ends] + metres, first, axis=1))
            if (shorter == d[:, reached]).all():
                break
            d[:, reached] = shorter
        else:
            return None
    return found


#: Sources that a task searches from.
SOURCES = 256


def shortest_paths(edges: DataFrame, sources: DataFrame, share: int = SOURCES) -> DataFrame:
    """Shortest path lengths (grid_id, a_id, b_id, dist_m) from each source (grid_id, node_id) to all vertices of its grid (grid_id, a_id, b_id, dist_m).

    A task searches from a share of a grid's sources and holds that grid's edges. A vertex that can't be
    reached raises GraphError. What is returned is a row for each source and vertex.
    """
    shares = sources.groupBy("grid_id").agg(F.ceil(F.count(F.lit(1)) / share).cast("int").alias("_shares"))
    own = sources.select("grid_id", "node_id").distinct().join(shares, "grid_id")
    asked = own.select("grid_id", F.pmod(F.xxhash64("node_id"), F.col("_shares")).cast("int").alias("share"), F.col("node_id").alias("a_id"), F.lit(None).cast("long").alias("b_id"), F.lit(None).cast("double").alias("dist_m"))
    spread = edges.join(shares, "grid_id").select("grid_id", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1)).alias("share"), "a_id", "b_id", "dist_m")

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf.b_id.isna().to_numpy()
        own, wanted = pdf[~asks], np.unique(pdf.a_id.to_numpy("int64")[asks])
        a, b, m = own.a_id.to_numpy("int64"), own.b_id.to_numpy("int64"), own.dist_m.to_numpy("float64")
        ids = np.unique(np.concatenate([a, b]))
        # a source without edges has no path to anything
        if not len(ids) or not len(wanted):
            return pd.DataFrame(columns=["grid_id", "a_id", "b_id", "dist_m"])
        unknown = wanted[~np.isin(wanted, ids)]
        if len(unknown):
            raise GraphError(f"no path from {unknown[0]} to {ids[0]}")
        (i, j), at = np.searchsorted(ids, [a, b]), np.searchsorted(ids, wanted)
        d = all_at_once(np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([m, m]), len(ids), at)
        if d is None:
            near, d = adjacency(i, j, m), np.full((len(wanted), len(ids)), np.inf)
            for k, source in enumerate(at.tolist()):
                found = dijkstra(near, source)
                d[k, list(found)] = list(found.values())
        lost = np.argwhere(np.isinf(d))
        if len(lost):
            raise GraphError(f"no path from {wanted[lost[0][0]]} to {ids[lost[0][1]]}")
        other = at[:, None] != np.arange(len(ids))
        return pd.DataFrame({"grid_id": int(pdf.grid_id.iloc[0]), "a_id": np.repeat(wanted, len(ids) - 1), "b_id": np.broadcast_to(ids, d.shape)[other], "dist_m": d[other]})

    return spread.union(asked).groupBy("grid_id", "share").applyInPandas(search, "grid_id long, a_id long, b_id long, dist_m double")


def bypass(edges: DataFrame, common: int) -> DataFrame:
    """The graph in which a vertex with two edges is left out and its neighbours are joined by their sum; others are returned as they were."""
    at = (F.col("a_id") == common) | (F.col("b_id") == common)
    mine = edges.where(at).agg(F.count(F.lit(1)).alias("n"), F.min(other_end(F.lit(common))).alias("a_id"), F.max(other_end(F.lit(common))).alias("b_id"), F.sum("dist_m").alias("dist_m"))
    made = mine.where("n = 2").select("a_id", "b_id", "dist_m")
    counted = F.broadcast(mine.select("n"))
    return edges_of(edges.join(counted).where(~at | (F.col("n") != 2)).select("a_id", "b_id", "dist_m").union(made))
