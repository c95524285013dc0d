"""Medium-voltage areas and their rings."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.functions import geo
from gridweave.operators.nearest import FEW, METRES_PER_DEGREE, around, nearest
from gridweave.storage import stored

NEIGHBOURS = 5


class RouteError(ValueError):
    """Nodes that no ring joins."""


def distances(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Great-circle distances between all points."""
    a, o = np.radians(lat), np.radians(lon)
    h = np.sin((a[:, None] - a) / 2) ** 2 + np.cos(a)[:, None] * np.cos(a) * np.sin((o[:, None] - o) / 2) ** 2
    return 2 * geo.RADIUS_M * np.arcsin(np.sqrt(h))


def cross(p, q, r, s) -> bool:
    """As geo.segments_cross, of points (lat, lon)."""
    turn = lambda a, b, c: (b[1] - a[1]) * (c[0] - a[0]) - (b[0] - a[0]) * (c[1] - a[1])
    between = lambda x, a, b: min(a[0], b[0]) <= x[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= x[1] <= max(a[1], b[1])
    t = [turn(p, q, r), turn(p, q, s), turn(r, s, p), turn(r, s, q)]
    if np.sign(t[0]) * np.sign(t[1]) < 0 and np.sign(t[2]) * np.sign(t[3]) < 0:
        return True
    return sum(x == 0 and between(*w) for x, w in zip(t, ((r, p, q), (s, p, q), (p, r, s), (q, r, s)), strict=True)) > 2


class Ring:
    """A closed tour grown by the cheapest insertion that neither crosses nor branches. Node 0 is the transition point.

    In each round the nodes not yet joined are tried in the order of their distance from the one joined
    last, at each edge of their nearest nodes; ties go to the first tried, edges by their ends.
    """

    def __init__(self, places: list[tuple[float, float]], neighbours: int = NEIGHBOURS):
        self.places, self.neighbours = places, neighbours
        self.d = distances(*np.array(places).T) if places else np.zeros((0, 0))
        self.edges: set[tuple[int, int]] = set()

    def near(self, i: int, n: int | None = None) -> list[int]:
        return [j for j in np.argsort(self.d[i], kind="stable").tolist() if j != i][:n]

    def detour(self, a: int, n: int, b: int) -> float:
        return float(self.d[a, n] + self.d[n, b] - self.d[a, b])

    def clear(self, edges: set[tuple[int, int]], fresh: list[tuple[int, int]]) -> bool:
        p = self.places
        return not any(e != f and cross(p[e[0]], p[e[1]], p[f[0]], p[f[1]]) for f in fresh for e in edges)

    def solve(self) -> tuple[set[tuple[int, int]], list[int]]:
        """Edges, and the nodes that could not be joined."""
        n = len(self.places)
        if n == 2:
            self.edges = {(0, 1)}
        if n < 3:
            return self.edges, []
        a, b = self.near(0, 2)
        self.edges = {(0, a), (0, b), (min(a, b), max(a, b))}
        current, open_ = a, [i for i in range(n) if i not in (0, a, b)]
        while open_:
            best = None
            for node in (j for j in self.near(current) if j in open_):
                about = set(self.near(node, self.neighbours))
                for e in sorted(e for e in self.edges if about & set(e)):
                    cost = self.detour(e[0], node, e[1])
                    if best is not None and cost >= best[0]:
                        continue
                    fresh = [(min(x, node), max(x, node)) for x in e]
                    if self.clear(self.edges - {e}, fresh):
                        best = (cost, node, e, fresh)
            if best is None:
                break
            _, current, e, fresh = best
            self.edges = self.edges - {e} | set(fresh)
            open_.remove(current)
        return self.edges, open_


#: Nodes that one task makes a ring of. A cell of more is made of such rings, which are then joined.
RING_NODES = 1000
#: Nodes that a task makes rings of, more where a ring has more.
TASK_NODES = 1000
#: Edges of either side that a junction is looked for among, at first.
JUNCTION_EDGES = 200


def halves(points: DataFrame, most: int) -> tuple[DataFrame, list[DataFrame]]:
    """points with their part, and the lines that part them: (cell_id, part, level, at, width), a table for each round.

    Parts of more than ``most`` nodes are halved at the median of their longer side. Each has a rectangle
    of its own, so that no straight line between nodes of one crosses one of another. The halves of part p
    are 2 p and 2 p + 1; nodes at one and the same place stay together.
    """
    parts, lines = points.withColumn("part", F.lit(1).cast("long")), []
    while True:
        box = [f(c).alias(f"{n}_{c}") for c in ("lat", "lon") for n, f in (("min", F.min), ("max", F.max), ("mid", lambda c: F.percentile_approx(c, 0.5)))]
        sizes = parts.groupBy("cell_id", "part").agg(F.count(F.lit(1)).alias("n"), *box).where(F.col("n") > most)
        tall, wide = F.col("max_lat") - F.col("min_lat"), F.col("max_lon") - F.col("min_lon")
        upright = tall >= wide
        side = lambda name: F.when(upright, F.col(f"{name}_lat")).otherwise(F.col(f"{name}_lon"))  # noqa: B023, E731
        at = F.when(side("mid") < side("max"), side("mid")).otherwise((side("min") + side("max")) / 2)
        width = F.greatest(4 * F.sqrt(tall * wide / F.col("n")), 8 * F.greatest(tall, wide) / F.col("n"))
        lines.append(stored(sizes.where(side("min") < side("max")).select("cell_id", "part", upright.alias("upright"), at.alias("at"), width.alias("width")), "lines"))
        if lines[-1].isEmpty():
            return parts, lines[:-1]
        where = F.when(F.col("upright"), F.col("lat")).otherwise(F.col("lon"))
        moved = parts.join(lines[-1].drop("width"), ["cell_id", "part"], "left").withColumn("part", F.when(F.col("at").isNull(), F.col("part")).otherwise(F.col("part") * 2 + (where > F.col("at")).cast("long")))
        parts = stored(moved.drop("upright", "at"), "parts")


def crossing(p: np.ndarray, q: np.ndarray, r: np.ndarray, s: np.ndarray) -> np.ndarray:
    """As ``cross``, of one segment p-q and many r-s."""
    turn = lambda a, b, c: (b[..., 1] - a[..., 1]) * (c[..., 0] - a[..., 0]) - (b[..., 0] - a[..., 0]) * (c[..., 1] - a[..., 1])
    between = lambda x, a, b: ((np.minimum(a, b) <= x) & (x <= np.maximum(a, b))).all(-1)
    sides = [turn(p, q, r), turn(p, q, s), turn(r, s, p), turn(r, s, q)]
    proper = (np.sign(sides[0]) * np.sign(sides[1]) < 0) & (np.sign(sides[2]) * np.sign(sides[3]) < 0)
    touching = sum(((x == 0) & between(*w)).astype(int) for x, w in zip(sides, ((r, p, q), (s, p, q), (p, r, s), (q, r, s)), strict=True))
    return proper | (touching > 2)


#: An edge of a ring: its ends and their places. Both ends are one node where a ring has no other; twice: a ring of two nodes goes along it twice.
EDGE = "part long, a_id long, b_id long, a_lat double, a_lon double, b_lat double, b_lon double, twice boolean"
FIELDS = [c.split()[0] for c in EDGE.split(", ")]


def junction(pdf: pd.DataFrame) -> pd.DataFrame:
    """What joins two rings on either side of a line into one: an edge of each goes, two between them come.

    Of the edges nearest to the line, those whose exchange adds least and crosses nothing; none if there are
    no such. done tells what goes (false) and what comes.
    """
    pdf = pdf.sort_values(["part", "a_id", "b_id"], ignore_index=True)
    upright, at, tries = bool(pdf.upright.iloc[0]), float(pdf["at"].iloc[0]), int(pdf.tries.iloc[0])
    a, b = pdf[["a_lat", "a_lon"]].to_numpy(), pdf[["b_lat", "b_lon"]].to_numpy()
    far = np.minimum(abs(a[:, 1 - upright] - at), abs(b[:, 1 - upright] - at))
    left = pdf.part.to_numpy() % 2 == 0
    near = lambda own: np.flatnonzero(own)[np.argsort(far[own], kind="stable")[: JUNCTION_EDGES << tries]]
    one, two = near(left), near(~left)
    scale = np.array([1.0, np.cos(np.radians(a[:, 0].mean()))])
    length = lambda x, y: np.sqrt((((x - y) * scale) ** 2).sum(-1))
    gone = length(a[one], b[one])[:, None] + length(a[two], b[two])
    way = lambda x, y: length(x[one][:, None], y[two][None])
    cost = np.stack([way(a, a) + way(b, b), way(a, b) + way(b, a)]) - gone
    order, ids = np.argsort(cost.ravel(), kind="stable"), pdf[["a_id", "b_id"]].to_numpy()
    out = pd.DataFrame(columns=["cell_id", "done", *FIELDS])
    for k in order.tolist():
        turned, i, j = np.unravel_index(k, cost.shape)
        i, j = int(one[i]), int(two[j])
        c, d = (b, a) if turned else (a, b)
        stays = np.ones(len(pdf), bool)
        stays[[i, j]] = pdf.twice.to_numpy()[[i, j]]
        dots = bool((ids[[i, j], 0] == ids[[i, j], 1]).all())  # two nodes become a ring of two
        if crossing(a[i], c[j], a[stays], b[stays]).any() or crossing(b[i], d[j], a[stays], b[stays]).any() or not dots and bool(crossing(a[i], c[j], b[i][None], d[j][None])[0]):
            continue
        cell, up = int(pdf.cell_id.iloc[0]), int(pdf.part.iloc[0]) // 2
        ends = (ids[j][::-1] if turned else ids[j]).tolist()
        rows = [(cell, False, int(pdf.part[k]), *ids[k].tolist(), *a[k], *b[k], bool(pdf.twice[k])) for k in (i, j)]
        rows += [(cell, True, up, *ids[k].tolist(), *a[k], *b[k], False) for k in (i, j) if pdf.twice[k] and ids[k][0] != ids[k][1]]
        rows.append((cell, True, up, int(ids[i][0]), ends[0], *a[i], *c[j], dots))
        rows += [] if dots else [(cell, True, up, int(ids[i][1]), ends[1], *b[i], *d[j], False)]
        return pd.DataFrame(rows, columns=out.columns)
    return out


def join_rings(edges: DataFrame, lines: DataFrame, begin: DataFrame) -> tuple[DataFrame, DataFrame]:
    """edges (cell_id, EDGE), with the rings on either side of each line (cell_id, part, upright, at, width) made one, part's; and (cell_id, node_id, lat, lon) that nothing joins.

    A task holds the edges in a band about a line, and of no more is a junction looked for; the band is
    widened where none is found, at last to all edges of both rings. Where every junction crosses an edge,
    the ring without the cell's transition point (begin: cell_id, leaf, the part that holds it) goes.
    """
    open_, spread, tries = lines, 1.0, 0
    while True:
        own = edges.withColumn("_up", F.floor(F.col("part") / 2)).join(open_.withColumnRenamed("part", "_up"), ["cell_id", "_up"])
        low, high = (f(F.when(F.col("upright"), F.col("a_lat")).otherwise(F.col("a_lon")), F.when(F.col("upright"), F.col("b_lat")).otherwise(F.col("b_lon"))) for f in (F.least, F.greatest))
        near = own.where((high >= F.col("at") - F.col("width") * spread) & (low <= F.col("at") + F.col("width") * spread)).withColumn("tries", F.lit(tries))
        both = near.groupBy("cell_id", "_up").agg(F.countDistinct("part").alias("_n")).where("_n = 2").drop("_n")
        found = stored(near.join(both, ["cell_id", "_up"], "left_semi").groupBy("cell_id", "_up").applyInPandas(junction, f"cell_id long, done boolean, {EDGE}"), "junctions")
        gone = found.where("not done").select("cell_id", "a_id", "b_id", "part")
        joined = stored(found.where("done").select("cell_id", F.col("part").alias("_up")).distinct(), "joined")
        kept = edges.join(gone, ["cell_id", "part", "a_id", "b_id"], "left_anti").withColumn("_up", F.floor(F.col("part") / 2)).join(joined.withColumn("_in", F.lit(True)), ["cell_id", "_up"], "left")
        kept = kept.withColumn("part", F.when(F.col("_in"), F.col("_up")).otherwise(F.col("part"))).select("cell_id", *FIELDS)
        edges = stored(kept.unionByName(found.where("done").drop("done")), "rings")
        open_ = stored(open_.join(joined.withColumnRenamed("_up", "part"), ["cell_id", "part"], "left_anti"), "lines")
        if open_.isEmpty():
            return edges, edges.where("false").select("cell_id", F.col("a_id").alias("node_id"))
        if spread > 1e9:
            break
        spread, tries = spread * (4 if tries < 6 else 1e9), tries + 1
    second = F.col("part") * 2 + 1
    lost = open_.join(begin, "cell_id").select("cell_id", F.when(F.startswith(F.bin("leaf"), F.bin(second)), second - 1).otherwise(second).alias("part"))
    at = edges.join(lost, ["cell_id", "part"], "left_semi")
    held = edges.join(lost, ["cell_id", "part"], "left_anti").withColumn("_up", F.floor(F.col("part") / 2)).join(open_.select("cell_id", F.col("part").alias("_up"), F.lit(True).alias("_in")), ["cell_id", "_up"], "left")
    held = held.withColumn("part", F.when(F.col("_in"), F.col("_up")).otherwise(F.col("part"))).select("cell_id", *FIELDS)
    return held, at.select("cell_id", F.explode(F.array("a_id", "b_id")).alias("node_id")).distinct()


def ring_routes(points: DataFrame, most: int = RING_NODES) -> DataFrame:
    """The ring of each cell: points (cell_id, node_id, lat, lon, is_transition) to edges (cell_id, a_id, b_id, dist_m, joined).

    A cell has one transition point; with none the least node_id is it, of several the least. A cell of
    one node has no edge, of two one edge. Nodes that can't be joined without a crossing come as rows
    without b_id. In a cell of more than ``most`` nodes the rings of its parts are joined, so no task holds
    a cell; its ring crosses itself as little as another.
    """

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["is_transition", "node_id"], ascending=[False, True])
        ids, places = [int(x) for x in pdf.node_id], list(zip(pdf.lat, pdf.lon, strict=True))
        edges, open_ = Ring(places).solve()
        alone = {0} if len(ids) == 1 else set()
        ends = sorted((*sorted((a, b), key=ids.__getitem__), True) for a, b in edges) + [(i, i, True) for i in alone] + [(i, i, False) for i in open_]
        rows = [(int(pdf.cell_id.iloc[0]), int(pdf.part.iloc[0]), ids[a], ids[b] if joined else None, *places[a], *places[b], len(ids) == 2) for a, b, joined in ends]
        return pd.DataFrame(rows, columns=["cell_id", *FIELDS]).astype({"b_id": "Int64"})

    own = points.select("cell_id", "node_id", "lat", "lon", F.coalesce("is_transition", F.lit(False)).alias("is_transition"))
    parts, lines = halves(own, most)
    first = own.groupBy("cell_id").agg(F.min_by("node_id", F.struct(~F.col("is_transition"), "node_id")).alias("_first"))
    begun = parts.join(first, "cell_id").withColumn("is_transition", F.col("node_id") == F.col("_first")).drop("_first")
    # few bytes are much work here, so the number of tasks follows the nodes
    begun = begun.repartition(int(own.count()) // TASK_NODES + FEW, "cell_id", "part")
    rings = stored(begun.groupBy("cell_id", "part").applyInPandas(solve, f"cell_id long, {EDGE}"), "rings")
    edges, left = rings.where("b_id is not null"), rings.where("b_id is null").select("cell_id", F.col("a_id").alias("node_id"))
    for level in reversed(lines):
        edges, lost = join_rings(edges, level, begun.where("is_transition").select("cell_id", F.col("part").alias("leaf")))
        left = left.unionByName(lost)
    if lines:
        left = left.unionByName(edges.where("a_id = b_id").join(lines[0].select("cell_id"), "cell_id", "left_semi").select("cell_id", F.col("a_id").alias("node_id")))
    made = edges.where("a_id <> b_id").select("cell_id", F.least("a_id", "b_id").alias("a_id"), F.greatest("a_id", "b_id").alias("b_id"), geo.haversine("a_lat", "a_lon", "b_lat", "b_lon").alias("dist_m"), F.lit(True).alias("joined"))
    return made.unionByName(left.select("cell_id", F.col("node_id").alias("a_id"), F.lit(None).cast("long").alias("b_id"), F.lit(None).cast("double").alias("dist_m"), F.lit(False).alias("joined")))


def hull(places: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Convex hull by monotone chains, counter-clockwise in (lon, lat), without its first point again."""
    points = sorted({(o, a) for a, o in places})
    if len(points) < 3:
        return [(a, o) for o, a in points]
    turn = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    chain: list[tuple[float, float]] = []
    for row in (points, points[::-1]):
        base = len(chain)
        for p in row:
            while len(chain) - base > 1 and turn(chain[-2], chain[-1], p) <= 0:
                chain.pop()
            chain.append(p)
        chain.pop()
    return [(a, o) for o, a in chain]


def centroid(corners: list[tuple[float, float]]) -> tuple[float, float]:
    """Area centroid of a polygon, or the mean of its corners where it has no area."""
    x, y = np.array([o for _, o in corners]), np.array([a for a, _ in corners])
    x0, y0 = x - x[0], y - y[0]
    c = x0 * np.roll(y0, -1) - np.roll(x0, -1) * y0
    if abs(c.sum()) < 1e-18:
        return float(y.mean()), float(x.mean())
    return float(y[0] + ((y0 + np.roll(y0, -1)) * c).sum() / (3 * c.sum())), float(x[0] + ((x0 + np.roll(x0, -1)) * c).sum() / (3 * c.sum()))


def hull_centroids(points: DataFrame) -> DataFrame:
    """Centroid of the convex hull of each group (grid_id, lat, lon). Each task first thins its points to their own hull, so a group's points needn't meet."""
    schema = "grid_id long, lat double, lon double"

    def corners(pdfs):
        for pdf in pdfs:
            for grid, own in pdf.groupby("grid_id"):
                yield pd.DataFrame([(grid, a, o) for a, o in hull(list(zip(own.lat, own.lon, strict=True)))], columns=["grid_id", "lat", "lon"])

    def centre(pdf: pd.DataFrame) -> pd.DataFrame:
        a, o = centroid(hull(list(zip(pdf.lat, pdf.lon, strict=True))))
        return pd.DataFrame({"grid_id": [int(pdf.grid_id.iloc[0])], "lat": [a], "lon": [o]})

    return points.select("grid_id", "lat", "lon").mapInPandas(corners, schema).groupBy("grid_id").applyInPandas(centre, schema)


def central_node(nodes: DataFrame) -> DataFrame:
    """Of each grid (grid_id, node_id, lat, lon) the node nearest to the centroid of its hull; of fewer than three the least node_id."""
    size = nodes.groupBy("grid_id").agg(F.count(F.lit(1)).alias("n"))
    centre = hull_centroids(nodes).withColumnsRenamed({"lat": "c_lat", "lon": "c_lon"})
    d = F.when(F.col("n") < 3, F.lit(0.0)).otherwise(F.round(geo.haversine("lat", "lon", "c_lat", "c_lon"), 6))
    found = nodes.join(size, "grid_id").join(centre, "grid_id").withColumn("dist_m", d)
    best = F.min(F.struct("dist_m", "node_id", "lat", "lon")).alias("best")  # summed before it is shuffled, as a grid may be the whole map
    return found.groupBy("grid_id").agg(best).select("grid_id", "best.node_id", "best.lat", "best.lon")


def voronoi_assign(nodes: DataFrame, sites: DataFrame, size: float = 0.05) -> DataFrame:
    """The cell of each node (node_id, lat, lon): that of the nearest site (site_id, lat, lon), planar in degrees, ties to the least site_id."""
    other = sites.select("site_id", F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"))
    square = (F.col("lat") - F.col("s_lat")) * (F.col("lat") - F.col("s_lat")) + (F.col("lon") - F.col("s_lon")) * (F.col("lon") - F.col("s_lon"))
    measured = lambda df: df.withColumn("deg", F.sqrt(square)).withColumn("dist_m", F.col("deg") * METRES_PER_DEGREE)
    best = nearest(nodes.select("node_id", "lat", "lon"), "node_id", other, ["s_lat", "s_lat"], ["s_lon", "s_lon"], measured, ["site_id"], size, flat=True)
    return best.select("node_id", F.col("site_id").alias("cell_id"))


def clipped(cell: list[tuple[float, float]], site: tuple[float, float], other: tuple[float, float]) -> list[tuple[float, float]]:
    """The part of a convex polygon that is nearer to a site than to another."""
    (a, o), (a2, o2) = site, other
    side = lambda p: (p[0] - (a + a2) / 2) * (a2 - a) + (p[1] - (o + o2) / 2) * (o2 - o)
    cut = []
    for p, q in zip(cell, cell[1:] + cell[:1], strict=True):
        s, t = side(p), side(q)
        if s <= 0:
            cut.append(p)
        if s * t < 0:
            u = s / (s - t)
            cut.append((p[0] + u * (q[0] - p[0]), p[1] + u * (q[1] - p[1])))
    return cut


RING_OF_CELL = "site_id long, lat double, lon double, cell array<struct<lat:double,lon:double>>"


def clip(pdfs):
    """The cells of sites without what is nearer to others."""
    for pdf in pdfs:
        cells = []
        for a, o, cell, others in zip(pdf.lat, pdf.lon, pdf.cell, pdf.others, strict=True):
            own = [(p["lat"], p["lon"]) for p in cell]
            for other in sorted({(x["lat"], x["lon"]) for x in others}, key=lambda x: ((x[0] - a) ** 2 + (x[1] - o) ** 2, x)):
                if other != (a, o):
                    own = clipped(own, (a, o), other)
            cells.append([{"lat": float(x), "lon": float(y)} for x, y in own])
        yield pdf.assign(cell=cells)[["site_id", "lat", "lon", "cell"]]


def voronoi_polygons(sites: DataFrame, margin: float = 1.0) -> DataFrame:
    """(site_id, ring): the cell of each site (site_id, lat, lon) as a closed ring, within the sites' box widened by ``margin`` times its greater side.

    Cells are cut by the sites in the grid cells about theirs, then by the sites that are nearest to their
    corners, until each corner is as near to its own site as to any: then the cell is exact, as it is
    convex. No task holds more than the neighbours of some sites. Sites at one place have the same ring; a
    single site has none, as its cell has no border.
    """
    sites = stored(sites.select("site_id", "lat", "lon"), "sites")
    box = sites.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{c}{k}") for c in ("lat", "lon") for k, f in enumerate((F.min, F.max))]).first()
    if box.n < 2:
        return sites.where("false").select("site_id", F.lit(None).cast("array<struct<lat:double,lon:double>>").alias("ring"))
    tall, wide = box.lat1 - box.lat0, box.lon1 - box.lon0
    m = margin * max(tall, wide, 1e-9)
    corner = lambda a, o: F.struct(F.lit(a).alias("lat"), F.lit(o).alias("lon"))
    whole = F.array(corner(box.lat0 - m, box.lon0 - m), corner(box.lat0 - m, box.lon1 + m), corner(box.lat1 + m, box.lon1 + m), corner(box.lat1 + m, box.lon0 - m))
    size = max((tall * wide / box.n) ** 0.5 * 2, max(tall, wide) / box.n * 2, 1e-9)  # some four sites a cell, on a line two
    at = sites.select(F.struct("lat", "lon").alias("other"), geo.cell("lat", size).alias("_y"), geo.cell("lon", size).alias("_x"))
    y, x = around("lat", "lon", size)
    near = sites.withColumn("_y", y).withColumn("_x", x).join(at, ["_y", "_x"], "left").groupBy("site_id", "lat", "lon").agg(F.collect_list("other").alias("others"))
    open_ = stored(near.withColumn("cell", whole).select("site_id", "lat", "lon", "cell", "others").mapInPandas(clip, RING_OF_CELL), "cells")
    done = []
    while True:
        corners = open_.select("site_id", F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"), F.posexplode("cell").alias("k", "p"))
        # corners are named by hashes of their places, as cells share them
        places = corners.select(F.xxhash64("p.lat", "p.lon").alias("node_id"), F.col("p.lat").alias("lat"), F.col("p.lon").alias("lon")).dropDuplicates(["node_id"])
        owner = voronoi_assign(places, sites, size).join(sites.select(F.col("site_id").alias("cell_id"), F.col("lat").alias("o_lat"), F.col("lon").alias("o_lon")), "cell_id")
        met = corners.withColumn("node_id", F.xxhash64("p.lat", "p.lon")).join(owner, "node_id")
        # a corner is as near to some other sites as to its own: only what is nearer for sure cuts, that is where
        # the corner is beyond the line between both by a part of its distance, however far it is
        farther = reduce(lambda a, b: a + b, [(F.col(f"s_{c}") - F.col(f"o_{c}")) * (2 * F.col(f"p.{c}") - F.col(f"s_{c}") - F.col(f"o_{c}")) for c in ("lat", "lon")])
        away = lambda p, k: F.hypot(F.col(f"{p}lat") - F.col(f"{k}_lat"), F.col(f"{p}lon") - F.col(f"{k}_lon"))
        nearer = met.where(-farther > away("s_", "o") * away("p.", "s") * 1e-9).groupBy("site_id").agg(F.collect_set(F.struct(F.col("o_lat").alias("lat"), F.col("o_lon").alias("lon"))).alias("others"))
        rest = stored(open_.join(nearer, "site_id", "left"), "cells")
        done.append(rest.where("others is null"))
        again = rest.where("others is not null")
        if again.isEmpty():
            break
        open_ = stored(again.select("site_id", "lat", "lon", "cell", "others").mapInPandas(clip, RING_OF_CELL), "cells")
    found = reduce(DataFrame.unionByName, [d.select("site_id", "cell") for d in done])
    return found.select("site_id", F.concat("cell", F.array(F.get("cell", F.lit(0)))).alias("ring"))
