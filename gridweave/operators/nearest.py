"""Nearest-neighbour joins without a cross product.

Things are entered in every grid cell that they cover and in those around it, a point in its own. What a
point finds is nearest for sure if it lies within one cell size; the other points look again with larger
cells, at last with cells that hold the whole earth. So the answer doesn't depend on the cell size, which
should be about the usual distance, and no point is left without one. Where degrees of longitude are
short, things are entered farther to either side. In the plane a point outside the things' box looks from
the box's place nearest to it.

Points and what they meet stay in the partition of their cell until each point has its best, so only
points and things are shuffled, not their pairs. The partitions' number follows the counted pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from gridweave.functions import geo
from gridweave.storage import stored

METRES_PER_DEGREE = 111_319.0


def around(lat: str, lon: str, size: float) -> list[Column]:
    """y and x of the nine cells about a point."""
    return [F.explode(F.transform(F.array(*[F.lit(k) for k in (-1, 0, 1)]), lambda d: geo.cell(c, size) + d)) for c in (lat, lon)]  # noqa: B023


def span(low: Column, high: Column, ends: tuple[int, int] | None) -> Column:
    """The whole numbers from low to high; of these those between two ends, where given, or null for none."""
    if ends is None:
        return F.sequence(low, high)
    low, high = F.greatest(low, F.lit(ends[0])), F.least(high, F.lit(ends[1]))
    return F.when(low <= high, F.sequence(low, high))


def cells_passed(df: DataFrame, e: Column, size: float, about: int = 0, wide: Column | None = None, within: tuple[tuple[int, int], tuple[int, int]] | None = None) -> DataFrame:
    """df by the cells (_y, _x) that a line e (a_lat, a_lon, b_lat, b_lon) passes or just misses: about its length in cells, not its box.

    With ``about``, also by the cells so many rows away, and ``wide`` cells to either side in a row _y; of
    all these only those ``within`` the first and last _y and _x, where given.
    """
    tall, broad = within or (None, None)
    near = size * 1e-3
    low, high = F.least(e["a_lat"], e["b_lat"]), F.greatest(e["a_lat"], e["b_lat"])
    rows = df.withColumn("_y", F.explode(span(geo.cell(low - near, size) - about, geo.cell(high + near, size) + about, tall)))
    level = e["a_lat"] == e["b_lat"]
    south, north = (F.col("_y") - about) * size - near, (F.col("_y") + 1 + about) * size + near
    ends = [geo.lon_at(e, F.least(F.greatest(low, south), high)), geo.lon_at(e, F.greatest(F.least(high, north), low))]
    west = F.when(level, F.least(e["a_lon"], e["b_lon"])).otherwise(F.least(*ends))
    east = F.when(level, F.greatest(e["a_lon"], e["b_lon"])).otherwise(F.greatest(*ends))
    side = F.lit(about) if wide is None else wide
    return rows.withColumn("_x", F.explode(span(geo.cell(west - near, size) - side, geo.cell(east + near, size) + side, broad)))


def line(lats: list[str], lons: list[str]) -> Column:
    return F.struct(*[F.col(c).alias(n) for c, n in zip((lats[0], lons[0], lats[1], lons[1]), ("a_lat", "a_lon", "b_lat", "b_lon"), strict=True)])


#: From a cell of this many degrees on, a point's cell and those around it hold every place.
WHOLE = 360.0


def sizes(size: float) -> list[float]:
    """Cell sizes of the rounds: twice the first, then four times the one before, until all is seen."""
    out = [size]
    while out[-1] < WHOLE:
        out.append(min(WHOLE, out[-1] * (2 if len(out) == 1 else 4)))
    return out


#: Pairs of points and things that a task looks at, unless a single cell has more.
TASK_PAIRS = 150_000
#: Entries of things in cells that a task makes: a shuffle holds what its task writes.
TASK_ENTRIES = 250_000
#: Points that a task places in rings, or counts the votes of.
TASK_POINTS = 100_000
#: Tasks of a round at least.
FEW = 8
#: Cells to either side that a thing is entered in, at most.
WIDEST = 40


def narrow(low: Column, high: Column) -> Column:
    """The least cosine of the latitudes from low to high: what a degree of longitude has of one of latitude; 0 across a pole."""
    quarter = lambda c: F.floor((c - 90.0) / 180.0)
    return F.when(quarter(low) != quarter(high), F.lit(0.0)).otherwise(F.least(F.abs(F.cos(F.radians(low))), F.abs(F.cos(F.radians(high)))))


def nearest(points: DataFrame, key: str, things: DataFrame, thing_lats: list[str], thing_lons: list[str], measured, order: list[str], size: float, by: tuple[str, ...] = (), flat: bool = False) -> DataFrame:
    """For each point (key, lat, lon; key unique) the row of ``things`` with the least dist_m, ties by ``order``, among those with equal ``by`` columns.

    measured: takes the joined rows and adds dist_m (rounded to 1e-3 m or finer) and what else is wanted.
    flat: distances are planar in degrees, in metres of a degree of latitude, not rounded. A point has no
    row only if there is no thing at all with its ``by`` columns.
    """
    points, things = stored(points, "points"), stored(things, "things")
    # where cells reach beyond all things on both sides, only latitudes tell what lies farther
    west, east, south, north, many = things.agg(*[f(g(*c)) for c in (thing_lons, thing_lats) for f, g in ((F.min, F.least), (F.max, F.greatest))], F.count(F.lit(1))).first()
    at_lat, at_lon = F.col("lat"), F.col("lon")
    if flat and many:
        # of a thing, from the box's nearest place: the square is at most that from the point less that of the way to the box
        at_lat, at_lon = F.least(F.greatest("lat", F.lit(south)), F.lit(north)), F.least(F.greatest("lon", F.lit(west)), F.lit(east))
    way = (F.col("lat") - at_lat) * (F.col("lat") - at_lat) + (F.col("lon") - at_lon) * (F.col("lon") - at_lon)
    left, open_, found, cell = points, points.count(), [], ["_y", "_x", *by]
    best = Window.partitionBy(*cell, key).orderBy(F.asc_nulls_last("dist_m"), *order)
    for cell_deg in sizes(size):
        share = F.lit(1.0) if flat else narrow((F.col("_y") - 1) * cell_deg, (F.col("_y") + 2) * cell_deg)
        wide = F.least(F.lit(WIDEST), F.ceil(1 / F.greatest(share, F.lit(1e-3)))).cast("long")
        p = left.withColumn("_y", geo.cell(at_lat, cell_deg)).withColumn("_x", geo.cell(at_lon, cell_deg))

        def entered(df: DataFrame) -> DataFrame:
            t = cells_passed(df, line(thing_lats, thing_lons), cell_deg, 1, wide)  # noqa: B023
            return t.join(p.select("_y", "_x").distinct(), ["_y", "_x"], "left_semi") if found and open_ * many > FEW * TASK_PAIRS else t  # noqa: B023

        t, tasks = entered(things), FEW
        if open_ * many > FEW * TASK_PAIRS:
            # summed in one aggregation: a join would hold both sides sorted in its tasks, whose number doesn't follow the input
            each = p.select(*cell, F.lit(1).alias("_p"), F.lit(0).alias("_t")).unionByName(t.select(*cell, F.lit(0).alias("_p"), F.lit(1).alias("_t")))
            counts = each.groupBy(cell).agg(F.sum("_p").alias("_p"), F.sum("_t").alias("_t"))
            pairs, entries = counts.agg(F.sum(F.col("_p") * F.col("_t")), F.sum("_t")).first()
            tasks += int(pairs or 0) // TASK_PAIRS
            # by place, as entries of the same cells take less room in a shuffle
            t = entered(things.repartitionByRange(int(entries or 0) // TASK_ENTRIES + FEW, thing_lats[0], thing_lons[0]))
        met = p.repartition(tasks, *cell).join(t.repartition(tasks, *cell), cell, "left")
        ranked = measured(met).withColumn("_n", F.row_number().over(best)).where("_n = 1")
        bound, found_m = F.lit(cell_deg * METRES_PER_DEGREE), F.col("dist_m") + 1e-3
        if flat:
            deg = F.col("dist_m") / METRES_PER_DEGREE
            found_m = F.sqrt(F.greatest(deg * deg * (1 + 1e-12) - way, F.lit(0.0))) * METRES_PER_DEGREE + 1e-3
        else:
            # along a circle of latitude: what lies beyond the cells to the side is at least as far as this
            side = F.lit(2 * geo.RADIUS_M * (1 - 1e-9)) * F.asin(F.sin(F.radians(F.least(wide * cell_deg, F.lit(180.0))) / 2) * share)
            beyond = (F.col("_x") - wide <= geo.cell(west, cell_deg)) & (F.col("_x") + wide >= geo.cell(east, cell_deg)) if west is not None else F.lit(False)
            bound = F.when(beyond, bound).otherwise(F.least(bound, side))
        sure = F.lit(True) if cell_deg >= WHOLE else found_m <= bound
        seen = Observation()
        ranked = ranked.withColumn("_sure", F.coalesce(sure & F.col("dist_m").isNotNull(), F.lit(False))).drop("_n", "_y", "_x")
        ranked = stored(ranked.observe(seen, F.count_if(~F.col("_sure")).alias("open")), "ranked")
        found.append(ranked.where("_sure").drop("_sure"))
        left, open_ = ranked.where("not _sure").select(*points.columns), seen.get["open"]
        if not open_ or not many:
            break
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def nearest_section(points: DataFrame, key: str, sections: DataFrame, min_distance_m: float, size: float = 2e-3, by: tuple[str, ...] = ()) -> DataFrame:
    """For each point the nearest section, and where it joins it (lat, lon, kind, t as ``snap_*``)."""

    def measured(df: DataFrame) -> DataFrame:
        snapped = df.withColumn("_s", geo.snap("lat", "lon", "a_lat", "a_lon", "b_lat", "b_lon", min_distance_m))
        named = snapped.withColumns({f"snap_{c}": F.col(f"_s.{c}") for c in ("lat", "lon", "kind", "t")}).drop("_s")
        return named.withColumn("dist_m", F.round(geo.haversine("lat", "lon", "snap_lat", "snap_lon"), 6))

    return nearest(points, key, sections, ["a_lat", "b_lat"], ["a_lon", "b_lon"], measured, ["way_id", "pos"], size, by=by)


def nearest_node(points: DataFrame, key: str, nodes: DataFrame, size: float = 2e-3) -> DataFrame:
    """For each point the nearest node: key, node_id, dist_m, and shared: whether another point has the same node."""
    other = nodes.select("node_id", F.col("lat").alias("n_lat"), F.col("lon").alias("n_lon"))
    measured = lambda df: df.withColumn("dist_m", F.round(geo.haversine("lat", "lon", "n_lat", "n_lon"), 6))
    best = nearest(points.select(key, "lat", "lon"), key, other, ["n_lat", "n_lat"], ["n_lon", "n_lon"], measured, ["node_id"], size)
    return best.select(key, "node_id", "dist_m", (F.count(F.lit(1)).over(Window.partitionBy("node_id")) > 1).alias("shared"))


def inside_any(points: DataFrame, key: str, rings: DataFrame, size: float = 0.02) -> DataFrame:
    """Points (key, lat, lon) that some ring (ring) covers, border included. Without rings there are none."""
    return point_in_rings(points, key, rings.select(F.xxhash64("ring").alias("_ring"), "ring"), "_ring", size).select(key).distinct()


#: Where in a cell its reference point lies; no map's points have such places.
OFF_Y, OFF_X = 0.4871938713, 0.5128061287


def ring_cells(rings: DataFrame, ring_key: str, size: float, within: tuple[tuple[int, int], tuple[int, int]]) -> DataFrame:
    """(ring_key, _r, _y, _x, edges, inside): each cell ``within`` (first and last _y and _x) that a ring's border or interior touches, with the edges that pass it and whether its reference point lies in the ring.

    A cell in the interior has no edges; no row holds a whole ring.
    """
    tall, broad = within
    named = rings.select(ring_key, F.xxhash64("ring").alias("_r"), "ring").dropDuplicates([ring_key, "_r"])  # before the edges part, so that none carries the ring
    own = named.select(ring_key, "_r", F.explode(geo.ring_edges("ring")).alias("e"))
    e = F.col("e")
    border = cells_passed(own, e, size, within=within)
    rows = own.withColumn("_y", F.explode(span(geo.cell(F.least("e.a_lat", "e.b_lat"), size), geo.cell(F.greatest("e.a_lat", "e.b_lat"), size), tall)))

    middle = (F.col("_y") + OFF_Y) * size
    crossed = rows.where((F.col("e.a_lat") > middle) != (F.col("e.b_lat") > middle)).groupBy(ring_key, "_r", "_y").agg(F.array_sort(F.collect_list(geo.lon_at(e, middle))).alias("at"))
    first = lambda k: F.ceil(F.get("at", k) / size - OFF_X)
    spans = F.transform(F.sequence(F.lit(1), F.floor(F.size("at") / 2).cast("int")), lambda k: F.struct(first(2 * k - 2).alias("a"), first(2 * k - 1).alias("b")))
    interior = crossed.where(F.size("at") > 1).select(ring_key, "_r", "_y", F.explode(spans).alias("s")).where("s.a < s.b").select(ring_key, "_r", "_y", F.explode(span(F.col("s.a"), F.col("s.b") - 1, broad)).alias("_x"))
    each = border.select(ring_key, "_r", "_y", "_x", "e", F.lit(0).alias("inside")).unionByName(interior.withColumn("inside", F.lit(1)), allowMissingColumns=True)
    return each.groupBy(ring_key, "_r", "_y", "_x").agg(F.collect_list("e").alias("edges"), F.max("inside").alias("inside"))


def point_in_rings(points: DataFrame, key: str | list[str], rings: DataFrame, ring_key: str, size: float = 0.02) -> DataFrame:
    """All pairs (key, ring_key; key may be several columns) of points and rings that cover them.

    Points meet the cells of rings, which are made where points can be: rings may reach far beyond them.
    From a point to its cell's reference point only edges of that cell can be crossed; an odd number of
    them parts the two.
    """
    keys = [key] if isinstance(key, str) else key
    at = points.select(*keys, "lat", "lon", geo.cell("lat", size).alias("_y"), geo.cell("lon", size).alias("_x"))
    y0, y1, x0, x1, many = at.agg(*[f(c) for c in ("_y", "_x") for f in (F.min, F.max)], F.count(F.lit(1))).first()
    within = ((0, -1), (0, -1)) if y0 is None or x0 is None else ((y0, y1), (x0, x1))
    # as many tasks as the points need: partitions that Spark merges grow with the input
    tasks = many // TASK_POINTS + FEW
    met = at.repartition(tasks, "_y", "_x").join(ring_cells(rings, ring_key, size, within).repartition(tasks, "_y", "_x"), ["_y", "_x"])
    crossed = geo.crossings_between(F.col("edges"), F.col("lat"), F.col("lon"), (F.col("_y") + OFF_Y) * size, (F.col("_x") + OFF_X) * size)
    inside = F.when(F.size("edges") == 0, F.col("inside") == 1).otherwise(((F.col("inside") + crossed) % 2 == 1) | geo.on_edges(F.col("edges"), F.col("lat"), F.col("lon")))
    return met.where(inside).select(*keys, ring_key)
