"""Boundary polygons and the division of a map into areas."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridweave.operators.nearest import FEW, TASK_POINTS, point_in_rings
from gridweave.storage import shared_dir

#: The administrative levels of a boundary.
ADMIN_LEVELS = [2, 4, 5, 6, 7, 8, 9, 10, 11, 12]
RING = "array<struct<lat:double,lon:double>>"
#: How a role's entities go to areas: the one with most votes, or all that cover a part.
ALLOCATION = {"building": "max", "substation": "max", "boundary": "max", "highway": "all", "landuse": "all"}


class RingError(ValueError):
    """Ways that don't form rings."""


def next_level(level: int) -> int | None:
    """The next lower administrative level, which has the next greater number."""
    return next((n for n in ADMIN_LEVELS if n > level), None)


def joined(sequence: list[int], way: list[int]) -> list[int]:
    """A node sequence continued by a way, either of them turned where that makes their ends meet. After a closed sequence the way begins anew."""
    if not sequence or not way:
        return sequence or way
    if sequence[0] == sequence[-1] and len(sequence) > 1:
        return sequence + way
    if sequence[-1] == way[0]:
        return sequence + way[1:]
    if sequence[-1] == way[-1]:
        return sequence + way[-2::-1]
    if sequence[0] == way[0]:
        return sequence[::-1] + way[1:]
    if sequence[0] == way[-1]:
        return sequence[::-1] + way[-2::-1]
    raise RingError(f"a way from {way[0]} to {way[-1]} doesn't continue one from {sequence[0]} to {sequence[-1]}")


def cut_rings(sequence: list[int]) -> list[list[int]]:
    """The sequence cut wherever a node comes again: from its last place to this one. Without such a node the whole sequence is closed with its first."""
    rings, last = [], {}
    for i, node in enumerate(sequence):
        if node in last:
            rings.append(sequence[last[node] : i + 1])
        last[node] = i
    return rings or ([[*sequence, sequence[0]]] if sequence else [])


def assemble_rings(members: DataFrame, strict: bool = True) -> DataFrame:
    """Rings of relations: (rel_id, member_pos, pos, node_id, lat, lon) of their ways' nodes to (rel_id, ring_no, ring, problem).

    Nodes without place are left out. Where ways don't meet or a ring has fewer than four points, strict
    raises RingError with the relation's id; else what can't be used is left out, and a row without ring tells the problem.
    """

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        rel, problem = int(pdf.rel_id.iloc[0]), None
        place = {int(n): (a, o) for n, a, o in pdf[["node_id", "lat", "lon"]].itertuples(index=False) if not pd.isna(a)}
        sequence: list[int] = []
        for _, way in pdf.sort_values(["member_pos", "pos"]).groupby("member_pos", sort=True):
            nodes = [int(n) for n in way.node_id if int(n) in place]
            try:
                sequence = joined(sequence, nodes)
            except RingError as e:
                problem = problem or f"relation {rel}: {e}"
        rings = [r for r in cut_rings(sequence) if len(r) > 3]
        if sequence and not rings:
            problem = problem or f"relation {rel} has no closed ring"
        if strict and problem:
            raise RingError(problem)
        rows = [(rel, i, [{"lat": place[n][0], "lon": place[n][1]} for n in r], None) for i, r in enumerate(rings)]
        return pd.DataFrame(rows + [(rel, None, None, problem)] * (problem is not None), columns=["rel_id", "ring_no", "ring", "problem"]).astype({"ring_no": "Int32"})

    return members.groupBy("rel_id").applyInPandas(build, f"rel_id long, ring_no int, ring {RING}, problem string")


def boundary_rings(relations: DataFrame, ways: DataFrame, nodes: DataFrame, level: int, strict: bool = True) -> DataFrame:
    """(area_id, ring_no, ring, problem) of the boundary relations of an administrative level. Roles of members are not looked at."""
    chosen = relations.where(F.col("tags")["admin_level"] == str(level))
    members = chosen.select("rel_id", F.posexplode("members").alias("member_pos", "m")).where(F.lower("m.type") == "way")
    refs = members.select("rel_id", "member_pos", F.col("m.id").alias("way_id")).join(ways.select("way_id", F.posexplode("nodes").alias("pos", "node_id")), "way_id")
    placed = refs.join(nodes.select("node_id", "lat", "lon"), "node_id", "left").select("rel_id", "member_pos", "pos", "node_id", "lat", "lon")
    return assemble_rings(placed, strict).withColumnRenamed("rel_id", "area_id")


def rectangles(areas: DataFrame, key: str) -> DataFrame:
    """(key, ring) of rectangles (key, lat0, lat1, lon0, lon1)."""
    corner = lambda a, o: F.struct(F.col(a).alias("lat"), F.col(o).alias("lon"))
    ring = F.array(corner("lat0", "lon0"), corner("lat0", "lon1"), corner("lat1", "lon1"), corner("lat1", "lon0"), corner("lat0", "lon0"))
    return areas.select(key, ring.alias("ring"))


def tasks_for(points: DataFrame) -> int:
    """How many tasks count the votes of points."""
    return int(points.count()) // TASK_POINTS + FEW


def votes(points: DataFrame, areas: DataFrame, size: float = 0.02, tasks: int | None = None) -> DataFrame:
    """How many of an entity's points each area covers: points (role, id, pos, lat, lon), areas (area_id, ring); a point has one vote for an area, however many of its rings cover it."""
    # an entity's points stay together, so their votes are counted and compared where they are; a constant
    # role, which Spark would take out of the keys and so deal the rows once more, is made a column of rows
    tasks = tasks or tasks_for(points)
    points = points.select(F.explode(F.array("role")).alias("role"), "id", "pos", "lat", "lon")
    inside = point_in_rings(points, ["role", "id", "pos"], areas, "area_id", size).repartition(tasks, "role", "id").distinct()
    return inside.groupBy("role", "id", "area_id").agg(F.count(F.lit(1)).alias("votes"))


def assign(voted: DataFrame, allocation: dict[str, str] | None = None) -> DataFrame:
    """(role, id, area_id): the area with most votes, ties to the least area_id, or every area with a vote. Entities that no area covers are left out."""
    kinds = allocation or ALLOCATION
    order = Window.partitionBy("role", "id").orderBy(F.desc("votes"), "area_id")
    to_all = F.col("role").isin([r for r, k in kinds.items() if k == "all"])
    return voted.withColumn("n", F.row_number().over(order)).where(to_all | (F.col("n") == 1)).select("role", "id", "area_id")


def prune_areas(assigned: DataFrame) -> DataFrame:
    """Without areas that have neither building nor substation."""
    used = assigned.where(F.col("role").isin("building", "substation")).select("area_id").distinct()
    return assigned.join(used, "area_id", "left_semi").select("role", "id", "area_id")


def partition(points: DataFrame, areas_of_level, starting: int, lowest: int, size: float = 0.02) -> DataFrame:
    """(region, role, id): region is the path of areas through the levels, as array<long>.

    areas_of_level: level to (area_id, ring), or None. Within each region an entity votes for the areas
    of the next level; a region without areas or assignments there stays as it is.
    """
    if starting not in ADMIN_LEVELS or lowest not in ADMIN_LEVELS or starting > lowest:
        raise ValueError(f"levels {starting} to {lowest} are not levels in ascending order")
    shared_dir(points.sparkSession)
    tasks = tasks_for(points)
    placed = points.select("role", "id").repartition(tasks, "role", "id").distinct().withColumn("region", F.array().cast("array<long>")).checkpoint()
    level: int | None = starting
    while level is not None and level <= lowest:
        areas = areas_of_level(level)
        if areas is not None and not (areas := areas.checkpoint()).isEmpty():
            voted = votes(points, areas, size, tasks)
            # votes don't depend on the region; the areas of a region are those that its own entities vote for
            assigned = placed.repartition(tasks, "role", "id").join(assign(voted), ["role", "id"]).select("region", "role", "id", "area_id")
            used = assigned.where(F.col("role").isin("building", "substation")).select("region", "area_id").distinct()
            assigned = assigned.join(used, ["region", "area_id"], "left_semi")
            whole = placed.join(used.select("region").distinct(), "region", "left_anti")
            placed = assigned.select("role", "id", F.concat("region", F.array("area_id")).alias("region")).unionByName(whole.select("role", "id", "region"))
            placed = placed.checkpoint()  # each level reads the one before it several times
        level = next_level(level)
    return placed.select("region", "role", "id")
