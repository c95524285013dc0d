"""Map entities: tag filters, roles, members.

nodes (node_id, lat, lon, tags), ways (way_id, nodes, tags), relations (rel_id, members, tags); an
entity is named by its type and id together, as ids of different types may be equal.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.storage import shared_dir


#: A filter: tag keys with the values allowed; an empty list allows any.
Filter = dict[str, list[str]]
BOUNDARY: Filter = {"boundary": ["administrative", "census"]}
SUBSTATION: Filter = {"building": ["transformer_tower"], "power": ["substation"]}
BUILDING: Filter = {"building": []}
HIGHWAY: Filter = {"highway": []}
LANDUSE: Filter = {"landuse": []}
ROLES: dict[str, Filter] = {"building": BUILDING, "highway": HIGHWAY, "landuse": LANDUSE, "boundary": BOUNDARY, "substation": SUBSTATION}


def has_tag(filter_: Filter, tags: str = "tags") -> Column:
    """Whether any key of the filter has an allowed value."""
    tests = [F.coalesce(F.col(tags)[k].isin(v) if v else F.col(tags)[k].isNotNull(), F.lit(False)) for k, v in filter_.items()]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def entities(nodes: DataFrame, ways: DataFrame, relations: DataFrame) -> DataFrame:
    """All entities: type, id, tags, is_closed."""
    closed = (F.size("nodes") > 1) & (F.get(F.col("nodes"), F.lit(0)) == F.element_at("nodes", -1))
    parts = [
        nodes.select(F.lit("node").alias("type"), F.col("node_id").alias("id"), "tags", F.lit(False).alias("is_closed")),
        ways.select(F.lit("way").alias("type"), F.col("way_id").alias("id"), "tags", F.coalesce(closed, F.lit(False)).alias("is_closed")),
        relations.select(F.lit("relation").alias("type"), F.col("rel_id").alias("id"), "tags", F.lit(False).alias("is_closed")),
    ]
    return reduce(DataFrame.unionByName, parts)


def filter_or(found: DataFrame, filters: list[Filter]) -> DataFrame:
    """Entities that any of the filters lets through; filters with a key in common don't hide each other."""
    return found.where(reduce(lambda a, b: a | b, [has_tag(f) for f in filters], F.lit(False)))


def with_roles(found: DataFrame, roles: dict[str, Filter] | None = None) -> DataFrame:
    """A row (role, type, id, is_closed) for each role that an entity has.

    Nodes are buildings only as substations; of buildings and landuses the closed ways count, of
    highways the ways, of boundaries the relations, of substations nodes and closed ways.
    """
    kinds = {"building": "is_closed", "landuse": "is_closed", "highway": "type = 'way'", "boundary": "type = 'relation'", "substation": "is_closed or type = 'node'"}
    each = [F.when(has_tag(f) & F.expr(kinds.get(r, "true")), F.lit(r)) for r, f in (roles or ROLES).items()]
    return found.select(F.explode(F.array_compact(F.array(*each))).alias("role"), "type", "id", "is_closed")


def of_type(found: DataFrame, kind: str) -> DataFrame:
    return found.where(F.col("type") == kind)


def closed_ways(found: DataFrame) -> DataFrame:
    return found.where("is_closed")


def substations_only(found: DataFrame) -> DataFrame:
    """Of entities those that can be a substation: nodes and closed ways."""
    return found.where("is_closed or type = 'node'")


def way_nodes(ways: DataFrame) -> DataFrame:
    """way_id, pos, node_id."""
    return ways.select("way_id", F.posexplode("nodes").alias("pos", "node_id"))


def way_members(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes of ways with their places; nodes that aren't there are left out."""
    return way_nodes(ways).join(nodes.select("node_id", "lat", "lon"), "node_id").select("way_id", "pos", "node_id", "lat", "lon")


def way_members_or_null(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes of ways; the place of a node that isn't there is null."""
    return way_nodes(ways).join(nodes.select("node_id", "lat", "lon"), "node_id", "left").select("way_id", "pos", "node_id", "lat", "lon")


def relation_members(relations: DataFrame, ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """All entities below each relation (rel_id, type, id), through relations in relations of any depth.

    Each round doubles the depth that is reached, until nothing is added, so a relation that contains
    itself ends the search too; members that aren't there or of unknown type are left out.
    """
    shared_dir(relations.sparkSession)
    direct = relations.select("rel_id", F.explode("members").alias("m")).select("rel_id", F.lower("m.type").alias("type"), F.col("m.id").alias("id"))
    known = direct.where("type in ('node', 'way', 'relation')").distinct().checkpoint()
    reach = known.where("type = 'relation'").select("rel_id", "id").checkpoint()
    size = reach.count()
    while size:
        further = reach.select(F.col("rel_id").alias("id"), F.col("id").alias("next"))
        reach = reach.union(reach.join(further, "id").select("rel_id", F.col("next").alias("id"))).distinct().checkpoint()
        before, size = size, reach.count()
        if size == before:
            break
    below = reach.join(known.withColumnRenamed("rel_id", "sub").withColumnRenamed("id", "member"), F.col("id") == F.col("sub")).select("rel_id", "type", F.col("member").alias("id"))
    found = known.union(below).distinct()
    refs = found.where("type = 'way'").join(way_nodes(ways), F.col("id") == F.col("way_id")).select("rel_id", F.lit("node").alias("type"), F.col("node_id").alias("id"))
    everything = found.union(refs).distinct()
    there = entities(*[d.select("*") for d in (nodes, ways, relations)]).select("type", "id")
    return everything.join(there, ["type", "id"], "left_semi").select("rel_id", "type", "id")


def merge(one: tuple[DataFrame, dict[str, Filter]], other: tuple[DataFrame, dict[str, Filter]]) -> tuple[DataFrame, dict[str, Filter]] | None:
    """The rows of two models (rows with roles, filters they were made by) of equal filters; None if the filters differ."""
    return (one[0].unionByName(other[0]), one[1]) if one[1] == other[1] else None


def merge_all(models: list[tuple[DataFrame, dict[str, Filter]]]) -> tuple[DataFrame, dict[str, Filter]] | None:
    """None of no models, or where the filters of any two differ."""
    if not models:
        return None
    return reduce(lambda a, b: a and merge(a, b), models)
