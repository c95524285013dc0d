"""Geometry as column expressions. Angles are degrees, lengths metres; a ring is an array of (lat, lon) structs whose last point equals its first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS_M = 6378137.0


def _c(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def haversine(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance on a sphere of 6378137 m."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2.0), 2.0) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2.0), 2.0)
    return F.lit(2 * RADIUS_M) * F.asin(F.sqrt(a))


def projection(lat, lon, a_lat, a_lon, b_lat, b_lon) -> Column:
    """Where the foot of the perpendicular from a point lies on the line a-b, planar in degrees: 0 at a, 1 at b, 0 where a equals b."""
    lat, lon, a_lat, a_lon, b_lat, b_lon = map(_c, (lat, lon, a_lat, a_lon, b_lat, b_lon))
    dx, dy = b_lon - a_lon, b_lat - a_lat
    square = dx * dx + dy * dy
    return F.when(square == 0.0, F.lit(0.0)).otherwise(((lon - a_lon) * dx + (lat - a_lat) * dy) / F.when(square == 0.0, F.lit(1.0)).otherwise(square))


def snap(lat, lon, a_lat, a_lon, b_lat, b_lon, min_distance_m: float) -> Column:
    """The connection point of a point on a section: struct(lat, lon, kind, t).

    A new point ('new') where the foot lies between the ends and farther than min_distance_m from both;
    else the nearer end ('a' or 'b'), b on a tie.
    """
    lat, lon, a_lat, a_lon, b_lat, b_lon = map(_c, (lat, lon, a_lat, a_lon, b_lat, b_lon))
    t = projection(lat, lon, a_lat, a_lon, b_lat, b_lon)
    p_lat, p_lon = a_lat + t * (b_lat - a_lat), a_lon + t * (b_lon - a_lon)
    to_a, to_b = haversine(p_lat, p_lon, a_lat, a_lon), haversine(p_lat, p_lon, b_lat, b_lon)
    fresh = (t >= 0.0) & (t <= 1.0) & (to_a > min_distance_m) & (to_b > min_distance_m)
    kind = F.when(fresh, "new").when(haversine(lat, lon, a_lat, a_lon) < haversine(lat, lon, b_lat, b_lon), "a").otherwise("b")
    pick = lambda new, a, b: F.when(kind == "new", new).when(kind == "a", a).otherwise(b)
    return F.struct(pick(p_lat, a_lat, b_lat).alias("lat"), pick(p_lon, a_lon, b_lon).alias("lon"), kind.alias("kind"), pick(t, F.lit(0.0), F.lit(1.0)).alias("t"))


def _edges(ring: Column, of) -> Column:
    """of(p, q) for each pair of consecutive points."""
    n = F.size(ring)
    at = F.when(n > 1, F.sequence(F.lit(0), n - 2)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: of(F.get(ring, i), F.get(ring, i + 1)))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def ring_area_m2(ring: Column | str) -> Column:
    """Area on the sphere: the sum of dlon * (sin lat1 + sin lat2) over the edges, times R^2 / 2."""
    terms = _edges(_c(ring), lambda p, q: F.radians(q["lon"] - p["lon"]) * (F.sin(F.radians(p["lat"])) + F.sin(F.radians(q["lat"]))))
    return F.abs(_sum(terms)) * F.lit(RADIUS_M**2 / 2)


def ring_centroid(ring: Column | str) -> Column:
    """Area centroid, planar in degrees: struct(lat, lon); the first point of a ring without area. Computed relative to the first point."""
    ring = _c(ring)
    o = F.get(ring, F.lit(0))
    cross = lambda p, q: (p["lon"] - o["lon"]) * (q["lat"] - o["lat"]) - (q["lon"] - o["lon"]) * (p["lat"] - o["lat"])
    area = _sum(_edges(ring, cross))
    safe = F.when(area == 0.0, F.lit(1.0)).otherwise(area) * 3.0
    part = lambda f: o[f] + F.when(area == 0.0, F.lit(0.0)).otherwise(_sum(_edges(ring, lambda p, q: (p[f] + q[f] - o[f] * 2.0) * cross(p, q))) / safe)
    return F.struct(part("lat").alias("lat"), part("lon").alias("lon"))


def _crossings(ring: Column, lat: Column, lon: Column) -> Column:
    hit = lambda p, q: F.when(
        ((p["lat"] > lat) != (q["lat"] > lat)) & (lon < (q["lon"] - p["lon"]) * (lat - p["lat"]) / F.when(q["lat"] == p["lat"], F.lit(1.0)).otherwise(q["lat"] - p["lat"]) + p["lon"]), F.lit(1)
    ).otherwise(F.lit(0))
    return F.aggregate(_edges(ring, hit), F.lit(0), lambda a, x: a + x)


def _on_border(ring: Column, lat: Column, lon: Column) -> Column:
    on = lambda p, q: (
        ((q["lon"] - p["lon"]) * (lat - p["lat"]) - (lon - p["lon"]) * (q["lat"] - p["lat"]) == 0.0)
        & lat.between(F.least(p["lat"], q["lat"]), F.greatest(p["lat"], q["lat"]))
        & lon.between(F.least(p["lon"], q["lon"]), F.greatest(p["lon"], q["lon"]))
    )
    return F.exists(_edges(ring, on), lambda x: x)


def ring_covers(ring: Column | str, lat, lon) -> Column:
    """Whether a point lies in a ring or on its border."""
    ring, lat, lon = _c(ring), _c(lat), _c(lon)
    return (_crossings(ring, lat, lon) % 2 == 1) | _on_border(ring, lat, lon)


def ring_contains(ring: Column | str, lat, lon) -> Column:
    """Whether a point lies in a ring, its border left out."""
    ring, lat, lon = _c(ring), _c(lat), _c(lon)
    return (_crossings(ring, lat, lon) % 2 == 1) & ~_on_border(ring, lat, lon)


def ring_edges(ring: Column | str) -> Column:
    """Pairs of consecutive points: array of struct(a_lat, a_lon, b_lat, b_lon)."""
    return _edges(_c(ring), lambda p, q: F.struct(p["lat"].alias("a_lat"), p["lon"].alias("a_lon"), q["lat"].alias("b_lat"), q["lon"].alias("b_lon")))


def lon_at(e: Column, lat: Column) -> Column:
    """Where an edge that isn't level crosses a latitude."""
    return (e["b_lon"] - e["a_lon"]) * (lat - e["a_lat"]) / F.when(e["b_lat"] == e["a_lat"], F.lit(1.0)).otherwise(e["b_lat"] - e["a_lat"]) + e["a_lon"]


def lat_at(e: Column, lon: Column) -> Column:
    return (e["b_lat"] - e["a_lat"]) * (lon - e["a_lon"]) / F.when(e["b_lon"] == e["a_lon"], F.lit(1.0)).otherwise(e["b_lon"] - e["a_lon"]) + e["a_lat"]


def crossings_between(edges: Column, lat: Column, lon: Column, c_lat: Column, c_lon: Column) -> Column:
    """How many edges the way from a point along its latitude and then along c_lon to (c_lat, c_lon) crosses; no edge may end at c_lon."""
    level = lambda e: ((e["a_lat"] > lat) != (e["b_lat"] > lat)) & ((lon_at(e, lat) > lon) != (lon_at(e, lat) > c_lon))
    upright = lambda e: ((e["a_lon"] > c_lon) != (e["b_lon"] > c_lon)) & ((lat_at(e, c_lon) > lat) != (lat_at(e, c_lon) > c_lat))
    return F.aggregate(edges, F.lit(0), lambda n, e: n + level(e).cast("int") + upright(e).cast("int"))


def on_edges(edges: Column, lat: Column, lon: Column) -> Column:
    """Whether a point lies on one of the edges."""
    between = lambda x, a, b: x.between(F.least(a, b), F.greatest(a, b))
    off = lambda e: (e["b_lon"] - e["a_lon"]) * (lat - e["a_lat"]) - (lon - e["a_lon"]) * (e["b_lat"] - e["a_lat"])
    return F.exists(edges, lambda e: (off(e) == 0.0) & between(lat, e["a_lat"], e["b_lat"]) & between(lon, e["a_lon"], e["b_lon"]))


def turn(p_lat, p_lon, q_lat, q_lon, r_lat, r_lon) -> Column:
    """Twice the signed area of the triangle p, q, r."""
    p_lat, p_lon, q_lat, q_lon, r_lat, r_lon = map(_c, (p_lat, p_lon, q_lat, q_lon, r_lat, r_lon))
    return (q_lon - p_lon) * (r_lat - p_lat) - (q_lat - p_lat) * (r_lon - p_lon)


def segments_cross(a: list, b: list, c: list, d: list) -> Column:
    """Whether segments a-b and c-d, points as [lat, lon], cross inside both, or lie on top of each other: more than two of the four ends on the other segment.

    A mere touch at an end of either is no crossing.
    """
    a, b, c, d = ([_c(x) for x in p] for p in (a, b, c, d))
    sides = [turn(*a, *b, *c), turn(*a, *b, *d), turn(*c, *d, *a), turn(*c, *d, *b)]
    between = lambda r, p, q: r[0].between(F.least(p[0], q[0]), F.greatest(p[0], q[0])) & r[1].between(F.least(p[1], q[1]), F.greatest(p[1], q[1]))
    on = [(s == 0.0) & between(r, p, q) for s, (r, p, q) in zip(sides, ((c, a, b), (d, a, b), (a, c, d), (b, c, d)), strict=True)]
    touching = sum(x.cast("int") for x in on)
    proper = (F.signum(sides[0]) * F.signum(sides[1]) < 0) & (F.signum(sides[2]) * F.signum(sides[3]) < 0)
    return proper | (touching > 2)


def household_kw(area_m2, density_w_m2) -> Column:
    """Power of a building, rounded to 0.1 W."""
    return F.round(_c(area_m2) * _c(density_w_m2) / 1000.0, 4)


def cell(degrees, size: float) -> Column:
    """Index of the cell that an angle falls in."""
    return F.floor(_c(degrees) / F.lit(size)).cast("long")
