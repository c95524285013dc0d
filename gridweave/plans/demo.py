"""A small map made of the star schema's tables, as SQL that Spark and DuckDB read alike.

Streets run along rows of 50 parts, in bands of six rows with a row left out between them, and along
every fifth column; buildings stand about the customers' parts, substations by the suppliers', nations
tile the map as rectangles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Each table, in an order in which it reads only those before it.
TABLES: dict[str, str] = {
    "osm_node": "SELECT CAST(p_partkey AS BIGINT) AS node_id, CAST(floor(p_partkey/50) AS BIGINT) AS r, CAST(p_partkey%50 AS BIGINT) AS c,"
    " 51.4e0+CAST(floor(p_partkey/50) AS BIGINT)*1e-3 AS lat, 7.3e0+(p_partkey%50)*1.5e-3 AS lon FROM part",
    "way_node": "SELECT 1000000+r AS way_id, c AS pos, node_id FROM osm_node WHERE r%7<>6"
    " UNION ALL SELECT 2000000+c*1000+CAST(floor(r/7) AS BIGINT) AS way_id, r AS pos, node_id FROM osm_node WHERE c%5=0 AND r%7<=5",
    "section": "SELECT s.way_id,s.pos,s.a_id,s.b_id,a.lat AS a_lat,a.lon AS a_lon,b.lat AS b_lat,b.lon AS b_lon FROM"
    " (SELECT way_id,pos,node_id AS a_id, lead(node_id) OVER (PARTITION BY way_id ORDER BY pos) AS b_id FROM way_node) s"
    " JOIN osm_node a ON a.node_id=s.a_id JOIN osm_node b ON b.node_id=s.b_id",
    "building": "SELECT CAST(c_custkey AS BIGINT) AS building_id, n.lat+((c_custkey*37)%100-50)*1e-5 AS lat,"
    " n.lon+((c_custkey*61)%150-75)*1e-5 AS lon, (4+c_custkey%7)*1e-5 AS half FROM customer JOIN osm_node n ON n.node_id=c_custkey",
    "boundary": "SELECT CAST(n_nationkey AS BIGINT) AS area_id,"
    " 51.3995e0+CAST(floor(n_nationkey/5) AS BIGINT)*p.nr*2e-4 AS lat0, 51.3995e0+(CAST(floor(n_nationkey/5) AS BIGINT)+1)*p.nr*2e-4 AS lat1,"
    " 7.2995e0+(n_nationkey%5)*1.5e-2 AS lon0, 7.2995e0+(n_nationkey%5+1)*1.5e-2 AS lon1"
    " FROM nation CROSS JOIN (SELECT count(*)/50 AS nr FROM part) p",
    "substation": "SELECT CAST(s_suppkey AS BIGINT) AS sub_id, n.lat+3e-5 AS lat, n.lon+2e-5 AS lon FROM supplier JOIN osm_node n ON n.node_id=s_suppkey*20",
    "landuse": "SELECT area_id AS landuse_id, lat0+1e-4 AS lat0, lat1-1e-4 AS lat1, lon0+5e-4 AS lon0, lon1-5e-4 AS lon1 FROM boundary WHERE area_id%3<>0",
    "entity": "SELECT CASE c_custkey%3 WHEN 0 THEN 'node' WHEN 1 THEN 'way' ELSE 'relation' END AS type, CAST(c_custkey AS BIGINT) AS id, c_custkey%2=1 AND c_custkey%3=1 AS is_closed,"
    " CASE WHEN c_custkey%4=0 THEN 'yes' WHEN c_custkey%9=1 THEN 'transformer_tower' END AS building, CASE WHEN c_custkey%5=0 THEN 'residential' WHEN c_custkey%5=1 THEN 'motorway' END AS highway,"
    " CASE WHEN c_custkey%6=0 THEN 'farm' END AS landuse, CASE WHEN c_custkey%7=0 THEN 'administrative' WHEN c_custkey%7=1 THEN 'maritime' END AS boundary,"
    " CASE WHEN c_custkey%11=0 THEN 'substation' WHEN c_custkey%11=1 THEN 'line' END AS power FROM customer",
}
TAGS = ["building", "highway", "landuse", "boundary", "power"]
HAVERSINE = "12756274e0*asin(sqrt(pow(sin(radians({b_lat}-{a_lat})/2e0),2e0)+cos(radians({a_lat}))*cos(radians({b_lat}))*pow(sin(radians({b_lon}-{a_lon})/2e0),2e0)))"


def haversine(a: str, b: str) -> str:
    """SQL of the distance between the places named by two prefixes, like ``s.a_``."""
    return HAVERSINE.format(a_lat=f"{a}lat", a_lon=f"{a}lon", b_lat=f"{b}lat", b_lon=f"{b}lon")


def sql(query: str, *more: str, recursive: bool = False) -> str:
    """A DuckDB query over the map; more: tables of its own, as ``name AS (...)``."""
    return f"WITH {'RECURSIVE ' * recursive}" + ", ".join([f"{name} AS ({text})" for name, text in TABLES.items()] + list(more)) + f" {query}"


class Map:
    """The map's tables of one scale."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        views = ["part", "customer", "supplier", "nation"]
        text = f"WITH {', '.join(f'{n} AS ({t})' for n, t in list(TABLES.items())[: list(TABLES).index(name) + 1])} SELECT * FROM {name}"
        return self.spark.sql(text.replace("FROM part", "FROM {part}").replace("FROM customer", "FROM {customer}").replace("FROM supplier", "FROM {supplier}").replace("FROM nation", "FROM {nation}"), **{v: self.base(v) for v in views})
