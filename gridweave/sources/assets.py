"""Equipment types from CSV files, and grids to and from CSV files."""

from __future__ import annotations

import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LINE_TYPE = "uuid string, b double, g double, i_max double, id string, r double, v_rated double, x double"
TRANSFORMER_TYPE = (
    "uuid string, b_m double, d_phi double, d_v double, g_m double, id string, r_sc double, s_rated double, tap_max int, tap_min int, tap_neutr int, "
    "tap_side boolean, v_rated_a double, v_rated_b double, x_sc double"
)
TRANSFORMER_3W_TYPE = (
    "uuid string, b_m double, d_phi double, d_v double, g_m double, id string, r_sc_a double, r_sc_b double, r_sc_c double, s_rated_a double, s_rated_b double, s_rated_c double, "
    "tap_max int, tap_min int, tap_neutr int, v_rated_a double, v_rated_b double, v_rated_c double, x_sc_a double, x_sc_b double, x_sc_c double"
)
#: File name and, in a hierarchic tree, folder of each table.
TYPE_FILES = {"line_type_input": (LINE_TYPE, "global"), "transformer_2_w_type_input": (TRANSFORMER_TYPE, "global"), "transformer_3_w_type_input": (TRANSFORMER_3W_TYPE, "global")}
#: Files that need not be there: their tables are empty then.
OPTIONAL = {"transformer_3_w_type_input"}
OUTPUT_FOLDERS = {
    "nodes": ("node_input", "grid"), "lines": ("line_input", "grid"), "transformers": ("transformer_2_w_input", "grid"), "transformers_3w": ("transformer_3_w_input", "grid"), "loads": ("load_input", "participants"),
}


class AssetError(ValueError):
    """Missing or broken type files."""


def read_types(spark: SparkSession, directory: str, separator: str = ",", hierarchic: bool = False) -> dict[str, DataFrame]:
    """Types of lines and of transformers with two and three windings, with file_order: their place in the file.

    A table that is missing (but for three windings), without uuids, empty, or with a value that isn't of its
    column's kind raises AssetError.
    """
    return {name: read_table(spark, "/".join([directory, *([folder] if hierarchic else []), f"{name}.csv"]), schema, separator, name in OPTIONAL) for name, (schema, folder) in TYPE_FILES.items()}


def read_table(spark: SparkSession, path: str, schema: str, separator: str, optional: bool) -> DataFrame:
    kinds = dict(c.split() for c in schema.split(", "))
    try:
        try:
            header = spark.read.option("sep", separator).option("header", True).csv(path)
        except AnalysisException as e:
            if optional and "PATH_NOT_FOUND" in str(e):
                return spark.createDataFrame([], f"{schema}, file_order int")
            raise
        missing = [c for c in kinds if c not in header.columns]
        if missing:
            raise AssetError(f"{path} has no {', '.join(missing)}")
        # a type file is one small file: the reader keeps its lines in order
        ordered = header.withColumn("file_order", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())))
        typed = {c: F.expr(f"try_cast(`{c}` as {kind})") for c, kind in kinds.items()}
        wrong = F.array_compact(F.array(*[F.when(F.col(c).isNotNull() & typed[c].isNull(), F.concat(F.lit(f"{c} "), c)) for c in kinds]))
        broken = ordered.select("file_order", wrong.alias("wrong")).where(F.size("wrong") > 0).orderBy("file_order").first()
        if broken:
            raise AssetError(f"{path}, line {broken.file_order + 1}: {', '.join(broken.wrong)}")
        if ordered.where("uuid is not null").isEmpty():
            raise AssetError(f"{path} has no types")
        return ordered.select(*[typed[c].alias(c) for c in kinds], "file_order")
    except AssetError:
        raise
    except Exception as e:
        raise AssetError(f"{path} can't be read: {str(e).splitlines()[0]}") from e


def output_directory(directory: str, grid_name: str, timestamp: bool, now: datetime.datetime | None = None) -> str:
    stamp = f"_{(now or datetime.datetime.now()):%Y-%m-%d_%H-%M-%S}" if timestamp else ""
    return f"{directory}/{grid_name}{stamp}"


def write_grid(grid: dict[str, DataFrame], directory: str, separator: str = ",", hierarchic: bool = False) -> dict[str, str]:
    """A folder of CSV part files for each table; its path by table. Parts are written in parallel: a grid of any size needs no single task."""
    paths = {}
    for table, df in grid.items():
        name, folder = OUTPUT_FOLDERS.get(table, (table, "other"))
        paths[table] = "/".join([directory, *([folder] if hierarchic else []), name])
        df.write.mode("overwrite").option("sep", separator).option("header", True).csv(paths[table])
    return paths


def read_grid(spark: SparkSession, paths: dict[str, str], schemas: dict[str, str], separator: str = ",") -> dict[str, DataFrame]:
    """The tables that write_grid has written, by the paths that it returned."""
    return {t: spark.read.schema(schemas[t]).option("sep", separator).option("header", True).csv(p) for t, p in paths.items()}
