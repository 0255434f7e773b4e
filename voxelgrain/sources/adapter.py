"""Derives the domain model (voxels, objects, masks, planes, points) from the relational tables.

Each view exists twice: as a DataFrame and as a DuckDB CTE, so that a query and its SQL start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Voxel size in micrometres, in array order.
SIZE = (0.1, 0.02, 0.02)
UNIT = "cast(0.1 as double) * 0.02 * 0.02"
#: Label ids per entity, in the views with few and with many instances.
MANY, FEW = 64, 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def voxels(spark: SparkSession, sf_dir: str, k: int = MANY) -> DataFrame:
    """``object_id, entity, z, y, x, label``: label entities; where labels collide in a cell the lowest stays."""
    cells = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("object_id"), F.col("l_returnflag").alias("entity"), F.col("l_linenumber").cast("int").alias("z"),
        F.col("l_quantity").cast("int").alias("y"), F.round(F.col("l_discount") * 100).cast("int").alias("x"), (F.col("l_partkey") % k + 1).alias("label"),
    )
    return cells.groupBy("object_id", "entity", "z", "y", "x").agg(F.min("label").alias("label"))


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``object_id, grp``."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    joined = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(F.col("s_suppkey").alias("object_id"), F.col("r_name").alias("grp"))


def object_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``object_id, z, y, x``: an ellipsoid in each object's grid."""
    axis = lambda a, b, name: F.explode(F.sequence(F.lit(a), F.lit(b))).alias(name)
    grid = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("object_id"))
    grid = grid.select("object_id", axis(1, 7, "z")).select("*", axis(1, 50, "y")).select("*", axis(0, 10, "x"))
    return grid.where("((z - 4) / 3.6D) * ((z - 4) / 3.6D) + ((y - 25.5D) / 27.0D) * ((y - 25.5D) / 27.0D) + ((x - 5) / 5.6D) * ((x - 5) / 5.6D) <= 1.0D")


def nucleus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``object_id, z, y, x``: a second mask."""
    rows = table(spark, sf_dir, "lineitem").where("l_linestatus = 'F' and l_tax <= 0.01D")
    return rows.select(F.col("l_suppkey").alias("object_id"), F.col("l_linenumber").cast("int").alias("z"), F.col("l_quantity").cast("int").alias("y"), F.round(F.col("l_discount") * 100).cast("int").alias("x")).distinct()


def plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``object_id, entity, y, x``: 2D masks."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("object_id"), F.col("event_type").alias("entity"), F.hour("ts").alias("y"), (F.dayofmonth("ts") - 1).alias("x")).distinct()


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, entity, z, y, x``: one point for each embedding."""
    at = lambda i: F.col("embedding")[i].cast("double")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("entity"), at(0).alias("z"), at(1).alias("y"), at(2).alias("x"))


def _vox_sql(name: str, k: int) -> str:
    return f"""{name} AS (SELECT l_suppkey AS object_id, l_returnflag AS entity, CAST(l_linenumber AS INTEGER) AS z, CAST(l_quantity AS INTEGER) AS y,
  CAST(round(l_discount * 100) AS INTEGER) AS x, min(l_partkey % {k} + 1) AS label FROM lineitem GROUP BY 1, 2, 3, 4, 5)"""


#: DuckDB CTEs by view name; ``with_views`` puts together those that a query needs.
VIEWS = {
    "vox": _vox_sql("vox", MANY),
    "vox16": _vox_sql("vox16", FEW),
    "objects": "objects AS (SELECT s_suppkey AS object_id, r_name AS grp FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)",
    "pm": """pm AS (SELECT s_suppkey AS object_id, z, y, x FROM supplier, (SELECT unnest(range(1, 8))::INTEGER AS z), (SELECT unnest(range(1, 51))::INTEGER AS y), (SELECT unnest(range(0, 11))::INTEGER AS x)
  WHERE ((z - 4) / 3.6) * ((z - 4) / 3.6) + ((y - 25.5) / 27.0) * ((y - 25.5) / 27.0) + ((x - 5) / 5.6) * ((x - 5) / 5.6) <= 1)""",
    "nucleus": "nucleus AS (SELECT DISTINCT l_suppkey AS object_id, CAST(l_linenumber AS INTEGER) AS z, CAST(l_quantity AS INTEGER) AS y, CAST(round(l_discount * 100) AS INTEGER) AS x FROM lineitem WHERE l_linestatus = 'F' AND l_tax <= 0.01)",
    "plane": "plane AS (SELECT DISTINCT user_id AS object_id, event_type AS entity, CAST(hour(ts) AS INTEGER) AS y, CAST(day(ts) - 1 AS INTEGER) AS x FROM events)",
    "points": "points AS (SELECT vec_id AS id, label AS entity, embedding[1]::DOUBLE AS z, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS x FROM embeddings)",
}


def with_views(names: str, *more: str) -> str:
    """``WITH RECURSIVE`` and the named views, then further CTEs."""
    return "WITH RECURSIVE " + ",\n".join([*(VIEWS[n] for n in names.split()), *more]) + "\n"
