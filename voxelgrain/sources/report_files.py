"""Writing, resuming and recolouring reports; palettes; which geometry can be used again."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from voxelgrain.functions.expressions import hex_colour_of
from voxelgrain.operators.report import as_float32, prune_all_null


def read_palette(spark: SparkSession, path: str) -> dict[str, str]:
    """Colour by structure from a JSON object; names and colours in lower case. Anything else raises."""
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    try:
        found = json.loads(text)
    except json.JSONDecodeError as e:
        raise ValueError(f"{path} is not JSON: {e}") from e
    if not isinstance(found, dict):
        raise ValueError(f"{path} must hold an object of structure and colour")
    return {str(k).lower(): hex_colour_of(v) for k, v in found.items()}


def write_report(df: DataFrame, path: str, lead: tuple[str, ...] = ("obs_level", "object_id"), facts: dict[str, str] | None = None, comments: dict[str, str] | None = None) -> None:
    """The report as Parquet: without empty columns, leading columns first, 32-bit floats.

    ``facts`` and column descriptions are the schema's metadata, which Spark keeps in the footer of every file.
    """
    kept = as_float32(prune_all_null(df))
    first = [c for c in lead if c in kept.columns]
    ordered = kept.select(*first, *(c for c in kept.columns if c not in first))
    notes = {c: ordered.schema[c].metadata for c in ordered.columns}
    for c, text in (comments or {}).items():
        if c in notes:
            notes[c] = notes[c] | {"comment": text}
    if facts is not None:
        notes = {c: {k: v for k, v in n.items() if k != "facts"} for c, n in notes.items()}
        notes[ordered.columns[0]]["facts"] = facts
    ordered.select(*(F.col(f"`{c}`").alias(c, metadata=n) for c, n in notes.items())).write.mode("overwrite").parquet(path)


def read_report(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str]]:
    df = spark.read.parquet(path)
    return df, next((dict(f.metadata["facts"]) for f in df.schema if "facts" in f.metadata), {})


def replace_report(df: DataFrame, path: str, facts: dict[str, str]) -> None:
    """Writes a report in the place of the one it was read from: beside it first, then both are renamed."""
    spark = df.sparkSession
    write_report(df, f"{path}.new", facts=facts)
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    files = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    files.delete(at(f"{path}.old"), True)
    if not (files.rename(at(path), at(f"{path}.old")) and files.rename(at(f"{path}.new"), at(path))):
        raise OSError(f"{path} can't be replaced; the new report is at {path}.new")
    files.delete(at(f"{path}.old"), True)


def read_geometry(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The geometry of all objects whose paths are given, as one table."""
    return spark.read.option("mergeSchema", True).parquet(*paths)


def finished(spark: SparkSession, parts: str) -> DataFrame | None:
    """Rows of the objects that earlier runs measured; nothing if there are none. A file that can't be read is left out, so its object is measured again."""
    inference = "spark.sql.sources.partitionColumnTypeInference.enabled"
    before = spark.conf.get(inference)
    # Ids are texts, whatever they look like.
    spark.conf.set(inference, "false")
    try:
        found = spark.read.option("ignoreCorruptFiles", True).option("mergeSchema", True).parquet(parts)
    except AnalysisException:
        return None
    finally:
        spark.conf.set(inference, before)
    return found if "obs_level" in found.columns and "object_id" in found.columns else None


def remaining(objects: DataFrame, done: DataFrame | None) -> DataFrame:
    """Objects that still have to be measured."""
    return objects if done is None else objects.join(done.select("object_id").distinct(), "object_id", "left_anti")


def write_parts(rows: DataFrame, parts: str) -> None:
    """Measured objects, a directory for each. One that was there already is replaced, so that a retry or a replayed batch leaves no row twice."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("object_id").parquet(parts)


def discard_parts(spark: SparkSession, parts: str) -> None:
    """Deletes the parts, once the report that they were kept for is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(parts)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def recolour(report: DataFrame, palette: dict[str, str]) -> tuple[DataFrame, int]:
    """The report with its whole colour column replaced (null for structures without a colour), and how many rows have one."""
    colours = F.create_map(*(F.lit(x) for kv in palette.items() for x in kv)) if palette else F.expr("cast(map() as map<string,string>)")
    found = report.withColumn("entity_colour", F.try_element_at(colours, F.lower("entity_name")))
    return found, found.where("entity_colour is not null").count()


def write_geometry(rows: DataFrame, path: str) -> None:
    """Geometry by object, zstd; an empty blob is null."""
    blobs = [f.name for f in rows.schema if isinstance(f.dataType, T.BinaryType)]
    clean = rows.withColumns({c: F.when(F.octet_length(c) > 0, F.col(c)) for c in blobs})
    scalars = [c for c in rows.columns if c not in blobs]
    clean.select(*scalars, *blobs).write.mode("overwrite").partitionBy("object_id").option("compression", "zstd").parquet(path)


def usable_geometry(spark: SparkSession, path: str) -> int | None:
    """Rows of a geometry table; nothing if it isn't there or is empty."""
    try:
        return spark.read.parquet(path).count() or None
    except AnalysisException:
        return None


def values_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Computed rows as a table; values that aren't finite become null."""
    clean = [tuple(None if isinstance(v, float) and (v != v or v in (float("inf"), float("-inf"))) else v for v in r) for r in rows]
    return spark.createDataFrame(clean, schema)
