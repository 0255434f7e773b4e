"""Loads objects: a folder's entity files as voxel rows, with everything refused that can't be measured.

An object is refused as a whole, with the first reason: no source, no entities, no object mask, an unreadable file, a
shape other than the source's, labels that aren't whole numbers, or a voxel size that is missing or has another number
of axes. What is left is clipped to the object mask, cropped to its bounding box, and masks of several pieces become
labels. Planes have ``z`` 0 throughout.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelgrain.functions.expressions import normal_name, normalize_name
from voxelgrain.operators import measure
from voxelgrain.operators.lineage import kept
from voxelgrain.sources import folders, tiff

BROKEN = (ValueError, struct.error, zlib.error, KeyError, IndexError)


@dataclass
class Loaded:
    """``objects`` (a row each), ``voxels`` (``object_id, entity, kind, label, z, y, x``), ``failures`` (``object_id, error``)."""

    objects: DataFrame
    voxels: DataFrame
    failures: DataFrame


def _contents(spark: SparkSession, root: str, wanted: DataFrame) -> DataFrame:
    """The files in ``wanted`` (``folder, file``) with their contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.tif*").load(root)
    files = files.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"), F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return files.join(wanted, ["folder", "file"])


def headers(spark: SparkSession, root: str, sources: DataFrame) -> DataFrame:
    """``folder``, ``shape``, ``dtype``, ``voxel_size`` (null if not given) and ``error`` of source images, from their tags: no pixel is decoded."""

    def read(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for folder, content in zip(batch["folder"], batch["content"], strict=True):
                try:
                    shape, dtype = tiff.header(bytes(content))
                    try:
                        size = list(tiff.voxel_size(bytes(content), len(shape)))
                    except ValueError:
                        size = None
                    rows.append((folder, list(shape), dtype, size, None))
                except BROKEN as e:
                    rows.append((folder, None, None, None, f"the source can't be read: {e}"))
            yield pd.DataFrame(rows, columns=["folder", "shape", "dtype", "voxel_size", "error"])

    return _contents(spark, root, sources).select("folder", "content").mapInPandas(read, "folder string, shape array<int>, dtype string, voxel_size array<double>, error string")


def estimate(found: DataFrame, heads: DataFrame) -> DataFrame:
    """What each object takes while it is dense, from headers alone: its entities times the uncropped source, as 32-bit numbers."""
    entities = found.where("role = 'entity'").groupBy("folder").agg(F.count("*").alias("n_entities"))
    cells = F.aggregate("shape", F.lit(1).cast("long"), lambda a, b: a * b)
    rows = heads.where("error is null").join(entities, "folder", "left")
    shape = F.concat(F.array(F.greatest(F.coalesce("n_entities", F.lit(1)), F.lit(1)).cast("int")), F.col("shape"))
    order = F.when(F.size("shape") == 3, "CZYX").otherwise("CYX")
    bytes_ = F.greatest(F.coalesce("n_entities", F.lit(1)), F.lit(1)) * cells * 4
    return rows.select("folder", shape.alias("shape"), F.lit("int32").alias("dtype"), order.alias("dim_order"), bytes_.alias("bytes"))


def _entities(spark: SparkSession, root: str, files: DataFrame) -> DataFrame:
    """``folder, entity, kind, label, z, y, x, shape, error``: the foreground of each file, one row at least."""

    def read(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["folder", "entity", "kind", "label", "z", "y", "x", "shape", "error"]
        for batch in batches:
            for folder, name, kind, content in batch.itertuples(index=False):
                try:
                    volume = tiff.check_labels(tiff.read_volume(bytes(content)))
                    shape = list(volume.shape)
                    solid = volume if volume.ndim == 3 else volume[None]
                    at = np.argwhere(solid)
                    label = solid[tuple(at.T)].astype("int64")
                    yield pd.DataFrame([(folder, name, kind, None, None, None, None, shape, None)], columns=columns)
                    for a in range(0, len(at), 200_000):
                        part = at[a : a + 200_000].astype("int32")
                        yield pd.DataFrame({"folder": folder, "entity": name, "kind": kind, "label": label[a : a + 200_000], "z": part[:, 0], "y": part[:, 1], "x": part[:, 2], "shape": None, "error": None})
                except BROKEN as e:
                    yield pd.DataFrame([(folder, name, kind, None, None, None, None, None, f"{name}: {e}")], columns=columns)

    rows = _contents(spark, root, files).select("folder", "name", "kind", "content")
    return rows.mapInPandas(read, "folder string, entity string, kind string, label long, z int, y int, x int, shape array<int>, error string")


def load(spark: SparkSession, root: str, object_mask: str | None, voxel_size: tuple[float, ...] | None = None, clip: bool = True, promote: bool = True) -> Loaded:
    """All objects below ``root``; ids are folders relative to it, so that equal names in two groups stay apart."""
    found = kept(folders.discover(folders.listing(spark, root)))
    rows = folders.objects(found, object_mask)
    heads = headers(spark, root, found.where("role = 'source'").select("folder", "file"))
    parts = kept(_entities(spark, root, found.where("role = 'entity'").select("folder", "file", "name", "kind")))
    files = parts.where("label is null").select("folder", F.col("shape").alias("of_shape"), F.col("error").alias("of_error"))
    odd = heads.select("folder", "shape").join(files, "folder").groupBy("folder").agg(
        F.min("of_error").alias("file_error"), F.max(F.col("of_shape").isNotNull() & (F.col("of_shape") != F.col("shape"))).alias("odd"), F.count("*").alias("n_read"),
    )
    given = F.array(*(F.lit(float(v)) for v in voxel_size)) if voxel_size else F.col("voxel_size")
    told = rows.withColumnRenamed("error", "folder_error").join(heads.withColumnRenamed("error", "head_error"), "folder", "left").join(odd, "folder", "left").withColumn("size", given)
    dims = F.size("shape")
    error = F.coalesce(
        "folder_error", "head_error", "file_error",
        F.when(F.col("odd"), "an entity's shape isn't the source's"),
        F.when(F.coalesce("n_read", F.lit(0)) != F.size("channels"), "not all entities were read"),
        F.when(F.col("size").isNull(), "the source doesn't tell its voxel size"),
        F.when(F.size("size") != dims, F.concat(F.lit("images have "), dims.cast("string"), F.lit(" axes, the voxel size has "), F.size("size").cast("string"))),
    )
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    own = F.regexp_replace("folder", F.lit(r"^[a-z0-9]+:/*"), F.lit(""))
    own = F.when(F.startswith(F.ltrim(own, F.lit("/")), F.lit(base)), F.ltrim(F.substr(F.ltrim(own, F.lit("/")), F.lit(len(base) + 1)), F.lit("/"))).otherwise(own)
    told = kept(told.select("folder", own.alias("object_id"), "channels", "object_mask", "size", F.size("shape").alias("spatial_dims"), error.alias("error")))
    failures = told.where("error is not null").select("object_id", "error")
    good = told.where("error is null").drop("error")
    name = None if object_mask is None else normalize_name(F.lit(object_mask))
    cells = parts.where("label is not null").join(good.select("folder", "object_id"), "folder").select("object_id", "entity", "kind", "label", "z", "y", "x")
    is_mask = (F.col("kind") == "mask") & (F.col("entity") == name)
    mask = kept(cells.where(is_mask).select("object_id", "z", "y", "x").distinct())
    if clip:
        cells = cells.where(is_mask).unionByName(measure.clip(cells.where(~is_mask), mask))
    cells = measure.crop(cells, mask)
    if promote:
        apart = measure.promote(cells.where("kind = 'mask'").drop("kind", "label"), ("z", "y", "x"), object_mask=None if object_mask is None else normal_name(object_mask))
        cells = cells.where("kind = 'label'").unionByName(apart.withColumn("label", F.col("label").cast("long")))
    extents = [(F.max(a) - F.min(a) + 1).alias(f"n_{a}") for a in "zyx"]
    centre = mask.groupBy("object_id").agg(*(F.avg(a).alias(f"mean_{a}") for a in "zyx"), *(F.min(a).alias(f"low_{a}") for a in "zyx"), *extents)
    flat = F.col("spatial_dims") == 2
    size = lambda a: F.element_at("size", -3 + "zyx".index(a))
    objects = good.join(centre, "object_id", "left").select(
        "object_id", "channels", "object_mask", "spatial_dims", F.when(flat, "CYX").otherwise("CZYX").alias("dim_order"), F.size("channels").alias("n_entities"),
        F.when(flat, F.array("n_y", "n_x")).otherwise(F.array("n_z", "n_y", "n_x")).alias("object_shape"),
        F.lit("config" if voxel_size else "tiff-metadata").alias("voxel_size_source"),
        F.when(~flat, F.try_element_at("size", F.lit(-3))).alias("pixel_size_Z"), size("y").alias("pixel_size_Y"), size("x").alias("pixel_size_X"),
        F.when(~flat, (F.col("mean_z") - F.col("low_z")) * F.try_element_at("size", F.lit(-3))).alias("object_center_z_um"),
        *((((F.col(f"mean_{a}") - F.col(f"low_{a}")) * size(a)).alias(f"object_center_{a}_um")) for a in "yx"),
    )
    return Loaded(kept(objects), kept(cells), failures)
