"""Finds objects in a folder tree: which image is the source, which files are its entities, and what is wrong.

Listing is Spark's (``binaryFile`` without contents), and every rule is an expression or a window over one folder,
so a tree with millions of objects is one job. Nothing here opens a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelgrain.functions.expressions import entity_file, normalize_name


def listing(spark: SparkSession, root: str) -> DataFrame:
    """``folder, file, stem, bytes, modified`` of every TIFF below ``root``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.tif*").load(root)
    path = F.col("path")
    file = F.element_at(F.split(path, "/"), -1)
    return files.select(
        F.regexp_replace(path, "/[^/]*$", "").alias("folder"), file.alias("file"), F.regexp_replace(file, r"\.[^.]*$", "").alias("stem"),
        F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"),
    )


def shared_prefix(a: Column, b: Column) -> Column:
    """Number of leading characters that two strings have in common."""
    places = F.sequence(F.lit(1), F.greatest(F.least(F.length(a), F.length(b)), F.lit(1)))
    differ = F.filter(places, lambda i: (F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1))) | (F.length(a) < i) | (F.length(b) < i))
    return F.coalesce(F.get(differ, 0) - 1, F.least(F.length(a), F.length(b)))


def discover(files: DataFrame) -> DataFrame:
    """Every file with its ``role`` (source, entity, rejected or unparsed) and the ``reason`` of a rejection.

    The source is the file, not itself named as an entity, that shares most characters with the entities' prefixes
    (then the largest). Entities are those whose prefix shares most with the source's name; if one of the two is the
    other's beginning, it has to end at a word's end; of two with one kind and name the first file stays.
    """
    parsed = files.withColumn("e", entity_file(F.col("stem"))).withColumn("normal", normalize_name(F.col("stem")))
    entities = parsed.where("e is not null").select("folder", "file", "bytes", F.col("e.prefix").alias("prefix"), F.col("e.name").alias("name"), F.col("e.kind").alias("kind"))
    images = parsed.where("e is null").select("folder", "file", "bytes", "normal")
    scores = images.join(entities.select("folder", "prefix"), "folder", "left").withColumn("score", F.coalesce(shared_prefix(F.col("normal"), F.col("prefix")), F.lit(0)))
    scores = scores.groupBy("folder", "file", "bytes", "normal").agg(F.sum("score").alias("score"))
    best = scores.groupBy("folder").agg(F.max(F.struct("score", "bytes", F.struct((-F.length("file")).alias("short"), "file", "normal").alias("of"))).alias("b"))
    best = best.select("folder", F.col("b.of.file").alias("source"), F.col("b.of.normal").alias("source_name"))
    matched = entities.join(best, "folder", "left").withColumn("shared", shared_prefix(F.col("source_name"), F.col("prefix")))
    folder = Window.partitionBy("folder")
    matched = matched.withColumn("most", F.max("shared").over(folder))
    longer = F.when(F.length("source_name") >= F.length("prefix"), F.col("source_name")).otherwise(F.col("prefix"))
    whole = F.col("shared") >= F.least(F.length("source_name"), F.length("prefix"))
    inside = whole & (F.col("shared") < F.length(longer)) & (F.substr(longer, F.col("shared") + 1, F.lit(1)) != "_")
    reason = F.when(F.col("source").isNull(), "no source").when(F.col("shared") < F.col("most"), "matches less closely").when(inside, "not at a word's end")
    matched = matched.withColumn("reason", reason)
    place = F.row_number().over(Window.partitionBy("folder", "kind", "name", F.col("reason").isNull()).orderBy("file"))
    matched = matched.withColumn("reason", F.coalesce("reason", F.when(place > 1, "duplicate")))
    found = matched.select("folder", "file", "bytes", F.when(F.col("reason").isNull(), "entity").otherwise("rejected").alias("role"), "name", "kind", "reason")
    rest = images.join(best, "folder", "left").select("folder", "file", "bytes", F.when(F.col("file") == F.col("source"), "source").otherwise("unparsed").alias("role"), *(F.lit(None).cast("string").alias(c) for c in ("name", "kind", "reason")))
    return found.unionByName(rest)


def supported(files: DataFrame) -> DataFrame:
    """Folders with a source and an entity."""
    is_entity = entity_file(F.col("stem")).isNotNull()
    return files.groupBy("folder").agg((F.bool_or(is_entity) & F.bool_or(~is_entity)).alias("ok")).where("ok").select("folder")


def objects(found: DataFrame, object_mask: str | None) -> DataFrame:
    """One row a folder: source, entities in channel order (object mask first, then by ``kind:name``), the mask, and the first error."""
    wanted = None if object_mask is None else normalize_name(F.lit(object_mask))
    is_mask = F.lit(False) if wanted is None else (F.col("kind") == "mask") & (F.col("name") == wanted)
    entity = F.when(F.col("role") == "entity", F.struct((~is_mask).alias("later"), F.concat_ws(":", "kind", "name").alias("key"), "file"))
    rows = found.groupBy("folder").agg(
        F.max(F.when(F.col("role") == "source", F.col("file"))).alias("source"), F.array_sort(F.collect_list(entity)).alias("e"),
        F.max(F.when((F.col("role") == "entity") & is_mask, F.col("name"))).alias("object_mask"),
        F.array_sort(F.collect_set(F.when((F.col("role") == "entity") & (F.col("kind") == "mask"), F.col("name")))).alias("masks"),
    )
    error = (
        F.when(F.col("source").isNull(), "no source image").when(F.size("e") == 0, "no entity files")
        .when(F.lit(wanted is None), F.concat(F.lit("no object mask named; there are: "), F.array_join("masks", ", ")))
        .when(F.col("object_mask").isNull(), F.concat(F.lit("the object mask isn't there; there are: "), F.array_join("masks", ", ")))
    )
    return rows.select("folder", "source", F.transform("e", lambda x: x["key"]).alias("channels"), F.transform("e", lambda x: x["file"]).alias("files"), "object_mask", error.alias("error"))


def dry_run(rows: DataFrame) -> DataFrame:
    """How many objects have each entity, and how many objects there are."""
    total = rows.agg(F.count("*").alias("objects"))
    return rows.select(F.explode("channels").alias("key")).groupBy("key").agg(F.count("*").alias("present")).crossJoin(total)


def peak_gb(voxels: int, entities: int, factor: float = 3.5) -> float:
    """Memory that one object needs while it is dense, in GB."""
    return voxels * (2 * entities + 4) * factor / 1e9
