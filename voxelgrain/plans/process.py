"""From loaded objects to the report: a row for each object and one for each of its entities.

Objects are measured together by number of axes and voxel size, of which a batch has few; everything else is one plan
over all objects of a kind. Object rows hold the measurements of instances, distances and contacts as aligned lists.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelgrain.functions import expressions as ex
from voxelgrain.operators import contacts, distance, geometry, measure, report
from voxelgrain.operators.lineage import kept
from voxelgrain.sources.objects import Loaded


@dataclass(frozen=True)
class Settings:
    """What a report measures: the widest gap of a contact, which entities get skeletons, and colours by structure."""

    gap_um: float = 0.5
    skeleton_entities: frozenset[str] | None = None
    most_skeleton_voxels: int | None = None
    polar_spread: bool = True
    groups: tuple[str, ...] = ()
    palette: dict[str, str] = field(default_factory=dict)


@dataclass
class Measured:
    """What is measured of objects with one voxel size, as plain tables."""

    instances: DataFrame
    entities: DataFrame
    distances: DataFrame
    contacts: DataFrame


def origins(objects: DataFrame, masks: DataFrame, size: measure.Size, object_mask: str) -> DataFrame:
    """``object_id`` and ``centroid_<axis>_um``: where directions are measured from. The loader's centre, else the mask's, else nothing."""
    axes = measure.AXES[len(size)]
    own = measure.extent(masks.where(F.col("entity") == object_mask), ("object_id",), size).select("object_id", *(F.col(f"centroid_{a}_um").alias(f"mean_{a}") for a in axes))
    told = lambda a: F.col(f"object_center_{a}_um") if f"object_center_{a}_um" in objects.columns else F.lit(None).cast("double")
    return objects.join(own, "object_id", "left").select("object_id", *(F.coalesce(told(a), F.col(f"mean_{a}")).alias(f"centroid_{a}_um") for a in axes))


def instance_table(labels: DataFrame, centres: DataFrame, size: measure.Size, settings: Settings) -> DataFrame:
    """Every instance with its shape, skeleton, direction from the centre, and nearest neighbour of its entity."""
    by, dims = list(measure.INSTANCE), len(size)
    found = geometry.shapes(labels, measure.INSTANCE, size).drop("n_voxels")
    bones = geometry.skeletons(labels, size, settings.skeleton_entities, settings.most_skeleton_voxels).drop("skeleton")
    found = found.join(bones.withColumnRenamed("cable_length_um", "length_um"), by, "left")
    found = (measure.polarity if dims == 3 else measure.polarity_2d)(found, centres)
    if settings.polar_spread and dims == 3:
        found = found.join(measure.polar_spread(labels, centres, size), by, "left")
    return found.join(distance.nearest_same(found, measure.AXES[dims]), by, "left")


def entity_table(labels: DataFrame, masks: DataFrame, channels: DataFrame, size: measure.Size) -> DataFrame:
    """Every entity of every object, also one without a cell: its kind, number of instances (labels only) and extent; masks with their shape."""
    extent, bound, roundness = geometry.SIZES[len(size)]
    whole = ("object_id", "entity")
    sizes = measure.entity_sizes(labels, size).select(*whole, "instance_count", F.col("total_um3").alias(f"total_{extent}"))
    shapes = geometry.shapes(masks, whole, size).select(*whole, F.col(extent).alias("mask_total"), bound, roundness, "aspect_ratio")
    found = channels.join(sizes, list(whole), "left").join(shapes, list(whole), "left")
    is_label = F.col("entity_kind") == "label"
    count = F.when(is_label, F.coalesce("instance_count", F.lit(0).cast("long")))
    return found.withColumn("instance_count", count).withColumn(f"total_{extent}", F.coalesce(f"total_{extent}", "mask_total", F.lit(0.0))).drop("mask_total")


def measured(loaded: Loaded, objects: DataFrame, size: measure.Size, object_mask: str, settings: Settings) -> Measured:
    """All tables of the ``objects``, which have one voxel size."""
    cells = loaded.voxels.join(objects.select("object_id"), "object_id", "left_semi")
    dims = len(size)
    names = cells.groupBy("object_id", "entity").agg(F.max("kind").alias("found_kind"))
    told = objects.select("object_id", F.explode("channels").alias("key")).select("object_id", F.split("key", ":")[0].alias("told_kind"), F.split("key", ":")[1].alias("entity"))
    # A mask of several pieces has become a label; an entity without a cell is what its file says.
    channels = kept(told.join(names, ["object_id", "entity"], "left").select("object_id", "entity", F.coalesce("found_kind", "told_kind").alias("entity_kind")))
    labels = kept(cells.where("kind = 'label'").drop("kind"))
    masks = kept(cells.where("kind = 'mask'").select("object_id", "entity", "z", "y", "x"))
    centres = kept(origins(objects, masks, size, object_mask))
    # A plane is one cell thick for distances, which don't depend on how thick.
    solid = size if dims == 3 else (1.0, *size)
    far = distance.to_targets(labels, masks, solid, object_mask=object_mask, histogram=True, targets=channels.select("object_id", "entity"))
    owned = contacts.claim(labels, masks.where(F.col("entity") != object_mask))
    touching = contacts.edges(owned, settings.gap_um, size, measure.AXES[dims])
    return Measured(kept(instance_table(labels, centres, size, settings)), kept(entity_table(labels, masks, channels, size)), kept(far), kept(touching))


def report_rows(objects: DataFrame, found: Measured, size: measure.Size, object_mask: str, settings: Settings) -> DataFrame:
    """Object rows (``obs_level`` 0, with lists) and entity rows (1) of one kind of object."""
    extent = geometry.SIZES[len(size)][0]
    entities = found.entities
    of_mask = entities.where(F.col("entity") == object_mask).select("object_id", F.col(f"total_{extent}").alias(f"object_{extent}"))
    totals = measure.roll_up(entities.where("instance_count is not null"), ["instance_count"], []).select("object_id", "instance_count")
    instances = report.to_lists(found.instances, "object_id", [c for c in found.instances.columns if c not in ("object_id", "entity_kind")], ["entity", "label"], "instance_")
    far = found.distances.withColumn("hist_counts", F.to_json("bins")).drop("bins")
    distances = report.to_lists(far, "object_id", ["entity", "label", "target", "distance_um", "mean_distance_um", "hist_counts"], ["entity", "label", "target"], "distance_")
    order = found.contacts.withColumn("rank_a", F.coalesce("label_a", F.lit(-1))).withColumn("rank_b", F.coalesce("label_b", F.lit(-1)))
    touching = report.to_lists(order, "object_id", ["entity_a", "label_a", "entity_b", "label_b", "gap_um"], ["entity_a", "rank_a", "entity_b", "rank_b"], "contact_")
    counts = found.contacts.groupBy("object_id").agg(F.count("*").alias("contact_count"))
    rows = objects.withColumnRenamed("object_mask", "object_mask_name")
    for more in (of_mask, totals, instances, distances, touching, counts):
        rows = rows.join(more, "object_id", "left")
    rows = rows.withColumn("contact_count", F.coalesce("contact_count", F.lit(0).cast("long"))).withColumn("obs_level", F.lit(0))
    colours = F.create_map(*(F.lit(x) for kv in settings.palette.items() for x in kv)) if settings.palette else F.expr("cast(map() as map<string,string>)")
    parts = entities.withColumnRenamed("entity", "entity_name").withColumn("entity_colour", F.try_element_at(colours, F.lower("entity_name"))).withColumn("obs_level", F.lit(1))
    parts = parts.join(objects.select("object_id", "spatial_dims"), "object_id")
    both = rows.unionByName(parts, allowMissingColumns=True)
    folder = F.col("object_id")
    return both.withColumn("imported_path_short", ex.group_of(folder, list(settings.groups)))


def kinds(objects: DataFrame) -> list[measure.Size]:
    """The voxel sizes that occur: few, as a batch comes from few instruments."""
    found = objects.select("pixel_size_Z", "pixel_size_Y", "pixel_size_X").distinct().collect()
    return sorted(tuple(v for v in r if v is not None) for r in found)


def _of_size(objects: DataFrame, size: measure.Size) -> DataFrame:
    z, y, x = size if len(size) == 3 else (None, *size)
    return objects.where(F.col("pixel_size_Z").eqNullSafe(F.lit(z)) & (F.col("pixel_size_Y") == y) & (F.col("pixel_size_X") == x))


def process(loaded: Loaded, object_mask: str, settings: Settings | None = None, done: DataFrame | None = None) -> DataFrame | None:
    """The report's rows of all loaded objects but those that are ``done``; nothing if no object is left."""
    settings = settings or Settings()
    left = loaded.objects if done is None else loaded.objects.join(done.select("object_id").distinct(), "object_id", "left_anti")
    tables = []
    for size in kinds(left):
        objects = kept(_of_size(left, size))
        tables.append(report_rows(objects, measured(loaded, objects, size, ex.normal_name(object_mask), settings), size, ex.normal_name(object_mask), settings))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables) if tables else None


def geometry_tables(loaded: Loaded, object_mask: str, settings: Settings | None = None, options: geometry.Options | None = None) -> list[DataFrame]:
    """Geometry rows, a table for each voxel size."""
    settings, name, tables = settings or Settings(), ex.normal_name(object_mask), []
    for size in kinds(loaded.objects):
        objects = _of_size(loaded.objects, size)
        cells = kept(loaded.voxels.join(objects.select("object_id"), "object_id", "left_semi"))
        labels = cells.where("kind = 'label'").drop("kind")
        masks = cells.where("kind = 'mask'").select("object_id", "entity", "z", "y", "x")
        touching = contacts.edges(contacts.claim(labels, masks.where(F.col("entity") != name)), settings.gap_um, size, measure.AXES[len(size)])
        tables.append(kept(geometry.geometry_rows(labels, masks, size, name, touching, options)))
    return tables


def run(spark: SparkSession, root: str, out: str, object_mask: str, voxel_size: tuple[float, ...] | None = None, settings: Settings | None = None, clip: bool = True, promote: bool = True, resume: bool = False, with_geometry: bool = False) -> DataFrame:
    """Measures everything below ``root``, keeps each object's rows in ``out``/parts as a retry may need them, writes ``out``/report, and gives the failures.

    With ``resume``, objects that an earlier run kept are not measured again. The parts go once a run had no failure.
    """
    from voxelgrain.sources import objects as sources
    from voxelgrain.sources import report_files

    loaded = sources.load(spark, root, object_mask, voxel_size, clip, promote)
    parts = f"{out}/parts"
    done = report_files.finished(spark, parts) if resume else None
    if not resume:
        report_files.discard_parts(spark, parts)
    rows = process(loaded, object_mask, settings, done)
    if rows is not None:
        report_files.write_parts(rows, parts)
    whole = report_files.finished(spark, parts)
    failures = kept(loaded.failures)
    n_failed = failures.count()
    if whole is not None:
        facts = {"object_mask": object_mask, "root": root, "n_failed": str(n_failed)}
        report_files.write_report(whole, f"{out}/report", facts=facts)
        if not n_failed:
            report_files.discard_parts(spark, parts)
    if with_geometry:
        for k, table in enumerate(geometry_tables(loaded, object_mask, settings)):
            report_files.write_geometry(table, f"{out}/geometry/size={k}")
    return failures
