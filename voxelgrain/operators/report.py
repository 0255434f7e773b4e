"""The report: list columns and back, distributions, ranks, joint reach, and the overview of a batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelgrain.functions.expressions import finite

PROBABILITIES = tuple(i / 50 for i in range(51))


def to_lists(rows: DataFrame, key: str, columns: list[str], order: list[str], prefix: str) -> DataFrame:
    """Rows as parallel list columns, one report row by ``key``; a list without any value is null."""
    packed = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, F.struct(*(c for c in columns)).alias("row")))).alias("rows"))
    pick = lambda c: F.transform("rows", lambda r: r["row"][c])
    lists = {c: pick(c) for c in columns}
    kept = lambda x: F.when(F.exists(x, lambda v: v.isNotNull()), x)
    return packed.select(key, *(kept(x).alias(f"{prefix}{c}") for c, x in lists.items()))


def unnest(report: DataFrame, keep: list[str], lists: list[str], lead: str) -> DataFrame:
    """Parallel lists as rows, aligned; a null or short list gives nulls. ``lead`` is a list that has every entry."""
    n = F.size(lead)
    padded = [F.when(F.col(c).isNull(), F.array_repeat(F.lit(None).cast(report.schema[c].dataType.elementType), n)).otherwise(F.col(c)).alias(c) for c in lists]
    return report.where(F.col(lead).isNotNull()).select(*keep, *padded).select(*keep, F.inline(F.arrays_zip(*lists)))


def distinct_values(rows: DataFrame, value: Column) -> DataFrame:
    return rows.select(value.alias("value")).where("value is not null").distinct()


def measured(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """Rows with a finite value, by metric."""
    counts = rows.agg(*(F.count(finite(F.col(m).cast("double"))).alias(m) for m in metrics))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("n")) for m in metrics))).alias("r")).select("r.*")


def one_per_category(rows: DataFrame, category: list[str], value: str) -> DataFrame:
    return rows.groupBy(*category).agg(F.count(value).alias("n")).agg(F.max("n").alias("most"))


def distribution(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    v = finite(F.col(value))
    return rows.groupBy(*by).agg(F.count(v).alias("n"), F.min(v).alias("low"), F.max(v).alias("high"), F.median(v).alias("median"), F.stddev_samp(v).alias("sd"))


def rank_sums(rows: DataFrame, category: str, value: str, within: list[str]) -> DataFrame:
    """Mid-rank sum and size of every category. Ranks come from the counts of distinct values, so only these are ordered."""
    known = rows.where(finite(F.col(value)).isNotNull()).groupBy(*within, category, value).agg(F.count("*").alias("times"))
    by_value = known.groupBy(*within, value).agg(F.sum("times").alias("tied"))
    w = Window.partitionBy(*within).orderBy(value)
    ranks = by_value.withColumn("rank", F.sum("tied").over(w) - F.col("tied") + (F.col("tied") + 1) / 2).drop("tied")
    joined = known.join(ranks, [*within, value])
    return joined.groupBy(*within, category).agg(F.sum(F.col("rank") * F.col("times")).alias("rank_sum"), F.sum("times").alias("n"))


def mann_whitney(rows: DataFrame, category: str, value: str, within: list[str]) -> DataFrame:
    """U and z of every two categories, over the ranks among those two alone."""
    known = rows.where(finite(F.col(value)).isNotNull()).groupBy(*within, category, value).agg(F.count("*").alias("times"))
    names = known.select(*within, category).distinct()
    a = names.withColumnRenamed(category, "cat_a")
    pairs = a.join(names.withColumnRenamed(category, "cat_b"), within).where("cat_a < cat_b")
    each = pairs.join(known, within).where((F.col(category) == F.col("cat_a")) | (F.col(category) == F.col("cat_b")))
    by_value = each.groupBy(*within, "cat_a", "cat_b", value).agg(F.sum("times").alias("tied"), F.sum(F.when(F.col(category) == F.col("cat_a"), F.col("times"))).alias("first"))
    w = Window.partitionBy(*within, "cat_a", "cat_b").orderBy(value)
    ranked = by_value.withColumn("rank", F.sum("tied").over(w) - F.col("tied") + (F.col("tied") + 1) / 2)
    sums = ranked.groupBy(*within, "cat_a", "cat_b").agg(F.sum(F.col("rank") * F.col("first")).alias("rank_sum"), F.sum("first").alias("n1"), (F.sum("tied") - F.sum("first")).alias("n2"))
    u = F.col("rank_sum") - F.col("n1") * (F.col("n1") + 1) / 2
    sigma = F.sqrt(F.col("n1") * F.col("n2") * (F.col("n1") + F.col("n2") + 1) / 12.0)
    return sums.withColumn("u", u).withColumn("z", F.try_divide(F.col("u") - F.col("n1") * F.col("n2") / 2.0, sigma))


def reach(distances: DataFrame) -> DataFrame:
    """For each instance and two targets: the distance within which it has both."""
    known = distances.where("distance_um is not null and object_id is not null and entity is not null and label is not null and target is not null")
    # An instance has few targets, so they meet in a list: distances are made once.
    listed = known.groupBy("object_id", "entity", "label").agg(F.sort_array(F.collect_list(F.struct("target", "distance_um"))).alias("d"))
    first = listed.where(F.size("d") > 1).select("object_id", "entity", "label", "d", F.explode("d").alias("a"))
    pairs = first.select("object_id", "entity", "label", "a", F.explode(F.filter("d", lambda x: x["target"] > F.col("a.target"))).alias("b"))
    return pairs.select("object_id", "entity", "label", F.col("a.target").alias("target_a"), F.col("b.target").alias("target_b"), F.greatest("a.distance_um", "b.distance_um").alias("reach_um"))


def reach_curve(reached: DataFrame, groups: DataFrame) -> DataFrame:
    """Exact quantiles of the reach at 51 probabilities, by entity, targets and condition: one pass, no curve of raw points."""
    joined = reached.join(groups, "object_id")
    curves = joined.groupBy("entity", "target_a", "target_b", "grp").agg(F.count("*").alias("n"), F.percentile("reach_um", F.array(*map(F.lit, PROBABILITIES))).alias("curve"))
    return curves.select("entity", "target_a", "target_b", "grp", "n", F.posexplode("curve").alias("i", "reach_um")).select("entity", "target_a", "target_b", "grp", "n", (F.col("i") / 50.0).alias("probability"), "reach_um")


def reach_pair_count(distances: DataFrame) -> DataFrame:
    n = distances.where(F.col("distance_um").isNotNull()).groupBy("entity").agg(F.countDistinct("target").alias("targets"))
    return n.withColumn("pairs", F.expr("targets * (targets - 1) div 2"))


def presence(objects: DataFrame, structures: DataFrame, entities: DataFrame) -> DataFrame:
    """Every object against every structure: ``missing`` tells an absent one from a mask, whose count is null."""
    rows = entities.select("object_id", "entity", "instance_count", F.lit(True).alias("there"))
    grid = objects.select("object_id").crossJoin(structures.select("entity").distinct())
    return grid.join(rows, ["object_id", "entity"], "left").select("object_id", "entity", F.col("there").isNull().alias("missing"), "instance_count")


def structure_gaps(grid: DataFrame) -> DataFrame:
    return grid.groupBy("entity").agg(F.count_if("missing").alias("missing_in")).where("missing_in > 0")


def composition(entities: DataFrame, sizes: DataFrame, object_mask: str) -> DataFrame:
    """Share of the object that every structure takes, with what is assigned and what is left."""
    part = entities.where((F.col("entity") != object_mask) & (F.col("total_um3") > 0)).join(sizes, "object_id")
    part = part.withColumn("fraction", F.col("total_um3") / F.col("object_um3"))
    total = part.groupBy("object_id").agg(F.sum("fraction").alias("assigned")).withColumn("unassigned", F.greatest(F.lit(0.0), 1 - F.col("assigned")))
    return part.select("object_id", "entity", "fraction").join(total, "object_id")


def overview(entities: DataFrame) -> DataFrame:
    """Objects, structures, labelled structures, instances, and structures whose counts differ or that some object lacks."""
    objects = entities.select("object_id").distinct().agg(F.count("*").alias("objects"))
    by_entity = entities.groupBy("entity").agg(F.count("*").alias("present"), F.count("instance_count").alias("labelled"), F.sum("instance_count").alias("instances"))
    rows = by_entity.crossJoin(objects)
    return rows.agg(
        F.max("objects").alias("objects"), F.count("*").alias("structures"), F.count_if(F.col("labelled") > 0).alias("labelled"),
        F.sum("instances").alias("instances"), F.count_if(F.col("present") < F.col("objects")).alias("uneven"),
    )


def mixed_dims(rows: DataFrame) -> DataFrame:
    """Objects by number of dimensions; nothing if all have the same."""
    counts = rows.groupBy("spatial_dims").agg(F.count("*").alias("objects"))
    kinds = counts.agg(F.count("*").alias("kinds"))
    return counts.crossJoin(kinds).where("kinds > 1").drop("kinds")


def short_labels(ids: DataFrame, name: str = "id") -> DataFrame:
    """Ids without the fields, split at ``_``, that all share at the front and then at the back.

    The first id, in order of its fields, keeps one field at least; one that would keep none stays whole. A lone id stays
    whole, and so do all if one of them is a single field.
    """
    split = ids.select(F.col(name).alias("id"), F.split(name, "_").alias("f"))
    # What all share at an end shows in the smallest and the largest list alone.
    ends = split.agg(F.min("f").alias("a"), F.max("f").alias("b"), F.min(F.reverse("f")).alias("c"), F.max(F.reverse("f")).alias("d"), F.min(F.size("f")).alias("least"), (F.min("id") == F.max("id")).alias("lone"))
    differs = lambda x, y: F.array_position(F.transform(F.arrays_zip(F.col(x).alias("p"), F.col(y).alias("q")), lambda z: z["p"].eqNullSafe(z["q"]).cast("int")), 0)
    common = lambda x, y: F.when(differs(x, y) > 0, differs(x, y) - 1).otherwise(F.size(x).cast("long"))
    kept = (F.col("least") > 1) & ~F.col("lone")
    ends = ends.select("a", common("c", "d").alias("back"), F.when(kept, F.least(common("a", "b"), F.size("a") - 1)).otherwise(F.lit(0)).alias("front"), kept.alias("kept"))
    ends = ends.select("front", F.when(F.col("kept"), F.least("back", F.size("a") - 1 - F.col("front"))).otherwise(F.lit(0)).alias("back"))
    rows = split.crossJoin(ends)
    left = F.greatest(F.size("f") - F.col("front") - F.col("back"), F.lit(0)).cast("int")
    short = F.array_join(F.slice("f", (F.col("front") + 1).cast("int"), left), "_")
    return rows.select("id", F.when(short == "", F.col("id")).otherwise(short).alias("short"))


def largest(rows: DataFrame, size: str, k: int, ascending: bool = False) -> DataFrame:
    """The ``k`` rows with the largest (or smallest) finite ``size``; ties go by the other columns."""
    rest = [F.col(c) for c in rows.columns if c != size]
    known = rows.where(finite(F.col(size)).isNotNull())
    return known.orderBy(F.asc(size) if ascending else F.desc(size), *rest).limit(k)


def largest_by_entity(rows: DataFrame, by: str, size: str, k: int, tie: list[str]) -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc_nulls_last(size), *tie)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def sample(rows: DataFrame, key: list[str], k: int, seed: int = 0) -> DataFrame:
    """``k`` rows, by a hash of their key: the same for the same seed, whatever the partitions."""
    return rows.orderBy(F.xxhash64(F.lit(seed), *key), *key).limit(k)


def gallery_size(columns: int, rows: int = 4, most: int = 120) -> int:
    """Whole rows of thumbnails: at most ``most``, cut down to a multiple of ``columns``."""
    return max(columns, min(most - most % columns, columns * rows))


def prune_all_null(rows: DataFrame) -> DataFrame:
    """``rows`` without the columns that hold nothing."""
    counts = rows.agg(*(F.count(F.col(f"`{c}`")).alias(c) for c in rows.columns)).first()
    return rows.select(*(F.col(f"`{c}`") for c in rows.columns if counts[c]))


def as_float32(rows: DataFrame) -> DataFrame:
    """Doubles and lists of doubles as 32-bit floats, for the sink."""
    kinds = {"double": "float", "array<double>": "array<float>"}
    return rows.select(*(F.col(f"`{f.name}`").cast(kinds[t]).alias(f.name) if (t := f.dataType.simpleString()) in kinds else F.col(f"`{f.name}`") for f in rows.schema))


def object_coverage(objects: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """How many objects there are, and how many of them each part says something of."""
    joined = objects.select("object_id")
    for name, rows in parts.items():
        joined = joined.join(rows.select(F.col("object_id").alias(f"of_{name}")).distinct(), F.col("object_id") == F.col(f"of_{name}"), "left")
    return joined.agg(F.count("*").alias("objects"), *(F.count(f"of_{name}").alias(name) for name in parts))


def ordered_objects(objects: DataFrame, groups: list[str]) -> DataFrame:
    """Objects with the rank of their group (those not named last) and their place in it: the order in which they are shown."""
    rank = F.coalesce(*(F.when(F.col("grp") == g, F.lit(k)) for k, g in enumerate(groups)), F.lit(len(groups)))
    return objects.select("*", rank.alias("rank"), F.row_number().over(Window.partitionBy("grp").orderBy("object_id")).alias("place"))


def object_level(report: DataFrame) -> DataFrame:
    """A report's rows of objects."""
    return report.where("obs_level = 0")


def entity_level(report: DataFrame) -> DataFrame:
    """A report's rows of entities."""
    return report.where("obs_level = 1 and entity_name is not null")


#: Metrics by the number of dimensions: those of space have no meaning in the plane.
METRICS = {3: ("volume_um3", "surface_um2", "sphericity", "elevation_deg"), 2: ("area_um2", "perimeter_um", "circularity")}


def vocabulary(columns: list[str]) -> dict[str, str]:
    """What a report with these columns calls an extent: volume in space; area in the plane, if that is all it has."""
    planar = "total_volume_um3" not in columns and "total_area_um2" in columns
    name, unit = ("area", "um2") if planar else ("volume", "um3")
    return {"object": f"object_{name}_{unit}", "total": f"total_{name}_{unit}", "noun": name, "unit": unit}


def metrics_of(columns: list[str], prefix: str = "instance_") -> list[str]:
    """The metrics to offer, in order, of those that a report's columns have; in the plane without those of space."""
    dims = 2 if vocabulary(columns)["noun"] == "area" else 3
    common = ("aspect_ratio", "branches", "length_um", "tortuosity", "nearest_um", "polar_spread_deg")
    return [m for m in (*METRICS[dims], *common) if f"{prefix}{m}" in columns]
