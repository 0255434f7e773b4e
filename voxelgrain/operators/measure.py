"""Measurement: aggregations over voxel rows (``object_id, entity, label, z, y, x``).

Background has no rows, so sizes, centres and shapes are grouped aggregates, combined before the shuffle.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelgrain.functions.expressions import clamp_unit, direction, direction_2d
from voxelgrain.operators import groups

Size = tuple[float, ...]
AXES = {3: ("z", "y", "x"), 2: ("y", "x")}
INSTANCE = ("object_id", "entity", "label")


def extent(voxels: DataFrame, by: tuple[str, ...], size: Size, name: str = "volume_um3") -> DataFrame:
    """Voxels, extent and centroid (micrometres) of every group."""
    axes = AXES[len(size)]
    centre = [(F.avg(a) * s).alias(f"centroid_{a}_um") for a, s in zip(axes, size, strict=True)]
    return voxels.groupBy(*by).agg(F.count("*").alias("n_voxels"), (F.count("*") * math.prod(size)).alias(name), *centre)


def entity_sizes(voxels: DataFrame, size: Size) -> DataFrame:
    """Instances and total extent of every entity of every object."""
    return voxels.groupBy("object_id", "entity").agg(F.countDistinct("label").alias("instance_count"), (F.count("*") * math.prod(size)).alias("total_um3"))


def roll_up(entities: DataFrame, summed: list[str], passed: list[str]) -> DataFrame:
    """Entity rows to object rows: sums (null if nothing is known), and other values only where there is one row to take them from."""
    one = [F.when(F.count("*") == 1, F.first(c)).alias(c) for c in passed]
    return entities.groupBy("object_id").agg(F.count("*").alias("n_entities"), *(F.sum(c).alias(c) for c in summed), *one)


def polarity(instances: DataFrame, centres: DataFrame) -> DataFrame:
    """Instances (3D) with the direction from their object's centre."""
    centres = centres.select("object_id", *(F.col(f"centroid_{a}_um").alias(f"origin_{a}") for a in "zyx"))
    offset = [F.col(f"centroid_{a}_um") - F.col(f"origin_{a}") for a in "zyx"]
    return instances.join(centres, "object_id", "left").withColumn("polar", direction(*offset)).select(*instances.columns, "polar.*")


def polarity_2d(regions: DataFrame, centres: DataFrame) -> DataFrame:
    centres = centres.select("object_id", *(F.col(f"centroid_{a}_um").alias(f"origin_{a}") for a in "yx"))
    offset = [F.col(f"centroid_{a}_um") - F.col(f"origin_{a}") for a in "yx"]
    return regions.join(centres, "object_id", "left").withColumn("polar", direction_2d(*offset)).select(*regions.columns, "polar.*")


def polar_spread(voxels: DataFrame, centres: DataFrame, size: Size) -> DataFrame:
    """Standard deviation of the angle between each voxel's direction and the mean one, by instance; null below three voxels off the centre."""
    centres = centres.select("object_id", *(F.col(f"centroid_{a}_um").alias(f"origin_{a}") for a in "zyx"))
    joined = voxels.join(centres, "object_id")
    for a, s in zip("zyx", size, strict=True):
        joined = joined.withColumn(f"d{a}", F.col(a) * s - F.col(f"origin_{a}"))
    r = F.sqrt(F.col("dz") ** 2 + F.col("dy") ** 2 + F.col("dx") ** 2)
    joined = joined.withColumn("r", r)
    unit = joined.where("r > 0").select(*INSTANCE, *((F.col(f"d{a}") / F.col("r")).alias(f"u{a}") for a in "zyx"))
    mean = unit.groupBy(*INSTANCE).agg(*(F.avg(f"u{a}").alias(f"m{a}") for a in "zyx"), F.count("*").alias("n"))
    length = F.sqrt(F.col("mz") ** 2 + F.col("my") ** 2 + F.col("mx") ** 2)
    mean = mean.withColumn("length", length)
    # Directions that cancel out have no mean; every one counts as at a right angle to it.
    dot = F.when(F.col("length") > 0, (F.col("uz") * F.col("mz") + F.col("uy") * F.col("my") + F.col("ux") * F.col("mx")) / F.col("length")).otherwise(F.lit(0.0))
    angle = F.degrees(F.acos(clamp_unit(dot)))
    found = unit.join(mean, list(INSTANCE)).groupBy(*INSTANCE).agg(F.when(F.max("n") >= 3, F.stddev_pop(angle)).alias("polar_spread_deg"))
    return voxels.select(*INSTANCE).distinct().join(found, list(INSTANCE), "left")


def half_directions(dims: int) -> list[tuple[int, ...]]:
    """One of each pair of opposite neighbour steps: 13 in 3D, 4 in 2D."""
    return [d for d in itertools.product((-1, 0, 1), repeat=dims) if d > (0,) * dims]


#: The share of directions that axes, face and space diagonals stand for, on an isotropic grid.
WEIGHTS = {1: 0.0915557824, 2: 0.0739612558, 3: 0.0703912796}


def boundary_terms(size: Size) -> list[tuple]:
    """Half the directions, and what a voxel with an open end there adds to the boundary."""
    dims, terms = len(size), []
    for d in half_directions(dims):
        step = math.sqrt(sum((k * s) ** 2 for k, s in zip(d, size, strict=True)))
        weight = 4 * WEIGHTS[sum(map(abs, d))] if dims == 3 else math.pi / 4
        terms.append((*d, weight * math.prod(size) / step))
    return terms


def boundary(voxels: DataFrame, by: tuple[str, ...], size: Size) -> DataFrame:
    """Crofton boundary (surface or perimeter) of every group of voxels; ``by`` ends with what tells instances of one entity apart.

    For each direction it counts the voxels whose neighbour belongs to another instance or to none: one equi-join
    of shifted voxels with the voxels, no geometry in Python.
    """
    dims = len(size)
    axes = AXES[dims]
    terms = boundary_terms(size)
    schema = [*(f"d{a}" for a in axes), "term"]
    shifts = F.explode(F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(t, schema, strict=True))) for t in terms)))
    moved = voxels.select(*by, *axes, shifts.alias("s")).select(*by, *((F.col(a) + F.col(f"s.d{a}")).alias(a) for a in axes), F.col("s.term").alias("term"))
    neighbours = voxels.select(*(F.col(c).alias(f"of_{c}") for c in by), *(F.col(a).alias(f"of_{a}") for a in axes))
    same = [F.col(c) == F.col(f"of_{c}") for c in (*by, *axes)]
    name = "surface_um2" if dims == 3 else "perimeter_um"
    open_ends = moved.join(neighbours, same, "left_anti")
    return open_ends.groupBy(*by).agg(F.sum("term").alias(name))


def covariances(size: Size) -> list[Column]:
    axes = AXES[len(size)]
    scaled = [F.col(a) * s for a, s in zip(axes, size, strict=True)]
    return [(F.covar_pop(scaled[i], scaled[j])).alias(f"c{axes[i]}{axes[j]}") for i in range(len(axes)) for j in range(i, len(axes))]


def covariance(voxels: DataFrame, by: tuple[str, ...], size: Size) -> DataFrame:
    return voxels.groupBy(*by).agg(*covariances(size))


def _ratio(high: Column, low: Column) -> Column:
    return F.when(low > high * 1e-9, F.sqrt(high / low))


def with_aspect_ratio(c: DataFrame, dims: int) -> DataFrame:
    """``c``, whose covariances are replaced by the longest over the shortest principal axis; null for what is a line or a point.

    In space from the closed-form eigenvalues of a symmetric 3x3 matrix.
    """
    others = [n for n in c.columns if n not in {f"c{a}{b}" for a in "zyx" for b in "zyx"}]
    if dims == 2:
        half, spread = (F.col("cyy") + F.col("cxx")) / 2, F.sqrt(((F.col("cyy") - F.col("cxx")) / 2) ** 2 + F.col("cyx") ** 2)
        return c.select(*others, _ratio(half + spread, half - spread).alias("aspect_ratio"))
    c = c.withColumn("q", (F.col("czz") + F.col("cyy") + F.col("cxx")) / 3)
    p = F.sqrt(((F.col("czz") - F.col("q")) ** 2 + (F.col("cyy") - F.col("q")) ** 2 + (F.col("cxx") - F.col("q")) ** 2 + 2 * (F.col("czy") ** 2 + F.col("czx") ** 2 + F.col("cyx") ** 2)) / 6)
    c = c.withColumn("p", p)
    a, b, d = ((F.col(k) - F.col("q")) / F.col("p") for k in ("czz", "cyy", "cxx"))
    e, f, g = (F.col(k) / F.col("p") for k in ("czy", "czx", "cyx"))
    det = a * (b * d - g * g) - e * (e * d - g * f) + f * (e * g - b * f)
    c = c.withColumn("phi", F.when(F.col("p") > 0, F.acos(clamp_unit(det / 2)) / 3))
    high = F.col("q") + 2 * F.col("p") * F.cos("phi")
    low = F.col("q") + 2 * F.col("p") * F.cos(F.col("phi") + 2 * math.pi / 3)
    return c.select(*others, F.when(F.col("p") == 0, F.when(F.col("q") > 0, 1.0)).otherwise(_ratio(high, low)).alias("aspect_ratio"))


def aspect_ratio_2d(voxels: DataFrame, by: tuple[str, ...], size: Size) -> DataFrame:
    return with_aspect_ratio(covariance(voxels, by, size), 2)


def aspect_ratio_3d(voxels: DataFrame, by: tuple[str, ...], size: Size) -> DataFrame:
    return with_aspect_ratio(covariance(voxels, by, size), 3)


def box_cells(dims: int) -> Column:
    return math.prod((F.max(a) - F.min(a) + 1 for a in AXES[dims]), start=F.lit(1)).cast("long").alias("bbox_cells")


def fill_ratio(voxels: DataFrame, by: tuple[str, ...], dims: int = 3) -> DataFrame:
    """Voxels, bounding-box cells, and their ratio."""
    return voxels.groupBy(*by).agg(F.count("*").alias("n_voxels"), box_cells(dims)).withColumn("fill_ratio", F.col("n_voxels") / F.col("bbox_cells"))


def clip(voxels: DataFrame, mask: DataFrame) -> DataFrame:
    """Voxels inside the mask.

    A mask that is drawn, rather than read, looks far smaller to the planner than it is, so it is never broadcast.
    """
    return voxels.join(mask.hint("merge"), ["object_id", "z", "y", "x"], "left_semi")


def crop(voxels: DataFrame, mask: DataFrame) -> DataFrame:
    """Voxels inside the mask's bounding box, with coordinates relative to it; objects without a mask stay as they are."""
    box = mask.groupBy("object_id").agg(*(f(a).alias(f"{n}_{a}") for a in "zyx" for f, n in ((F.min, "low"), (F.max, "high"))))
    joined = voxels.join(box, "object_id", "left")
    for a in "zyx":
        joined = joined.where(F.col(f"low_{a}").isNull() | F.col(a).between(F.col(f"low_{a}"), F.col(f"high_{a}"))).withColumn(a, F.col(a) - F.coalesce(F.col(f"low_{a}"), F.lit(0)))
    return joined.select(*voxels.columns)


def connected(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` nodes the smallest one that the links between ``a`` and ``b`` lead to: roots hang on smaller roots, and paths are halved."""
    root = np.arange(n)
    while len(a):
        one, two = root[a], root[b]
        apart = one != two
        a, b, one, two = a[apart], b[apart], one[apart], two[apart]
        np.minimum.at(root, np.maximum(one, two), np.minimum(one, two))
        while (root[root] != root).any():
            root = root[root]
    return root


def component_labels(cells: np.ndarray, group: np.ndarray | None = None) -> np.ndarray:
    """Component of every cell (rows of coordinates), all neighbours counting, numbered from 1 in raster order of first cells.

    With ``group``, which numbers groups from 0 and doesn't fall, each group has components of its own.
    """
    if not len(cells):
        return np.zeros(0, int)
    if group is None:
        group = np.zeros(len(cells), np.int64)
    begins = groups.starts(group)
    cells = cells - np.minimum.reduceat(cells, begins, axis=0)[group - group[0]] + 1
    shape = tuple((cells.max(axis=0) + 2).tolist())
    if math.prod(shape) > 2**62 // len(begins) and len(begins) > 1:
        return np.concatenate([component_labels(cells[i:j]) for i, j in zip(begins, [*begins[1:], len(cells)], strict=True)])
    keys = (group - group[0]) * math.prod(shape) + np.ravel_multi_index(tuple(cells.T), shape)
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    links = []
    for d in half_directions(cells.shape[1]):
        step = int(np.dot(d, [math.prod(shape[k + 1 :]) for k in range(len(shape))]))
        place = np.minimum(np.searchsorted(ranked, ranked + step), len(ranked) - 1)
        hit = np.flatnonzero(ranked[place] == ranked + step)
        links.append((hit, place[hit]))
    roots = connected(len(cells), np.concatenate([x for x, _ in links]), np.concatenate([y for _, y in links]))
    # Cells in order stand group by group, so components are numbered through, and a group's first one is the least.
    numbered = np.unique(roots, return_inverse=True)[1]
    out = np.empty(len(cells), int)
    out[order] = numbered - numbered[begins][group - group[0]] + 1
    return out


def components(cells: DataFrame, axes: tuple[str, ...] = ("y", "x"), count: bool = False) -> DataFrame:
    """``cells`` (``object_id, entity`` and the axes) with their component's number in ``label``. One mask is one group.

    With ``count``, every cell tells how many components its mask has, in ``components``.
    """
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in cells.schema] + ["label int"] + ["components int"] * count)

    def run(table: pa.Table) -> pa.Table:
        begins = groups.starts(groups.codes(table.column("object_id"))[0], groups.codes(table.column("entity"))[0])
        group = groups.within(begins, table.num_rows)
        label = component_labels(np.stack([groups.numbers(table.column(a)) for a in axes], 1), group)
        table = table.append_column("label", pa.array(label, pa.int32()))
        return table.append_column("components", pa.array(np.maximum.reduceat(label, begins)[group], pa.int32())) if count else table

    return groups.by_group(cells, ("object_id", "entity"), run, schema)


def promote(masks: DataFrame, axes: tuple[str, ...] = ("z", "y", "x"), object_mask: str | None = None) -> DataFrame:
    """Masks with several components become label entities: ``kind`` and ``label`` are set; others stay masks with a null label, the ``object_mask`` always."""
    found = components(masks, axes, count=True)
    several = F.col("components") > 1
    if object_mask is not None:
        several = several & (F.col("entity") != object_mask)
    return found.select(*masks.columns, F.when(several, "label").otherwise("mask").alias("kind"), F.when(several, F.col("label")).alias("label"))
