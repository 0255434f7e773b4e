"""Distances from instances to structures.

An object is the unit: its voxels meet in one task, are laid out on the object's own grid, and one exact Euclidean
distance transform for each target gives the distances of all its instances at once. The transform goes axis by axis: a
scan along the first, then, along short axes, each step for the whole grid at a time until none so long can help, and
along long ones the lower envelope of parabolas, for many lines at a time, in proportion to the grid; the last axis only
where an instance is. Memory is the grid (nine bytes a cell, a few times) and ``BLOCK_CELLS`` of lines, whatever the
number of targets: on small grids some are made together, on large ones they follow one another.
"""

from __future__ import annotations

import itertools
import json
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelgrain.operators import groups
from voxelgrain.operators.lineage import kept
from voxelgrain.operators.measure import Size

BINS = 20
MASK_LABEL = 0
#: Labels of rows that only name an entity.
NAME_LABEL = -1
#: How much wider cells get when nothing was found near enough.
WIDER = 4


#: Cells of the lines whose envelopes are made at a time, and of the grids of several targets.
BLOCK_CELLS = 4_000_000
#: Lines up to which every step along them is tried, for whole grids at a time, rather than their envelopes made.
SHORT_LINE = 128
#: Cells of a target up to which each of them is held against the whole grid.
FEW_CELLS = 40


def _scan(target: np.ndarray, step: float) -> np.ndarray:
    """Squared distance to the nearest target along the first axis."""
    n = len(target)
    at = np.arange(n, dtype=np.int32).reshape(-1, *[1] * (target.ndim - 1))
    far = np.int32(2 * n + 1)
    before = np.maximum.accumulate(np.where(target, at, -far), axis=0)
    after = np.minimum.accumulate(np.where(target, at, 2 * far)[::-1], axis=0)[::-1]
    cells = np.minimum(at - before, after - at)
    return np.where(cells <= n, (cells * step) ** 2, np.inf)


def _envelope(lines: np.ndarray, step: float) -> np.ndarray:
    """For every line (row) of squared distances, the least over all places of that place's value and the squared way to it."""
    rows, n = lines.shape
    if n == 1:
        return lines.copy()
    places = np.arange(n) * step
    hull = np.zeros((rows, n), np.int32)
    begins = np.full((rows, n + 1), np.inf)
    top = np.full(rows, -1)
    for q in range(n):
        open_rows = np.flatnonzero(np.isfinite(lines[:, q]))
        while len(open_rows):
            last = top[open_rows]
            some = last >= 0
            p = hull[open_rows, np.maximum(last, 0)]
            with np.errstate(divide="ignore", invalid="ignore"):
                meet = (lines[open_rows, q] + places[q] ** 2 - lines[open_rows, p] - places[p] ** 2) / (2 * (places[q] - places[p]))
            hidden = some & (meet <= begins[open_rows, np.maximum(last, 0)])
            lies = open_rows[~hidden]
            top[lies] += 1
            hull[lies, top[lies]] = q
            begins[lies, top[lies]] = np.where(some, meet, -np.inf)[~hidden]
            open_rows = open_rows[hidden]
            top[open_rows] -= 1
    at, out, every = np.zeros(rows, np.int64), np.full((rows, n), np.inf), np.arange(rows)
    filled = every[top >= 0]
    if not len(filled):
        return out
    end = top[filled]
    for q in range(n):
        ahead = filled
        while len(ahead):
            ahead = ahead[(at[ahead] < top[ahead]) & (begins[ahead, np.minimum(at[ahead] + 1, n)] < places[q])]
            at[ahead] += 1
        # Neighbours on the hull as well: where parabolas meet, rounding may have taken the other one.
        best = np.full(len(filled), np.inf)
        for k in (-1, 0, 1):
            p = hull[filled, np.clip(at[filled] + k, 0, end)]
            best = np.minimum(best, lines[filled, p] + ((q - p) * step) ** 2)
        out[filled, q] = best
    return out


def _shifted(squared: np.ndarray, step: float, upto: float = math.inf) -> np.ndarray:
    """The same along axis 1 of ``(grids, axis, rest)``, by looking one step farther each time, until no step that long can help."""
    out, moved, n = squared.copy(), np.empty_like(squared), squared.shape[1]
    for k in range(1, n):
        way = (k * step) ** 2
        if way > upto:
            break
        # What is known only gets less, so it is enough to look now and then.
        if k % 4 == 1 and way >= out.max():
            break
        np.add(squared, way, out=moved)
        np.minimum(out[:, k:], moved[:, :-k], out=out[:, k:])
        np.minimum(out[:, :-k], moved[:, k:], out=out[:, :-k])
    return out


def _transforms(targets: np.ndarray, size: Size, wanted: np.ndarray | None = None, upto: float = math.inf) -> np.ndarray:
    """The distance transform of several grids, one after the other along the first axis."""
    # A grid without a cell would keep the others looking.
    some = targets.reshape(len(targets), -1).any(axis=1)
    if not some.all():
        out = np.full(targets.shape, np.inf)
        if some.any():
            out[some] = _transforms(targets[some], size, wanted, upto)
        return out
    squared = np.moveaxis(_scan(np.moveaxis(targets, 1, 0), size[0]), 0, 1)
    for axis in range(1, targets.ndim - 1):
        shape, n = squared.shape, squared.shape[axis + 1]
        if n <= SHORT_LINE:
            lines = np.ascontiguousarray(squared.reshape(math.prod(shape[: axis + 1]), n, -1))
            block = max(1, BLOCK_CELLS // 16 // (n * lines.shape[2]))
            squared = np.concatenate([_shifted(lines[a : a + block], size[axis], (upto * (1 + 1e-9)) ** 2) for a in range(0, len(lines), block)]).reshape(shape)
            continue
        lines = np.moveaxis(squared, axis + 1, -1).reshape(-1, n)
        use = np.arange(len(lines)) if wanted is None or axis < targets.ndim - 2 else np.flatnonzero(np.tile(wanted.any(axis=axis).reshape(-1), len(targets)))
        out = np.full(lines.shape, np.inf)
        block = max(1, BLOCK_CELLS // n)
        for a in range(0, len(use), block):
            out[use[a : a + block]] = _envelope(lines[use[a : a + block]], size[axis])
        squared = np.moveaxis(out.reshape(np.moveaxis(squared, axis + 1, -1).shape), -1, axis + 1)
    return np.sqrt(squared)


def distance_transform(target: np.ndarray, size: Size, wanted: np.ndarray | None = None, upto: float = math.inf) -> np.ndarray:
    """Distance of every cell to the nearest cell of ``target`` (boolean, any number of axes); infinite without one.

    With ``wanted`` (boolean, as large), cells on long lines of the last axis without a wanted cell are left infinite.
    Distances of more than ``upto`` may be told too large.
    """
    cells = np.argwhere(target) if np.count_nonzero(target) <= FEW_CELLS else ()
    if len(cells):
        # Each cell's distances to the whole grid, which are sums along the axes.
        squared = np.full(target.shape, np.inf)
        ways = [((np.arange(n) - cells[:, [k]]) * s) ** 2 for k, (n, s) in enumerate(zip(target.shape, size, strict=True))]
        for c in range(len(cells)):
            way = ways[0][c]
            for along in ways[1:]:
                way = way[..., None] + along[c]
            np.minimum(squared, way, out=squared)
        return np.sqrt(squared)
    return _transforms(target[None], size, wanted, upto)[0]


def to_targets(voxels: DataFrame, masks: DataFrame, size: Size, object_mask: str | None = None, histogram: bool = False, targets: DataFrame | None = None) -> DataFrame:
    """Least and mean distance (micrometres) of every instance to every other entity of its object.

    ``voxels`` are label entities (``object_id, entity, label, z, y, x``), ``masks`` are targets only (``object_id,
    entity, z, y, x``). The ``object_mask`` is turned inside out: its distance is that to the outside within the
    object's bounding box. ``targets`` (``object_id, entity``) are all entities of an object, if only without a cell, as
    after clipping; the distance to one without a cell is null. ``bins`` counts an instance's voxels over ``BINS`` bins that all
    instances of an entity share for one target.
    """
    rows = voxels.select("object_id", "entity", F.col("label").cast("long").alias("label"), "z", "y", "x").unionByName(masks.select("object_id", "entity", F.lit(MASK_LABEL).cast("long").alias("label"), "z", "y", "x"))
    if targets is not None:
        place = [F.lit(0).cast(voxels.schema[a].dataType).alias(a) for a in "zyx"]
        rows = rows.unionByName(targets.select("object_id", "entity", F.lit(NAME_LABEL).cast("long").alias("label"), *place))
    kind = voxels.schema["object_id"].dataType.simpleString()

    def measure(table: pa.Table) -> pa.Table | None:
        objects, names = groups.codes(table.column("object_id"))
        entities, entity_names = groups.codes(table.column("entity"))
        labels = groups.numbers(table.column("label"))
        cells = np.stack([groups.numbers(table.column(a)) for a in "zyx"], 1)
        inverted = -1 if object_mask is None else next((k for k, e in enumerate(entity_names.to_pylist()) if e == object_mask), -1)
        begins = groups.starts(objects)
        found = []
        for i, j in zip(begins.tolist(), [*begins[1:].tolist(), len(objects)], strict=True):
            one = _of_object(entities[i:j], labels[i:j], cells[i:j], size, inverted, histogram)
            if one is not None:
                found.append((np.full(len(one[0]), objects[i]), *one))
        if not found:
            return None
        of, source, label, target, least, mean, bins = (np.concatenate(c) for c in zip(*found, strict=True))
        unknown = np.isinf(least)
        told = pa.array(mean, mask=unknown)
        # A row's bins lie one after the other; rows without any are null.
        ends = np.arange(len(of) + 1, dtype=np.int32) * (BINS if histogram else 0)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(bins.reshape(-1)), mask=pa.array(unknown | (not histogram)))
        by_name = lambda c: entity_names.take(pa.array(c))
        return pa.table([names.take(pa.array(of)), by_name(source), pa.array(label), by_name(target), pa.array(least, mask=unknown), told, lists], ["object_id", "entity", "label", "target", "distance_um", "mean_distance_um", "bins"])

    return groups.by_group(rows, ("object_id",), measure, f"object_id {kind}, entity string, label long, target string, distance_um double, mean_distance_um double, bins array<long>")


def _of_object(entity: np.ndarray, label: np.ndarray, cells: np.ndarray, size: Size, inverted: int, histogram: bool) -> tuple[np.ndarray, ...] | None:
    """Entity, label, target, least and mean distance (infinite without a cell of the target) and bins of one object's instances."""
    some = label != NAME_LABEL
    targets = np.unique(entity)
    entity, label, cells = entity[some], label[some], cells[some]
    own = np.flatnonzero(label != MASK_LABEL)
    if not len(own):
        return None
    at = cells - cells.min(axis=0)
    shape = tuple((at.max(axis=0) + 1).tolist())
    flat = np.ravel_multi_index(tuple(at.T), shape)
    own = own[np.lexsort((label[own], entity[own]))]
    begins = groups.starts(entity[own], label[own])
    kinds = groups.starts(entity[own])
    of_kind = groups.within(kinds, len(own))
    source, name = entity[own][begins], label[own][begins]
    times = np.diff(np.append(begins, len(own)))
    wanted = np.zeros(math.prod(shape), bool)
    wanted[flat[own]] = True
    out = []
    together = max(1, BLOCK_CELLS // len(wanted))
    for k in range(0, len(targets), together):
        some_targets = targets[k : k + together]
        grid = np.zeros((len(some_targets), len(wanted)), bool)
        place = np.searchsorted(some_targets, entity)
        here = some_targets[np.minimum(place, len(some_targets) - 1)] == entity
        grid[place[here], flat[here]] = True
        grid[some_targets == inverted] ^= True
        far = _transforms(grid.reshape(-1, *shape), size, wanted.reshape(shape)).reshape(grid.shape)[:, flat[own]]
        for target, values in zip(some_targets.tolist(), far, strict=True):
            use = source != target
            if not use.any():
                continue
            least = np.minimum.reduceat(values, begins)
            mean = np.add.reduceat(values, begins) / times
            bins = np.zeros((len(begins), BINS if histogram else 0), np.int64)
            if histogram and np.isfinite(least).all():
                low, high = np.minimum.reduceat(values, kinds)[of_kind], np.maximum.reduceat(values, kinds)[of_kind]
                width = np.where(high > low, high - low, 1.0)
                bin_of = np.clip(((values - low) / width * BINS).astype(int), 0, BINS - 1)
                bins = np.bincount(groups.within(begins, len(own)) * BINS + bin_of, minlength=bins.size).reshape(bins.shape)
            out.append((source[use], name[use], np.full(use.sum(), target), least[use], mean[use], bins[use]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else None


def bins_json(bins: list[int] | None) -> str | None:
    return None if bins is None else json.dumps(list(bins))


def nearest_same(instances: DataFrame, axes: tuple[str, ...] = ("z", "y", "x"), key: tuple[str, ...] = ("object_id", "entity"), label: str = "label") -> DataFrame:
    """Distance from each instance's centroid to the nearest other one of its entity; null for a lone instance.

    Centroids of a group are laid out in cells, so wide that a cell holds a few, and each looks at the cells around
    its own: an equi-join. A distance up to the width of a cell is final. What has none looks again among cells that
    are ``WIDER`` times as wide, until the cells are as wide as the group. Centroids at one place are one row, and
    as near to each other as can be.
    """
    names = [f"centroid_{a}_um" for a in axes]
    points = instances.select(*key, label, *names)
    places = points.groupBy(*key, *names).agg(F.count("*").alias("times"))
    spans = [F.max(n) - F.min(n) for n in names]
    box = places.groupBy(*key).agg(F.count("*").alias("many"), F.greatest(*spans).alias("span"), *(x.alias(f"span_{n}") for x, n in zip(spans, names, strict=True)), *(F.min(n).alias(f"low_{n}") for n in names))
    # A cell of that size holds about two, for points that fill the box; a flat box counts as a little thick.
    volume = reduce(lambda a, b: a * b, (F.greatest(F.col(f"span_{n}"), F.col("span") * 1e-6) for n in names))
    width = F.pow(volume * 2 / F.col("many"), F.lit(1 / len(axes)))
    found = places.join(box, list(key)).withColumn("width", F.when(F.col("span") > 0, width).otherwise(F.lit(1.0)))
    found = kept(found.withColumn("place", F.monotonically_increasing_id()))
    open_places, done = found.where("times = 1 and many > 1").select("*", F.lit(1.0).alias("scale")), []
    while True:
        cell = lambda n, scale: F.floor((F.col(n) - F.col(f"low_{n}")) / (F.col("width") * scale))
        scale = F.lit(float(WIDER ** len(done)))
        steps = F.explode(F.array(*(F.struct(*(F.lit(v).alias(f"d{i}") for i, v in enumerate(d))) for d in itertools.product((-1, 0, 1), repeat=len(axes)))))
        looking = open_places.select(*key, "place", "span", "width", *names, *(cell(n, scale).alias(f"cell{i}") for i, n in enumerate(names))).withColumn("s", steps)
        looking = looking.select(*(F.col(k).alias(f"own_{k}") for k in key), F.col("place").alias("own"), "span", "width", *(F.col(n).alias(f"own_{n}") for n in names), *((F.col(f"cell{i}") + F.col(f"s.d{i}")).alias(f"at{i}") for i in range(len(names))))
        others = found.select(*key, "place", *names, *(cell(n, scale).alias(f"cell{i}") for i, n in enumerate(names)))
        met = looking.join(others, [F.col(f"own_{k}").eqNullSafe(F.col(k)) for k in key] + [F.col(f"at{i}") == F.col(f"cell{i}") for i in range(len(names))], "left")
        squared = sum(((F.col(n) - F.col(f"own_{n}")) ** 2 for n in names), F.lit(0.0))
        near = F.sqrt(F.min(F.when(F.col("place") != F.col("own"), squared)))
        level = met.groupBy("own").agg(near.alias("nearest_um"), F.first("span").alias("span"), F.first("width").alias("width"))
        final = (F.col("nearest_um") <= F.col("width") * scale) | (F.col("width") * scale >= F.col("span"))
        level = kept(level.withColumn("final", F.coalesce(final, F.lit(False))))
        done.append(level.where("final").select("own", "nearest_um"))
        left = level.where("not final").select("own")
        if left.isEmpty():
            break
        open_places = open_places.join(left, F.col("place") == F.col("own"), "left_semi")
    known = reduce(DataFrame.unionByName, done)
    by_place = found.join(known, F.col("place") == F.col("own"), "left").select(*key, *names, F.when(F.col("times") > 1, 0.0).otherwise(F.col("nearest_um")).alias("nearest_um"))
    renamed = by_place.select(*(F.col(c).alias(f"of_{c}") for c in (*key, *names)), "nearest_um")
    joined = points.join(renamed, [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in (*key, *names)])
    return joined.select(*key, label, "nearest_um")


def overlap_share(distances: DataFrame) -> DataFrame:
    """Distances, and the share of them that are zero, by entity and target."""
    rows = distances.groupBy("entity", "target").agg(F.count("distance_um").alias("n"), F.count_if(F.col("distance_um") == 0).alias("overlapping"))
    return rows.withColumn("share", F.try_divide(F.col("overlapping").cast("double"), F.col("n")))
