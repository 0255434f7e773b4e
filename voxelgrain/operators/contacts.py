"""Contacts: pairs of instances of one object whose voxels come within a gap of each other."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelgrain.functions.expressions import all_of, pair_label, partner_key
from voxelgrain.operators import groups
from voxelgrain.operators.measure import Size

#: Voxel steps are not exact in binary; gaps up to this much above the limit are within it.
SLACK = 1e-9
#: Voxel steps within a gap, up to which every voxel is shifted by each of them; beyond, cells of the gap's size are joined.
MOST_SHIFTS = 250
#: Side of the blocks (in voxels) that space is cut into, at least this and four times the gap.
BLOCK = 64
#: Steps above which it pays to leave out cells inside an instance; finding them takes a step to each face.
SURFACE_SHIFTS = 40


def claim(labels: DataFrame, masks: DataFrame | None = None) -> DataFrame:
    """One owner for each cell: a later label entity before an earlier one, labels before masks, an earlier mask before a later one.

    Masks are one instance with a null label. Entities are in order of their names.
    """
    rows = labels.select("object_id", "entity", F.col("label").cast("long").alias("label"), "z", "y", "x", F.lit(True).alias("is_label"))
    if masks is not None:
        rows = rows.unionByName(masks.select("object_id", "entity", F.lit(None).cast("long").alias("label"), "z", "y", "x", F.lit(False).alias("is_label")))
    last = F.max_by(F.struct("entity", "label"), F.when(F.col("is_label"), F.col("entity")))
    first = F.min_by(F.struct("entity", "label"), F.when(~F.col("is_label"), F.col("entity")))
    owner = rows.groupBy("object_id", "z", "y", "x").agg(F.coalesce(last, first).alias("owner"))
    return owner.select("object_id", "owner.entity", "owner.label", "z", "y", "x")


def _ordered(pairs: DataFrame) -> DataFrame:
    """Each unordered pair with its ends in order of entity and label (masks first)."""
    rank = lambda s: F.struct(F.col(f"entity_{s}"), F.coalesce(F.col(f"label_{s}"), F.lit(-1)))
    swap = rank("a") > rank("b")
    pick = lambda c, s, o: F.when(swap, F.col(f"{c}_{o}")).otherwise(F.col(f"{c}_{s}")).alias(f"{c}_{s}")
    return pairs.select("object_id", pick("entity", "a", "b"), pick("label", "a", "b"), pick("entity", "b", "a"), pick("label", "b", "a"), "gap_um")


def surface(cells: DataFrame, axes: tuple[str, ...] = ("z", "y", "x")) -> DataFrame:
    """The cells with a face towards another instance or none. The least gap of two instances is one between such cells:
    from any other, one step towards the other instance stays inside and is nearer."""
    steps = [tuple(s if i == k else 0 for i in range(len(axes))) for k in range(len(axes)) for s in (-1, 1)]
    moves = F.explode(F.array(*(F.struct(*(F.lit(v).alias(f"d{i}") for i, v in enumerate(d))) for d in steps)))
    seen = cells.withColumn("s", moves).select("object_id", "entity", "label", *((F.col(a) + F.col(f"s.d{i}")).alias(a) for i, a in enumerate(axes)))
    # A cell that all its neighbours of the same instance point at is inside.
    inside = seen.groupBy("object_id", "entity", "label", *axes).agg(F.count("*").alias("faces")).where(F.col("faces") == len(steps))
    of = inside.select(F.col("object_id").alias("of"), F.col("entity").alias("of_entity"), F.col("label").alias("of_label"), *(F.col(a).alias(f"of_{a}") for a in axes))
    same = (F.col("object_id") == F.col("of")) & (F.col("entity") == F.col("of_entity")) & F.col("label").eqNullSafe(F.col("of_label"))
    return cells.join(of, [same, *(F.col(a) == F.col(f"of_{a}") for a in axes)], "left_anti")


def _close(table: pa.Table, shifts: list[tuple], sides: list[int], axes: tuple[str, ...], same_type: bool) -> pa.Table | None:
    """Pairs of instances and their least gap, in the blocks of ``table``, from cells that are at home in their block."""
    blocks = [groups.numbers(table.column(f"block{i}")) for i in range(len(axes))]
    at = [groups.numbers(table.column(a)) for a in axes]
    objects, names = groups.codes(table.column("object_id"))
    entities, entity_names = groups.codes(table.column("entity"))
    label = groups.numbers(table.column("label").fill_null(0))
    bare = table.column("label").is_null().to_numpy()
    begins = groups.starts(objects, *blocks)
    block = groups.within(begins, len(objects))
    # Instances in the order of their ends: by entity, then masks, as if their label were -1, among labels.
    rank = np.where(bare, -1, label)
    order = np.lexsort((~bare, rank, entities, block))
    new = groups.starts(block[order], entities[order], rank[order], bare[order])
    instance = np.empty(len(order), np.int64)
    instance[order] = groups.within(new, len(order))
    first = order[new]
    home = np.ones(len(block), bool)
    for c, b, side in zip(at, blocks, sides, strict=True):
        home &= c // side == b
    # One number for a place: steps that leave a block's cells lead to the margin around them.
    margin = [max(1, *(abs(d[k]) for d in shifts)) for k in range(len(axes))]
    low = [np.minimum.reduceat(c, begins)[block] for c in at]
    at = [c - m + r for c, m, r in zip(at, low, margin, strict=True)]
    spans = [int(c.max()) + r + 1 for c, r in zip(at, margin, strict=True)]
    strides = [math.prod(spans[k + 1 :]) for k in range(len(spans))]
    key = block * math.prod(spans) + sum(c * s for c, s in zip(at, strides, strict=True))
    if len(shifts) > SURFACE_SHIFTS:
        own = np.sort(key * len(new) + instance)
        inside = np.ones(len(key), bool)
        for s in (*strides, *(-s for s in strides)):
            wanted = (key + s) * len(new) + instance
            inside &= own[np.minimum(np.searchsorted(own, wanted), len(own) - 1)] == wanted
        key, instance, home = key[~inside], instance[~inside], home[~inside]
    order = np.argsort(key, kind="stable")
    key, instance, home = key[order], instance[order], home[order]
    from_key, from_instance = key[home], instance[home]
    kind = entities[first]
    pairs, gaps = [], []
    for *d, gap in sorted(shifts, key=lambda d: d[-1]):
        wanted = from_key + sum(k * s for k, s in zip(d, strides, strict=True))
        place = np.searchsorted(key, wanted)
        hit = np.flatnonzero(key[np.minimum(place, len(key) - 1)] == wanted) if len(key) else place
        one, two = from_instance[hit], place[hit]
        # Where instances share a place, each of them is met.
        times = np.searchsorted(key, wanted[hit], "right") - two
        if len(times) and times.max() > 1:
            ahead = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            one, two = np.repeat(one, times), np.repeat(two, times) + ahead
        two = instance[two]
        apart = one != two
        if same_type:
            apart &= kind[one] == kind[two]
        one, two = one[apart], two[apart]
        found = np.unique(np.minimum(one, two) * len(new) + np.maximum(one, two))
        pairs.append(found)
        gaps.append(np.full(len(found), gap))
    # Gaps come in order, so a pair's first one is its least.
    found, at_first = np.unique(np.concatenate(pairs), return_index=True)
    if not len(found):
        return None
    a, b = first[found // len(new)], first[found % len(new)]
    ends = lambda k: (entity_names.take(pa.array(entities[k])), pa.array(label[k], mask=bare[k]))
    return pa.table([names.take(pa.array(objects[a])), *ends(a), *ends(b), pa.array(np.concatenate(gaps)[at_first])], ["object_id", "entity_a", "label_a", "entity_b", "label_b", "gap_um"])


def _met_in_blocks(cells: DataFrame, shifts: list[tuple], reach: list[int], axes: tuple[str, ...], same_type: bool) -> DataFrame:
    """Pairs of instances that meet in a block, in order of their ends, with their least gap there."""
    sides = [max(BLOCK, 4 * r) for r in reach]
    known = cells.select("object_id", "entity", F.col("label").cast("long").alias("label"), *(F.col(a).cast("long").alias(a) for a in axes)).dropna(subset=["object_id", "entity", *axes])
    for i, (a, r, side) in enumerate(zip(axes, reach, sides, strict=True)):
        block = lambda c, side=side: F.floor(c / side)
        # Steps never lead down the first axis, so what is above its block isn't needed below.
        up = F.col(a) if i == 0 else F.col(a) + r
        known = known.withColumn(f"block{i}", F.explode(F.sequence(block(F.col(a) - r), block(up))) if r else block(F.col(a)))
    kind = cells.schema["object_id"].dataType.simpleString()
    schema = f"object_id {kind}, entity_a string, label_a long, entity_b string, label_b long, gap_um double"
    return groups.by_group(known, ("object_id", *(f"block{i}" for i in range(len(axes)))), lambda table: _close(table, shifts, sides, axes, same_type), schema)


def edges(cells: DataFrame, max_gap_um: float, size: Size, axes: tuple[str, ...] = ("z", "y", "x"), same_type: bool = False) -> DataFrame:
    """All pairs of instances within ``max_gap_um``, with their least gap, from claimed ``cells``; with ``same_type``, those of one entity.

    Few voxel steps lie within a small gap, so each voxel looks at every one of half of them. Space is cut into blocks,
    whose cells meet in one task with those around them that the gap reaches; the steps are looked up there, so that
    only cells and found pairs are shuffled, whatever the number of steps. For large gaps, space is cut into cells of
    the gap's size and the neighbouring cells are joined before the distance is tested. Where there are many steps,
    cells inside an instance are left out first.
    """
    if same_type:
        cells = cells.where(F.col("label").isNotNull())
    reach = [math.floor((max_gap_um + SLACK) / s) for s in size]
    shifts = [d for d in itertools.product(*(range(-r, r + 1) for r in reach)) if d >= (0,) * len(size)]
    shifts = [(*d, math.sqrt(sum((k * s) ** 2 for k, s in zip(d, size, strict=True)))) for d in shifts]
    shifts = [d for d in shifts if d[-1] <= max_gap_um + SLACK]
    if len(shifts) <= MOST_SHIFTS:
        met = _met_in_blocks(cells, shifts, reach, axes, same_type)
        met = met.withColumns({f"label_{s}": F.col(f"label_{s}").cast(cells.schema["label"].dataType) for s in "ab"})
        return met.groupBy("object_id", "entity_a", "label_a", "entity_b", "label_b").agg(F.min("gap_um").alias("gap_um"))
    cells = surface(cells, axes)
    other = cells.select(F.col("object_id").alias("of"), F.col("entity").alias("entity_b"), F.col("label").alias("label_b"), *(F.col(a).alias(f"{a}_b") for a in axes))
    one = cells.select("object_id", F.col("entity").alias("entity_a"), F.col("label").alias("label_a"), *axes)
    different = (F.col("entity_a") != F.col("entity_b")) | ~F.col("label_a").eqNullSafe(F.col("label_b"))
    types = [F.col("entity_a") == F.col("entity_b")] if same_type else []
    width = [max(1, r) for r in reach]
    cell = lambda suffix: [F.floor(F.col(f"{a}{suffix}") / w) for a, w in zip(axes, width, strict=True)]
    near = F.explode(F.array(*(F.struct(*(F.lit(v).alias(f"d{i}") for i, v in enumerate(d))) for d in itertools.product((-1, 0, 1), repeat=len(axes)))))
    one = one.withColumn("s", near).select("*", *((c + F.col(f"s.d{i}")).alias(f"cell{i}") for i, c in enumerate(cell(""))))
    other = other.select("*", *(c.alias(f"of_cell{i}") for i, c in enumerate(cell("_b"))))
    met = one.join(other, [F.col("object_id") == F.col("of")] + types + [F.col(f"cell{i}") == F.col(f"of_cell{i}") for i in range(len(axes))]).where(different)
    gap = F.sqrt(sum((((F.col(a) - F.col(f"{a}_b")) * s) ** 2 for a, s in zip(axes, size, strict=True)), F.lit(0.0)))
    met = met.withColumn("gap_um", gap).where(F.col("gap_um") <= max_gap_um + SLACK)
    found = _ordered(met).groupBy("object_id", "entity_a", "label_a", "entity_b", "label_b").agg(F.min("gap_um").alias("gap_um"))
    return found


def select(contacts: DataFrame, gap_um: float, same_type: bool = False, pair: tuple[str, str] | None = None) -> DataFrame:
    """Contacts up to a gap; all, within one type, or of one unordered pair of types."""
    a, b = F.col("entity_a"), F.col("entity_b")
    parts: list[Column] = [F.col("gap_um") <= gap_um + SLACK]
    if same_type:
        parts.append(a == b)
    if pair:
        parts.append((F.least(a, b) == min(pair)) & (F.greatest(a, b) == max(pair)))
    return contacts.where(all_of(parts))


def ordered(contacts: DataFrame) -> DataFrame:
    """Contacts in the order of their ends: by entity, and by label, masks first."""
    ends = [x for s in "ab" for x in (F.col(f"entity_{s}"), F.coalesce(F.col(f"label_{s}"), F.lit(-1)))]
    return contacts.orderBy("object_id", *ends)


def limits(contacts: DataFrame) -> DataFrame:
    """Contacts and the largest gap, by unordered pair of types."""
    return contacts.groupBy(pair_label(F.col("entity_a"), F.col("entity_b")).alias("pair")).agg(F.count("*").alias("n"), F.max("gap_um").alias("max_gap_um"))


def partner_counts(contacts: DataFrame) -> DataFrame:
    """Different partners of every instance; masks are neither partners nor have any."""
    side = lambda s, o: contacts.select("object_id", F.col(f"entity_{s}").alias("entity"), F.col(f"label_{s}").alias("label"), partner_key(F.col(f"entity_{o}"), F.col(f"label_{o}")).alias("partner"))
    both = side("a", "b").unionByName(side("b", "a"))
    return both.groupBy("object_id", "entity", "label").agg(F.countDistinct("partner").alias("partners"))


def profile(instances: DataFrame, contacts: DataFrame, structures: list[str] | None = None) -> DataFrame:
    """Instances with their number of partners, 0 for none."""
    rows = instances.select("object_id", "entity", "label").distinct()
    if structures is not None:
        rows = rows.where(F.col("entity").isin(structures))
    return rows.join(partner_counts(contacts), ["object_id", "entity", "label"], "left").withColumn("partners", F.coalesce("partners", F.lit(0).cast("long")))


def per_object(profiles: DataFrame, groups: DataFrame) -> DataFrame:
    found = profiles.groupBy("object_id").agg(F.count("*").alias("instances"), F.count_if(F.col("partners") > 0).alias("in_contact"), F.avg("partners").alias("mean_partners"))
    return found.join(groups, "object_id", "left")


def gaps_per_object(contacts: DataFrame) -> DataFrame:
    return contacts.groupBy("object_id").agg(F.count("*").alias("contacts"), F.median("gap_um").alias("median_gap_um"))


def pair_matrix(contacts: DataFrame, groups: DataFrame) -> DataFrame:
    """Contacts by condition and unordered pair of types."""
    pairs = contacts.select("object_id", F.least("entity_a", "entity_b").alias("s1"), F.greatest("entity_a", "entity_b").alias("s2"))
    return pairs.join(groups, "object_id").groupBy("grp", "s1", "s2").agg(F.count("*").alias("n"))


def partner_shares(matrix: DataFrame) -> DataFrame:
    """Share of each partner type among a type's contacts: both sides of mixed pairs, pairs of one type once."""
    turned = matrix.where("s1 <> s2").select("grp", F.col("s2").alias("structure"), F.col("s1").alias("partner"), "n")
    both = matrix.select("grp", F.col("s1").alias("structure"), F.col("s2").alias("partner"), "n").unionByName(turned)
    return both.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("grp", "structure")))
