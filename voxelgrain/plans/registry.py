"""Registered queries over the derived views, and the DuckDB SQL that each is held against."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelgrain.functions import expressions as ex
from voxelgrain.operators import contacts, distance, graph, measure, report
from voxelgrain.operators.lineage import kept
from voxelgrain.sources import adapter
from voxelgrain.sources.adapter import SIZE, UNIT, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

FLAT = SIZE[1:]
GAP, CLUSTER_GAP = 0.05, 0.02
DIGITS = 6


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Doubles to ``DIGITS`` places; adding zero turns -0.0 into 0.0."""
    return df.withColumns({c: F.round(F.col(c), DIGITS) + F.lit(0.0) for c in columns})


def r(expression: str, name: str) -> str:
    return f"round({expression}, {DIGITS}) + 0.0 AS {name}"


# --- measurement -------------------------------------------------------------------------------------------------

_CENTRE = "avg(z) * 0.1 AS centroid_z_um, avg(y) * 0.02 AS centroid_y_um, avg(x) * 0.02 AS centroid_x_um"
INSTANCES = f"inst AS (SELECT object_id, entity, label, count(*) AS n_voxels, count(*) * ({UNIT}) AS volume_um3, {_CENTRE} FROM vox GROUP BY 1, 2, 3)"
CENTRES = "centre AS (SELECT object_id, avg(z) * 0.1 AS oz, avg(y) * 0.02 AS oy, avg(x) * 0.02 AS ox FROM pm GROUP BY 1)"


def instances(spark: SparkSession, sf: str) -> DataFrame:
    return measure.extent(adapter.voxels(spark, sf), measure.INSTANCE, SIZE)


def centres(spark: SparkSession, sf: str) -> DataFrame:
    return measure.extent(adapter.object_mask(spark, sf), ("object_id",), SIZE)


@query("instance_extent", with_views("vox", INSTANCES) + f"SELECT object_id, entity, label, n_voxels, {r('volume_um3', 'volume_um3')}, {r('centroid_z_um', 'centroid_z_um')}, {r('centroid_y_um', 'centroid_y_um')}, {r('centroid_x_um', 'centroid_x_um')} FROM inst")
def instance_extent(spark, sf):
    return rounded(instances(spark, sf), "volume_um3", "centroid_z_um", "centroid_y_um", "centroid_x_um")


ENTITIES = f"ent AS (SELECT object_id, entity, count(DISTINCT label) AS instance_count, count(*) * ({UNIT}) AS total_um3 FROM vox GROUP BY 1, 2)"


@query("entity_sizes", with_views("vox", ENTITIES) + f"SELECT object_id, entity, instance_count, {r('total_um3', 'total_um3')} FROM ent")
def entity_sizes(spark, sf):
    return rounded(measure.entity_sizes(adapter.voxels(spark, sf), SIZE), "total_um3")


@query(
    "entity_rollup",
    f"SELECT o_custkey AS object_id, count(*) AS n_entities, sum(n)::BIGINT AS instance_count, round(CASE WHEN count(*) = 1 THEN min(total) END, {DIGITS}) AS total_um3 FROM (SELECT o_custkey, o_orderpriority, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1, 2) GROUP BY 1",
)
def entity_rollup(spark, sf):
    """Customers as objects and the priorities of their orders as entities: some have one only, whose size is passed on."""
    entities = adapter.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("object_id"), "o_orderpriority").agg(F.count("*").alias("instance_count"), F.sum("o_totalprice").alias("total_um3"))
    return measure.roll_up(entities, ["instance_count"], ["total_um3"]).withColumn("total_um3", F.round("total_um3", DIGITS))


@query("object_extent", with_views("pm") + f"SELECT object_id, count(*) AS n_voxels, {r(f'count(*) * ({UNIT})', 'volume_um3')} FROM pm GROUP BY 1")
def object_extent(spark, sf):
    return rounded(centres(spark, sf).select("object_id", "n_voxels", "volume_um3"), "volume_um3")


_D = "sqrt(dz * dz + dy * dy + dx * dx)"


@query(
    "instance_polarity_3d",
    with_views("vox pm", INSTANCES, CENTRES, "o AS (SELECT i.*, centroid_z_um - oz AS dz, centroid_y_um - oy AS dy, centroid_x_um - ox AS dx FROM inst i LEFT JOIN centre c ON i.object_id = c.object_id)")
    + f"""SELECT object_id, entity, label, {r(_D, 'dist')}, {r(f'CASE WHEN {_D} > 0 THEN dz / {_D} END', 'nz')}, {r(f'CASE WHEN {_D} > 0 THEN dy / {_D} END', 'ny')}, {r(f'CASE WHEN {_D} > 0 THEN dx / {_D} END', 'nx')},
  round(CASE WHEN {_D} > 0 THEN degrees(atan2(dy, dx)) END, 4) + 0.0 AS az_deg, round(CASE WHEN {_D} > 0 THEN degrees(asin(least(greatest(dz / {_D}, -1), 1))) END, 4) + 0.0 AS el_deg FROM o""",
)
def instance_polarity_3d(spark, sf):
    found = measure.polarity(instances(spark, sf), centres(spark, sf)).select("object_id", "entity", "label", "dist", "nz", "ny", "nx", "az_deg", "el_deg")
    return rounded(found, "dist", "nz", "ny", "nx").withColumns({c: F.round(c, 4) + F.lit(0.0) for c in ("az_deg", "el_deg")})


@query(
    "instance_polarity_2d",
    with_views(
        "plane", "m AS (SELECT object_id, entity, avg(y) * 0.02 AS cy, avg(x) * 0.02 AS cx FROM plane GROUP BY 1, 2)", "c AS (SELECT object_id, avg(y) * 0.02 AS oy, avg(x) * 0.02 AS ox FROM (SELECT DISTINCT object_id, y, x FROM plane) GROUP BY 1)",
        "o AS (SELECT m.object_id, entity, cy - oy AS dy, cx - ox AS dx FROM m LEFT JOIN c ON m.object_id = c.object_id)",
    )
    + f"SELECT object_id, entity, {r('sqrt(dy * dy + dx * dx)', 'dist')}, round(CASE WHEN sqrt(dy * dy + dx * dx) > 1e-9 THEN degrees(atan2(dy, dx)) END, 4) + 0.0 AS angle_deg FROM o",
)
def instance_polarity_2d(spark, sf):
    cells = adapter.plane(spark, sf)
    regions = measure.extent(cells, ("object_id", "entity"), FLAT, "area_um2")
    centre = measure.extent(cells.select("object_id", "y", "x").distinct(), ("object_id",), FLAT, "area_um2")
    found = measure.polarity_2d(regions, centre).select("object_id", "entity", "dist", "angle_deg")
    return rounded(found.withColumn("angle_deg", F.when(F.col("dist") > 1e-9, F.round("angle_deg", 4) + F.lit(0.0))), "dist")


@query(
    "polar_spread",
    with_views(
        "vox pm", CENTRES, "d AS (SELECT v.object_id, entity, label, z * 0.1 - oz AS dz, y * 0.02 - oy AS dy, x * 0.02 - ox AS dx FROM vox v JOIN centre c ON v.object_id = c.object_id)",
        f"u AS (SELECT object_id, entity, label, dz / {_D} AS uz, dy / {_D} AS uy, dx / {_D} AS ux FROM d WHERE {_D} > 0)",
        "m AS (SELECT object_id, entity, label, avg(uz) AS mz, avg(uy) AS my, avg(ux) AS mx, count(*) AS n FROM u GROUP BY 1, 2, 3)",
        "s AS (SELECT u.object_id, u.entity, u.label, CASE WHEN max(n) >= 3 THEN stddev_pop(degrees(acos(least(greatest((uz * mz + uy * my + ux * mx) / sqrt(mz * mz + my * my + mx * mx), -1), 1)))) END AS spread FROM u JOIN m ON u.object_id = m.object_id AND u.entity = m.entity AND u.label = m.label WHERE mz * mz + my * my + mx * mx > 0 GROUP BY 1, 2, 3)",
    )
    + "SELECT v.object_id, v.entity, v.label, round(spread, 3) + 0.0 AS polar_spread_deg FROM (SELECT DISTINCT object_id, entity, label FROM vox) v LEFT JOIN s ON v.object_id = s.object_id AND v.entity = s.entity AND v.label = s.label",
)
def polar_spread(spark, sf):
    return measure.polar_spread(adapter.voxels(spark, sf), centres(spark, sf), SIZE).withColumn("polar_spread_deg", F.round("polar_spread_deg", 3) + F.lit(0.0))


def _boundary_sql(view: str, by: str, axes: str, size: tuple[float, ...]) -> str:
    terms, dims = [], len(size)
    for d in measure.half_directions(dims):
        step = math.sqrt(sum((k * s) ** 2 for k, s in zip(d, size, strict=True)))
        weight = 4 * measure.WEIGHTS[sum(map(abs, d))] if dims == 3 else math.pi / 4
        terms.append(f"({', '.join(map(str, d))}, {weight * math.prod(size) / step!r}::DOUBLE)")
    names = axes.split()
    columns = ", ".join([f"d{a}" for a in names])
    same = " AND ".join([f"w.{c} = v.{c}" for c in by.split(", ")] + [f"w.{a} = v.{a} + s.d{a}" for a in names])
    return f"bound AS (SELECT {', '.join('v.' + c for c in by.split(', '))}, sum(term) AS b FROM {view} v, (VALUES {', '.join(terms)}) s({columns}, term) WHERE NOT EXISTS (SELECT 1 FROM {view} w WHERE {same}) GROUP BY ALL)"


@query("crofton_surface", with_views("vox", _boundary_sql("vox", "object_id, entity, label", "z y x", SIZE)) + f"SELECT object_id, entity, label, {r('b', 'surface_um2')} FROM bound")
def crofton_surface(spark, sf):
    return rounded(measure.boundary(adapter.voxels(spark, sf), measure.INSTANCE, SIZE), "surface_um2")


@query("crofton_perimeter", with_views("plane", _boundary_sql("plane", "object_id, entity", "y x", FLAT)) + f"SELECT object_id, entity, {r('b', 'perimeter_um')} FROM bound")
def crofton_perimeter(spark, sf):
    return rounded(measure.boundary(adapter.plane(spark, sf), ("object_id", "entity"), FLAT), "perimeter_um")


@query(
    "roundness_3d",
    with_views("vox", INSTANCES, _boundary_sql("vox", "object_id, entity, label", "z y x", SIZE))
    + f"SELECT object_id, entity, label, {r('pow(pi(), 1.0 / 3) * pow(6 * volume_um3, 2.0 / 3) / b', 'sphericity')} FROM inst JOIN bound USING (object_id, entity, label)",
)
def roundness_3d(spark, sf):
    vox = adapter.voxels(spark, sf)
    both = measure.extent(vox, measure.INSTANCE, SIZE).join(measure.boundary(vox, measure.INSTANCE, SIZE), list(measure.INSTANCE))
    return rounded(both.select(*measure.INSTANCE, ex.roundness_3d(F.col("volume_um3"), F.col("surface_um2")).alias("sphericity")), "sphericity")


@query(
    "roundness_2d",
    with_views("plane", "a AS (SELECT object_id, entity, count(*) * 0.02 * 0.02 AS area FROM plane GROUP BY 1, 2)", _boundary_sql("plane", "object_id, entity", "y x", FLAT))
    + f"SELECT object_id, entity, {r('2 * sqrt(pi() * area) / b', 'circularity')} FROM a JOIN bound USING (object_id, entity)",
)
def roundness_2d(spark, sf):
    cells, by = adapter.plane(spark, sf), ("object_id", "entity")
    both = measure.extent(cells, by, FLAT, "area_um2").join(measure.boundary(cells, by, FLAT), list(by))
    return rounded(both.select(*by, ex.roundness_2d(F.col("area_um2"), F.col("perimeter_um")).alias("circularity")), "circularity")


@query(
    "aspect_ratio_2d",
    with_views("plane", "c AS (SELECT object_id, entity, covar_pop(y * 0.02, y * 0.02) AS a, covar_pop(x * 0.02, x * 0.02) AS d, covar_pop(y * 0.02, x * 0.02) AS b FROM plane GROUP BY 1, 2)", "e AS (SELECT *, (a + d) / 2 AS h, sqrt(((a - d) / 2) * ((a - d) / 2) + b * b) AS s FROM c)")
    + "SELECT object_id, entity, round(CASE WHEN h - s > (h + s) * 1e-9 THEN sqrt((h + s) / (h - s)) END, 4) AS aspect_ratio FROM e",
)
def aspect_ratio_2d(spark, sf):
    return measure.aspect_ratio_2d(adapter.plane(spark, sf), ("object_id", "entity"), FLAT).withColumn("aspect_ratio", F.round("aspect_ratio", 4))


@query(
    "aspect_ratio_3d",
    with_views(
        "vox", "s AS (SELECT object_id, entity, z * 0.1 AS z, y * 0.02 AS y, x * 0.02 AS x FROM vox)",
        "c AS (SELECT object_id, entity, covar_pop(z, z) AS zz, covar_pop(y, y) AS yy, covar_pop(x, x) AS xx, covar_pop(z, y) AS zy, covar_pop(z, x) AS zx, covar_pop(y, x) AS yx FROM s GROUP BY 1, 2)",
        "q AS (SELECT *, (zz + yy + xx) / 3 AS q FROM c)",
        "p AS (SELECT *, sqrt((pow(zz - q, 2) + pow(yy - q, 2) + pow(xx - q, 2) + 2 * (zy * zy + zx * zx + yx * yx)) / 6) AS p FROM q)",
        "n AS (SELECT *, (zz - q) / p AS a, (yy - q) / p AS b, (xx - q) / p AS d, zy / p AS e, zx / p AS f, yx / p AS g FROM p WHERE p > 0)",
        "t AS (SELECT *, acos(least(greatest((a * (b * d - g * g) - e * (e * d - g * f) + f * (e * g - b * f)) / 2, -1), 1)) / 3 AS phi FROM n)",
        "v AS (SELECT *, q + 2 * p * cos(phi) AS hi, q + 2 * p * cos(phi + 2 * pi() / 3) AS lo FROM t)",
    )
    + "SELECT object_id, entity, round(CASE WHEN lo > hi * 1e-9 THEN sqrt(hi / lo) END, 4) AS aspect_ratio FROM v",
)
def aspect_ratio_3d(spark, sf):
    return measure.aspect_ratio_3d(adapter.voxels(spark, sf), ("object_id", "entity"), SIZE).withColumn("aspect_ratio", F.round("aspect_ratio", 4))


@query("fill_ratio", with_views("vox") + f"SELECT object_id, entity, count(*) AS n_voxels, ((max(z) - min(z) + 1) * (max(y) - min(y) + 1) * (max(x) - min(x) + 1))::BIGINT AS bbox_cells, {r('count(*)::DOUBLE / ((max(z) - min(z) + 1) * (max(y) - min(y) + 1) * (max(x) - min(x) + 1))', 'fill_ratio')} FROM vox GROUP BY 1, 2")
def fill_ratio(spark, sf):
    return rounded(measure.fill_ratio(adapter.voxels(spark, sf), ("object_id", "entity")), "fill_ratio")


@query(
    "smoothing_width",
    with_views("vox", INSTANCES, _boundary_sql("vox", "object_id, entity, label", "z y x", SIZE), "f AS (SELECT object_id, entity, label, count(*)::DOUBLE / ((max(z) - min(z) + 1) * (max(y) - min(y) + 1) * (max(x) - min(x) + 1)) AS fill FROM vox GROUP BY 1, 2, 3)")
    + f"SELECT object_id, entity, label, {r('0.3 + 1.2 * least(sqrt(pow(pi(), 1.0 / 3) * pow(6 * volume_um3, 2.0 / 3) / b * least(1.0, fill / (pi() / 6))), 1.0)', 'sigma')} FROM inst JOIN bound USING (object_id, entity, label) JOIN f USING (object_id, entity, label)",
)
def smoothing_width(spark, sf):
    vox, by = adapter.voxels(spark, sf), list(measure.INSTANCE)
    both = measure.extent(vox, measure.INSTANCE, SIZE).drop("n_voxels").join(measure.boundary(vox, measure.INSTANCE, SIZE), by).join(measure.fill_ratio(vox, measure.INSTANCE), by)
    return rounded(both.select(*by, ex.smoothing(ex.roundness_3d(F.col("volume_um3"), F.col("surface_um2")), F.col("fill_ratio")).alias("sigma")), "sigma")


# --- transforms --------------------------------------------------------------------------------------------------


@query("clip_to_mask", with_views("vox pm") + "SELECT object_id, entity, z, y, x, label FROM vox v WHERE EXISTS (SELECT 1 FROM pm WHERE pm.object_id = v.object_id AND pm.z = v.z AND pm.y = v.y AND pm.x = v.x)")
def clip_to_mask(spark, sf):
    return measure.clip(adapter.voxels(spark, sf), adapter.object_mask(spark, sf))


@query(
    "crop_to_bbox",
    with_views("vox nucleus", "b AS (SELECT object_id, min(z) AS z0, max(z) AS z1, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM nucleus GROUP BY 1)")
    + "SELECT v.object_id, entity, z - coalesce(z0, 0) AS z, y - coalesce(y0, 0) AS y, x - coalesce(x0, 0) AS x, label FROM vox v LEFT JOIN b ON v.object_id = b.object_id WHERE z0 IS NULL OR (z BETWEEN z0 AND z1 AND y BETWEEN y0 AND y1 AND x BETWEEN x0 AND x1)",
)
def crop_to_bbox(spark, sf):
    return measure.crop(adapter.voxels(spark, sf), adapter.nucleus(spark, sf))


COMPONENTS = with_views(
    "plane",
    "n AS (SELECT object_id, entity, y, x, y * 1000 + x AS id FROM plane)",
    "e AS (SELECT a.object_id, a.entity, a.id AS a, b.id AS b FROM n a JOIN n b ON a.object_id = b.object_id AND a.entity = b.entity AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1)",
    "w(object_id, entity, id, root) AS (SELECT object_id, entity, id, id FROM n UNION SELECT e.object_id, e.entity, e.b, w.root FROM w JOIN e ON e.object_id = w.object_id AND e.entity = w.entity AND e.a = w.id AND w.root < e.b)",
    "c AS (SELECT object_id, entity, id, min(root) AS root FROM w GROUP BY 1, 2, 3)",
)


@query("components_2d", COMPONENTS + "SELECT object_id, entity, CAST(id // 1000 AS INTEGER) AS y, CAST(id % 1000 AS INTEGER) AS x, CAST(dense_rank() OVER (PARTITION BY object_id, entity ORDER BY root) AS INTEGER) AS label FROM c")
def components_2d(spark, sf):
    return measure.components(adapter.plane(spark, sf))


@query("promoted_masks", COMPONENTS + "SELECT object_id, entity, CASE WHEN count(DISTINCT root) > 1 THEN 'label' ELSE 'mask' END AS kind, CASE WHEN count(DISTINCT root) > 1 THEN count(DISTINCT root) ELSE 0 END AS instance_count FROM c GROUP BY 1, 2")
def promoted_masks(spark, sf):
    found = measure.promote(adapter.plane(spark, sf), ("y", "x"))
    return found.groupBy("object_id", "entity", "kind").agg(F.countDistinct("label").alias("instance_count"))


@query(
    "promoted_masks_3d",
    with_views(
        "nucleus pm",
        "n AS (SELECT object_id, z, y, x, (z * 1000 + y) * 1000 + x AS id FROM nucleus)",
        "e AS (SELECT a.object_id, a.id AS a, b.id AS b FROM n a JOIN n b ON a.object_id = b.object_id AND abs(a.z - b.z) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1)",
        "w(object_id, id, root) AS (SELECT object_id, id, id FROM n UNION SELECT e.object_id, e.b, w.root FROM w JOIN e ON e.object_id = w.object_id AND e.a = w.id AND w.root < e.b)",
        "c AS (SELECT object_id, id, min(root) AS root FROM w GROUP BY 1, 2)",
        "k AS (SELECT object_id, count(DISTINCT root) AS n FROM c GROUP BY 1)",
    )
    + """SELECT object_id, 'nucleus' AS entity, CASE WHEN n > 1 THEN 'label' ELSE 'mask' END AS kind, CASE WHEN n > 1 THEN n ELSE 0 END AS instance_count FROM k
  UNION ALL SELECT DISTINCT object_id, 'pm', 'mask', 0 FROM pm""",
)
def promoted_masks_3d(spark, sf):
    """In space, all 26 neighbours counting; the object mask stays a mask whatever its pieces."""
    both = masks(spark, sf).unionByName(adapter.object_mask(spark, sf).withColumn("entity", F.lit("pm")))
    found = measure.promote(both.select("object_id", "entity", "z", "y", "x"), object_mask="pm")
    return found.groupBy("object_id", "entity", "kind").agg(F.countDistinct("label").alias("instance_count"))


# --- distances ---------------------------------------------------------------------------------------------------

#: Every voxel's least distance to every target, by brute force.
_NEAR = """near AS (SELECT v.object_id, v.entity, v.label, t.target, v.z, v.y, v.x, min(pow((v.z - t.z) * 0.1, 2) + pow((v.y - t.y) * 0.02, 2) + pow((v.x - t.x) * 0.02, 2)) AS d2
  FROM vox v JOIN targets t ON v.object_id = t.object_id AND v.entity <> t.target GROUP BY ALL)"""
_TARGETS = "targets AS (SELECT object_id, entity AS target, z, y, x FROM vox UNION ALL SELECT object_id, 'nucleus', z, y, x FROM nucleus)"
DISTANCES = "dist AS (SELECT object_id, entity, label, target, sqrt(min(d2)) AS distance_um, avg(sqrt(d2)) AS mean_distance_um FROM near GROUP BY 1, 2, 3, 4)"
_DISTANCE_VIEWS = (_TARGETS, _NEAR, DISTANCES)


def masks(spark: SparkSession, sf: str) -> DataFrame:
    return adapter.nucleus(spark, sf).withColumn("entity", F.lit("nucleus"))


def distances(spark: SparkSession, sf: str, histogram: bool = False) -> DataFrame:
    return distance.to_targets(adapter.voxels(spark, sf), masks(spark, sf), SIZE, histogram=histogram)


@query("distance_to_target", with_views("vox nucleus", *_DISTANCE_VIEWS) + f"SELECT object_id, entity, label, target, {r('distance_um', 'distance_um')} FROM dist")
def distance_to_target(spark, sf):
    return rounded(distances(spark, sf).select("object_id", "entity", "label", "target", "distance_um"), "distance_um")


@query("distance_mean", with_views("vox nucleus", *_DISTANCE_VIEWS) + f"SELECT object_id, entity, label, target, {r('mean_distance_um', 'mean_distance_um')} FROM dist")
def distance_mean(spark, sf):
    return rounded(distances(spark, sf).select("object_id", "entity", "label", "target", "mean_distance_um"), "mean_distance_um")


@query(
    "distance_empty_targets",
    with_views(
        "vox nucleus",
        "inside AS (SELECT v.* FROM vox v JOIN nucleus n ON v.object_id = n.object_id AND v.z = n.z AND v.y = n.y AND v.x = n.x)",
        "i AS (SELECT DISTINCT object_id, entity, label FROM inside)",
        "t AS (SELECT DISTINCT object_id, entity AS target FROM vox)",
        "d AS (SELECT a.object_id, a.entity, a.label, b.entity AS target, min(sqrt(pow((a.z - b.z) * 0.1, 2) + pow((a.y - b.y) * 0.02, 2) + pow((a.x - b.x) * 0.02, 2))) AS d "
        "FROM inside a JOIN inside b ON a.object_id = b.object_id AND a.entity <> b.entity GROUP BY 1, 2, 3, 4)",
    )
    + f"SELECT i.object_id, i.entity, i.label, t.target, {r('d.d', 'distance_um')} FROM i JOIN t ON t.object_id = i.object_id AND t.target <> i.entity "
    "LEFT JOIN d ON d.object_id = i.object_id AND d.entity = i.entity AND d.label = i.label AND d.target = t.target",
)
def distance_empty_targets(spark, sf):
    """Distances inside a mask: an entity that has no cell there is a target all the same, at no known distance."""
    vox = adapter.voxels(spark, sf)
    none = masks(spark, sf).where("false").select("object_id", "entity", "z", "y", "x")
    found = distance.to_targets(measure.clip(vox, adapter.nucleus(spark, sf)), none, SIZE, targets=vox.select("object_id", "entity").distinct())
    return rounded(found.select("object_id", "entity", "label", "target", "distance_um"), "distance_um")


@query(
    "distance_boundary",
    with_views(
        "vox pm", "grid AS (SELECT s_suppkey AS object_id, z, y, x FROM supplier, (SELECT unnest(range(1, 8)) AS z), (SELECT unnest(range(1, 51)) AS y), (SELECT unnest(range(0, 11)) AS x))",
        "targets AS (SELECT object_id, 'pm' AS target, z, y, x FROM grid g WHERE NOT EXISTS (SELECT 1 FROM pm WHERE pm.object_id = g.object_id AND pm.z = g.z AND pm.y = g.y AND pm.x = g.x))",
        _NEAR, DISTANCES,
    )
    + f"SELECT object_id, entity, label, {r('distance_um', 'distance_um')} FROM dist",
)
def distance_boundary(spark, sf):
    pm = adapter.object_mask(spark, sf).withColumn("entity", F.lit("pm"))
    found = distance.to_targets(adapter.voxels(spark, sf), pm, SIZE, object_mask="pm").where("target = 'pm'")
    return rounded(found.select("object_id", "entity", "label", "distance_um"), "distance_um")


@query(
    "distance_histogram",
    with_views(
        "vox nucleus", _TARGETS, _NEAR, "d AS (SELECT *, sqrt(d2) AS d FROM near)",
        "g AS (SELECT object_id, entity, target, min(d) AS lo, max(d) AS hi FROM d GROUP BY 1, 2, 3)",
        "b AS (SELECT d.object_id, d.entity, d.label, d.target, least(19, greatest(0, floor((d - lo) / (CASE WHEN hi > lo THEN hi - lo ELSE 1 END) * 20)))::BIGINT AS bin FROM d JOIN g ON d.object_id = g.object_id AND d.entity = g.entity AND d.target = g.target)",
    )
    + "SELECT object_id, entity, label, target, bin, count(*) AS n FROM b GROUP BY ALL",
)
def distance_histogram(spark, sf):
    found = distances(spark, sf, histogram=True).select("object_id", "entity", "label", "target", F.posexplode("bins").alias("bin", "n"))
    return found.where("n > 0").withColumn("bin", F.col("bin").cast("long"))


@query("distance_overlap_share", with_views("vox nucleus", *_DISTANCE_VIEWS) + f"SELECT entity, target, count(*) AS n, count(*) FILTER (distance_um = 0) AS overlapping, {r('count(*) FILTER (distance_um = 0)::DOUBLE / count(*)', 'share')} FROM dist GROUP BY 1, 2")
def distance_overlap_share(spark, sf):
    return rounded(distance.overlap_share(distances(spark, sf)), "share")


@query(
    "nearest_same_type",
    with_views("vox", INSTANCES)
    + f"SELECT a.object_id, a.entity, a.label, {r('sqrt(min(pow(a.centroid_z_um - b.centroid_z_um, 2) + pow(a.centroid_y_um - b.centroid_y_um, 2) + pow(a.centroid_x_um - b.centroid_x_um, 2)))', 'nearest_um')} FROM inst a LEFT JOIN inst b ON a.object_id = b.object_id AND a.entity = b.entity AND a.label <> b.label GROUP BY 1, 2, 3",
)
def nearest_same_type(spark, sf):
    return rounded(distance.nearest_same(instances(spark, sf)), "nearest_um")


@query(
    "nearest_point",
    with_views("points", "p AS (SELECT a.entity, a.id, min(pow(a.z - b.z, 2) + pow(a.y - b.y, 2) + pow(a.x - b.x, 2)) AS d FROM points a LEFT JOIN points b ON a.entity = b.entity AND a.id <> b.id GROUP BY 1, 2)")
    + f"SELECT entity, id, {r('sqrt(d)', 'nearest_um')} FROM p",
)
def nearest_point(spark, sf):
    points = adapter.points(spark, sf).withColumnsRenamed({a: f"centroid_{a}_um" for a in "zyx"})
    return rounded(distance.nearest_same(points, key=("entity",), label="id"), "nearest_um")


# --- reach -------------------------------------------------------------------------------------------------------

REACH = "reach AS (SELECT a.object_id, a.entity, a.label, a.target AS target_a, b.target AS target_b, greatest(a.distance_um, b.distance_um) AS reach_um FROM dist a JOIN dist b ON a.object_id = b.object_id AND a.entity = b.entity AND a.label = b.label AND a.target < b.target)"


@query("reach_pairs", with_views("vox nucleus", *_DISTANCE_VIEWS, REACH) + f"SELECT object_id, entity, label, target_a, target_b, {r('reach_um', 'reach_um')} FROM reach")
def reach_pairs(spark, sf):
    return rounded(report.reach(distances(spark, sf)), "reach_um")


@query(
    "reach_curve",
    with_views("objects vox nucleus", *_DISTANCE_VIEWS, REACH, f"q AS (SELECT entity, target_a, target_b, grp, count(*) AS n, quantile_cont(reach_um, {list(report.PROBABILITIES)}) AS curve FROM reach JOIN objects USING (object_id) GROUP BY 1, 2, 3, 4)")
    + f"SELECT entity, target_a, target_b, grp, n, (i - 1) / 50.0::DOUBLE AS probability, {r('curve[i]', 'reach_um')} FROM q, (SELECT unnest(range(1, 52)) AS i)",
)
def reach_curve(spark, sf):
    return rounded(report.reach_curve(report.reach(distances(spark, sf)), adapter.objects(spark, sf)), "reach_um")


@query("reach_pair_count", with_views("vox nucleus", *_DISTANCE_VIEWS) + "SELECT entity, count(DISTINCT target) AS targets, count(DISTINCT target) * (count(DISTINCT target) - 1) // 2 AS pairs FROM dist GROUP BY 1")
def reach_pair_count(spark, sf):
    return report.reach_pair_count(distances(spark, sf))


# --- contacts ----------------------------------------------------------------------------------------------------

_CLAIM = """cells AS (SELECT object_id, z, y, x, coalesce(max_by({'e': entity, 'l': label}, CASE WHEN is_label THEN entity END), min_by({'e': entity, 'l': label}, CASE WHEN NOT is_label THEN entity END)) AS o
  FROM (SELECT object_id, entity, label, z, y, x, true AS is_label FROM vox UNION ALL SELECT object_id, 'nucleus', NULL, z, y, x, false FROM nucleus) GROUP BY 1, 2, 3, 4)"""
_OWNED = "owned AS (SELECT object_id, z, y, x, o.e AS entity, o.l AS label FROM cells)"


def _edges_sql(gap: float) -> str:
    return f"""edges AS (SELECT object_id, ea AS entity_a, la AS label_a, eb AS entity_b, lb AS label_b, min(gap) AS gap_um FROM (
  SELECT a.object_id, a.entity AS ea, a.label AS la, b.entity AS eb, b.label AS lb, sqrt(pow((a.z - b.z) * 0.1, 2) + pow((a.y - b.y) * 0.02, 2) + pow((a.x - b.x) * 0.02, 2)) AS gap FROM owned a JOIN owned b
  ON a.object_id = b.object_id AND abs(a.y - b.y) <= 5 AND (a.entity < b.entity OR (a.entity = b.entity AND coalesce(a.label, -1) < coalesce(b.label, -1)))) WHERE gap <= {gap} + 1e-9 GROUP BY ALL)"""


CONTACTS = (_CLAIM, _OWNED, _edges_sql(GAP))


def owned(spark: SparkSession, sf: str) -> DataFrame:
    return contacts.claim(adapter.voxels(spark, sf), masks(spark, sf))


def edges(spark: SparkSession, sf: str) -> DataFrame:
    return contacts.edges(owned(spark, sf), GAP, SIZE)


@query("claimed_cells", with_views("vox nucleus", _CLAIM, _OWNED) + "SELECT object_id, entity, label, z, y, x FROM owned")
def claimed_cells(spark, sf):
    return owned(spark, sf)


@query("contact_edges", with_views("vox nucleus", *CONTACTS) + f"SELECT object_id, entity_a, label_a, entity_b, label_b, {r('gap_um', 'gap_um')} FROM edges")
def contact_edges(spark, sf):
    return rounded(edges(spark, sf), "gap_um")


@query("contact_edges_wide", with_views("vox nucleus", _CLAIM, _OWNED, _edges_sql(0.1)) + f"SELECT entity_a, entity_b, count(*) AS n, {r('max(gap_um)', 'max_gap_um')}, {r('sum(gap_um)', 'sum_gap_um')} FROM edges GROUP BY 1, 2")
def contact_edges_wide(spark, sf):
    found = contacts.edges(owned(spark, sf), 0.1, SIZE)
    return rounded(found.groupBy("entity_a", "entity_b").agg(F.count("*").alias("n"), F.max("gap_um").alias("max_gap_um"), F.sum("gap_um").alias("sum_gap_um")), "max_gap_um", "sum_gap_um")


@query("contact_same_type", with_views("vox nucleus", *CONTACTS) + f"SELECT object_id, entity_a, label_a, entity_b, label_b, {r('gap_um', 'gap_um')} FROM edges WHERE entity_a = entity_b AND gap_um <= 0.03 + 1e-9")
def contact_same_type(spark, sf):
    return rounded(contacts.edges(owned(spark, sf), 0.03, SIZE, same_type=True), "gap_um")


@query("contact_pair_filter", with_views("vox nucleus", *CONTACTS) + f"SELECT object_id, entity_a, label_a, entity_b, label_b, {r('gap_um', 'gap_um')} FROM edges WHERE least(entity_a, entity_b) = 'A' AND greatest(entity_a, entity_b) = 'R'")
def contact_pair_filter(spark, sf):
    return rounded(contacts.select(edges(spark, sf), GAP, pair=("R", "A")), "gap_um")


@query("contact_limits", with_views("vox nucleus", *CONTACTS) + f"SELECT least(entity_a, entity_b) || ' + ' || greatest(entity_a, entity_b) AS pair, count(*) AS n, {r('max(gap_um)', 'max_gap_um')} FROM edges GROUP BY 1")
def contact_limits(spark, sf):
    return rounded(contacts.limits(edges(spark, sf)), "max_gap_um")


_PARTNERS = "partners AS (SELECT object_id, entity, label, count(DISTINCT partner) AS partners FROM (SELECT object_id, entity_a AS entity, label_a AS label, entity_b || ':' || CAST(label_b AS VARCHAR) AS partner FROM edges UNION ALL SELECT object_id, entity_b, label_b, entity_a || ':' || CAST(label_a AS VARCHAR) FROM edges) GROUP BY 1, 2, 3)"
PROFILE = "profile AS (SELECT i.object_id, i.entity, i.label, coalesce(p.partners, 0) AS partners FROM (SELECT DISTINCT object_id, entity, label FROM vox) i LEFT JOIN partners p ON i.object_id = p.object_id AND i.entity = p.entity AND i.label = p.label)"


@query("partner_counts", with_views("vox nucleus", *CONTACTS, _PARTNERS) + "SELECT * FROM partners")
def partner_counts(spark, sf):
    return contacts.partner_counts(edges(spark, sf))


def profiles(spark: SparkSession, sf: str) -> DataFrame:
    return contacts.profile(adapter.voxels(spark, sf), edges(spark, sf))


@query("instance_profile", with_views("vox nucleus", *CONTACTS, _PARTNERS, PROFILE) + "SELECT * FROM profile")
def instance_profile(spark, sf):
    return profiles(spark, sf)


@query("contact_per_object", with_views("objects vox nucleus", *CONTACTS, _PARTNERS, PROFILE) + f"SELECT p.object_id, grp, count(*) AS instances, count(*) FILTER (partners > 0) AS in_contact, {r('avg(partners)', 'mean_partners')} FROM profile p LEFT JOIN objects o ON p.object_id = o.object_id GROUP BY 1, 2")
def contact_per_object(spark, sf):
    return rounded(contacts.per_object(profiles(spark, sf), adapter.objects(spark, sf)), "mean_partners")


@query("contact_gap_per_object", with_views("vox nucleus", *CONTACTS) + f"SELECT object_id, count(*) AS contacts, {r('median(gap_um)', 'median_gap_um')} FROM edges GROUP BY 1")
def contact_gap_per_object(spark, sf):
    return rounded(contacts.gaps_per_object(edges(spark, sf)), "median_gap_um")


_MATRIX = "matrix AS (SELECT grp, least(entity_a, entity_b) AS s1, greatest(entity_a, entity_b) AS s2, count(*) AS n FROM edges JOIN objects USING (object_id) GROUP BY 1, 2, 3)"


@query("pair_matrix", with_views("objects vox nucleus", *CONTACTS, _MATRIX) + "SELECT * FROM matrix")
def pair_matrix(spark, sf):
    return contacts.pair_matrix(edges(spark, sf), adapter.objects(spark, sf))


@query("partner_shares", with_views("objects vox nucleus", *CONTACTS, _MATRIX) + f"SELECT grp, structure, partner, n, {r('n / sum(n) OVER (PARTITION BY grp, structure)', 'share')} FROM (SELECT grp, s1 AS structure, s2 AS partner, n FROM matrix UNION ALL SELECT grp, s2, s1, n FROM matrix WHERE s1 <> s2)")
def partner_shares(spark, sf):
    return rounded(contacts.partner_shares(contacts.pair_matrix(edges(spark, sf), adapter.objects(spark, sf))), "share")


@query("orphan_distances", with_views("vox nucleus", *_DISTANCE_VIEWS, _CLAIM, _OWNED) + "SELECT object_id, entity, label, target FROM dist d WHERE NOT EXISTS (SELECT 1 FROM owned v WHERE v.object_id = d.object_id AND v.entity = d.entity AND v.label = d.label)")
def orphan_distances(spark, sf):
    """Distances of instances that own no cell, since later entities have them all."""
    left = owned(spark, sf).select(*measure.INSTANCE).distinct()
    return distances(spark, sf).join(left, list(measure.INSTANCE), "left_anti").select(*measure.INSTANCE, "target")


# --- clusters ----------------------------------------------------------------------------------------------------

_LINKS = _edges_sql(CLUSTER_GAP).replace("edges AS", "close AS")
GROUPS = (
    _CLAIM.replace("UNION ALL SELECT object_id, 'nucleus', NULL, z, y, x, false FROM nucleus", ""), _OWNED, _LINKS,
    "nodes AS (SELECT DISTINCT object_id, entity, label, dense_rank() OVER (PARTITION BY object_id ORDER BY entity, label) AS id FROM owned)",
    "ends AS (SELECT c.object_id, a.id AS a, b.id AS b FROM close c JOIN nodes a ON a.object_id = c.object_id AND a.entity = entity_a AND a.label = label_a JOIN nodes b ON b.object_id = c.object_id AND b.entity = entity_b AND b.label = label_b WHERE entity_a = entity_b)",
    "walk(object_id, id, root) AS (SELECT object_id, id, id FROM nodes UNION SELECT w.object_id, CASE WHEN e.a = w.id THEN e.b ELSE e.a END, w.root FROM walk w JOIN ends e ON e.object_id = w.object_id AND (e.a = w.id OR e.b = w.id))",
    "roots AS (SELECT object_id, id, min(root) AS root FROM walk GROUP BY 1, 2)",
    "members AS (SELECT n.object_id, n.entity, n.label, m.entity || ':' || CAST(m.label AS VARCHAR) AS cluster FROM nodes n JOIN roots r ON r.object_id = n.object_id AND r.id = n.id JOIN nodes m ON m.object_id = n.object_id AND m.id = r.root)",
)


def close_contacts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Instances that own a cell, and their contacts of one type within the clusters' gap."""
    cells = contacts.claim(adapter.voxels(spark, sf))
    return cells.select(*measure.INSTANCE).distinct(), contacts.edges(cells, CLUSTER_GAP, SIZE, same_type=True)


def members(spark: SparkSession, sf: str) -> DataFrame:
    return graph.clusters(*close_contacts(spark, sf))


@query("clusters", with_views("vox", *GROUPS) + "SELECT object_id, entity, label, cluster FROM members")
def clusters(spark, sf):
    return members(spark, sf)


PER_OBJECT = """sizes AS (SELECT object_id, cluster, count(*) AS n, count(DISTINCT entity) AS types FROM members GROUP BY 1, 2),
per_object AS (SELECT object_id, count(*) FILTER (n >= 2) AS clusters, coalesce(sum(n) FILTER (n >= 2), 0)::BIGINT AS clustered, coalesce(max(n) FILTER (n >= 2), 0) AS largest, count(*) FILTER (n >= 2 AND types > 1) AS mixed FROM sizes GROUP BY 1)"""


@query("clusters_per_object", with_views("vox", *GROUPS, PER_OBJECT) + "SELECT * FROM per_object")
def clusters_per_object(spark, sf):
    return graph.per_object(members(spark, sf))


CLOSE_PARTNERS = _PARTNERS.replace("FROM edges", "FROM same").replace("partners AS", "same AS (SELECT * FROM close WHERE entity_a = entity_b),\npartners AS", 1)


@query(
    "contact_condition_totals",
    with_views("objects vox", *GROUPS, PER_OBJECT, CLOSE_PARTNERS, PROFILE.replace("FROM vox", "FROM owned"), "o AS (SELECT object_id, count(*) AS instances, count(*) FILTER (partners > 0) AS in_contact FROM profile GROUP BY 1)", "t AS (SELECT object_id, count(*) AS contacts FROM same GROUP BY 1)")
    + f"""SELECT grp, count(*) AS objects, sum(instances)::BIGINT AS instances, sum(in_contact)::BIGINT AS in_contact, coalesce(sum(contacts), 0)::BIGINT AS contacts, sum(clusters)::BIGINT AS clusters, sum(mixed)::BIGINT AS mixed, max(largest) AS largest,
  {r('100.0 * sum(in_contact) / sum(instances)', 'pct_in_contact')} FROM objects JOIN o USING (object_id) LEFT JOIN t USING (object_id) LEFT JOIN per_object USING (object_id) GROUP BY 1""",
)
def contact_condition_totals(spark, sf):
    # Contacts feed three branches, so they are made once.
    nodes, found = (kept(df) for df in close_contacts(spark, sf))
    return rounded(graph.condition_totals(contacts.profile(nodes, found), found, graph.clusters(nodes, found), adapter.objects(spark, sf)), "pct_in_contact")


_REACHED = (
    "groups AS (SELECT object_id, cluster, count(*) AS size, list_sort(list(DISTINCT entity)) AS made FROM members GROUP BY 1, 2 HAVING count(*) >= 2)",
    "obs AS (SELECT g.object_id, g.cluster, g.size, g.made, d.target, min(d.distance_um) AS observed FROM groups g JOIN members m ON m.object_id = g.object_id AND m.cluster = g.cluster JOIN dist d ON d.object_id = m.object_id AND d.entity = m.entity AND d.label = m.label WHERE NOT list_contains(g.made, d.target) GROUP BY 1, 2, 3, 4, 5)",
    "pool AS (SELECT o.object_id, o.cluster, o.target, o.size AS k, o.observed, count(*) AS n, count(*) FILTER (d.distance_um < o.observed) AS lt, count(*) FILTER (d.distance_um <= o.observed) AS le FROM obs o JOIN dist d ON d.object_id = o.object_id AND d.target = o.target AND list_contains(o.made, d.entity) GROUP BY 1, 2, 3, 4, 5)",
    """beats AS (SELECT *, CASE WHEN k < n THEN 50.0 * (list_product(list_transform(range(0, k), lambda j: greatest(n - le - j, 0)::DOUBLE / (n - j))) + list_product(list_transform(range(0, k), lambda j: greatest(n - lt - j, 0)::DOUBLE / (n - j)))) END AS beats FROM pool)""",
)


def reached(spark: SparkSession, sf: str) -> DataFrame:
    return graph.cluster_reach(kept(members(spark, sf)), kept(distances(spark, sf).where("distance_um is not null")))


@query("cluster_reach", with_views("vox nucleus", *GROUPS, *_DISTANCE_VIEWS, *_REACHED) + f"SELECT object_id, cluster, target, k AS size, n AS pool, {r('observed', 'observed_um')}, {r('beats', 'beats')} FROM beats")
def cluster_reach(spark, sf):
    return rounded(reached(spark, sf), "observed_um", "beats")


@query("null_percentile", with_views("vox nucleus", *GROUPS, *_DISTANCE_VIEWS, *_REACHED) + f"SELECT target, count(beats) AS n, {r('median(beats)', 'median_beats')} FROM beats GROUP BY 1")
def null_percentile(spark, sf):
    return rounded(graph.median_beats(reached(spark, sf)), "median_beats")


def queries() -> dict[str, Query]:
    from voxelgrain.plans import overview_queries  # noqa: F401  registers the rest

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
