"""Registered queries over the report: list columns, ranks, the overview, top-k, names, colours and geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelgrain.functions import expressions as ex
from voxelgrain.operators import contacts, geometry, graph, measure, report
from voxelgrain.operators.lineage import kept
from voxelgrain.plans.registry import CLOSE_PARTNERS, COMPONENTS, CONTACTS, FLAT, GROUPS, INSTANCES, PER_OBJECT, PROFILE, close_contacts, distances, edges, instances, query, r, rounded
from voxelgrain.sources import adapter
from voxelgrain.sources.adapter import SIZE, with_views

GROUPED = "g AS (SELECT i.*, grp FROM inst i JOIN objects o ON i.object_id = o.object_id)"


def grouped(spark, sf):
    return instances(spark, sf).join(adapter.objects(spark, sf), "object_id")


# --- list columns ------------------------------------------------------------------------------------------------


def as_report(spark, sf):
    rows = instances(spark, sf).withColumn("surface_um2", F.lit(None).cast("double"))
    return report.to_lists(rows, "object_id", ["entity", "label", "volume_um3", "surface_um2"], ["entity", "label"], "instance_")


@query("report_lists", with_views("vox", INSTANCES) + f"SELECT object_id, list(entity ORDER BY entity, label) AS instance_entity, list(label ORDER BY entity, label) AS instance_label, list(round(volume_um3, 6) ORDER BY entity, label) AS instance_volume_um3 FROM inst GROUP BY 1")
def report_lists(spark, sf):
    found = as_report(spark, sf).withColumn("instance_volume_um3", F.transform("instance_volume_um3", lambda v: F.round(v, 6)))
    return report.prune_all_null(found)


@query("unnest_instances", with_views("vox", INSTANCES) + f"SELECT object_id, entity AS instance_entity, label AS instance_label, {r('volume_um3', 'instance_volume_um3')}, CAST(NULL AS DOUBLE) AS instance_surface_um2 FROM inst")
def unnest_instances(spark, sf):
    lists = ["instance_entity", "instance_label", "instance_volume_um3", "instance_surface_um2"]
    return rounded(report.unnest(as_report(spark, sf), ["object_id"], lists, "instance_entity"), "instance_volume_um3")


@query("unnest_round_trip", with_views("vox", INSTANCES) + f"SELECT entity, count(*) AS n, count(DISTINCT object_id) AS objects, sum(label)::BIGINT AS labels, {r('sum(volume_um3)', 'volume_um3')} FROM inst GROUP BY 1")
def unnest_round_trip(spark, sf):
    lists = ["instance_entity", "instance_label", "instance_volume_um3", "instance_surface_um2"]
    back = report.unnest(as_report(spark, sf), ["object_id"], lists, "instance_entity").withColumnRenamed("instance_entity", "entity")
    found = back.groupBy("entity").agg(F.count("*").alias("n"), F.countDistinct("object_id").alias("objects"), F.sum("instance_label").alias("labels"), F.sum("instance_volume_um3").alias("volume_um3"))
    return rounded(found, "volume_um3")


_ODD = "CASE WHEN user_id % 7 = 0 THEN CAST('NaN' AS DOUBLE) WHEN user_id % 11 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE value END"


@query("finite_guard", f"SELECT event_type, count(v) FILTER (isfinite(v)) AS n, {r('max(v) FILTER (isfinite(v))', 'high')}, {r('min(v) FILTER (isfinite(v))', 'low')} FROM (SELECT event_type, {_ODD} AS v FROM events) GROUP BY 1")
def finite_guard(spark, sf):
    v = ex.finite(F.expr(_ODD))
    return rounded(adapter.table(spark, sf, "events").groupBy("event_type").agg(F.count(v).alias("n"), F.max(v).alias("high"), F.min(v).alias("low")), "high", "low")


@query("distinct_values", "SELECT DISTINCT l_returnflag AS value FROM lineitem WHERE l_returnflag <> 'N'")
def distinct_values(spark, sf):
    return report.distinct_values(adapter.voxels(spark, sf), F.when(F.col("entity") != "N", F.col("entity")))


# --- distributions and ranks -------------------------------------------------------------------------------------


@query("measured_metrics", with_views("vox", INSTANCES) + "SELECT 'volume_um3' AS metric, count(volume_um3) AS n FROM inst UNION ALL SELECT 'centroid_z_um', count(*) FROM inst UNION ALL SELECT 'nothing', 0")
def measured_metrics(spark, sf):
    return report.measured(instances(spark, sf).withColumn("nothing", F.lit(None).cast("double")), ["volume_um3", "centroid_z_um", "nothing"])


@query("one_per_category", with_views("vox", INSTANCES) + "SELECT max(n) AS most FROM (SELECT count(volume_um3) AS n FROM inst GROUP BY object_id, entity)")
def one_per_category(spark, sf):
    return report.one_per_category(instances(spark, sf), ["object_id", "entity"], "volume_um3")


@query("instance_counts", with_views("vox", INSTANCES) + "SELECT count(*) AS instances, count(DISTINCT entity) AS entities FROM inst")
def instance_counts(spark, sf):
    return instances(spark, sf).agg(F.count("*").alias("instances"), F.countDistinct("entity").alias("entities"))


@query("instance_distribution", with_views("vox objects", INSTANCES, GROUPED) + f"SELECT entity, grp, count(*) AS n, {r('min(volume_um3)', 'low')}, {r('max(volume_um3)', 'high')}, {r('median(volume_um3)', 'median')}, {r('stddev_samp(volume_um3)', 'sd')} FROM g GROUP BY 1, 2")
def instance_distribution(spark, sf):
    return rounded(report.distribution(grouped(spark, sf), ["entity", "grp"], "volume_um3"), "low", "high", "median", "sd")


@query("rank_sums", with_views("vox objects", INSTANCES, GROUPED, "k AS (SELECT entity, grp, avg(rn) OVER (PARTITION BY entity, n_voxels) AS rank FROM (SELECT entity, grp, n_voxels, row_number() OVER (PARTITION BY entity ORDER BY n_voxels) AS rn FROM g))") + f"SELECT entity, grp, {r('sum(rank)', 'rank_sum')}, count(*) AS n FROM k GROUP BY 1, 2")
def rank_sums(spark, sf):
    return rounded(report.rank_sums(grouped(spark, sf).withColumn("n_voxels", F.col("n_voxels").cast("double")), "grp", "n_voxels", ["entity"]), "rank_sum")


@query(
    "mann_whitney",
    with_views(
        "vox objects", INSTANCES, GROUPED, "names AS (SELECT DISTINCT entity, grp FROM g)", "pairs AS (SELECT a.entity, a.grp AS cat_a, b.grp AS cat_b FROM names a JOIN names b ON a.entity = b.entity AND a.grp < b.grp)",
        "each AS (SELECT p.*, g.grp, n_voxels, row_number() OVER (PARTITION BY p.entity, cat_a, cat_b ORDER BY n_voxels) AS rn FROM pairs p JOIN g ON g.entity = p.entity AND g.grp IN (cat_a, cat_b))",
        "ranked AS (SELECT *, avg(rn) OVER (PARTITION BY entity, cat_a, cat_b, n_voxels) AS rank FROM each)",
        "s AS (SELECT entity, cat_a, cat_b, sum(rank) FILTER (grp = cat_a) AS rank_sum, count(*) FILTER (grp = cat_a) AS n1, count(*) FILTER (grp = cat_b) AS n2 FROM ranked GROUP BY 1, 2, 3)",
        "u AS (SELECT *, rank_sum - n1 * (n1 + 1) / 2.0::DOUBLE AS u FROM s)",
    )
    + f"SELECT entity, cat_a, cat_b, {r('rank_sum', 'rank_sum')}, n1, n2, {r('u', 'u')}, {r('(u - n1 * n2 / 2.0::DOUBLE) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12.0::DOUBLE)', 'z')} FROM u",
)
def mann_whitney(spark, sf):
    rows = grouped(spark, sf).withColumn("n_voxels", F.col("n_voxels").cast("double"))
    return rounded(report.mann_whitney(rows, "grp", "n_voxels", ["entity"]), "rank_sum", "u", "z")


# --- overview ----------------------------------------------------------------------------------------------------

#: The overview's objects are customers and their structures the priorities of their orders, so that some objects lack
#: some structures, or have none, as the rows are. The mask, with no count, is what is partly delivered.
_CUSTOMERS = "objects AS (SELECT c_custkey AS object_id, r_name AS grp FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
_SOME = """chosen AS (SELECT o_custkey AS object_id, o_orderpriority AS entity, count(*) AS instance_count, sum(o_totalprice) AS total_um3 FROM orders GROUP BY 1, 2
  UNION ALL SELECT o_custkey, 'nucleus', NULL, sum(o_totalprice) FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)"""


def customers(spark, sf):
    nation, region = adapter.table(spark, sf, "nation"), adapter.table(spark, sf, "region")
    joined = adapter.table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(F.col("c_custkey").alias("object_id"), F.col("r_name").alias("grp"))


def some_entities(spark, sf):
    orders = adapter.table(spark, sf, "orders").withColumnRenamed("o_custkey", "object_id")
    size = F.sum("o_totalprice").alias("total_um3")
    labels = orders.groupBy("object_id", F.col("o_orderpriority").alias("entity")).agg(F.count("*").alias("instance_count"), size)
    mask = orders.where("o_orderstatus = 'P'").groupBy("object_id").agg(size)
    return labels.unionByName(mask.select("object_id", F.lit("nucleus").alias("entity"), F.lit(None).cast("long").alias("instance_count"), "total_um3"))


_GRID = "grid AS (SELECT o.object_id, s.entity, e.object_id IS NULL AS missing, e.instance_count FROM objects o CROSS JOIN (SELECT DISTINCT entity FROM chosen) s LEFT JOIN chosen e ON e.object_id = o.object_id AND e.entity = s.entity)"


def grid(spark, sf):
    rows = some_entities(spark, sf)
    return report.presence(customers(spark, sf), rows, rows)


@query("presence_matrix", with_views("", _CUSTOMERS, _SOME, _GRID) + "SELECT * FROM grid")
def presence_matrix(spark, sf):
    return grid(spark, sf)


@query("structure_gaps", with_views("", _CUSTOMERS, _SOME, _GRID) + "SELECT entity, count(*) FILTER (missing) AS missing_in FROM grid GROUP BY 1 HAVING count(*) FILTER (missing) > 0")
def structure_gaps(spark, sf):
    return report.structure_gaps(grid(spark, sf))


@query(
    "composition",
    with_views("", _SOME, "s AS (SELECT o_custkey AS object_id, 2 * sum(o_totalprice) AS object_um3 FROM orders GROUP BY 1)", "f AS (SELECT chosen.object_id, entity, total_um3 / object_um3 AS fraction FROM chosen JOIN s ON s.object_id = chosen.object_id WHERE total_um3 > 0)")
    + f"SELECT object_id, entity, {r('fraction', 'fraction')}, {r('sum(fraction) OVER (PARTITION BY object_id)', 'assigned')}, {r('greatest(0, 1 - sum(fraction) OVER (PARTITION BY object_id))', 'unassigned')} FROM f",
)
def composition(spark, sf):
    sizes = adapter.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("object_id")).agg((2 * F.sum("o_totalprice")).alias("object_um3"))
    return rounded(report.composition(some_entities(spark, sf), sizes, "pm"), "fraction", "assigned", "unassigned")


@query("overview_counts", with_views("", _SOME, "o AS (SELECT count(DISTINCT object_id) AS objects FROM chosen)", "e AS (SELECT entity, count(*) AS present, count(instance_count) AS labelled, sum(instance_count) AS instances FROM chosen GROUP BY 1)") + "SELECT max(objects) AS objects, count(*) AS structures, count(*) FILTER (labelled > 0) AS labelled, sum(instances)::BIGINT AS instances, count(*) FILTER (present < objects) AS uneven FROM e, o")
def overview_counts(spark, sf):
    return report.overview(some_entities(spark, sf))


@query(
    "mixed_dims",
    with_views("vox plane", "d AS (SELECT DISTINCT object_id, 3 AS spatial_dims FROM vox UNION ALL SELECT DISTINCT object_id, 2 FROM plane)")
    + "SELECT spatial_dims, count(*) AS objects FROM d GROUP BY 1 HAVING (SELECT count(DISTINCT spatial_dims) FROM d) > 1",
)
def mixed_dims(spark, sf):
    solid = adapter.voxels(spark, sf).select("object_id").distinct().withColumn("spatial_dims", F.lit(3))
    return report.mixed_dims(solid.unionByName(adapter.plane(spark, sf).select("object_id").distinct().withColumn("spatial_dims", F.lit(2))))


@query("coverage", with_views("", _SOME) + "SELECT count(*) AS objects, count(*) FILTER (n > 0) AS with_instances, count(*) FILTER (m) AS with_mask FROM (SELECT object_id, sum(instance_count) AS n, bool_or(entity = 'nucleus') AS m FROM chosen GROUP BY 1)")
def coverage(spark, sf):
    rows = some_entities(spark, sf).groupBy("object_id").agg(F.sum("instance_count").alias("n"), F.bool_or(F.col("entity") == "nucleus").alias("m"))
    return rows.agg(F.count("*").alias("objects"), F.count_if(F.col("n") > 0).alias("with_instances"), F.count_if("m").alias("with_mask"))


@query("entity_presence", with_views("", _SOME) + "SELECT (CASE WHEN entity = 'nucleus' THEN 'mask' ELSE 'label' END) || ':' || entity AS key, count(*) AS present, (SELECT count(DISTINCT object_id) FROM chosen) AS objects FROM chosen GROUP BY 1")
def entity_presence(spark, sf):
    rows = some_entities(spark, sf)
    key = F.concat(F.when(F.col("entity") == "nucleus", "mask").otherwise("label"), F.lit(":"), F.col("entity"))
    return rows.groupBy(key.alias("key")).agg(F.count("*").alias("present")).crossJoin(rows.agg(F.countDistinct("object_id").alias("objects")))


@query("entity_order", with_views("", _SOME) + "SELECT entity, CAST(row_number() OVER (ORDER BY entity <> 'nucleus', entity) AS INTEGER) AS place FROM (SELECT DISTINCT entity FROM chosen)")
def entity_order(spark, sf):
    from pyspark.sql import Window

    names = some_entities(spark, sf).select("entity").distinct()
    # One row for each structure, so the order over all of them is short.
    return names.select("entity", F.row_number().over(Window.orderBy(F.col("entity") != "nucleus", "entity")).alias("place"))


@query(
    "short_labels",
    "SELECT 'batch_a_' || n_name || '_x' || CASE WHEN n_nationkey % 2 = 0 THEN '1' ELSE '2' END || '_final_v2' AS id, regexp_replace(n_name, '^NATION_', '') || '_x' || CASE WHEN n_nationkey % 2 = 0 THEN '1' ELSE '2' END AS short FROM nation",
)
def short_labels(spark, sf):
    names = adapter.table(spark, sf, "nation").select(F.concat(F.lit("batch_a_"), "n_name", F.lit("_x"), F.when(F.col("n_nationkey") % 2 == 0, "1").otherwise("2"), F.lit("_final_v2")).alias("id"))
    return report.short_labels(names)


# --- top-k -------------------------------------------------------------------------------------------------------


def sized(spark, sf):
    return instances(spark, sf).select("object_id", "entity", "label", F.round("volume_um3", 9).alias("volume_um3"))


_SIZED = "sized AS (SELECT object_id, entity, label, round(volume_um3, 9) AS volume_um3 FROM inst)"


@query("topk_largest", with_views("vox", INSTANCES, _SIZED) + "SELECT * FROM sized ORDER BY volume_um3 DESC, object_id, entity, label LIMIT 4000")
def topk_largest(spark, sf):
    return report.largest(sized(spark, sf), "volume_um3", 4000)


@query("gallery_highest", with_views("vox", INSTANCES, _SIZED) + "SELECT * FROM sized ORDER BY volume_um3 DESC, object_id, entity, label LIMIT 24")
def gallery_highest(spark, sf):
    return report.largest(sized(spark, sf), "volume_um3", report.gallery_size(6))


@query("gallery_lowest", with_views("vox", INSTANCES, _SIZED) + "SELECT * FROM sized ORDER BY volume_um3, object_id, entity, label LIMIT 24")
def gallery_lowest(spark, sf):
    return report.largest(sized(spark, sf), "volume_um3", report.gallery_size(6), ascending=True)


@query("gallery_random")
def gallery_random(spark, sf):
    return report.sample(sized(spark, sf), ["object_id", "entity", "label"], 24, seed=3)


@query("per_entity_topk", with_views("vox", INSTANCES, _SIZED) + "SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY entity ORDER BY volume_um3 DESC, object_id, label) AS INTEGER) AS place FROM sized) WHERE place <= 10")
def per_entity_topk(spark, sf):
    return report.largest_by_entity(sized(spark, sf), "entity", "volume_um3", 10, ["object_id", "label"])


# --- names, colours, paths ---------------------------------------------------------------------------------------

_STEM = "p_brand || ' ' || p_name || CASE WHEN p_partkey % 3 = 0 THEN '_labels' WHEN p_partkey % 3 = 1 THEN '-Mask' ELSE '.tif' END"
_NORM = f"trim(regexp_replace(lower({_STEM}), '[^a-z0-9]+', '_', 'g'), '_')"


@query(
    "name_parse",
    f"WITH n AS (SELECT p_partkey, {_NORM} AS s FROM part), m AS (SELECT *, regexp_matches(s, '^(.*)_([a-z0-9_]+)_(labels?|mask)$') AS ok FROM n) SELECT p_partkey, s AS normal, CASE WHEN ok THEN regexp_extract(s, '^(.*)_([a-z0-9_]+)_(labels?|mask)$', 1) END AS prefix, CASE WHEN ok THEN regexp_extract(s, '^(.*)_([a-z0-9_]+)_(labels?|mask)$', 2) END AS name, CASE WHEN ok THEN CASE WHEN s LIKE '%mask' THEN 'mask' ELSE 'label' END END AS kind FROM m",
)
def name_parse(spark, sf):
    end = F.when(F.col("p_partkey") % 3 == 0, "_labels").when(F.col("p_partkey") % 3 == 1, "-Mask").otherwise(".tif")
    stem = F.concat("p_brand", F.lit(" "), "p_name", end)
    found = adapter.table(spark, sf, "part").select("p_partkey", ex.normalize_name(stem).alias("normal"), ex.entity_file(stem).alias("e"))
    return found.select("p_partkey", "normal", "e.prefix", "e.name", "e.kind")


_PALETTE = {"A1": "#D62728", "N2": "#2c3"}
#: The ten colours that structures without one of their own get in turn, in the overview and in space.
OBJECT_COLOURS = ("#1f77b4", "#ff7f0e", "#2ca02c", "#d62728", "#9467bd", "#8c564b", "#e377c2", "#7f7f7f", "#bcbd22", "#17becf")
SPACE_COLOURS = ("#33ddff", "#ff8f00", "#acff6c", "#ff2728", "#9467ff", "#f1a69b", "#e377ff", "#7f7f7f", "#ccff22", "#17beff")


def _turn_sql(colours: tuple[str, ...], name: str) -> str:
    listed = ", ".join(f"'{c}'" for c in colours)
    return f"coalesce(chosen, [{listed}][1 + (row_number() OVER (ORDER BY entity) - 1) % {len(colours)}]) AS {name}"


@query(
    "colour_lookup",
    "WITH n AS (SELECT l_returnflag || (l_linenumber::VARCHAR) AS entity, count(*) AS n FROM lineitem GROUP BY 1), "
    "c AS (SELECT *, CASE entity WHEN 'A1' THEN '#d62728' WHEN 'N2' THEN '#22cc33' END AS chosen FROM n) "
    f"SELECT entity, n, {_turn_sql(OBJECT_COLOURS, 'colour')}, {_turn_sql(SPACE_COLOURS, 'colour_in_space')} FROM c",
)
def colour_lookup(spark, sf):
    from pyspark.sql import Window

    name = F.concat("l_returnflag", F.col("l_linenumber").cast("string"))
    names = adapter.table(spark, sf, "lineitem").groupBy(name.alias("entity")).agg(F.count("*").alias("n"))
    # One row for each structure: a short order, and a palette that is a literal.
    place = F.row_number().over(Window.orderBy("entity")) - 1
    chosen = F.create_map(*(F.lit(v) for k, c in _PALETTE.items() for v in (k, ex.hex_colour_of(c))))
    turn = lambda colours: F.coalesce(F.try_element_at(chosen, "entity"), F.get(F.array(*map(F.lit, colours)), F.pmod(place, F.lit(len(colours)))))
    return names.select("entity", "n", turn(OBJECT_COLOURS).alias("colour"), turn(SPACE_COLOURS).alias("colour_in_space"))


_HEX = "CASE p_partkey % 5 WHEN 0 THEN '#' || p_size WHEN 1 THEN '#ABC' WHEN 2 THEN '#12aBef' WHEN 3 THEN 'red' ELSE NULL END"


@query("hex_colours", f"WITH c AS (SELECT p_partkey, lower({_HEX}) AS c FROM part) SELECT p_partkey, CASE WHEN regexp_full_match(c, '#[0-9a-f]{{6}}') THEN c WHEN regexp_full_match(c, '#[0-9a-f]{{3}}') THEN regexp_replace(c, '([0-9a-f])', '\\1\\1', 'g') END AS colour FROM c")
def hex_colours(spark, sf):
    return adapter.table(spark, sf, "part").select("p_partkey", ex.hex_colour(F.expr(_HEX)).alias("colour"))


def _mix(k: int) -> str:
    """One channel between two stops of the colour map, from its hex digits."""
    stops = "[" + ", ".join(f"{int(c[1 + 2 * k : 3 + 2 * k], 16)} / 255.0::DOUBLE" for c in ex.VIRIDIS) + "]"
    return f"CASE WHEN t IS NULL THEN 0.6 ELSE {stops}[lo + 1] + ({stops}[lo + 2] - {stops}[lo + 1]) * (t * 8 - lo) END"


@query(
    "viridis",
    with_views(
        "vox",
        INSTANCES,
        "v AS (SELECT object_id, entity, label, CASE WHEN label % 13 = 0 THEN NULL ELSE volume_um3 END AS v FROM inst)",
        "w AS (SELECT *, min(v) OVER (PARTITION BY object_id) AS a, max(v) OVER (PARTITION BY object_id) AS b FROM v)",
        "n AS (SELECT object_id, entity, label, (v - a) / CASE WHEN b > a THEN b - a ELSE 1 END AS t FROM w)",
        "l AS (SELECT *, CAST(least(floor(t * 8), 7) AS INTEGER) AS lo FROM n)",
    )
    + f"SELECT object_id, entity, label, {r(_mix(0), 'r')}, {r(_mix(1), 'g')}, {r(_mix(2), 'b')} FROM l",
)
def viridis(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("object_id")
    # Some instances have no finite value, and are grey.
    v = F.when(F.col("label") % 13 == 0, F.lit(float("nan"))).otherwise(F.col("volume_um3"))
    rows = instances(spark, sf).select("object_id", "entity", "label", v.alias("v"))
    known = ex.finite(F.col("v"))
    rows = rows.withColumn("c", ex.metric_colour(F.col("v"), F.min(known).over(w), F.max(known).over(w)))
    return rounded(rows.select("object_id", "entity", "label", "c.*"), "r", "g", "b")


@query("explode_offset", f"SELECT id, {r('CASE WHEN d * f = 0 THEN 0 ELSE x * d * f END', 'ox')}, {r('CASE WHEN d * f = 0 THEN 0 ELSE y * d * f END', 'oy')}, {r('CASE WHEN d * f = 0 THEN 0 ELSE z * d * f END', 'oz')} FROM (SELECT vec_id AS id, embedding[1]::DOUBLE AS z, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS x, (vec_id % 4)::DOUBLE AS d, coalesce(nullif(label % 3, 1), 0)::DOUBLE AS f FROM embeddings)")
def explode_offset(spark, sf):
    rows = adapter.points(spark, sf).withColumn("d", (F.col("id") % 4).cast("double")).withColumn("f", F.nullif(F.col("entity") % 3, F.lit(1)).cast("double"))
    rows = rows.withColumn("o", ex.explode_offset(F.col("d"), (F.col("x"), F.col("y"), F.col("z")), F.col("f")))
    return rounded(rows.select("id", F.col("o")[0].alias("ox"), F.col("o")[1].alias("oy"), F.col("o")[2].alias("oz")), "ox", "oy", "oz")


_FOLDER = "CASE p_partkey % 4 WHEN 0 THEN 'control' WHEN 1 THEN 'control/' || p_brand WHEN 2 THEN p_type || '/' || p_brand || '/c' ELSE p_brand END"


@query("group_of_path", f"WITH f AS (SELECT p_partkey, {_FOLDER} AS f FROM part) SELECT p_partkey, f AS folder, CASE WHEN f = 'control' OR starts_with(f, 'control/') THEN 'control' WHEN f = 'PROMO' OR starts_with(f, 'PROMO/') THEN 'PROMO' WHEN contains(f, '/') THEN string_split(f, '/')[1] ELSE '' END AS grp FROM f")
def group_of_path(spark, sf):
    rows = adapter.table(spark, sf, "part").select("p_partkey", F.expr(_FOLDER).alias("folder"))
    return rows.withColumn("grp", ex.group_of(F.col("folder"), ["control", "PROMO"]))


# --- geometry ----------------------------------------------------------------------------------------------------

#: Regions of the plane, each a component of its mask, and the whole of an object's masks as one; the outline of a set
#: of cells has a vertex at every corner of an edge that has no other cell behind it.
_REGIONS = COMPONENTS + """,
region AS (SELECT object_id, entity, CAST(dense_rank() OVER (PARTITION BY object_id, entity ORDER BY root) AS INTEGER) AS label, CAST(id // 1000 AS INTEGER) AS y, CAST(id % 1000 AS INTEGER) AS x FROM c),
drawn AS (SELECT 'instance' AS row_type, * FROM region UNION ALL SELECT DISTINCT 'file', object_id, 'all', NULL, y, x FROM plane),
sides AS (SELECT d.*, dy, dx FROM drawn d, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) v(dy, dx) WHERE NOT EXISTS (SELECT 1 FROM drawn o
  WHERE o.row_type = d.row_type AND o.object_id = d.object_id AND o.entity = d.entity AND o.label IS NOT DISTINCT FROM d.label AND o.y = d.y + dy AND o.x = d.x + dx)),
corners AS (SELECT row_type, object_id, entity, label, unnest([[2 * y + dy - abs(dx), 2 * x + dx - abs(dy)], [2 * y + dy + abs(dx), 2 * x + dx + abs(dy)]]) AS p FROM sides),
outlined AS (SELECT row_type, object_id, entity, label, count(DISTINCT p) AS outline_vertices FROM corners GROUP BY ALL),
sized AS (SELECT row_type, object_id, entity, label, count(*) AS n_voxels, count(*) * 0.02::DOUBLE * 0.02 AS area_um2 FROM drawn GROUP BY ALL),
shape AS (SELECT s.*, outline_vertices FROM sized s JOIN outlined o ON s.row_type = o.row_type AND s.object_id = o.object_id AND s.entity = o.entity AND s.label IS NOT DISTINCT FROM o.label),
touch AS (SELECT a.object_id, a.entity AS entity_a, a.label AS label_a, b.entity AS entity_b, b.label AS label_b, min(sqrt(pow((a.y - b.y) * 0.02, 2) + pow((a.x - b.x) * 0.02, 2))) AS gap_um FROM region a JOIN region b
  ON a.object_id = b.object_id AND abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2 AND (a.entity < b.entity OR (a.entity = b.entity AND a.label < b.label)) GROUP BY ALL HAVING min(pow((a.y - b.y) * 0.02, 2) + pow((a.x - b.x) * 0.02, 2)) <= 0.04 * 0.04 + 1e-9)
"""


def regions(spark, sf):
    return measure.components(adapter.plane(spark, sf))


def flat_geometry(spark, sf, found=None):
    cells = adapter.plane(spark, sf)
    found = kept(regions(spark, sf)) if found is None else found
    whole = cells.select("object_id", F.lit("all").alias("entity"), "y", "x").distinct()
    touching = contacts.edges(found, 2 * FLAT[0], FLAT, ("y", "x"))
    return geometry.geometry_rows(found, whole, FLAT, "all", touching)


@query("geometry_rows", _REGIONS + f"SELECT object_id, entity, label, row_type, n_voxels, {r('area_um2', 'area_um2')}, outline_vertices, NULL AS entity_a, NULL AS label_a, NULL AS entity_b, NULL AS label_b, CAST(NULL AS DOUBLE) AS gap_um FROM shape UNION ALL SELECT object_id, NULL, NULL, 'contact', NULL, NULL, NULL, entity_a, label_a, entity_b, label_b, {r('gap_um', 'gap_um')} FROM touch")
def geometry_rows(spark, sf):
    names = ("object_id", "entity", "label", "row_type", "n_voxels", "area_um2", "outline_vertices", "entity_a", "label_a", "entity_b", "label_b", "gap_um")
    return rounded(flat_geometry(spark, sf).select(*names), "area_um2", "gap_um")


@query("geometry_summary", _REGIONS + f"SELECT entity, row_type, count(*) AS n, CAST(NULL AS BIGINT) AS faces, CAST(NULL AS DOUBLE) AS widest_gap_um FROM shape GROUP BY 1, 2 UNION ALL SELECT NULL, 'contact', NULL, NULL, {r('max(gap_um)', 'widest_gap_um')} FROM touch")
def geometry_summary(spark, sf):
    return rounded(geometry.summary(flat_geometry(spark, sf)), "widest_gap_um")


@query(
    "preview_topk",
    _REGIONS + ", p AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY area_um2 DESC, label, object_id) AS place FROM shape WHERE row_type = 'instance' AND outline_vertices < 16) "
    f"SELECT object_id, entity, label, {r('area_um2', 'area_um2')}, outline_vertices FROM p WHERE place <= 5 ORDER BY area_um2 DESC, entity, label, object_id LIMIT 12",
)
def preview_topk(spark, sf):
    some = geometry.spread_preview(flat_geometry(spark, sf), "instance", per_entity=5, budget=16, limit=12)
    return rounded(some.select("object_id", "entity", "label", "area_um2", "outline_vertices"), "area_um2")


@query(
    "geometry_palette",
    _REGIONS + ", names AS (SELECT DISTINCT entity FROM shape), named AS (SELECT entity, CASE entity WHEN 'all' THEN '#d62728' WHEN 'click' THEN '#22cc33' END AS chosen FROM names) "
    f"SELECT entity, {_turn_sql(SPACE_COLOURS, 'colour')} FROM named",
)
def geometry_palette(spark, sf):
    chosen = spark.createDataFrame([("all", "#D62728"), ("click", "#2c3"), ("elsewhere", "#000000")], "entity string, entity_colour string")
    return geometry.palette(flat_geometry(spark, sf), chosen.withColumn("entity_colour", ex.hex_colour(F.col("entity_colour"))), SPACE_COLOURS)


@query(
    "carried_metrics",
    _REGIONS + ", owner AS (SELECT object_id, y, x, max(entity) AS entity FROM region GROUP BY 1, 2, 3), told AS (SELECT object_id, entity, label, count(*) * 0.02::DOUBLE * 0.02 AS area_um2 FROM region JOIN owner USING (object_id, y, x, entity) GROUP BY 1, 2, 3) "
    f"SELECT s.object_id, s.entity, s.label, {r('coalesce(t.area_um2, s.area_um2)', 'area_um2')} FROM shape s LEFT JOIN told t ON s.object_id = t.object_id AND s.entity = t.entity AND s.label = t.label WHERE row_type = 'instance'",
)
def carried_metrics(spark, sf):
    """Areas as a report has them, of the cells that a region owns; regions that own none keep the area of their geometry."""
    found = kept(regions(spark, sf))
    owned = contacts.claim(found.withColumn("z", F.lit(0)))
    told = measure.extent(owned, measure.INSTANCE, FLAT, "area_um2").withColumn("row_type", F.lit("instance"))
    rows = geometry.carry(flat_geometry(spark, sf, found), told, ["area_um2"], (*measure.INSTANCE, "row_type"))
    return rounded(rows.where("row_type = 'instance'").select(*measure.INSTANCE, "area_um2"), "area_um2")


@query("outline_counts", _REGIONS + "SELECT s.object_id, s.entity, s.label, outline_vertices AS vertices, 2 * sides AS indices FROM shape s JOIN (SELECT object_id, entity, label, count(*) AS sides FROM sides WHERE row_type = 'instance' GROUP BY ALL) e ON s.object_id = e.object_id AND s.entity = e.entity AND s.label = e.label")
def outline_counts(spark, sf):
    rows = flat_geometry(spark, sf).where("row_type = 'instance'")
    return rows.select("object_id", "entity", "label", ex.payload_count(F.col("outline"), 0).alias("vertices"), ex.payload_count(F.col("outline"), 1).alias("indices"))


def solid_geometry(spark, sf):
    masks = adapter.object_mask(spark, sf).withColumn("entity", F.lit("pm")).unionByName(adapter.nucleus(spark, sf).withColumn("entity", F.lit("nucleus")))
    return geometry.geometry_rows(adapter.voxels(spark, sf, adapter.FEW), masks, SIZE, "pm")


@query("mesh_counts")
def mesh_counts(spark, sf):
    """All instances and masks in space: meshes, and skeletons with their metrics."""
    rows = solid_geometry(spark, sf)
    return rounded(rows.select("object_id", "entity", "label", "row_type", "n_voxels", "mesh_vertices", "mesh_faces", "branches", "cable_length_um", "tortuosity"), "cable_length_um", "tortuosity")


@query(
    "skeleton_filter",
    with_views("vox16", "i AS (SELECT object_id, entity, label, count(*) AS n FROM vox16 GROUP BY 1, 2, 3)", "m AS (SELECT *, entity IN ('A', 'R') AND n <= 12 AS wanted FROM i)")
    + "SELECT object_id, entity, label, wanted AND max(CASE WHEN wanted AND n >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY object_id, entity) = 1 AS measured FROM m",
)
def skeleton_filter(spark, sf):
    """Which instances are measured: those of the named entities, up to a size, if any of the entity's has a skeleton."""
    found = geometry.skeletons(adapter.voxels(spark, sf, adapter.FEW), SIZE, geometry.entity_filter("a, R"), most=12)
    return found.select("object_id", "entity", "label", F.col("branches").isNotNull().alias("measured"))


@query("merged_meshes")
def merged_meshes(spark, sf):
    rows = geometry.merged_meshes(geometry.importable(solid_geometry(spark, sf).select("object_id", "entity", "mesh"), excluded=["pm"]))
    return rows.select("object_id", "entity", "parts", ex.payload_count(F.col("mesh"), 0).alias("vertices"), ex.payload_count(F.col("mesh"), 1).alias("indices"))


_STEPS = ", ".join(f"CAST(sum(floor(({a}::DOUBLE - {a}0::DOUBLE) / ({a}1 - {a}0)::FLOAT::DOUBLE * 65535 + 0.5)) AS BIGINT) AS {a}_steps" for a in "xyz")


@query(
    "payload_roundtrip",
    with_views("points", "b AS (SELECT entity AS of, " + ", ".join(f"min({a}) AS {a}0, max({a}) AS {a}1" for a in "xyz") + " FROM points GROUP BY 1)")
    + f"SELECT entity, count(*) AS n, 3::BIGINT AS indices, {_STEPS} FROM points JOIN b ON entity = of GROUP BY 1",
)
def payload_roundtrip(spark, sf):
    return geometry.payload_steps(adapter.points(spark, sf))


@query("skeleton_metrics")
def skeleton_metrics(spark, sf):
    return rounded(geometry.planar_skeletons(adapter.plane(spark, sf), FLAT), "cable_length_um", "tortuosity")


# --- further selections ------------------------------------------------------------------------------------------


@query("gallery_total", with_views("vox", INSTANCES) + "SELECT count(*) AS n FROM inst WHERE isfinite(volume_um3)")
def gallery_total(spark, sf):
    return instances(spark, sf).where(ex.finite(F.col("volume_um3")).isNotNull()).agg(F.count("*").alias("n"))


@query("distance_pairs", with_views("vox nucleus") + "SELECT DISTINCT v.entity, t.target FROM vox v JOIN (SELECT DISTINCT object_id, entity AS target FROM vox UNION SELECT DISTINCT object_id, 'nucleus' FROM nucleus) t ON v.object_id = t.object_id AND v.entity <> t.target")
def distance_pairs(spark, sf):
    """Which entities have distances to which, from a report's two aligned lists."""
    rows = distances(spark, sf).where("distance_um is not null")
    listed = report.to_lists(rows, "object_id", ["entity", "target", "label", "distance_um"], ["entity", "target", "label"], "distance_")
    return report.unnest(listed, ["object_id"], ["distance_entity", "distance_target"], "distance_entity").select(F.col("distance_entity").alias("entity"), F.col("distance_target").alias("target")).distinct()


@query("contact_coverage", with_views("objects vox nucleus", *CONTACTS) + "SELECT count(*) AS objects, count(i.object_id) AS with_instances, count(e.object_id) AS with_contacts FROM objects o LEFT JOIN (SELECT DISTINCT object_id FROM vox) i ON i.object_id = o.object_id LEFT JOIN (SELECT DISTINCT object_id FROM edges) e ON e.object_id = o.object_id")
def contact_coverage(spark, sf):
    return report.object_coverage(adapter.objects(spark, sf), {"with_instances": adapter.voxels(spark, sf), "with_contacts": edges(spark, sf)})


@query("maybe_int", f"SELECT event_id, CASE WHEN isfinite(v) THEN CAST(trunc(v) AS BIGINT) END AS id FROM (SELECT event_id, try_cast(nullif({'{}'}, '') AS DOUBLE) AS v FROM events)".replace("{}", "CASE user_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'NaN' WHEN 2 THEN NULL ELSE CAST(value AS VARCHAR) END"))
def maybe_int(spark, sf):
    text = F.expr("case user_id % 5 when 0 then '' when 1 then 'NaN' when 2 then null else cast(value as string) end")
    return adapter.table(spark, sf, "events").select("event_id", ex.maybe_int(text).alias("id"))


@query("object_order", with_views("objects") + "SELECT object_id, grp, CAST(CASE grp WHEN 'EUROPE' THEN 0 WHEN 'ASIA' THEN 1 ELSE 2 END AS INTEGER) AS rank, CAST(row_number() OVER (PARTITION BY grp ORDER BY object_id) AS INTEGER) AS place FROM objects")
def object_order(spark, sf):
    return report.ordered_objects(adapter.objects(spark, sf), ["EUROPE", "ASIA"])


@query(
    "object_metrics",
    with_views("vox", *GROUPS, PER_OBJECT, CLOSE_PARTNERS, PROFILE.replace("FROM vox", "FROM owned"), "o AS (SELECT object_id, count(*) AS instances, count(*) FILTER (partners > 0) AS in_contact, avg(partners) AS mean_partners FROM profile GROUP BY 1)", "t AS (SELECT object_id, median(gap_um) AS median_gap_um FROM same GROUP BY 1)")
    + f"SELECT object_id, {r('100.0 * in_contact / instances', 'pct_in_contact')}, {r('mean_partners', 'mean_partners')}, nullif(largest, 0) AS largest_cluster, {r('median_gap_um', 'median_gap_um')} FROM o LEFT JOIN t USING (object_id) LEFT JOIN per_object USING (object_id)",
)
def object_metrics(spark, sf):
    nodes, found = (kept(df) for df in close_contacts(spark, sf))
    return rounded(graph.object_metrics(contacts.profile(nodes, found), found, graph.clusters(nodes, found)), "pct_in_contact", "mean_partners", "median_gap_um")


@query(
    "object_rows",
    with_views("", _CUSTOMERS, _SOME) + "SELECT o.object_id, grp, bool_or(instance_count IS NOT NULL) AS has_instances, count(entity) AS n_entities FROM objects o LEFT JOIN chosen c ON c.object_id = o.object_id GROUP BY 1, 2",
)
def object_rows(spark, sf):
    rows = customers(spark, sf).join(some_entities(spark, sf), "object_id", "left")
    return rows.groupBy("object_id", "grp").agg(F.bool_or(F.col("instance_count").isNotNull()).alias("has_instances"), F.count("entity").alias("n_entities"))


@query("entity_rows_of_group", with_views("", _CUSTOMERS, _SOME) + f"SELECT object_id, entity, instance_count, {r('total_um3', 'total_um3')} FROM chosen WHERE object_id IN (SELECT object_id FROM objects WHERE grp = 'ASIA')")
def entity_rows_of_group(spark, sf):
    wanted = customers(spark, sf).where("grp = 'ASIA'")
    return rounded(some_entities(spark, sf).join(wanted, "object_id", "left_semi"), "total_um3")


@query(
    "significance",
    with_views(
        "vox objects", INSTANCES, GROUPED, "names AS (SELECT DISTINCT entity, grp FROM g)", "pairs AS (SELECT a.entity, a.grp AS cat_a, b.grp AS cat_b FROM names a JOIN names b ON a.entity = b.entity AND a.grp < b.grp)",
    )
    + "SELECT entity, count(*) AS pairs, round(0.05 / count(*), 6) AS level FROM pairs GROUP BY 1",
)
def significance(spark, sf):
    """Bonferroni: the level divided by the number of pairs that are shown."""
    names = grouped(spark, sf).select("entity", "grp").distinct()
    pairs = names.alias("a").join(names.withColumnRenamed("grp", "other"), "entity").where("grp < other")
    return pairs.groupBy("entity").agg(F.count("*").alias("pairs")).withColumn("level", F.round(0.05 / F.col("pairs"), 6))
