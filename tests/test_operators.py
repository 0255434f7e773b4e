"""Operators on small literal objects in anisotropic voxels."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelgrain.functions import expressions as ex
from voxelgrain.functions import spatial
from voxelgrain.operators import contacts, distance, geometry, graph, measure, report

SIZE = (0.1, 0.02, 0.02)


def block(entity, label, origin, size=(3, 3, 3), obj="o"):
    return [(obj, entity, label, origin[0] + z, origin[1] + y, origin[2] + x) for z, y, x in np.ndindex(*size)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "object_id string, entity string, label long, z int, y int, x int")


@pytest.mark.parametrize(("second", "gap"), [((2, 2, 5), 0.02), ((2, 2, 7), 0.06), ((2, 2, 8), None)])
def test_gap_counts_voxel_steps(spark, second, gap):
    rows = frame(spark, block("mito", 1, (2, 2, 2)) + block("mito", 2, second))
    got = contacts.edges(contacts.claim(rows), 0.06, SIZE).collect()
    assert [round(r.gap_um, 6) for r in got] == ([gap] if gap else [])


def test_gap_in_z_mask_partners_and_wide_gaps(spark):
    rows = frame(spark, block("mito", 1, (2, 2, 2), (2, 3, 3)) + block("mito", 2, (5, 2, 2), (2, 3, 3)))
    assert [round(r.gap_um, 6) for r in contacts.edges(contacts.claim(rows), 0.2, SIZE).collect()] == [0.2]
    wide = contacts.edges(contacts.claim(rows), 1.0, SIZE)
    assert [round(r.gap_um, 6) for r in wide.collect()] == [0.2]
    masks = frame(spark, block("nucleus", None, (2, 2, 5))).drop("label")
    found = contacts.edges(contacts.claim(frame(spark, block("mito", 1, (2, 2, 2))), masks), 0.05, SIZE).collect()
    assert [(r.entity_a, r.label_a, r.entity_b, r.label_b) for r in found] == [("mito", 1, "nucleus", None)]


def test_wide_and_narrow_gaps_agree(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = frame(spark, [("o", "e%d" % rng.integers(2), int(rng.integers(1, 9)), *map(int, rng.integers(0, 12, 3))) for _ in range(200)]).dropDuplicates(["entity", "z", "y", "x"])
    cells = contacts.claim(rows).cache()
    one = sorted(map(tuple, contacts.edges(cells, 0.07, (0.05, 0.02, 0.02)).withColumn("gap_um", F.round("gap_um", 6)).collect()))
    monkeypatch.setattr(contacts, "MOST_SHIFTS", 0)
    assert one == sorted(map(tuple, contacts.edges(cells, 0.07, (0.05, 0.02, 0.02)).withColumn("gap_um", F.round("gap_um", 6)).collect()))


def test_later_labels_and_labels_before_masks(spark):
    rows = frame(spark, [("o", "a", 1, 0, 0, 0), ("o", "b", 2, 0, 0, 0), ("o", "a", 3, 0, 0, 1)])
    masks = frame(spark, [("o", "m", None, 0, 0, 1), ("o", "n", None, 0, 0, 2), ("o", "m", None, 0, 0, 2)]).drop("label")
    got = {r.x: (r.entity, r.label) for r in contacts.claim(rows, masks).collect()}
    assert got == {0: ("b", 2), 1: ("a", 3), 2: ("m", None)}


def test_distances(spark):
    rows = frame(spark, block("mito", 1, (2, 2, 2)) + block("mito", 2, (2, 2, 14)) + block("er", 1, (6, 9, 9)))
    masks = frame(spark, block("nucleus", None, (2, 2, 8))).drop("label")
    got = distance.to_targets(rows, masks, SIZE, histogram=True).collect()
    by = {(r.entity, r.label, r.target): r for r in got}
    assert by["mito", 1, "nucleus"].distance_um == pytest.approx(0.08)
    assert all(sum(r.bins) == 27 and len(r.bins) == 20 and r.mean_distance_um >= r.distance_um for r in got)
    assert {(r.entity, r.target) for r in got} == {("mito", "er"), ("mito", "nucleus"), ("er", "mito"), ("er", "nucleus")}


def test_distance_to_the_outside(spark):
    inside = [("o", "pm", z, y, x) for z, y, x in np.ndindex(10, 20, 20) if 1 <= z < 9 and 1 <= y < 19 and 1 <= x < 19] + [("o", "grid", 0, 0, 0), ("o", "grid", 9, 19, 19)]
    masks = spark.createDataFrame(inside, "object_id string, entity string, z int, y int, x int")
    got = distance.to_targets(frame(spark, block("mito", 1, (4, 4, 4), (2, 2, 2))), masks, SIZE, object_mask="pm").where("target = 'pm'").first()
    assert got.distance_um == pytest.approx(4 * 0.02)


def test_nearest_and_direction(spark):
    rows = frame(spark, block("mito", 1, (2, 2, 2), (2, 2, 2)) + block("er", 1, (2, 2, 7), (2, 2, 2)) + block("mito", 2, (2, 2, 12), (2, 2, 2)))
    inst = measure.extent(rows, measure.INSTANCE, SIZE)
    got = {(r.entity, r.label): r.nearest_um for r in distance.nearest_same(inst).collect()}
    assert got["mito", 1] == pytest.approx(0.2) and got["er", 1] is None
    centre = measure.extent(rows.where("entity = 'mito' and label = 1"), ("object_id",), SIZE)
    polar = {(r.entity, r.label): r for r in measure.polarity(inst, centre).collect()}
    assert polar["mito", 2].az_deg == pytest.approx(0) and polar["mito", 1].az_deg is None and polar["mito", 1].dist == 0


@pytest.mark.parametrize(("shape", "size", "centre"), [((41, 81, 81), (0.1, 0.05, 0.05), (20, 40, 40)), ((81, 81), (0.05, 0.05), (40, 40))])
def test_round_shapes(spark, shape, size, centre):
    at = np.stack(np.indices(shape), -1)
    cells = np.argwhere((((at - np.array(centre)) * size) ** 2).sum(-1) <= 1)
    axes = measure.AXES[len(shape)]
    df = spark.createDataFrame([("o", "e", 1, *map(int, c)) for c in cells], "object_id string, entity string, label long, " + ", ".join(f"{a} int" for a in axes))
    size_of = measure.extent(df, measure.INSTANCE, size).first().volume_um3
    edge = measure.boundary(df, measure.INSTANCE, size).first()[-1]
    if len(shape) == 3:
        assert size_of == pytest.approx(4 * math.pi / 3, rel=0.01) and edge == pytest.approx(4 * math.pi, rel=0.02)
        ratio = measure.aspect_ratio_3d(df, measure.INSTANCE, size).first().aspect_ratio
    else:
        assert size_of == pytest.approx(math.pi, rel=0.01) and edge == pytest.approx(2 * math.pi, rel=0.02)
        ratio = measure.aspect_ratio_2d(df, measure.INSTANCE, size).first().aspect_ratio
    assert ratio == pytest.approx(1, abs=0.02)


def test_clusters(spark):
    inst = spark.createDataFrame([("a", "mito", k) for k in (1, 2, 3, 4)] + [("b", "mito", 1), ('c "1"', "mito", 1), ('c "1"', "gr", 7)], "object_id string, entity string, label long")
    links = spark.createDataFrame([("a", "mito", 1, "mito", 2), ("a", "mito", 2, "mito", 3), ('c "1"', "gr", 7, "mito", 1), ("b", "mito", 1, "nucleus", None)], "object_id string, entity_a string, label_a long, entity_b string, label_b long")
    got = {r.object_id: r for r in graph.per_object(graph.clusters(inst, links)).collect()}
    assert (got["a"].clusters, got["a"].clustered, got["a"].largest, got["a"].mixed) == (1, 3, 3, 0)
    assert got['c "1"'].mixed == 1 and got["b"].clusters == 1
    strict = {r.object_id: r for r in graph.per_object(graph.clusters(inst, links, strict=True)).collect()}
    assert strict["b"].clusters == 0


def test_null_model(spark):
    members = spark.createDataFrame([("o", "m", k, "m:1" if k < 3 else f"m:{k}") for k in range(1, 9)], "object_id string, entity string, label long, cluster string")
    far = spark.createDataFrame([("o", "m", k, "t", k / 10) for k in range(1, 9)], "object_id string, entity string, label long, target string, distance_um double")
    got = graph.cluster_reach(members, far).collect()
    assert [(r.size, r.observed_um, round(r.beats, 9)) for r in got] == [(2, 0.1, 87.5)]
    whole = members.withColumn("cluster", F.lit("m:1"))
    assert graph.cluster_reach(whole, far).first().beats is None
    assert graph.cluster_reach(members, far.withColumn("target", F.lit("m"))).count() == 0


def test_shares_sum_to_one(spark):
    matrix = spark.createDataFrame([("a", "m", "m", 4), ("a", "m", "t", 2), ("b", "m", "t", 1)], "grp string, s1 string, s2 string, n long")
    sums = contacts.partner_shares(matrix).groupBy("grp", "structure").agg(F.sum("share").alias("s")).collect()
    assert len(sums) == 4 and all(r.s == pytest.approx(1) for r in sums)


def test_lists_and_back(spark):
    rows = spark.createDataFrame([("o", "e", k, float(k), None) for k in range(3)] + [("p", "e", 1, None, None)], "object_id string, entity string, label long, v double, w double")
    lists = report.to_lists(rows, "object_id", ["entity", "label", "v", "w"], ["entity", "label"], "")
    by = {r.object_id: r for r in lists.collect()}
    assert by["o"].w is None and by["p"].v is None and by["o"].v == [0, 1, 2]
    back = report.unnest(lists, ["object_id"], ["entity", "label", "v", "w"], "entity")
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(map(tuple, rows.collect()), key=repr)
    assert "w" not in report.prune_all_null(lists).columns
    assert dict(report.as_float32(lists).dtypes)["v"] == "array<float>"


def test_expressions(spark):
    df = spark.createDataFrame([("s_golgi_body_label", "#D62728", "control/x"), ("C1 nucleus Mask", "#2c3", "a/b"), ("image", "red", "x")], "stem string, colour string, folder string")
    rows = df.select(ex.entity_file(F.col("stem")).alias("e"), ex.hex_colour(F.col("colour")).alias("c"), ex.group_of(F.col("folder"), ["control"]).alias("g")).collect()
    assert tuple(rows[0].e) == ("s_golgi", "body", "label") and tuple(rows[1].e) == ("c1", "nucleus", "mask") and rows[2].e is None
    assert [r.c for r in rows] == ["#d62728", "#22cc33", None] and [r.g for r in rows] == ["control", "a", ""]
    explode = lambda d, n, f: spark.range(1).select(ex.explode_offset(F.lit(d), tuple(map(F.lit, n)), F.lit(f))).first()[0]
    assert explode(3.0, (1.0, 0.0, 0.0), 2.0) == [6, 0, 0] and explode(3.0, (0.0, 0.0, 1.0), 2.0) == [0, 0, 6] and explode(3.0, (1.0, 0.0, 0.0), 0.0) == [0, 0, 0]
    names = spark.createDataFrame([("run_a_1_end",), ("run_b_1_end",), ("run_c_2_end",)], "id string")
    assert [r.short for r in report.short_labels(names).orderBy("id").collect()] == ["a_1", "b_1", "c_2"]
    odd = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,)], "v double")
    assert [r[0] for r in odd.select(ex.finite(F.col("v"))).collect()] == [1.0, None, None, None]


def test_short_labels_keep_what_tells_ids_apart(spark):
    short = lambda *ids: [r.short for r in report.short_labels(spark.createDataFrame([(i,) for i in ids], "id string")).orderBy("id").collect()]
    assert short("a_b_c") == ["a_b_c"]
    assert short("a", "a_b") == ["a", "a_b"]
    assert short("x_a", "x_b") == ["a", "b"]
    assert short("x_a", "x_a_c") == ["a", "a_c"]
    assert short("x_a_c_z", "x_b_z") == ["a_c", "b"]


def test_directions_that_cancel_out(spark):
    rows = frame(spark, [("o", "e", 1, 0, 0, x) for x in (0, 1, 3, 4)] + [("o", "e", 2, 0, 0, x) for x in (0, 1)])
    centres = spark.createDataFrame([("o", 0.0, 0.0, 0.04)], "object_id string, centroid_z_um double, centroid_y_um double, centroid_x_um double")
    got = {r.label: r.polar_spread_deg for r in measure.polar_spread(rows, centres, SIZE).collect()}
    assert got[1] == pytest.approx(0) and got[2] is None


def test_the_object_mask_stays_a_mask(spark):
    rows = spark.createDataFrame([("o", e, 0, 0, x) for e in ("pm", "er") for x in (0, 5)], "object_id string, entity string, z int, y int, x int")
    got = {(r.entity, r.kind, r.label) for r in measure.promote(rows, object_mask="pm").collect()}
    assert got == {("pm", "mask", None), ("er", "label", 1), ("er", "label", 2)}


def test_nearest_of_clustered_and_equal_points(spark):
    rng = np.random.default_rng(5)
    points = np.concatenate([rng.normal(0, 0.001, (60, 3)), rng.random((40, 3)) * 100, np.full((3, 3), 7.0), [[1e4, 0, 0]]])
    rows = [("o", "e", k, *map(float, p)) for k, p in enumerate(points)] + [("o", "lone", 1, 0.0, 0.0, 0.0), ("p", "line", 1, 0.0, 0.0, 0.0), ("p", "line", 2, 0.0, 0.0, 9.0)]
    df = spark.createDataFrame(rows, "object_id string, entity string, label long, centroid_z_um double, centroid_y_um double, centroid_x_um double")
    got = {(r.object_id, r.entity, r.label): r.nearest_um for r in distance.nearest_same(df).collect()}
    far = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    np.fill_diagonal(far, np.inf)
    assert len(got) == len(rows)
    assert all(got["o", "e", k] == pytest.approx(d, abs=1e-9) for k, d in enumerate(far.min(axis=1)))
    assert got["o", "lone", 1] is None and got["p", "line", 1] == 9.0


def test_gaps_between_surfaces_alone(spark):
    rows = frame(spark, block("mito", 1, (0, 0, 0), (6, 7, 8)) + block("mito", 2, (0, 0, 12), (6, 7, 8)) + block("er", 1, (9, 0, 0), (5, 5, 5)))
    cells = contacts.claim(rows)
    assert contacts.surface(cells).count() == (6 * 7 * 8 - 4 * 5 * 6) * 2 + 125 - 27
    wide = {(r.entity_a, r.entity_b): round(r.gap_um, 6) for r in contacts.edges(cells, 0.4, SIZE).collect()}
    assert wide["mito", "mito"] == 0.1 and wide["er", "mito"] == 0.4
    assert contacts.edges(cells, 0.4, SIZE, same_type=True).count() == 1


def test_targets_without_a_cell(spark):
    rows = frame(spark, block("mito", 1, (0, 0, 0)))
    masks = spark.createDataFrame([("o", "nucleus", 0, 0, 9)], "object_id string, entity string, z int, y int, x int")
    names = spark.createDataFrame([("o", "mito"), ("o", "gone"), ("o", "nucleus"), ("empty", "gone")], "object_id string, entity string")
    got = {r.target: r.distance_um for r in distance.to_targets(rows, masks, SIZE, targets=names).collect()}
    assert got["gone"] is None and got["nucleus"] == pytest.approx(0.14) and set(got) == {"gone", "nucleus"}


def test_what_is_not_measured_of_skeletons(spark):
    rows = frame(spark, block("er", 1, (0, 0, 0), (1, 1, 9)) + block("er", 2, (5, 0, 0), (1, 1, 1)) + block("er", 3, (9, 0, 0), (2, 2, 9)) + block("dot", 1, (20, 0, 0), (1, 1, 1)))
    got = {(r.entity, r.label): (r.branches, r.cable_length_um) for r in geometry.skeletons(rows, SIZE, most=20).collect()}
    assert got["er", 1][0] == 1 and got["er", 2] == (0, 0.0) and got["er", 3] == (None, None) and got["dot", 1] == (None, None)
    none = geometry.skeletons(rows, SIZE, geometry.entity_filter(None, none=True)).where("branches is not null")
    assert none.count() == 0 and geometry.entity_filter("ER , Golgi-body") == {"er", "golgi_body"} and geometry.entity_filter(None) is None
    some = geometry.skeletons(rows, SIZE, geometry.entity_filter("Er"))
    assert {r.entity for r in some.where("branches is not null").collect()} == {"er"}


def test_scenes_and_places(spark):
    rows = frame(spark, block("a", 1, (0, 0, 0)) + block("a", 2, (0, 0, 9)) + block("b", 1, (9, 0, 0), (1, 1, 2)))
    masks = spark.createDataFrame([("o", "pm", z, y, x) for _, _, _, z, y, x in block("a", 1, (0, 0, 0))], "object_id string, entity string, z int, y int, x int")
    found = geometry.geometry_rows(rows, masks, SIZE, "pm")
    assert geometry.importable(found).count() == 3 and geometry.importable(found, entities=["a", "pm"], excluded=["pm"]).count() == 2
    (one,) = geometry.merged_meshes(geometry.importable(found, ["o"], ["a"])).collect()
    parts = [geometry.decode_payload(r.mesh) for r in geometry.importable(found, ["o"], ["a"]).collect()]
    whole = geometry.decode_payload(one.mesh)
    assert one.parts == 2 and len(whole[0]) == sum(len(v) for v, _ in parts) and whole[1].max() == len(whole[0]) - 1
    summary = {(r.entity, r.row_type): (r.n, r.faces) for r in geometry.summary(found).collect()}
    assert summary["a", "instance"] == (2, sum(len(f) for _, f in parts)) and summary["pm", "file"][0] == 1
    places = spark.createDataFrame([("o", "g", "/x/o.parquet"), ("p", "g", None)], "object_id string, grp string, mesh_geometry_file string")
    assert [r.path for r in geometry.locations(places).collect()] == ["/x/o.parquet"]
    assert [r.path for r in geometry.locations(places, "http://h/").collect()] == ["http://h/o/geometry.parquet"]


def test_accessors(spark):
    df = spark.createDataFrame([(0.1, 0.02, 0.02, 1.0, None)], "pixel_size_Z double, pixel_size_Y double, pixel_size_X double, object_center_y_um double, object_center_x_um double")
    row = df.select(spatial.voxel_size(spatial.spatial_axes("CZYX")).alias("a"), spatial.voxel_size("YX").alias("b"), spatial.object_center("YX").alias("c")).first()
    assert row.a == [0.1, 0.02, 0.02] and row.b == [0.02, 0.02] and row.c is None and spatial.spatial_axes("CYX") == "YX"
    texts = spark.createDataFrame([("12",), ("3.0",), ("",), ("NaN",), ("x",), (None,)], "v string")
    assert [r[0] for r in texts.select(ex.maybe_int(F.col("v"))).collect()] == [12, 3, None, None, None, None]
    links = spark.createDataFrame([("o", "b", 1, "b", 2), ("o", "a", None, "b", 1), ("o", "a", 1, "a", 2)], "object_id string, entity_a string, label_a long, entity_b string, label_b long")
    assert [(r.entity_a, r.label_a) for r in contacts.ordered(links).collect()] == [("a", None), ("a", 1), ("b", 1)]
    rows = spark.createDataFrame([("o", 0, None), ("o", 1, "e"), ("o", 1, None)], "object_id string, obs_level int, entity_name string")
    assert report.entity_level(rows).count() == 1 and report.object_level(rows).count() == 1


def test_natural_gaps_in_small(spark):
    rows = spark.createDataFrame([("a", "m", 2), ("a", "n", None), ("b", "m", 1)], "object_id string, entity string, instance_count long")
    objects = spark.createDataFrame([("a",), ("b",), ("c",)], "object_id string")
    grid = report.presence(objects, rows, rows)
    assert {(r.object_id, r.entity) for r in grid.where("missing").collect()} == {("b", "n"), ("c", "m"), ("c", "n")}
    assert {(r.entity, r.missing_in) for r in report.structure_gaps(grid).collect()} == {("m", 1), ("n", 2)}


def test_contacts_across_blocks_shuffle_cells_not_steps(spark, monkeypatch):
    rng = np.random.default_rng(11)
    rows = [("o%d" % rng.integers(2), "e%d" % rng.integers(2), int(rng.integers(1, 6)), *map(int, rng.integers(-9, 14, 3))) for _ in range(600)]
    cells = contacts.claim(frame(spark, rows), frame(spark, block("nucleus", None, (-3, -3, -3), (5, 5, 5), "o0")).drop("label")).cache()
    gap, size = 0.065, (0.03, 0.02, 0.02)
    at = cells.collect()
    want: dict = {}
    for i, a in enumerate(at):
        for b in at[i + 1 :]:
            ends = sorted([(a.entity, -1 if a.label is None else a.label), (b.entity, -1 if b.label is None else b.label)])
            far = math.sqrt(sum(((p - q) * s) ** 2 for p, q, s in zip((a.z, a.y, a.x), (b.z, b.y, b.x), size, strict=True)))
            if a.object_id == b.object_id and ends[0] != ends[1] and far <= gap + 1e-9:
                want[a.object_id, *ends[0], *ends[1]] = min(far, want.get((a.object_id, *ends[0], *ends[1]), 9))
    label = lambda v: -1 if v is None else v
    for side in (64, 5):
        monkeypatch.setattr(contacts, "BLOCK", side)
        found = contacts.edges(cells, gap, size)
        got = {(r.object_id, r.entity_a, label(r.label_a), r.entity_b, label(r.label_b)): r.gap_um for r in found.collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
        # No step multiplies the rows before a shuffle.
        assert "array(struct" not in found._jdf.queryExecution().optimizedPlan().toString() and "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_a_drawn_mask_is_not_broadcast(spark):
    grid = spark.range(3).select(F.col("id").cast("string").alias("object_id")).select("object_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("z")).select("*", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("y"), F.lit(1).alias("x"))
    rows = frame(spark, block("er", 1, (3, 3, 0), (4, 4, 3), "1"))
    found = measure.clip(rows, grid)
    assert found.count() == 4
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_masks_are_promoted_in_one_pass_of_many(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [("o%d" % k, e, 0, int(y), int(x)) for k in range(40) for e in ("a", "b") for y, x in rng.integers(0, 6, (rng.integers(1, 12), 2))]
    cells = spark.createDataFrame(rows, "object_id string, entity string, z int, y int, x int").distinct().cache()
    found = measure.promote(cells)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan and "FlatMapGroups" not in plan
    want = {}
    for name in {(r.object_id, r.entity) for r in cells.collect()}:
        of = sorted((r.z, r.y, r.x) for r in cells.collect() if (r.object_id, r.entity) == name)
        labels = measure.component_labels(np.array(of)).tolist()
        want |= {(*name, *c): (k if max(labels) > 1 else None) for c, k in zip(of, labels, strict=True)}
    assert {(r.object_id, r.entity, r.z, r.y, r.x): r.label for r in found.collect()} == want


def test_distances_of_many_objects_by_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = {("o%d" % k, "e%d" % e, int(rng.integers(1, 4)), *map(int, c)) for k in range(12) for e in range(3) for c in rng.integers(0, (4, 9, 5), (rng.integers(1, 9), 3))}
    voxels = frame(spark, sorted(rows))
    # Along short lines, envelopes are not made one object at a time.
    monkeypatch.setattr(distance, "_envelope", None)
    found = distance.to_targets(voxels, voxels.where("false").select("object_id", "entity", "z", "y", "x"), SIZE, histogram=True)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
    near: dict = {}
    for o, e, k, *c in rows:
        for target in {f for p, f, *_ in rows if p == o} - {e}:
            near.setdefault((o, e, k, target), []).append(min(math.sqrt(sum(((p - q) * s) ** 2 for p, q, s in zip(c, t[3:], SIZE, strict=True))) for t in rows if t[:2] == (o, target)))
    got = {(r.object_id, r.entity, r.label, r.target): r for r in found.collect()}
    assert got.keys() == near.keys()
    for name, d in near.items():
        assert got[name].distance_um == pytest.approx(min(d)) and got[name].mean_distance_um == pytest.approx(np.mean(d)) and sum(got[name].bins) == len(d)


def test_reach_is_made_of_distances_made_once(spark):
    rows = [("o", "e", 1, "a", 0.2), ("o", "e", 1, "b", 0.1), ("o", "e", 1, "c", None), ("o", "e", 1, "d", 0.4), ("o", "e", 2, "a", 0.3)]
    found = report.reach(spark.createDataFrame(rows, "object_id string, entity string, label long, target string, distance_um double"))
    assert {(r.label, r.target_a, r.target_b): r.reach_um for r in found.collect()} == {(1, "a", "b"): 0.2, (1, "a", "d"): 0.4, (1, "b", "d"): 0.4}
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_clusters_of_many_objects_in_one_call(spark):
    inst = spark.createDataFrame([(o, "mito", k) for o in "pq" for k in (1, 2, 3)] + [("r", "er", 10), ("r", "er", 9)], "object_id string, entity string, label long")
    links = [("p", "mito", 1, "mito", 3, 0.0), ("q", "mito", 2, "nucleus", None, 0.0), ("q", "mito", 3, "nucleus", None, 0.0), ("r", "er", 9, "er", 10, 0.0), ("s", "er", 1, "er", 2, 0.0)]
    links = spark.createDataFrame(links, "object_id string, entity_a string, label_a long, entity_b string, label_b long, gap_um double")
    found = graph.clusters(inst, links)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "CoGroup" not in plan
    got = {(r.object_id, r.entity, r.label): r.cluster for r in found.collect()}
    assert len(got) == 11 and got["p", "mito", 3] == got["p", "mito", 1] == "mito:1" and got["p", "mito", 2] == "mito:2"
    assert got["q", "mito", 3] == got["q", "nucleus", None] == "mito:2" and got["r", "er", 10] == "er:9" and got["s", "er", 2] == "er:1"
    strict = {(r.object_id, r.entity, r.label): r.cluster for r in graph.clusters(inst, links, strict=True).collect()}
    assert len(strict) == 8 and strict["q", "mito", 3] == "mito:3" and strict["r", "er", 10] == "er:9"


def test_geometry_is_made_when_asked_for(spark):
    cells = [(e, k, y, x) for e, k in (("a", 1), ("a", 2), ("b", 1)) for y, x in ((0, 0), (0, 1), (1, 1), (5, 5), (5, k + 5))]
    rows = spark.createDataFrame([("o", *c) for c in cells], "object_id string, entity string, label long, y int, x int").distinct()
    masks = rows.select("object_id", F.lit("all").alias("entity"), "y", "x").distinct()
    found = geometry.geometry_rows(rows, masks, (0.02, 0.02), "all")
    # An outline needs no skeleton, and an instance no mask's outline.
    plan = found.where("row_type = 'instance'").select("object_id", "outline")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") <= 1 and "Window" not in plan and "Join" not in plan
    whole = geometry.shapes(rows, measure.INSTANCE, (0.02, 0.02)).drop("n_voxels")
    got = {(r.entity, r.label): r for r in found.where("row_type = 'instance'").collect()}
    for r in whole.collect():
        for c in whole.columns[3:]:
            assert got[r.entity, r.label][c] == (None if r[c] is None else pytest.approx(r[c])), c
