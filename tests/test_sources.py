"""Folders, images, reports and arrivals on disk."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelgrain import cli
from voxelgrain.operators import measure, report
from voxelgrain.plans import process
from voxelgrain.sources import folders, objects, report_files, tiff
from voxelgrain.streaming.arrivals import measure_arrivals


def put(path, volume, **more):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(tiff.write_volume(volume, **more))


@pytest.fixture()
def tree(tmp_path):
    full, mito = np.zeros((6, 12, 12), "uint8"), np.zeros((6, 12, 12), "uint16")
    full[1:5, 1:11, 1:11] = 1
    mito[2:4, 2:5, 2:5], mito[2:4, 2:5, 6:9] = 1, 2
    for group in ("control", "treated"):
        base = f"{tmp_path}/{group}/cell_a"
        put(f"{base}/c1.tif", full, spacing=0.1, resolution=(500_000, 1))
        put(f"{base}/c1_pm_mask.tif", full)
        put(f"{base}/c1_mito_labels.tif", mito)
        put(f"{base}/c10_er_label.tif", mito)
    with open(f"{tmp_path}/treated/cell_a/c1_bad_label.tif", "wb") as f:
        f.write(b"II*\0 broken")
    put(f"{tmp_path}/empty/only.tif", full)
    return str(tmp_path)


def test_discovery(spark, tree):
    files = folders.listing(spark, tree)
    assert folders.supported(files).count() == 2
    roles = {(r.folder.rsplit("/", 2)[1], r.file): (r.role, r.reason) for r in folders.discover(files).collect()}
    assert roles["control", "c1.tif"][0] == "source" and roles["control", "c1_mito_labels.tif"][0] == "entity"
    assert roles["control", "c10_er_label.tif"] == ("rejected", "not at a word's end")
    rows = {r.folder.rsplit("/", 2)[1]: r for r in folders.objects(folders.discover(files), "PM").collect()}
    assert rows["control"].channels[:2] == ["mask:pm", "label:mito"] and rows["control"].error is None
    missing = folders.objects(folders.discover(files), "nucleus").where("folder like '%control%'").first()
    assert "pm" in missing.error
    assert {r.key: r.present for r in folders.dry_run(folders.objects(folders.discover(files), "pm")).collect()}["mask:pm"] == 2


def test_refusals(spark, tree):
    loaded = objects.load(spark, tree, "pm")
    failed = {r.object_id: r.error for r in loaded.failures.collect()}
    assert "bad" in failed["treated/cell_a"] and failed["empty"] == "no entity files"
    assert [r.object_id for r in loaded.objects.collect()] == ["control/cell_a"]
    flat = objects.load(spark, tree, "pm", (0.1, 0.1))
    assert "voxel size has 2" in {r.object_id: r.error for r in flat.failures.collect()}["control/cell_a"]
    put(f"{tree}/control/cell_a/c1_small_label.tif", np.ones((6, 12, 11), "uint8"))
    odd = objects.load(spark, tree, "pm")
    assert "shape" in {r.object_id: r.error for r in odd.failures.collect()}["control/cell_a"]
    heads = objects.headers(spark, tree, folders.discover(folders.listing(spark, tree)).where("role = 'source'").select("folder", "file"))
    got = {r.folder.rsplit("/", 2)[1]: r for r in heads.collect()}
    assert got["control"].shape == [6, 12, 12] and got["control"].dtype == "uint8" and got["control"].voxel_size == pytest.approx([0.1, 0.02, 0.02])
    size = {r.folder.rsplit("/", 2)[1]: r for r in objects.estimate(folders.discover(folders.listing(spark, tree)), heads).collect()}
    assert size["control"].shape == [3, 6, 12, 12] and size["control"].bytes == 3 * 6 * 12 * 12 * 4 and size["control"].dim_order == "CZYX"


def ellipsoid(shape, centre, radii):
    at = np.stack(np.indices(shape), -1)
    return (((at - np.array(centre)) / np.array(radii)) ** 2).sum(-1) <= 1


SPECS = [("control/object_a", 4, (2, 3, 3)), ("control/object_b", 4, (2, 2.5, 2.5)), ("treated/object_c", 3, (3, 4.5, 4.5)), ("treated/object_d", 3, (3, 5, 5))]


@pytest.fixture(scope="module")
def batch(tmp_path_factory):
    """Four objects in space, as the published fixtures describe them."""
    root, shape = str(tmp_path_factory.mktemp("batch")), (20, 40, 40)
    pm, nucleus = ellipsoid(shape, (10, 20, 20), (9, 18, 18)), ellipsoid(shape, (10, 14, 14), (4, 6, 6))
    for name, n, radii in SPECS:
        mito = np.zeros(shape, "uint16")
        for i in range(n):
            t = 2 * np.pi * i / n
            mito[ellipsoid(shape, (10, 20 + 9 * np.sin(t), 20 + 9 * np.cos(t)), radii) & pm] = i + 1
        base = f"{root}/{name}/{name.split('/')[1]}"
        more = {"spacing": 0.1, "resolution": (500_000, 1)}
        put(f"{base}.tif", pm.astype("uint8"), **more)
        for entity, volume in (("pm_mask", pm), ("nucleus_mask", nucleus), ("mito_labels", mito)):
            put(f"{base}_{entity}.tif", volume.astype("uint16"), **more)
    return root


def test_process_end_to_end(spark, batch, tmp_path):
    out, palette = f"{tmp_path}/out", tmp_path / "p.json"
    palette.write_text(json.dumps({"mito": "#D62728"}))
    assert cli.main(["process", batch, "--object-mask", "pm", "--out", out, "--palette", str(palette), "--geometry"]) == 0
    rows, facts = report_files.read_report(spark, f"{out}/report")
    assert facts["object_mask"] == "pm" and rows.count() == 16 and not os.path.exists(f"{out}/parts")
    found = {r.object_id: r for r in report.object_level(rows).collect()}
    assert [found[name].instance_count for name, _, _ in SPECS] == [4, 4, 3, 3] and len(found) == 4
    assert found["control/object_a"].channels == ["mask:pm", "label:mito", "mask:nucleus"]
    assert found["control/object_a"].imported_path_short == "control" and found["treated/object_d"].imported_path_short == "treated"
    assert found["control/object_a"].object_shape == [19, 37, 37] and found["control/object_a"].voxel_size_source == "tiff-metadata"
    instances = report.unnest(report.object_level(rows), ["object_id"], ["instance_entity", "instance_label", "instance_volume_um3", "instance_branches"], "instance_entity")
    assert instances.count() == 14
    far = report.unnest(report.object_level(rows), ["object_id"], ["distance_entity", "distance_target", "distance_distance_um", "distance_hist_counts"], "distance_entity")
    assert far.count() == 28 and {r.distance_target for r in far.collect()} == {"nucleus", "pm"} and min(r.distance_distance_um for r in far.collect()) == 0
    touching = report.unnest(report.object_level(rows), ["object_id"], ["contact_entity_a", "contact_entity_b", "contact_gap_um"], "contact_entity_a").collect()
    assert {r.object_id for r in touching} == set(found) and all(r.contact_gap_um <= 0.5 + 1e-6 for r in touching)
    assert all("pm" not in (r.contact_entity_a, r.contact_entity_b) for r in touching)
    parts = {(r.object_id, r.entity_name): r for r in report.entity_level(rows).collect()}
    assert len(parts) == 12 and all((r.entity_colour == "#d62728") == (name == "mito") for (_, name), r in parts.items())
    pm = ellipsoid((20, 40, 40), (10, 20, 20), (9, 18, 18)).sum() * 0.1 * 0.02 * 0.02
    assert found["control/object_b"].object_volume_um3 == pytest.approx(pm, rel=1e-5)
    assert report.vocabulary(rows.columns)["noun"] == "volume" and report.metrics_of(rows.columns)[0] == "volume_um3"
    shapes = report_files.read_geometry(spark, [f"{out}/geometry/size=0"])
    kinds = {r.row_type: r.n for r in shapes.groupBy("row_type").agg(F.count("*").alias("n")).collect()}
    assert kinds["instance"] == 14 and kinds["file"] == 8 and kinds["contact"] == len(touching)
    assert shapes.where("row_type = 'instance' and mesh is null").count() == 0
    assert cli.main(["colours", f"{out}/report", str(palette)]) == 0
    again, kept_facts = report_files.read_report(spark, f"{out}/report")
    assert kept_facts == facts and again.where("entity_colour is not null").count() == 4


def test_resume_measures_what_is_left(spark, batch, tmp_path):
    loaded = objects.load(spark, batch, "pm")
    done = spark.createDataFrame([(name, 0) for name, _, _ in SPECS[:3]], "object_id string, obs_level int")
    rows = process.process(loaded, "pm", process.Settings(skeleton_entities=frozenset()), done)
    assert {r.object_id for r in rows.collect()} == {"treated/object_d"}
    assert rows.where("instance_branches is not null").count() == 0
    assert process.process(loaded, "pm", done=loaded.objects) is None


def test_planes(spark, tmp_path):
    disc = ellipsoid((60, 60), (30, 30), (28, 28))
    mito = np.where(ellipsoid((60, 60), (30, 46), (3, 3)), 1, 0) + np.where(ellipsoid((60, 60), (46, 30), (3, 3)), 2, 0)
    pieces = ellipsoid((60, 60), (20, 20), (3, 3)) | ellipsoid((60, 60), (35, 35), (2, 2))
    base = f"{tmp_path}/in/flat/one"
    put(f"{base}.tif", disc.astype("uint8"), resolution=(500_000, 1))
    for entity, volume in (("boundary_mask", disc), ("mito_labels", mito), ("pieces_mask", pieces), ("gone_mask", ~disc)):
        put(f"{base}_{entity}.tif", volume.astype("uint8"))
    loaded = objects.load(spark, f"{tmp_path}/in", "boundary")
    assert loaded.failures.count() == 0
    rows = process.process(loaded, "boundary").cache()
    top = report.object_level(rows).first()
    assert top.spatial_dims == 2 and top.object_area_um2 == pytest.approx(disc.sum() * 0.0004) and top.instance_count == 4
    kinds = {r.entity_name: r.entity_kind for r in report.entity_level(rows).collect()}
    assert kinds == {"boundary": "mask", "mito": "label", "pieces": "label", "gone": "mask"}
    far = {(r.e, r.t): r.d for r in report.unnest(report.object_level(rows), [], ["distance_entity", "distance_target", "distance_distance_um"], "distance_entity").toDF("e", "t", "d").collect()}
    assert far["mito", "gone"] is None and far["mito", "pieces"] > 0
    assert report.vocabulary([c for c in rows.columns if rows.where(F.col(c).isNotNull()).count()])["noun"] == "area"


def test_report_files(spark, tmp_path):
    df = spark.createDataFrame([("o", 1, "mito", 0.25, None), ("o", 1, "er", 0.5, None)], "object_id string, obs_level int, entity_name string, volume_um3 double, empty double")
    path = f"{tmp_path}/report"
    report_files.write_report(df, path, ("object_id", "obs_level"), facts={"flavor": "x"}, comments={"volume_um3": "extent"})
    back, facts = report_files.read_report(spark, path)
    assert facts == {"flavor": "x"} and "empty" not in back.columns and dict(back.dtypes)["volume_um3"] == "float"
    assert back.schema["volume_um3"].metadata == {"comment": "extent"}
    palette = tmp_path / "p.json"
    palette.write_text(json.dumps({"mito": "#D62728", "ER": "#2c3"}))
    found = report_files.read_palette(spark, str(palette))
    assert found == {"mito": "#d62728", "er": "#22cc33"}
    assert report_files.recolour(back, {"mito": "#d62728"})[1] == 1
    for bad in ('{"a": "red"}', "[1]", "{", '{"a": 3}'):
        palette.write_text(bad)
        with pytest.raises(ValueError):
            report_files.read_palette(spark, str(palette))


def test_resume(spark, tmp_path):
    parts = f"{tmp_path}/parts"
    wanted = spark.createDataFrame([("a",), ("b",)], "object_id string")
    assert report_files.finished(spark, parts) is None
    report_files.write_parts(spark.createDataFrame([("a", 0, 1.0)], "object_id string, obs_level int, v double"), parts)
    for _ in range(2):
        report_files.write_parts(spark.createDataFrame([("a", 0, 1.0)], "object_id string, obs_level int, v double"), parts)
    with open(f"{parts}/object_id=a/part-broken.parquet", "wb") as f:
        f.write(b"PAR1 nothing")
    assert report_files.finished(spark, parts).count() == 1
    assert [r.object_id for r in report_files.remaining(wanted, report_files.finished(spark, parts)).collect()] == ["b"]
    report_files.discard_parts(spark, parts)
    assert report_files.finished(spark, parts) is None


def test_geometry_files(spark, tmp_path):
    path = f"{tmp_path}/g"
    assert report_files.usable_geometry(spark, path) is None
    report_files.write_geometry(spark.createDataFrame([("o", bytearray(b"")), ("o", bytearray(b"xy"))], "object_id string, mesh binary"), path)
    assert report_files.usable_geometry(spark, path) == 2 and spark.read.parquet(path).where("mesh is null").count() == 1
    got = report_files.values_table(spark, [("a", float("nan")), ("b", 1.0)], "k string, v double")
    assert got.where(F.col("v").isNull()).count() == 1


def test_arrivals(spark, tmp_path):
    rows = spark.createDataFrame([("o", "e", 1, 0, 0, k) for k in range(4)], "object_id string, entity string, label long, z int, y int, x int")
    rows.write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        measure_arrivals(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/ck", (0.1, 0.02, 0.02)).awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert [(r.object_id, r.n_voxels) for r in got] == [("o", 4)]
    assert measure.INSTANCE == ("object_id", "entity", "label")
