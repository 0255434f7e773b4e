import os
import types

import pyarrow as pa
import pytest

import corpus_pipeline
from voxelgrain.llm import common, components, ngram_join


def tables(spark):
    folder = f"{common.shared_dir(spark).removeprefix('file://')}/voxelgrain"
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def test_tables_go_when_nothing_needs_them(spark):
    before = tables(spark)
    df = spark.createDataFrame([(k, f"some words of text number {k // 2} and more of them") for k in range(20)], "doc_id long, text string")
    found = ngram_join.classes(df)
    left = {t.rsplit("-", 1)[0] for t in tables(spark) - before}
    assert left == {"rows", "named"} and found.count() == 20
    one = common.written(df, "one")
    common.discard(one)
    common.discard(one)
    assert not any(t.startswith("one-") for t in tables(spark))


def test_a_stage_deletes_what_the_last_one_kept(spark):
    df = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta")], "doc_id long, text string")
    with common.noting() as paths:
        kept = corpus_pipeline.near_duplicates(spark, df, "").collect()
    assert len(kept) == 1 and any(os.path.isdir(p.removeprefix("file://")) for p in paths)
    corpus_pipeline.mask_secrets(spark, df, "")
    assert not any(os.path.isdir(p.removeprefix("file://")) for p in paths)


def test_a_cluster_must_name_its_folder():
    conf = types.SimpleNamespace(get=lambda name, default: default)
    cluster = types.SimpleNamespace(conf=conf, sparkContext=types.SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError):
        common.shared_dir(cluster)


def test_components(spark):
    links = [(1, 2), (2, 3), (5, 4), (9, 9), (7, 5), (3, 2)] + [(k, k + 1) for k in range(100, 180)] + [(200, k) for k in range(201, 260)]
    df = spark.createDataFrame(links, "a long, b long").repartition(5)
    got = {r.node: r.root for r in components.components(df).collect()}
    assert [got[k] for k in (1, 2, 3, 4, 5, 7)] == [1, 1, 1, 4, 4, 4] and 9 not in got
    assert {got[k] for k in range(100, 181)} == {100} and {got[k] for k in range(200, 260)} == {200}
    assert components.components(df.limit(0)).count() == 0


def test_few_links_take_one_table_and_no_rounds(spark, monkeypatch):
    chain = [(k, k + 1) for k in range(300)] + [(900 - k, 900 - k // 2) for k in range(1, 60)]
    links = common.written(spark.createDataFrame(chain, "a long, b long").repartition(7), "links")
    with common.noting() as paths:
        few = {r.node: r.root for r in components.components(links).collect()}
    assert len(paths) == 1 and few[300] == 0 and few[900] == 841
    monkeypatch.setattr(components, "IN_ONE", 20)
    with common.noting() as paths:
        rounds = {r.node: r.root for r in components.components(links).collect()}
    assert len(paths) > 3 and rounds == few
    common.discard(links)


def test_links_are_connected_so_many_at_a_time(monkeypatch):
    monkeypatch.setattr(components, "IN_ONE", 4)
    batches = [pa.RecordBatch.from_arrays([pa.array(range(k, k + 7)), pa.array(range(k + 1, k + 8))], ["a", "b"]) for k in (0, 100)]
    found = [(nodes.tolist(), root.tolist()) for nodes, root in components._forests(batches)]
    assert found == [([*range(k, k + n)], [k] * n) for k, n in ((0, 5), (4, 4), (100, 5), (104, 4))]
