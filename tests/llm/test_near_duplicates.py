import corpus_pipeline
from tests.llm import test_ngram_join as t
from voxelgrain.llm import ngram_join
from voxelgrain.llm.common import noting


def test_stage_takes_five_words_at_80_percent(spark):
    words = [f"w{k}" for k in range(104)]
    near = " ".join(["other" if k in (30, 70) else w for k, w in enumerate(words)])  # 90 of 110 five-word shingles
    far = " ".join(["other" if k in (20, 50, 80) else w for k, w in enumerate(words)])  # 85 of 115
    rows = [(1, " ".join(words)), (2, near), (3, "something else altogether that has seven words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert t.brute(rows)[1][2] == 2
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [1, 3]
    docs = spark.createDataFrame([rows[0], (2, far)], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [1, 2]


def test_five_words_against_brute_force(spark, monkeypatch):
    rows = t.corpus(5, 6, 8)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.id, r.n, r.component) for r in ngram_join.classes(docs, n=5, percent=80).collect())
    three = t.shingles
    monkeypatch.setattr(t, "shingles", lambda text: three(text, 5))
    assert got == t.brute(rows, 80)


def test_few_links_write_no_tables_of_rounds(spark):
    rows = t.corpus(6, 3, 6)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    with noting() as paths:
        corpus_pipeline.near_duplicates(spark, docs, "").collect()
    names = [p.rpartition("/")[2].rpartition("-")[0] for p in paths]
    assert names.count("roots") == 4 and "edges" not in names
