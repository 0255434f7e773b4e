import corpus_pipeline
from tests.llm.test_decontamination import ITEMS

B = ITEMS[1][1]
TEXT = " ".join(f"{x}{y}" for x in "bdfgklmnpr" for y in ("a", "e", "io", "u"))
OTHER = " ".join(reversed(TEXT.split()))


def test_one_row_of_each_group_stays(spark):
    rows = [(None, TEXT, "a"), (None, TEXT, "b"), (None, OTHER, "c"), (7, OTHER, "d"), (8, "lonely", "e"), (8, "lonely", "f"), (None, "by itself", "g"), (8, "", "h"), (8, "", "i"), (9, None, "j")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    got = sorted((r.doc_id or 0, r.text or "") for r in kept.collect())
    assert got == sorted([(0, TEXT), (7, OTHER), (8, "lonely"), (0, "by itself"), (8, ""), (8, ""), (9, "")])


def test_a_leak_takes_its_own_row_only(spark, tmp_path):
    spark.createDataFrame([(2, B)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    words = B.split()
    rows = [(None, B, "leak"), (None, TEXT, "clean"), (5, B, "leak"), (5, OTHER, "clean"), (6, " ".join(words[:9]), "part"), (6, " ".join(words[9:18]), "part")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    kept = corpus_pipeline.decontaminate(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert sorted(r.source for r in kept.collect()) == ["clean", "clean", "part", "part"]
