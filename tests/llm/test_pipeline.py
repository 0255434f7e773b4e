import hashlib
import random

import pyarrow as pa
import sentencepiece

import corpus_pipeline
from tests.llm import test_decontamination, test_ngram_join, test_secret_scan
from voxelgrain.llm import quality_rules, secret_scan
from voxelgrain.llm.entry import piece_model_path


def masked(text):
    spans = sorted((a, b) for a, _, b in test_secret_scan.base_spans(text) + test_secret_scan.entropy_spans(text))
    merged = []
    for a, b in spans:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    for a, b in reversed(merged):
        text = text[:a] + secret_scan.MASK + text[b:]
    return text


def test_odd_rows(spark, tmp_path):
    rng = random.Random(4)
    body = lambda n: " ".join("".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 8))) for _ in range(n))
    texts = [body(80) for _ in range(130)]
    rows = [(k, x, "en", "s", len(x), "x") for k, x in enumerate(texts)]
    rows += [(None, texts[0], "en", "s", 1, "copy"), (None, body(90), None, None, None, "null id"), (3, body(70), "en", "s", 1, "id of another"), (5, texts[5], "en", "s", 1, "twice")]
    rows += [(900, body(60_000), "en", "s", 1, "long"), (901, None, "en", "s", None, "null"), (902, "", "en", "s", 0, "empty"), (903, " \n", "en", "s", 2, "blank")]
    names = "doc_id long, text string, lang string, source string, n_chars long, leak_row string"
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/in/documents.parquet")
    spark.createDataFrame([(1, "no leak here at all")], "item_id long, text string").write.parquet(f"{tmp_path}/in/benchmark.parquet")
    got = [r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_path}/in").collect()]
    assert sorted(got, key=repr) == sorted([*range(130), None, 3, 900], key=repr)
    spark.createDataFrame([], names).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_against_brute_force(spark, tmp_path):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 8)))
    base = [" ".join(word() for _ in range(rng.randint(55, 120))) for _ in range(40)]
    texts = base + [b + " extra" for b in base[:12]] + base[:6] + ["same words again " * 40, "too short", None, ""]
    texts += [base[13] + " " + test_decontamination.ITEMS[1][1], base[14] + " token = 'abcdef0123456789abcdef01' " + base[15]]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([x for x in test_decontamination.ITEMS if x[0]], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    good = {r.doc_id for r in quality_rules.verdicts(docs).where("kept").collect()}
    rows = [(i, t) for i, t in enumerate(texts) if i in good]
    rows = [(i, texts[i]) for i, _, c in test_ngram_join.brute(rows) if i == c]
    bad = {i for i, _ in test_decontamination.brute(rows, test_decontamination.ITEMS)}
    library = sentencepiece.SentencePieceProcessor(model_file=piece_model_path())
    want = {i: masked(t) for i, t in rows if i not in bad}
    assert set(got) == set(want) and len(want) > 30 and bad
    for i, t in want.items():
        ids = library.encode(t)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_idle_workers_remember_nothing(spark):
    df = spark.createDataFrame([(i, " ".join(f"unheard{i + k} word{i}" for k in range(9))) for i in range(200)], "doc_id long, text string").repartition(4)

    def held(batches):
        from voxelgrain.llm import ngram_join, sentencepiece_codec

        found = len(ngram_join._known) + len(sentencepiece_codec.model(path).known)
        yield from (pa.RecordBatch.from_arrays([pa.array([found])], ["n"]) for _ in batches)

    path = piece_model_path()
    for stage in (corpus_pipeline.near_duplicates, corpus_pipeline.tokens):
        assert stage(spark, df, "").count() > 0
        assert max(r.n for r in df.mapInArrow(held, "n long").collect()) == 0
