import random
import zlib

import numpy as np
import pytest

from voxelgrain.llm import toxicity as t

BAD = ["fool", "rotten", "vequeur", "vequez", "vequais"]


def rows(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 5))) for _ in range(rng.randint(5, 80))]
        toxic = rng.random() < 0.25
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        out.append((i, " ".join(words), rng.choice(["en", "fr", None]), int(toxic)))
    return out


@pytest.fixture(scope="module")
def scored(spark):
    data = rows(1600)
    odd = [(9001, None, None), (9002, "", "en"), (9003, "?! ...", "xx"), (None, "fool rotten", "en"), (9004, "word " * 500_000 + "fool rotten vequeur", "en"), (5, "clean words", "en")]
    docs = spark.createDataFrame([(i, x, lang, "s") for i, x, lang, _ in data] + [(*o, "s") for o in odd], "doc_id long, text string, lang string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, _, y in data] + [(777777, 1), (3, None), (None, 1), (4, data[4][3])], "doc_id long, toxic int")
    return data, docs, labels, t.score(docs, labels).collect()


def test_held_out_accuracy(scored):
    data, _, _, got = scored
    truth = {i: y for i, _, _, y in data}
    assert len(got) == len(data) + 6
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.93
    assert np.mean([r.flagged == truth[r.doc_id] for r in held]) > 0.93
    by = {r.doc_id: r for r in got if r.doc_id is None or r.doc_id > 9000}
    assert by[9001].score == by[9002].score == by[9003].score < 0.3
    assert by[9004].predicted == 1 and by[None].predicted == 1


def test_scores_know_nothing_but_the_text(spark, scored):
    _, docs, labels, got = scored
    from pyspark.sql import functions as F

    model = t.fit(*zip(*[(r["text"], r["toxic"], r["lang"]) for r in t.training_rows(docs, labels)], strict=True))
    texts = [r.text for r in docs.limit(50).collect()]
    a = model.score([t.word_ids(x) for x in texts])
    b = np.concatenate([model.score([t.word_ids(x)]) for x in texts])
    assert np.allclose(a, b, atol=1e-6)
    assert not {r["of"] for r in t.training_rows(docs, labels)} & {r.doc_id for r in got if r.held_out}
    assert t.score(docs.limit(0), labels).count() == 0
    assert {r.score for r in t.score(docs.limit(4), labels.where(F.col("toxic") == 9)).collect()} == {0.5}


def test_whole_score_by_plain_loops(scored, spark):
    """The score of every text from nested loops over words, filters and places, against the vectorised one."""
    data, docs, labels, got = scored
    model = t.fit(*zip(*[(r["text"], r["toxic"], r["lang"]) for r in t.training_rows(docs, labels)], strict=True))
    by = {r.doc_id: r.score for r in got}
    for i, text, _, _ in data[10:60]:
        e = [sum(model.weights["embed"][k] for k in row) for row in t.word_ids(text)]
        features = []
        for w in t.WIDTHS:
            for f in range(t.FILTERS):
                best = max((sum(float(e[p + s] @ model.weights[f"filter{w}"][s * t.WIDTH : (s + 1) * t.WIDTH, f]) for s in range(w)) for p in range(len(e) - w + 1)), default=0.0)
                features.append(max(best, 0.0))
        raw = float(np.array(features) @ model.weights["out"].reshape(-1) + model.weights["bias"][0])
        assert abs(1 / (1 + np.exp(-(model.scale * raw + model.shift))) - by[i]) < 1e-4


def test_gradient_matches_differences():
    rng = np.random.default_rng(0)
    model = t.Classifier.new()
    texts = [rng.integers(1, 50, (n, 1 + len(t.STEMS))).astype(np.int32) for n in (4, 1, 7, 0, 2)]
    sizes = np.array([len(x) for x in texts])
    pooled, _ = model.pooled(np.concatenate(texts), sizes)
    for k, x in enumerate(texts):
        e = model.weights["embed"][x].sum(axis=1)
        for j, w in enumerate(t.WIDTHS):
            want = np.zeros(t.FILTERS)
            if len(e) >= w:
                r = np.array([sum(e[i + s] @ model.weights[f"filter{w}"][s * t.WIDTH : (s + 1) * t.WIDTH] for s in range(w)) for i in range(len(e) - w + 1)])
                want = np.maximum(r.max(axis=0), 0)
            assert np.allclose(pooled[k, j * t.FILTERS : (j + 1) * t.FILTERS], want, atol=1e-5)
