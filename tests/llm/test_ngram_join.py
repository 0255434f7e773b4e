import random
import re

import numpy as np
import pytest

from voxelgrain.llm import ngram_join as j


def shingles(text, n=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + n]) for k in range(max(len(w) - n + 1, 1))} if w else set()


def brute(rows, percent=90):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    keys = {}
    for k, (i, _) in enumerate(rows):
        keys.setdefault(root(k), []).append(i)
    low = {r: min((i for i in v if i is not None), default=None) for r, v in keys.items()}
    return sorted(((i, len(sets[k]), low[root(k)]) for k, (i, _) in enumerate(rows)), key=repr)


def corpus(seed, families=12, size=14):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    passage = [word() for _ in range(30)]
    rows = []
    for _ in range(families):
        base = [word() for _ in range(rng.choice((5, 20, 60, 150, 400)))]
        for _ in range(size):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                at = rng.randrange(len(text))
                text[at : at + rng.randint(0, 1)] = [word()]
            if rng.random() < 0.2:
                text += passage
            rows.append(" ".join(text))
    for _ in range(80):
        rows.append(" ".join([*passage, *(word() for _ in range(rng.randint(0, 6)))]))
    rows += ["", None, " \n", "one", "ONE", "one two", "Ärger ärger Ärger", "ärger ärger ärger", "a b c", "a b c d"]
    rows += rng.choices(rows, k=30)
    rng.shuffle(rows)
    return list(enumerate(rows, 100))


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed) + [(None, "one"), (None, "lonely text of a null key"), (5, None), (6, "x " * 30000), (7, "x " * 30001)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, label string")
    got = sorted(((r.id, r.n, r.component) for r in j.classes(df).collect()), key=repr)
    assert got == brute(rows)


def test_small_blocks_and_frequent(spark, monkeypatch):
    monkeypatch.setattr(j, "CELL_BYTES", 20_000)
    monkeypatch.setattr(j, "FREQUENT", 5)
    rows = corpus(3, 5, 40)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.id, r.n, r.component) for r in j.classes(df).collect()) == brute(rows)


def test_keep_one(spark):
    rows = corpus(4, 6, 8)
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, gone_id int")
    kept = j.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _, c in brute(rows) if i == c)
    assert j.keep_one(df.limit(0)).count() == 0


def test_trie_finds_every_component():
    rng = random.Random(8)
    for _ in range(200):
        pool = [sorted(rng.sample(range(60), rng.randint(5, 40))) for _ in range(3)]
        sets = []
        for _ in range(rng.randint(2, 25)):
            s = set(rng.choice(pool))
            for _ in range(rng.randint(0, 3)):
                s ^= {rng.randrange(60)}
            sets.append(np.array(sorted(s or {1})))
        known = np.array([rng.randrange(8) for _ in sets]) if rng.random() < 0.5 else np.arange(len(sets))
        want, got = known.tolist(), known.tolist()

        def join(p, a, b):
            old, new = p[a], p[b]
            for k, v in enumerate(p):
                if v == old:
                    p[k] = new

        for a in range(len(sets)):
            for b in range(a):
                if 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b])):
                    join(want, a, b)
        for a, b in j.trie_links(sets, 80, known):
            join(got, a, b)
        groups = lambda p: {frozenset(k for k in range(len(p)) if p[k] == r) for r in p}
        assert groups(got) == groups(want)


def test_sketches_rule_out_no_link():
    rng = random.Random(4)
    for _ in range(150):
        pool = [[rng.getrandbits(62) for _ in range(rng.choice((3, 40, 70, 130, 500)))] for _ in range(3)]
        sets = []
        for _ in range(rng.choice((2, 5, 9, 30))):
            s = set(rng.choice(pool))
            for _ in range(rng.randint(0, len(s) // 6 + 1)):
                s ^= {rng.choice(list(s)), rng.getrandbits(62)}
            sets.append(np.array(sorted(s or {1})))
        percent = rng.choice((50, 80, 90))
        rows = [(k, rng.choice((k, 0)), len(x), j.sketch(x)) for k, x in enumerate(sets)]
        root = {k: r[1] for k, r in enumerate(rows)}
        for a, b in j._sketch_cell(rows, percent):
            old = root[a]
            root = {k: root[b] if v == old else v for k, v in root.items()}
        for a in range(len(sets)):
            for b in range(a):
                if 100 * len(np.intersect1d(sets[a], sets[b])) >= percent * len(np.union1d(sets[a], sets[b])):
                    assert root[a] == root[b]
