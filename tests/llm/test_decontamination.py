import random
import re
from collections import defaultdict

import regex

from voxelgrain.llm import decontamination as d


def canon(text):
    raw, out = regex.findall(d.TOKEN, text or ""), []
    for i, t in enumerate(raw):
        if "0" <= t < ":":
            out.append(("<number>", t.lower()))
        elif i and "0" <= raw[i - 1] < ":" and t.lower() in d.UNITS:
            out.append(("<unit>", t.lower()))
        elif t[0] != t.lower()[0]:
            out.append(("<name>", t.lower()))
        else:
            out.append((None, t.lower()))
    return out


def brute(docs, items):
    found = set()
    for key, text in items:
        it = canon(text)
        tpl = [k or v for k, v in it]
        js = [j for j in range(len(it) - 7) if sum(k is None for k, _ in it[j : j + 8]) >= 4]
        for doc, body in docs:
            dt = canon(body)
            dtpl, at = [k or v for k, v in dt], defaultdict(list)
            for j in js:
                for i in range(len(dt) - 7):
                    if dtpl[i : i + 8] == tpl[j : j + 8]:
                        at[i - j].append(j)
            good = set()
            for off, got in at.items():
                pairs = {(it[j + k][0], it[j + k][1], dt[j + off + k][1]) for j in got for k in range(8) if it[j + k][0]}
                if len({(a, b) for a, b, _ in pairs}) == len(pairs) == len({(a, c) for a, _, c in pairs}):
                    good |= set(got)
            if js and 2 * len(good) >= len(js):
                found.add((doc, key))
    return found


ITEMS = [
    (1, "If Alice has 3 apples and gives 2 apples to Bob how many apples does Alice keep for the 3 km walk home"),
    (2, "the quick brown fox jumps over the lazy dog while seven small cats are watching it from the old fence"),
    (3, "too short to match"), (4, None), (5, ""), (None, "an item without any id at all still has words enough to be found in a text"),
    (6, "the quick brown fox jumps over the lazy dog while seven small cats are watching it from the old fence"),
]


def documents():
    rng = random.Random(2)
    noise = lambda n: " ".join(rng.choice("lorem ipsum dolor sit amet Elit sed 12 do tempor".split()) for _ in range(n))
    a, b = ITEMS[0][1], ITEMS[1][1]
    yield from [None, "", noise(9), f"{noise(40)}\n{a}. {noise(30)}", f"{noise(5)} {b.upper()} {noise(5)}", f"{noise(5)} {b} {noise(5)}"]
    yield noise(20) + " " + a.replace("Alice", "Carol").replace("Bob", "Dan").replace("3", "7").replace("2", "5").replace("km", "miles")
    yield noise(20) + " " + a.replace("Alice", "Carol", 1).replace("3 km", "9 km")  # slots that contradict each other
    yield " ".join(b.split()[:11]) + " " + noise(30)
    yield " ".join(b.split()[:16]) + " " + noise(30) + ITEMS[5][1]
    yield (b + " ") * 300
    yield a.replace("apples", "pears")
    yield noise(20000) + " " + a


def test_against_brute_force(spark):
    rows = list(enumerate(documents())) + [(None, ITEMS[1][1]), (3, "other row, same key")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, leak_doc string")
    items = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id long, text string, window int")
    want = brute(rows, ITEMS)
    got = {(r.doc, r.item): r for r in d.leaks(docs, items).collect()}
    assert set(got) == want
    assert {(3, 1), (5, 2), (6, 1), (None, 2)} <= want and (7, 1) not in want and (8, 2) not in want
    assert got[3, 1].exact and not got[6, 1].exact
    kept = d.drop_leaks(docs, items)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - {i for i, _ in want}


def test_without_broadcast_and_empty(spark, monkeypatch):
    rows = list(enumerate(documents()))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    monkeypatch.setattr(d, "BROADCAST_BYTES", 0)
    assert {(r.doc, r.item) for r in d.leaks(docs, items).collect()} == brute(rows, ITEMS)
    assert d.leaks(docs.limit(0), items).count() == 0
    assert d.drop_leaks(docs, items.limit(0)).count() == len(rows)
    assert re.search("window", str(d.item_windows(items).columns))


def test_templates_token_by_token(spark):
    from pyspark.sql import functions as F

    texts = ["3km of 3 KM and 3 Km, 1.5 kg; 12:30 h km", "Iphone iPhone İstanbul Straße ÉCOLE école ΑΣ ǅ ǆ ́a A1 1A x9", "Größe THE the 7 Seven 7 seconds Seconds", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", d._tokens(F.col("text")).alias("raw"))
    df = d._with_templates(df, True)
    # What it stands for: the placeholder of a token, or the token in lower case as Spark has it.
    for column, folded in (("template", False), ("folded", True)):
        want = F.transform("raw", lambda t, i: F.xxhash64(F.coalesce(d._slot(F.col("raw"), t, i, folded), F.lower(t))))  # noqa: B023
        assert df.where(~F.col(column).eqNullSafe(want)).count() == 0
    kinds = {r.i: r.kinds for r in df.select("i", F.transform("raw", lambda t, i: d._slot(F.col("raw"), t, i)).alias("kinds")).collect()}
    assert all(kinds[i] == [k for k, _ in canon(t)] for i, t in enumerate(texts) if i != 1)
    # Tokens are looked at once for both templates: units, which are found by a list, are sought in one place.
    assert df.select("template", "folded")._jdf.queryExecution().optimizedPlan().toString().count("array_contains") == 1
