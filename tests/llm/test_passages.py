from tests.llm.test_decontamination import ITEMS
from voxelgrain.llm import decontamination as d

A, B = ITEMS[0][1], ITEMS[1][1]
LONG = " ".join(f"{x}{y}" for x in "bdfgklmnpr" for y in ("a", "e", "io", "u"))
NOISE = "lorem ipsum dolor sit amet elit sed do tempor magna aliqua ut enim"


def test_partial_recased_and_edited(spark):
    part = " ".join(LONG.split()[:22])
    edited = " ".join("changed" if k % 10 == 9 else w for k, w in enumerate(LONG.split()))
    capitals = " ".join(w.title() for w in part.split())
    contradicting = A.replace("Alice", "Carol", 1).replace("3 km", "9 km")
    found = {0: part, 1: capitals, 2: edited, 3: contradicting, 4: B.upper(), 5: A.lower(), 6: " ".join(B.split()[:11])}
    clean = {20: NOISE, 21: " ".join(LONG.split()[:9]), 22: " ".join(B.split()[:7]), 23: " ".join(reversed(LONG.split())), 24: None}
    rows = [(i, f"{NOISE} {t} {NOISE}" if t else t) for i, t in {**found, **clean}.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, A), (2, B), (3, LONG)], "item_id long, text string")
    got = {(r.doc, r.item) for r in d.leaks(docs, items, passages=True).collect()}
    assert got == {(0, 3), (1, 3), (2, 3), (3, 1), (4, 2), (5, 1), (6, 2)}
    assert {r.doc_id for r in d.drop_leaks(docs, items, passages=True).collect()} == set(clean)
