import duckdb
import pytest

from voxelgrain.llm import quality_rules as q

SCHEMA = "doc_id long, text string, lang string, source string, quality_measured string"


@pytest.fixture(scope="module")
def rows():
    plain = lambda n, k: " ".join(f"Word{(i * 7 + k) % 997}x" if i % 9 else f"it.\nNo{i}" for i in range(n))
    out = [(i, plain(60 + i % 50, i), "en", "a" if i % 3 else "b", "c") for i in range(400)]
    out += [(1000 + i, " ".join(f"w{j}{i}%%%" for j in range(80)), "en", "a", "c") for i in range(4)]
    out += [(2000, None, None, None, None), (2001, "", "en", "a", None), (None, "one", None, "a", None), (2002, "same words again " * 40, "en", "a", None), (2002, "same words again " * 40, "en", "a", None)]
    out += [(2003, "LOUD WORDS%d " % 3 + " ".join(f"SHOUT{chr(65 + i % 26)}{chr(65 + i // 26)}" for i in range(90)), "en", "a", None), (2004, " \t\x0b\n ", "xx", None, None)]
    out += [(2005, "\n".join(f"line {i % 5} of a text with more words in it {i % 5}" for i in range(40)), "de", "z", None), (2006, " ".join(str(i) for i in range(60000)), "en", "b", None)]
    return out


def test_against_sql(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, q.verdicts(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()), key=repr)
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    con.execute("CREATE TABLE d AS SELECT doc_id::BIGINT doc_id, text, lang, source FROM documents")
    want = sorted(con.execute(q.sql("d")).fetchall(), key=repr)
    assert [tuple(map(str, x)) for x in got] == [tuple(map(str, x)) for x in want]
    verdict = {r[0]: r[-1] for r in got}
    assert all(verdict[i] for i in range(0, 400, 7)) and not any(verdict[i] for i in (1000, 1001, 2001, 2002, 2003))


def test_filter(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    kept = q.keep_good(df)
    assert kept.columns == df.columns
    want = sorted((r.doc_id for r in q.verdicts(df).where("kept").collect()), key=repr)
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == want
    assert q.keep_good(df.limit(0)).count() == 0 and q.verdicts(df.limit(0)).count() == 0
