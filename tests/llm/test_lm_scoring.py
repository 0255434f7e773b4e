import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from voxelgrain.llm import lm_scoring as m


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda x: x[0].lower(), text or ""))


def brute(rows):
    split = [(i, words(t)) for i, t in rows]
    grams = lambda s: Counter(tuple(s[k : k + n]) for n in (1, 2, 3) for k in range(len(s) - n + 1))
    everywhere, total, out = Counter(), sum(len(s) for _, s in split), []
    for _, s in split:
        everywhere.update(grams(s))
    for i, s in split:
        own, value, back = grams(s), 0.0, 0
        count = lambda g, own=own: everywhere[g] - own[g]
        for k in range(len(s)):
            longest = min(k + 1, 3)
            n = next((n for n in range(longest, 1, -1) if count(tuple(s[k + 1 - n : k + 1])) > 0), 1)
            gram = tuple(s[k + 1 - n : k + 1])
            share = count(gram) / count(gram[:-1]) if n > 1 else max(count(gram), 1) / max(total - len(s), 1)
            value += math.log(0.4 ** (longest - n) * share)
            back += n < longest
        out.append((i, len(s), back, round(value / len(s), 5) if s else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("chars", [200, 8_000_000])
def test_against_brute_force(spark, monkeypatch, chars):
    monkeypatch.setattr(m, "BATCH_CHARS", chars)
    monkeypatch.setattr(m, "BUCKET_GRAMS", chars)
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["the", "of", "The", "é", "w%d" % rng.randrange(50)]) for _ in range(rng.randint(0, 60)))) for i in range(200)]
    rows += [(500, None), (None, "the of the"), (501, " \t\n"), (501, "the of"), (502, "one"), (503, "the of " * 20000)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, batch int").repartition(3)
    got = sorted(((r.doc_id, r.n_words, r.n_backoff, None if r.score is None else round(r.score, 5)) for r in m.score(df).collect()), key=repr)
    want = brute(rows)
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert all(a[3] is b[3] is None or abs(a[3] - b[3]) < 2e-5 for a, b in zip(got, want, strict=True))
    assert m.score(df.limit(0)).count() == 0


def test_few_bytes_go_to_a_worker_at_once(spark):
    df = spark.range(40, numPartitions=1).selectExpr("cast(repeat('x', 1000000) as binary) AS data")
    with m._few_rows(spark):
        sizes = [r.n for r in df.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches), "n long").collect()]
    assert sum(sizes) > 40_000_000 and max(sizes) < 8_000_000


def test_executors_hold_few_packed_rows(spark, monkeypatch):
    monkeypatch.setattr(m, "BATCH_CHARS", 100)
    monkeypatch.setitem(m.PAGES, "parquet.page.size", "64")
    df = spark.createDataFrame([(i, " ".join(f"word{i + k}" for k in range(20))) for i in range(60)], "doc_id long, text string").coalesce(1)
    pages, plans, write = [], [], m.written

    def noted(table, name, *options):
        plans.append((name, table._jdf.queryExecution().executedPlan().toString(), spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")))
        out = write(table, name, *options)
        if name == "lm-texts":
            jvm, conf, rows = spark._jvm, spark._jsc.hadoopConfiguration(), out.count()
            at = jvm.org.apache.hadoop.fs.Path(out.inputFiles()[0])
            reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(conf, at)
            columns = reader.getFooter().getBlocks().get(0).getColumns()
            pages.extend((rows, reader.readOffsetIndex(c).getPageCount()) for c in columns if c.getPath().toDotString() in ("ids", "vocabulary"))
            reader.close()
        return out

    monkeypatch.setattr(m, "written", noted)
    assert m.score(df).count() == 60
    # A page ends with the row that fills it, the reader takes as few as go to a worker, and buckets are not sorted.
    assert len(pages) == 2 and all(rows > 20 and n >= rows / 2 for rows, n in pages)
    assert all(int(size) == m.ARROW_ROWS for name, _, size in plans if name != "lm-texts")
    assert not any("Sort" in plan for name, plan, _ in plans if "totals" in name) and sum("totals" in name for name, _, _ in plans) == 3


def test_a_file_holds_several_buckets(spark, monkeypatch):
    monkeypatch.setattr(m, "BUCKET_GRAMS", 25)
    files, write = {}, m.written

    def noted(table, name, *options):
        out = write(table, name, *options)
        files[name] = len(out.inputFiles())
        return out

    monkeypatch.setattr(m, "written", noted)
    rows = [(i, f"the of word{i % 7} the word{i % 5} " * 5) for i in range(50)]
    got = m.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_words, r.n_backoff) for r in got) == [x[:3] for x in sorted(brute(rows))]
    # 1250 words make 50 buckets, which had a file each that had rows.
    assert all(n <= 50 // m.TASK_BUCKETS for name, n in files.items() if "totals" in name) and len(files) == 5


def test_idle_workers_remember_nothing(spark):
    df = spark.createDataFrame([(i, f"unheard{i} word{i}") for i in range(200)], "doc_id long, text string").repartition(4)
    assert m.score(df).count() == 200

    def held(batches):
        from voxelgrain.llm import lm_scoring

        yield from (pa.RecordBatch.from_arrays([pa.array([len(lm_scoring._known)])], ["n"]) for _ in batches)

    assert max(r.n for r in df.mapInArrow(held, "n long").collect()) == 0
