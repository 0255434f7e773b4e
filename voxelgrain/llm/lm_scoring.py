"""Stupid-backoff scores of every text, from the n-gram counts of all other texts.

The order is ``ORDER`` (three). A word scores ``c(n-gram) / c(context)`` by the longest n-gram that ends with it and
that other texts have, times ``BACKOFF`` for each order that had to be left out; a word alone scores ``c(word) / N``,
and one that no other text has counts as if it occurred once. A text's first words have shorter n-grams to begin
with, for which nothing is taken off. A text's own n-grams are taken off all counts, and its words off N: else every
n-gram would be found, as the text itself holds it. Counts of one are counts. A text's score is the mean logarithm.

The relations are packed, so that hundreds of millions of exploded n-grams needn't be as many rows. A batch of texts
is a row: its words as local numbers, text by text. For each order, the batch's distinct n-grams with their counts
go to the count table, which is partitioned by the n-grams' hash: counts are combined beforehand, summed in the
table's buckets, and every batch gets the totals of its own n-grams back, in its own order. Then the batch joins them
to its exploded n-grams and sums by text. A frequent n-gram is one entry for each batch, never one for each text, so
no bucket is hot; buckets grow in number with the words. Orders follow one another, and what an order shuffled is
deleted before the next. Between batches and buckets there are as many rows as a shuffle between so many tasks has
blocks; at very large sizes, larger batches keep them long. Nothing is sampled or cut off.

Null, empty and blank texts have no words and a null score. Very long texts are batches of their own. Repeated rows
count as often as they occur, each as a text of its own, ids being carried along only: null and equal ones are
nothing special. An empty table gives an empty result. n-grams are told apart by 64-bit hashes. Other columns aren't
read, whatever their names.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelgrain.llm.common import SPACE_RUN, discard, lean, written

ORDER, BACKOFF = 3, 0.4
#: Characters of text in a batch, words a worker remembers, and n-grams of a bucket.
BATCH_CHARS, REMEMBERED, BUCKET_GRAMS = 4_000_000, 200_000, 4_000_000
#: Rows that are read and go to a Python worker at once: each holds up to some MB, in the executor's memory and in the worker's.
ARROW_ROWS = 4
#: Buckets of a task that writes a table, one after the other: a file for each would be many small ones.
TASK_BUCKETS = 4
#: A page of texts ends with the row that fills it. Else a hundred rows or a file's are one, held several times over by who writes and reads it.
PAGES = {"parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1", "parquet.enable.dictionary": "false"}
_TEXTS = pa.schema([("batch", pa.int64()), ("words", pa.int64()), ("ids", pa.binary()), ("sizes", pa.binary()), ("vocabulary", pa.binary()), ("local", pa.binary())])
_COUNTS = pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), ("grams", pa.binary()), ("counts", pa.binary())])
_BACK = pa.schema([("batch", pa.int64()), ("bucket", pa.int32()), ("totals", pa.binary())])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "bigint", pa.int32(): "int", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _rows(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """A few rows at a time, as each holds up to some hundred KB."""
    for at in range(0, len(rows), 64):
        columns = zip(*rows[at : at + 64], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


class _Hashes(dict):
    """Hashes of words, each computed when it is first asked for."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


_known = _Hashes()


def _forget() -> None:
    _known.clear()


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))


def _planes(values: np.ndarray) -> bytes:
    """The bytes of whole numbers, most of them small, by significance: what a shuffle's compression does well on."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def _from_planes(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def _narrow(values: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as the largest needs, and that number of bytes first."""
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if values.max(initial=0) <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + _planes(values.astype(kind))


def _from_narrow(data: bytes) -> np.ndarray:
    return _from_planes(data[1:], {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}[data[0]])


def _steps(keys: np.ndarray) -> bytes:
    """Ascending keys as their differences."""
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def _from_steps(data: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(data, np.uint64), dtype=np.uint64)


def _packed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row for each batch of texts."""

    def row(batch: int, ids: pa.Array, texts: list[str | None]) -> tuple:
        split = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
        sizes = np.array([len(s) for s in split], np.uint32)
        flat = np.concatenate([_hashes(s) for s in split]) if len(split) else np.zeros(0, np.uint64)
        vocabulary, local = np.unique(flat, return_inverse=True)
        named = pa.ipc.new_stream(sink := pa.BufferOutputStream(), pa.schema([("id", ids.type)]))
        named.write_batch(pa.RecordBatch.from_arrays([ids], ["id"]))
        named.close()
        return batch, len(flat), sink.getvalue().to_pybytes(), sizes.tobytes(), _steps(vocabulary), _narrow(local)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for arrived in batches:
            texts, at = arrived.column(1).to_pylist(), 0
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and (end == at or chars + len(texts[end] or "") <= BATCH_CHARS):
                    chars += len(texts[end] or "")
                    end += 1
                yield from _rows([row(number, arrived.column(0).slice(at, end - at), texts[at:end])], _TEXTS)
                number, at = number + 1, end

    return docs.select(key, text).mapInArrow(lean(run, _forget), _ddl(_TEXTS))


class _Batch:
    """A batch's words by place, and the n-grams that end there."""

    def __init__(self, sizes: bytes, vocabulary: bytes, local: bytes):
        self.sizes = np.frombuffer(sizes, np.uint32).astype(np.int64)
        self.word = _from_steps(vocabulary)[_from_narrow(local)]
        self.text = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        # How many words of its text stand before a place.
        self.before = np.arange(len(self.word)) - (np.cumsum(self.sizes) - self.sizes)[self.text]

    def grams(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """By order from one: the places that have so many words, and the n-grams' hashes."""
        places, hashes = np.arange(len(self.word)), self.word
        for order in range(1, ORDER + 1):
            yield places, hashes
            # An n-gram is the one that ends a place before it, and its last word.
            ends = np.flatnonzero(self.before >= order)
            shorter = np.zeros(len(self.word), np.uint64)
            shorter[places] = hashes
            places, hashes = ends, _joined(shorter[ends - 1], self.word[ends])


def _joined(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    x = first * np.uint64(0x9E3779B97F4A7C15) + second
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """An equal part of the hashes each, so that a batch's ascending keys come back in their order."""
    return (((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _totals(texts: DataFrame, order: int, buckets: int) -> DataFrame:
    """For every batch, the totals of its distinct n-grams of this order, by bucket."""

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for arrived in batches:
            for batch, sizes, vocabulary, local in zip(*(c.to_pylist() for c in arrived.columns), strict=True):
                _, hashes = next(islice(_Batch(sizes, vocabulary, local).grams(), order - 1, None))
                grams, counts = np.unique(hashes, return_counts=True)
                cuts = np.searchsorted(_bucket(grams, buckets), np.arange(buckets + 1))
                yield from _rows([(b, batch, _steps(grams[x:y]), _narrow(counts[x:y])) for b, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if x < y], _COUNTS)

    def summed(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        grams = [_from_steps(r[2]) for r in held]
        _, place = np.unique(np.concatenate(grams), return_inverse=True)
        totals = np.bincount(place, np.concatenate([_from_narrow(r[3]) for r in held])).astype(np.uint64)[place]
        ends = np.cumsum([len(g) for g in grams])
        yield from _rows([(r[1], r[0], _narrow(totals[e - len(g) : e])) for r, g, e in zip(held, grams, ends.tolist(), strict=True)], _BACK)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A partition is a bucket, so there is nothing to sort, for which the executor would hold all its rows.
        held: dict[int, list[tuple]] = {}
        for arrived in batches:
            for r in zip(*(c.to_pylist() for c in arrived.columns), strict=True):
                held.setdefault(r[0], []).append(r)
        while held:
            yield from summed(held.popitem()[1])

    counts = texts.select("batch", "sizes", "vocabulary", "local").mapInArrow(lean(deal, _forget), _ddl(_COUNTS))
    return counts.repartitionById(buckets, F.col("bucket")).mapInArrow(lean(run, _forget), _ddl(_BACK))


def _scored(texts: DataFrame, totals: list[DataFrame], key: str, kind: str) -> DataFrame:
    """``key``, ``n_words``, ``n_backoff``, ``n_unigram`` and ``part``: the sum of logarithms but for ``log N`` of each word that is scored alone."""

    def score(held: list[tuple]) -> pa.RecordBatch:
        (row,) = [r for r in held if r[1] == 0]
        ids = pa.ipc.open_stream(row[3]).read_all().column(0).combine_chunks()
        batch = _Batch(*row[4:7])
        n, used, value = len(batch.word), np.zeros(len(batch.word), np.int8), np.zeros(len(batch.word))
        shorter = np.zeros(n)
        for order, (places, hashes) in enumerate(batch.grams(), 1):
            _, index = np.unique(hashes, return_inverse=True)
            got = {r[2]: _from_narrow(r[3]) for r in held if r[1] == order}
            total = np.concatenate([got[b] for b in sorted(got)]) if got else np.zeros(0, np.uint8)
            # What other texts have of it: all, but for the text's own.
            own = batch.text[places].astype(np.int64) * (len(total) + 1) + index
            _, of, times = np.unique(own, return_inverse=True, return_counts=True)
            others = np.zeros(n)
            others[places] = total[index].astype(float) - times[of] if n else 0
            if order == 1:
                used[:], value = 1, np.log(np.maximum(others, 1))
            else:
                found = np.flatnonzero(others > 0)
                used[found], value[found] = order, np.log(others[found]) - np.log(shorter[found - 1])
            shorter = others
        left_out = np.minimum(batch.before + 1, ORDER) - used
        value += left_out * np.log(BACKOFF)
        by_text = lambda w: np.bincount(batch.text, w, len(batch.sizes)) if n else np.zeros(len(batch.sizes))
        columns = [ids, pa.array(batch.sizes), pa.array(by_text(left_out > 0).astype(np.int64)), pa.array(by_text(used == 1).astype(np.int64)), pa.array(by_text(value))]
        return pa.RecordBatch.from_arrays(columns, [key, "n_words", "n_backoff", "n_unigram", "part"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for arrived in batches:
            for r in zip(*(c.to_pylist() for c in arrived.columns), strict=True):
                if held and r[0] != held[0][0]:
                    yield score(held)
                    held = []
                held.append(r)
        if held:
            yield score(held)

    none = lambda name: F.lit(None).cast("binary").alias(name)
    rows = texts.select("batch", F.lit(0).alias("order"), F.lit(0).alias("bucket"), F.col("ids").alias("data"), "sizes", "vocabulary", "local")
    for order, back in enumerate(totals, 1):
        rows = rows.unionByName(back.select("batch", F.lit(order).alias("order"), "bucket", F.col("totals").alias("data"), none("sizes"), none("vocabulary"), none("local")))
    return rows.repartition("batch").sortWithinPartitions("batch").mapInArrow(lean(run, _forget), f"`{key}` {kind}, n_words bigint, n_backoff bigint, n_unigram bigint, part double")


def score(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_words``, ``n_backoff`` (words whose longest n-gram no other text has) and ``score`` of every row."""
    spark = docs.sparkSession
    texts = written(_packed(docs, key, text), "lm-texts", PAGES)
    with _few_rows(spark):
        return _score(texts, key, docs.schema[key].dataType.simpleString())


@contextlib.contextmanager
def _few_rows(spark: SparkSession) -> Iterator[None]:
    before = {name: spark.conf.get(name) for name in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")}
    for name in before:
        spark.conf.set(name, ARROW_ROWS)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def _score(texts: DataFrame, key: str, kind: str) -> DataFrame:
    spark = texts.sparkSession
    total = texts.agg(F.sum("words")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_GRAMS))
    tasks = max(spark.sparkContext.defaultParallelism, buckets // TASK_BUCKETS)
    totals = [written(_totals(texts, order, buckets).coalesce(tasks), f"lm-totals-{order}") for order in range(1, ORDER + 1)]
    parts = written(_scored(texts, totals, key, kind).coalesce(tasks), "lm")
    discard(texts, *totals)
    others = F.greatest(F.lit(total) - F.col("n_words"), F.lit(1)).cast("double")
    mean = (F.col("part") - F.col("n_unigram") * F.log(others)) / F.col("n_words")
    return parts.select(key, "n_words", "n_backoff", F.when(F.col("n_words") > 0, F.round(mean, 6)).alias("score"))


def sql() -> str:
    """DuckDB SQL for ``score`` of ``documents``."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    others = lambda gram: f"count(*) OVER (PARTITION BY {gram}) - count(*) OVER (PARTITION BY rid, {gram})"
    return f"""WITH t AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '{SPACE_RUN}'), lambda x: x <> '') AS w FROM documents),
e AS (SELECT rid, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM t),
p AS (SELECT *, lag(word) OVER o AS w1, lag(word, 2) OVER o AS w2 FROM e WINDOW o AS (PARTITION BY rid ORDER BY i)),
c AS (SELECT rid, n, i, {others("word")} AS c1, CASE WHEN i > 1 THEN {others("w1, word")} END AS c2, CASE WHEN i > 2 THEN {others("w2, w1, word")} END AS c3 FROM p),
d AS (SELECT *, lag(c1) OVER o AS d1, lag(c2) OVER o AS d2 FROM c WINDOW o AS (PARTITION BY rid ORDER BY i)),
total AS (SELECT count(*) AS n FROM e),
s AS (SELECT rid, CASE WHEN c3 > 0 THEN 0 WHEN c2 > 0 THEN least(i, 3) - 2 ELSE least(i, 3) - 1 END AS back,
  CASE WHEN c3 > 0 THEN ln(c3) - ln(d2) WHEN c2 > 0 THEN ln(c2) - ln(d1) ELSE ln(greatest(c1, 1)) - ln(greatest(total.n - d.n, 1)) END AS v FROM d, total),
g AS (SELECT rid, count(*) FILTER (back > 0) AS n_backoff, avg(v + back * ln({BACKOFF})) AS score FROM s GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_backoff, 0)::BIGINT AS n_backoff, round(score, 6) AS score FROM t LEFT JOIN g ON t.rid = g.rid"""
