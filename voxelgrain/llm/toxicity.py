"""Toxicity by a small convolutional text classifier, trained in numpy.

A word (a run of letters and digits, in lower case) is embedded as the sum of hashed embeddings of itself and of
its beginnings, so that inflected forms share what their stem has learnt. Filters of several
widths slide over the embeddings; each filter's largest response over the whole text goes through a rectifier into
a logistic output, which is the score. Training is mini-batch Adam on the cross entropy, from a fixed seed, on a
bounded sample of the labelled rows: those with the ``MAX_TRAINING`` smallest hashes of their id, and of these whole
texts. Every text is scored whole, in a stream, whatever its length.

A share of the sample is kept out of training to calibrate: scores are shifted and scaled (Platt), and per language
a threshold is found that gives the best F1, shrunk to the overall one where a language has few labels. The
language only selects the threshold of ``flagged``; it is no input of the score, and neither are source or id.

Null, empty and wordless texts have the score that the bias alone gives; an empty table gives an empty result. Rows map
to rows, also repeated ones. Of rows and labels that share an id the smallest text and the larger label teach; labels
whose document doesn't exist, null labels and null ids teach nothing, nor do texts beyond ``MAX_TRAINING_CHARS``, so that
the sample is bounded in bytes too. With no labels of both kinds the score is the share of toxic ones. A score at a
threshold reaches it. Other columns aren't read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bound of the sample that a classifier is fitted on, in rows, and of the words of one training batch.
MAX_TRAINING, MAX_TRAINING_CHARS, BATCH_WORDS = 4000, 50_000, 30_000
BUCKETS, WIDTH, FILTERS, WIDTHS = 1 << 17, 8, 8, (1, 2, 3)
#: Lengths of the beginnings that are embedded beside the word.
STEMS = (3, 4, 5)
EPOCHS, EXAMPLES, RATE, DECAY, SEED = 6, 30_000, 0.02, 1e-3, 7
#: Training texts that a bucket must occur in to have an embedding; others are zero, so that unseen words say nothing.
LEAST_TEXTS = 5
CALIBRATION_PERCENT, LEAST_BY_LANG = 20, 30
#: Words that are convolved at once, and words a worker remembers.
BLOCK_WORDS, REMEMBERED = 400_000, 500_000
_WORD = re.compile(r"\w+")
_known: dict[str, bytes] = {}


def _buckets(word: str) -> bytes:
    """The word's bucket and those of its beginnings; bucket 0, which stays zero, where the word is too short."""
    parts = [f"={word}", *(f"{word[:k]}-" if len(word) > k else "" for k in STEMS)]
    return np.array([1 + xxhash.xxh3_64_intdigest(p.encode("utf-8", "surrogatepass")) % (BUCKETS - 1) if p else 0 for p in parts], np.int32).tobytes()


def word_ids(text: str | None) -> np.ndarray:
    """Buckets by word: a row for each word."""
    words = _WORD.findall((text or "").lower())
    if len(_known) > REMEMBERED:
        _known.clear()
    for w in set(words).difference(_known):
        _known[w] = _buckets(w)
    return np.frombuffer(b"".join(map(_known.__getitem__, words)), np.int32).reshape(len(words), 1 + len(STEMS))


@dataclass
class Classifier:
    """Weights by name, the calibration of the scores, and the thresholds by language."""

    weights: dict[str, np.ndarray]
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5
    by_lang: dict[str | None, float] = field(default_factory=dict)

    @classmethod
    def new(cls) -> Classifier:
        rng = np.random.default_rng(SEED)
        w = {"embed": rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32), "out": rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32), "bias": np.zeros(1, np.float32)}
        for k in WIDTHS:
            w[f"filter{k}"] = rng.normal(0, 0.4, (k * WIDTH, FILTERS)).astype(np.float32)
        return cls(w)

    def pooled(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        """Largest responses (rectified) by text and filter, and where each is. Texts come one after the other."""
        n, w = len(sizes), self.weights
        out, where = np.zeros((n, FILTERS * len(WIDTHS)), np.float32), {}
        ends = np.cumsum(sizes)
        x = w["embed"][ids].sum(axis=1)
        for j, k in enumerate(WIDTHS):
            there = np.flatnonzero(sizes >= k)
            if not len(there):
                continue
            m = len(ids) - k + 1
            response = sum(x[i : m + i] @ w[f"filter{k}"][i * WIDTH : (i + 1) * WIDTH] for i in range(k))
            # Windows that begin in one text and end in the next take no part.
            begin, stop = (ends - sizes)[there], ends[there] - k + 1
            over = np.zeros(m + 1, np.int32)
            np.add.at(over, begin, 1)
            np.add.at(over, stop, -1)
            response[np.cumsum(over[:-1]) == 0] = -np.inf
            best = np.maximum.reduceat(response, begin, axis=0)
            out[there[:, None], np.arange(j * FILTERS, (j + 1) * FILTERS)] = np.maximum(best, 0)
            where[k] = (there, begin, best, response)
        return out, where

    def raw(self, texts: list[np.ndarray]) -> np.ndarray:
        """The logit of each text, a block of words at a time; texts above a block are pooled piece by piece with overlaps."""
        out = np.zeros(len(texts))
        held, size = [], 0

        def flush() -> None:
            if held:
                sizes = np.array([len(texts[i]) for i in held])
                ids = np.concatenate([texts[i] for i in held])
                out[held] = self.pooled(ids, sizes)[0] @ self.weights["out"] + self.weights["bias"][0]

        for i, t in enumerate(texts):
            if len(t) > BLOCK_WORDS:
                step, lap = BLOCK_WORDS, max(WIDTHS) - 1
                pieces = [t[a : a + step + lap] for a in range(0, len(t), step)]
                top = np.maximum.reduce([self.pooled(p, np.array([len(p)]))[0][0] for p in pieces])
                out[i] = top @ self.weights["out"] + self.weights["bias"][0]
                continue
            if size + len(t) > BLOCK_WORDS:
                flush()
                held, size = [], 0
            held.append(i)
            size += len(t)
        flush()
        return out

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.raw(texts) + self.shift, -30, 30)))


def _train(model: Classifier, texts: list[np.ndarray], labels: np.ndarray) -> None:
    """Mini-batch Adam on the cross entropy; embeddings are updated by the rows that a batch touches."""
    rng, w = np.random.default_rng(SEED), model.weights
    known = np.bincount(np.concatenate([np.unique(x) for x in texts]), minlength=BUCKETS) >= LEAST_TEXTS
    known[0] = False
    w["embed"][~known] = 0
    first = {k: np.zeros_like(v) for k, v in w.items()}
    second = {k: np.zeros_like(v) for k, v in w.items()}
    sizes_of, t = np.array([len(x) for x in texts]), 0
    batch = max(8, min(64, len(texts) // 40))
    # Small samples are gone through more often.
    for _ in range(min(40, max(EPOCHS, EXAMPLES // len(texts)))):
        order = rng.permutation(len(texts))
        cuts, words = [0], 0
        for at, k in enumerate(order):
            if at - cuts[-1] >= batch or (words and words + sizes_of[k] > BATCH_WORDS):
                cuts.append(at)
                words = 0
            words += sizes_of[k]
        for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
            part = order[a:b]
            sizes = sizes_of[part]
            ids = np.concatenate([texts[k] for k in part])
            pooled, where = model.pooled(ids, sizes)
            error = (1 / (1 + np.exp(-np.clip(pooled @ w["out"] + w["bias"][0], -30, 30))) - labels[part]).astype(np.float32) / len(part)
            grads = {"out": pooled.T @ error, "bias": np.array([error.sum()], np.float32)}
            back = np.outer(error, w["out"]) * (pooled > 0)
            touched, moves = [], []
            for j, k in enumerate(WIDTHS):
                grads[f"filter{k}"] = np.zeros_like(w[f"filter{k}"])
                if k not in where:
                    continue
                there, begin, best, response = where[k]
                owner = np.repeat(np.arange(len(there)), np.diff(np.append(begin, len(response))))
                tail = response[begin[0] :]
                for f in range(FILTERS):
                    g = back[there, j * FILTERS + f]
                    hit = np.flatnonzero(tail[:, f] == best[owner, f])
                    _, at = np.unique(owner[hit], return_index=True)
                    at = hit[at] + begin[0]
                    live = np.flatnonzero(g)
                    if not len(live):
                        continue
                    for i in range(k):
                        rows = ids[at[live] + i]
                        grads[f"filter{k}"][i * WIDTH : (i + 1) * WIDTH, f] += w["embed"][rows].sum(axis=1).T @ g[live]
                        touched.append(rows.ravel())
                        moves.append(np.repeat(np.outer(g[live], w[f"filter{k}"][i * WIDTH : (i + 1) * WIDTH, f]), rows.shape[1], axis=0))
            t += 1
            if touched:
                rows, back_to = np.unique(np.concatenate(touched), return_inverse=True)
                g = np.zeros((len(rows), WIDTH), np.float32)
                np.add.at(g, back_to, np.concatenate(moves))
                live = known[rows]
                rows, g = rows[live], g[live] + DECAY * w["embed"][rows[live]]
                first["embed"][rows] = 0.9 * first["embed"][rows] + 0.1 * g
                second["embed"][rows] = 0.99 * second["embed"][rows] + 0.01 * g * g
                w["embed"][rows] -= RATE * first["embed"][rows] / (np.sqrt(second["embed"][rows]) + 1e-6)
            for name, g in grads.items():
                g = g + DECAY * w[name]
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.99 * second[name] + 0.01 * g * g
                w[name] -= RATE * (first[name] / (1 - 0.9**t)) / (np.sqrt(second[name] / (1 - 0.99**t)) + 1e-6)


def _platt(logits: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Scale and shift by Newton steps on the smoothed cross entropy."""
    pos, neg = labels.sum(), len(labels) - labels.sum()
    target = np.where(labels == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * logits + b, -30, 30)))
        g = np.array([((p - target) * logits).sum() + 1e-3 * (a - 1), (p - target).sum()])
        v = p * (1 - p)
        h = np.array([[(v * logits * logits).sum() + 1e-3, (v * logits).sum()], [(v * logits).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step *= min(1, 2 / max(np.abs(step).max(), 1e-9))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)


def _threshold(scores: np.ndarray, labels: np.ndarray) -> float:
    """The middle of the best F1's range of cutoffs."""
    cuts = np.unique(np.round(scores, 3))
    cuts = np.unique(np.concatenate([cuts, [0.3, 0.5]]))
    f1 = np.array([2 * (labels[scores >= c].sum()) / max(1, (scores >= c).sum() + labels.sum()) for c in cuts])
    best = cuts[f1 >= f1.max() - 1e-12]
    return float(np.median(best))


def fit(texts: list[str | None], labels: list[int], langs: list[str | None]) -> Classifier:
    """A classifier from labelled texts; every fifth is kept for calibration."""
    ids, y = [word_ids(t) for t in texts], np.array(labels, float)
    model = Classifier.new()
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
        model.weights["out"][:] = 0
        model.weights["bias"][0] = np.log(share / (1 - share))
        return model
    held = np.random.default_rng(SEED).random(len(y)) * 100 < CALIBRATION_PERCENT
    if y[held].min(initial=1) == y[held].max(initial=0) or y[~held].min(initial=1) == y[~held].max(initial=0):
        held = np.zeros(len(y), bool)
    use = np.flatnonzero(~held)
    _train(model, [ids[i] for i in use], y[use])
    test = np.flatnonzero(held) if held.any() else use
    picked = [ids[i] for i in test]
    model.scale, model.shift = _platt(model.raw(picked), y[test])
    scores = model.score(picked)
    model.threshold = _threshold(scores, y[test])
    tongues = np.array([str(langs[i]) for i in test])
    for lang in set(tongues.tolist()):
        own = tongues == lang
        weight = own.sum() / (own.sum() + LEAST_BY_LANG)
        if y[test][own].any() and not y[test][own].all():
            model.by_lang[lang] = float(weight * _threshold(scores[own], y[test][own]) + (1 - weight) * model.threshold)
    return model


def held_out(key: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.encode(key.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> list:
    """At most ``MAX_TRAINING`` labelled rows that aren't held out: those whose id has the smallest hash, but for very long ones."""
    known = labels.where(F.col("toxic").isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key))).groupBy(key).agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64(F.lit(SEED), key), key).limit(MAX_TRAINING).select(F.col(key).alias("of"), "toxic")
    # A bounded number of narrow rows, so it may be broadcast.
    joined = docs.select(key, F.col(text).alias("text"), "lang").join(F.broadcast(chosen), F.col(key) == F.col("of"))
    short = joined.where(F.coalesce(F.char_length("text"), F.lit(0)) <= MAX_TRAINING_CHARS)
    return short.groupBy("of").agg(F.min(F.struct("text", "lang", "toxic")).alias("row")).select("of", "row.*").orderBy("of").collect()


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``held_out``, ``score``, ``predicted`` (score of 0.3 or more) and ``flagged`` (by the language's threshold) of every row."""
    rows = training_rows(docs, labels, key, text)
    model = fit([r["text"] for r in rows], [r["toxic"] for r in rows], [r["lang"] for r in rows])
    # A few hundred KB of weights, whatever the input; float16 would do as well.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, at = batch.column(0), 0
            texts, langs = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and (end == at or chars < 4_000_000):
                    chars += len(texts[end] or "")
                    end += 1
                m = shared.value
                p = m.score([word_ids(t) for t in texts[at:end]])
                own = np.array([m.by_lang.get(str(x), m.threshold) for x in langs[at:end]])
                columns = [keys.slice(at, end - at), pa.array(p, pa.float64()), pa.array((p >= 0.3).astype(np.int32)), pa.array((p >= own).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, [key, "score", "predicted", "flagged"])
                at = end

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(key, text, "lang").mapInArrow(run, f"`{key}` {kind}, score double, predicted int, flagged int")
    return out.select(key, held_out(F.col(key)).alias("held_out"), "score", "predicted", "flagged")
