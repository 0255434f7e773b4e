"""SentencePiece byte-pair encoding and decoding by vectorised merge rounds.

All words that a batch of texts needs are laid out as one flat array of symbols. Each round finds, by a
segmented minimum, the best pair rank of every word, merges all its leftmost non-overlapping occurrences at
once, and compacts the array; words without a pair left are taken out. Two steps keep this equal to the
library's one-merge-at-a-time order:

* a word is cut where two neighbouring characters are neighbours in no vocabulary piece, as no merge can span
  such a place;
* if merging several occurrences at once makes a pair that ranks as well or better than the one just merged,
  the order of merges could matter, and that word alone is redone one merge at a time with a heap.

The words come from white space, which no piece holds after another character (checked when a model is
loaded). A bounded cache per Python worker keeps the ids of words that were seen before.

Nulls and empty texts have no ids and decode to an empty text. Text is treated whole, whatever its length. Rows map to
rows: repeated ones and equal or null ids are encoded one by one, and ties don't arise. An empty table gives an empty
result. Other columns aren't read, whatever their names.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from voxelgrain.llm.common import lean

SPACE = "▁"
#: Symbols from here on are characters without a piece of their own: this plus the code point.
LOOSE = 1 << 21
WIDTH = LOOSE + 0x110000
NEVER = np.int32(2**31 - 1)
#: Words that a worker remembers, and characters of text that it handles at once.
REMEMBERED, BLOCK_CHARS = 200_000, 1_000_000


def _one_by_one(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("voxelgrain_bytes", _one_by_one)


class PieceModel:
    """The tables of one model file: pair ranks, pieces as bytes, and how characters may be neighbours."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb2

        model = pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, kinds = model.normalizer_spec, pb2.ModelProto.SentencePiece
        if model.trainer_spec.model_type != pb2.TrainerSpec.BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only byte-pair models that keep the text as it is are supported")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.prefix = SPACE if norm.add_dummy_prefix else ""
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        if any(SPACE in p.lstrip(SPACE) for p in normal):
            raise ValueError("a piece holds white space after another character")
        self.byte = np.full(256, -1, np.int64)
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN)
        out = []
        for i, p in enumerate(model.pieces):
            if p.type == kinds.BYTE:
                self.byte[int(p.piece[3:5], 16)] = i
                out.append(bytes([int(p.piece[3:5], 16)]))
            elif p.type == kinds.CONTROL:
                out.append(b"")
            elif p.type == kinds.UNKNOWN:
                out.append(model.trainer_spec.unk_surface.encode())
            else:
                out.append(p.piece.replace(SPACE, " ").encode())
        self.fallback = model.trainer_spec.byte_fallback
        self.bytes_of = np.array(out, dtype=object)
        self.text_of = np.array([str(i) for i in range(len(out))], dtype=object)
        self.leads = np.array([p.type == kinds.NORMAL and p.piece.startswith(SPACE) for p in model.pieces])
        self.silent = np.array([p.type == kinds.CONTROL for p in model.pieces])
        self.symbol_of = np.arange(0x110000, dtype=np.int64) + LOOSE
        for p, i in normal.items():
            if len(p) == 1:
                self.symbol_of[ord(p)] = i
        by_score = {s: r for r, s in enumerate(sorted({model.pieces[i].score for i in normal.values()}, reverse=True))}
        pairs, near = {}, set()
        for p, i in normal.items():
            near.update(ord(a) << 21 | ord(b) for a, b in zip(p, p[1:], strict=False))
            for k in range(1, len(p)):
                left, right = self._symbol(p[:k], normal), self._symbol(p[k:], normal)
                if left >= 0 and right >= 0:
                    pairs[left * WIDTH + right] = (by_score[model.pieces[i].score], i)
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], dtype=np.int32)
        self.merged = np.array([pairs[k][1] for k in self.keys.tolist()], dtype=np.int64)
        self.pairs = pairs
        self.near = np.array(sorted(near), dtype=np.int64)
        loose = "".join(c for c in "\n\t\r" if not any(c in p for p in normal if len(p) > 1))
        self.unit = re.compile(f"{SPACE}+[^{SPACE}{loose}]*|[^{SPACE}{loose}]+" + (f"|[{loose}]" if loose else ""))
        self.known: dict[str, bytes] = {}

    def _symbol(self, part: str, normal: dict[str, int]) -> int:
        return normal[part] if part in normal else int(self.symbol_of[ord(part)]) if len(part) == 1 else -1

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; ``NEVER`` where the two don't merge."""
        key = left * WIDTH + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NEVER), self.merged[at]

    def _merge_in_turn(self, symbols: list[int]) -> list[int]:
        """One merge at a time, best rank first and leftmost among equals: the library's order."""
        symbols, n = list(symbols), len(symbols)
        after, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (found := self.pairs.get(symbols[i] * WIDTH + symbols[j])):
                heapq.heappush(heap, (found[0], i, symbols[i], symbols[j], found[1]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b, whole = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue
            symbols[i], symbols[j] = whole, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [s for s in symbols if s >= 0]

    def _rounds(self, symbols: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges every segment to the end. Returns the symbols and, non-descending, their segments."""
        done_symbols, done_segments = [], []
        start_symbols, start_bounds = symbols, np.searchsorted(segment, np.arange(segment[-1] + 2))
        rank, whole = np.full(len(symbols), NEVER, np.int32), np.zeros(len(symbols), np.int64)
        fresh = np.ones(len(symbols), bool)
        while len(symbols):
            last = np.append(segment[1:] != segment[:-1], True)
            todo = np.flatnonzero(fresh & ~last)
            rank[last] = NEVER
            if len(todo):
                rank[todo], whole[todo] = self._look_up(symbols[todo], symbols[todo + 1])
            first = np.flatnonzero(np.append(True, last[:-1]))
            sizes = np.diff(np.append(first, len(symbols)))
            best = np.minimum.reduceat(rank, first)
            ended = best == NEVER
            if ended.any():
                out = np.repeat(ended, sizes)
                done_symbols.append(symbols[out])
                done_segments.append(segment[out])
                symbols, segment, rank, whole = symbols[~out], segment[~out], rank[~out], whole[~out]
                if not len(symbols):
                    break
                best, sizes = best[~ended], sizes[~ended]
            top = np.repeat(best, sizes)
            chosen = rank == top
            at = np.flatnonzero(chosen)
            begins = np.append(True, np.diff(at) > 1)
            run = np.maximum.accumulate(np.where(begins, at, 0))
            at = at[(at - run) % 2 == 0]
            merged = symbols.copy()
            merged[at] = whole[at]
            gone = np.zeros(len(symbols), bool)
            gone[at + 1] = True
            keep = ~gone
            changed = np.zeros(len(symbols), bool)
            changed[at] = True
            changed, new, new_segment, new_top = changed[keep], merged[keep], segment[keep], top[keep]
            # Several merges in one segment, and a pair that is as good arises: their order could matter.
            owner = segment[at]
            many = np.append(False, owner[1:] == owner[:-1])
            fresh = changed.copy()
            fresh[:-1] |= changed[1:]
            redo = np.zeros(0, np.int64)
            if many.any():
                several = np.unique(owner[many])
                look = np.flatnonzero(fresh[:-1] & (new_segment[1:] == new_segment[:-1]))
                look = look[np.isin(new_segment[look], several)]
                if len(look):
                    r, _ = self._look_up(new[look], new[look + 1])
                    redo = np.unique(new_segment[look[r <= new_top[look]]])
            rank, whole = rank[keep], whole[keep]
            symbols, segment = new, new_segment
            if len(redo):
                out = np.isin(segment, redo)
                symbols, segment, rank, whole, fresh = symbols[~out], segment[~out], rank[~out], whole[~out], fresh[~out]
                for s in redo.tolist():
                    in_turn = self._merge_in_turn(start_symbols[start_bounds[s] : start_bounds[s + 1]].tolist())
                    done_symbols.append(np.array(in_turn, np.int64))
                    done_segments.append(np.full(len(in_turn), s, segment.dtype))
        symbols, segment = np.concatenate(done_symbols), np.concatenate(done_segments)
        order = np.argsort(segment, kind="stable")
        return symbols[order], segment[order]

    def _learn(self, units: list[str]) -> None:
        """Adds the ids of ``units``, all of them not empty, to what is known."""
        lengths = np.array([len(u) for u in units])
        points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        unit = np.repeat(np.arange(len(units)), lengths)
        near = points[:-1] << 21 | points[1:]
        at = np.minimum(np.searchsorted(self.near, near), len(self.near) - 1)
        cut = np.append(False, (unit[1:] != unit[:-1]) | (self.near[at] != near))
        segment = np.cumsum(cut)
        unit_of = unit[np.flatnonzero(np.append(True, cut[1:]))]
        symbols, segment = self._rounds(self.symbol_of[points], segment)
        unit = unit_of[segment]
        loose = symbols >= LOOSE
        if loose.any():
            spread = [[s] if s < LOOSE else self._spelt(s - LOOSE) for s in symbols.tolist()]
            unit = np.repeat(unit, [len(x) for x in spread])
            symbols = np.array([s for x in spread for s in x], np.int64)
        ids, ends = symbols.astype("<i4").tobytes(), np.searchsorted(unit, np.arange(1, len(units) + 1)) * 4
        begin = 0
        for u, end in zip(units, ends.tolist(), strict=True):
            self.known[u] = ids[begin:end]
            begin = end

    def _spelt(self, point: int) -> list[int]:
        if not self.fallback:
            return [self.unknown]
        return self.byte[list(chr(point).encode("utf-8", "surrogatepass"))].tolist()

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        split = [self.unit.findall(self.prefix + t.replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = {u for s in split for u in s}.difference(self.known)
        if new:
            self._learn(sorted(new))
        known = self.known
        return [np.frombuffer(b"".join([known[u] for u in s]), "<i4") for s in split]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ``ids``; bytes that aren't UTF-8 become U+FFFD one by one."""
        if not len(ids):
            return ""
        text = b"".join(self.bytes_of[ids].tolist()).decode("utf-8", "voxelgrain_bytes")
        heard = np.flatnonzero(~self.silent[ids])
        return text[1:] if self.prefix and len(heard) and self.leads[ids[heard[0]]] else text


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    return PieceModel(path)


def _forget(path: str) -> None:
    model(path).known.clear()


def blocks(texts: list[str | None]) -> Iterator[list[str]]:
    """The texts in order, about ``BLOCK_CHARS`` characters at a time; a longer text is a block of its own."""
    block, size = [], 0
    for t in texts:
        block.append(t or "")
        size += len(block[-1])
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def encode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``ids`` (array of int) of every row's whole text. Rows map to rows: repeated keys stay."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            at = 0
            for block in blocks(batch.column(1).to_pylist()):
                ids = pa.array([x.tolist() for x in m.encode_all(block)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(block)), ids], [key, "ids"])
                at += len(block)

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(lean(run, partial(_forget, path)), f"`{key}` {kind}, ids array<int>")


def decode(df: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key`` and ``text`` for rows with an array of ids (null: empty)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            out = [m.decode(np.array(x or [], np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], [key, "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, ids).mapInArrow(lean(run, partial(_forget, path)), f"`{key}` {kind}, text string")


def digests(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes every whole text, decodes the ids, and returns ``key``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for batch in batches:
            at = 0
            for block in blocks(batch.column(1).to_pylist()):
                ids = m.encode_all(block)
                columns = [
                    batch.column(0).slice(at, len(block)),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([sha(",".join(m.text_of[x].tolist())) for x in ids], pa.string()),
                    pa.array([sha(m.decode(x)) for x in ids], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, [key, "n_tokens", "ids_sha256", "decoded_sha256"])
                at += len(block)

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(lean(run, partial(_forget, path)), f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
