"""N-gram Jaccard self-join by prefix trees.

Texts that have the same set of word n-grams are one class; only classes are joined. All n-grams have one global
order, by their hash, in which frequent ones are moved back by a fixed distance ``BACK``. Sets with Jaccard
similarity ``percent`` or more share one of the first ``n - ceil(percent * n) + 1`` n-grams of each, so only these
prefixes are counted and joined. As ``BACK`` is fixed, a prefix always lies inside the part of a set that one look
at the hashes gives, and frequencies are needed for that part alone.

The join has two steps, and whole sets are fetched for the second alone.

* Families. Classes that share a prefix n-gram meet with a sketch of their sets, a parity bit for each of about n
  hash values. Sketches that differ in more bits than linked sets have differing n-grams rule a link out, for
  certain. What isn't ruled out chains classes to families, and no link leaves a family.
* Links. The whole sets of a family are stored in a trie over the global order. The trie is walked from the root,
  carrying for every set its overlap with the path so far: sets that share a path share that work. A subtree is
  left out for sets whose overlap, with all that remains below, can't reach the threshold, for sets of other
  lengths, and for sets that are already known to be of one component with all of the subtree.

Both steps meet in the same way (``_meet``): the rows of a group are dealt out to cells of bounded size, twice. At
first every row goes to one cell, and the group's leader to all. What is found becomes known. Then only groups with
more than one known component are dealt out again: the commonest component's rows to one cell each, the others to
all of them. A cell gives links that connect what is linked in it, fewer than it has rows, never pairs. So links
that others imply aren't made, while no link between components is missed.

Words are runs without white space, after lower-casing A-Z. A text with fewer words than n has its whole sequence
as its only n-gram. Null, empty and blank texts have no n-gram and are linked with nothing. n-grams are compared by
63-bit hashes and classes by 128-bit digests of all hashes. Very long texts are taken whole; only the n-grams of one
text must fit a worker. Rows may repeat, ids too: a row is told by its id and its text's hash. Ties go to the smallest
id; a null id never becomes a component's id unless all its ids are null. An empty table gives an empty result.
Other columns aren't read, whatever their names, but are carried along by ``keep_one``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelgrain.llm.common import discard, fresh, lean, written
from voxelgrain.llm.components import components

SPAN = 1 << 63
#: How far frequent n-grams are moved back, as a share of all hashes, and how many classes make one frequent: any
#: that is shared at all, so that a prefix begins with n-grams that can't match.
BACK, FREQUENT = 0.12, 2
#: Bytes that a cell's rows hold, at ``ROW_BYTES`` a row besides its set or sketch, and words a worker remembers.
CELL_BYTES, ROW_BYTES, REMEMBERED = 16_000_000, 4096, 500_000
#: The bitmap of wanted texts has two to this power bits: 2 MB, in at most 262,144 rows of 64 bits.
FILTER_BITS = 24


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


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def grams(text: str | None, n: int = 3) -> np.ndarray:
    """The set of a text's word n-grams, as ascending 63-bit hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    h, n = _word_hashes(words), min(n, len(words))
    acc = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        acc = _mixed(acc * np.uint64(0x9E3779B97F4A7C15) + h[k : len(words) - n + 1 + k])
    return np.unique((acc >> np.uint64(1)).astype(np.int64))


def _digest(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def sketch(found: np.ndarray) -> bytes:
    """A bit for each of the next power of two of hash values: whether an odd number of the n-grams has it."""
    bits = max(64, 1 << (max(len(found), 1) - 1).bit_length())
    return np.packbits((np.bincount(found & (bits - 1), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def most_differing(a, b, percent: int):
    """How many n-grams linked sets of ``a`` and ``b`` n-grams may have that the other has not."""
    return a + b + 2 * (-percent * (a + b) // (100 + percent))


def linked(common, a, b, percent: int):
    return 100 * common >= percent * (a + b - common)


def _fingerprints(docs: DataFrame, key: str, text: str, n: int, percent: int) -> DataFrame:
    """``id``, ``hash`` (the text's), ``n``, ``sig``, ``sketch``, and the part of the set that any prefix lies in: ``part`` and, if frequent, the ``later`` place of each."""
    back = int(BACK * SPAN)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for chunk in _chunks(batch.column(1)):
                sizes, sigs, sketches, parts, laters = [], [], [], [], []
                for t in chunk:
                    found = grams(t, n)
                    sizes.append(len(found))
                    sigs.append(_digest(found) if len(found) else None)
                    sketches.append(sketch(found))
                    if not len(found):
                        parts.append([])
                        laters.append([])
                        continue
                    p = prefix_length(len(found), percent)
                    part = found[: np.searchsorted(found, min(int(found[p - 1]) + back, SPAN - 1), "right")]
                    later = np.full(len(part), -1, np.int32)
                    later[:p] = np.searchsorted(found, np.minimum(part[:p], SPAN - 1 - back) + back)
                    parts.append(part)
                    laters.append(later)
                columns = [batch.column(0).slice(at, len(chunk)), batch.column(2).slice(at, len(chunk)), pa.array(sizes, pa.int32()), pa.array(sigs, pa.binary())]
                columns += [pa.array(sketches, pa.binary()), pa.array(parts, pa.list_(pa.int64())), pa.array(laters, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "hash", "n", "sig", "sketch", "part", "later"])
                at += len(chunk)

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key), F.col(text), F.xxhash64(text))
    return rows.mapInArrow(lean(run, _forget), f"id {kind}, hash bigint, n int, sig binary, sketch binary, part array<bigint>, later array<int>")


def _chunks(column, chars: int = 4_000_000) -> Iterator[list[str | None]]:
    chunk, size = [], 0
    for t in column.to_pylist():
        chunk.append(t)
        size += len(t or "")
        if size >= chars:
            yield chunk
            chunk, size = [], 0
    if chunk:
        yield chunk


def _prefixes(shared: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """``label`` and ``firsts``: the n-grams of each class's prefix that others have too, in global order; ``spot`` is a place and, above 32 bits, the later one plus 1."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, sizes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            offsets, values = batch.column(2).offsets.to_numpy(), batch.column(2).values
            spots, grams_of, hots = (values.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            ats, laters = spots & 0xFFFFFFFF, (spots >> 32) - 1
            kept, firsts, lengths = [], [], []
            for k in range(len(labels)):
                part = slice(offsets[k], offsets[k + 1])
                order = np.argsort(ats[part])
                at, later, hot, n = ats[part][order], laters[part][order], hots[part][order], int(sizes[k])
                moved = at[hot]
                place = at - np.searchsorted(moved, at) + np.searchsorted(np.sort(later[hot]), at, "right")
                own = later[hot]
                place[hot] = own - np.searchsorted(moved, own) + np.arange(len(moved))
                place = np.where(hot & (later < 0), n, place)
                keep = np.flatnonzero(place < prefix_length(n, percent))
                if len(keep):
                    keep = keep[np.argsort(place[keep], kind="stable")]
                    kept.append(k)
                    firsts.append(grams_of[part][order][keep])
                    lengths.append(len(keep))
            ends = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
            joined = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(firsts) if firsts else [], pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(labels[kept], pa.int64()), joined], ["label", "firsts"])

    lists = shared.groupBy("label").agg(F.collect_list(F.struct("spot", "gram", "frequent")).alias("found"))
    lists = lists.join(sizes.select("label", "n"), "label").select("label", "n", "found")
    return lists.mapInArrow(lean(run, _forget), "label bigint, firsts array<bigint>")


def _united(known: np.ndarray, at: int, hits: np.ndarray) -> list[tuple[int, int]]:
    """Makes ``at`` and all ``hits`` one component in ``known``, and gives a link to one of each component that was another."""
    _, first = np.unique(known[hits], return_index=True)
    out = [(at, int(hits[k])) for k in first if known[hits[k]] != known[at]]
    for _, other in out:
        known[known == known[other]] = known[at]
    return out


def trie_links(sets: list[np.ndarray], percent: int, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Enough of the links between ``sets`` (ascending arrays) to connect all that are linked; sets with equal ``known`` are connected already.

    The sets, cut down to the n-grams that two of them have, are sorted; a range of the sorted list with a common
    beginning is a node of the trie, and the beginning its path.
    """
    m = len(sets)
    known = np.arange(m) if known is None else np.unique(known, return_inverse=True)[1]
    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(m), sizes)
    order = np.argsort(flat, kind="stable")
    values, begins, times = np.unique(flat[order], return_index=True, return_counts=True)
    local = np.full(len(flat), -1)
    often = times >= 2
    ids = np.cumsum(often) - 1
    local[order] = np.repeat(np.where(often, ids, -1), times)
    holders = owner[order]
    posting = [holders[b : b + t] for b, t in zip(begins[often].tolist(), times[often].tolist(), strict=True)]
    ends = np.cumsum(sizes)
    paths = [x[x >= 0] for x in (local[e - k : e] for e, k in zip(ends.tolist(), sizes.tolist(), strict=True))]
    ranked = sorted(range(m), key=lambda k: paths[k].astype(">i4").tobytes())
    place = np.empty(m, int)
    place[ranked] = np.arange(m)
    links: list[tuple[int, int]] = []
    deep = np.array([len(paths[k]) for k in ranked])
    at_rank, size_at = np.array(ranked), sizes[ranked]
    # A node carries the sets that may still be linked with one below it, and their overlaps with its path.
    stack = [(0, m, 0, np.arange(m), np.zeros(m, np.int64))]
    while stack:
        lo, hi, depth, among, overlap = stack.pop()
        below = known[at_rank[lo:hi]]
        if (below == below[0]).all():
            use = known[among] != below[0]
            among, overlap = among[use], overlap[use]
        if not len(among):
            continue
        first, last = paths[ranked[lo]], paths[ranked[hi - 1]]
        most = min(len(first), len(last))
        differ = np.flatnonzero(first[depth:most] != last[depth:most])
        end = depth + int(differ[0]) if len(differ) else most
        if end > depth:
            overlap = overlap + np.bincount(np.concatenate([posting[g] for g in first[depth:end].tolist()]), minlength=m)[among]
        small, large, left = size_at[lo:hi].min(), size_at[lo:hi].max(), deep[lo:hi].max() - end
        size = sizes[among]
        # Each pair is looked at from the later of the two; lengths and what remains rule out the rest.
        alive = (place[among] < hi) & linked(np.minimum(overlap + left, large), size, small, percent) & (100 * size >= percent * small) & (percent * size <= 100 * large)
        among, overlap, size = among[alive], overlap[alive], size[alive]
        if not len(among):
            continue
        stop = lo
        while stop < hi and deep[stop] == end:
            k = ranked[stop]
            hit = (place[among] < stop) & (known[among] != known[k]) & linked(overlap, size, sizes[k], percent)
            if hit.any():
                links += _united(known, k, among[hit])
            stop += 1
        while stop < hi:
            head, step = paths[ranked[stop]][end], stop + 1
            while step < hi and paths[ranked[step]][end] == head:
                step += 1
            stack.append((stop, step, end, among, overlap))
            stop = step
    return links


Rows = list[tuple[int, int, int, bytes]]


def _trie_cell(rows: Rows, percent: int) -> list[tuple[int, int]]:
    """Links of labels from rows of label, what is known, size and set."""
    rows = list({r[0]: r for r in rows}.values())
    if len({r[1] for r in rows}) < 2:
        return []
    found = trie_links([np.frombuffer(r[3], np.int64) for r in rows], percent, np.array([r[1] for r in rows]))
    return [(rows[x][0], rows[y][0]) for x, y in found]


def _folded(sketch: int, bits: int, to: int) -> int:
    while bits > to:
        bits //= 2
        sketch = (sketch >> bits) ^ (sketch & ((1 << bits) - 1))
    return sketch


def _sketch_cell(rows: Rows, percent: int) -> list[tuple[int, int]]:
    """Pairs of labels, from rows of label, what is known, size and sketch, that connect all whose sketches don't rule a link out."""
    if len({r[1] for r in rows}) < 2:
        return []
    out = []
    if len(rows) <= 8:
        known, bits, found = [r[1] for r in rows], [8 * len(r[3]) for r in rows], [int.from_bytes(r[3], "little") for r in rows]
        for x in range(1, len(rows)):
            for y in range(x):
                a, b = rows[x][2], rows[y][2]
                if known[x] == known[y] or 100 * a < percent * b or 100 * b < percent * a:
                    continue
                least = min(bits[x], bits[y])
                if (_folded(found[x], bits[x], least) ^ _folded(found[y], bits[y], least)).bit_count() <= most_differing(a, b, percent):
                    known = [known[x] if k == known[y] else k for k in known]
                    out.append((rows[x][0], rows[y][0]))
        return out
    rows = sorted(rows, key=lambda r: r[2])
    sizes, labels = np.array([r[2] for r in rows]), [r[0] for r in rows]
    known = np.unique(np.array([r[1] for r in rows]), return_inverse=True)[1]
    bits = np.array([8 * len(r[3]) for r in rows])
    for level in np.unique(bits):
        lo = int(np.searchsorted(bits, level))
        here = int(np.searchsorted(bits, level, "right"))
        hi = int(np.searchsorted(sizes, 100 * sizes[here - 1] // percent, "right"))
        # Sketches of this length and, folded to it, those of larger sets that may be linked with one of these.
        found = np.concatenate([_fold(np.frombuffer(b"".join(r[3] for r in rows[a:b]), np.uint64).reshape(b - a, -1), int(level) // 64) for a, b in _runs(bits, lo, hi)])
        for x in range(lo, here):
            end = int(np.searchsorted(sizes, 100 * sizes[x] // percent, "right"))
            others = x + 1 + np.flatnonzero(known[x + 1 : end] != known[x])
            if len(others):
                apart = np.bitwise_count(found[others - lo] ^ found[x - lo]).sum(axis=1)
                hits = others[apart <= most_differing(sizes[x], sizes[others], percent)]
                if len(hits):
                    out += [(labels[a], labels[b]) for a, b in _united(known, x, hits)]
    return out


def _runs(bits: np.ndarray, lo: int, hi: int) -> list[tuple[int, int]]:
    """The ranges of equal values between ``lo`` and ``hi`` of an ascending array."""
    cuts = [lo, *(lo + 1 + np.flatnonzero(np.diff(bits[lo:hi]))).tolist(), hi]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def _fold(sketches: np.ndarray, words: int) -> np.ndarray:
    while sketches.shape[1] > words:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def _cells(rows: DataFrame, first: bool) -> DataFrame:
    """Deals ``rows`` (``group``, ``label``, ``known``, ``n``, ``payload``) out to cells ``host``, ``guest`` of their groups.

    Every row is a host in one block of its group. Guests go to all blocks of hosts: the row with the smallest label
    if ``first``, else those that don't belong to the commonest ``known``. Guests have blocks of their own, so that no
    cell holds more than two blocks. Groups in which nothing is left to be found are left out.
    """
    weight = F.octet_length("payload") + ROW_BYTES
    count = lambda column, of: F.ceil(F.greatest(column, F.lit(1)) / F.lit(of)).cast("int")
    if first:
        stats = rows.groupBy("group").agg(F.count("*").alias("m"), F.sum(weight).alias("total"), F.min("label").alias("of")).where("m > 1")
        stats, is_guest = stats.select("group", "of", count(F.col("total"), CELL_BYTES).alias("hosts"), F.lit(1).alias("guests")), F.col("label") == F.col("of")
    else:
        each = rows.groupBy("group", "known").agg(F.count("*").alias("m"), F.sum(weight).alias("w"))
        stats = each.groupBy("group").agg(F.count("*").alias("kinds"), F.sum("w").alias("total"), F.max(F.struct("w", "known")).alias("most")).where("kinds > 1")
        stats = stats.select("group", F.col("most.known").alias("of"), count(F.col("total"), CELL_BYTES).alias("hosts"), count(F.col("total") - F.col("most.w"), CELL_BYTES).alias("guests"))
        is_guest = F.col("known") != F.col("of")
    dealt = rows.join(stats, "group")
    own = lambda blocks: F.pmod(F.xxhash64("label"), F.col(blocks)).cast("int")
    every = lambda blocks: F.sequence(F.lit(0), F.col(blocks) - 1)
    as_host = F.transform(every("guests"), lambda g: F.struct(own("hosts").alias("host"), g.alias("guest")))
    as_guest = F.transform(every("hosts"), lambda h: F.struct(h.alias("host"), own("guests").alias("guest")))
    cells = F.when(is_guest, F.array_distinct(F.concat(as_host, as_guest))).otherwise(as_host)
    return dealt.withColumn("cell", F.explode(cells)).select("group", "cell.host", "cell.guest", "label", "known", "n", "payload")


def _meet(rows: DataFrame, first: bool, cell: Callable[[Rows, int], list[tuple[int, int]]], percent: int) -> DataFrame:
    """``a`` and ``b``: what ``cell`` finds in every cell of ``rows``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for batch in batches:
            out = []
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r[:3] != group:
                    out += cell(held, percent)
                    group, held = r[:3], []
                held.append(r[3:])
            yield _pairs(out)
        yield _pairs(cell(held, percent))

    dealt = _cells(rows, first).repartition("group", "host", "guest").sortWithinPartitions("group", "host", "guest")
    return dealt.mapInArrow(lean(run, _forget), "a bigint, b bigint")


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*found, strict=True) if found else ([], [])
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _connected(first: DataFrame, again: DataFrame, cell: Callable, percent: int, name: str) -> DataFrame:
    """Components of what ``cell`` finds: in the groups of ``first``, then among all of ``again`` that isn't connected yet."""
    links = written(_meet(first.withColumn("known", F.col("label")), True, cell, percent), name)
    roots = components(links)
    rest = again.join(roots, again["label"] == roots["node"], "left").withColumn("known", F.coalesce("root", "label")).drop("node", "root")
    more = written(_meet(rest, False, cell, percent), name)
    out = components(links.unionByName(more))
    discard(links, roots, more)
    return out


def _families(prints: DataFrame, by_sig: DataFrame, percent: int) -> DataFrame:
    """``node`` and ``root`` of classes that may be linked with another."""
    sizes = prints.select("label", "n", F.col("sketch").alias("payload"))
    # Both places in one number, as these are the most rows that are ever shuffled.
    spot = F.shiftleft((F.col("x.later") + 1).cast("long"), 32).bitwiseOR(F.col("at").cast("long")).alias("spot")
    parts = by_sig.select("label", F.posexplode(F.arrays_zip("part", "later")).alias("at", "x")).select("label", F.col("x.part").alias("gram"), spot)
    times = parts.groupBy("gram").agg(F.count("*").alias("times")).where("times > 1")
    shared = parts.join(times, "gram").select("label", "spot", "gram", (F.col("times") >= FREQUENT).alias("frequent"))
    prefixes = written(_prefixes(shared, sizes, percent), "prefixes")
    # Of the prefix n-grams, those that two classes' prefixes have; most classes have none.
    entries = prefixes.select("label", F.posexplode("firsts").alias("rank", "gram"))
    twice = entries.groupBy("gram").agg(F.count("*").alias("m")).where("m > 1").drop("m")
    found = entries.join(twice, "gram", "left_semi").groupBy("label").agg(F.sort_array(F.collect_list(F.struct("rank", "gram"))).alias("found"))
    found = found.select("label", F.transform("found", lambda x: x["gram"]).alias("grams")).join(sizes, "label")
    found = written(found, "candidates")
    discard(prefixes)
    out = _connected(found.withColumn("group", F.col("grams")[0]), found.withColumn("group", F.explode("grams")), _sketch_cell, percent, "near")
    discard(found)
    return out


def _word(hashed: Column) -> Column:
    """Which 64 bits of the bitmap a hash's bit lies in."""
    return F.pmod(F.shiftright(hashed, 6), F.lit(1 << (FILTER_BITS - 6)))


def _bit(hashed: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(hashed, F.lit(64)).cast("int"))


def _sets(docs: DataFrame, wanted: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """``label``, ``group``, ``n`` and the whole set as ``payload`` of the classes in ``wanted`` (``id``, ``hash``, ``label``, ``family``)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for chunk in _chunks(batch.column(0)):
                found = [grams(t, n) for t in chunk]
                columns = [batch.column(1).slice(at, len(chunk)), batch.column(2).slice(at, len(chunk)), pa.array([len(x) for x in found], pa.int32()), pa.array([x.tobytes() for x in found], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["label", "group", "n", "payload"])
                at += len(chunk)

    texts = docs.select(F.col(key).alias("of_id"), F.col(text).alias("body"), F.xxhash64(text).alias("of_hash"))
    # Most texts aren't wanted. A bitmap of the wanted hashes, of a size that doesn't grow, leaves them out before they
    # are shuffled; where so many are wanted that it fills up, it lets more through, and the join is right all the same.
    marks = wanted.groupBy(_word(F.col("hash")).alias("word")).agg(F.bit_or(_bit(F.col("hash"))).alias("mark"))
    texts = texts.join(F.broadcast(marks), _word(F.col("of_hash")) == F.col("word")).where(F.col("mark").bitwiseAND(_bit(F.col("of_hash"))) != 0)
    texts = texts.join(wanted, F.col("of_id").eqNullSafe(F.col("id")) & (F.col("of_hash") == F.col("hash"))).select("body", "label", "family")
    return texts.mapInArrow(lean(run, _forget), "label bigint, group bigint, n int, payload binary")


def _labelled(docs: DataFrame, key: str, text: str, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Every row's ``id``, ``hash``, ``n`` and ``sig``; and by ``sig`` its component's ``best`` row: ``missing``, ``id`` and ``hash``, the smallest."""
    prints = written(_fingerprints(docs, key, text, n, percent).withColumn("label", F.monotonically_increasing_id()), "prints")
    # Copies are combined before the shuffle; of each class one row's part goes on, that with the smallest label.
    best = F.min(F.struct(F.isnull("id").alias("missing"), "id", "hash")).alias("best")
    whole = prints.where("n > 0").groupBy("sig").agg(F.min(F.struct("label", "part", "later")).alias("one"), best)
    whole = written(whole.select("sig", "best", "one.*"), "classes")
    families = _families(prints, whole, percent)
    wanted = prints.select("id", "hash", "label").join(families.select(F.col("node").alias("label"), F.col("root").alias("family")), "label")
    wanted = written(wanted, "wanted")
    by_sig = written(whole.select("sig", "label", "best"), "named-classes")
    slim = written(prints.select("id", "hash", "n", "sig"), "rows")
    discard(prints, families, whole)
    sets = written(_sets(docs, wanted, key, text, n), "sets")
    discard(wanted)
    roots = _connected(sets, sets, _trie_cell, percent, "links")
    discard(sets)
    mine = by_sig.join(roots, by_sig["label"] == roots["node"], "left").withColumn("root", F.coalesce("root", "label"))
    best = mine.groupBy("root").agg(F.min("best").alias("best"))
    named = written(mine.select("sig", "root").join(best, "root").select(F.col("sig").alias("of"), "best"), "named")
    discard(by_sig, roots)
    return slim, named


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 3, percent: int = 90) -> DataFrame:
    """``id``, ``n`` (the set's size), ``component`` (the smallest id of the component) of every row of ``docs``."""
    rows, named = _labelled(docs, key, text, n, percent)
    size = F.col("n").cast("long").alias("n")
    linked_rows = rows.where("n > 0").join(named, F.col("sig") == F.col("of")).select("id", size, F.col("best.id").alias("component"))
    return linked_rows.unionByName(rows.where("n = 0").select("id", size, F.col("id").alias("component")))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 3, percent: int = 90) -> DataFrame:
    """One row of each component: that with the smallest key, null keys last; of rows that share it, any one. Rows without words all stay."""
    rows, named = _labelled(docs, key, text, n, percent)
    found = rows.where("n > 0").join(named, F.col("sig") == F.col("of"))
    stays = F.col("id").eqNullSafe(F.col("best.id")) & (F.col("hash") == F.col("best.hash"))
    judged = written(found.groupBy("id", "hash").agg(F.count("*").alias("times"), F.first(stays).alias("stays")).where("times > 1 or not stays"), "judged")
    discard(rows, named)
    base = fresh(docs, "gone_of")
    out = [F.col(f"`{c}`") for c in docs.columns]
    mine = [f"{base}_id", f"{base}_hash"]
    marked = docs.withColumn(mine[1], F.xxhash64(F.col(f"`{text}`")))
    same = lambda of: marked[f"`{key}`"].eqNullSafe(of[mine[0]]) & (marked[mine[1]] == of[f"{mine[1]}_"])
    gone = judged.select(F.col("id").alias(mine[0]), F.col("hash").alias(f"{mine[1]}_"), "times", "stays")
    kept = marked.join(gone, same(gone), "left_anti").select(*out)
    # Rows with one key and text that stay: one of each, found by a grouped aggregate.
    often = gone.where("stays")
    if often.isEmpty():
        return kept
    again = marked.join(often, same(often), "left_semi")
    again = again.groupBy(F.col(f"`{key}`").alias(mine[0]), F.col(mine[1])).agg(F.first(F.struct(*out)).alias("row"))
    return kept.unionByName(again.select("row.*"))
