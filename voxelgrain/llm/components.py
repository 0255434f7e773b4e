"""Connected components of a table of links: by one task where they are few, else by alternating large and small stars.

Nothing but counts comes to the driver. Every task connects the links that it has by itself, at most ``IN_ONE`` at a
time. As many as that are left to one task altogether; a round of stars costs as much for a few links as for many, in
jobs and in files. More than that go through the rounds. Every round is written to the shared folder, so lineage stays
short, and the round before is deleted. Each star operation groups by a node's smallest neighbour, found by a grouped
minimum, so a node with very many links is no hot key: the minimum is combined before the shuffle, and the join back may
be split. An empty table of links gives an empty result; repeated links and links of a node with itself change nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelgrain.llm.common import discard, written
from voxelgrain.operators.measure import connected

#: Links that one task connects at a time: 16 MB.
IN_ONE = 1_000_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hangs each node's larger (or smaller and own) neighbours on its smallest one."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def _forests(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The nodes of the links in ``batches``, and for each the smallest that it is connected with; for at most ``IN_ONE`` links at a time."""
    held, rows = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, IN_ONE):
            part = batch.slice(at, IN_ONE)
            if rows + part.num_rows > IN_ONE:
                yield _forest(held)
                held, rows = [], 0
            held.append(part)
            rows += part.num_rows
    if held:
        yield _forest(held)


def _forest(held: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    ends = [np.concatenate([b.column(k).to_numpy() for b in held]) for k in (0, 1)]
    nodes, place = np.unique(np.concatenate(ends), return_inverse=True)
    return nodes, nodes[connected(len(nodes), *np.split(place, 2))]


def _contracted(edges: DataFrame) -> DataFrame:
    """The links of every partition as stars around the smallest nodes that they connect."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, root in _forests(batches):
            hung = root != nodes
            yield pa.RecordBatch.from_arrays([pa.array(nodes[hung]), pa.array(root[hung])], ["a", "b"])

    return edges.mapInArrow(run, "a bigint, b bigint")


def _by_one(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` of no more than ``IN_ONE`` links."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, root in _forests(batches):
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(root)], ["node", "root"])

    return edges.coalesce(1).mapInArrow(run, "node bigint, root bigint")


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node reachable) of every node that has a link. ``edges`` has columns ``a`` and ``b``, and is read twice."""
    edges = edges.where("a <> b").select("a", "b")
    if edges.count() <= IN_ONE:
        return written(_by_one(edges), "roots")
    edges = written(_contracted(edges), "edges")
    before = _digest(edges)
    if before[0] <= IN_ONE:
        out = written(_by_one(edges), "roots")
        discard(edges)
        return out
    while before[0]:
        last, edges = edges, written(_star(_star(edges, True), False), "edges")
        discard(last)
        # A star forest hangs every node on one root that hangs on none; the digest tells whether a round changed anything.
        now = _digest(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = written(roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()), "roots")
    discard(edges)
    return out
