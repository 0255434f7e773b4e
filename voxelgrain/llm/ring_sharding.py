"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns ``VNODES`` points of a ring of ``2**RING_BITS`` positions; a point's position depends on its
shard and number alone. A row's position is a hash of its key (and, to spread rows that share a key, of its
text's checksum). Going clockwise from there, a row belongs to the first point it meets whose shard isn't full.
Capacities add up to the number of rows and differ by one at most, so in the end every shard is exactly full:
the law is ``rows``, counts at most one apart. A shard that is added takes over the arcs before its own points;
beyond that, only rows that overflow move.

It runs in two passes. The first counts rows by cell, a cell being a fixed part of the ring cut at every point;
there are ``CELLS`` parts and ``VNODES`` points a shard, whatever the number of rows. These counts come to the
driver, which walks the ring once over arcs and yields, for every arc, the runs of ranks that go to each shard.
Each of the shards fills up once, so there are as many runs as cells, points and shards, at most. The second pass
ranks rows inside their cell and looks their run up. Only narrow columns are shuffled.

Null texts have size 1 and the checksum of an empty text, empty ones the same; very long ones count by their bytes and
are read once. Null keys hash like any key, and repeated rows, which tie, get slots of their own. An empty table has no
rows in any shard. Other columns aren't read, whatever their names. One more shard than 16 moves about a tenth of the
rows, of which it takes 1/17; the rest had overflowed.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelgrain.llm.common import written

RING_BITS, VNODES, CELLS = 40, 64, 4096
SEED = "ring"


def positions(key: Column, salt: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key.cast("string"), salt), 64 - RING_BITS)


def points(spark, shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """The virtual nodes as (position, shard), clockwise. Their number is ``shards * vnodes``."""
    grid = spark.range(shards * vnodes).select(F.floor(F.col("id") / vnodes).alias("shard"), (F.col("id") % vnodes).alias("v"))
    rows = grid.select("shard", F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "shard", "v"), 64 - RING_BITS).alias("at")).collect()
    return sorted((r["at"], r["shard"]) for r in rows)


def plan(counts: dict[tuple[int, int], int], nodes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs of rows as (cell, arc, first rank, end rank, shard, first slot), from the counts by (cell, arc).

    ``arc`` is the index in ``nodes`` of the first point clockwise. Rows go round in turn: in each step, what waits
    at a point is taken by its shard as far as that has room, and the rest waits at the next point.
    """
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used, waiting = [0] * shards, defaultdict(list)
    for (cell, arc), n in sorted(counts.items()):
        waiting[arc].append((cell, arc, 0, n))
    runs, step = [], 0
    while any(waiting.values()):
        at = step % len(nodes)
        shard, queue = nodes[at][1], waiting.pop(at, [])
        for k, (cell, arc, first, end) in enumerate(queue):
            take = min(room[shard], end - first)
            if take:
                runs.append((cell, arc, first, first + take, shard, used[shard]))
                room[shard] -= take
                used[shard] += take
            if take < end - first:
                waiting[(at + 1) % len(nodes)] += [(cell, arc, first + take, end), *queue[k + 1 :]]
                break
        step += 1
    return runs


def _located(df: DataFrame, nodes: list[tuple[int, int]]) -> DataFrame:
    """``cell`` and ``arc`` from ``ring``. The parts of the ring that hold points are few, so a literal table will do."""
    width = 1 << (RING_BITS - (CELLS.bit_length() - 1))
    ats = [at for at, _ in nodes]
    first = [bisect_left(ats, c * width) for c in range(CELLS)]
    inside = [[a for a in ats[first[c] : (first[c + 1] if c + 1 < CELLS else len(ats))]] for c in range(CELLS)]
    spark = df.sparkSession
    lookup = spark.createDataFrame([(c, first[c], inside[c]) for c in range(CELLS)], "cell int, first int, inside array<bigint>")
    df = df.withColumn("cell", F.floor(F.col("ring") / width).cast("int"))
    # CELLS rows, whatever the data: safe to broadcast.
    df = df.join(F.broadcast(lookup), "cell")
    arc = F.col("first") + F.size(F.filter("inside", lambda a: a < F.col("ring")))
    return df.withColumn("arc", (arc % len(nodes)).cast("int")).drop("first", "inside")


def assign(df: DataFrame, shards: int, key: str = "doc_id", text: str = "text", vnodes: int = VNODES) -> DataFrame:
    """``key``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard`` and ``home_shard`` (without bounds) of every row."""
    spark, nodes = df.sparkSession, points(df.sparkSession, shards, vnodes)
    body = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    size = F.when(F.col(text).isNull(), F.lit(1)).otherwise(F.octet_length(F.col(text)) + 1).cast("long")
    slim = df.select(F.col(key), size.alias("size"), F.crc32(body).alias("text_crc32"))
    slim = slim.withColumn("ring", positions(F.col(key), F.col("text_crc32")))
    slim = written(_located(slim, nodes), "ring")
    counts = {(r["cell"], r["arc"]): r["count"] for r in slim.groupBy("cell", "arc").count().collect()}
    # A cell's rows in order of their place; the tail of the order only separates rows that share it.
    order = Window.partitionBy("cell", "arc").orderBy("ring", F.col(key), "text_crc32", "size")
    ranked = slim.withColumn("rank", F.row_number().over(order) - 1)
    by_arc = defaultdict(list)
    for cell, arc, first, end, shard, slot in plan(counts, nodes, shards):
        by_arc[cell, arc].append((first, end, shard, slot))
    schema = "cell int, arc int, runs array<struct<first:bigint,end:bigint,shard:int,slot:bigint>>"
    runs = spark.createDataFrame([(c, a, r) for (c, a), r in by_arc.items()], schema)
    # At most one row for each cell and point, and as many runs as rows and shards together: safe to broadcast.
    found = ranked.join(F.broadcast(runs), ["cell", "arc"])
    run = F.filter("runs", lambda r: (r["first"] <= F.col("rank")) & (F.col("rank") < r["end"]))[0]
    found = found.withColumn("run", run)
    homes = F.array(*(F.lit(s) for _, s in nodes))
    return found.select(
        key, "size", "text_crc32", F.lit("rows").alias("law"), F.col("run.shard").alias("shard"),
        (F.col("run.slot") + F.col("rank") - F.col("run.first")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), F.get(homes, F.col("arc")).cast("int").alias("home_shard"),
    )
