"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``SLOTS`` slots; a row's slot is a hash of its key, and each shard owns
``vnodes`` slots at hashed places. A row belongs to the first virtual node at or after its
slot. A shard takes at most its capacity; rows beyond it continue clockwise to the next
virtual node whose shard has room. Rows of a shard's own arcs come before rows that overflow
into it, so only the surplus moves. With ``slack = 0`` the capacities add up to the number of
rows, so every shard is filled exactly: counts are at most one apart.

Only slot counts reach the driver (at most ``SLOTS`` rows, plus one per input partition for a
slot that holds far more than its share), never keys. The row-level work is one shuffle by
slot and a broadcast of the slot plan, whose size has the same bound.
"""

from __future__ import annotations

import math
from collections import defaultdict

import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archspark.session import cut_lineage

SLOTS = 1 << 16
#: a slot with this many times the mean, and at least HOT_ROWS rows, is ranked in pieces
HOT_TIMES, HOT_ROWS = 8, 100_000


def ring(n_shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(slot, shard) of every virtual node, ascending; a slot taken twice goes to the next free one."""
    taken: dict[int, int] = {}
    for shard in range(n_shards):
        for i in range(vnodes):
            slot = xxhash.xxh64_intdigest(f"{shard}/{i}") % SLOTS
            while slot in taken:
                slot = (slot + 1) % SLOTS
            taken[slot] = shard
    return sorted(taken.items())


def capacities(n: int, n_shards: int, slack: float) -> list[int]:
    """Rows each shard may hold; with no slack they add up to ``n`` and differ by at most one."""
    if slack:
        return [math.ceil((1 + slack) * n / n_shards)] * n_shards
    return [n // n_shards + (s < n % n_shards) for s in range(n_shards)]


def plan(cells: list[tuple[int, int, int]], nodes: list[tuple[int, int]], room: list[int]) -> list[tuple]:
    """Runs of rows to shards: ``(slot, piece, first rank, last rank, shard, place of the first rank)``.

    ``cells`` are (slot, piece, rows) in ring order. Each round offers what is waiting at a
    virtual node to its shard; what finds no room waits at the next node with room.
    """
    room, filled = list(room), defaultdict(int)
    waiting: dict[int, list[list[int]]] = defaultdict(list)
    at = 0
    for slot, piece, rows in cells:
        while at < len(nodes) and nodes[at][0] < slot:
            at += 1
        waiting[at % len(nodes)].append([slot, piece, 0, rows])
    out = []
    while waiting:
        moved: dict[int, list[list[int]]] = defaultdict(list)
        for node in sorted(waiting):
            shard = nodes[node][1]
            for run in waiting[node]:
                slot, piece, first, rows = run
                take = min(rows, room[shard])
                if take:
                    out.append((slot, piece, first, first + take - 1, shard, filled[shard]))
                    room[shard] -= take
                    filled[shard] += take
                if take < rows:
                    step = (node + 1) % len(nodes)
                    while not room[nodes[step][1]]:
                        step = (step + 1) % len(nodes)
                    moved[step].append([slot, piece, first + take, rows - take])
        waiting = moved
    return out


def assign_shards(docs: DataFrame, *, n_shards: int = 24, vnodes: int = 128, slack: float = 0.0,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, size, text_crc32, shard, slot (gapless from 0 in its shard).

    A null text has no bytes (size 8, crc 0); a null id is a key like any other; equal rows are
    separate rows with a place each; an empty table gives an empty result. Only the id and the
    text are read.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.col(id_col)).alias("place"),
    ).withColumn("ring", F.pmod("place", F.lit(SLOTS)).cast("int"))
    rows = cut_lineage(rows)  # counted, then ranked: both must see the same rows in the same partitions
    counts = {r["ring"]: r["n"] for r in rows.groupBy("ring").agg(F.count("*").alias("n")).collect()}
    n = sum(counts.values())
    hot = [s for s, c in counts.items() if c >= HOT_ROWS and c > HOT_TIMES * n / SLOTS]
    piece = F.when(F.col("ring").isin(hot), F.spark_partition_id()).otherwise(F.lit(0)) if hot else F.lit(0)
    rows = rows.withColumn("piece", piece.cast("int"))
    cells = [(s, 0, c) for s, c in counts.items() if s not in set(hot)]
    if hot:
        cells += [tuple(r) for r in rows.filter(F.col("ring").isin(hot)).groupBy("ring", "piece").count().collect()]
    runs = plan(sorted(cells), ring(n_shards, vnodes), capacities(n, n_shards, slack))
    table = spark.createDataFrame(runs, "ring int, piece int, first long, last long, shard int, start long")
    order = Window.partitionBy("ring", "piece").orderBy("place", id_col, "text_crc32", "size")
    ranked = rows.withColumn("rank", F.row_number().over(order).cast("long") - 1)
    r, t = ranked.alias("r"), F.broadcast(table).alias("t")  # at most SLOTS cells and a few cuts
    return (r.join(t, (F.col("r.ring") == F.col("t.ring")) & (F.col("r.piece") == F.col("t.piece"))
                   & F.col("r.rank").between(F.col("t.first"), F.col("t.last")))
            .select(F.col(f"r.{id_col}").alias(id_col), "size", "text_crc32", "shard",
                    (F.col("start") + F.col("rank") - F.col("first")).alias("slot")))
