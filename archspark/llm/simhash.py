"""SimHash near-duplicates by covering locality-sensitive hashing.

Every document gets a 64-bit fingerprint: a bit is 1 if it is set in over half of the XXH64
values of its word shingles. Equal fingerprints are collapsed first, so copies cost nothing
later on. For radius r each bit place i gets a vector a(i) of r + 1 bits, and there is a table
for each non-zero vector v: its mask holds the places where <a(i), v> is odd. The differing
places of a pair within the radius span at most r dimensions, so some v is orthogonal to all of
them, and the pair agrees on that table's masked bits. Hence no pair within the radius is
missed; every candidate is verified by its bit distance.

A bucket emits a spanning forest of its links, not all pairs, so its output is linear in
its size. A bucket with more than ``bucket`` fingerprints is split: a pair within r differing
bits agrees on one of r + 1 blocks of the fingerprint, so each block value makes a smaller
bucket. If that is still too large, it is dealt into chunks that meet pairwise, each pair of
chunks in a task of its own. Nothing is dropped at any size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archspark.llm.common import annotate
from archspark.llm.components import components
from archspark.session import cut_lineage

BITS = 64
SEED = 42
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, shingle: int) -> int:
    """Unsigned 64-bit fingerprint; no words: 0."""
    words = (text or "").encode().translate(LOWER).split()  # ASCII white space: \x20, \x09-\x0D
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    values = np.array([digest(flat[a:b], SEED) for a, b in spans], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(values), 65_536):
        part = values[at : at + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << int(i) for i in np.flatnonzero(2 * ones > len(values)))


def covering_masks(radius: int) -> list[int]:
    """Signed 64-bit masks of the 2^(radius+1) - 1 tables; a(i) runs through the non-zero vectors."""
    size = (1 << (radius + 1)) - 1
    masks = []
    for v in range(1, size + 1):
        m = sum(1 << i for i in range(BITS) if ((1 + i % size) & v).bit_count() & 1)
        masks.append(m - (1 << 64) if m >> 63 else m)
    return masks


def block_masks(radius: int) -> list[int]:
    edges = [BITS * i // (radius + 1) for i in range(radius + 2)]
    masks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _bits(x: np.ndarray) -> np.ndarray:
    """Set bits of signed 64-bit numbers (bitwise_count alone counts those of the absolute value)."""
    return np.bitwise_count(x.view(np.uint64))


def _forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within one bucket, found by breadth-first search."""
    left, out = fps, []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = _bits(left ^ x) <= radius
            if near.any():
                out += [(int(x), int(y)) for y in left[near]]
                front += list(left[near])
                left = left[~near]
    return out


def bucket_links(groups: np.ndarray, fps: np.ndarray, radius: int, small: int = 6) -> list[tuple[int, int]]:
    """Links within runs of equal ``groups``: all of them in runs up to ``small``, forests of the others."""
    cuts = np.flatnonzero(groups[1:] != groups[:-1]) + 1
    starts, sizes = np.concatenate(([0], cuts)), np.diff(np.concatenate(([0], cuts, [len(groups)])))
    out: list[tuple[int, int]] = []
    little = np.repeat(sizes <= small, sizes)
    for lag in range(1, small):
        if lag >= len(groups):
            break
        hit = (groups[lag:] == groups[:-lag]) & little[lag:]
        hit &= _bits(fps[lag:] ^ fps[:-lag]) <= radius
        out += list(zip(fps[lag:][hit].tolist(), fps[:-lag][hit].tolist()))
    for a, n in zip(starts[sizes > small].tolist(), sizes[sizes > small].tolist()):
        out += _forest(np.unique(fps[a : a + n]), radius)
    return out


def links_in_groups(rows: DataFrame, radius: int) -> DataFrame:
    """Links (u, v) between fingerprints that share a group; ``rows`` (g, fp) with bounded groups."""
    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            g, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            held.append((g, fp))
            if g[0] == g[-1] == held[0][0][0]:
                continue  # the run may go on
            g, fp = (np.concatenate(x) for x in zip(*held))
            last = np.searchsorted(g, g[-1])
            held = [(g[last:], fp[last:])]
            yield _pairs(bucket_links(g[:last], fp[:last], radius))
        if held:
            yield _pairs(bucket_links(*(np.concatenate(x) for x in zip(*held)), radius))

    return rows.select("g", "fp").repartition("g").sortWithinPartitions("g").mapInArrow(run, "u long, v long")


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    u, v = (pa.array([p[i] for p in found], pa.int64()) for i in (0, 1))
    return pa.RecordBatch.from_arrays([u, v], names=["u", "v"])


def _grouped(rows: DataFrame, bucket: int) -> tuple[DataFrame, DataFrame]:
    """Rows of groups with 2 to ``bucket`` members; rows, with the group's size, of larger ones."""
    sizes = rows.groupBy("g").agg(F.count("*").alias("n")).filter("n > 1")
    sized = rows.join(sizes, "g")
    return sized.filter(F.col("n") <= bucket), sized.filter(F.col("n") > bucket)


def near_links(fps: DataFrame, radius: int, bucket: int) -> DataFrame:
    """Links (u, v) that connect all distinct fingerprints within the radius as all links would."""
    tables = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k"))
                                 for i, m in enumerate(covering_masks(radius))]))
    rows = fps.select("fp", tables.alias("x")).select(F.xxhash64("x.t", "x.k").alias("g"), "fp")
    small, big = _grouped(rows, bucket)
    blocks = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k"))
                                 for i, m in enumerate(block_masks(radius))]))
    again = big.select("g", "fp", blocks.alias("x")).select(F.xxhash64("g", "x.t", "x.k").alias("g"), "fp")
    small2, huge = _grouped(again, bucket)
    # chunk c of a group of n rows meets every chunk of the group: one task for each pair
    chunks = F.ceil(F.col("n") * 2 / bucket).cast("int")
    huge = (huge.withColumn("c", chunks).withColumn("i", F.pmod(F.xxhash64("fp"), F.col("c")).cast("int"))
            .select("g", "fp", "i", F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("j"))
            .select(F.xxhash64("g", F.least("i", "j"), F.greatest("i", "j")).alias("g"), "fp"))
    return links_in_groups(small.select("g", "fp").unionAll(small2.select("g", "fp")).unionAll(huge), radius)


def near_duplicates(docs: DataFrame, *, shingle: int = 3, radius: int = 3, bucket: int = 4096,
                    id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """id, carried columns, fingerprint (16 hex digits), component_id (smallest id reachable over links).

    group_fp, a fingerprint of the component, tells apart components without any id.

    Null, empty and blank texts have fingerprint zero, linked like any other; repeated rows share
    a fingerprint and so a component; a null id is no candidate for the smallest id (a component of
    null ids only gets null); an empty table gives an empty result. Only id and text are read.
    """
    def make():
        def work(texts):
            fps = np.array([fingerprint(t, shingle) for t in texts.to_pylist()], np.uint64)
            return [fps.view(np.int64)]

        return work

    rows = cut_lineage(annotate(docs, make, "fp long", id_col=id_col, text_col=text_col, carry=carry))
    first = rows.groupBy("fp").agg(F.min(id_col).alias("first"))
    links = near_links(first.select("fp"), radius, bucket)
    roots = components(links)
    member = roots.join(first.withColumnRenamed("fp", "node"), "node")
    least = member.groupBy("root").agg(F.min("first").alias("least"))
    linked = roots.join(least, "root").select(F.col("node").alias("fp"), "root", "least")
    groups = first.join(linked, "fp", "left").select("fp", F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("least")).alias("component_id"),
                                                     F.coalesce("root", "fp").alias("group_fp"))
    return (rows.join(groups, "fp")
            .select(id_col, *(c for c in carry if c != id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                    "component_id", "group_fp"))


def one_of_each_group(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without near-duplicates: of each component the row with the smallest id stays.

    Rows with an id come before rows without, equal ids go by a hash of the whole row, and of rows
    equal in all columns one stays. Texts are shuffled only if the removed rows are too many to be
    broadcast (the planner decides by their size).
    """
    columns = docs.columns
    keyed = docs.withColumn("__row", F.xxhash64(*columns))
    found = near_duplicates(keyed, id_col=id_col, text_col=text_col, carry=("__row",), **how)
    rows = cut_lineage(found.select(id_col, "__row", "group_fp").groupBy(id_col, "__row", "group_fp").agg(F.count("*").alias("n")))
    first = F.min(F.struct(F.col(id_col).isNull().alias("x"), F.col(id_col).alias("y"), F.col("__row").alias("z")))
    stays = rows.groupBy("group_fp").agg(first["z"].alias("__row"))
    gone = rows.join(stays, "__row", "left_anti").select("__row")
    kept = keyed.join(gone, "__row", "left_anti")
    repeated = rows.join(stays, "__row", "left_semi").filter("n > 1").select("__row")
    if not repeated.isEmpty():  # equal rows: all have stayed so far
        again = kept.join(repeated, "__row", "left_semi").dropDuplicates(["__row"])
        kept = kept.join(repeated, "__row", "left_anti").unionByName(again)
    return kept.select(*columns)
