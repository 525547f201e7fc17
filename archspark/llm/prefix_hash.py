"""Document fingerprints from prefix polynomial hashes.

The prefix array of a text holds, for every position i, the sum of c_j * B^j over the code points before
i, modulo two primes of 31 bits. A span's value is a difference of two entries; spans at different
positions are compared after multiplying each by the base to the other's position. So any span equality
is answered from the arrays alone, and the longest common extension of two positions by binary search.

A fingerprint keeps a bounded part of the array: the length, the value of the whole text, and the values
at up to ``GRID`` multiples of a power of two counted from the start, and as many counted from the end.
Grids of powers of two nest, so the fingerprints of any two texts share positions: their longest common
prefix and suffix are located on them by binary search, and equal spans between are found at equal offsets.

Texts are hashed in blocks, so working memory is a block beside the text. The neighbour of a document in
ascending doc_id order is found without moving texts twice: ranges of (doc_id, hash of the text) are
taken from a table of these two numbers, each document goes to its range once, and the first document of
a range goes to the range before it too.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from archspark.llm.common import annotate, small_batches
from archspark.session import cut_lineage

#: the two largest primes below 2^31, and for each a base drawn from a digest of its name
PRIMES = (2147483647, 2147483629)
BASES = tuple(int(hashlib.sha256(f"base {p}".encode()).hexdigest(), 16) % (p - 2**21) + 2**20 for p in PRIMES)
GRID = 16
BLOCK = 1 << 15


@lru_cache(1)
def _powers() -> np.ndarray:
    """Base to the powers 0..BLOCK for both primes (512 KB)."""
    out = np.ones((2, BLOCK + 1), np.int64)
    for k, (p, b) in enumerate(zip(PRIMES, BASES)):
        have = 1
        while have <= BLOCK:
            take = min(have, BLOCK + 1 - have)
            out[k, have:have + take] = out[k, :take] * pow(b, have, p) % p
            have += take
    return out


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


class Prefix:
    """Prefix values of one text, kept at block starts; any other is summed within its block."""

    def __init__(self, text: str, like: Prefix | None = None, common: int = 0):
        """``like``: a text that has the same first ``common`` code points; its blocks are taken over."""
        self.points = points(text)
        self.n = len(self.points)
        same = common // BLOCK if like is not None else 0
        self.starts = like.starts[: same + 1].copy() if same else np.zeros((1, 2), np.int64)
        rows = [self.starts[-1]]
        for at in range(same * BLOCK, self.n, BLOCK):
            rows.append(self._add(rows[-1], at, min(at + BLOCK, self.n)))
        self.starts = np.vstack([self.starts, *rows[1:]])
        self.whole = tuple(int(x) for x in rows[-1])

    def _add(self, before, start: int, stop: int):
        """Prefix value at ``stop`` from that at ``start``, a block start."""
        chunk, powers = self.points[start:stop].astype(np.int64), _powers()
        # products stay below 2^52 before and sums below 2^46 after the modulus
        return np.array([(int(before[k]) + int((chunk * powers[k, : len(chunk)] % p).sum()) % p * pow(BASES[k], start, p)) % p
                         for k, p in enumerate(PRIMES)], np.int64)

    def at(self, i: int) -> tuple[int, int]:
        if i == self.n:
            return self.whole
        block = i // BLOCK
        before = self.starts[block]
        return tuple(int(x) for x in (before if i == block * BLOCK else self._add(before, block * BLOCK, i)))

    def many(self, places: list[int]) -> list[tuple[int, int]]:
        """``at`` for ascending places, each code point summed once."""
        out, powers = [], _powers()
        for block in range(0, self.n + 1, BLOCK):
            inside = [i for i in places if block <= i < block + BLOCK and i < self.n]
            if inside:
                chunk, before = self.points[block: inside[-1]].astype(np.int64), self.starts[block // BLOCK]
                sums = []
                for k, p in enumerate(PRIMES):
                    run = np.concatenate(([0], np.cumsum(chunk * powers[k, : len(chunk)] % p)))[np.array(inside) - block] % p
                    sums.append([(int(before[k]) + int(x) * pow(BASES[k], block, p)) % p for x in run])
                out += list(zip(*sums))
        return out + [self.whole] * sum(i == self.n for i in places)


def _span(start: tuple[int, int], stop: tuple[int, int], shift: int) -> tuple[int, ...]:
    """Value of a span between two prefix values, times the base to ``shift``."""
    return tuple((b - a) * pow(base, shift, p) % p for a, b, base, p in zip(start, stop, BASES, PRIMES))


def span_equal(a: Prefix, i: int, b: Prefix, j: int, length: int) -> bool:
    """Whether ``length`` code points from i in one text equal those from j in the other."""
    if i + length > a.n or j + length > b.n:
        return False
    return _span(a.at(i), a.at(i + length), j) == _span(b.at(j), b.at(j + length), i)


def common_extension(a: Prefix, i: int, b: Prefix, j: int) -> int:
    """Length of the longest common extension to the right of position i in one text and j in the other."""
    low, high = 0, max(min(a.n - i, b.n - j), 0)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if span_equal(a, i, b, j, middle) else (low, middle - 1)
    return low


def _step(n: int) -> int:
    step = 1
    while n // step > GRID:
        step *= 2
    return step


def _hex(pair: tuple[int, int]) -> str:
    return f"{pair[0]:08x}{pair[1]:08x}"


class Fingerprint:
    """length, whole value, values at k * step and at length - k * step (k from 1, inside the text)."""

    def __init__(self, n: int, whole: tuple, heads: list, tails: list):
        self.n, self.whole, self.heads, self.tails = n, whole, heads, tails
        self.step = _step(n)

    @classmethod
    def of(cls, prefix: Prefix) -> Fingerprint:
        n, step = prefix.n, _step(prefix.n)
        places = range(step, n, step)
        found = dict(zip(every := sorted({*places, *(n - i for i in places)}), prefix.many(every)))
        return cls(n, prefix.whole, [found[i] for i in places], [found[n - i] for i in places])

    def __str__(self) -> str:
        return f"{self.n:x}:{_hex(self.whole)}:{''.join(map(_hex, self.heads))}:{''.join(map(_hex, self.tails))}"

    @classmethod
    def parse(cls, text: str) -> Fingerprint:
        n, *parts = text.split(":")
        pairs = [[(int(x[i:i + 8], 16), int(x[i + 8:i + 16], 16)) for i in range(0, len(x), 16)] for x in parts]
        return cls(int(n, 16), pairs[0][0], pairs[1], pairs[2])

    def head(self, i: int) -> tuple[int, int]:
        """Prefix value at i, a multiple of the step or the length."""
        return (0, 0) if i == 0 else self.whole if i == self.n else self.heads[i // self.step - 1]

    def tail(self, i: int) -> tuple[int, int]:
        """Prefix value at length - i, i a multiple of the step or the length."""
        return self.whole if i == 0 else (0, 0) if i == self.n else self.tails[i // self.step - 1]

    def likeness(self, other: Fingerprint) -> float:
        """Share of the longer text's code points that lie in the common prefix, the common suffix, or between
        them in spans equal at equal offsets, as far as the shared grid shows; 1 only for equal texts."""
        if self.n == other.n and self.whole == other.whole:
            return 1.0
        short, step = min(self.n, other.n), max(self.step, other.step)
        places = [*range(0, short, step), *([short] if _has(self, other, short) else [])]
        low, high = 0, len(places) - 1
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if self.head(places[middle]) == other.head(places[middle]) else (low, middle - 1)
        prefix = places[low] if places else 0
        ends = [k for k in range(0, short, step) if k <= short - prefix]
        a, b = 0, len(ends) - 1
        while a < b:
            middle = (a + b + 1) // 2
            same = (_span(self.tail(ends[middle]), self.whole, max(other.n - self.n, 0))
                    == _span(other.tail(ends[middle]), other.whole, max(self.n - other.n, 0)))
            a, b = (middle, b) if same else (a, middle - 1)
        suffix = ends[a] if ends else 0
        between = 0
        for i, j in zip(places[low:], places[low + 1:]):
            if j <= short - suffix and _span(self.head(i), self.head(j), 0) == _span(other.head(i), other.head(j), 0):
                between += j - i
        return min(prefix + between + suffix, max(self.n, other.n) - 1) / max(self.n, other.n)


def _has(a: Fingerprint, b: Fingerprint, i: int) -> bool:
    """Whether both know the prefix value at i."""
    return all(i == x.n or i < x.n and i % x.step == 0 for x in (a, b))


def likeness(left: str | None, right: str | None) -> float | None:
    """Likeness, 0 to 1, of two fingerprint strings; null if one is missing."""
    return None if left is None or right is None else Fingerprint.parse(left).likeness(Fingerprint.parse(right))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", carry=()) -> DataFrame:
    """``id, *carry, n_chars, fingerprint`` of every row; a null text is an empty one. No shuffle."""
    def make():
        def work(texts: pa.Array):
            found = [Fingerprint.of(Prefix(t or "")) for t in texts.to_pylist()]
            return [f.n for f in found], [str(f) for f in found]
        return work
    return annotate(docs, make, "n_chars long, fingerprint string", id_col=id_col, text_col=text_col, carry=carry)


def common_prefixes(pairs: DataFrame, left: str, right: str, *, at: tuple[int, int] = (0, 0), name: str = "common") -> DataFrame:
    """``pairs`` with the length of the longest common extension of two text columns from positions ``at``.

    Null texts count as empty. Every other column is kept as it is; no shuffle.
    """
    if name in pairs.columns:
        raise ValueError(f"the input has a column {name}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(*(batch.column(c).to_pylist() for c in (left, right)))
            found = [common_extension(Prefix(a or ""), at[0], Prefix(b or ""), at[1]) for a, b in both]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], names=[*batch.schema.names, name])

    small_batches(pairs.sparkSession)
    return pairs.mapInArrow(run, T.StructType([*pairs.schema.fields, T.StructField(name, T.LongType())]))


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of a range in order, the next range's first as its last row -> results of all but that one."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    held = out = None

    def close(now, after):
        doc_id, text, prefix, own = now
        _, following, _, theirs = after
        cut = own.n - own.n // 4
        edited = text[:cut] + following[: own.n // 4]
        changed = Fingerprint.of(Prefix(edited, prefix, cut))
        return (doc_id, own.n, hashlib.sha256(edited.encode()).hexdigest(), str(own), str(changed),
                own.likeness(changed), own.likeness(theirs))

    def done():
        kinds = [kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(list(zip(*out)) or [()] * 7, kinds)], names=names)

    kind = None
    for batch in batches:
        kind, out = batch.schema.field("doc_id").type, []
        columns = [batch.column(c) for c in ("part", "guest", "doc_id", "text")]
        for k in range(batch.num_rows):  # one text at a time leaves Arrow's memory
            part, guest, doc_id, text = (c[k].as_py() for c in columns)
            prefix = Prefix(text)
            now = (doc_id, text, prefix, Fingerprint.of(prefix))
            if held is not None and held[0] == part:
                out.append(close(held[1], now))
            held = None if guest else (part, now)
        if out:
            yield done()


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its text with the last quarter taken from the next document.

    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``, one row per
    row of ``docs`` (doc_id, text). Next is the following row in ascending order of doc_id, nulls first,
    rows of one id in order of a 64-bit hash of their text; after the last comes the first, so a single
    row is its own next. Null texts are empty (length 0, likeness 1 to empty texts, 0 to others). Very long
    texts are hashed in blocks; a task holds two texts and one small Arrow batch. Repeated rows each give
    a row. An empty table gives an empty result; other columns are not read.
    """
    small_batches(docs.sparkSession, 64)
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("h"))
    order = ["doc_id", "h"]
    # ranges of the two numbers, as even as Spark's own sample makes them, and the first row of each
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slim = keyed.select(*order).repartitionByRange(ranges, *order).withColumn("p", F.spark_partition_id())
    first = cut_lineage(slim.groupBy("p").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id", "h")).alias("m")))
    bounds = [tuple(r["m"]) for r in first.orderBy("p").collect()]  # one row for each shuffle partition
    if not bounds:
        return docs.select("doc_id").limit(0).mapInArrow(_edited, _schema(docs))
    keys = [(k, i if k else 0, h) for k, i, h in bounds]

    @F.arrow_udf("array<int>")
    def parts(known: pa.Array, doc_id: pa.Array, h: pa.Array) -> pa.Array:
        """The range of a row; for the first row of a range also the one before it, negative."""
        out = []
        for k, i, hashed in zip(known.to_pylist(), doc_id.to_pylist(), h.to_pylist()):
            key = (k, i if k else 0, hashed)
            at = bisect_right(keys, key) - 1
            out.append([at + 1, -((at - 1) % len(keys)) - 1] if key == keys[at] else [at + 1])
        return pa.array(out, pa.list_(pa.int32()))

    dealt = keyed.withColumn("to", F.explode(parts(F.col("doc_id").isNotNull(), "doc_id", "h")))
    dealt = dealt.select(F.abs("to").alias("part"), (F.col("to") < 0).alias("guest"), "doc_id", "h", "text")
    return (dealt.repartitionById(len(keys), F.col("part") - 1).sortWithinPartitions("part", "guest", "doc_id", "h")
            .select("part", "guest", "doc_id", "text").mapInArrow(_edited, _schema(docs)))


def _schema(docs: DataFrame) -> str:
    return (f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, "
            "edited_fingerprint string, near_edited double, near_next double")
