"""Benchmark decontamination: a prefix-filtered containment join of documents and item windows.

A window (``window`` consecutive words of an item; all words of a shorter item) is a set of word
shingles. Full containment needs every one of them, so a prefix of one shingle is enough: the
window's rarest. Rarity is measured over the whole corpus first: each task counts the benchmark's
shingles in its documents, Spark sums the counts. Then a document position holding a window's
prefix shingle gives a candidate place; the position bound (the window must start and end inside
the document) and the length bound drop it or the words decide: the window must occur word for
word.

The benchmark side goes to the tasks in blocks of at most ``block_rows`` (window, item) rows,
spread by hash; several blocks are several narrow passes one after the other, so any benchmark
size works with the same bound on memory. Documents are never shuffled; hot passages cost
only their own matches.
"""

from __future__ import annotations

import math
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from archspark.llm.common import small_batches

#: bytes to themselves in lower case if they make words, else to a space
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SHINGLE = 5
_BASE = 0x9E3779B97F4A7C15


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_BYTES).split()


def item_windows(items: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """(words, item): each distinct window of each item; items without words have none."""
    def run(batches):
        for batch in batches:
            pairs = set()
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = words_of(text)
                pairs |= {(b" ".join(w[i : i + window]), item) for i in range(max(1, len(w) - window + 1) if w else 0)}
            yield pa.RecordBatch.from_arrays([pa.array([p[0].decode() for p in pairs], pa.string()),
                                              pa.array([p[1] for p in pairs], pa.string())], names=["words", "item"])

    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, "words string, item string").distinct()


def _codes(ids: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k ids from each place on; verified by comparing ids, so collisions are harmless."""
    out = np.zeros(max(0, len(ids) - k + 1), np.uint64)
    wide = ids.astype(np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = (out + wide[i : len(ids) - k + 1 + i]) * np.uint64(_BASE)
            out ^= out >> np.uint64(29)
    return out


class Block:
    """A bounded part of the windows, as arrays: vocabulary, window ids, shingles, prefixes."""

    def __init__(self, rows: list[tuple[str, str]]):
        windows: dict[str, list[str]] = {}
        for words, item in rows:
            windows.setdefault(words, []).append(item)
        split = [w.encode().split(b" ") for w in windows]
        self.vocab = {w: i + 1 for i, w in enumerate(dict.fromkeys(x for ws in split for x in ws))}  # 0: any other word
        self.length = np.array([len(w) for w in split], np.int64)
        self.words = np.zeros((len(split), int(self.length.max(initial=0))), np.int32)
        for i, ws in enumerate(split):
            self.words[i, : len(ws)] = [self.vocab[x] for x in ws]
        self.items = sorted({i for v in windows.values() for i in v})
        at = {x: i for i, x in enumerate(self.items)}
        self.item_of = [np.array([at[i] for i in v], np.int64) for v in windows.values()]
        self.sizes = sorted({min(SHINGLE, int(n)) for n in self.length})
        self.shingles = {k: np.unique(np.concatenate([_codes(self.words[i, :n], k) for i, n in enumerate(self.length) if min(SHINGLE, n) == k]))
                         for k in self.sizes}
        self.prefix: dict[int, tuple] = {}

    def ids(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Word ids of the documents one after the other, each followed by a 0; their starts."""
        n = np.array([len(d) + 1 for d in docs], np.int64)
        starts = np.concatenate(([0], np.cumsum(n)))
        ids = np.zeros(int(starts[-1]), np.int32)
        get = self.vocab.get
        for a, d in zip(starts.tolist(), docs):
            ids[a : a + len(d)] = np.fromiter(map(get, d, repeat(0)), np.int32, len(d))
        return ids, starts

    def places(self, ids: np.ndarray, k: int) -> np.ndarray:
        """Places where k words of the vocabulary stand in a row."""
        known = ids > 0
        run = known[: len(ids) - k + 1].copy() if len(ids) >= k else np.zeros(0, bool)
        for i in range(1, k):
            run &= known[i : len(ids) - k + 1 + i]
        return np.flatnonzero(run)

    def found(self, ids: np.ndarray, k: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, row of ``table``) for the places whose shingle code is in the sorted table."""
        at = self.places(ids, k)
        if not len(at) or not len(table):
            return at[:0], at[:0]
        near = ids[np.add.outer(at, np.arange(k))]
        code = np.zeros(len(at), np.uint64)
        with np.errstate(over="ignore"):
            for i in range(k):
                code = (code + near[:, i].astype(np.uint64)) * np.uint64(_BASE)
                code ^= code >> np.uint64(29)
        row = np.minimum(np.searchsorted(table, code), len(table) - 1)
        hit = table[row] == code
        return at[hit], row[hit]

    def order(self, count: dict[int, dict[int, int]]) -> None:
        """Choose each window's prefix: its rarest shingle, the first of equals."""
        for k in self.sizes:
            table = self.shingles[k]
            freq = np.array([count.get(k, {}).get(int(h.astype(np.int64)), 0) for h in table], np.int64)
            chosen, offset, which = [], [], []
            for w in np.flatnonzero(np.minimum(self.length, SHINGLE) == k):
                codes = _codes(self.words[w, : self.length[w]], k)
                o = int(np.argmin(freq[np.searchsorted(table, codes)]))
                chosen.append(codes[o])
                offset.append(o)
                which.append(w)
            by = np.argsort(np.array(chosen, np.uint64), kind="stable")
            keys, first = np.unique(np.array(chosen, np.uint64)[by], return_index=True)
            self.prefix[k] = (keys, np.concatenate((first, [len(by)])), np.array(which, np.int64)[by], np.array(offset, np.int64)[by])

    def occurrences(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, window) of every occurrence of a window in the documents."""
        place, window = [], []
        for k, (keys, first, which, offset) in self.prefix.items():
            at, row = self.found(ids, k, keys)
            n = first[row + 1] - first[row]
            at = np.repeat(at, n)
            entry = np.repeat(first[row], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            w = which[entry]
            begin = at - offset[entry]
            doc = np.searchsorted(starts, at, "right") - 1
            fits = (begin >= starts[doc]) & (begin + self.length[w] < starts[doc + 1])  # position and length bounds
            begin, w = begin[fits], w[fits]
            same = np.ones(len(begin), bool)
            for i in range(self.words.shape[1]):
                here = i < self.length[w]
                same &= ~here | (ids[np.minimum(begin + i, len(ids) - 1)] == self.words[w, i])
            place.append(begin[same])
            window.append(w[same])
        return (np.concatenate(place), np.concatenate(window)) if place else (np.zeros(0, np.int64),) * 2


def shingle_counts(docs: DataFrame, block, text_col: str) -> DataFrame:
    """(k, shingle, n): how often each shingle of the block occurs in the corpus."""
    def run(batches):
        b = block.value
        total = {k: np.zeros(len(b.shingles[k]), np.int64) for k in b.sizes}
        for batch in batches:
            ids, _ = b.ids([words_of(t) for t in batch.column(0).to_pylist()])
            for k in b.sizes:
                total[k] += np.bincount(b.found(ids, k, b.shingles[k])[1], minlength=len(total[k]))
        for k, n in total.items():
            seen = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), k, np.int32)), pa.array(b.shingles[k][seen].view(np.int64)),
                                              pa.array(n[seen])], names=["k", "shingle", "n"])

    parts = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "k int, shingle long, n long")
    return parts.groupBy("k", "shingle").agg(F.sum("n").alias("n"))


def contained_windows(docs: DataFrame, items: DataFrame, *, window: int = 10, block_rows: int = 200_000,
                      id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
                      carry: tuple[str, ...] = ()) -> DataFrame:
    """id, carried columns, n_words, n_hit and items (sorted ids) for every row of ``docs``.

    n_hit counts words inside any occurrence of a window; items lists, as strings, the items with
    an occurring window. Null and empty texts have no words; items without words have no window; a
    null item id is listed as the empty string; equal items share their windows; repeated rows
    each get their row; an empty table of either side gives no hits. Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    windows = item_windows(items, window, item_id, item_text).persist()
    n_blocks = max(1, math.ceil(windows.count() / block_rows))
    part = F.pmod(F.xxhash64("words", "item"), F.lit(n_blocks))
    blocks = []
    for i in range(n_blocks):  # a block's rows are bounded by block_rows, up to the spread of the hash
        block = Block([tuple(r) for r in windows.filter(part == i).collect()])
        sent = spark.sparkContext.broadcast(block)
        count: dict[int, dict[int, int]] = {}
        for r in shingle_counts(docs, sent, text_col).collect():  # as many rows as the block has shingles, at most
            count.setdefault(r["k"], {})[r["shingle"]] = r["n"]
        block.order(count)
        sent.unpersist()
        blocks.append(spark.sparkContext.broadcast(block))
    windows.unpersist()
    kept = [c for c in carry if c not in (id_col, text_col)]
    rows = docs.select(id_col, *kept, F.col(text_col).cast("string").alias("__words"),
                       F.lit(None).cast("binary").alias("__hit"), F.array().cast("array<string>").alias("__items"))
    for block in blocks:
        rows = _pass(rows, block)
    text = [F.col("__words").alias(text_col)] if text_col in carry else []
    return rows.select(id_col, *kept, *text, F.col("__n").alias("n_words"), F.col("__h").alias("n_hit"), F.col("__items").alias("items"))


def _pass(rows: DataFrame, block) -> DataFrame:
    """One narrow pass: adds the block's hits to each document's hit bits and items."""
    keep = [c for c in rows.columns if c not in ("__words", "__hit", "__items", "__n", "__h")]
    schema = T.StructType([*(rows.schema[c] for c in keep), T.StructField("__words", T.StringType()), T.StructField("__hit", T.BinaryType()),
                           T.StructField("__items", T.ArrayType(T.StringType())), T.StructField("__n", T.LongType()), T.StructField("__h", T.LongType())])
    names = schema.fieldNames()

    def run(batches):
        b = block.value
        for batch in batches:
            if not batch.num_rows:
                continue
            at = len(keep)
            texts = batch.column(at)
            docs = [words_of(t) for t in texts.to_pylist()]
            ids, starts = b.ids(docs)
            place, window = b.occurrences(ids, starts)
            edge = np.zeros(len(ids) + 1, np.int64)
            np.add.at(edge, place, 1)
            np.add.at(edge, place + b.length[window], -1)
            hit = np.cumsum(edge[:-1]) > 0
            doc = np.searchsorted(starts, place, "right") - 1
            items: dict[int, set] = {}
            for d, w in set(zip(doc.tolist(), window.tolist())):
                items.setdefault(d, set()).update(b.item_of[w].tolist())
            n_hit, bits, found = [], [], []
            for d, (a, z) in enumerate(zip(starts[:-1].tolist(), (starts[1:] - 1).tolist())):
                before, own = batch.column(at + 1)[d].as_py(), hit[a:z]
                if before is not None:
                    own = own | np.unpackbits(np.frombuffer(before, np.uint8), count=z - a).astype(bool)
                n_hit.append(int(own.sum()))
                bits.append(np.packbits(own).tobytes() if n_hit[-1] else None)
                found.append(sorted({*batch.column(at + 2)[d].as_py(), *(b.items[i] for i in items.get(d, ()))}))
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], texts, pa.array(bits, pa.binary()), pa.array(found, pa.list_(pa.string())),
                                              pa.array([len(d) for d in docs], pa.int64()), pa.array(n_hit, pa.int64())], names=names)

    return rows.select(*keep, "__words", "__hit", "__items").mapInArrow(run, schema)
