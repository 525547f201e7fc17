"""Toxicity by class-conditional Kneser-Ney bigram models.

Two interpolated Kneser-Ney models, one of toxic and one of ordinary texts, are learnt from a
bounded sample of labelled rows (``sample_rows`` rows and ``sample_bytes`` bytes of text for each
class). Both back off to the same lowest level: the continuation counts of the whole corpus, labelled or not.

    P(w|v) = max(n(vw) - D, 0) / n(v) + g(v) * P(w)
    P(w)   = max(k(w) - D, 0) / K     + g    * S(w)

n counts the class's texts with a bigram, k a word's distinct left neighbours in the class, S the shared
level: a word's distinct left neighbours in the corpus, of all its pairs. A word that neither class
has seen gets S times the class's backoff mass from both, so its own S cancels in the ratio. An expression too rare to tell the classes apart (the two shares of counts that are its differ
by less than ``z`` standard errors) gives all its mass to the backoff in both models, so
it gets the same probability from either; with ``z`` = 0 every expression counts, smoothed by the discount
and the backoff alone, which is tried first. A text's score is the logistic of its log-likelihood ratio
per word; slope, offset and z are fitted on labelled rows that the models have not seen.

The corpus pass sends, from each task, its distinct pairs of neighbouring words as hashes; each bucket of
hashes is made distinct in one place and counted, so what is gathered grows with the corpus, and so does
the number of buckets, a bucket standing for about ``BUCKET_BYTES`` of text. The model that is broadcast
is bounded by the sample.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archspark.llm.common import annotate, memory, small_batches
from archspark.session import cut_lineage

#: ASCII letters in lower case and bytes of other characters make words, all else parts them
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
FOLDS = 5


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(LETTERS).split()


def _discount(counts: np.ndarray) -> float:
    one, two = int((counts == 1).sum()), int((counts == 2).sum())
    return one / (one + 2 * two) if one and two else 0.5


class Model:
    """Log-likelihood ratios: ``unigram[w]``, ``left[v]`` and, for seen bigrams, ``bigram``."""

    def __init__(self, vocab: list[bytes]):
        self.vocab = {w: i + 1 for i, w in enumerate(vocab)}  # 0: words of neither class
        self.slope, self.offset = 1.0, 0.0

    def ids(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Word ids of all texts, one after the other, and the number of words of each."""
        get, end, parts = self.vocab.get, np.zeros(1, np.int32), []
        for t in texts:  # the end of the text counts as an unknown word, so an empty text has a ratio too
            w = words_of(t)
            parts += [np.fromiter(map(get, w, repeat(0)), np.int32, len(w)), end]
        n = np.array([len(p) + 1 for p in parts[::2]], np.int64)
        return np.concatenate(parts) if parts else end[:0], n

    def keys(self, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(left neighbour, bigram key) of each word; a text's first word has neighbour size."""
        size = len(self.vocab) + 1
        left = np.empty(len(ids), np.int64)
        left[1:] = ids[:-1]
        left[np.cumsum(n) - n] = size
        return left, left * size + ids

    def gather(self, texts: dict[int, list[str]], shared: np.ndarray) -> None:
        """Counts of the class samples (0, 1); shared: the corpus's continuation counts of each id, 0 holding all other words."""
        size = len(self.vocab) + 1
        self.base = (shared + 0.5) / (shared.sum() + 0.5 * size)
        self.counts = {}
        for c in (0, 1):
            ids, n = self.ids(texts[c])
            key = self.keys(ids, n)[1]
            doc = np.repeat(np.arange(len(n)), n)
            many = max(1, len(n))
            self.counts[c] = np.unique(np.unique(key * many + doc) // many, return_counts=True)
        self.seen = np.union1d(self.counts[0][0], self.counts[1][0])

    @staticmethod
    def telling(a: np.ndarray, b: np.ndarray, z: float) -> np.ndarray:
        """True where the shares that expressions have of all counts a and of all b differ by z standard errors."""
        na, nb = max(1.0, a.sum()), max(1.0, b.sum())
        both = (a + b) / (na + nb)
        error = np.sqrt(np.maximum(both * (1 - both), 1e-12) * (1 / na + 1 / nb))
        return np.abs(a / na - b / nb) >= z * error

    def fit(self, z: float) -> None:
        size = len(self.vocab) + 1
        own = []
        for c in (0, 1):
            own.append(np.zeros(len(self.seen), np.float32))
            own[c][np.searchsorted(self.seen, self.counts[c][0])] = self.counts[c][1]
        words = self.telling(*(np.bincount(self.seen % size, weights=own[c], minlength=size) for c in (0, 1)), z)
        pairs = np.flatnonzero(self.telling(*own, z))
        v, w = self.seen[pairs] // size, self.seen[pairs] % size
        logs = []
        for c in (0, 1):
            key, n = self.counts[c]
            k = np.bincount(key % size, minlength=size)
            kept = np.where(words, np.maximum(k - _discount(k[k > 0]), 0), 0.0)
            total = max(1, int(k.sum()))
            word = kept / total + (1 - kept.sum() / total) * self.base
            held = np.maximum(own[c][pairs] - _discount(n), 0)
            left = np.maximum(np.bincount(key // size, weights=n, minlength=size + 1), 1)
            back = 1 - np.bincount(v, weights=held, minlength=size + 1) / left
            logs.append((np.log(word), np.log(np.maximum(back, 1e-9)), np.log(held / left[v] + np.maximum(back[v], 1e-9) * word[w])))
        self.unigram, self.left, self.bigram = (np.float32(b - a) for a, b in zip(*logs))
        self.known = self.seen[pairs]  # of the others the two models say the same up to their backoffs

    def mean_ratio(self, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Log-likelihood ratio per word of each text."""
        left, key = self.keys(ids, n)
        r = self.unigram[ids] + self.left[left]
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, key), len(self.known) - 1)
            r = np.where(self.known[at] == key, self.bigram[at], r)
        return np.bincount(np.repeat(np.arange(len(n)), n), weights=r, minlength=len(n)) / n

    def score(self, texts: list[str | None]) -> np.ndarray:
        z = self.slope * self.mean_ratio(*self.ids(texts)) + self.offset
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))

    def choose(self, texts: list[str], labels: list[int], grid: tuple[float, ...] = (0.0, 1.0, 2.0, 4.0, 6.0, 8.0, 10.0, 12.0)) -> None:
        """Fit z, slope and offset on labelled texts the models have not seen (the first z of equals).

        Slope and offset are those of classes that weigh the same: 0.5 is where a text speaks for neither, however
        rare toxic texts are among the labels; by their odds a text needed much more evidence, and doubtful ones all passed.
        """
        y, (ids, n) = np.array(labels, np.float64), self.ids(texts)
        best = None
        for z in (*grid, None):
            self.fit(best[1] if z is None else z)
            loss = self.calibrate(self.mean_ratio(ids, n), y, even=z is None)
            if best is None or loss < best[0]:
                best = loss, z
        for name in ("seen", "counts", "base"):
            delattr(self, name)

    def calibrate(self, x: np.ndarray, y: np.ndarray, rounds: int = 50, even: bool = False) -> float:
        """Newton steps of a logistic regression with a weak pull to zero; returns its mean loss. ``even``: both classes weigh the same."""
        if len(x) == 0 or y.min() == y.max():
            self.slope, self.offset = 1.0, -1.0
            return 0.0
        a = np.column_stack([x, np.ones(len(x))])
        b = np.zeros(2)
        weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())) if even else np.ones(len(x))
        pull = np.diag([1e-4, 1e-6])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(a @ b, -50, 50)))
            step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + pull, a.T @ (weight * (y - p)) - pull @ b)
            b = b + np.clip(step, -10, 10)
            if np.abs(step).max() < 1e-8:
                break
        self.slope, self.offset = float(b[0]), float(b[1])
        z = np.clip(a @ b, -50, 50)
        return float(np.mean(weight * (np.log1p(np.exp(-z)) + (1 - y) * z)))


def folds(id_col: str):
    """crc32 of the id as text, mod FOLDS; a null id is in fold 0, which is never learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS, F.lit(0)).cast("int")


def sample(docs: DataFrame, labels: DataFrame, *, sample_rows: int, sample_bytes: int, id_col: str, text_col: str) -> list:
    """(part, toxic, text): parts 0 and 1 are the class samples, part 2 the rows for the fit.

    Rows are taken in the order of a hash of the id up to both bounds; fold 0 gives none. A row of more
    than a tenth of ``sample_bytes`` comes after all shorter ones, so it cannot keep them out.
    """
    known = labels.filter(F.col(id_col).isNotNull() & F.col("toxic").isin(0, 1)).groupBy(id_col).agg(F.max("toxic").cast("int").alias("toxic"))
    part = F.when(folds(id_col) == FOLDS - 1, F.lit(2)).otherwise(F.col("toxic"))
    known = known.filter(folds(id_col) > 0).select(id_col, "toxic", part.alias("part"), F.xxhash64(id_col).alias("at"))
    picked = None
    for p in range(3):
        some = known.filter(F.col("part") == p).orderBy("at", id_col).limit(sample_rows)
        picked = some if picked is None else picked.unionAll(some)
    picked = cut_lineage(picked)  # at most 3 * sample_rows ids: small enough to broadcast
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    sizes = docs.select(id_col, F.octet_length(text).alias("bytes")).join(F.broadcast(picked), id_col)
    order = Window.partitionBy("part").orderBy(F.col("bytes") > sample_bytes // 10, "at", id_col, "bytes")
    kept = cut_lineage(sizes.withColumn("sum", F.sum("bytes").over(order)).filter(F.col("sum") <= sample_bytes).select(id_col, "toxic", "part").distinct())
    rows = docs.select(id_col, text.alias("text")).join(F.broadcast(kept), id_col).select("part", "toxic", "text")
    return sorted(zip(*(c.to_pylist() for c in rows.toArrow().columns)))


class _Codes(dict):
    """Word -> its id in the model, or a 64-bit hash with the top bit set; remembered."""

    def __init__(self, vocab: dict[bytes, int]):
        super().__init__(vocab)
        self.vocab = vocab

    def __missing__(self, word: bytes) -> int:
        if len(self) > len(self.vocab) + 300_000:
            self.clear()
            self.update(self.vocab)
        code = self[word] = xxhash.xxh64_intdigest(word) | 1 << 63
        return code


#: text of a bucket of pairs; buckets are leading bits of the hash, 8 at least, as the first byte is not sent, and 20 at most
BUCKET_BYTES = 1 << 21


def _packed(key: np.ndarray, word: np.ndarray) -> bytes:
    """Hashes without their first byte, then the steps of the sorted words by planes of bytes, which compress well."""
    order = np.argsort(word, kind="stable")
    steps = np.diff(word[order], prepend=np.int32(0)).astype("<i4")
    return key[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7].tobytes() + steps.view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(blob) // 11
    raw = np.frombuffer(blob, np.uint8)
    key = np.zeros((n, 8), np.uint8)
    key[:, :7] = raw[: 7 * n].reshape(n, 7)
    return key.view("<u8")[:, 0], np.cumsum(np.ascontiguousarray(raw[7 * n :].reshape(4, n).T).view("<i4")[:, 0])


class _Pairs:
    """Distinct (key, word) pairs in two fixed arrays, sorted by key where asked; one key has one word."""

    def __init__(self, room: int):
        self.keys, self.words, self.n = np.empty(room, np.uint64), np.empty(room, np.int32), 0

    def add(self, keys: np.ndarray, words: np.ndarray) -> None:
        self.keys[self.n: self.n + len(keys)], self.words[self.n: self.n + len(keys)] = keys, words
        self.n += len(keys)

    def distinct(self) -> int:
        """Sort, drop repeats, both within the arrays; the number left."""
        order = np.argsort(self.keys[: self.n])
        self.keys[: self.n] = self.keys[order]
        self.words[: self.n] = self.words[order]
        del order
        first = np.ones(self.n, bool)
        np.not_equal(self.keys[1: self.n], self.keys[: max(self.n - 1, 0)], out=first[1:])
        left = int(first.sum())
        self.keys[:left], self.words[:left] = self.keys[: self.n][first], self.words[: self.n][first]
        self.n = left
        return left


def shared_counts(docs: DataFrame, vocab: dict[bytes, int], text_col: str, *, most: int = 1 << 21) -> np.ndarray:
    """Distinct left neighbours in the whole corpus of each word of the model; at 0 the sum of those of all others.

    A text's start is a neighbour too. Tasks send their distinct pairs, by hash, once ``most`` are held; each
    bucket of hashes is made distinct in one place.
    """
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    bits = min(20, max(8, int(size // BUCKET_BYTES).bit_length()))
    sent = docs.sparkSession.sparkContext.broadcast(vocab)

    def pairs(batches):
        memory("toxicity")
        codes, held = _Codes(sent.value), _Pairs(2 * most)

        def rows():
            keys, words = held.keys[: held.n], held.words[: held.n]
            first = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
            cuts = np.concatenate(([0], first, [held.n]))
            full = np.flatnonzero(np.diff(cuts))
            found = [_packed(keys[cuts[b]: cuts[b + 1]], words[cuts[b]: cuts[b + 1]]) for b in full]
            held.n = 0
            return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(found, pa.binary())], names=["bucket", "pairs"])

        for batch in batches:
            for text in batch.column(0):
                w = words_of(text.as_py())
                for at in range(0, len(w), most):  # a very long text in pieces, each with the word before it
                    piece = w[max(at - 1, 0): at + most]
                    code = np.fromiter(map(codes.__getitem__, piece), np.uint64, len(piece))
                    left = np.zeros_like(code)
                    left[1:] = code[:-1]
                    key = left * np.uint64(0x9E3779B97F4A7C15) ^ code * np.uint64(0xC2B2AE3D27D4EB4F)
                    key = (key ^ key >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
                    own = slice(1 if at else 0, None)
                    if held.n + len(piece) > 2 * most and held.distinct() > most:
                        yield rows()
                    held.add((key ^ key >> np.uint64(32))[own], np.where(code >> np.uint64(63) == 0, code, 0).astype(np.int32)[own])
        if held.n:
            held.distinct()
            yield rows()

    def counts(batches):
        total, now, keys, words = np.zeros(len(sent.value) + 1, np.int64), None, [], []

        def close():
            held = _Pairs(sum(map(len, keys)))
            for k, w in zip(keys, words):
                held.add(k, w)
            held.distinct()
            total[:] += np.bincount(held.words[: held.n], minlength=len(total))
            keys.clear()
            words.clear()

        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                if bucket != now and keys:
                    close()
                now = bucket
                key, word = _unpacked(blob.as_py())
                keys.append(key)
                words.append(word)
        if keys:
            close()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["word", "n"])

    small_batches(docs.sparkSession)
    dealt = docs.select(F.col(text_col).cast("string")).mapInArrow(pairs, "bucket int, pairs binary").repartition("bucket").sortWithinPartitions("bucket")
    found = dealt.mapInArrow(counts, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()  # a row for each word of the bounded model
    sent.unpersist()
    out = np.zeros(len(vocab) + 1)
    out[found["word"].to_numpy()] = found["n"].to_numpy()
    return out


def learn(docs: DataFrame, labels: DataFrame, *, sample_rows: int = 3000, sample_bytes: int = 24_000_000,
          id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model; with no rows of one class in the sample it gives every text a low score."""
    rows = sample(docs, labels, sample_rows=sample_rows, sample_bytes=sample_bytes, id_col=id_col, text_col=text_col)
    texts = {p: [t for q, _, t in rows if q == p] for p in range(3)}
    model = Model(sorted({w for p in (0, 1) for t in texts[p] for w in words_of(t)}))
    model.gather(texts, shared_counts(docs, model.vocab, text_col))
    model.choose(texts[2], [y for q, y, _ in rows if q == 2])
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                   carry: tuple[str, ...] = (), **how) -> DataFrame:
    """id, carried columns, held_out (fold 0), score (0 to 1) and predicted (score >= 0.5) for every row of ``docs``.

    Null and empty texts are scored like a text of one unknown word; repeated rows each get their
    row; labels that are null or neither 0 nor 1 are not used, of repeated labels the largest is;
    an empty table gives an empty result. Other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, id_col=id_col, text_col=text_col, **how))

    def make():
        def work(texts):
            p = sent.value.score(texts.to_pylist())
            return p, (p >= 0.5).astype("int32")

        return work

    scored = annotate(docs, make, "score double, predicted int", id_col=id_col, text_col=text_col, carry=carry)
    return scored.withColumn("held_out", folds(id_col) == 0)
