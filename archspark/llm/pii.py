"""PII: base patterns plus information-theoretic sanitisation of terms that reveal them.

Base spans (email, ip, card, phone) are found by fixed patterns and are the protected
entities. Corpus co-occurrence then tells which other terms reveal an entity: with a context of
``reach`` words to either side of each entity, and counts of documents,

    PMI(e, t) = log2( n(e, t) * N / (n(e) * n(t)) )

is the information that term t discloses about entity e, and IC(e) = log2(N / n(e)) is all there
is to disclose. A term is disclosive if PMI >= ``share`` * IC(e) with at least ``support``
documents in which they stand together. A term that is disclosive for some entity is marked wherever
it stands, in every text, with the entity or without it. Terms are generalised to their class in the
sanitised text; entities are removed.

Only the pairs of an entity with the few words around it are counted, so the pair table grows with
the entities found and not with the words of the corpus; n(t) is then counted over all documents
for the terms of those pairs. A bit map of fixed size keeps other words from leaving a task; the
words that pass it are held against the terms themselves by a join.
Copies are no evidence: N and all counts are of distinct texts. Texts are never shuffled.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archspark.llm.common import annotate, small_batches
from archspark.session import cut_lineage

#: fixed patterns
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
KINDS = ("email", "ip", "card", "phone")
#: bits of the map of terms
BITS = 1 << 24
SPANS = "array<struct<start int, k int, end int>>"
WORD = re.compile(r"[^\W\d_]{3,}")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str):
    """Matches of the email pattern, found from each @ outwards, so long words cost linear time."""
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        m = DOMAIN.match(text, at)
        start = at
        if m:
            while start > done and text[start - 1] in LOCAL_CHARS:
                start -= 1
        if m and start < at:
            yield start, m.end()
            done = at = m.end()
        else:
            at += 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), sorted; leftmost non-overlapping per kind, failing matches dropped."""
    out = [(s, 0, e) for s, e in emails(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m.group())) <= 15]
    return sorted(out)


def contexts(text: str, spans: list[tuple[int, int, int]], reach: int) -> list[list[tuple[int, int, str]]]:
    """For each span the words (start, end, lower case) nearest to it, none of them inside any span."""
    out = []
    inside = lambda a, b: any(a < e and s < b for s, _, e in spans)
    for start, _, end in spans:
        lo, hi = max(0, start - 24 * reach), end + 24 * reach
        left = [(m.start(), m.end()) for m in WORD.finditer(text, lo, start)]
        right = [(m.start(), m.end()) for m in WORD.finditer(text, end, min(hi, len(text)))]
        # a word cut by the look-out's edge is not a word of the text
        left = [w for w in left if w[0] > lo or lo == 0][-reach:]
        right = [w for w in right if w[1] < hi or hi >= len(text)][:reach]
        out.append([(a, b, text[a:b].lower()) for a, b in left + right if not inside(a, b)])
    return out


def _bit(term: str) -> int:
    return xxhash.xxh64_intdigest(term) % BITS


def _digest(text: str) -> int:
    return int.from_bytes(xxhash.xxh64_digest(text), "big", signed=True)


def _bit_map(rows: DataFrame) -> np.ndarray:
    """BITS bits, set for the given terms (or digests); at most BITS / 64 rows reach the driver."""
    def run(batches):
        for batch in batches:
            at = [_bit(x) if isinstance(x, str) else x % BITS for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([b >> 6 for b in at], pa.int64()), pa.array([b & 63 for b in at], pa.int32())], names=["w", "b"])

    one = F.expr("bit_or(shiftleft(1L, b))").alias("m")
    out = np.zeros(BITS // 64, np.int64)
    for r in rows.mapInArrow(run, "w long, b int").groupBy("w").agg(one).collect():
        out[r["w"]] = r["m"]
    return out.view(np.uint64)


def _holds(bits: np.ndarray, at: int) -> bool:
    return bool(int(bits[at >> 6]) >> (at & 63) & 1)


class _Terms:
    """Words of texts -> the terms they are, if the bit map has them; remembers words."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.known = bits, {}

    def __getitem__(self, word: str) -> str | None:
        if word not in self.known:
            if len(self.known) > 500_000:
                self.known = {}
            term = word.lower()
            self.known[word] = term if _holds(self.bits, _bit(term)) else None
        return self.known[word]


def _term_counts(docs: DataFrame, terms: DataFrame, copied: DataFrame, text_col: str) -> DataFrame:
    """(term, nt): distinct texts that hold each of the given terms; ``copied``: digests of more than one row.

    A text outside the bit map of copied digests is there once and is counted in its task; the few others
    leave it as (digest, terms) and are counted once for each digest.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((_bit_map(terms), _bit_map(copied)))

    def run(batches):
        bits, more_rows = sent.value
        term_of, seen, done, many = _Terms(bits), Counter(), set(), []
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if not text:
                    continue
                digest = _digest(text)
                several = _holds(more_rows, digest % BITS)
                if several and digest in done:
                    continue
                held = {t for w in set(WORD.findall(text)) if (t := term_of[w]) is not None}
                if not several:
                    seen.update(held)
                elif held:
                    many.append((digest, list(held)))
                    if len(done) < 100_000:
                        done.add(digest)
            if many:
                yield _sums({}, many)
                many = []
            if len(seen) > 500_000:
                yield _sums(seen, [])
                seen = Counter()
        yield _sums(seen, [])

    parts = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "digest long, terms array<string>, n long")
    # a copy's terms are a function of its digest, so the first row of each digest stands for all
    once = parts.groupBy("digest", F.when(F.col("digest").isNull(), F.col("terms")[0]).alias("only")).agg(
        F.first("terms").alias("terms"), F.sum("n").alias("n"))
    counts = once.select(F.explode("terms").alias("term"), F.when(F.col("digest").isNull(), F.col("n")).otherwise(1).alias("n"))
    return counts.groupBy("term").agg(F.sum("n").alias("nt")).join(terms, "term", "left_semi")


def _sums(seen: dict[str, int], many: list[tuple[int, list[str]]]) -> pa.RecordBatch:
    """Counts of single terms (no digest), and the terms of texts that may have copies."""
    return pa.RecordBatch.from_arrays([
        pa.array([None] * len(seen) + [d for d, _ in many], pa.int64()),
        pa.array([[t] for t in seen] + [t for _, t in many], pa.list_(pa.string())),
        pa.array([*seen.values(), *(1 for _ in many)], pa.int64())], names=["digest", "terms", "n"])


def outside(text: str, spans: list[tuple[int, int, int]]):
    """Words (start, end, word) of the text between the spans."""
    at = 0
    for start, end in [*((s, e) for s, _, e in sorted(spans)), (len(text), len(text))]:
        if start > at:
            yield from ((m.start(), m.end(), m.group()) for m in WORD.finditer(text, at, start))
        at = max(at, end)


def _everywhere(docs: DataFrame, terms: DataFrame, text_col: str) -> DataFrame:
    """(digest, more): the spans of all given terms in all texts that hold one, once for each distinct text."""
    sent = docs.sparkSession.sparkContext.broadcast(_bit_map(terms))

    def run(batches):
        term_of, done = _Terms(sent.value), set()
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                if not text or all(term_of[w] is None for w in set(WORD.findall(text))):
                    continue
                digest = _digest(text)
                if digest in done:
                    continue
                if len(done) < 100_000:
                    done.add(digest)
                places: dict[str, list] = {}
                for a, b, w in outside(text, base_spans(text)):
                    if (t := term_of[w]) is not None:
                        places.setdefault(t, []).append({"start": a, "k": 4, "end": b})
                rows += [(digest, t, at) for t, at in places.items()]
            cols = list(zip(*rows)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], spots)], names=["digest", "term", "at"])

    spots = pa.list_(pa.struct([("start", pa.int32()), ("k", pa.int32()), ("end", pa.int32())]))
    found = docs.select(F.col(text_col).cast("string")).mapInArrow(run, f"digest long, term string, at {SPANS}")
    once = found.groupBy("digest", "term").agg(F.first("at").alias("at")).join(terms, "term", "left_semi")
    return once.groupBy("digest").agg(F.flatten(F.collect_list("at")).alias("more"))  # places of one text


def _found(docs: DataFrame, reach: int, id_col: str, text_col: str) -> DataFrame:
    """id, digest of the text, base spans, and the words near each entity; texts are left behind."""
    def make():
        def work(texts):
            digest, base, near = [], [], []
            for text in texts.to_pylist():
                spans = base_spans(text) if text else []
                digest.append(_digest(text) if text else None)
                base.append([{"start": s, "k": k, "end": e} for s, k, e in spans])
                near.append([{"entity": f"{KINDS[k]}:{text[s:e]}", "words": [{"term": w, "start": a, "end": b} for a, b, w in around]}
                             for (s, k, e), around in zip(spans, contexts(text, spans, reach) if spans else [])])
            return digest, base, near

        return work

    schema = ("digest long, base array<struct<start int, k int, end int>>, "
              "near array<struct<entity string, words array<struct<term string, start int, end int>>>>")
    return cut_lineage(annotate(docs, make, schema, id_col=id_col, text_col=text_col))


def disclosive_terms(docs: DataFrame, near: DataFrame, texts: DataFrame, *, share: float, support: int, text_col: str) -> DataFrame:
    """(entity, term, pmi, ic) of the terms that reveal an entity; ``near`` (digest, entity, words), ``texts`` (digest, copies)."""
    n_docs = float(max(texts.count(), 1))
    entities = near.groupBy("entity").agg(F.countDistinct("digest").alias("ne"))
    pairs = near.select("digest", "entity", F.explode("words.term").alias("term"))
    together = cut_lineage(pairs.groupBy("entity", "term").agg(F.countDistinct("digest").alias("net")).filter(F.col("net") >= support))
    nt = _term_counts(docs, together.select("term").distinct(), texts.filter("copies > 1").select("digest"), text_col)
    pmi = F.log2(F.col("net") * n_docs / (F.col("ne") * F.greatest("nt", "net")))
    ic = F.log2(n_docs / F.col("ne"))
    scored = together.join(entities, "entity").join(nt, "term").select("entity", "term", pmi.alias("pmi"), ic.alias("ic"))
    return scored.filter((F.col("pmi") > 0) & (F.col("pmi") >= share * F.col("ic")))


def find_personal_data(docs: DataFrame, *, reach: int = 4, share: float = 0.5, support: int = 2,
                       id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, base and spans (arrays of start, k, end) for every row of ``docs``.

    k counts the kinds email, ip, card, phone; 4 is a disclosive term, at every place where it stands
    outside the base spans. Offsets are code points, ends exclusive. Null and empty texts have no spans; repeated rows each get their row, as one
    text in the statistics; an empty table gives an empty result. Other columns are not read.
    """
    found = _found(docs, reach, id_col, text_col)
    texts = cut_lineage(found.filter("digest IS NOT NULL").groupBy("digest").agg(F.count("*").alias("copies")))
    some = found.filter(F.size("base") > 0)
    near = some.select("digest", F.explode("near").alias("x")).select("digest", "x.entity", "x.words").distinct()
    terms = disclosive_terms(docs, near, texts, share=share, support=support, text_col=text_col)
    # stored, so that the join deals it anew and can split the rows of a text with many copies
    more = cut_lineage(_everywhere(docs, cut_lineage(terms.select("term").distinct()), text_col))
    joined = found.filter("digest IS NOT NULL").drop("near").join(more, "digest", "left")
    spans = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(SPANS))))
    none = found.filter("digest IS NULL").select(id_col, "base", F.col("base").alias("spans"))
    return joined.select(id_col, "base", spans.cast(SPANS).alias("spans")).unionByName(none)


def sanitise(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text without its entities (``[email]`` ...) and with disclosive terms generalised to ``[term]``."""
    out, at = [], 0
    for start, k, end in sorted(spans):
        if start >= at:
            out += [text[at:start], f"[{(*KINDS, 'term')[k]}]"]
            at = end
    return "".join(out) + text[at:]


def sanitised(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """id and sanitised text of the rows with spans (others stay as they are); ids must be unique here."""
    spans = find_personal_data(docs, id_col=id_col, text_col=text_col, **how).filter(F.size("spans") > 0)
    rows = docs.select(id_col, F.col(text_col).alias("__t")).join(spans, id_col)

    def run(batches):
        for batch in batches:
            ids, texts, found = (batch.column(i) for i in range(3))
            out = [sanitise(t, [(x["start"], x["k"], x["end"]) for x in s]) for t, s in zip(texts.to_pylist(), found.to_pylist())]
            yield pa.RecordBatch.from_arrays([ids, pa.array(out, pa.string())], names=[id_col, "text"])

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.select(id_col, "__t", "spans").mapInArrow(run, f"`{id_col}` {kind}, text string")
