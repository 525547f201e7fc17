"""Token-id output: encode, write range-coded blocks, read them back.

Documents are dealt by ranges of their id into parts of about ``part_bytes`` of text, sorted, and
tokenised in that order; each document ends with ``end_id``. Whole documents fill blocks of at most
``BLOCK_IDS`` ids, a longer document takes several. A row of the store is a block: its part and number,
its documents (id, place of its first id in the part, number of ids here, whether it has several
pieces), the coded payload, and the CRC-32 of its ids. Spark writes the rows as Parquet in
the folder given (by default one of its own below the checkpoint folder that all executors
share), so a part is there as a whole or not at all, whatever happens to an executor.

Reading decodes many blocks at once, checks every checksum, and puts long documents' CRC-32s together
from those of their pieces; ids themselves are never gathered.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from operator import itemgetter
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import WhitespaceSplit

from archspark.llm import range_coder
from archspark.llm.common import memory, small_batches
from archspark.llm.token_counts import WordLengths, drops_space, load
from archspark.session import cut_lineage, ensure_checkpoint_dir

LANES = 2048
#: parts of words in a line for the merge model
LINE = 256

#: lower-case words with the marks behind them, one a line: the pre-tokeniser parts just these two; anything else comes third
PLAIN = re.compile("^([a-z\u00df-\u00f6\u00f8-\u00ff]*)([].,!*$&%#|;:?()\"[{}/+=~^@_-]*)(.*)$", re.MULTILINE)

#: a capital before a character that may compose with it; all marks that do are of U+0300 to U+037F (lead bytes CC and CD)
MARKED = re.compile(rb"[A-Z][\x80-\xff]").search

#: texts of which not every word is lowered
ODD = "<\\||[\u0300-\u037f]"


def _byte_level() -> dict[int, str]:
    """The characters that byte-level models use for bytes: printable ones for themselves, then from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordIds(WordLengths):
    """Ids of texts by their words, for tokenizers that drop white space (see token_counts).

    With ``lower`` (the tokenizer lowers case itself and has the usual letter pattern) words are lowered first, and the letters
    and marks of plain words go to the library's merge model directly, past the normaliser and pre-tokeniser, which leave them
    as they are: many at once, as a line of which each blank ends a word, and each of them once until ``most`` are known.
    """

    BYTES = _byte_level()

    def __init__(self, encoder, batch_bytes: int = 262_144, most: int = 300_000, longest: int = 64, lower: bool = False):
        super().__init__(encoder, batch_bytes, most, longest)
        self.lower = lower
        self.older: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {"": b""}
        if lower:
            self.line = Tokenizer(encoder.model)
            self.line.pre_tokenizer = WhitespaceSplit()
            suffix = getattr(encoder.model, "end_of_word_suffix", None) or ""
            self.ends = np.zeros(encoder.get_vocab_size(), bool)
            self.ends[[i for w, i in encoder.get_vocab().items() if suffix and w.endswith(suffix)]] = True

    @staticmethod
    def value(encoding) -> bytes:
        return np.array(encoding.ids, "<u4").tobytes()

    def learn_parts(self, parts: list[str]) -> None:
        bytes_of = self.BYTES
        plain = [p if p.isascii() else "".join(map(bytes_of.__getitem__, p.encode())) for p in parts]
        ids = np.array(self.line.encode_batch_fast([" ".join(plain)], add_special_tokens=False)[0].ids, "<u4")
        ends = 4 * (np.flatnonzero(self.ends[ids]) + 1)
        if len(ends) != len(parts):  # a model that does not mark the ends of words
            tokenize = self.encoder.model.tokenize
            self.parts |= {p: pack(f"<{len(x)}I", *(y.id for y in x)) for p, x in zip(parts, map(tokenize, plain))}
            return
        raw, at = ids.tobytes(), 0
        for p, end in zip(parts, ends.tolist()):
            self.parts[p] = raw[at:end]
            at = end

    def learn(self, words: list[str]) -> list[bytes]:
        if not self.lower or not words:
            found = super().learn({w.encode() for w in words})
            return [found[w.encode()] for w in words]
        cut, parts = PLAIN.findall("\n".join(words)), self.parts
        missed = list(set(map(itemgetter(0), cut)).union(map(itemgetter(1), cut)).difference(parts))
        for at in range(0, len(missed), LINE):
            self.learn_parts(missed[at : at + LINE])
        out = [None if rest else parts[letters] + parts[marks] for letters, marks, rest in cut]
        if other := {w.encode() for w, x in zip(words, out) if x is None}:
            found = super().learn(other)
            out = [found[w.encode()] if x is None else x for w, x in zip(words, out)]
        if len(parts) > self.most:
            self.parts = {"": b""}
        return out

    def words(self, text: str) -> list[bytes]:
        raw = text.encode()
        # the tokenizer lowers case itself; special tokens are matched before that, so their texts stay
        if not self.lower or b"<|" in raw:
            return raw.split()
        if (b"\xcc" in raw or b"\xcd" in raw) and MARKED(raw):
            # it composes before it lowers, and some capitals lack the composed form: such words stay
            return [w if MARKED(w) else w.lower() for w in raw.split()]
        return raw.lower().split()

    def __call__(self, texts: pa.Array | list[str]) -> list[bytes]:
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        plain = pc.ascii_lower(texts) if self.lower else texts
        if self.lower and (odd := np.flatnonzero(pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False)).tolist()):
            plain = plain.to_pylist()
            for i in odd:
                plain[i] = b" ".join(self.words(texts[i].as_py())).decode()
            plain = pa.array(plain, pa.string())
        cut = pc.ascii_split_whitespace(plain)
        coded = cut.flatten().dictionary_encode()
        words, known = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), self.known
        ids = list(map(known.get, words))
        if missed := [w for w, x in zip(words, ids) if x is None]:
            found = list(map(self.older.get, missed))
            new = iter(self.learn([w for w, x in zip(missed, found) if x is None]))
            found = [next(new) if x is None else x for x in found]
            if len(known) + len(found) > self.most:
                self.older, self.known = known, {}  # words in use come back from the older half
            self.known.update(zip(missed, found))
            for w in missed:
                if len(w) > self.longest:
                    del self.known[w]
            found = iter(found)
            ids = [next(found) if x is None else x for x in ids]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        starts = np.concatenate(([0], np.cumsum(sizes)))
        lists = pa.LargeListArray.from_arrays(pa.array(starts), pa.array(np.frombuffer(b"".join(ids), "<u4")))
        taken = lists.take(coded.indices)
        ends = taken.offsets.to_numpy()[cut.offsets.to_numpy()] * 4
        raw = taken.values.to_numpy().tobytes()
        return [raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def encoder(path: str):
    """texts -> ids of each as little-endian 32-bit numbers, exactly as the tokenizers library gives them."""
    if drops_space(path):
        known = memory(__name__)
        if path not in known:
            tok = load(path)
            ids = lambda t: tok.encode(t, add_special_tokens=False).ids
            same = all(ids(chr(c)) == ids(chr(c).lower()) for c in range(65, 91)) and ids("AbCXYZ") == ids("abcxyz")
            words = WordIds(tok, lower=same)
            samples = ["thonne", "über.,", "café***", "ß!!", ")(", "naïve|", "a", "_", "x--"]
            if same and any(words.learn([w])[0] != WordIds.value(tok.encode(w, add_special_tokens=False)) for w in samples):
                words = WordIds(tok)  # another pre-tokeniser: every word through all of the library's steps
            known[path] = words
        return known[path]
    tok = load(path)
    plain = lambda texts: texts.to_pylist() if isinstance(texts, pa.Array) else texts
    return lambda texts: [WordIds.value(tok.encode(t, add_special_tokens=False)) for t in plain(texts)]


class _Blocks:
    """Fills blocks with documents and codes them in large groups."""

    def __init__(self, part: int):
        self.part, self.number, self.start, self.count = part, 0, 0, 0
        self.ids: list[np.ndarray] = []
        self.docs: list[dict] = []
        self.full: list[tuple[int, list[dict], np.ndarray]] = []

    def add(self, doc, ids: np.ndarray) -> None:
        if self.count + len(ids) > range_coder.BLOCK_IDS:
            self.close()
        for at in range(0, len(ids), range_coder.BLOCK_IDS):
            piece = ids[at : at + range_coder.BLOCK_IDS]
            self.docs.append({"id": doc, "start": self.start, "n": len(piece), "several": len(ids) > range_coder.BLOCK_IDS})
            self.ids.append(piece)
            self.count += len(piece)
            if self.count == range_coder.BLOCK_IDS:
                self.close()
        self.start += len(ids)

    def close(self) -> None:
        if self.docs:
            self.full.append((self.number, self.docs, np.concatenate(self.ids)))
            self.number += 1
            self.ids, self.docs, self.count = [], [], 0

    def coded(self):
        payloads = range_coder.encode([b[2] for b in self.full])
        rows = [(self.part, n, docs, len(ids), zlib.crc32(ids.astype("<u4")), p) for (n, docs, ids), p in zip(self.full, payloads)]
        self.full = []
        return rows


def _schema(kind: T.DataType) -> T.StructType:
    doc = T.StructType([T.StructField("id", kind), T.StructField("start", T.LongType()), T.StructField("n", T.IntegerType()),
                        T.StructField("several", T.BooleanType())])
    return T.StructType([T.StructField("part", T.IntegerType()), T.StructField("block", T.IntegerType()),
                         T.StructField("docs", T.ArrayType(doc)), T.StructField("n", T.IntegerType()), T.StructField("crc", T.LongType()),
                         T.StructField("payload", T.BinaryType())])


def write_ids(docs: DataFrame, path: str, out: str, *, end_id: int = 2, part_bytes: int = 32 << 20,
              id_col: str = "doc_id", text_col: str = "text") -> str:
    """Write the store to folder ``out`` in ascending id order (null ids first, equal ids by text); returns ``out``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = max(1, math.ceil(size / part_bytes))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("h"))
    rows = rows.repartitionByRange(parts, "id", "h").sortWithinPartitions("id", "h").select("id", "text", F.spark_partition_id().alias("part"))
    schema = _schema(docs.schema[id_col].dataType)
    arrow = to_arrow_schema(schema)

    def batch_of(found):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), arrow)], names=arrow.names)

    def run(batches):
        encode, blocks, end = encoder(path), None, np.array([end_id], "<u4").tobytes()
        for batch in batches:
            if not batch.num_rows:
                continue
            blocks = blocks or _Blocks(batch.column(2)[0].as_py())
            for doc, raw in zip(batch.column(0).to_pylist(), encode(batch.column(1))):
                blocks.add(doc, np.frombuffer(raw + end, "<u4"))
            if len(blocks.full) >= LANES:
                yield batch_of(blocks.coded())
        if blocks:
            blocks.close()
            if blocks.full:
                yield batch_of(blocks.coded())

    rows.mapInArrow(run, schema).write.option("compression", "none").parquet(out)
    return out


def _crc_shift(crc: int, n: int, _powers: dict[int, list[int]] = {}) -> int:  # noqa: B006 - a memory of operators
    """The CRC-32 register after n more zero bytes, by repeated squaring of the one-bit operator."""
    def times(m, v):
        out = i = 0
        while v:
            if v & 1:
                out ^= m[i]
            v >>= 1
            i += 1
        return out

    if not _powers:
        m = [0xEDB88320] + [1 << i for i in range(31)]  # one zero bit
        for _ in range(3):
            m = [times(m, x) for x in m]
        _powers[0] = m  # one zero byte
    bit = 0
    while n:
        if bit not in _powers:
            _powers[bit] = [times(_powers[bit - 1], x) for x in _powers[bit - 1]]
        if n & 1:
            crc = times(_powers[bit], crc)
        n >>= 1
        bit += 1
    return crc


def crc_joined(pieces: list[tuple[int, int]]) -> int:
    """CRC-32 of byte strings put together, from each one's (crc, number of bytes)."""
    out = 0
    for crc, n in pieces:
        out = _crc_shift(out, n) ^ crc
    return out


def _pieces(blocks: DataFrame, kind: T.DataType) -> DataFrame:
    """part, block, and of each document with ids in the block: id, start, n, crc, several."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("id", kind),
                           T.StructField("start", T.LongType()), T.StructField("n", T.LongType()), T.StructField("crc", T.LongType()),
                           T.StructField("several", T.BooleanType())])
    arrow = to_arrow_schema(schema)

    def decoded(rows):
        found = []
        for row, ids in zip(rows, range_coder.decode([r["payload"] for r in rows], [r["n"] for r in rows])):
            raw = memoryview(ids.astype("<u4").tobytes())
            if zlib.crc32(raw) != row["crc"]:
                raise ValueError(f"block {row['block']} of part {row['part']} is damaged")
            at = 0
            for d in row["docs"]:
                end = at + 4 * d["n"]
                found.append((row["part"], row["block"], d["id"], d["start"], d["n"], zlib.crc32(raw[at:end]), d["several"]))
                at = end
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), arrow)], names=arrow.names)

    def run(batches):
        held = []
        for batch in batches:
            held += batch.to_pylist()
            if len(held) >= LANES:
                yield decoded(held)
                held = []
        if held:
            yield decoded(held)

    return blocks.mapInArrow(run, schema)


def _joined(pieces: DataFrame, kind: T.DataType) -> DataFrame:
    """Documents of several pieces: part, id, start, n, crc."""
    def run(batches):
        for batch in batches:
            crc = [crc_joined([(x["crc"], 4 * x["n"]) for x in p]) for p in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(crc, pa.int64())], names=["part", "id", "start", "n", "crc"])

    rows = pieces.groupBy("part", "start").agg(F.first("id").alias("id"), F.sum("n").alias("n"),
                                               F.array_sort(F.collect_list(F.struct("block", "n", "crc"))).alias("p"))  # a piece for 4096 ids
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("id", kind), T.StructField("start", T.LongType()),
                           T.StructField("n", T.LongType()), T.StructField("crc", T.LongType())])
    return rows.select("part", "id", "start", "n", "p").mapInArrow(run, schema)


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """id, start, n_tokens and ids_crc32 of every document of the store, from its decoded blocks."""
    small_batches(spark)
    blocks = spark.read.parquet(folder)
    kind = blocks.schema["docs"].dataType.elementType["id"].dataType
    pieces = cut_lineage(_pieces(blocks, kind))  # both branches below read it: decode once
    total = blocks.groupBy("part").agg(F.sum("n").alias("ids"))
    earlier = F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # one row for each part
    offsets = total.select("part", F.coalesce(earlier, F.lit(0)).alias("offset"))
    columns = ["part", "id", "start", "n", "crc"]
    docs = pieces.filter(~F.col("several")).select(columns).unionByName(_joined(pieces.filter("several"), kind).select(columns))
    return docs.join(offsets, "part").select("id", (F.col("start") + F.col("offset")).alias("start"), F.col("n").alias("n_tokens"),
                                             F.col("crc").alias("ids_crc32"))


def store_ids(docs: DataFrame, path: str, *, out: str | None = None, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Write the store, read it back: id, start, n_tokens, ids_crc32 for every row of ``docs``.

    Null and empty texts are just the end id; null ids come first; repeated rows each get their
    place; an empty table gives an empty result. Other columns are not read.
    """
    out = out or f"{ensure_checkpoint_dir(docs.sparkSession)}/token_ids_{uuid.uuid4().hex}"
    write_ids(docs, path, out, id_col=id_col, text_col=text_col, **how)
    return read_ids(docs.sparkSession, out).withColumnRenamed("id", id_col)
