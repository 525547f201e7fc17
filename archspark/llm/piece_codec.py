"""SentencePiece (BPE) encoding and decoding with a prefix table.

Merging BPE has a property that allows a linear pass: a sequence of pieces is the encoding of a
text if and only if each piece encodes to itself and each two neighbours are compatible, that is,
the two texts put together encode to just these two pieces. So the last piece of every prefix
of a word is unique, and the table of these last pieces is filled from left to right: the
automaton gives the pieces that end at a place, and the piece sought is the one that starts where
a known prefix ends whose own last piece is compatible with it. The ids are recovered backwards
from the end.

Merge rules follow the score of the merged piece (the best first, the leftmost of equals), so the
order among pieces is the model's own; compatibility is decided by merging two pieces' characters
in that order and remembered for each pair.

A text is cut first where no piece can reach across: before a space mark after another character,
and around characters that occur in no longer piece. Words recur, so each worker remembers the ids
of words up to a bounded number (about 150 MB with the pairs), and drops them when it turns to another operator. Characters that are no piece become their bytes.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame

from archspark.llm.common import annotate, memory

SPACE = "▁"  # the mark that stands for a space


class PieceCodec:
    """Encoder and decoder for a sentencepiece BPE model with byte fallback and no normalisation."""

    def __init__(self, path: str, known_words: int = 400_000, known_pairs: int = 600_000):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        if sp.normalize("A  é ﬁ") != SPACE + "A" + 2 * SPACE + "é" + SPACE + "ﬁ":
            raise ValueError("only models that change nothing but spaces are supported")
        self.begin, self.end = sp.bos_id(), sp.eos_id()
        plain = [i for i in range(sp.vocab_size()) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in plain}
        #: place in the merge order: better scores first; sentencepiece compares scores only
        self.order = {p: -sp.get_score(i) for p, i in self.ids.items()}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(not sp.is_byte(i) for i in self.bytes):
            raise ValueError("only models with byte fallback are supported")
        longer = [p for p in self.ids if len(p) > 1]
        if any(SPACE in p.lstrip(SPACE) for p in longer):
            raise ValueError("only models whose pieces have space marks in front are supported")
        self.joining = {c for p in longer for c in p}  # characters of longer pieces
        self.matcher = ahocorasick.Automaton()
        for p in self.ids:
            if self.merged(p) == [p]:  # a piece that merging cannot build is never a result
                self.matcher.add_word(p, p)
        self.matcher.make_automaton()
        self.most_words, self.most_pairs = known_words, known_pairs
        self.words: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}  # by the two ids in one number

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by merging its characters in the model's order."""
        parts, order = list(text), self.order.get
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                o = order(parts[i] + parts[i + 1])
                if o is not None and (best is None or o < best):
                    best, at = o, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        """Whether the two pieces stay as they are when they meet."""
        both = self.ids[left] << 32 | self.ids[right]
        found = self.pairs.get(both)
        if found is None:
            if len(self.pairs) >= self.most_pairs:
                self.pairs = {}
            found = self.pairs[both] = self.merged(left + right) == [left, right]
        return found

    def pieces(self, word: str) -> list[str]:
        """Pieces of a word, characters that are no piece among them."""
        if len(word) == 1:
            return [word]
        last: list[str | None] = [None] * (len(word) + 1)  # last[n]: last piece of the prefix of n characters
        n, compatible, ids = 0, self.compatible, self.ids
        for end, piece in self.matcher.iter(word):
            end += 1
            while n < end - 1:  # characters no piece ends at stand alone
                n += 1
                last[n] = last[n] or word[n - 1]
            if last[end] is None:
                start = end - len(piece)
                before = last[start] if start else None
                if start == 0 or (before is not None and (before not in ids or compatible(before, piece))):
                    last[end] = piece
                    n = end
        for i in range(n + 1, len(word) + 1):
            last[i] = last[i] or word[i - 1]
        out, at = [], len(word)
        while at:
            out.append(last[at])
            at -= len(last[at])
        return out[::-1]

    def word_ids(self, word: str) -> bytes:
        """Ids of a word as little-endian 32-bit numbers."""
        ids: list[int] = []
        for p in self.pieces(word):
            i = self.ids.get(p)
            if i is None:
                ids += [self.bytes[b] for b in p.encode()]
            else:
                ids.append(i)
        return np.array(ids, "<u4").tobytes()

    def cut(self, text: str) -> list[str]:
        """The marked text in parts that no piece reaches across."""
        marked = (SPACE + text).replace(" ", SPACE)
        return PARTS.findall(marked)

    def encode(self, text: str) -> bytes:
        """Ids without begin and end, as little-endian 32-bit numbers; an empty text has none."""
        if not text:
            return b""
        parts = self.cut(text)
        found = list(map(self.words.get, parts))
        if None in found:
            if len(self.words) > self.most_words:
                self.words = {}
            for i, f in enumerate(found):
                if f is None:
                    f = self.words.get(parts[i])
                    if f is None:
                        f = self.word_ids(parts[i])
                        if len(parts[i]) <= 64:
                            self.words[parts[i]] = f
                    found[i] = f
        return b"".join(found)

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


#: a run of space marks with what follows up to the next mark or line end; other white space alone
PARTS = re.compile(f"{SPACE}*[^{SPACE}\\n]+|{SPACE}+|\\n")


def codec(path: str) -> PieceCodec:
    known = memory(__name__)
    if path not in known:
        c = PieceCodec(path)
        if "\n" in c.joining:
            raise ValueError("only models whose longer pieces hold no line end are supported")
        known[path] = c
    return known[path]


def encode_decode(docs: DataFrame, path: str, *, keep: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text",
                  carry: tuple[str, ...] = ()) -> DataFrame:
    """id, carried columns, n_tokens, ids_sha256, decoded_sha256 for every row.

    ``keep`` may name ids (little-endian 32-bit numbers) and decoded (the text), to return them too.

    Ids include the begin and end ids. Null and empty texts have just these two and decode to the
    empty text; repeated rows each get their row; an empty table gives an empty result. Other
    columns are not read.
    """
    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    more = {"ids": "binary", "decoded": "string"}
    schema += "".join(f", {k} {more[k]}" for k in keep)

    def make():
        c = codec(path)
        begin, end = (np.array([i], "<u4").tobytes() for i in (c.begin, c.end))

        def work(texts):
            n, ids_sha, decoded_sha, kept = [], [], [], {"ids": [], "decoded": []}
            for text in texts.to_pylist():
                raw = begin + c.encode(text or "") + end
                ids = np.frombuffer(raw, "<u4").tolist()
                back = c.decode(ids)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(raw).hexdigest())
                decoded_sha.append(hashlib.sha256(back.encode()).hexdigest())
                for k in keep:
                    kept[k].append(raw if k == "ids" else back)
            return [n, ids_sha, decoded_sha, *(kept[k] for k in keep)]

        return work

    return annotate(docs, make, schema, id_col=id_col, text_col=text_col, carry=carry)
