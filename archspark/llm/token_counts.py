"""Token counts: batch encoding inside Arrow functions that return lengths only.

Texts are cut at safe boundaries, that is where a cut cannot change any token:

* a tokenizer that drops white space (its pre-tokeniser keeps only runs without it) may be
  cut at every run of ASCII white space. The pieces of an Arrow batch are then words, each
  distinct word is encoded once, and its length is remembered by the worker (a bounded memory);
* any other may be cut at a single space between two ASCII letters: no normaliser composes
  across it, no special token holds it, the pre-tokenisers end a word there. For ``.json``
  tokenizers the space opens the second piece; for ``.model`` files it is left out, since the
  encoder puts a space before each piece. Only long texts are cut there.

Pieces are dealt into encoder batches of about ``batch_bytes``, so memory follows bytes and
not rows, and of each encoding only its length is kept.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
from pyspark.sql import DataFrame

from archspark.llm.common import annotate

BOUNDARY = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")
_LOADED: dict[str, object] = {}


def load(path: str):
    """The library's encoder for a file, once per worker process; a null limit: no cut, no padding."""
    if path not in _LOADED:
        if path.endswith(".model"):
            import sentencepiece

            _LOADED[path] = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs one task per core
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.no_truncation()
            tok.no_padding()
            _LOADED[path] = tok
    return _LOADED[path]


def cut(text: str, most: int, drop_space: bool) -> list[str]:
    """Pieces of about ``most`` characters, ending at safe boundaries; one piece where there are none."""
    pieces, start = [], 0
    while len(text) - start > most:
        m = BOUNDARY.search(text, start + most)
        if m is None:
            break
        pieces.append(text[start:m.start()])
        start = m.start() + drop_space
    pieces.append(text[start:])
    return pieces


def batches(pieces: list[tuple[int, str]], most: int):
    """Consecutive pieces until a batch holds ``most`` characters; a longer piece is a batch of its own."""
    at, size, out = [], 0, []
    for row, piece in pieces:
        if out and size + len(piece) > most:
            yield at, out
            at, size, out = [], 0, []
        at.append(row)
        out.append(piece)
        size += len(piece)
    if out:
        yield at, out


class WordLengths:
    """Lengths of white-space separated words, each encoded once until ``most`` words are known."""

    def __init__(self, encoder, batch_bytes: int, most: int = 1_000_000, longest: int = 64):
        self.encoder, self.batch_bytes, self.most, self.longest = encoder, batch_bytes, most, longest
        self.known: dict = {}

    value = staticmethod(len)  # what is kept of a word's encoding

    def learn(self, words: set[bytes]) -> dict:
        new = list(words)
        found = {}
        for at, some in batches([(i, w.decode()) for i, w in enumerate(new)], self.batch_bytes):
            for i, x in zip(at, self.encoder.encode_batch_fast(some, add_special_tokens=False)):
                found[new[i]] = self.value(x)
        return found

    def __call__(self, texts: list[bytes]) -> list[int]:
        words = [t.split() for t in texts]  # bytes.split cuts at ASCII white space only
        got = [list(map(self.known.get, w)) for w in words]
        new = {w for ws, ns in zip(words, got) if None in ns for w, n in zip(ws, ns) if n is None}
        found = self.learn(new)
        out = [sum(ns) if None not in ns else sum(found[w] if n is None else n for w, n in zip(ws, ns))
               for ws, ns in zip(words, got)]
        if len(self.known) + len(found) > self.most:
            self.known = {}
        self.known |= {w: n for w, n in found.items() if len(w) <= self.longest}  # long ones are rare
        return out


def drops_space(path: str) -> bool:
    """True if the file says that words are what a pattern without white space keeps, and nothing else."""
    if path.endswith(".model"):
        return False
    with open(path, encoding="utf-8") as f:
        pre = json.load(f).get("pre_tokenizer") or {}
    first = (pre.get("pretokenizers") or [pre])[0]
    pattern = (first.get("pattern") or {}).get("Regex", "")
    return (first.get("type") == "Split" and first.get("behavior") == "Removed" and bool(first.get("invert"))
            and not re.search(r"(?<!\^)\\s|\\S| ", pattern))


def piece_lengths(texts: list[str], path: str, piece_chars: int, batch_bytes: int) -> np.ndarray:
    encoder, model = load(path), path.endswith(".model")
    pieces = [(i, p) for i, t in enumerate(texts) if t for p in cut(t, piece_chars, model)]
    total = np.zeros(len(texts), np.int64)
    for at, some in batches(pieces, batch_bytes):
        if model:
            n = [len(x) for x in encoder.encode(some, num_threads=1)]
        else:
            n = [len(x) for x in encoder.encode_batch_fast(some, add_special_tokens=False)]
        np.add.at(total, at, n)
    return total


_WORDS: dict[tuple[str, int], WordLengths] = {}


def count_tokens(docs: DataFrame, path: str, *, limit: int = 2048, piece_chars: int = 16_384,
                 batch_bytes: int = 262_144, id_col: str = "doc_id", text_col: str = "text",
                 carry: tuple[str, ...] = ()) -> DataFrame:
    """id, n_bytes (UTF-8), n_tokens, over_limit for every row of ``docs``.

    Null and empty texts have no bytes and no tokens; equal rows each get their row; an empty
    table gives an empty result; other columns are not read. ``path`` must be readable on the
    executors (an installed file).
    """
    by_word = drops_space(path)

    def make():
        if by_word and (path, batch_bytes) not in _WORDS:
            _WORDS[path, batch_bytes] = WordLengths(load(path), batch_bytes)

        def work(texts):
            texts = [t or "" for t in texts.to_pylist()]
            raw = [t.encode() for t in texts]
            n = _WORDS[path, batch_bytes](raw) if by_word else piece_lengths(texts, path, piece_chars, batch_bytes)
            n = np.asarray(n, np.int64)
            return [len(t) for t in raw], n, n > limit

        return work

    return annotate(docs, make, "n_bytes long, n_tokens long, over_limit boolean",
                    id_col=id_col, text_col=text_col, carry=carry)
