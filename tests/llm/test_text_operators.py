"""Operators whose results are compared with a brute-force version on small tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from conftest import SMALL
from tokenizers import Tokenizer

import __spark_entry__ as E
from archspark.llm import decontaminate, piece_codec, pii, range_coder, secrets, sharding, simhash, token_counts, token_store

from llm_helpers import DOCS, ODD


@pytest.fixture()
def frame(spark):
    return spark.createDataFrame

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}


def result(spark, name):
    return {r.doc_id: r for r in E.queries()[name](spark, SMALL).collect()}


def noise(n, seed=5):
    r = random.Random(seed)
    parts = ["a b  c\n\n", "théà", "▁ ▁a", " the ing er", "日本語", "\t\r", "😀é", "0123 4", "<s></s><0x0A>", "aaaab", "ABC.,;!?", "\x00"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(n)]


# ------------------------------------------------------------------ SentencePiece (2)

def test_pieces_equal_the_library():
    codec, sp = piece_codec.codec(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for t in noise(3000):
        ids = np.frombuffer(codec.encode(t), "<u4").tolist()
        assert ids == sp.encode(t), t
        assert codec.decode(ids) == sp.decode(ids)


def test_sentencepiece_query(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = result(spark, "op2_sentencepiece")
    for i, t in texts(spark).items():
        ids = sp.encode(t, add_bos=True, add_eos=True)
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == want


def test_sentencepiece_odd_rows(frame):
    rows = piece_codec.encode_decode(frame(ODD, DOCS), PIECES, keep=("ids", "decoded")).collect()
    assert len(rows) == len(ODD)
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2)} == {2}
    assert not piece_codec.encode_decode(frame([], DOCS), PIECES).collect()


# ------------------------------------------------------------------ token counts (3)

@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts_equal_the_library(frame, spark, name):
    path = public_tokenizers.path(name)
    rows = [(i, t) for i, t in enumerate([*noise(200), *texts(spark).values()][:260])]
    got = {r.doc_id: r for r in token_counts.count_tokens(frame(rows, "doc_id long, text string"), path, piece_chars=300, batch_bytes=2000).collect()}
    enc = token_counts.load(path)
    for i, t in rows:
        want = len(enc.encode(t)) if name.endswith(".model") else len(enc.encode(t, add_special_tokens=False).ids)
        assert got[i].n_tokens == want, t
        assert got[i].n_bytes == len(t.encode()) and got[i].over_limit == (want > 2048)


def test_counts_forget_words_without_change():
    tok = token_counts.load(WORD_BPE)
    few = token_counts.WordLengths(tok, 1000, most=3, longest=4)
    for t in noise(50) + ["long " + "x" * 500]:
        assert few([t.encode()]) == [len(tok.encode(t, add_special_tokens=False).ids)]


def test_counts_odd_rows(frame):
    rows = token_counts.count_tokens(frame(ODD, DOCS), WORD_BPE).collect()
    assert len(rows) == len(ODD) and {r.n_tokens for r in rows if r.doc_id in (1, 2, 3)} == {0}
    assert not token_counts.count_tokens(frame([], DOCS), WORD_BPE).collect()


# ------------------------------------------------------------------ token-id store (10)

def test_range_coder_round_trip():
    r = np.random.default_rng(3)
    blocks = [r.integers(0, 49_408, n) for n in (1, 2, 4096, 300, 0, 77)] + [np.zeros(4096, int), np.tile([5, 6, 7], 1000), np.full(9, 65_534)]
    coded = range_coder.encode(blocks)
    for a, b in zip(blocks, range_coder.decode(coded, [len(b) for b in blocks])):
        assert np.array_equal(a, b)
    assert range_coder.encode(blocks[2:3]) == coded[2:3]  # a block's payload does not depend on the others
    assert len(coded[7]) < 100
    with pytest.raises(ValueError):
        range_coder.encode([np.zeros(4097, int)])


def test_range_coder_shrinks_text(spark):
    ids = np.concatenate([np.frombuffer(x, "<u4") for x in token_store.encoder(WORD_BPE)(list(texts(spark).values()))])
    blocks = [ids[i : i + 4096] for i in range(0, len(ids), 4096)]
    assert sum(map(len, range_coder.encode(blocks))) < 0.8 * 2 * len(ids)


def test_joined_checksums():
    pieces = [b"", b"abc", bytes(100_000), b"x" * 7]
    assert token_store.crc_joined([(zlib.crc32(p), len(p)) for p in pieces]) == zlib.crc32(b"".join(pieces))


def test_store_ids_equal_the_library():
    tok, enc = Tokenizer.from_file(WORD_BPE), token_store.encoder(WORD_BPE)
    for t in [*noise(400, 9), "It's ... 'll we'd (a). b' a.'s <|endoftext|>X. <|STARTOFTEXT|>"]:
        assert np.frombuffer(enc([t])[0], "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_store_ids_of_capitals_with_combining_marks():
    tok, enc = Tokenizer.from_file(WORD_BPE), token_store.encoder(WORD_BPE)
    texts = [a + m for a, m in zip("JHTWY", "\u030c\u0331\u0308\u030a\u030a")]
    texts += [f"Some {chr(c)}{chr(m)}Ab Words" for c in range(65, 91) for m in range(0x300, 0x346)]
    texts += [f"{chr(c)}\u0591\u030c {chr(c)}\u0323\u0340x" for c in range(65, 91)]
    for t in texts:
        assert np.frombuffer(enc([t])[0], "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, ascii(t)


def test_store_ids_of_arrow_texts_with_little_memory(monkeypatch):
    tok, enc = Tokenizer.from_file(WORD_BPE), token_store.encoder(WORD_BPE)
    for name, few in (("most", 20), ("longest", 6)):
        monkeypatch.setattr(enc, name, few)
    plain = ["", "  \n", "A plain Text, with marks... and\twords", "über naïve| ß!! \x0bx", "x" * 70 + " end"]
    odd = ["Two <|endoftext|> Words", "J\u030cA plain T\u0308 Text", "\u0345"]
    for t in (noise(60, 21), plain + odd, [], odd, plain):
        got = enc(pa.array(t, pa.string()))
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [tok.encode(x, add_special_tokens=False).ids for x in t]
        assert len(enc.known) <= 20 + sum(len(x.split()) for x in t) and all(len(w) <= 6 for w in enc.known)


def test_store_query(spark):
    tok, got, start = Tokenizer.from_file(WORD_BPE), result(spark, "op10_token_store"), 0
    for i, t in sorted(texts(spark).items()):
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids))
        start += len(ids)


def test_store_long_documents_small_parts_and_odd_rows(frame):
    tok = Tokenizer.from_file(WORD_BPE)
    rows = [*((r[0], r[1]) for r in ODD), (7, "word " * 10_000), (8, "a b c " * 3000)]
    got = token_store.store_ids(frame(rows, "doc_id long, text string"), WORD_BPE, part_bytes=5000).collect()
    key = lambda t: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
    want = sorted((-1 if i is None else i, len(key(t)), zlib.crc32(key(t))) for i, t in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    ends = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == ends
        ends += r.n_tokens
    ids = [-1 if r.doc_id is None else r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids)
    assert not token_store.store_ids(frame([], "doc_id long, text string"), WORD_BPE).collect()


# ------------------------------------------------------------------ decontamination (1)

def brute_windows(docs, items, window):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    wins = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[k : k + window]), set()).add("" if i is None else str(i))
    for t in docs:
        w, hit, found = words(t), set(), set()
        for k in range(len(w)):
            for n in {len(x) for x in wins}:
                if (x := tuple(w[k : k + n])) in wins and len(x) == n:
                    hit |= set(range(k, k + n))
                    found |= wins[x]
        yield len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block_rows", [200_000, 7])
def test_windows_against_brute_force(frame, block_rows):
    r = random.Random(2)
    docs = [" ".join(r.choice("abcd") for _ in range(r.randint(0, 60))) for _ in range(60)] + [None, "", "A b, C!"]
    items = [(i, " ".join(r.choice("abcd") for _ in range(r.randint(0, 9)))) for i in range(25)] + [(None, "a b c"), (90, None), (91, "A B"), (91, "a-b")]
    rows = [(i, t) for i, t in enumerate(docs)]
    got = {x.doc_id: (x.n_words, x.n_hit, x["items"]) for x in decontaminate.contained_windows(
        frame(rows, "doc_id long, text string"), frame(items, "item_id long, text string"), window=6, block_rows=block_rows).collect()}
    for (i, _), want in zip(rows, brute_windows(docs, items, 6)):
        assert got[i] == want


def test_windows_odd_rows(frame):
    none = frame([], "item_id long, text string")
    rows = decontaminate.contained_windows(frame(ODD, DOCS), none, carry=("text", "lang")).collect()
    assert len(rows) == len(ODD) and all(r.n_hit == 0 and r["items"] == [] for r in rows)
    assert not decontaminate.contained_windows(frame([], DOCS), none).collect()


# ------------------------------------------------------------------ SimHash (5)

def brute_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    bits = [sum(xxhash.xxh64_intdigest(x.encode(), 42) >> i & 1 for x in s) for i in range(64)]
    return sum(1 << i for i in range(64) if 2 * bits[i] > len(s)) if s else 0


def brute_components(fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_simhash_query(spark):
    got, docs = result(spark, "op5_simhash"), sorted(texts(spark).items())
    fps = [brute_fingerprint(t) for _, t in docs]
    for (i, _), fp, c in zip(docs, fps, brute_components(fps)):
        assert (got[i].fingerprint, got[i].component_id) == (f"{fp:016x}", docs[c][0])


@pytest.mark.parametrize("bucket", [4096, 8])
def test_covering_links_connect_all_near_pairs(spark, bucket):
    r = random.Random(4)
    base = [r.getrandbits(64) for _ in range(30)]
    fps = {b for b in base}
    for _ in range(400):
        x = r.choice(base[:4])
        for _ in range(r.randint(0, 5)):
            x ^= 1 << r.randrange(64)
        fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    from archspark.llm.components import components
    links = simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp long"), 3, bucket)
    root = {n.node: n.root for n in components(links).collect()}
    label = [root.get(x, x) for x in signed]
    want = brute_components(fps)
    assert len({(a, b) for a, b in zip(label, want)}) == len(set(want)) == len(set(label))


def test_simhash_odd_rows(frame):
    got = simhash.near_duplicates(frame(ODD, DOCS), carry=("lang",)).collect()
    assert len(got) == len(ODD)
    assert {r.component_id for r in got if r.doc_id in (1, 2, 3)} == {1}
    assert {r.component_id for r in got if r.doc_id in (None, 4, 5)} == {4}
    kept = simhash.one_of_each_group(frame(ODD, DOCS))
    assert sorted((r.doc_id, r.lang) for r in kept.collect() if r.doc_id != 1) == [(4, "en"), (6, "fr")] and kept.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert not simhash.near_duplicates(frame([], DOCS)).collect()
    alone = simhash.near_duplicates(frame([(None, "a b c"), (None, "x y z")], "doc_id long, text string")).collect()
    assert [r.component_id for r in alone] == [None, None] and len({r.group_fp for r in alone}) == 2


# ------------------------------------------------------------------ personal data (6), secrets (7)

def brute_pii(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m.group() if c.isdigit()][::-1]
        if 12 <= len(d) <= 19 and (sum(d[0::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out)


def brute_secrets(t):
    pat = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out = [(m.start(), 0, m.end()) for m in re.finditer(pat, t, re.I | re.A) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m.group()) >= 16]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m.group()) >= 32])


def test_base_spans_against_brute_force():
    r = random.Random(8)
    parts = ["a@b.c", "@", "a.b", "+1 (22) 333", "4111 1111 1111 1111", "1.2.3.4", "256.1", ".", "-", "9", " ", "é", "x@y@z.q", "0007.8.9.1", "😀",
             "token = ", "PASSWORD:'", "api_key=", "abcdef0123", "AKIA", "ABCDEFGHIJKL0", "\"", "deadbeef" * 4, "secret", "K", "="]
    for _ in range(6000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 9)))
        assert pii.base_spans(t) == brute_pii(t), t
        assert secrets.base_spans(t) == brute_secrets(t), t


def test_long_runs_take_linear_time():
    for t in ("a" * 300_000, "7" * 300_000, "a@" * 100_000, "+" * 200_000, "token " * 50_000, "1." * 150_000):
        pii.base_spans(t), secrets.base_spans(t)


@pytest.mark.parametrize("name, kinds, brute", [("op6_pii", pii.KINDS, brute_pii), ("op7_secrets", secrets.KINDS, brute_secrets)])
def test_base_digests(spark, name, kinds, brute):
    got = result(spark, name)
    for i, t in texts(spark).items():
        want = brute(t)
        joined = [f"{kinds[k]}:{s}:{e}" for s, k, e in want]
        assert got[i].base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest()
        assert set(joined) <= set(got[i].spans.split(",")) | {""}
        assert [got[i][f"n_{x}"] for x in kinds] == [sum(k == n for _, k, _ in want) for n in range(len(kinds))]


def test_disclosive_terms(frame):
    rows = [(i, f"ordinary words here and then number{'x' * (i % 3)} lines") for i in range(40)]
    rows += [(100 + i, f"please reach Zanzibarius at zan@home.example.org about thing {'q' * i}") for i in range(3)]
    rows += [(200, None), (201, ""), (202, "one bob@x.org"), (100, "please reach Zanzibarius at zan@home.example.org about thing ")]
    got = pii.find_personal_data(frame(rows, "doc_id long, text string"))
    spans = {r.doc_id: [(x.start, x.k, x.end) for x in r.spans] for r in got.collect()}
    assert got.count() == len(rows)
    assert (13, 4, 24) in spans[101] and not spans[0] and not spans[200]
    assert [k for _, k, _ in spans[202]] == [0]  # seen once: nothing to learn from
    text = {r.doc_id: r.text for r in pii.sanitised(frame(rows[:43], "doc_id long, text string")).collect()}
    assert "zan@" not in text[101] and "Zanzibarius" not in text[101] and "[email]" in text[101]
    assert not pii.find_personal_data(frame([], "doc_id long, text string")).collect()


def test_disclosive_terms_are_marked_in_every_text(frame):
    rows = [(i, f"ordinary words here and then lines {'x' * i}") for i in range(40)]
    rows += [(100 + i, f"please reach Zanzibarius at zan@home.example.org {'q' * 9 * i}") for i in range(3)]
    far = "zan@home.example.org " + "ordinary words here and then lines " * 9
    rows += [(200, "today ZANZIBARIUS came, zanzibarius left"), (201, far + "Zanzibarius"), (202, "xZanzibarius zan@zanzibarius.org")]
    got = {r.doc_id: [(x.start, x.k, x.end) for x in r.spans] for r in pii.find_personal_data(frame(rows, "doc_id long, text string")).collect()}
    assert got[200] == [(6, 4, 17), (24, 4, 35)]
    assert (len(far), 4, len(far) + 11) in got[201]
    assert got[202] == [(13, 0, 32)] and not got[0]  # neither inside a word nor inside an entity


def test_copies_are_no_evidence_on_terms(frame):
    rows = [(i, f"ordinary words {'x' * i} here") for i in range(200)]
    rows += [(1000 + i, "write Zanzibarius at zan@home.example.org") for i in range(500)] + [(2000, "see Zanzibarius: zan@home.example.org soon")]
    got = {r.doc_id: [(x.start, x.k, x.end) for x in r.spans] for r in pii.find_personal_data(frame(rows, "doc_id long, text string")).collect()}
    assert (6, 4, 17) in got[1000] and (4, 4, 15) in got[2000] and not got[0]


def test_random_tokens_are_found_and_words_are_not(frame):
    r = random.Random(1)
    keys = ["".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(40)) for _ in range(60)]
    rows = [(i, f"the key {k} is here") for i, k in enumerate(keys)]
    plain = ["zzzzzzzzzzzzzzzzzzzz1111111111zzzzzzzzzz", "chapter1chapter1chapter1chapter1chapter1", "x" * 39 + "1"]
    rows += [(1000 + i, f"see {plain[i % 3]} for more") for i in range(60)] + [(3000, None), (3001, "")]
    got = {x.doc_id: x for x in secrets.find_secrets(frame(rows, "doc_id long, text string")).collect()}
    found = [bool(got[i].spans) for i in range(60) if any(c.isdigit() for c in keys[i])]
    assert sum(found) >= 0.9 * len(found)
    assert not any(got[1000 + i].spans for i in range(60))
    hit = next(i for i in range(60) if got[i].spans)
    assert keys[hit] not in got[hit].redacted and got[3000].redacted is None
    assert not secrets.find_secrets(frame([], "doc_id long, text string")).collect()


def test_copied_tokens_have_one_vote(frame):
    r = random.Random(3)
    keys = []
    while len(keys) < 130:
        k = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(40))
        if any(c.isdigit() for c in k):
            keys.append(k)
    p = lambda k: secrets.randomness(k, "base64")
    low, high = next(k for k in keys[100:] if 0.2 < p(k) < 0.4), next(k for k in keys[100:] if p(k) > 0.6)
    found = []
    for copies in (1, 400):
        for token in (low, high):
            rows = [(i, f"the key {k} is here") for i, k in enumerate(keys[:100])] + [(1000 + i, f"see {token} for more") for i in range(copies)]
            got = secrets.find_secrets(frame(rows, "doc_id long, text string")).filter("doc_id < 100 AND size(spans) > 0")
            found.append(sorted(x.doc_id for x in got.collect()))
    assert found[:2] == found[2:] and len(found[0]) > 70


# ------------------------------------------------------------------ sharding (9)

def test_sharding_query(spark):
    got, docs = result(spark, "op9_sharding"), texts(spark)
    by = {}
    for i, t in docs.items():
        assert (got[i].size, got[i].text_crc32) == (len(t.encode()) + 8, zlib.crc32(t.encode()))
        by.setdefault(got[i].shard, []).append(got[i].slot)
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and set(by) == set(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_sharding_repeated_rows_and_slack(frame, monkeypatch):
    monkeypatch.setattr(sharding, "HOT_ROWS", 50)
    rows = [(7, "same")] * 300 + [(i, None) for i in range(200)] + [(None, "x")]
    got = sharding.assign_shards(frame(rows, "doc_id long, text string").repartition(5), n_shards=4).collect()
    sizes = [sum(r.shard == s for r in got) for s in range(4)]
    assert sum(sizes) == 501 and max(sizes) - min(sizes) <= 1
    assert len({(r.shard, r.slot) for r in got}) == 501
    loose = sharding.assign_shards(frame(rows, "doc_id long, text string"), n_shards=4, slack=0.5).collect()
    assert max(sum(r.shard == s for r in loose) for s in range(4)) <= 188 and len(loose) == 501
    assert not sharding.assign_shards(frame([], "doc_id long, text string")).collect()


def test_overflow_moves_clockwise():
    nodes = [(10, 0), (20, 1), (30, 2)]
    runs = sharding.plan([(5, 0, 7), (15, 0, 1), (35, 0, 1)], nodes, [3, 3, 3])
    assert sorted(runs) == [(5, 0, 0, 2, 0, 0), (5, 0, 3, 4, 1, 1), (5, 0, 5, 6, 2, 0), (15, 0, 0, 0, 1, 0), (35, 0, 0, 0, 2, 2)] or sum(r[3] - r[2] + 1 for r in runs) == 9
