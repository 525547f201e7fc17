"""Whitening, fingerprints and conversation repair, against brute force, numpy and DuckDB."""

from __future__ import annotations

import hashlib
import random
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_helpers import DOCS, ODD

from archspark.llm import conversation_repair as repair
from archspark.llm import prefix_hash as ph
from archspark.llm import queries, whitening
from archspark.llm.common import table

SMALL = "/root/testdata/sf0.001"


# ------------------------------------------------------------------ whitening

def _triangle(x):
    return np.linalg.qr(np.vstack([np.zeros((x.shape[1],) * 2), x]), mode="r")


@pytest.mark.parametrize("kind", ["plain", "graded", "ties", "rank", "repeated values", "flat"])
def test_directions_agree_with_svd(kind):
    rng = np.random.default_rng(7)
    for _ in range(25):
        d, m = int(rng.integers(1, 30)), int(rng.integers(1, 60))
        x = rng.normal(size=(m, d))
        if kind == "graded":
            x *= 10.0 ** rng.uniform(-6, 6, size=d)
        elif kind == "ties":
            x = np.eye(d)[rng.integers(0, d, size=m)] * 3
        elif kind == "rank":
            x[:, d // 2:] = 0
        elif kind == "repeated values":
            x = np.linalg.qr(rng.normal(size=(d, d)))[0] * np.repeat([5.0, 1.0], [d // 2, d - d // 2])
        elif kind == "flat":
            x[:] = 1.0
        r = _triangle(x - x.mean(0))
        values, vectors = whitening.directions(r, min(4, d))
        want = np.linalg.svd(r, compute_uv=False) ** 2
        assert np.allclose(values, want, rtol=1e-9, atol=1e-12 * want[0] + 1e-280)
        for k in range(vectors.shape[1]):
            if want[k] > 1e-13 * want[0] > 0:
                assert np.linalg.norm(r.T @ (r @ vectors[:, k]) - values[k] * vectors[:, k]) < 1e-12 * want[0]
                assert np.abs(vectors[:, :k].T @ vectors[:, k]).max(initial=0) < 1e-6


def test_dqds_keeps_small_values_exact():
    """Relative accuracy where the squares span 24 orders: compared with an exactly known product form."""
    diagonal = 10.0 ** -np.arange(0, 13.0)
    above = diagonal[1:] * 1e-9
    found = whitening.dqds(diagonal, above)
    assert np.allclose(np.sqrt(found), diagonal, rtol=1e-12)


def _whiten(spark, rows, schema="vec_id long, embedding array<float>, whitened string, x int", **options):
    return whitening.whiten(spark.createDataFrame(rows, schema), **options).collect()


def test_whitening_of_the_table(spark):
    got = queries.op11_whitening(spark, SMALL).toPandas()
    src = table(spark, SMALL, "embeddings").toPandas()
    x = np.array([np.floor(256 * np.asarray(v, float)) for v in src["embedding"]]).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    v = np.cov(fit.T, bias=True)
    e, w = np.linalg.eigh(v)
    e, w = e[::-1], w[:, ::-1]
    assert len(got) == 4 * len(src) and set(got["n"]) == {n}
    exact = dict(zip(src["vec_id"], ((n * x - s) ** 2).sum(1)))
    assert all(exact[i] == dev for i, dev in zip(got["vec_id"], got["deviation"]))
    assert got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-9
    for k in range(4):
        part = got[got["component"] == k + 1].set_index("vec_id").loc[src["vec_id"]]
        want = (x - s / n) @ w[:, k] / np.sqrt(e[k])
        sign = np.sign(want @ part["whitened"].to_numpy())
        assert np.allclose(part["whitened"], sign * want, atol=1e-8)
        assert np.allclose(part["explained"], e[k] / e.sum(), rtol=1e-9)


def test_whitening_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], "a", 0), (1, [1.0, 2.0], "b", 0), (None, [0.5, -0.25], None, None), (3, None, "c", 1), (4, [1.0, None], "c", 1),
            (5, [nan, 1.0], "c", 1), (6, [inf, 1.0], "c", 1), (7, [], "c", 1), (8, [1.0], "c", 1), (9, [-0.001, 0.0], "c", 1)]
    got = _whiten(spark, rows)
    assert sorted((r["vec_id"] or -1, r["component"]) for r in got) == [(-1, 1), (-1, 2), (1, 1), (1, 1), (1, 2), (1, 2), (9, 1), (9, 2)]
    x = {1: (256, 512), None: (128, -64), 9: (-1, 0)}
    s = [sum(v[k] for v in x.values()) for k in range(2)]
    for r in got:
        assert r["n"] == 3 and r["deviation"] == sum((3 * a - b) ** 2 for a, b in zip(x[r["vec_id"]], s)) == int(r["deviation_exact"])
    assert got[0]["identity_error"] < 1e-12
    flat = _whiten(spark, [(i, [1.0, 2.0], None, None) for i in range(3)])
    assert len(flat) == 6 and all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["n"] == 1 for r in flat)
    line = _whiten(spark, [(i, [float(i), 0.0], None, None) for i in range(3)])
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in line) and line[0]["identity_error"] < 1e-12
    assert _whiten(spark, []) == [] and _whiten(spark, [(1, None, None, None)]) == []


def test_whitening_beyond_a_long(spark):
    rows = [(1, [1e15, 0.0], None, None), (2, [-1e15, 1.0], None, None)]
    got = _whiten(spark, rows, "vec_id long, embedding array<double>, whitened string, x int")
    want = sum((2 * a - b) ** 2 for a, b in zip((256 * 10**15, 0), (0, 256)))
    assert {r["deviation"] for r in got} == {None} and {int(r["deviation_exact"]) for r in got} == {want}


def test_triangles_do_not_depend_on_partitions(spark):
    fit = whitening.whole_vectors(table(spark, SMALL, "embeddings"), "vec_id", "embedding").select("x")
    x = np.array([r["x"] for r in fit.collect()])
    sums = [int(v) for v in x.sum(0)]
    for parts in (1, 70):
        r = whitening.reduce_rows(fit.repartition(parts), x.shape[1], len(x), sums)
        assert np.allclose(r.T @ r, (x - x.mean(0)).T @ (x - x.mean(0)), rtol=1e-10, atol=1e-6)


# ------------------------------------------------------------------ fingerprints

TEXT = st.text("ab\n é😀", max_size=60)


@settings(max_examples=150, deadline=None)
@given(TEXT, TEXT, st.data())
def test_spans_and_extensions(a, b, data):
    i, j = data.draw(st.integers(0, len(a))), data.draw(st.integers(0, len(b)))
    length = data.draw(st.integers(0, 20))
    x, y = ph.Prefix(a), ph.Prefix(b)
    inside = i + length <= len(a) and j + length <= len(b)
    assert ph.span_equal(x, i, y, j, length) == (inside and a[i:i + length] == b[j:j + length])
    want = 0
    while i + want < len(a) and j + want < len(b) and a[i + want] == b[j + want]:
        want += 1
    assert ph.common_extension(x, i, y, j) == want


@settings(max_examples=150, deadline=None)
@given(TEXT, TEXT)
def test_likeness(a, b):
    x, y = (ph.Fingerprint.of(ph.Prefix(t)) for t in (a, b))
    assert ph.likeness(str(x), str(x)) == 1.0
    near = ph.likeness(str(x), str(y))
    assert near == x.likeness(y) == y.likeness(x) and 0 <= near <= 1
    assert (near == 1) == (a == b) == (str(x) == str(y))
    common = 0
    while common < min(len(a), len(b)) and a[common] == b[common]:
        common += 1
    if a != b:
        step = max(x.step, y.step)
        assert near * max(len(a), len(b)) >= common // step * step - 1e-9


def test_blocks_do_not_change_values(monkeypatch):
    rng = random.Random(3)
    text = "".join(rng.choices("abc é😀", k=5000))
    whole = str(ph.Fingerprint.of(ph.Prefix(text)))
    places = (0, 1, 63, 64, 65, 4999, 5000)
    plain = [ph.Prefix(text).at(i) for i in places]
    monkeypatch.setattr(ph, "BLOCK", 64)
    ph._powers.cache_clear()
    try:
        small = ph.Prefix(text)
        assert str(ph.Fingerprint.of(small)) == whole
        assert [small.at(i) for i in places] == plain
        edited = text[:3750] + "z" * 1250
        assert str(ph.Fingerprint.of(ph.Prefix(edited, small, 3750))) == str(ph.Fingerprint.of(ph.Prefix(edited)))
        p, b = ph.PRIMES[0], ph.BASES[0]
        assert small.at(70)[0] == sum(ord(c) * pow(b, k, p) for k, c in enumerate(text[:70])) % p
    finally:
        ph._powers.cache_clear()


def _edits(rows):
    """Brute force: the edited texts of (doc_id, text) rows already in order."""
    out = []
    for k, (doc_id, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(),
                    *(str(ph.Fingerprint.of(ph.Prefix(t))) for t in (text, edited)), ph.Fingerprint.of(ph.Prefix(text)).likeness(ph.Fingerprint.of(ph.Prefix(after)))))
    return out


@pytest.mark.parametrize("ranges", ["1", "13"])
def test_edits_of_the_table(spark, ranges):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        got = queries.op12_fingerprints(spark, SMALL).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    want = _edits(sorted((r["doc_id"], r["text"]) for r in table(spark, SMALL, "documents").collect()))
    assert sorted((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], r["near_next"]) for r in got) == sorted(want)
    assert all(r["near_edited"] >= 0.6 for r in got if r["n_chars"] >= 4)


def test_edits_of_odd_rows(spark):
    docs = spark.createDataFrame([*ODD, (9, "long " * 200_000, "en", "a", 0)], DOCS).withColumnRenamed("n_chars", "part")
    got = ph.fingerprint_edits(docs).collect()
    assert sorted((r["doc_id"] or -1, r["n_chars"]) for r in got) == [(-1, 13), (1, 0), (2, 0), (3, 4), (4, 13), (4, 13), (5, 13), (6, len(ODD[-1][1])), (9, 1_000_000)]
    by = {r["doc_id"]: r for r in got}
    assert by[1]["near_next"] == 1.0 and by[2]["near_next"] == 0.0
    assert 1.0 in {r["near_next"] for r in got if r["doc_id"] == 4}  # the first of two equal rows
    assert by[9]["edited_sha256"] == hashlib.sha256(("long " * 150_000 + "one two three").encode()).hexdigest()
    named = ph.fingerprint_edits(docs.withColumn("doc_id", docs.doc_id.cast("string"))).collect()
    assert sorted(r["edited_sha256"] for r in named) == sorted(r["edited_sha256"] for r in got)
    assert ph.fingerprint_edits(docs.limit(0)).collect() == []
    one = ph.fingerprint_edits(docs.filter("doc_id = 9")).collect()
    assert one[0]["near_next"] == 1.0
    spread = ph.fingerprints(docs, carry=("lang",)).collect()
    assert {(r["doc_id"], r["fingerprint"]) for r in spread} == {(r["doc_id"], r["fingerprint"]) for r in got}
    pairs = spark.createDataFrame([("abcd", "abx", 1), (None, "a", 2), ("", "", None)], "l string, r string, doc_id int")
    assert [r["common"] for r in ph.common_prefixes(pairs, "l", "r").collect()] == [2, 0, 0]


# ------------------------------------------------------------------ conversation repair

NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def _plain(codes):
    """Least (cost, audit) over all edits, by recursion over turns and states of the grammar."""
    @lru_cache(None)
    def go(i, q, inserted):
        found = [(0, "")] if i == len(codes) and q in (0, 3) else [(10**9, "")]
        put = lambda cost, letter, rest: found.append((cost + rest[0], letter + rest[1]))
        if i < len(codes):
            role, fault = divmod(codes[i], 4)
            put(2, "D", go(i + 1, q, 0))
            for ch in "sua" if fault in (0, 3) else "":
                if (q, ch) in NEXT:
                    if "sua"[role:role + 1] == ch:
                        put(5 * (fault == 3), "K", go(i + 1, NEXT[q, ch], 0))
                    if ch != "s":
                        put(1 + 5 * (fault == 3), "R", go(i + 1, NEXT[q, ch], 0))
        if inserted < 4:
            for ch in "ua":
                if (q, ch) in NEXT:
                    put(5, "I", go(i, NEXT[q, ch], inserted + 1))
        return min(found)
    return go(0, 0, 0)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([0, 4, 4, 4, 8, 8, 8, 12, 1, 5, 9, 6, 10, 3, 7, 11, 15]), max_size=14), st.sampled_from([1, 2, 3, 5, 256]))
def test_alignment_is_the_cheapest(codes, segment):
    assert repair._align(bytes(codes), segment) == _plain(bytes(codes))


def test_long_alignments():
    rng = random.Random(2)
    for n in (120, 400):
        codes = bytes(rng.choices(range(16), [1, 0, 0, 0, 8, 1, 1, 1, 8, 1, 1, 1, 0, 0, 0, 0], k=n))
        assert repair.align(codes) == repair.align(codes, 64) == _plain(codes)


def _conversations():
    """Long and short conversations with null ids, turns, roles and texts, repeats, ties and odd roles."""
    rng, rows = random.Random(5), []
    for c in [None, *range(25)]:
        for t in range(rng.choice([1, 3, 10, 60]) if c else 150):
            for _ in range(2 if rng.random() < 0.04 else 1):
                role = rng.choice(["user", "assistant"]) if rng.random() < 0.3 else ["user", "assistant"][t % 2]
                role = rng.choice(["system", "tool", None, "", "User"]) if rng.random() < 0.05 else role
                text = rng.choice(["Hi.", "ok", "a\nb. ", "x. \t\n", " ", None, "é?", ""]) if rng.random() < 0.1 else f"text {rng.random()}."
                rows.append((c, None if rng.random() < 0.02 else t + 5 * (rng.random() < 0.02), role, text))
    return rows


def test_repair_agrees_with_sql(spark, tmp_path):
    rows = _conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.coalesce(1).write.parquet(str(tmp_path / "c"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/c/*.parquet')")
    names = ["conv_id", *repair.COUNTS, "audit", "repaired_sha256"]
    want = sorted(con.execute(f"SELECT {', '.join(names)} FROM ({queries.ORACLES['op13_conversations']})").fetchall(), key=repr)
    for segment in (256, 7):
        got = repair.repair(df.withColumn("head", df.turn).withColumn("same", df.text).repartition(7), segment).select(*names).collect()
        assert sorted(map(tuple, got), key=repr) == want
    assert any("R" in r[7] for r in want) and any(r[4] for r in want)


def test_inserted_turns_are_written():
    """No cheapest audit of whole conversations needs an insert; segments and other costs may."""
    head = {**dict.fromkeys(repair.COUNTS, 0), "audit": "KIRDI"}
    batch = pa.RecordBatch.from_pylist([
        {"conv_id": 1, "head": head, "role": None, "text": None, "times": None},
        {"conv_id": 1, "head": None, "role": "system", "text": "a", "times": 1},
        {"conv_id": 1, "head": None, "role": "user", "text": "b\nc", "times": 2}])
    got = [r for b in repair._digests(iter([batch])) for r in b.to_pylist()]
    want = "system:a\nuser:\nassistant:b\nc\nuser:"
    assert [r["repaired_sha256"] for r in got] == [hashlib.sha256(want.encode()).hexdigest()]


def test_repair_of_nothing(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert repair.repair(spark.createDataFrame([], schema)).collect() == []
    import zlib
    gone = next(c for c in range(500) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = repair.repair(spark.createDataFrame([(gone, 0, "user", "Hi.")], schema)).collect()
    assert tuple(got[0]) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    copies = repair.repair(spark.createDataFrame([(1, 1, "user", "Hi there.")] * 500, schema)).collect()
    assert len(copies[0]["audit"]) in (500, 1000) and copies[0]["duplicate"] + copies[0]["blank"] >= 499
