"""Operators that learn from the corpus, the pipeline, and how all is registered."""

import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from conftest import SMALL
from llm_helpers import DOCS, ODD

import __spark_entry__ as E
import corpus_pipeline
from archspark.llm import quality, toxicity

MEDIUM = "/root/testdata/sf0.1"


def test_all_operators_and_the_pipeline_are_registered():
    names = [n for n in E.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in E.queries()


def test_nothing_else_imports_the_subpackage():
    import pathlib
    root = pathlib.Path(E.__file__).parent
    for p in (root / "archspark").rglob("*.py"):
        if "llm" not in p.parts:
            assert "archspark.llm" not in p.read_text(), p


# ------------------------------------------------------------------ toxicity (4)

def test_toxicity_on_held_out_rows(spark):
    rows = spark.read.parquet(f"{MEDIUM}/labels.parquet").join(E.queries()["op4_toxicity"](spark, MEDIUM), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    ranked = sorted(held, key=lambda r: r.score)
    at = [i for i, r in enumerate(ranked) if r.toxic == 1]
    n1, n0 = len(at), len(ranked) - len(at)
    assert (sum(at) - n1 * (n1 - 1) / 2) / (n1 * n0) > 0.93
    caught = [r for r in held if r.predicted]
    assert sum(r.toxic for r in caught) / len(caught) > 0.95 and sum(r.toxic for r in caught) / n1 > 0.85


def test_toxicity_learns_nothing_from_fold_zero(spark, frame):
    docs = [(i, ("vile " if i % 2 else "kind ") * 8 + f"word{i}") for i in range(400)]
    labels = [(i, i % 2) for i in range(400)]
    flipped = [(i, (1 - t) if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t in labels]
    got = [sorted(tuple(r) for r in toxicity.score_toxicity(frame(docs, "doc_id long, text string"), frame(x, "doc_id long, toxic int")).collect())
           for x in (labels, flipped)]
    assert got[0] == got[1]
    assert all(p == i % 2 for i, _, p, _ in got[0])


def test_toxicity_knows_individually_rare_expressions(frame):
    words = "the of and to in is that for it as was with be by on not he his but at are this have from or".split()
    docs = [(i, " ".join([words[(i * 7 + j * j) % 25] for j in range(20)] + [("vile" if i % 2 else "kind") + "abcdefghijklmnopqrstuvwxyz"[(i // 2) % 26] + "xyzuvw"[(i // 52) % 6]]))
            for i in range(1200)]  # 156 expressions of each class, each in about 4 texts
    got = toxicity.score_toxicity(frame(docs, "doc_id long, text string"), frame([(i, i % 2) for i in range(1200)], "doc_id long, toxic int"))
    held = [r for r in got.collect() if r.held_out]
    assert sum(r.predicted for r in held if r.doc_id % 2) > 0.85 * sum(r.doc_id % 2 for r in held)
    assert sum(r.predicted for r in held if r.doc_id % 2 == 0) < 0.1 * len(held)


def test_toxicity_continuation_counts_of_the_whole_corpus(frame):
    texts = ["san francisco san francisco", "in San Francisco", "the end of the day", "of the end", None, "", "zebra francisco"] * 3
    vocab = {b"francisco": 1, b"the": 2, b"end": 3, b"absent": 4}
    left = {}
    for t in texts:
        w = toxicity.words_of(t)
        for a, b in zip([None, *w], w):
            left.setdefault(b, set()).add(a)
    others = sum(len(v) for w, v in left.items() if w not in vocab)
    docs = frame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert toxicity.shared_counts(docs, vocab, "text").tolist() == [others, *(len(left.get(w, ())) for w in vocab)]
    assert not toxicity.shared_counts(docs.limit(0), {}, "text").any()


def test_toxicity_weighs_both_classes_the_same():
    class Given(toxicity.Model):  # the texts are their own ratios
        def ids(self, texts):
            return np.array(texts, float), np.ones(len(texts))

        def fit(self, z):
            pass

        def mean_ratio(self, ids, n):
            return ids

    model = Given([])
    model.seen = model.counts = model.base = None
    # at ratio 0 are 6 of 20 toxic texts and 14 of 200 ordinary ones: likelier among the toxic, though fewer
    texts = [1.0] * 14 + [0.0] * 6 + [1.0] * 6 + [0.0] * 14 + [-1.0] * 180
    model.choose(texts, [1] * 20 + [0] * 200)
    assert [s >= 0.5 for s in model.score([1.0, 0.0, -1.0])] == [True, True, False]


def test_toxicity_odd_rows(frame):
    none = frame([], "doc_id long, toxic int")
    for labels in (none, frame([(2, None), (4, 1), (4, 0), (None, 1), (3, 7)], "doc_id long, toxic int")):
        got = toxicity.score_toxicity(frame(ODD, DOCS), labels, carry=("text",)).collect()
        assert len(got) == len(ODD) and not any(r.predicted for r in got if r.doc_id in (1, 2, 3))
    assert not toxicity.score_toxicity(frame([], DOCS), none).collect()


# ------------------------------------------------------------------ quality (8)

def brute_counts(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = Counter(windows)
    hit = {j for i, x in enumerate(windows) if n[x] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_quality_counts_against_brute_force(spark):
    got = {r.doc_id: r for r in E.queries()["op8_quality"](spark, SMALL).collect()}
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        x, want = got[r.doc_id], brute_counts(r.text)
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == want
        assert x.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and (not x.kept or not x.base_failed)


def test_quality_odd_counts(frame):
    texts = [None, "", "a", "a b c d e f g h a b c d e f g h", "x " * 30, "\n\n a\n a\n\t\na", "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8", "#*|<> é😀 &"]
    got = {r.doc_id: r for r in quality.statistics(frame([(i, t, None, None, 0) for i, t in enumerate(texts)], DOCS)).collect()}
    for i, t in enumerate(texts):
        x = got[i]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == brute_counts(t), t


def test_quality_keeps_good_and_drops_junk(spark):
    rows = E.queries()["op8_quality"](spark, MEDIUM).join(spark.read.parquet(f"{MEDIUM}/labels.parquet"), "doc_id").filter("NOT base_failed").collect()
    good, junk = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.995 * len(good)
    assert sum(not r.kept for r in junk) >= 0.95 * len(junk)


def test_quality_small_and_empty_tables(frame):
    assert len(quality.quality(frame(ODD, DOCS)).collect()) == len(ODD)
    assert not quality.quality(frame([], DOCS)).collect()
    same = [(i, "one two three four five six seven eight nine ten " * 1 + "a b c d e f g h i j k", None if i % 2 else "en", "s", 0) for i in range(130)]
    assert all(r.kept for r in quality.quality(frame(same, DOCS)).collect())  # ties: every distance is zero


# ------------------------------------------------------------------ pipeline

def test_pipeline_against_its_operators(spark):
    q = E.queries()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SMALL).collect()}
    toxic = {r.doc_id for r in q["op4_toxicity"](spark, SMALL).filter("predicted = 1").collect()}
    left = docs.filter(~docs.doc_id.isin(toxic)) if toxic else docs
    fps = {r.doc_id: r for r in q["op5_simhash"](spark, SMALL).collect()}
    ids = sorted(r.doc_id for r in left.select("doc_id").collect())
    root = {i: i for i in ids}
    for a in ids:  # smallest id among the near ones, over chains
        for b in ids:
            if b < a and (int(fps[a].fingerprint, 16) ^ int(fps[b].fingerprint, 16)).bit_count() <= 3:
                ra, rb = a, b
                while root[ra] != ra:
                    ra = root[ra]
                while root[rb] != rb:
                    rb = root[rb]
                root[max(ra, rb)] = min(ra, rb)
    kept = {i for i in ids if root[i] == i}
    dirty = {r.doc_id for r in q["op1_decontamination"](spark, SMALL).filter("contaminated").collect()}
    assert set(got) == kept - dirty
    whole = {r.doc_id: r for r in q["op2_sentencepiece"](spark, SMALL).collect()}
    secret = {r.doc_id for r in q["op7_secrets"](spark, SMALL).filter("spans <> ''").collect()}
    for i, r in got.items():
        assert (r.ids_sha256 == whole[i].ids_sha256) == (i not in secret)


def test_pipeline_stages_on_odd_rows_and_clashing_columns(spark, frame):
    extra = "doc_id long, text string, lang string, source string, n_chars long, score double, items string, __row long, spans int, n_words string"
    for rows in ([(*r, 0.5, "x", 1, 2, None) for r in ODD], []):
        docs = frame(rows, extra)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SMALL)
            out.collect()
            if name != "sentencepiece":
                assert out.columns == docs.columns


@pytest.fixture()
def frame(spark):
    return spark.createDataFrame


# ------------------------------------------------------------------ oracles

@pytest.mark.parametrize("name", [n for n in sorted(E.oracle_sql()) if re.match(r"op\d+_", n)])
def test_oracle_columns(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    assert sorted(con.sql(E.oracle_sql()[name]).columns) == sorted(E.queries()[name](spark, SMALL).columns)
