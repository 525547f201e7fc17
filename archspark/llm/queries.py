"""Registered queries of the training-data operators: thin bindings to the driver tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archspark.llm import (conversation_repair, decontaminate, piece_codec, pii, prefix_hash, quality, secrets, sharding, simhash,
                           token_counts, token_store, toxicity, whitening)
from archspark.llm.common import table

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    REGISTRY[fn.__name__] = fn
    return fn


@query
def op1_decontamination(spark, sf_dir):
    hits = decontaminate.contained_windows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return hits.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                       F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

ORACLES["op1_decontamination"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item, w[p:p + 9] AS g FROM (
    SELECT item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS p FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len(g) AS k FROM win),
grams AS (SELECT doc_id, k, p, w[p:p + k - 1] AS g FROM (
    SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, lens WHERE len(w) >= k)),
occ AS (SELECT doc_id, k, p, item FROM grams JOIN win USING (g)),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (
    SELECT doc_id, unnest(range(p, p + k)) AS q FROM (SELECT DISTINCT doc_id, k, p FROM occ)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""


@query
def op2_sentencepiece(spark, sf_dir):
    return piece_codec.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op3_token_counts(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op4_toxicity(spark, sf_dir):
    scored = toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


@query
def op5_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=3).drop("group_fp")


def _joined(spans, kinds):
    """kind:start:end of an array of (start, k, end), comma-joined."""
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["k"]], x["start"], x["end"])), ",")


def _count(spans, k):
    return F.size(F.filter(spans, lambda x: x["k"] == k)).cast("long")


@query
def op6_pii(spark, sf_dir):
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    kinds = (*pii.KINDS, "term")
    return found.select("doc_id", *(_count("base", k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS)),
                        F.sha2(_joined("base", kinds), 256).alias("base_sha256"), _joined("spans", kinds).alias("spans"))


@query
def op7_secrets(spark, sf_dir):
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["k"] < len(secrets.KINDS))
    kinds = (*secrets.KINDS, "random")
    return found.select("doc_id", *(_count("spans", k).alias(f"n_{name}") for k, name in enumerate(secrets.KINDS)),
                        F.sha2(_joined(base, kinds), 256).alias("base_sha256"), _joined("spans", kinds).alias("spans"))


@query
def op8_quality(spark, sf_dir):
    return quality.quality(table(spark, sf_dir, "documents")).drop("distance")


@query
def op9_sharding(spark, sf_dir):
    rows = sharding.assign_shards(table(spark, sf_dir, "documents"), n_shards=24)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"))


@query
def op10_token_store(spark, sf_dir):
    return token_store.store_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


@query
def op11_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=4)


@query
def op12_fingerprints(spark, sf_dir):
    return prefix_hash.fingerprint_edits(table(spark, sf_dir, "documents"))


@query
def op13_conversations(spark, sf_dir):
    return conversation_repair.repair(table(spark, sf_dir, "conversations"))


def _least(*options: str) -> str:
    """Least (cost, audit, turns) of the options that exist."""
    return f"list_sort([{', '.join(options)}], 'ASC', 'NULLS LAST')[1]"


def _step(state: str, cost: str, letter: str, turn: str | None) -> str:
    turns = f"list_append({state}.t, {turn})" if turn else f"{state}.t"
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {turns}}} END"


def _stay(state: str, want: str) -> str:
    """The row kept or rerolled where the grammar wants ``want`` after ``state``."""
    name = {"u": "user", "a": "assistant"}.get(want)
    keep = _step(state, "(CASE WHEN broken THEN 5 ELSE 0 END)", "K", "role || ':' || text")
    change = _step(state, "(CASE WHEN broken THEN 6 ELSE 1 END)", "R", f"'{name}:' || text") if name else "NULL"
    return f"CASE WHEN NOT forced THEN CASE WHEN ini = '{want}' THEN {keep} ELSE {change} END END"


_CONV_STATE = "STRUCT(c BIGINT, a VARCHAR, t VARCHAR[])"

# the same minimum over the four states of the grammar, row by row, instead of an alignment to each length
ORACLES["op13_conversations"] = f"""
WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
drawn AS (SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(k, ''), lambda c: ascii(c)::BIGINT)),
        lambda h, b: list_reduce([xor(h, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384))),
    4294967295) % 20 AS f FROM keyed),
damaged AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)) AS copy,
    CASE WHEN f = 1 THEN '' WHEN f = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM drawn WHERE f <> 0),
placed AS (SELECT *, left(role, 1) AS ini, row_number() OVER w AS i,
    NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
    NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS open FROM damaged
    WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text), copy)),
judged AS (SELECT *, blank OR again AS forced, open AND NOT blank AND NOT again AS broken,
    ini || lead(ini) OVER (PARTITION BY conv_id ORDER BY i) AS pair FROM placed),
counted AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS n,
    count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (broken) AS truncated,
    count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id),
dp AS (SELECT conv_id, 0::BIGINT AS i, {{'c': 0, 'a': '', 't': []}}::{_CONV_STATE} AS q0, NULL::{_CONV_STATE} AS q1,
    NULL::{_CONV_STATE} AS q2, NULL::{_CONV_STATE} AS q3 FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, {_step('q0', '2', 'D', None)}, {_least(_step('q1', '2', 'D', None), _stay('q0', 's'))},
    {_least(_step('e2', '2', 'D', None), *(_stay(q, 'u') for q in ('q0', 'q1', 'e3')))},
    {_least(_step('e3', '2', 'D', None), _stay('e2', 'a'))}
  FROM (SELECT *, {_least('q3', _step('e2', '5', 'I', "'assistant:'"))} AS e3 FROM (
    SELECT dp.conv_id, judged.i, q0, q1, q3, role, text, ini, forced, broken,
      {_least('q2', *(_step(q, '5', 'I', "'user:'") for q in ('q0', 'q1', 'q3')))} AS e2
    FROM dp JOIN judged ON dp.conv_id IS NOT DISTINCT FROM judged.conv_id AND judged.i = dp.i + 1))),
ended AS (SELECT conv_id, i, {_least('q0', 'q3', _step('e2', '5', 'I', "'assistant:'"))} AS best FROM (
    SELECT *, {_least('q2', *(_step(q, '5', 'I', "'user:'") for q in ('q0', 'q1', 'q3')))} AS e2 FROM dp))
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
    coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, best.c::BIGINT AS cost, best.a AS audit,
    sha256(array_to_string(best.t, chr(10))) AS repaired_sha256
FROM ended e LEFT JOIN counted c ON e.conv_id IS NOT DISTINCT FROM c.conv_id WHERE e.i = coalesce(c.n, 0)
"""
