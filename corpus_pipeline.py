"""Corpus pipeline over ``documents``: toxicity, near-duplicates, decontamination, secrets, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the
last return the columns of ``documents``. Stages carry text through narrow passes; only the
near-duplicate stage may shuffle it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archspark.llm import decontaminate, piece_codec, secrets, simhash, toxicity
from archspark.llm.common import table
from archspark.session import cut_lineage


def _apart(docs: DataFrame):
    """``docs`` with its other columns under names no operator uses, and the way back."""
    names = {c: f"__column_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    back = [F.col(names.get(c, c)).alias(c) for c in docs.columns]
    return docs.withColumnsRenamed(names), lambda df: df.select(*back)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models reject go."""
    rows, back = _apart(docs)
    return back(toxicity.score_toxicity(rows, table(spark, sf_dir, "labels"), carry=tuple(rows.columns)).filter("predicted = 0"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (3-word shingles, up to 3 differing bits)."""
    rows, back = _apart(docs)
    return back(simhash.one_of_each_group(rows, shingle=3, radius=3))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of ten benchmark words go."""
    rows, back = _apart(docs)
    hits = decontaminate.contained_windows(rows, table(spark, sf_dir, "benchmark"), window=10, carry=tuple(rows.columns))
    return back(hits.filter("n_hit = 0"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; n_chars follows the text."""
    rows, back = _apart(docs)
    found = secrets.find_secrets(rows, carry=tuple(c for c in rows.columns if c != "text"))
    changed = back(found.withColumnRenamed("redacted", "text").drop("spans"))
    if "n_chars" not in docs.columns:
        return changed
    kind = docs.schema["n_chars"].dataType
    chars = F.when(F.col("text").contains(secrets.MARK), F.length("text").cast(kind)).otherwise(F.col("n_chars"))
    return changed.withColumn("n_chars", chars).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every remaining text, with digests of the ids and of the decoded text."""
    return piece_codec.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=("ids",))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("sentencepiece", encode_pieces),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what a stage returns is written once, then read by the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut_lineage(docs)
    return docs
