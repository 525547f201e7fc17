"""Dimension tables built from the fixed vocabularies (all tiny and bounded).

They are constants (tens of rows), so broadcasting them is safe at any scale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from archspark.functions import vocab


def taxonomy(spark: SparkSession) -> DataFrame:
    """(layer, priority, keyword): one row per layer keyword; priority = declaration order."""
    rows = [(layer, i, kw) for i, (layer, kws) in enumerate(vocab.LAYERS, start=1) for kw in kws]
    return spark.createDataFrame(rows, "layer string, priority int, keyword string")


def layers(spark: SparkSession) -> DataFrame:
    """(layer, priority) for every layer including the fallback."""
    rows = [(layer, i) for i, (layer, _) in enumerate(vocab.LAYERS, start=1)]
    return spark.createDataFrame(rows, "layer string, priority int")


def path_rules(spark: SparkSession) -> DataFrame:
    """(grp, ord, layer, pattern, points): first match per group wins."""
    rows = [("path", o, layer, rx, pts) for o, layer, rx, pts in vocab.PATH_RULES]
    rows += [("ext", o, layer, rx, pts) for o, layer, rx, pts in vocab.EXT_RULES]
    return spark.createDataFrame(rows, "grp string, ord int, layer string, pattern string, points int")


def concepts(spark: SparkSession) -> DataFrame:
    """(keyword, ord, concept) exploded concept dictionary."""
    rows = [(kw, i, c) for i, (kw, cs) in enumerate(vocab.CONCEPT_MAP, start=1) for c in cs]
    return spark.createDataFrame(rows, "keyword string, ord int, concept string")


def layer_vocab(spark: SparkSession) -> DataFrame:
    """(layer, concept): a concept in the vocabulary selects the layer as a target."""
    rows = [(layer, c) for ls, cs in vocab.LAYER_VOCAB for layer in ls for c in cs]
    return spark.createDataFrame(rows, "layer string, concept string")


def stop_words(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w,) for w in vocab.STOP_WORDS], "word string")


def change_map(spark: SparkSession) -> DataFrame:
    rows = [(kw, i, target) for i, (kw, target) in enumerate(vocab.CHANGE_MAP, start=1)]
    return spark.createDataFrame(rows, "keyword string, ord int, target string")


def advice(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(vocab.ADVICE, "ord int, title string, advice string")


def file_keyword_map(spark: SparkSession) -> DataFrame:
    rows = [(kw, i, f) for i, (kw, f) in enumerate(vocab.FILE_KEYWORD_MAP, start=1)]
    return spark.createDataFrame(rows, "keyword string, ord int, filename string")


def default_target_keys(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, i) for i, k in enumerate(vocab.DEFAULT_TARGET_KEYS, start=1)],
                                 "dkey string, ord int")
