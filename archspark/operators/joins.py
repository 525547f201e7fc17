"""Join helpers shared by the operators: size-checked broadcast and exact substring joins.

A substring join ("text contains needle") has no hash key. Three exact ways, by counted sizes:

* a handful of needles is broadcast into a nested-loop join, which stays in the JVM;
* dictionaries of up to ``MAX_PATTERN_CHARS`` characters become one Aho-Corasick automaton, broadcast as its
  patterns; texts pass through it in Arrow batches, in time that follows their length and their hits,
  not the number of needles, without a shuffle;
* beyond that needles and texts meet on a three-character piece (``gram_join``), in equi joins that Spark shuffles
  like any others (and AQE splits if a key is hot).
"""

from __future__ import annotations

from collections.abc import Iterator
from importlib.util import find_spec

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from archspark.operators.frames import fresh as _fresh

#: needles that a nested loop takes; rows of a broadcast dictionary; characters of an automaton's patterns (a node
#: each at most, some 200 MB in a worker) and of its longest one
FEW_NEEDLES, MAX_BROADCAST_ROWS, MAX_PATTERN_CHARS = 64, 100_000, 2_000_000


def bounded_broadcast(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """Broadcast ``df`` only when a count proves it small; otherwise hand it back unchanged."""
    n = df.count()
    return (F.broadcast(df), True) if n <= max_rows else (df, False)


def _grams(text, short: bool):
    """Distinct three-character pieces of a text (and all shorter ones if ``short``)."""
    n = F.length(text)
    at = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1))), lambda i: F.substring(text, i, F.lit(k)))
    return F.array_distinct(F.concat(at(1), at(2), at(3)) if short else at(3))


def gram_join(needles: DataFrame, needle: str, texts: DataFrame, text: str, on: list[str]) -> DataFrame:
    """Distinct (on, needle, text) with the text holding the needle, both in the same ``on`` group.

    One plan for every size: each needle is looked up under that of its three-character pieces (a needle of one
    or two characters is its own piece) which the fewest texts have, a text under all of its pieces;
    the candidates that share a piece are verified. Empty needles never match.

    Texts travel once, not with each of their pieces: these carry the text's hash, and texts of one hash are verified
    alike. The joins are merge joins: a shuffle of needles is small before their pieces are cut, so Spark would take the
    pieces for small as well and gather them in the driver to broadcast them.
    """
    n = needles.select(*on, F.col(needle).alias("_n")).where(F.length("_n") > 0).distinct()
    pieces = n.select(*on, "_n", F.explode(F.when(F.length("_n") < 3, F.array("_n")).otherwise(_grams(F.col("_n"), False))).alias("_g"))
    t = texts.select(*on, F.col(text).alias("_t")).distinct().withColumn("_id", F.xxhash64("_t"))
    looked = t.select(*on, "_id", F.explode(_grams(F.col("_t"), True)).alias("_g"))
    common = looked.groupBy(*on, "_g").agg(F.count(F.lit(1)).alias("_c"))
    # a piece that no text has decides as well: such a needle matches nothing
    key = (pieces.join(_fresh(common).hint("merge"), [*on, "_g"], "left").groupBy(*on, "_n")
           .agg(F.min(F.struct(F.coalesce("_c", F.lit(0)).alias("_c"), F.col("_g").alias("_g"))).alias("_m"))
           .where("_m._c > 0").select(*on, "_n", F.col("_m._g").alias("_g")))
    near = looked.join(key.hint("merge"), [*on, "_g"]).select(*on, "_n", "_id").distinct()
    hits = _fresh(t).join(near.hint("merge"), [*on, "_id"]).where(F.col("_t").contains(F.col("_n")))
    return hits.select(*on, F.col("_n").alias(needle), F.col("_t").alias(text))


def dictionary(needles: DataFrame, needle: str, max_chars: int = MAX_PATTERN_CHARS) -> list[str] | None:
    """The distinct non-empty needles, if a count shows that an automaton can hold them; else None."""
    distinct = needles.select(F.col(needle).alias("_n")).where(F.length("_n") > 0).distinct()
    if find_spec("ahocorasick") is None or (distinct.agg(F.sum(F.length("_n"))).first()[0] or 0) > max_chars:
        return None
    return sorted(r[0] for r in distinct.collect())


def automaton_join(texts: DataFrame, text_col: str, patterns: list[str], name: str) -> DataFrame:
    """``texts`` with a column ``name``: one row for each distinct pattern that the text holds. Nulls hold none."""
    sent = texts.sparkSession.sparkContext.broadcast(patterns)
    at = texts.columns.index(text_col)
    schema = T.StructType([*texts.schema.fields, T.StructField(name, T.StringType())])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for p in sent.value:
            machine.add_word(p, p)
        machine.make_automaton()
        for batch in batches:
            rows, found = [], []
            for i, text in enumerate(batch.column(at).to_pylist()):
                hits = {p for _, p in machine.iter(text)} if text and sent.value else ()
                rows += [i] * len(hits)
                found += hits
            out = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(found, pa.string())], names=names)

    return texts.mapInArrow(run, schema)


def contains_join(texts: DataFrame, text_col: str, needles: DataFrame, needle_col: str,
                  small: str = "needles", max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Every (texts row, needles row) pair with ``texts[text_col]`` containing
    ``needles[needle_col]`` (case as given; empty needles never match here).

    ``small`` names the side to try broadcasting ("needles" or "texts").
    """
    needles = needles.where(F.length(needle_col) > 0)
    side = needles if small == "needles" else texts
    b, ok = bounded_broadcast(side, min(FEW_NEEDLES, max_broadcast_rows) if small == "needles" else max_broadcast_rows)
    if ok:
        if small == "needles":
            return texts.join(b, F.col(text_col).contains(F.col(needle_col)))
        return needles.join(b, F.col(text_col).contains(F.col(needle_col)))
    if small == "needles" and (patterns := dictionary(needles, needle_col, MAX_PATTERN_CHARS if max_broadcast_rows else -1)) is not None:
        return automaton_join(texts, text_col, patterns, needle_col).join(_fresh(needles), needle_col)
    hits = gram_join(needles, needle_col, texts, text_col, [])
    return texts.join(hits.hint("merge"), text_col).join(_fresh(needles).hint("merge"), needle_col)
