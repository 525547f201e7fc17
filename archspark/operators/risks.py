"""Risk detectors R1-R6, their union G1, and the substring joins D10/D11 (with F5).

The substring joins ("the test path contains the file stem") meet on a three-character piece
of the stem within the repository (``joins.gram_join``): an equi join at every size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archspark.functions import vocab
from archspark.functions.paths import stem
from archspark.operators.frames import fresh as _fresh
from archspark.operators.joins import gram_join


def missing_tests(file_facts_df: DataFrame, test_paths: DataFrame, key: str = "repo_id",
                  top: int = vocab.MISSING_TEST_TOP, min_bytes: int = vocab.MISSING_TEST_MIN_BYTES,
                  same_repo: bool = True, fold_case: bool = False) -> DataFrame:
    """R6 + D10 + F5: .py files (no 'test'/'setup' in the path, size > min_bytes) whose stem
    no test path contains (case as given: stem is not lower-cased, the path is);
    the ``top`` largest per repository. -> (key, file, size, rank)."""
    src = (file_facts_df.where((F.col("extension") == ".py") & ~F.lower("path").contains("test")
                               & ~F.lower("path").contains("setup") & (F.col("size") > min_bytes))
           .select(key, F.col("path").alias("file"), "size",
                   (F.lower(stem("path")) if fold_case else stem("path")).alias("_stem")))
    on = [key] if same_repo else []
    hits = gram_join(src, "_stem", test_paths.select(*on, F.lower("path").alias("_tpath")), "_tpath", on)
    # an empty stem is part of every path
    tested = hits.select(*on, "_stem").unionByName(
        test_paths.select(*on, F.lit("").alias("_stem"))).distinct()
    cand = src.join(tested, [*on, "_stem"], "left_anti")
    w = Window.partitionBy(key).orderBy(F.col("size").desc(), F.col("file"))
    return (cand.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= top)
            .select(key, "file", "size", "rank"))


def affected_tests(files: DataFrame, test_paths: DataFrame, key: str = "repo_id",
                   same_repo: bool = True) -> DataFrame:
    """(key, file, test) where the lower-cased test path contains the file's stem."""
    src = files.select(key, F.col("path").alias("file"), stem("path").alias("_stem"))
    on = [key] if same_repo else []
    tests = test_paths.select(*on, F.col("path").alias("test"), F.lower("path").alias("_tpath"))
    hits = gram_join(src, "_stem", tests, "_tpath", on).unionByName(
        tests.select(*on, F.lit("").alias("_stem"), "_tpath").distinct())  # an empty stem is part of every path
    return (src.join(hits, [*on, "_stem"]).join(tests, [*on, "_tpath"])
            .select(key, "file", "test").distinct())


def _risk(df: DataFrame, key: str, detector: int, title, file_col: str, severity, evidence_type: str, *more: str):
    return df.select(key, F.lit(detector).cast("bigint").alias("detector"),
                     (title if not isinstance(title, str) else F.lit(title)).alias("title"),
                     F.col(file_col).cast("string").alias("file"),
                     (severity if not isinstance(severity, str) else F.lit(severity)).alias("severity"),
                     F.lit(vocab.RISK_CONFIDENCE[detector]).alias("confidence"),
                     F.lit(evidence_type).alias("evidence_type"), *more)


def risk_oversized(ff: DataFrame, key: str = "repo_id") -> DataFrame:
    """R1."""
    hit = ff.where((F.col("extension") == ".py") & ((F.col("size") > vocab.OVERSIZED_BYTES)
                                                     | (F.col("function_count") > vocab.OVERSIZED_FUNCTIONS)))
    lp = F.lower("path")
    title = F.when(lp.contains("controller") | lp.contains("window"), vocab.RISK_CONTROLLER) \
        .otherwise(vocab.RISK_OVERSIZED)
    sev = F.when(F.col("size") > vocab.CRITICAL_BYTES, "Critical").otherwise("High")
    return _risk(hit, key, 1, title, "path", sev, "complexity")


def risk_cycles(components: DataFrame, key: str = "repo_id") -> DataFrame:
    """R2: one risk per cyclic component, reported on its smallest file."""
    c = components.where(F.col("node") == F.col("component"))
    return _risk(c, key, 2, vocab.RISK_CYCLE, "component", "High", "dependency")


def cycle_path(cycle="cycle"):
    """A cycle's nodes in order, the first one again at the end, joined by arrows."""
    names = F.col(cycle).cast("array<string>")
    return F.array_join(F.array_append(names, names[0]), vocab.CYCLE_ARROW)


def risk_cycle_paths(cycles: DataFrame, key: str = "repo_id") -> DataFrame:
    """R2: one risk per simple cycle (``graph.simple_cycles``), on its smallest file, with its path."""
    c = cycles.select(key, F.col("cycle")[0].alias("_first"), cycle_path().alias("path"), "length")
    return _risk(c, key, 2, vocab.RISK_CYCLE, "_first", "High", "dependency", "path", "length")


def cycle_evidence(cycles: DataFrame, key: str = "repo_id") -> DataFrame:
    """R2: the evidence sentences of each cycle -> (key, file, path, ord, evidence)."""
    c = cycles.select(key, F.col("cycle")[0].cast("string").alias("file"), cycle_path().alias("path"))
    sentences = F.array(F.concat(F.lit(vocab.CYCLE_EVIDENCE), F.col("path")), F.lit(vocab.CYCLE_EFFECT))
    return c.select(key, "file", "path", F.posexplode(sentences).alias("ord", "evidence")).withColumn("ord", F.col("ord").cast("long"))


def risk_deep(depths: DataFrame, key: str = "repo_id", threshold: int = vocab.DEEP_CHAIN) -> DataFrame:
    """R3."""
    return _risk(depths.where(F.col("depth") > threshold), key, 3, vocab.RISK_DEEP, "node", "Medium", "dependency")


def risk_routes(ff: DataFrame, key: str = "repo_id") -> DataFrame:
    """R4."""
    return _risk(ff.where(F.col("route_count") > vocab.ROUTE_CONCENTRATION), key, 4, vocab.RISK_ROUTES,
                 "path", "High", "route")


def risk_database(ff: DataFrame, facts: DataFrame, edges: DataFrame, key: str = "repo_id") -> DataFrame:
    """Route files that call cursor/execute/commit methods or import > 1 database-like files."""
    routed = ff.where(F.col("route_count") > 0).select(key, "path")
    meth = (facts.select(key, "path", F.explode("classes").alias("c"))
            .select(key, "path", F.explode("c.methods").alias("m"))
            .where(F.lower("m").rlike("cursor|execute|commit")).select(key, "path").distinct()
            .withColumn("_direct", F.lit(True)))
    dbi = (edges.select(key, F.col("src").alias("path"), "dst").distinct()
           .where(F.lower("dst").rlike("database|db|sql"))
           .groupBy(key, "path").agg(F.count(F.lit(1)).alias("_dbi")))
    hit = (routed.join(meth, [key, "path"], "left").join(dbi, [key, "path"], "left")
           .where(F.col("_direct").isNotNull() | (F.coalesce("_dbi", F.lit(0)) > 1)))
    return _risk(hit, key, 5, vocab.RISK_DB, "path", "High", "database")


def risk_missing_tests(missing: DataFrame, key: str = "repo_id") -> DataFrame:
    """R6 rows from ``missing_tests``."""
    return _risk(missing, key, 6, vocab.RISK_TESTS, "file", "Medium", "test")


def union_risks(*parts: DataFrame) -> DataFrame:
    """G1: detectors in order (the ``detector`` column keeps the reference order)."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
