"""Layer classification, roll-up and propagation.

The taxonomy is data: ``taxonomy(layer, priority, keyword)``, ``layers(layer, priority)``
and ``path_rules(grp, ord, layer, pattern, points)``. Dictionaries are constant-sized,
so the keyword match is a broadcast nested-loop join guarded by a row-count check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archspark.functions import vocab
from archspark.functions.paths import basename
from archspark.operators.frames import fresh as _fresh
from archspark.operators.joins import contains_join
from archspark.session import cut_lineage

MAX_DICTIONARY_ROWS = 100_000


def rule_hits(files: DataFrame, text, rules: DataFrame, block_rows: int = MAX_DICTIONARY_ROWS) -> DataFrame:
    """Files x the regex rules that match ``text``. Regex rules have no equi-join form, so the rule
    table is held against the files in blocks of about ``block_rows`` rules, each small enough to be
    broadcast; one block is the usual case."""
    blocks = max(1, -(-rules.count() // block_rows))
    part = F.pmod(F.xxhash64(*rules.columns), F.lit(blocks))
    out = None
    for i in range(blocks):
        hits = _fresh(files).join(F.broadcast(_fresh(rules.where(part == i))), F.regexp_like(text, F.col("pattern")))
        out = hits if out is None else out.unionByName(hits)
    return out


def layer_contributions(files: DataFrame, taxonomy: DataFrame, path_rules: DataFrame | None = None,
                        db_files: DataFrame | None = None, route_files: DataFrame | None = None,
                        key: str = "repo_id", db_points=vocab.DATABASE_FILE_POINTS,
                        route_points=vocab.ROUTE_HANDLER_POINTS) -> DataFrame:
    """J4 parts as rows (key, path, layer, points)."""
    f = files.select(key, "path").distinct()
    lp, ln = F.lower(F.col("path")), F.lower(basename("path"))
    fl = f.select(key, "path", lp.alias("_lp"), ln.alias("_ln"))
    kw = contains_join(fl, "_lp", taxonomy.select("layer", "keyword"), "keyword", small="needles")  # D12
    parts = [kw.select(key, "path", "layer",
                       F.when(F.col("_ln").contains(F.col("keyword")), 6).otherwise(3).alias("points"))]
    if path_rules is not None:
        hits = rule_hits(f, lp, path_rules.select("grp", "ord", "layer", "pattern", "points"))
        w = Window.partitionBy(key, "path", "grp").orderBy("ord")
        parts.append(hits.withColumn("_r", F.row_number().over(w)).where("_r = 1")
                     .select(key, "path", "layer", "points"))
    if db_files is not None:
        parts.append(db_files.select(key, "path").distinct().join(f, [key, "path"], "left_semi")
                     .select(key, "path", F.lit(db_points[0]).alias("layer"), F.lit(db_points[1]).alias("points")))
    if route_files is not None:
        parts.append(route_files.select(key, "path").distinct().join(f, [key, "path"], "left_semi")
                     .select(key, "path", F.lit(route_points[0]).alias("layer"),
                             F.lit(route_points[1]).alias("points")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def layer_scores(contributions: DataFrame, key: str = "repo_id") -> DataFrame:
    """(key, path, layer, score): summed points per layer (only layers with points)."""
    return contributions.groupBy(key, "path", "layer").agg(F.sum("points").cast("bigint").alias("score"))


def assign_layers(files: DataFrame, scores: DataFrame, layers: DataFrame, key: str = "repo_id",
                  fallback: str = vocab.FALLBACK_LAYER) -> DataFrame:
    """best layer per file, strict maximum so the first-declared layer wins ties;
    the fallback layer with score 0 when nothing scored. -> (key, path, layer, score)."""
    pri = F.broadcast(layers.select("layer", "priority"))  # a dictionary; shuffled, a layer's files would meet in one task
    best = (scores.where("score > 0").join(pri, "layer")
            .groupBy(key, "path")
            .agg(F.max_by(F.struct("layer", "score"),
                          F.struct(F.col("score"), (-F.col("priority")).alias("np"))).alias("b")))
    return (files.select(key, "path").distinct().join(best, [key, "path"], "left")
            .select(key, "path", F.coalesce(F.col("b.layer"), F.lit(fallback)).alias("layer"),
                    F.coalesce(F.col("b.score"), F.lit(0)).cast("bigint").alias("score")))


def classify(files, taxonomy, layers, path_rules=None, db_files=None, route_files=None, key="repo_id",
             fallback=vocab.FALLBACK_LAYER) -> DataFrame:
    c = layer_contributions(files, taxonomy, path_rules, db_files, route_files, key)
    return assign_layers(files, layer_scores(c, key), layers, key, fallback)


def propagate(assignments: DataFrame, edges: DataFrame, layers: DataFrame, rounds: int = 2,
              key: str = "repo_id", fallback: str = vocab.FALLBACK_LAYER, weak_below: int = 4,
              propagated_score: int = 4) -> DataFrame:
    """H3: files in the fallback layer or scoring below 4 take the majority layer of their
    import neighbours (imports and importers, duplicates kept) when it has >= 2 votes or
    the file has exactly one neighbour; the new score is 4.

    Rounds are synchronous (every file sees the previous round), which makes the result
    independent of visiting order. Vote ties go to the first-declared layer.
    """
    e = cut_lineage(edges.select(key, "src", "dst"))  # reused every round: materialise once
    nb = (e.select(key, F.col("src").alias("path"), F.col("dst").alias("nb"))
          .unionAll(e.select(key, F.col("dst").alias("path"), F.col("src").alias("nb"))))
    n_nb = nb.groupBy(key, "path").agg(F.count(F.lit(1)).alias("n_nb"))
    pri = F.broadcast(layers.select("layer", "priority"))  # as in ``assign_layers``
    cur = cut_lineage(assignments.select(key, "path", "layer", "score"))
    for _ in range(rounds):
        labels = _fresh(cur.select(key, F.col("path").alias("nb"), F.col("layer").alias("nl")))
        votes = (nb.join(labels, [key, "nb"]).where(F.col("nl") != fallback)
                 .groupBy(key, "path", F.col("nl").alias("layer")).agg(F.count(F.lit(1)).alias("votes"))
                 .join(pri, "layer"))
        w = Window.partitionBy(key, "path").orderBy(F.col("votes").desc(), F.col("priority"))
        top = (votes.withColumn("_r", F.row_number().over(w)).where("_r = 1")
               .join(_fresh(n_nb), [key, "path"])
               .where((F.col("votes") >= 2) | (F.col("n_nb") == 1))
               .select(key, "path", F.col("layer").alias("new_layer")))
        eligible = (F.col("layer") == fallback) | (F.col("score") < weak_below)
        cur = (cur.join(top, [key, "path"], "left")
               .select(key, "path",
                       F.when(eligible & F.col("new_layer").isNotNull(), F.col("new_layer"))
                       .otherwise(F.col("layer")).alias("layer"),
                       F.when(eligible & F.col("new_layer").isNotNull(), F.lit(propagated_score))
                       .otherwise(F.col("score")).cast("bigint").alias("score")))
        cur = cut_lineage(cur)
    return cur


def rollup(assignments: DataFrame, layers: DataFrame, key: str = "repo_id") -> DataFrame:
    """E13 + F7: per layer: file count and confidence = clamp(round(share scored > 0), .60, .98)
    as an integer percentage; rank by file count (ties: declaration order). Membership stays
    in the long ``assignments`` table instead of a nested list."""
    pri = layers.select("layer", "priority")  # equi join; AQE broadcasts it after measuring
    g = (assignments.groupBy(key, "layer")
         .agg(F.count(F.lit(1)).alias("n_files"),
              F.sum(F.when(F.col("score") > 0, 1).otherwise(0)).alias("scored")))
    g = g.withColumn("confidence_pct",
                     F.expr("least(greatest((200 * scored + n_files) div (2 * n_files), 60), 98)"))
    w = Window.partitionBy(key).orderBy(F.col("n_files").desc(), F.col("priority"))
    return (g.join(pri, "layer").withColumn("rank", F.row_number().over(w).cast("bigint"))
            .select(key, "layer", "n_files", "confidence_pct", "rank"))
