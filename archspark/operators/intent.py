"""Goal -> concepts -> target layers -> ranked candidate files.

Goals are a table ``(goal_id, goal)``; every goal is answered in the same job.

Concept hits (a concept is a substring of a file path) are found by one pass of the
lower-cased paths through an automaton of the distinct concept vocabulary, so no
goal x file product is formed. Files without a hit for a goal differ only by a
per-file base score and by whether their layer is a target of the goal; per layer
the best ``k`` files under each of those variants are the only ones that can
reach a goal's top-``k`` (any other file has ``k`` files of its own layer ahead of
it). They are attached to goals by an equi join on the layer, broadcasting that
bounded candidate list.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archspark.functions import vocab
from archspark.functions.paths import basename, extension
from archspark.operators.frames import fresh as _fresh
from archspark.operators.joins import automaton_join, contains_join, dictionary
from archspark.session import cut_lineage

WORD_RX = r"[\p{L}\p{N}_]+"


def goal_words(goals: DataFrame, stop_words: DataFrame) -> DataFrame:
    """Words of each goal: Unicode word tokens longer than one character, minus stop words."""
    w = goals.select("goal_id", F.explode(F.regexp_extract_all(F.lower("goal"), F.lit(WORD_RX), 0)).alias("concept"))
    return (w.where(F.length("concept") > 1)
            .join(stop_words.select(F.col("word").alias("concept")), "concept", "left_anti")
            .select("goal_id", "concept"))


def dictionary_hits(goals: DataFrame, concepts: DataFrame) -> DataFrame:
    """(goal_id, keyword) for dictionary keywords contained in the lower-cased goal."""
    g = goals.select("goal_id", F.lower(F.col("goal")).alias("_lg"))
    return contains_join(g, "_lg", concepts.select("keyword").distinct(), "keyword").select("goal_id", "keyword")


def goal_concepts(goals: DataFrame, concepts: DataFrame, stop_words: DataFrame) -> DataFrame:
    """Distinct (goal_id, concept) = expansions of contained keywords + goal words."""
    hits = dictionary_hits(goals, concepts)
    expanded = hits.join(concepts.select("keyword", "concept"), "keyword").select("goal_id", "concept")
    return expanded.unionByName(goal_words(goals, stop_words)).distinct()


def goal_summary(goals: DataFrame, concepts: DataFrame, stop_words: DataFrame) -> DataFrame:
    """(goal_id, n_concepts, direct_hits, confidence_pct) for goals with concepts."""
    gc = goal_concepts(goals, concepts, stop_words).groupBy("goal_id").agg(F.count(F.lit(1)).alias("n_concepts"))
    hits = dictionary_hits(goals, concepts).groupBy("goal_id").agg(F.count(F.lit(1)).alias("direct_hits"))
    return (gc.join(hits, "goal_id", "left")
            .select("goal_id", F.col("n_concepts").cast("bigint"),
                    F.coalesce("direct_hits", F.lit(0)).cast("bigint").alias("direct_hits"))
            .withColumn("confidence_pct", F.least(F.lit(70) + 8 * F.col("direct_hits"), F.lit(98)).cast("bigint")))


def target_layers(goal_concepts_df: DataFrame, layer_vocab: DataFrame,
                  fallback: str = vocab.FALLBACK_LAYER) -> DataFrame:
    """(goal_id, layer): layers whose vocabulary meets the goal's concepts, else the fallback."""
    hit = (goal_concepts_df.join(layer_vocab.select("layer", "concept"), "concept")
           .select("goal_id", "layer").distinct())
    none = (goal_concepts_df.select("goal_id").distinct().join(hit.select("goal_id").distinct(), "goal_id", "left_anti")
            .select("goal_id", F.lit(fallback).alias("layer")))
    return hit.unionByName(none)


def file_concepts(vocab_df: DataFrame, files: DataFrame, key: str = "repo_id") -> DataFrame:
    """(key, path, concept, in_name) for every vocabulary concept that is a substring of the
    lower-cased path: by one automaton of the vocabulary, or, beyond its counted bound, by an equi join on the
    substrings of the lengths that concepts have (no nested loop over concepts x files either way)."""
    lp = files.select(key, "path", F.lower("path").alias("lp"))
    words = vocab_df.select("concept").distinct()
    patterns = dictionary(words, "concept")
    if patterns is not None:
        hits = automaton_join(lp, "lp", patterns, "concept").select(key, "path", "concept").distinct()
    else:
        hits = contains_join(lp, "lp", words, "concept", max_broadcast_rows=0).select(key, "path", "concept").distinct()
    return hits.select(key, "path", "concept", F.lower(basename("path")).contains(F.col("concept")).alias("in_name"))


# numerator of the exact score over the per-goal denominator 3 * d1 * d2 (see candidate_scores)
_NUM = ("greatest(75 * least(p, d1) * d2, CASE WHEN floor22 THEN 66 * d1 * d2 ELSE 0 END)"
        " + 75 * least(q, d2) * d1 + b3 * d1 * d2")
_SCORE = "least(greatest(num div (3 * d1 * d2), 5), 100)"


def _b3(t: int):
    """Three times the goal-independent part of a score for layer-target flag ``t``."""
    return ((F.lit(20 * t) + F.when(F.col("dep"), 15 + 5 * t).otherwise(0)) * 3
            + F.least(F.col("resp_x"), F.lit(15)) * 2)


#: groups of a posting block; step of the goal-independent points by which blocks are told apart (a third of a point)
BLOCK_GROUPS, POINT_STEP = 256, 45


def posting_blocks(groups: DataFrame, key: str, block_groups: int = BLOCK_GROUPS) -> DataFrame:
    """Posting lists of the concepts in blocks of groups that share all that bounds their scores.

    -> (key, concept, layer, special, n_sig, n_name, u_0, u_1, members): a group of the block matches at most n_sig
    concepts, n_name of them in names, and has at most u_0 or u_1 goal-independent points; members are (gid, in_name).
    """
    up = lambda c: (F.ceil(F.col(c) / POINT_STEP) * POINT_STEP).cast("long")
    shape = [key, "concept", "layer", "special", "n_sig", "n_name", "u_0", "u_1"]
    p = groups.select("gid", key, "layer", "special", F.size("sig").alias("n_sig"), F.size(F.filter("sig", lambda c: c["in_name"])).alias("n_name"),
                      up("b3_0").alias("u_0"), up("b3_1").alias("u_1"), F.explode("sig").alias("c"))
    p = p.select("gid", F.col("c.in_name").alias("in_name"), F.col("c.concept").alias("concept"), *[c for c in shape if c != "concept"])
    n = p.groupBy(*shape).agg(F.ceil(F.count(F.lit(1)) / F.lit(block_groups)).alias("_k"))
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"n.{c}")) for c in shape]
    dealt = p.alias("p").join(_fresh(n).alias("n"), reduce(lambda a, b: a & b, same)).select(
        *[F.col(f"p.{c}").alias(c) for c in shape], F.pmod(F.xxhash64("p.gid"), F.col("n._k")).alias("_b"), F.struct("p.gid", "p.in_name").alias("x"))
    return dealt.groupBy(*shape, "_b").agg(F.collect_list("x").alias("members")).drop("_b")


def scored_groups(gc: DataFrame, m: DataFrame, tl: DataFrame, groups: DataFrame, k: int, key: str) -> DataFrame:
    """Matches of goals and groups that can be among a goal's ``k`` best -> (goal_id, gid, key, layer, special, p, q, matched).

    A threshold algorithm: (1) of each concept and repository the ``k`` groups with the most concepts are scored
    exactly; the goal's k-th best score among them can only rise. (2) Goals meet posting blocks, not groups, on the
    concept; a block whose greatest possible score is below that threshold is left out with all its groups
    (equal scores stay, the path decides). A block's bound is the same under each of its groups' concepts, so
    the matches of a group that stays are complete.
    """
    wide = Window.partitionBy(key, "concept").orderBy(F.col("n_name").desc(), F.col("n_sig").desc(), F.col("b3_1").desc(), "gid")
    heads = (groups.select("gid", key, F.size("sig").alias("n_sig"), F.size(F.filter("sig", lambda c: c["in_name"])).alias("n_name"),
                           "b3_1", F.explode("sig.concept").alias("concept"))
             .withColumn("_r", F.row_number().over(wide)).where(F.col("_r") <= k).select("gid", "concept"))
    own = gc.groupBy("goal_id").agg(F.collect_set("concept").alias("cs"))
    seeds = gc.select("goal_id", "concept").join(_fresh(heads), "concept").select("goal_id", "gid").distinct()
    seeds = (seeds.join(_fresh(groups), "gid").join(_fresh(own), "goal_id").join(_fresh(m), "goal_id").join(_fresh(tl), ["goal_id", "layer"], "left"))
    hit = F.filter("sig", lambda c: F.array_contains("cs", c["concept"]))
    seeds = (seeds.select("goal_id", key, "d1", "d2", F.size(hit).alias("p"), F.size(F.filter(hit, lambda c: c["in_name"])).alias("q"),
                          (F.col("special") & F.col("has_ui")).alias("floor22"),
                          F.when(F.col("t") == 1, F.col("b3_1")).otherwise(F.col("b3_0")).alias("b3"))
             .withColumn("num", F.expr(_NUM)).withColumn("score", F.expr(_SCORE)))
    w = Window.partitionBy("goal_id", key).orderBy(F.col("score").desc())
    least = (seeds.select("goal_id", key, "score").withColumn("_r", F.row_number().over(w)).where(F.col("_r") == k)
             .select("goal_id", key, F.col("score").alias("least")))
    met = (gc.select("goal_id", "concept").join(_fresh(posting_blocks(groups, key)), "concept")
           .join(_fresh(m), "goal_id").join(_fresh(tl), ["goal_id", "layer"], "left").join(_fresh(least), ["goal_id", key], "left"))
    bound = (met.withColumn("p", F.least("m", "n_sig")).withColumn("q", F.least("m", "n_name"))
             .withColumn("floor22", F.col("special") & F.col("has_ui"))
             .withColumn("b3", F.when(F.col("t") == 1, F.col("u_1")).otherwise(F.col("u_0")))
             .withColumn("num", F.expr(_NUM)).withColumn("most", F.expr(_SCORE)))
    kept = bound.where(F.col("most") >= F.coalesce("least", F.lit(0))).select("goal_id", key, "layer", "special", "concept", F.explode("members").alias("x"))
    return (kept.groupBy("goal_id", F.col("x.gid").alias("gid"), key, "layer", "special")
            .agg(F.count(F.lit(1)).alias("p"), F.sum(F.col("x.in_name").cast("int")).alias("q"),
                 F.slice(F.array_sort(F.collect_list("concept")), 1, 3).alias("matched")))


def layer_heads(f: DataFrame, k: int, key: str = "repo_id") -> DataFrame:
    """(key, path, layer) of each layer's best ``k`` files under each (in target?, ui floor?) variant."""
    orders = []
    for t in (0, 1):
        for u in (False, True):
            s = F.col(f"b3_{t}") + (F.when(F.col("special"), 66).otherwise(0) if u else F.lit(0))
            points = F.least(F.greatest(F.floor(s / 3), F.lit(5)), F.lit(100))
            orders.append(F.row_number().over(Window.partitionBy(key, "layer").orderBy(points.desc(), F.col("path"))))
    # a limit for each variant: Spark then keeps the k best of each task before a layer's files meet in one
    firsts = [f.withColumn("_r", o).where(F.col("_r") <= k).select(key, "path", "layer") for o in orders]
    return reduce(DataFrame.unionByName, firsts).distinct()


def candidate_scores(goals: DataFrame, files: DataFrame, file_facts_df: DataFrame, assignments: DataFrame,
                     concepts: DataFrame, stop_words: DataFrame, layer_vocab: DataFrame, layer_names: list[str],
                     k: int = 10, key: str = "repo_id", fallback: str = vocab.FALLBACK_LAYER) -> DataFrame:
    """J7 + J8 + F3: the top ``k`` files per (goal, repository), exactly.

    score = clamp(trunc(path + name + layer + dependency + responsibility), 5, 100) as in
    the analysed tool, from an exact integer numerator over a per-goal denominator;
    ranking is by this integer score, then path.

    Plan, without a goal x file product:
    1. files -> contained concepts (substring equi join); files with the same concept
       signature, layer, floor-folder flag and goal-independent points form a group and
       have the same score for every goal;
    2. goals x groups through the concept key, by a threshold algorithm over blocks of posting lists
       (``scored_groups``); per goal the groups are ranked by their best file and only the top ``k``
       groups are expanded (a file in the top k belongs to a group whose best file is in the top k);
    3. files without a hit compete through the per-layer best ``k`` files under each
       (layer-target, floor) variant.
    -> (goal_id, key, path, layer, score, rank, reasons)
    """
    gc = cut_lineage(goal_concepts(goals, concepts, stop_words))
    m = cut_lineage(gc.groupBy("goal_id").agg(
        F.count(F.lit(1)).alias("m"), F.max(F.col("concept").isin(*vocab.UI_FLOOR_CONCEPTS)).alias("has_ui"))
        .withColumn("d1", F.greatest(F.lit(1), F.col("m") - 2))
        .withColumn("d2", F.greatest(F.lit(1), F.col("m") - 4)))
    tl = _fresh(target_layers(gc, layer_vocab, fallback).select("goal_id", "layer", F.lit(1).alias("t")))
    f = (files.select(key, "path")
         .join(file_facts_df.select(key, "path", "function_count", "class_count", "import_count",
                                    "imported_by_count"), [key, "path"], "left")
         .join(assignments.select(key, "path", "layer"), [key, "path"], "left")
         .select(key, "path", F.coalesce("layer", F.lit(fallback)).alias("layer"),
                 ((F.coalesce("import_count", F.lit(0)) + F.coalesce("imported_by_count", F.lit(0))) > 0).alias("dep"),
                 (F.coalesce("function_count", F.lit(0)) + 2 * F.coalesce("class_count", F.lit(0))
                  + F.coalesce("imported_by_count", F.lit(0))).alias("resp_x"),
                 F.coalesce("imported_by_count", F.lit(0)).alias("fan_in"),
                 F.lower("path").rlike("|".join(vocab.UI_FLOOR_FOLDERS)).alias("special")))
    f = cut_lineage(f.withColumn("b3_0", _b3(0)).withColumn("b3_1", _b3(1)))

    # 1. concept signatures and groups
    fc = file_concepts(gc.select("concept").distinct(), f.select(key, "path"), key)
    sig = fc.groupBy(key, "path").agg(F.array_sort(F.collect_set(F.struct("concept", "in_name"))).alias("sig"))
    gid = F.sha2(F.to_json(F.struct(F.col(key), "sig", "layer", "special", "b3_0", "b3_1")), 256)
    fg = cut_lineage(f.join(sig, [key, "path"]).withColumn("gid", gid))
    groups = fg.groupBy("gid").agg(F.first("sig").alias("sig"), F.first("layer").alias("layer"), F.first("special").alias("special"),
                                   F.first(key).alias(key), F.first("b3_0").alias("b3_0"), F.first("b3_1").alias("b3_1"))
    groups = cut_lineage(groups)
    by_path = Window.partitionBy("gid").orderBy("path")  # the files of a group score alike: its first k by path
    gheads = cut_lineage(fg.withColumn("r", F.row_number().over(by_path)).where(F.col("r") <= k)
                         .select("gid", key, "path", "layer", "special", "b3_0", "b3_1", "r"))

    # 2. goals x groups, as far as their bounds reach the goal's k-th best, ranked by each group's best file; expand the top k
    gg = scored_groups(gc, m, tl, groups, k, key)
    gg = (gg.join(m, "goal_id").join(tl, ["goal_id", "layer"], "left")
          .withColumn("t", F.coalesce("t", F.lit(0)))
          .withColumn("floor22", F.col("special") & F.col("has_ui")))
    best = _fresh(gheads.where(F.col("r") == 1).select("gid", "path", "b3_0", "b3_1"))
    gb = (gg.join(best, "gid")
          .withColumn("b3", F.when(F.col("t") == 1, F.col("b3_1")).otherwise(F.col("b3_0")))
          .withColumn("num", F.expr(_NUM)).withColumn("score", F.expr(_SCORE)))
    wg = Window.partitionBy("goal_id", key).orderBy(F.col("score").desc(), F.col("path"))
    top_groups = (gb.withColumn("_g", F.row_number().over(wg)).where(F.col("_g") <= k)
                  .select("goal_id", "gid", "t", "p", "q", "matched"))
    hit_pairs = (top_groups.join(_fresh(gheads.select("gid", key, "path")), "gid")
                 .select("goal_id", key, "path", "p", "q", "matched"))

    # 3. base candidates: per layer, the best k files under each (in target?, ui floor?) variant
    lheads = cut_lineage(layer_heads(f, k, key))
    n_heads = lheads.count()  # at most 4k rows per (repository, layer): bounded
    goal_layers = m.select("goal_id", F.explode(F.array(*[F.lit(x) for x in layer_names])).alias("layer"))
    base_pairs = (goal_layers.join(F.broadcast(lheads) if n_heads <= 1_000_000 else lheads, "layer")
                  .select("goal_id", key, "path", F.lit(0).cast("bigint").alias("p"),
                          F.lit(0).cast("bigint").alias("q"), F.array().cast("array<string>").alias("matched")))

    pairs = (hit_pairs.unionByName(base_pairs)
             .groupBy("goal_id", key, "path")
             .agg(F.max("p").alias("p"), F.max("q").alias("q"), F.max("matched").alias("matched")))
    scored = (pairs.join(m, "goal_id").join(_fresh(f), [key, "path"])
              .join(tl, ["goal_id", "layer"], "left")
              .withColumn("t", F.coalesce("t", F.lit(0)))
              .withColumn("floor22", F.col("special") & F.col("has_ui"))
              .withColumn("b3", F.when(F.col("t") == 1, F.col("b3_1")).otherwise(F.col("b3_0")))
              .withColumn("num", F.expr(_NUM))
              .withColumn("score", F.expr(_SCORE).cast("bigint")))
    w = Window.partitionBy("goal_id", key).orderBy(F.col("score").desc(), F.col("path"))
    top = scored.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)
    lname = F.lower(basename("path"))
    ext = extension("path")
    reasons = F.array_compact(F.array(
        F.when(F.col("t") == 1, F.concat(F.lit("Located inside "), F.col("layer"))),
        F.when(ext.isin(".tsx", ".jsx"), F.lit("React TSX component")).when(ext == ".py", F.lit("Python module")),
        F.when(reduce(lambda a, b: a | b, [lname.contains(w) for w in vocab.UI_NAME_WORDS]),
               F.lit("Contains UI rendering logic")),
        F.when(F.col("fan_in") > 2, F.lit("Referenced by core system components")),
        F.when(F.size("matched") > 0, F.concat(F.lit("Matches intent concepts: "), F.array_join("matched", ", ")))))
    reasons = F.when(F.size(reasons) == 0, F.array(F.lit("File path matched concepts in goal request."))) \
        .otherwise(reasons)
    return top.select("goal_id", key, "path", "layer", "score", "rank", reasons.alias("reasons"))


def first_keyword_match(prompts: DataFrame, change_map: DataFrame) -> DataFrame:
    """the first prompt word found in the map, else the first map keyword (declaration
    order) contained in the normalised prompt; null when none -> (prompt_id, target)."""
    norm = F.regexp_replace(F.lower("prompt"), r"[^\p{L}\p{N}_\s]", "")
    p = prompts.select("prompt_id", norm.alias("norm"))
    words = p.select("prompt_id", F.posexplode(F.split(F.trim("norm"), r"\s+")).alias("pos", "keyword"))
    cm = change_map.select("keyword", "ord", "target")
    by_word = (words.join(cm, "keyword").groupBy("prompt_id")
               .agg(F.min_by("target", "pos").alias("t1")))
    by_sub = (contains_join(p, "norm", cm, "keyword").groupBy("prompt_id")
              .agg(F.min_by("target", "ord").alias("t2")))
    return (p.select("prompt_id").join(by_word, "prompt_id", "left").join(by_sub, "prompt_id", "left")
            .select("prompt_id", F.coalesce("t1", "t2").alias("target")))


def prompt_file_cascade(prompts: DataFrame, files: DataFrame, keyword_map: DataFrame, default_keys: DataFrame,
                        key: str = "repo_id") -> DataFrame:
    """one file per prompt asked of a repository, from the first tier that yields one:

    1. the first map keyword (declaration order) contained in the prompt whose file exists,
       or else a file whose path contains that file name or the keyword;
    2. a file whose lower path, or a non-empty dot-separated part of it, is in the prompt;
    3. a file containing one of the default keys (in key order);
    4. any file.
    Within a tier the smallest path wins (the analysed tool uses directory-walk order).
    prompts (prompt_id, key, prompt) -> (prompt_id, key, target, tier)
    """
    p = prompts.select("prompt_id", F.col(key).alias("_pk"), F.lower("prompt").alias("norm"))
    f = files.select(F.col(key).alias("_fk"), "path", F.lower("path").alias("lpath"))
    same = F.col("_pk") == F.col("_fk")
    kws = contains_join(p, "norm", keyword_map.select("keyword", "ord", "filename"), "keyword")
    exact = (kws.join(f, same & (F.col("path") == F.col("filename")))
             .select("prompt_id", "_pk", "path", F.lit(1).alias("tier"), (F.col("ord") * 2).alias("sub")))
    needles = (keyword_map.select("ord", F.col("filename").alias("needle"))
               .unionByName(keyword_map.select("ord", F.col("keyword").alias("needle"))).distinct())
    # of files alike for a prompt the smallest path wins: one a keyword, or a part, meets the prompts, not all of them
    loose = (contains_join(f, "path", needles, "needle").groupBy("_fk", "ord").agg(F.min("path").alias("path"))
             .join(kws.select("prompt_id", "_pk", "ord"), "ord").where(same)
             .select("prompt_id", "_pk", "path", F.lit(1).alias("tier"), (F.col("ord") * 2 + 1).alias("sub")))
    parts = (f.select("_fk", "path", F.explode(F.array_union(F.array("lpath"), F.split("lpath", r"\."))).alias("part"))
             .where(F.length("part") > 0).groupBy("_fk", "part").agg(F.min("path").alias("path")))
    t2 = (contains_join(p, "norm", parts, "part").where(same)
          .select("prompt_id", "_pk", "path", F.lit(2).alias("tier"), F.lit(0).alias("sub")))
    t3 = (contains_join(f, "path", default_keys.select("dkey", "ord"), "dkey")
          .select("_fk", "path", F.col("ord").alias("sub"), F.lit(3).alias("tier")))
    t4 = f.groupBy("_fk").agg(F.min("path").alias("path")).select("_fk", "path", F.lit(0).alias("sub"),
                                                                  F.lit(4).alias("tier"))
    w0 = Window.partitionBy("_fk").orderBy("tier", "sub", "path")
    fallback = (t3.unionByName(t4).withColumn("_r", F.row_number().over(w0)).where("_r = 1")
                .select(F.col("_fk").alias("_pk"), "path", "tier", "sub"))
    per_prompt = p.select("prompt_id", "_pk").join(fallback, "_pk").select("prompt_id", "_pk", "path", "tier", "sub")
    allc = exact.unionByName(loose).unionByName(t2).unionByName(per_prompt)
    w = Window.partitionBy("prompt_id", "_pk").orderBy("tier", "sub", "path")
    return (allc.withColumn("_r", F.row_number().over(w)).where("_r = 1")
            .select("prompt_id", F.col("_pk").alias(key), F.col("path").alias("target"),
                    F.col("tier").cast("bigint").alias("tier")))
