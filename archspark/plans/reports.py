"""Answers built from the derived tables.

Every answer is a table for *all* files / goals / prompts at once; nested lists that
could grow with the data are kept as long tables or counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archspark.functions import vocab
from archspark.functions.paths import is_entry_point
from archspark.operators import graph
from archspark.operators.frames import fresh as _fresh
from archspark.session import cut_lineage


def change_impact(ff: DataFrame, assignments: DataFrame, risks_df: DataFrame | None,
                  cochange: DataFrame | None, key: str = "repo_id") -> DataFrame:
    """K3 + J11 for every file: counts of direct / reverse / co-change dependencies and
    risk score = clamp(trunc(4 out + 6 in + 2 fn + size/1024 + 20 risks), 10, 100)."""
    out = ff.join(assignments.select(key, "path", "layer"), [key, "path"], "left")
    if risks_df is not None:
        rc = risks_df.groupBy(key, F.col("file").alias("path")).agg(F.count(F.lit(1)).alias("n_risks"))
        out = out.join(rc, [key, "path"], "left")
    else:
        out = out.withColumn("n_risks", F.lit(0))
    if cochange is not None:
        cc = (cochange.where("pct > 0").groupBy(key, F.col("a").alias("path"))
              .agg(F.count(F.lit(1)).alias("cochange_count")))
        out = out.join(cc, [key, "path"], "left")
    else:
        out = out.withColumn("cochange_count", F.lit(0))
    out = out.fillna(0, ["n_risks", "cochange_count"])
    score = F.expr("least(greatest((1024 * (4 * import_count + 6 * imported_by_count + 2 * function_count "
                   "+ 20 * n_risks) + size) div 1024, 10), 100)")
    return out.select(key, "path", F.coalesce("layer", F.lit(vocab.FALLBACK_LAYER)).alias("layer"),
                      F.col("import_count").alias("direct_count"), F.col("imported_by_count").alias("reverse_count"),
                      F.col("cochange_count").cast("bigint"), F.col("n_risks").cast("bigint"),
                      score.cast("bigint").alias("risk_score"))


def ownership(assignments: DataFrame, edges: DataFrame | None, routes: DataFrame | None,
              key: str = "repo_id") -> DataFrame:
    """K4 + D16-D18 for every file: layer, number of other files in the layer, connected
    entry points (in the layer or importing a file of it) and routes served by the layer.

    Same-layer relations are answered by per-layer counts, never by pairing files."""
    a = assignments.select(key, "path", "layer")
    per_layer = a.groupBy(key, "layer").agg(F.count(F.lit(1)).alias("n_layer"))
    entries = a.where(is_entry_point("path")).select(key, F.col("path").alias("entry"), F.col("layer").alias("elayer"))
    conn = entries.select(key, "entry", F.col("elayer").alias("layer"))
    if edges is not None:
        via = (edges.select(key, F.col("src").alias("entry"), F.col("dst").alias("path"))
               .join(entries.select(key, "entry"), [key, "entry"], "left_semi")
               .join(_fresh(a), [key, "path"]).select(key, "entry", "layer"))
        conn = conn.unionByName(via)
    eps = conn.distinct().groupBy(key, "layer").agg(F.count(F.lit(1)).alias("entry_points"))
    out = a.join(per_layer, [key, "layer"]).join(eps, [key, "layer"], "left")
    if routes is not None:
        r = (routes.select(key, F.split("handler", ":").getItem(0).alias("path"))
             .join(_fresh(a), [key, "path"]).groupBy(key, "layer").agg(F.count(F.lit(1)).alias("routes")))
        out = out.join(r, [key, "layer"], "left")
    else:
        out = out.withColumn("routes", F.lit(0))
    return out.select(key, "path", "layer", (F.col("n_layer") - 1).cast("bigint").alias("related_files"),
                      F.coalesce("entry_points", F.lit(0)).cast("bigint").alias("entry_points"),
                      F.coalesce("routes", F.lit(0)).cast("bigint").alias("routes"))


def plan_complexity(goals: DataFrame) -> DataFrame:
    """Goal words -> Low / Medium / High (first rule that matches)."""
    g = F.lower("goal")
    expr = None
    for words, level in vocab.PLAN_COMPLEXITY:
        cond = F.lit(False)
        for w in words:
            cond = cond | g.contains(w)
        expr = F.when(cond, level) if expr is None else expr.when(cond, level)
    return goals.select("goal_id", expr.otherwise("Low").alias("complexity"))


def plan_level(complexity_col: str = "complexity", risks_col: str = "n_risks"):
    """High or > 2 risks -> CRITICAL; Medium or > 0 risks -> HIGH; else LOW."""
    c, r = F.col(complexity_col), F.col(risks_col)
    return F.when((c == "High") | (r > 2), "CRITICAL").when((c == "Medium") | (r > 0), "HIGH").otherwise("LOW")


def checklist(goals: DataFrame, targets: DataFrame, tests: DataFrame, key: str = "repo_id") -> DataFrame:
    """K7: verification items per goal and repository -> (goal_id, key, ord, item).

    targets (goal_id, key, target); tests (goal_id, key, test) for the goal's affected files."""
    each = ["goal_id", key]
    g = goals.join(targets, "goal_id")
    low = F.lower("goal")
    auth = low.contains("auth") | low.contains("jwt") | low.contains("login")
    db = low.contains("postgres") | low.contains("cosmos") | low.contains("database") | low.contains("db")
    t = F.col("target")
    items = (F.when(auth, F.array(F.concat(F.lit("Assert password hashes are salted and not exposed in `"), t, F.lit("`.")),
                                  F.lit("Verify JWT middleware intercepts unauthorized requests.")))
             .when(db, F.array(F.concat(F.lit("Verify database connection pool initializes successfully from `"), t,
                                        F.lit("`.")), F.lit("Bench-test partitioned document query latency.")))
             .otherwise(F.array(F.concat(F.lit("Verify static import trees before applying structural changes in `"),
                                         t, F.lit("`.")))))
    first = g.select(*each, F.posexplode(items).alias("ord", "item"))
    tt = tests.select(*each, "test").distinct()
    runs = tt.select(*each, F.lit(10).alias("ord"),
                     F.concat(F.lit("Run test suite command: `pytest "), F.col("test"), F.lit("`")).alias("item"))
    default = (targets.select(*each).distinct().join(tt.select(*each).distinct(), each, "left_anti")
               .select(*each, F.lit(10).alias("ord"),
                       F.lit("Run default regression test suite: `pytest` or `python -m unittest`").alias("item")))
    return first.unionByName(runs).unionByName(default)


def recommendations(risks_df: DataFrame, advice: DataFrame, key: str = "repo_id") -> DataFrame:
    """K6: risk rows joined to the (bounded) advice dictionary."""
    return (risks_df.join(advice.select("ord", "title", "advice"), "title")
            .select(key, "file", "title", "ord", "advice"))


def what_if(prompt_targets: DataFrame, radius: DataFrame, key: str = "repo_id",
            suggestions: list[str] | None = None) -> DataFrame:
    """Prompt -> mapped target -> blast-radius summary and level; unmapped prompts get the
    sorted suggestion list. prompt_targets (prompt_id, key, target)."""
    impact = graph.global_impact(radius, key)
    out = (prompt_targets.join(impact, [key, "target"], "left")
           .select("prompt_id", key, "target",
                   F.coalesce("global_impact_score", F.lit(0)).cast("bigint").alias("global_impact_score"),
                   F.coalesce("modules_affected", F.lit(0)).cast("bigint").alias("modules_affected")))
    sugg = ", ".join(sorted(set(suggestions or [t for _, t in vocab.CHANGE_MAP])))
    return out.select("*", F.when(F.col("target").isNull(), F.lit(None))
                      .otherwise(graph.risk_level()).alias("risk_level"),
                      F.when(F.col("target").isNull(), F.lit(sugg)).alias("suggestions"))


def repo_brief(profile: DataFrame, cov: DataFrame | None, risks_df: DataFrame | None,
               layer_rollup: DataFrame | None, key: str = "repo_id") -> DataFrame:
    """K1: one row per repository."""
    out = profile.select(key, "project_type", "layout", "n_files")
    if cov is not None:
        out = out.join(cov.select(key, "confidence_pct", "overall_pct"), key, "left")
    if risks_df is not None:
        out = out.join(risks_df.groupBy(key).agg(F.count(F.lit(1)).alias("n_risks")), key, "left")
    if layer_rollup is not None:
        out = out.join(layer_rollup.groupBy(key).agg(F.count(F.lit(1)).alias("n_layers")), key, "left")
    return out


def agent_context(candidates: DataFrame, goals: DataFrame, companion_fn, risks_df: DataFrame | None,
                  routes: DataFrame | None, test_paths: DataFrame | None, key: str = "repo_id",
                  min_score: int = 10) -> DataFrame:
    """K2 + K9 (+ C13, D11, D14, D15, J13, K7): one row per goal and repository.

    The recommended target is the repository's best candidate; below ``min_score`` the pair
    gets status 'unavailable', as does a goal without candidates anywhere (no repository). Affected
    files = target + ranked companions; their risks, routes and tests are counted within the
    repository. ``test_paths`` without the key column is a suite shared by all repositories.
    ``companion_fn(targets)`` returns companion rows restricted to those targets.
    """
    each = ["goal_id", key]
    best = cut_lineage(candidates.where(F.col("rank") == 1).select(
        "goal_id", key, F.col("path").alias("target"), F.col("layer").alias("target_layer"),
        F.col("score").alias("target_score")))  # one row per goal, reused by every branch below
    ok = best.where(F.col("target_score") >= min_score)
    # a few rows a target, read by every branch below
    comp = cut_lineage(companion_fn(ok.select(key, "target").distinct()).select(key, "target", "file"))
    affected = (ok.select("goal_id", key, "target", F.col("target").alias("file"))
                .unionByName(ok.join(comp.select(key, "target", "file"), [key, "target"])
                             .select("goal_id", key, "target", "file")))

    n_comp = comp.groupBy(key, "target").agg(F.count(F.lit(1)).alias("n_companions"))
    out = ok.join(n_comp, [key, "target"], "left")
    if risks_df is not None:
        r = (affected.join(_fresh(risks_df.select(key, "file", "title")), [key, "file"])
             .groupBy(*each).agg(F.count(F.lit(1)).alias("n_risks")))
        out = out.join(r, each, "left")
    else:
        out = out.withColumn("n_risks", F.lit(0))
    if routes is not None:
        rf = routes.select(key, F.split("handler", ":").getItem(0).alias("file"))
        rr = affected.join(_fresh(rf), [key, "file"]).groupBy(*each).agg(F.count(F.lit(1)).alias("n_routes"))
        out = out.join(rr, each, "left")
    else:
        out = out.withColumn("n_routes", F.lit(0))
    tests = None
    if test_paths is not None:
        from archspark.operators.risks import affected_tests  # local import keeps module deps one-way
        files = affected.select(key, F.col("file").alias("path")).distinct()
        at = affected_tests(files, test_paths, key=key, same_repo=key in test_paths.columns)
        tests = (affected.select(*each, "file").join(at, [key, "file"])
                 .select(*each, "test").distinct())
        out = out.join(tests.groupBy(*each).agg(F.count(F.lit(1)).alias("n_tests")), each, "left")
    else:
        out = out.withColumn("n_tests", F.lit(0))
    cx = plan_complexity(goals)
    out = out.join(cx, "goal_id", "left").fillna(0, ["n_companions", "n_risks", "n_routes", "n_tests"])
    out = out.withColumn("level", plan_level("complexity", "n_risks"))
    checks = checklist(goals, ok.select(*each, "target"),
                       tests if tests is not None else ok.select(*each, F.lit(None).cast("string").alias("test"))
                       .where(F.lit(False)), key)
    n_checks = checks.groupBy(*each).agg(F.count(F.lit(1)).alias("n_checks"))
    out = out.join(n_checks, each, "left")

    weak = best.where(F.col("target_score") < min_score).select(*each)
    none = (goals.select("goal_id").join(best.select("goal_id").distinct(), "goal_id", "left_anti")
            .select("goal_id", F.lit(None).cast(best.schema[key].dataType).alias(key)))
    unavailable = weak.unionByName(none).select(*each, F.lit("unavailable").alias("status"), F.lit("Evidence not available.").alias("reason"))
    avail = out.select("goal_id", F.lit("available").alias("status"), F.lit(None).cast("string").alias("reason"),
                       key, "target", "target_layer", "target_score",
                       *[F.col(c).cast("bigint").alias(c) for c in ("n_companions", "n_risks", "n_routes",
                                                                      "n_tests", "n_checks")],
                       "complexity", "level")
    return avail.unionByName(unavailable, allowMissingColumns=True)


def review(inventory: DataFrame, profile: DataFrame, cov: DataFrame, risks_df: DataFrame,
           deps: DataFrame | None, advice: DataFrame, key: str = "repo_id", max_risks: int = 5,
           max_deps: int = 8) -> DataFrame:
    """The repository review as data -> (key, section, ord, item, value).

    Sections: coverage, profile, entry_points, databases, libraries (first 8 sorted),
    layers (files per first folder, exact folder match), strengths, risks (first 5 in
    detector order), recommendations (risk titles with advice)."""
    from archspark.functions.paths import first_segment, is_database_file
    cov_rows = cov.select(key, F.expr("""stack(5,
        'overall', CAST(overall_pct AS STRING), 'ast', CAST(ast_pct AS STRING),
        'dependency', CAST(dep_pct AS STRING),
        'git', coalesce(CAST(git_pct AS STRING), 'Not Available (Reason: No readable Git history)'),
        'route', coalesce(CAST(route_pct AS STRING), 'Not Available (Reason: No routes mapped in workspace)'))
        AS (item, value)""")).select(key, F.lit("coverage").alias("section"), F.lit(0).alias("ord"), "item", "value")
    prof = profile.select(key, F.lit("profile").alias("section"), F.lit(0).alias("ord"),
                          F.lit("layout").alias("item"), F.col("layout").alias("value"))
    inv = inventory.select(key, "path")
    entries = inv.where(is_entry_point("path")).select(key, F.lit("entry_points").alias("section"),
                                                       F.lit(0).alias("ord"), F.col("path").alias("item"),
                                                       F.lit(None).cast("string").alias("value"))
    dbs = inv.where(is_database_file("path")).select(key, F.lit("databases").alias("section"), F.lit(0).alias("ord"),
                                                     F.col("path").alias("item"), F.lit(None).cast("string").alias("value"))
    parts = [cov_rows, prof, entries, dbs]
    if deps is not None:
        wl = Window.partitionBy(key).orderBy("dep")
        parts.append(deps.select(key, "dep").distinct().withColumn("ord", F.row_number().over(wl))
                     .where(F.col("ord") <= max_deps)
                     .select(key, F.lit("libraries").alias("section"), "ord", F.col("dep").alias("item"),
                             F.lit(None).cast("string").alias("value")))
    dirs = (inv.select(key, first_segment("path").alias("d")).where(F.col("d").isNotNull())
            .groupBy(key, "d").agg(F.count(F.lit(1)).alias("n")))
    parts.append(dirs.select(key, F.lit("layers").alias("section"), F.lit(0).alias("ord"), F.col("d").alias("item"),
                             F.col("n").cast("string").alias("value")))
    n_entries = entries.groupBy(key).agg(F.count(F.lit(1)).alias("n_entries"))
    st = (profile.select(key, "n_files").join(cov.select(key, "ast_pct"), key, "left").join(n_entries, key, "left")
          .select(key, F.explode(F.array_compact(F.array(
              F.when(F.col("n_files") > 10, F.lit("Modular Design")),
              F.when(F.col("ast_pct") > 90, F.lit("High AST Parse Success")),
              F.when(F.coalesce("n_entries", F.lit(0)) > 0, F.lit("Explicit Entrypoints"))))).alias("item")))
    parts.append(st.select(key, F.lit("strengths").alias("section"), F.lit(0).alias("ord"), "item",
                           F.lit(None).cast("string").alias("value")))
    wr = Window.partitionBy(key).orderBy("detector", "file", "title")
    parts.append(risks_df.withColumn("ord", F.row_number().over(wr)).where(F.col("ord") <= max_risks)
                 .select(key, F.lit("risks").alias("section"), "ord",
                         F.concat(F.lit("["), F.upper("severity"), F.lit("] "), F.col("title")).alias("item"),
                         F.col("file").alias("value")))
    rec = recommendations(risks_df, advice, key)
    parts.append(rec.select(key, F.lit("recommendations").alias("section"), F.col("ord"),
                            F.col("advice").alias("item"), F.col("file").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("ord", F.col("ord").cast("bigint"))


def reasoning_trace(agent_ctx: DataFrame, goal_summary: DataFrame, cov: DataFrame, layer_rollup: DataFrame,
                    key: str = "repo_id", max_checks: int = 3) -> DataFrame:
    """K8: the nine-step trace per goal as data -> (goal_id, step, title, value, detail).

    Counts come from the tables already built: concepts (J9), layers (E13), files and parse
    rate (E7), target and companions (K2), risks of the target (D14), checks (K7, at most 3),
    confidence (J1)."""
    ok = agent_ctx.where(F.col("status") == "available")
    layers_n = layer_rollup.groupBy(key).agg(F.count(F.lit(1)).alias("n_layers"))
    row = (ok.join(goal_summary.select("goal_id", "n_concepts"), "goal_id", "left")
           .join(cov.select(key, "n_files", "ast_pct", "confidence_pct"), key, "left")
           .join(layers_n, key, "left"))
    trace = F.expr(f"""stack(9,
        1, 'User Intent', CAST(NULL AS BIGINT), CAST(goal_id AS STRING),
        2, 'Intent Mapping', CAST(n_concepts AS BIGINT), 'concepts',
        3, 'Subsystem Discovery', CAST(n_layers AS BIGINT), 'layers',
        4, 'Repository Intelligence', CAST(n_files AS BIGINT), concat('ast coverage ', CAST(ast_pct AS STRING), '%'),
        5, 'Impact Intelligence', CAST(n_companions AS BIGINT), CAST(target AS STRING),
        6, 'Risk Intelligence', CAST(n_risks AS BIGINT), 'risks of target files',
        7, 'Verification Intelligence', CAST(least(n_checks, {max_checks}) AS BIGINT), 'checks',
        8, 'Architecture Recommendation', CAST(confidence_pct AS BIGINT), 'confidence %',
        9, 'Human Approval', CAST(0 AS BIGINT), 'files modified') AS (step, title, value, detail)""")
    return row.select("goal_id", key, trace)
