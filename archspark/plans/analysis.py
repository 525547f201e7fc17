"""The whole analysis of many repositories as one lazy set of DataFrames.

``build_analysis(corpus, commit_files)`` is the code-corpus entry point: it derives
every table the questions need; nothing is computed until a table is written or read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from archspark.functions import vocab
from archspark.functions.paths import is_database_file, is_test_path, normalise
from archspark.operators import companions, extract, facts, graph, history, layers, risks
from archspark.plans import reports
from archspark.sources import corpus as src
from archspark.sources import dims, manifests


def module_table(inv: DataFrame) -> DataFrame:
    """Module lookup of D1: a .py file is importable by its path without extension, so only
    root-level files resolve (the analysed tool's rule)."""
    py = inv.where(F.col("extension") == ".py")
    return py.select("repo_id", F.regexp_replace("path", r"\.py$", "").alias("module"), F.col("path").alias("file"))


def build_analysis(spark: SparkSession, corpus: DataFrame, commit_files: DataFrame | None = None,
                   latest_n: int | None = None, k_companions: int = 8, commits: DataFrame | None = None,
                   store: str | None = None) -> dict[str, DataFrame]:
    """All derived tables. ``latest_n`` keeps only the newest commits of each repository (F1) and
    then needs ``commits`` (repo_id, commit_id, seq), which also holds commits without files.

    With ``store`` (a folder all executors share) the parsed facts, the import edges and the
    co-change ratios are written there once and read back, so each source is parsed once
    however many tables are used; without it they are recomputed by every table that reads them.
    """
    def kept(name: str, df: DataFrame) -> DataFrame:
        if store is None:
            return df
        df.write.mode("overwrite").parquet(f"{store}/{name}")
        return spark.read.parquet(f"{store}/{name}")

    inv = src.inventory(corpus)
    kept_paths = inv.select("repo_id", "path")
    sources = corpus.withColumn("path", normalise("path"))
    code = kept("code_facts", extract.code_facts(sources.join(kept_paths, ["repo_id", "path"], "left_semi")))
    raw = code.select("repo_id", F.col("path").alias("src"), F.explode("imports.module").alias("module"))
    imports = kept("imports", graph.resolve_imports(raw, module_table(inv)))
    routes = extract.routes(code)
    ff = facts.file_facts(inv, code, imports)
    out: dict[str, DataFrame] = {"files": inv, "code_facts": code, "imports": imports, "routes": routes,
                                 "file_facts": ff}

    history_files = None
    cochange_raw = None
    if commit_files is not None:
        cf = commit_files
        if latest_n is not None:
            if commits is None:
                raise ValueError("a window of commits needs the table of commits, also those without files")
            newest = Window.partitionBy("repo_id").orderBy("seq", "commit_id")
            win = commits.select("repo_id", "commit_id", "seq", F.row_number().over(newest).alias("rank")).where(F.col("rank") <= latest_n)
            cf = history.restrict_to_window(cf, win)
        out["file_history"] = history.file_history(cf)
        cochange_raw = kept("cochange_raw", history.cochange_ratios(cf))
        out["cochange_raw"] = cochange_raw
        out["temporal_matrix"] = history.temporal_matrix(cf, code_only=True)
        history_files = cf.select("repo_id", "path").distinct()

    out["coverage"] = facts.coverage(inv, code, imports, history_files, routes)
    db_files = inv.where(is_database_file("path")).select("repo_id", "path")
    out["health"] = facts.health(ff, db_files)

    comps = graph.cycle_components(imports)
    depth = graph.dependency_depth(imports)
    tests = inv.where(is_test_path("path")).select("repo_id", "path")
    miss = risks.missing_tests(ff, tests)
    out["risks"] = risks.union_risks(
        risks.risk_oversized(ff), risks.risk_cycles(comps), risks.risk_deep(depth), risks.risk_routes(ff),
        risks.risk_database(ff, code, imports), risks.risk_missing_tests(miss))

    handlers = routes.select("repo_id", F.split("handler", ":").getItem(0).alias("path"))
    base = layers.classify(inv, dims.taxonomy(spark), dims.layers(spark), dims.path_rules(spark),
                           db_files=db_files, route_files=handlers)
    assign = layers.propagate(base, imports, dims.layers(spark))
    out["layer_assignments"] = assign
    out["layer_rollup"] = layers.rollup(assign, dims.layers(spark))

    models = extract.explode_facts(code, "models").select("repo_id", "path", F.col("name").alias("model"))
    route_paths = routes.select("repo_id", "path", "route")
    cc = cochange_raw if cochange_raw is not None else imports.select(
        "repo_id", F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(0).cast("bigint").alias("pct")).where("false")
    out["companions"] = companions.companions(inv, imports, models, route_paths, cc, k=k_companions)
    out["change_impact"] = reports.change_impact(ff, assign, out["risks"], cochange_raw)
    out["ownership"] = reports.ownership(assign, imports, routes)
    deps = manifests.requirement_lines(corpus.where(F.col("path").endswith("requirements.txt"))
                                       .select("repo_id", "path", F.col("content").cast("string").alias("content")))
    pkg = manifests.package_json_deps(corpus.where(F.col("path").endswith("package.json"))
                                      .select("repo_id", "path", F.col("content").cast("string").alias("content")))
    all_deps = deps.select("repo_id", "dep").unionByName(pkg.select("repo_id", "dep"))
    out["dependencies"] = manifests.dependency_set(all_deps)
    out["profile"] = manifests.project_profile(inv, all_deps)
    out["brief"] = reports.repo_brief(out["profile"], out["coverage"], out["risks"], out["layer_rollup"])
    return out


def answer_goals(spark: SparkSession, analysis: dict[str, DataFrame], goals: DataFrame,
                 k: int = 10) -> dict[str, DataFrame]:
    """Goal questions over a built analysis (K2/K9 with J7-J10): ranked candidates per goal and
    one agent-context row per goal. goals (goal_id, goal)."""
    from archspark.operators import intent

    cands = intent.candidate_scores(goals, analysis["files"], analysis["file_facts"], analysis["layer_assignments"],
                                    dims.concepts(spark), dims.stop_words(spark), dims.layer_vocab(spark),
                                    [name for name, _ in vocab.LAYERS], k=k)
    models = extract.explode_facts(analysis["code_facts"], "models").select("repo_id", "path",
                                                                             F.col("name").alias("model"))
    routes = analysis["routes"].select("repo_id", "path", "route")
    cc = analysis.get("cochange_raw")
    if cc is None:
        cc = analysis["imports"].select("repo_id", F.col("src").alias("a"), F.col("dst").alias("b"),
                                        F.lit(0).cast("bigint").alias("pct")).where("false")

    def comp_fn(targets):
        return companions.companions(analysis["files"], analysis["imports"], models, routes, cc, targets=targets)

    tests = analysis["files"].where(is_test_path("path")).select("repo_id", "path")
    ctx = reports.agent_context(cands, goals, comp_fn, analysis["risks"], analysis["routes"], tests)
    return {"candidates": cands, "agent_context": ctx}
