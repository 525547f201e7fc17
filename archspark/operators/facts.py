"""File fact sheets, coverage and health.

All ratios are integer percentages (see ``archspark.functions.scores.pct``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archspark.functions import vocab
from archspark.functions.paths import is_readme, is_test_path
from archspark.operators.frames import fresh as _fresh


def file_facts(inventory: DataFrame, facts: DataFrame | None, edges: DataFrame | None,
               key: str = "repo_id") -> DataFrame:
    """D3 + E5 + E6 + E20: one row per inventory file, missing facts default to 0.

    -> (key, path, extension, size, function_count, class_count, route_count,
        import_count, imported_by_count)
    """
    inv = inventory.select(key, "path", "extension", F.coalesce(F.col("size"), F.lit(0)).cast("bigint").alias("size"))
    out = inv
    if facts is not None:
        methods = F.aggregate("classes", F.lit(0), lambda acc, c: acc + F.size(c["methods"]))
        k = facts.select(key, "path",
                         (F.size("functions") + methods).alias("function_count"),
                         F.size("classes").alias("class_count"), F.size("endpoints").alias("route_count"))
        out = out.join(k.hint("merge"), [key, "path"], "left")
    else:
        out = out.select("*", *[F.lit(0).alias(c) for c in ("function_count", "class_count", "route_count")])
    if edges is not None:
        e = edges.select(key, "src", "dst").distinct()
        fo = e.groupBy(key, F.col("src").alias("path")).agg(F.count(F.lit(1)).alias("import_count"))
        fi = _fresh(e).groupBy(key, F.col("dst").alias("path")).agg(F.count(F.lit(1)).alias("imported_by_count"))
        out = out.join(fo, [key, "path"], "left").join(fi, [key, "path"], "left")
    else:
        out = out.select("*", F.lit(0).alias("import_count"), F.lit(0).alias("imported_by_count"))
    cols = ["function_count", "class_count", "route_count", "import_count", "imported_by_count"]
    return out.select(key, "path", "extension", "size",
                      *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in cols])


def coverage(inventory: DataFrame, facts: DataFrame | None, edges: DataFrame | None,
             history_files: DataFrame | None, routes: DataFrame | None, key: str = "repo_id") -> DataFrame:
    """E7-E11 + J1 per repository, as integer percentages.

    ast: parsed .py files / .py files (100 if none); dependency: edges whose target is
    in the inventory / edges (100 if none); git: files seen in history / files (null
    without history); route: routes whose handler file exists / routes (null without
    routes); overall: half-up mean of the non-null ones; confidence:
    round(.45 ast + .35 dep + .20 git).
    """
    inv = inventory.select(key, "path", "extension")
    inv_flag = _fresh(inv.select(key, "path", F.lit(True).alias("_in")))
    parsed = (facts.where("parsed").select(key, "path", F.lit(1).alias("_p")) if facts is not None
              else inv.select(key, "path", F.lit(None).cast("int").alias("_p")).limit(0))
    a = (inv.where(F.col("extension") == ".py").join(parsed.hint("merge"), [key, "path"], "left")
         .groupBy(key).agg(F.count(F.lit(1)).alias("py_files"), F.count("_p").alias("parsed_files")))
    files = inv.groupBy(key).agg(F.count(F.lit(1)).alias("n_files"))
    out = files.join(a, key, "left")
    if edges is not None:
        d = (edges.select(key, "src", "dst").distinct()
             .join(inv_flag.select(key, F.col("path").alias("dst"), "_in"), [key, "dst"], "left")
             .groupBy(key).agg(F.count(F.lit(1)).alias("n_edges"), F.count("_in").alias("resolved_edges")))
        out = out.join(d, key, "left")
    else:
        out = out.select("*", F.lit(0).alias("n_edges"), F.lit(0).alias("resolved_edges"))
    if history_files is not None:
        h = history_files.select(key, "path").distinct()
        repos_with_history = h.select(key).distinct().select(key, F.lit(True).alias("_has_history"))
        tracked = (inv.join(_fresh(h), [key, "path"], "left_semi").groupBy(key)
                   .agg(F.count(F.lit(1)).alias("tracked_files")))
        out = out.join(repos_with_history, key, "left").join(tracked, key, "left")
    else:
        out = out.select("*", F.lit(None).cast("boolean").alias("_has_history"), F.lit(0).alias("tracked_files"))
    if routes is not None:
        r = (routes.select(key, F.split("handler", ":").getItem(0).alias("hfile"))
             .join(inv_flag.select(key, F.col("path").alias("hfile"), "_in"), [key, "hfile"], "left")
             .groupBy(key).agg(F.count(F.lit(1)).alias("n_routes"), F.count("_in").alias("resolved_routes")))
        out = out.join(r, key, "left")
    else:
        out = out.select("*", F.lit(0).alias("n_routes"), F.lit(0).alias("resolved_routes"))
    out = out.fillna(0, ["py_files", "parsed_files", "n_edges", "resolved_edges", "tracked_files",
                         "n_routes", "resolved_routes"])
    ast_pct = F.expr("CASE WHEN py_files = 0 THEN 100 ELSE (200 * parsed_files + py_files) div (2 * py_files) END")
    dep_pct = F.expr("CASE WHEN n_edges = 0 THEN 100 ELSE (200 * resolved_edges + n_edges) div (2 * n_edges) END")
    git_pct = F.expr("CASE WHEN _has_history IS NULL THEN NULL WHEN n_files = 0 THEN 100 "
                     "ELSE (200 * tracked_files + n_files) div (2 * n_files) END")
    route_pct = F.expr("CASE WHEN n_routes = 0 THEN NULL "
                       "ELSE (200 * resolved_routes + n_routes) div (2 * n_routes) END")
    out = out.select(key, "n_files", ast_pct.cast("bigint").alias("ast_pct"), dep_pct.cast("bigint").alias("dep_pct"),
                     git_pct.cast("bigint").alias("git_pct"), route_pct.cast("bigint").alias("route_pct"))
    n_vals = "(2 + CASE WHEN git_pct IS NULL THEN 0 ELSE 1 END + CASE WHEN route_pct IS NULL THEN 0 ELSE 1 END)"
    s_vals = "(ast_pct + dep_pct + coalesce(git_pct, 0) + coalesce(route_pct, 0))"
    return out.select("*",
                      F.expr(f"(2 * {s_vals} + {n_vals}) div (2 * {n_vals})").cast("bigint").alias("overall_pct"),
                      F.expr("(45 * ast_pct + 35 * dep_pct + 20 * coalesce(git_pct, 0) + 50) div 100")
                      .cast("bigint").alias("confidence_pct"))


def health(file_facts_df: DataFrame, database_files: DataFrame | None = None, key: str = "repo_id",
           cycles: DataFrame | None = None, cycle_penalty: int = 0) -> DataFrame:
    """E12 + J2 + J3 + E21 per repository, exact in integers.

    maintainability = trunc(100 - min(cx/5, 20) - min(deps/3, 15) - min(bloat, 15)) clamped
    to 10..100, computed in units of 1/3000; integrity = 100 - 5 without database files
    (minus ``cycle_penalty`` per cyclic component when ``cycles`` is given; the analysed
    tool's penalty is a constant 0);
    test density = min(400 * tests / files, 100), 15 when below 10; documentation 85
    with a root readme else 40.
    """
    big = F.col("size") > vocab.BLOAT_BYTES
    g = file_facts_df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_files"),
        F.sum(F.col("function_count") + 2 * F.col("class_count")).alias("complexity"),
        F.sum("import_count").alias("dependencies"),
        F.sum(F.when(big, F.least(3 * (F.col("size") - vocab.BLOAT_BYTES), F.lit(45000))).otherwise(0))
        .alias("bloat3000"),
        F.sum(F.when(is_test_path("path"), 1).otherwise(0)).alias("test_files"),
        F.max(F.when(is_readme("path"), 1).otherwise(0)).alias("has_readme"))
    if database_files is not None:
        db = database_files.groupBy(key).agg(F.count(F.lit(1)).alias("db_files"))
        g = g.join(db, key, "left")
    else:
        g = g.withColumn("db_files", F.lit(0))
    if cycles is not None and cycle_penalty:
        nc = cycles.select(key, "component").distinct().groupBy(key).agg(F.count(F.lit(1)).alias("n_cycles"))
        g = g.join(nc, key, "left")
    else:
        g = g.withColumn("n_cycles", F.lit(0))
    m = F.expr("(300000 - least(600 * complexity, 60000) - least(1000 * dependencies, 45000) "
               "- least(bloat3000, 45000)) div 3000")
    td = F.expr("CASE WHEN least((400 * test_files) div n_files, 100) < 10 THEN 15 "
                "ELSE least((400 * test_files) div n_files, 100) END")
    return g.select(key, "n_files",
                    F.least(F.greatest(m, F.lit(10)), F.lit(100)).cast("bigint").alias("maintainability"),
                    (F.when(F.coalesce("db_files", F.lit(0)) > 0, 100).otherwise(95)
                     - F.lit(cycle_penalty) * F.coalesce("n_cycles", F.lit(0))).cast("bigint")
                    .alias("structural_integrity"),
                    td.cast("bigint").alias("test_density"),
                    F.when(F.col("has_readme") == 1, 85).otherwise(40).cast("bigint").alias("documentation"))


def evidence_records(cov: DataFrame, key: str = "repo_id") -> DataFrame:
    """K5: four evidence records per repository as rows of the evidence struct."""
    rec = F.expr("""stack(4,
        'ast', 'available', ast_pct, CAST(NULL AS STRING),
        'dependency', 'available', dep_pct, CAST(NULL AS STRING),
        'git', CASE WHEN git_pct IS NULL THEN 'unavailable' ELSE 'available' END, git_pct,
               CASE WHEN git_pct IS NULL THEN 'No readable Git history' END,
        'route', CASE WHEN route_pct IS NULL THEN 'unavailable' ELSE 'available' END, route_pct,
               CASE WHEN route_pct IS NULL THEN 'No route endpoints defined in workspace.' END)
        AS (evidence_type, status, coverage_pct, reason)""")
    return cov.select(key, "confidence_pct", rec)
