"""The content of the answers as long tables: impact lists (K3), ranked radius (F6), nodes of the impact
graph (H5), measured evidence of risks (R1-R6), related files and routes of an owner (K4), the brief (K1), risks and
routes of what a change affects (D14, D15), change plans and their steps (K9, J13)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archspark.functions import vocab
from archspark.functions.paths import is_database_file, is_entry_point
from archspark.operators.facts import evidence_records


def impact_lists(edges: DataFrame, cochange: DataFrame | None = None, key: str = "repo_id") -> DataFrame:
    """K3: (key, path, relation, other, pct): what a file imports, what imports it, what changes with it (pct is
    the co-change ratio, 0 for imports)."""
    e = edges.select(key, "src", "dst").distinct()
    none = F.lit(0).cast("bigint").alias("pct")
    out = e.select(key, F.col("src").alias("path"), F.lit("direct").alias("relation"), F.col("dst").alias("other"), none)
    out = out.unionByName(e.select(key, F.col("dst").alias("path"), F.lit("reverse").alias("relation"), F.col("src").alias("other"), none))
    if cochange is not None:
        out = out.unionByName(cochange.select(key, F.col("a").alias("path"), F.lit("cochange").alias("relation"), F.col("b").alias("other"),
                                              F.col("pct").cast("bigint").alias("pct")))
    return out


def ranked_radius(radius: DataFrame, key: str = "repo_id") -> DataFrame:
    """the blast radius with its order: heaviest first, then by file."""
    order = Window.partitionBy(key, "target").orderBy(F.col("impact_weight").desc(), "file")
    return radius.select("*", F.row_number().over(order).cast("bigint").alias("rank"))


def impact_nodes(files: DataFrame, companions: DataFrame, key: str = "repo_id") -> DataFrame:
    """H5: nodes of each file's impact graph: itself as the centre and its companions."""
    centre = files.select(key, F.col("path").alias("target"), F.col("path").alias("node"), F.lit("center").alias("kind"),
                          F.lit(100).cast("bigint").alias("confidence_pct"))
    return centre.distinct().unionByName(companions.select(key, "target", F.col("file").alias("node"), F.lit("companion").alias("kind"), "confidence_pct"))


def simulated_impact(files: DataFrame, companions: DataFrame, key: str = "repo_id") -> DataFrame:
    """E17 for every file: the mean companion confidence, 10 without companions."""
    mean = companions.groupBy(key, "target").agg(F.floor(F.avg("confidence_pct")).cast("bigint").alias("m"))
    return (files.select(key, F.col("path").alias("target")).distinct().join(mean, [key, "target"], "left")
            .select(key, "target", F.coalesce("m", F.lit(10)).cast("bigint").alias("impact_score")))


def risk_evidence(ff: DataFrame, components: DataFrame, depths: DataFrame, missing: DataFrame, key: str = "repo_id") -> DataFrame:
    """The measured values behind each risk: (key, detector, file, measure, value); a loop's
    members are one row each, with the loop's size as value."""
    def rows(df, detector, file, measure, value):
        return df.select(key, F.lit(detector).cast("bigint").alias("detector"), F.col(file).cast("string").alias("file"),
                         F.lit(measure).alias("measure"), F.col(value).cast("bigint").alias("value"))

    big = ff.where((F.col("extension") == ".py") & ((F.col("size") > vocab.OVERSIZED_BYTES) | (F.col("function_count") > vocab.OVERSIZED_FUNCTIONS)))
    parts = [rows(big, 1, "path", "size", "size"), rows(big, 1, "path", "functions", "function_count"),
             rows(components, 2, "node", "loop size", "component_size"),
             rows(depths.where(F.col("depth") > vocab.DEEP_CHAIN), 3, "node", "depth", "depth"),
             rows(ff.where(F.col("route_count") > vocab.ROUTE_CONCENTRATION), 4, "path", "routes", "route_count"),
             rows(missing, 6, "file", "size", "size")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def related_entry_points(assignments: DataFrame, edges: DataFrame, key: str = "repo_id") -> DataFrame:
    """(key, layer, entry): entry points in a layer or importing one of its files."""
    a = assignments.select(key, "path", "layer")
    own = a.where(is_entry_point("path")).select(key, "layer", F.col("path").alias("entry"))
    via = (edges.select(key, F.col("src").alias("entry"), F.col("dst").alias("path")).where(is_entry_point("entry"))
           .join(a, [key, "path"]).select(key, "layer", "entry"))
    return own.unionByName(via).distinct()


def change_plan(context: DataFrame, companions: DataFrame, key: str = "repo_id") -> DataFrame:
    """K9: the files a goal changes, per repository: (goal_id, key, file, role, reason, confidence_pct, level).

    ``context`` are rows of ``reports.agent_context``; unavailable ones give no files.
    """
    ok = context.where(F.col("status") == "available").select("goal_id", key, "target", "target_score", "level")
    target = ok.select("goal_id", key, F.col("target").alias("file"), F.lit("target").alias("role"),
                       F.lit("Best match of the goal").alias("reason"), F.least("target_score", F.lit(99)).cast("bigint").alias("confidence_pct"), "level")
    near = (ok.join(companions.select(key, "target", "file", "reason", "confidence_pct"), [key, "target"])
            .select("goal_id", key, "file", F.lit("companion").alias("role"), "reason", "confidence_pct", "level"))
    return target.unionByName(near)


def layer_routes(assignments: DataFrame, routes: DataFrame, key: str = "repo_id") -> DataFrame:
    """(key, layer, route, method, handler): routes whose handler's file is in the layer."""
    r = routes.select(key, F.split("handler", ":")[0].alias("path"), "route", "method", "handler")
    return r.join(assignments.select(key, "path", "layer"), [key, "path"]).select(key, "layer", "route", "method", "handler")


def affected_content(affected: DataFrame, risks_df: DataFrame, routes: DataFrame, key: str = "repo_id") -> DataFrame:
    """D14 + D15: risks and routes of the files a change affects -> (key, target, file, kind, item, detail).

    affected (key, target, file); an item is a risk's title with its severity, or a route with its method."""
    a = affected.select(key, "target", "file").distinct()
    risk = risks_df.select(key, "file", F.lit("risk").alias("kind"), F.col("title").alias("item"), F.col("severity").alias("detail"))
    route = routes.select(key, F.split("handler", ":")[0].alias("file"), F.lit("route").alias("kind"), F.col("route").alias("item"), F.col("method").alias("detail"))
    return a.join(risk.unionByName(route), [key, "file"]).select(key, "target", "file", "kind", "item", "detail")


def brief(profile: DataFrame, inventory: DataFrame, assignments: DataFrame, risks_df: DataFrame, cov: DataFrame, key: str = "repo_id") -> DataFrame:
    """K1: the content of the brief of each repository -> (key, section, item, value): project type, entry points,
    subsystems with their files, databases, risks with their files, confidence, evidence with status and coverage."""
    none = F.lit(None).cast("string")

    def rows(df, section, item, value=none):
        return df.select(key, F.lit(section).alias("section"), item.cast("string").alias("item"), value.cast("string").alias("value"))

    per_layer = assignments.groupBy(key, "layer").agg(F.count(F.lit(1)).alias("n"))
    evidence = evidence_records(cov)
    parts = [rows(profile, "project type", F.col("project_type")), rows(inventory.where(is_entry_point("path")), "entry point", F.col("path")),
             rows(per_layer, "subsystem", F.col("layer"), F.col("n")),
             rows(inventory.where(is_database_file("path")), "database", F.col("path")),
             rows(risks_df, "risk", F.col("title"), F.col("file")), rows(cov, "confidence", F.col("confidence_pct")),
             rows(evidence, "evidence", F.concat_ws(" ", "evidence_type", "status"), F.col("coverage_pct"))]
    return reduce(DataFrame.unionByName, parts)


def plan_steps(goals: DataFrame, affected: DataFrame, key: str = "repo_id") -> DataFrame:
    """The plan of each goal -> (goal_id, key, complexity, part, ord, text); part is step or check.

    goals (goal_id, key, target, goal): the wording picks the plan (first of auth, database, cache, other);
    affected (key, target, file): the first two other files by name are named in the step on dependents."""
    others = (affected.groupBy(key, "target").agg(F.array_join(F.slice(F.array_sort(F.collect_set("file")), 1, 2), ", ").alias("others")))
    g = goals.join(others, [key, "target"], "left")
    low = F.lower("goal")
    said = lambda words: reduce(lambda a, b: a | b, [low.contains(w) for w in words])

    def fill(texts):
        """Sentences with the target and the other files put in; one that needs others goes without any."""
        made = []
        for text in texts:
            at = F.replace(F.replace(F.lit(text), F.lit("{target}"), F.col("target")), F.lit("{others}"), F.coalesce("others", F.lit("")))
            made.append(F.when(F.col("others").isNotNull(), at) if "{others}" in text else at)
        return F.array_compact(F.array(*made))

    def pick(part):
        out = None
        for (words, _), plan in zip(vocab.PLAN_COMPLEXITY, vocab.PLAN_TEXTS):
            out = F.when(said(words), fill(plan[part])) if out is None else out.when(said(words), fill(plan[part]))
        return out.otherwise(fill(vocab.PLAN_TEXTS[-1][part]))

    level = F.lit("Low")
    for words, named in reversed(vocab.PLAN_COMPLEXITY):
        level = F.when(said(words), named).otherwise(level)
    rows = [g.select("goal_id", key, level.alias("complexity"), F.lit(name).alias("part"), F.posexplode(pick(i)).alias("ord", "text"))
            for i, name in enumerate(("step", "check"))]
    return rows[0].unionByName(rows[1]).withColumn("ord", F.col("ord").cast("long"))
