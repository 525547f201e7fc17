"""Companion files of every target at once.

Score of (target t, file f), in hundredths of a point::

    500 * [f imports t] + 400 * [t imports f] + 300 * [share a model]
    + 200 * [share a route path] + 5 * pct(co-change t -> f)

confidence = min(0.5 + score / 20, 0.99), kept as an integer percentage.

Scale: sharing a model or a route puts every pair of a group in relation, which is
quadratic in the group size. We never emit those pairs. For a top-``k`` answer three lists of a
target suffice: its first ``k`` files by path that share a model, that share a route, that share
both. Proof sketch: a file f without an import or co-change signal scores 300, 200 or 500. All
files that share a model score 300 at least, so those before a model-only f by path rank before it, and
if f makes the top-k there are fewer than k of them; the same holds for routes and for both. The
first ``k + 1`` members of each group (one may be the target) hold these lists. The flags of a listed
file are final: if it also shared the other kind of name, it would be among the first k that share both.
Files with an import or co-change signal are always candidates. The result is exact; only the
enumeration is bounded.

Model and route names are compared for candidates that can still reach the top ``k`` only. A listed file's score
is sure; the k-th of these, by confidence and path, is what others must reach at best, with the points for
names not yet compared. Those that could reach it with names shared go to their file as short rows with 64-bit
masks of the target's names: names without a bit in common are not shared. Only what is left after that carries names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archspark.operators.frames import fresh as _fresh
from archspark.operators.joins import bounded_broadcast
from archspark.session import cut_lineage, stored

#: heads of groups (short rows) that are broadcast
MAX_BROADCAST_HEADS = 200_000


def _group_heads(members: DataFrame, key: str, group_cols: list[str], n: int) -> DataFrame:
    """First ``n`` members (by path) of every group -> (key, *group_cols, file)."""
    w = Window.partitionBy(key, *group_cols).orderBy("path")
    return (members.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
            .select(key, *group_cols, F.col("path").alias("file")))


def _members(sheets: DataFrame, key: str, group_cols: list[str]) -> DataFrame:
    """(key, path, *group_cols): a row for each group that a file is in."""
    for col, names in (("model", "ms"), ("route", "rs")):
        if col in group_cols:
            sheets = sheets.withColumn(col, F.explode(names))
    return sheets.select(key, "path", *group_cols)


def _group_candidates(sheets: DataFrame, key: str, group_cols: list[str], k: int, deal) -> DataFrame:
    """(key, target, file): the first ``k`` files by path that share a group with the target (see the module's text).

    The heads of all groups, if a count shows them to be few, are broadcast to the file sheets dealt out by target: a
    target's list is cut where its groups lie, and nothing but the sheets is shuffled.
    """
    heads, few = bounded_broadcast(_fresh(cut_lineage(_group_heads(_members(sheets, key, group_cols), key, group_cols, k + 1))), MAX_BROADCAST_HEADS)
    targets = _members(deal(sheets, "path") if few else sheets, key, group_cols).withColumnRenamed("path", "target")
    met = targets.join(heads, [key, *group_cols]).where(F.col("target") != F.col("file")).select(key, "target", "file")
    first = Window.partitionBy(key, "target").orderBy("file")
    return ((met if few else deal(met, "target")).distinct()
            .withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k).drop("_r"))


def _confidence(score: str):
    return F.expr(f"least(50 + ({score} + 10) div 20, 99)")


def _points(flag: str, n: int):
    return F.when(F.col(flag), n).otherwise(0)


def _reaching(cands: DataFrame, k: int, key: str, listed: bool = False) -> DataFrame:
    """The candidates that can be among their target's ``k`` first (see the module's text), with ``need``: how many points of
    names not yet compared a candidate wants for that at least.

    ``listed``: ``has_m`` and ``has_r`` come from the lists of first files, so both are final where one is set, and of equal
    confidences the path decides.
    """
    grouped = F.col("has_m") | F.col("has_r")  # by a group: an inventory file, whose score is sure
    least = _points("imp_in", 500) + _points("imp_out", 400) + 5 * F.col("pct") + _points("has_m", 300) + _points("has_r", 200)
    c = cands.withColumn("_least", least)
    sure = F.when(grouped, _confidence("_least"))
    w = (Window.partitionBy(key, "target").orderBy(sure.desc_nulls_last(), "file")
         .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    c = c.withColumn("_kth", F.nth_value(F.when(grouped, F.struct(sure.alias("c"), F.col("file").alias("f"))), k).over(w))
    ties = F.col("file") <= F.col("_kth.f") if listed else F.lit(True)

    def reaches(points):
        best = _confidence(f"_least + {points}")
        return F.col("_kth").isNull() | (best > F.col("_kth.c")) | ((best == F.col("_kth.c")) & ties)

    need = F.when(reaches(0), 0)
    no_m, no_r = ~F.col("has_m"), ~F.col("has_r")
    for points, missing in ((200, no_r), (300, no_m), (500, no_m & no_r)):
        need = need.when((~grouped if listed else missing) & reaches(points), points)
    return c.withColumn("need", need).where("need IS NOT NULL").drop("_least", "_kth", "has_m", "has_r")


def _sheets(files: DataFrame, models: DataFrame, routes: DataFrame, key: str) -> DataFrame:
    """(key, path, ms, rs, mm, rm): each inventory file with its sorted model and route names and a 64-bit mask of either."""
    none = F.lit(None).cast("string")
    rows = (files.select(key, "path", none.alias("model"), none.alias("route"), F.lit(True).alias("_in"))
            .unionByName(models.select(key, "path", "model", none.alias("route"), F.lit(False).alias("_in")))
            .unionByName(routes.select(key, "path", none.alias("model"), "route", F.lit(False).alias("_in"))))
    bit = lambda name: F.expr(f"bit_or(shiftleft(1L, CAST(pmod(xxhash64({name}), 64L) AS INT))) FILTER (WHERE {name} IS NOT NULL)")
    return (rows.groupBy(key, "path")
            .agg(F.array_sort(F.collect_set("model")).alias("ms"), F.array_sort(F.collect_set("route")).alias("rs"),
                 F.coalesce(bit("model"), F.lit(0)).alias("mm"), F.coalesce(bit("route"), F.lit(0)).alias("rm"), F.bool_or("_in").alias("_in"))
            .where("_in").drop("_in"))


def companions(files: DataFrame, edges: DataFrame, models: DataFrame, routes: DataFrame,
               cochange: DataFrame, k: int = 8, key: str = "repo_id",
               targets: DataFrame | None = None, dealt: int | None = None) -> DataFrame:
    """-> (key, target, file, score, confidence_pct, confidence, reason, rank), rank <= k.

    files (key, path); edges (key, src, dst); models (key, path, model);
    routes (key, path, route); cochange (key, a, b, pct) with ratio = joint / commits(a).
    ``targets`` (key, target), when given, restricts the answer to those targets early.
    If ``cochange`` has a column ``edge``, a row says by it whether a imports b, and ``edges`` are those rows.
    ``dealt``: ``cochange`` lies in so many partitions by (key, a). The other candidates are then dealt out
    likewise, and the co-change rows are not shuffled before most of them are dropped.
    """
    sheets = stored(_sheets(files, models, routes, key))
    deal = lambda df, target: df.repartition(dealt, key, target) if dealt else df.repartition(key, target)
    apart = lambda df: deal(df, "target") if dealt else df
    e = edges.select(key, "src", "dst")
    known = "edge" in cochange.columns
    cc = cochange.select(key, F.col("a").alias("target"), F.col("b").alias("file"), "pct",
                         (F.col("edge") if known else F.lit(False)).alias("out")).where("pct > 0 OR out")

    def sig(df, imp_in=False, imp_out=None, pct=None, model=False, route=False):
        return df.select(key, "target", "file", F.lit(imp_in).alias("imp_in"), (F.lit(False) if imp_out is None else imp_out).alias("imp_out"),
                         (F.col("pct") if pct else F.lit(0)).cast("bigint").alias("pct"),
                         F.lit(model).alias("has_m"), F.lit(route).alias("has_r"))

    # every candidate with its direct signals, merged by one aggregation (one shuffle, or none of the co-change rows)
    rows = (sig(cc, pct=True, imp_out=F.col("out"))
            .unionByName(sig(apart(e.select(key, F.col("dst").alias("target"), F.col("src").alias("file"))), imp_in=True)))
    if not known:
        rows = rows.unionByName(sig(apart(e.select(key, F.col("src").alias("target"), F.col("dst").alias("file"))), imp_out=F.lit(True)))
    rows = (rows.unionByName(sig(_group_candidates(sheets, key, ["model"], k, deal), model=True))
            .unionByName(sig(_group_candidates(sheets, key, ["route"], k, deal), route=True))
            .unionByName(sig(_group_candidates(sheets, key, ["model", "route"], k, deal), model=True, route=True)))
    if targets is not None:
        rows = rows.join(_fresh(targets.select(key, "target").distinct()), [key, "target"], "left_semi")
    cands = (rows.where(F.col("target") != F.col("file")).groupBy(key, "target", "file")
             .agg(F.max("imp_in").alias("imp_in"), F.max("imp_out").alias("imp_out"), F.max("pct").alias("pct"),
                  F.max("has_m").alias("has_m"), F.max("has_r").alias("has_r")))
    cands = _reaching(cands, k, key, listed=True)

    # inner joins on both ends also keep only inventory files (the reference loops over its fact sheets)
    sheet = lambda end, **cols: _fresh(sheets.select(key, F.col("path").alias(end), *(F.col(c).alias(n) for n, c in cols.items()))).hint("merge")
    near = (cands.join(sheet("target", tmm="mm", trm="rm"), [key, "target"])
            .join(sheet("file", fmm="mm", frm="rm", fm="ms", fr="rs"), [key, "file"])
            .where(F.expr("need <= IF((tmm & fmm) != 0, 300, 0) + IF((trm & frm) != 0, 200, 0)")))
    scored = near.drop("tmm", "trm", "fmm", "frm", "need").join(sheet("target", tm="ms", tr="rs"), [key, "target"])
    scored = scored.select(key, "target", "file", "imp_in", "imp_out", F.array_sort(F.array_intersect("tm", "fm")).alias("sm"),
                           F.array_sort(F.array_intersect("tr", "fr")).alias("sr"), "pct")
    score = (_points("imp_in", 500) + _points("imp_out", 400)
             + F.when(F.size("sm") > 0, 300).otherwise(0) + F.when(F.size("sr") > 0, 200).otherwise(0)
             + F.lit(5) * F.col("pct")).cast("bigint")
    tgt = F.col("target").cast("string")
    reason = F.concat_ws(" and ",
                         F.when(F.col("imp_in"), F.concat(F.lit("Explicitly imports "), tgt)),
                         F.when(F.col("imp_out"), F.concat(F.lit("Imported by "), tgt)),
                         F.when(F.size("sm") > 0, F.concat(F.lit("Shares DB model: "), F.array_join("sm", ", "))),
                         F.when(F.size("sr") > 0, F.concat(F.lit("Shares API endpoint paths: "),
                                                           F.array_join("sr", ", "))),
                         F.when(F.col("pct") > 0, F.concat(F.lit("Co-changed in "), F.col("pct").cast("string"),
                                                           F.lit("% of commit history"))))
    out = (scored.withColumn("score", score).where("score > 0")
           .withColumn("confidence_pct", _confidence("score"))
           .withColumn("confidence", F.col("confidence_pct") / F.lit(100.0)))
    w = Window.partitionBy(key, "target").orderBy(F.col("confidence_pct").desc(), F.col("file"))
    return (out.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)
            .select(key, "target", "file", "score", "confidence_pct", "confidence", reason.alias("reason"), "rank"))


def impact_score(companion_rows: DataFrame, key: str = "repo_id") -> DataFrame:
    """int(mean companion confidence * 100) per target (10 when there is none)."""
    return companion_rows.groupBy(key, "target").agg(
        F.coalesce(F.floor(F.avg("confidence_pct")), F.lit(10)).cast("bigint").alias("impact_score"))


def impact_graph(companion_rows: DataFrame, key: str = "repo_id") -> DataFrame:
    """H5: edges from each target to its ranked companions, typed static (an import in the
    reason) or shadow (history only) -> (key, target, file, edge_type, label, confidence_pct)."""
    typ = F.when(F.lower("reason").rlike("imports|imported"), "static").otherwise("shadow")
    return companion_rows.select(key, "target", "file", typ.alias("edge_type"), F.col("reason").alias("label"),
                                 "confidence_pct")
