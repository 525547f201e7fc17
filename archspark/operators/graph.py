"""Import graph operators: resolution, fan-in/out, cycles, depth, blast radius.

Edges are a long table ``(key, src, dst)``. Components and depth come from ``operators/contraction``; loops
cut their lineage with a reliable ``checkpoint`` into the session's checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archspark.operators.contraction import SMALL, chain_depths, strongly_connected
from archspark.operators.frames import fresh as _fresh
from archspark.session import cut_lineage


def resolve_imports(raw_imports: DataFrame, modules: DataFrame, key: str = "repo_id") -> DataFrame:
    """D1 + G4: (key, src, module) joined to (key, module, file) -> distinct (key, src, dst), no self edges.

    The module table has one row per file, so the join is a plain equi join; a merge join, as imports exploded from
    few columns of stored facts look small enough to be broadcast.
    """
    m = modules.select(key, "module", F.col("file").alias("dst"))
    return (raw_imports.select(key, "src", "module").join(m.hint("merge"), [key, "module"])
            .where(F.col("src") != F.col("dst")).select(key, "src", "dst").distinct())


def resolve_imports_dotted(raw_names: DataFrame, files: DataFrame, key: str = "repo_id") -> DataFrame:
    """D1 option ``resolution="dotted"``: import ``a.b.c`` resolves to the file of its longest
    existing prefix (``a/b/c`` as package ``__init__.py`` or module ``.py``, else ``a/b`` ...);
    a package wins over a same-named module, as in Python.
    raw_names (key, src, name); files (key, path) -> distinct (key, src, dst), no self edges."""
    py = files.where(F.col("path").endswith(".py")).select(key, "path")
    mods = py.select(key, F.regexp_replace(F.regexp_replace("path", r"/__init__\.py$", ""), r"\.py$", "")
                     .alias("mpath"), F.col("path").alias("dst"), F.col("path").endswith("__init__.py").alias("pkg"))
    parts = raw_names.select(key, "src", "name", F.split("name", r"\.").alias("_p"))
    prefixes = (parts.select(key, "src", "name", "_p", F.explode(F.sequence(F.lit(1), F.size("_p"))).alias("n"))
                .select(key, "src", "name", "n", F.array_join(F.slice("_p", 1, F.col("n")), "/").alias("mpath")))
    best = (prefixes.join(mods, [key, "mpath"])
            .groupBy(key, "src", "name").agg(F.max_by("dst", F.struct("n", "pkg")).alias("dst")))
    return best.select(key, "src", "dst").where(F.col("src") != F.col("dst")).distinct()


def fan_in_out(edges: DataFrame, key: str = "repo_id") -> DataFrame:
    """(key, node, fan_out, fan_in) for every node that appears in an edge."""
    e = edges.select(key, "src", "dst").distinct()
    out = e.groupBy(key, F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("fan_out"))
    inn = e.groupBy(key, F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("fan_in"))
    return (out.join(inn, [key, "node"], "full_outer")
            .select(key, "node", F.coalesce("fan_out", F.lit(0)).alias("fan_out"),
                    F.coalesce("fan_in", F.lit(0)).alias("fan_in")))


def reverse_deps(edges: DataFrame, key: str = "repo_id") -> DataFrame:
    """The reversed edge table (key, file, importer); long form, never a nested list."""
    return edges.select(key, F.col("dst").alias("file"), F.col("src").alias("importer")).distinct()


def cycle_components(edges: DataFrame, key: str = "repo_id", stats: dict | None = None, small: int = SMALL) -> DataFrame:
    """H1 (deterministic contract): nodes that lie on a cycle, with their strongly
    connected component -> (key, node, component, component_size).

    ``component`` is the smallest node of the component. Components are found by contraction
    (``operators/contraction``); all reachable pairs are never materialised. A node is on a
    cycle when its component has two or more nodes or it has an edge to itself.
    """
    e = cut_lineage(edges.select(key, "src", "dst").distinct())
    comp = strongly_connected(e, key, stats, small)
    sizes = _fresh(comp).groupBy(key, "component").agg(F.count(F.lit(1)).alias("component_size"))
    loops = (_fresh(e).where(F.col("src") == F.col("dst")).select(key, F.col("src").alias("node"))
             .join(_fresh(comp.select(key, "node")), [key, "node"], "left_anti"))
    return (comp.join(sizes, [key, "component"]).select(key, "node", "component", "component_size")
            .unionByName(loops.select(key, "node", F.col("node").alias("component"), F.lit(1).cast("long").alias("component_size"))))


def simple_cycles(edges: DataFrame, max_length: int, key: str = "repo_id") -> DataFrame:
    """H1(b): every simple cycle of at most ``max_length`` edges, once, from its smallest node on
    -> (key, cycle, length); ``cycle`` lists its nodes, the first one not repeated.

    Paths are grown from each node over larger nodes of its component only. For every start the fewest
    edges that lead back from each node are found first (backwards, a round for each edge), and a
    path is only extended to nodes from which the start is still within reach, so no path is grown
    that all walks of the rest's length would have to leave open.
    """
    e = cut_lineage(edges.select(key, "src", "dst").distinct())
    comp = cut_lineage(strongly_connected(e, key))
    of = _fresh(comp)
    inner = (e.join(of.select(key, F.col("node").alias("src"), F.col("component").alias("cs")), [key, "src"])
             .join(_fresh(comp).select(key, F.col("node").alias("dst"), F.col("component").alias("cd")), [key, "dst"])
             .where("cs = cd AND src <> dst").select(key, "src", "dst"))
    inner = cut_lineage(inner)
    # fewest edges from v back to start, over nodes larger than start
    home = cut_lineage(_fresh(inner).where("src > dst").select(key, F.col("dst").alias("start"), F.col("src").alias("v"), F.lit(1).alias("back")))
    for step in range(2, max_length):
        last = home.where(F.col("back") == step - 1)
        if last.isEmpty():
            break
        new = (_fresh(last).join(_fresh(inner).select(key, F.col("src").alias("u"), F.col("dst").alias("v")), [key, "v"]).where("u > start")
               .select(key, "start", F.col("u").alias("v")).distinct()
               .join(_fresh(home.select(key, "start", "v")), [key, "start", "v"], "left_anti"))
        home = cut_lineage(home.unionByName(new.withColumn("back", F.lit(step))))
    steps = cut_lineage(_fresh(inner).where("dst > src").select(key, F.col("src").alias("start"), F.col("dst").alias("v"))
                        .join(_fresh(home), [key, "start", "v"]).where(F.col("back") < max_length)
                        .select(key, "start", F.array("start", "v").alias("cycle"), "v", "back"))
    loops = _fresh(e).where("src = dst").select(key, F.array("src").alias("cycle"))
    found, paths = loops, steps
    for length in range(2, max_length + 1):
        found = found.unionByName(_fresh(paths).where("back = 1").select(key, "cycle"))
        if length == max_length or paths.isEmpty():
            break
        grown = (_fresh(paths).drop("back").join(_fresh(inner).select(key, F.col("src").alias("v"), F.col("dst").alias("w")), [key, "v"])
                 .where("w > start AND NOT array_contains(cycle, w)")
                 .join(_fresh(home).select(key, "start", F.col("v").alias("w"), "back"), [key, "start", "w"])
                 .where(F.col("back") <= max_length - length))
        paths = cut_lineage(grown.select(key, "start", F.array_append("cycle", F.col("w")).alias("cycle"), F.col("w").alias("v"), "back"))
    return found.select(key, "cycle", F.size("cycle").cast("long").alias("length"))


def dependency_depth(edges: DataFrame, nodes: DataFrame | None = None, key: str = "repo_id", stats: dict | None = None,
                     small: int = SMALL) -> DataFrame:
    """H2: number of nodes on the longest import chain from each node (a leaf is 1).

    Cycles are collapsed to their component, which weighs its node count; the heaviest chains of the
    condensed graph are found by rake and compress (``operators/contraction``).
    -> (key, node, depth)
    """
    depth = chain_depths(edges, key, stats, small)
    if nodes is None:
        return depth
    return (_fresh(nodes.select(key, "node").distinct()).join(_fresh(depth), [key, "node"], "left")
            .select(key, "node", F.coalesce("depth", F.lit(1)).cast("bigint").alias("depth")))


def hop_distances(edges: DataFrame, hops: int, key: str = "repo_id") -> DataFrame:
    """H4: (key, src, dst, hops): the fewest import steps, up to ``hops``, to every file reached (no self pairs).

    A round extends only the pairs found in the round before, and pairs seen earlier are removed from it.
    """
    e = cut_lineage(edges.where("src <> dst").select(key, "src", "dst").distinct())
    seen = e.withColumn("hops", F.lit(1))
    for step in range(2, hops + 1):
        last = seen.where(F.col("hops") == step - 1).select(key, "src", F.col("dst").alias("mid"))
        new = (_fresh(last).join(_fresh(e).select(key, F.col("src").alias("mid"), F.col("dst").alias("to")), [key, "mid"]).where("src <> to")
               .select(key, "src", F.col("to").alias("dst")).distinct()
               .join(_fresh(seen.select(key, "src", "dst")), [key, "src", "dst"], "left_anti"))
        seen = cut_lineage(seen.unionByName(new.withColumn("hops", F.lit(step))))
    return seen.select(key, "src", "dst", F.col("hops").cast("long").alias("hops"))


def within_hops(edges: DataFrame, hops: int, key: str = "repo_id") -> DataFrame:
    """(key, src, dst) for every dst reachable from src in 1..hops import steps (no self pairs)."""
    return hop_distances(edges, hops, key).select(key, "src", "dst")


def reach_estimates(edges: DataFrame, hops: int, key: str = "repo_id", lg_size: int = 12) -> DataFrame:
    """H4 by sketches: (key, node, reach): about how many files each file reaches within ``hops`` steps, itself aside.

    A file's HyperLogLog sketch of itself is merged into those that import it, once a round, so a round moves at
    most a sketch (2^lg_size bytes at most, relative error about 1.04 / sqrt(2^lg_size)) for each edge, however many
    files are reached. ``hop_distances`` counts exactly where the pairs themselves are wanted.
    """
    e = cut_lineage(edges.where("src <> dst").select(key, "src", "dst").distinct())
    nodes = e.select(key, F.col("src").alias("node")).unionAll(e.select(key, F.col("dst").alias("node"))).distinct()
    own = cut_lineage(nodes.groupBy(key, "node").agg(F.hll_sketch_agg("node", lg_size).alias("sketch")))
    for _ in range(hops):
        ahead = e.join(_fresh(own).select(key, F.col("node").alias("dst"), "sketch"), [key, "dst"]).select(key, F.col("src").alias("node"), "sketch")
        own = cut_lineage(own.unionByName(ahead).groupBy(key, "node").agg(F.hll_union_agg("sketch").alias("sketch")))
    return own.select(key, "node", (F.hll_sketch_estimate("sketch") - 1).cast("long").alias("reach"))


def blast_radius(static_edges: DataFrame, temporal: DataFrame, key: str = "repo_id",
                 w_static: int = 40, w_temporal: int = 60, hops: int = 1) -> DataFrame:
    """D4 + J5 + F6 for every target at once.

    static_edges: (key, src, dst); temporal: (key, a, b, pct) directional ratios.
    -> (key, target, file, static, pct, impact_weight, relationship)
    ``impact_weight = min((100*w_s*static + w_t*pct) div 100, 100)`` in integers.
    """
    if hops > 1:  # optional reach beyond direct imports (the analysed tool uses one hop)
        static_edges = within_hops(static_edges, hops, key)
    s = static_edges.select(key, F.col("src").alias("target"), F.col("dst").alias("file"),
                            F.lit(1).alias("static")).distinct()
    t = temporal.select(key, F.col("a").alias("target"), F.col("b").alias("file"), "pct")
    fused = s.join(t, [key, "target", "file"], "full_outer")
    fused = fused.select(key, "target", "file", F.coalesce("static", F.lit(0)).cast("bigint").alias("static"),
                         F.coalesce("pct", F.lit(0)).cast("bigint").alias("pct"))
    weight = F.expr(f"least((100 * {w_static} * static + {w_temporal} * pct) div 100, 100)")
    rel = (F.when((F.col("static") == 1) & (F.col("pct") > 70), "Tight Coupler (Import & Git)")
           .when(F.col("static") == 1, "Direct Import").otherwise("Shadow Coupling (Git History)"))
    return fused.select(key, "target", "file", "static", "pct",
                        weight.cast("bigint").alias("impact_weight"), rel.alias("relationship"))


def global_impact(radius: DataFrame, key: str = "repo_id") -> DataFrame:
    """Per target min(int(mean weight * (1 + 0.05 n)), 100) = (s*(20+n)) div (20 n)."""
    g = radius.groupBy(key, "target").agg(F.sum("impact_weight").alias("s"),
                                          F.count(F.lit(1)).alias("modules_affected"))
    score = F.expr("least((s * (20 + modules_affected)) div (20 * modules_affected), 100)")
    return g.select(key, "target", score.cast("bigint").alias("global_impact_score"), "modules_affected")


def risk_level(score_col: str = "global_impact_score"):
    """> 70 CRITICAL, > 40 HIGH, else MEDIUM."""
    c = F.col(score_col)
    return F.when(c > 70, "CRITICAL").when(c > 40, "HIGH").otherwise("MEDIUM")
