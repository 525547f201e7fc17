"""Bind the driver's star-schema tables to the code-analytics input shapes.

These bindings are what the DuckDB oracles re-state in SQL (``archspark.plans.oracles``).

* commits         = orders: repo = order priority, commit = order, ts = order date, author = customer
* part_commits    = distinct (order, part) of lineitem: a commit touching "files" = parts
* supplier_commits= distinct (order, supplier) of lineitem
* nation_edges    = customer nation -> each other supplier nation with at least one and a half times its mean lines
* supplier_edges  = supplier -> each partner it meets two standard deviations more often than its mean partner (per repo)
* part_edges      = part -> each partner it changed with at least twice (per repo); part_graph: over all orders
* part_files      = part as a file inventory: path = <type>/<name words>_<key>.py, size = p_size*100
* document_files  = documents as a file inventory: path = <source>/<lang>/<doc_id>.txt, size = n_chars
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archspark.operators import history
from archspark.session import cut_round, stored
from archspark.sources.tables import Tables

REPO = "repo_id"

#: lines whose commits' pairs are counted in one partition
LINES_A_PART = 100_000


def commits(t: Tables) -> DataFrame:
    o = t.orders
    return o.select(F.col("o_orderpriority").alias(REPO), F.col("o_orderkey").alias("commit_id"),
                    F.col("o_orderdate").alias("commit_ts"), F.col("o_custkey").alias("author"))


def _commit_files(t: Tables, file_col: str) -> DataFrame:
    li = t.lineitem.select("l_orderkey", file_col)
    c = commits(t)
    return (li.join(c, li.l_orderkey == c.commit_id)
            .select(REPO, "commit_id", "commit_ts", "author", F.col(file_col).alias("path")))


def part_commits(t: Tables) -> DataFrame:
    return _commit_files(t, "l_partkey")


def supplier_commits(t: Tables) -> DataFrame:
    return _commit_files(t, "l_suppkey")


def supplier_blocks(t: Tables) -> DataFrame:
    """The supplier commits as rows of arrays, stored: lines and orders are joined once for the files and all pairs."""
    return stored(history.commit_blocks(supplier_commits(t)))


def pair_parts(t: Tables) -> int:
    """Partitions for the pairs of the lines' commits."""
    return max(int(t.spark.conf.get("spark.sql.shuffle.partitions")), -(-t.lineitem.count() // LINES_A_PART))


def nation_edges(t: Tables) -> DataFrame:
    """(repo_id, src, dst): src buys from dst at least 1.5 times as much as from its mean partner nation."""
    li = t.lineitem.select("l_orderkey", "l_suppkey")
    o = t.orders.select("o_orderkey", "o_custkey")
    c = t.customer.select("c_custkey", "c_nationkey")
    s = t.supplier.select("s_suppkey", "s_nationkey")
    # customer and supplier are dimension-sized; AQE may broadcast them after measuring.
    lines = (li.join(o, li.l_orderkey == o.o_orderkey)
             .join(c, o.o_custkey == c.c_custkey)
             .join(s, li.l_suppkey == s.s_suppkey)
             .where(F.col("c_nationkey") != F.col("s_nationkey"))
             .groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst"))
             .agg(F.count(F.lit(1)).alias("n")))
    w = Window.partitionBy("src")
    return (lines.withColumn("c", F.count("*").over(w)).withColumn("s", F.sum("n").over(w)).where("2 * n * c >= 3 * s")
            .select(F.lit("nations").alias(REPO), F.col("src").cast("bigint").alias("src"),
                    F.col("dst").cast("bigint").alias("dst")))


def supplier_ties(t: Tables, ratios: DataFrame | None = None, **pair_opts) -> DataFrame:
    """The co-change ratios with ``edge``: joint count above mean + 2 sqrt(mean) of the supplier's pairs (in integers).

    A window over the rows of a supplier, which already lie together: no second count of the pairs is joined back.
    """
    r = ratios if ratios is not None else history.cochange_ratios(supplier_commits(t), **pair_opts)
    w = Window.partitionBy(REPO, "a")
    above = F.expr("joint * c > s AND (joint * c - s) * (joint * c - s) > 4 * s * c")
    return r.withColumn("c", F.count("*").over(w)).withColumn("s", F.sum("joint").over(w)).withColumn("edge", above).drop("c", "s")


def supplier_edges(t: Tables, ratios: DataFrame | None = None, **pair_opts) -> DataFrame:
    """(repo_id, src, dst): the ties of suppliers that are edges."""
    return tie_edges(supplier_ties(t, ratios, **pair_opts))


def tie_edges(ties: DataFrame) -> DataFrame:
    return ties.where("edge").select(REPO, F.col("a").alias("src"), F.col("b").alias("dst"))


def part_files(t: Tables) -> DataFrame:
    """(repo_id, path, size, extension, key): parts as a file inventory of one repo."""
    p = t.part
    path = F.concat(F.lower(F.col("p_type")), F.lit("/"), F.regexp_replace(F.col("p_name"), " ", "_"),
                    F.lit("_"), F.col("p_partkey").cast("string"), F.lit(".py"))
    return p.select(F.lit("parts").alias(REPO), path.alias("path"),
                    (F.col("p_size").cast("bigint") * 100).alias("size"),
                    F.lit(".py").alias("extension"), F.col("p_partkey").alias("key"))


def document_files(t: Tables) -> DataFrame:
    """(repo_id, path, size, extension, doc_id): documents as Python-like files, one repo per
    source; path = <lang>/<doc_id>.py, size = n_chars."""
    d = t.documents
    path = F.concat(F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".py"))
    return d.select(F.col("source").alias(REPO), path.alias("path"), F.col("n_chars").alias("size"),
                    F.lit(".py").alias("extension"), "doc_id")


def document_corpus(t: Tables) -> DataFrame:
    """(repo_id, path, content): the whole document texts as source files."""
    d = t.documents
    path = F.concat(F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".py"))
    return d.select(F.col("source").alias(REPO), path.alias("path"), F.col("text").alias("content"))


def benchmark_tests(t: Tables) -> DataFrame:
    """(path): a shared test suite, one test module per benchmark item."""
    return t.benchmark.select(F.concat(F.lit("tests/test_"), F.col("item_id").cast("string"),
                                       F.lit(".py")).alias("path"))


def labelled_history(t: Tables) -> DataFrame:
    """(repo_id, path): documents with a label row count as 'seen in history'."""
    d = t.documents.select("doc_id", "source", "lang")
    return (d.join(t.labels.select("doc_id"), "doc_id", "left_semi")
            .select(F.col("source").alias(REPO),
                    F.concat(F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path")))


def page_routes(t: Tables) -> DataFrame:
    """(repo_id, path, route, method, handler): every distinct href of a page is a GET route of it."""
    p = t.pages.select("url", F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), 1)).alias("route"))
    return (p.distinct().select(F.lit("pages").alias(REPO), F.col("url").alias("path"), "route",
                                F.lit("GET").alias("method"),
                                F.concat(F.col("url"), F.lit(":page")).alias("handler")))


def part_edges(t: Tables, ratios: DataFrame | None = None, **pair_opts) -> DataFrame:
    """(repo_id, src, dst): parts changed together at least twice in a repo."""
    r = ratios if ratios is not None else history.cochange_ratios(part_commits(t), **pair_opts)
    return (r.where("joint >= 2")
            .select(REPO, F.col("a").alias("src"), F.col("b").alias("dst")))


def part_modules(t: Tables) -> DataFrame:
    """Root-level module files, one per distinct part-name word: (repo_id, module, file)."""
    w = t.part.select(F.explode(F.split(F.col("p_name"), " ")).alias("module")).distinct()
    return w.select(F.lit("parts").alias(REPO), "module", F.concat("module", F.lit(".py")).alias("file"))


def part_raw_imports(t: Tables) -> DataFrame:
    """Each part file 'imports' the words of its name and its type: (repo_id, src, module)."""
    pf = part_files(t)
    p = t.part.select(F.col("p_partkey").alias("key"),
                      F.concat(F.split(F.col("p_name"), " "), F.array(F.lower("p_type"))).alias("mods"))
    return pf.join(p, "key").select(REPO, F.col("path").alias("src"), F.explode("mods").alias("module"))


def supplier_files(t: Tables) -> DataFrame:
    """(repo_id, path): suppliers seen in each repo's commits."""
    return supplier_commits(t).select(REPO, "path").distinct()


def supplier_models(t: Tables, files: DataFrame | None = None) -> DataFrame:
    """(repo_id, path, model): a supplier 'defines' the model named after its nation."""
    s = t.supplier.select(F.col("s_suppkey").alias("path"),
                          F.concat(F.lit("nation_"), F.col("s_nationkey").cast("string")).alias("model"))
    return (supplier_files(t) if files is None else files).join(s, "path").select(REPO, "path", "model")


def supplier_routes(t: Tables, files: DataFrame | None = None) -> DataFrame:
    """(repo_id, path, route): a supplier 'serves' the part types it supplies more than its mean type."""
    li = t.lineitem.select("l_suppkey", "l_partkey")
    p = t.part.select("p_partkey", "p_type")
    counts = (li.join(p, li.l_partkey == p.p_partkey).groupBy("l_suppkey", "p_type")
              .agg(F.count(F.lit(1)).alias("n")))
    w = Window.partitionBy("l_suppkey")
    top = (counts.withColumn("c", F.count("*").over(w)).withColumn("s", F.sum("n").over(w)).where("n * c > s")
           .select(F.col("l_suppkey").alias("path"), F.concat(F.lit("/"), F.lower("p_type")).alias("route")))
    if files is not None:  # for several readers: the part lines are counted once
        top = cut_round(top)
    return (supplier_files(t) if files is None else files).join(top, "path").select(REPO, "path", "route")


# Binding taxonomy for part files (data, not code): layer, priority, keywords.
PART_LAYERS = [
    ("Fastener Layer", ["bolt", "rod", "ring"]),
    ("Tooling Layer", ["gear", "anvil", "plate"]),
    ("Gadget Layer", ["gizmo", "widget"]),
    ("Climate Layer", ["hot", "cold"]),
    ("Core Runtime Layer", []),
]
PART_PATH_RULES = [
    ("path", 1, "Tooling Layer", "^large/", 8),
    ("path", 2, "Gadget Layer", "^(promo|small)/", 8),
]


def part_taxonomy(spark):
    rows = [(layer, i, kw) for i, (layer, kws) in enumerate(PART_LAYERS, start=1) for kw in kws]
    return spark.createDataFrame(rows, "layer string, priority int, keyword string")


def part_layers(spark):
    return spark.createDataFrame([(layer, i) for i, (layer, _) in enumerate(PART_LAYERS, start=1)],
                                 "layer string, priority int")


def part_path_rules(spark):
    return spark.createDataFrame(PART_PATH_RULES, "grp string, ord int, layer string, pattern string, points int")


def part_graph(t: Tables, **pair_opts) -> DataFrame:
    """(repo_id='parts', src, dst) over part file paths: parts together in at least two orders."""
    cf = _commit_files(t, "l_partkey").withColumn(REPO, F.lit("parts"))
    r = history.cochange_ratios(cf, **pair_opts)
    top = r.where("joint >= 2").select(REPO, "a", "b")
    pf = part_files(t)
    ps = pf.select(F.col("key").alias("a"), F.col("path").alias("src"))
    pd = pf.select(F.col("key").alias("b"), F.col("path").alias("dst"))
    return top.join(ps, "a").join(pd, "b").select(REPO, "src", "dst")


def goals(t: Tables) -> DataFrame:
    """(goal_id, goal): every user turn of every conversation is a goal sentence."""
    c = t.conversations.where(F.col("role") == "user")
    return c.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("goal_id"),
                    F.col("text").alias("goal"))


def part_layer_vocab(spark):
    """(layer, concept): a part-layer keyword in a goal makes that layer a target."""
    rows = [(layer, kw) for layer, kws in PART_LAYERS for kw in kws]
    return spark.createDataFrame(rows, "layer string, concept string")
