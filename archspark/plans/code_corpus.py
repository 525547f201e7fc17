"""A parseable multi-repository code corpus rendered from the part table, and its queries.

Each part is one file of the repository named after its brand: its columns decide the kind of
path, the imports (name words), class, methods, fields, functions, endpoints, size and whether the
source is broken. Each distinct name word of a brand is a root module, so imports resolve. The
oracles in ``code_oracles`` state the expected facts from the same columns.

Paths by key mod 10: 0 test, 1 readme, 2 entry point, 3 database, 4 ignored folder, 5 back slashes,
6 JavaScript, else ordinary modules.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archspark.functions import paths
from archspark.functions.paths import is_database_file, is_test_path
from archspark.operators import extract, facts, graph, risks
from archspark.plans import answers
from archspark.plans.analysis import module_table
from archspark.session import cut_round, stored
from archspark.sources import corpus as src
from archspark.sources.tables import Tables


def code_corpus(t: Tables) -> DataFrame:
    """(repo_id, path, size, content) of every file, paths as written (one kind with back slashes)."""
    key, word = F.col("p_partkey").cast("string"), F.split("p_name", " ")[0]
    kind = F.col("p_partkey") % 10
    path = (F.when(kind == 0, F.concat(F.lit("tests/test_"), word, F.lit("_"), key, F.lit(".py")))
            .when(kind == 1, F.concat(F.lit("README_"), key, F.lit(".md")))
            .when(kind == 2, F.concat(F.lit("k"), key, F.lit("/main.py")))
            .when(kind == 3, F.concat(F.lit("k"), key, F.lit("/store.sqlite")))
            .when(kind == 4, F.concat(F.lit("node_modules/k"), key, F.lit("/lib.py")))
            .when(kind == 5, F.concat(F.lit("win\\k"), key, F.lit("\\mod_"), key, F.lit(".py")))
            .when(kind == 6, F.concat(F.lit("web/k"), key, F.lit(".js")))
            .otherwise(F.concat(F.lower("p_type"), F.lit("/"), F.regexp_replace("p_name", " ", "_"), F.lit("_"), key, F.lit(".py"))))
    size = F.col("p_size").cast("int")

    def several(n, one):
        return F.array_join(F.transform(F.slice(F.sequence(F.lit(0), F.lit(9)), 1, n), one), "")

    python = F.concat(
        F.array_join(F.transform(F.split("p_name", " "), lambda w: F.concat(F.lit("import "), w, F.lit("\n"))), ""),
        F.lit("class C"), key, F.when(size % 3 == 0, "(Base)").when(size % 3 == 1, "(object)").otherwise("(models.Model)"), F.lit(":\n    tag: int = 0\n"),
        F.when(size % 2 == 0, "    f = Column(1)\n").otherwise(""),
        several(size % 4, lambda i: F.concat(F.lit("    def m"), i.cast("string"), F.lit("(self):\n        pass\n"))),
        several((F.col("p_partkey") % 3).cast("int"), lambda i: F.concat(F.lit("def f"), i.cast("string"), F.lit("(x):\n    pass\n"))),
        F.when(size % 2 == 1, F.concat(F.lit("@router.post('/"), F.lower("p_type"), F.lit("')\ndef h(x):\n    pass\n"))).otherwise(""),
        F.when(F.col("p_partkey") % 4 == 0, "@app.route('/r', methods=['get', 'put'])\ndef g():\n    pass\n").otherwise(""),
        F.when(F.col("p_partkey") % 11 == 0, "def broken(:\n").otherwise(""),
        F.lit("#"), F.repeat(F.lit("x"), size * size * 14), F.lit("\n"))
    content = F.when(path.endswith(".py"), python).otherwise(F.concat(F.lit("text "), key, F.lit("\n")))
    parts = t.spread("part", "p_partkey", "p_brand", "p_name", "p_type", "p_size")
    files = parts.select(F.col("p_brand").alias("repo_id"), path.alias("path"), content.cast("binary").alias("content"))
    modules = (t.part.select(F.col("p_brand").alias("repo_id"), F.explode(F.split("p_name", " ")).alias("w")).distinct()
               .select("repo_id", F.concat("w", F.lit(".py")).alias("path"), F.lit("").cast("binary").alias("content")))
    return files.unionByName(modules).select("repo_id", "path", F.octet_length("content").cast("long").alias("size"), "content")


class Code:
    """Facts of the corpus, as ``build_analysis`` derives them, without the history.

    Sources are rendered and parsed once: the inventory, the facts and the import edges are kept in the checkpoint
    folder, where several tables read them. The flat ones are kept without a size estimate (``cut_round``), as
    one by column types takes them for small and has the driver broadcast them; the nested facts as columns (``stored``),
    of which each reader needs a few.
    """

    def __init__(self, t: Tables):
        self.t = t
        self.corpus = code_corpus(t)

    @cached_property
    def inventory(self) -> DataFrame:
        return cut_round(self.t.gathered(src.inventory(self.corpus), "part"))

    @property
    def parsed(self) -> DataFrame:
        """The facts for one reader."""
        # what ``inventory`` keeps of the same rows, without a join that would move every text
        named = self.corpus.withColumn("path", paths.normalise("path")).where(F.col("repo_id").isNotNull() & ~paths.is_ignored("path"))
        return extract.code_facts(named)

    @cached_property
    def facts(self) -> DataFrame:
        return stored(self.parsed)

    @cached_property
    def imports(self) -> DataFrame:
        raw = self.facts.select("repo_id", F.col("path").alias("src"), F.explode("imports.module").alias("module"))
        return cut_round(graph.resolve_imports(raw, module_table(self.inventory)))

    @cached_property
    def file_facts(self) -> DataFrame:
        return facts.file_facts(self.inventory, self.facts, self.imports)

    @property
    def tests(self) -> DataFrame:
        return self.inventory.where(is_test_path("path")).select("repo_id", "path")

    def history(self, t: Tables) -> DataFrame:
        """Files of the larger parts count as seen in history."""
        big = t.part.where("p_size > 20").select(F.col("p_partkey"), F.col("p_brand").alias("repo_id"))
        named = self.inventory.withColumn("p_partkey", F.regexp_extract("path", r"([0-9]+)[^0-9]*$", 1).try_cast("long"))
        return named.join(big.hint("merge"), ["repo_id", "p_partkey"], "left_semi").select("repo_id", "path")

    def coverage(self, t: Tables) -> DataFrame:
        return facts.coverage(self.inventory, self.facts, self.imports, self.history(t), extract.routes(self.facts))


def corpus_code_facts(spark, sf_dir):
    f = Code(Tables(spark, sf_dir)).parsed
    size = lambda c, name: F.size(c).cast("bigint").alias(name)
    return f.select("repo_id", "path", "parsed", size("imports", "n_imports"), size("classes", "n_classes"), size("functions", "n_functions"),
                    size("endpoints", "n_endpoints"), size("models", "n_models"),
                    F.coalesce(F.get(F.col("models"), F.lit(0))["fields"], F.array().cast("array<string>")).alias("fields0"))\
        .withColumn("fields0", F.array_join("fields0", ","))


def corpus_fact_rows(spark, sf_dir):
    corpus = code_corpus(Tables(spark, sf_dir)).withColumn("path", paths.normalise("path"))
    found = extract.fact_rows(corpus.where(~paths.is_ignored("path")))
    return found.select("repo_id", "path", "kind", "name", F.col("line").cast("long").alias("line"), F.array_join("items", ",").alias("items"))


def corpus_path_parts(spark, sf_dir):
    return paths.path_parts(code_corpus(Tables(spark, sf_dir)).select("repo_id", "path"))


def corpus_imports(spark, sf_dir):
    return Code(Tables(spark, sf_dir)).imports


def corpus_routes(spark, sf_dir):
    return extract.routes(Code(Tables(spark, sf_dir)).parsed)


def corpus_file_facts(spark, sf_dir):
    return Code(Tables(spark, sf_dir)).file_facts


def corpus_coverage(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return Code(t).coverage(t).fillna(-1, ["git_pct", "route_pct"])  # -1: not available


def corpus_evidence(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return facts.evidence_records(Code(t).coverage(t)).select("repo_id", "evidence_type", "status", "coverage_pct", "confidence_pct").fillna(-1, ["coverage_pct"])


def corpus_health(spark, sf_dir):
    c = Code(Tables(spark, sf_dir))
    return facts.health(c.file_facts, c.inventory.where(is_database_file("path")).select("repo_id", "path"))


def corpus_oversized(spark, sf_dir):
    return risks.risk_oversized(Code(Tables(spark, sf_dir)).file_facts)


def corpus_missing_tests(spark, sf_dir):
    c = Code(Tables(spark, sf_dir))
    return risks.missing_tests(c.file_facts, c.tests)


def corpus_affected_tests(spark, sf_dir):
    c = Code(Tables(spark, sf_dir))
    return risks.affected_tests(c.inventory, c.tests)


def corpus_impact_lists(spark, sf_dir):
    return answers.impact_lists(Code(Tables(spark, sf_dir)).imports)


def corpus_risk_evidence(spark, sf_dir):
    c = Code(Tables(spark, sf_dir))
    ff = cut_round(c.file_facts)  # four readers
    comps = graph.cycle_components(c.imports)
    return answers.risk_evidence(ff, comps, graph.dependency_depth(c.imports), risks.missing_tests(ff, c.tests))


QUERIES = {f.__name__: f for f in (
    corpus_code_facts, corpus_fact_rows, corpus_path_parts, corpus_imports, corpus_routes, corpus_file_facts, corpus_coverage, corpus_evidence,
    corpus_health, corpus_oversized, corpus_missing_tests, corpus_affected_tests, corpus_impact_lists, corpus_risk_evidence)}
