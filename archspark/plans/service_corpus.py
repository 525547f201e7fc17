"""Small services rendered from the customer table, forty customers a repository, and the answers about them.

Each customer is one file of its repository: views with routes, class methods and imports of stores, logic modules that
import each other in a ring (repositories of even number) or a chain, database stores, and entry points; some
logic modules have a test. Files of a repository changed together when their customers ordered in one month. So every risk detector, cycles, deep chains, entry points, routes of a layer, co-change and
change plans have something to find; ``service_oracles`` states it from the same columns.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archspark.operators import extract, facts, graph, history, risks
from archspark.functions.paths import is_database_file, is_entry_point, is_test_path
from archspark.plans import answers, reports
from archspark.plans.analysis import module_table
from archspark.session import cut_round, stored
from archspark.sources import corpus as src
from archspark.sources import dims, manifests
from archspark.sources.tables import Tables

LAYERS = (("views_", "API Layer"), ("logic_", "Logic Layer"), ("db_store_", "Data Layer"))


def _repo(k):
    return F.concat(F.lit("svc"), F.floor(k / 40).cast("string"))


def _path(k):
    s = k.cast("string")
    return (F.when(k % 4 == 0, F.concat(F.lit("views_"), s, F.lit(".py"))).when(k % 4 == 1, F.concat(F.lit("logic_"), s, F.lit(".py")))
            .when(k % 4 == 2, F.concat(F.lit("db_store_"), s, F.lit(".py"))).otherwise(F.concat(F.lit("run_"), s, F.lit("/main.py"))))


def service_corpus(t: Tables) -> DataFrame:
    """(repo_id, path, size, content)."""
    k = F.col("c_custkey")
    s = k.cast("string")

    def name(prefix, number):
        return F.concat(F.lit("import " + prefix), number.cast("string"), F.lit("\n"))

    place = k % 40
    routes = F.array_join(F.transform(F.slice(F.sequence(F.lit(0), F.lit(7)), 1, (F.floor(k / 4) % 8).cast("int")), lambda j: F.concat(
        F.lit("@app.get('/v"), s, F.lit("/"), j.cast("string"), F.lit("')\ndef h"), j.cast("string"), F.lit("(x):\n    pass\n"))), "")
    views = F.concat(name("db_store_", k + 2), F.when(k % 3 == 0, name("db_store_", k + 6)).otherwise(""), name("logic_", k + 1),
                     F.lit("class V"), s, F.lit(":\n    def "), F.when(k % 5 == 0, "execute_").otherwise("show_"), s, F.lit("(self):\n        pass\n"), routes)
    following = F.when(place < 36, name("logic_", k + 4)).when(F.floor(k / 40) % 2 == 0, name("logic_", k - 36)).otherwise("")
    logic = F.concat(following, F.lit("def run_"), s, F.lit("(x):\n    pass\n"))
    store = F.concat(F.lit("class S"), s, F.lit(":\n    x = Column(1)\n"))
    main = F.concat(name("views_", k - 3), name("logic_", k - 2), F.lit("if True:\n    pass\n"))
    filler = F.concat(F.lit("#"), F.repeat(F.lit("x"), ((k % 7) * 7000).cast("int")), F.lit("\n"))
    body = F.when(k % 4 == 0, views).when(k % 4 == 1, logic).when(k % 4 == 2, store).otherwise(main)
    customers = t.spread("customer", "c_custkey")
    files = customers.select(_repo(k).alias("repo_id"), _path(k).alias("path"), F.concat(body, F.when(k % 4 != 3, filler).otherwise("")).cast("binary").alias("content"))
    tests = customers.where(k % 16 == 5).select(_repo(k).alias("repo_id"), F.concat(F.lit("tests/test_logic_"), s, F.lit(".py")).alias("path"),
                                                 name("logic_", k).cast("binary").alias("content"))
    data = customers.where(k % 16 == 6).select(_repo(k).alias("repo_id"), F.concat(F.lit("data/s_"), s, F.lit(".sqlite")).alias("path"), F.lit("x").cast("binary").alias("content"))
    return files.unionByName(tests).unionByName(data).select("repo_id", "path", F.octet_length("content").cast("long").alias("size"), "content")


class Service:
    """Everything derived from the services; sources are rendered and parsed once, as in ``code_corpus.Code``."""

    def __init__(self, t: Tables):
        self.t = t
        self.corpus = service_corpus(t)

    @cached_property
    def inventory(self) -> DataFrame:
        return cut_round(self.t.gathered(src.inventory(self.corpus), "customer"))

    @cached_property
    def facts(self) -> DataFrame:
        return stored(extract.code_facts(self.corpus))

    @cached_property
    def imports(self) -> DataFrame:
        raw = self.facts.select("repo_id", F.col("path").alias("src"), F.explode("imports.module").alias("module"))
        return cut_round(graph.resolve_imports(raw, module_table(self.inventory)))

    @property
    def routes(self) -> DataFrame:
        return extract.routes(self.facts)

    @cached_property
    def file_facts(self) -> DataFrame:
        return facts.file_facts(self.inventory, self.facts, self.imports)

    @property
    def assignments(self) -> DataFrame:
        layer = F.lit("Runtime Layer")
        for prefix, named in LAYERS:
            layer = F.when(F.col("path").startswith(prefix), named).otherwise(layer)
        return self.inventory.select("repo_id", "path", layer.alias("layer"))

    def risks(self) -> DataFrame:
        tests = self.inventory.where(is_test_path("path")).select("repo_id", "path")
        ff = cut_round(self.file_facts)  # four readers
        cycles = risks.risk_cycle_paths(graph.simple_cycles(self.imports, 12)).drop("path", "length")
        return risks.union_risks(risks.risk_oversized(ff), cycles, risks.risk_deep(graph.dependency_depth(self.imports)), risks.risk_routes(ff),
                                 risks.risk_database(ff, self.facts, self.imports), risks.risk_missing_tests(risks.missing_tests(ff, tests)))

    def cochange(self) -> DataFrame:
        """Files whose customers ordered in one month."""
        k = F.col("o_custkey")
        cf = self.t.orders.select(_repo(k).alias("repo_id"), F.date_format("o_orderdate", "yyyy-MM").alias("commit_id"), _path(k).alias("path"))
        return history.temporal_matrix(cf)

    def coverage(self) -> DataFrame:
        return facts.coverage(self.inventory, self.facts, self.imports, None, self.routes)

    def affected(self) -> DataFrame:
        """(repo_id, target, file): each views module, what it imports and what imports it."""
        views = self.inventory.where(F.col("path").startswith("views_")).select("repo_id", F.col("path").alias("target"))
        out = views.select("repo_id", "target", F.col("target").alias("file"))
        down = views.join(self.imports.select("repo_id", F.col("src").alias("target"), F.col("dst").alias("file")), ["repo_id", "target"])
        up = views.join(self.imports.select("repo_id", F.col("dst").alias("target"), F.col("src").alias("file")), ["repo_id", "target"])
        return out.unionByName(down).unionByName(up).distinct()


def service_risks(spark, sf_dir):
    return Service(Tables(spark, sf_dir)).risks()


def service_ownership(spark, sf_dir):
    s = Service(Tables(spark, sf_dir))
    return reports.ownership(s.assignments, s.imports, s.routes)


def service_entry_points(spark, sf_dir):
    s = Service(Tables(spark, sf_dir))
    return answers.related_entry_points(s.assignments, s.imports)


def service_layer_routes(spark, sf_dir):
    s = Service(Tables(spark, sf_dir))
    return answers.layer_routes(s.assignments, s.routes)


def service_change_risk(spark, sf_dir):
    s = Service(Tables(spark, sf_dir))
    return reports.change_impact(s.file_facts, s.assignments, s.risks(), s.cochange())


def service_brief(spark, sf_dir):
    s = Service(Tables(spark, sf_dir))
    deps = s.inventory.select("repo_id", F.lit("fastapi").alias("dep")).where(F.substring("repo_id", -1, 1) == "1").distinct()
    return answers.brief(manifests.project_profile(s.inventory, deps), s.inventory, s.assignments, s.risks(), s.coverage())


def service_affected(spark, sf_dir):
    s = Service(Tables(spark, sf_dir))
    return answers.affected_content(s.affected(), s.risks(), s.routes)


def service_plans(spark, sf_dir):
    """Goals about every views module, one of five wordings by its number."""
    s = Service(Tables(spark, sf_dir))
    k = F.regexp_extract("target", r"([0-9]+)", 1)
    words = F.array(*[F.lit(w) for w in GOALS])
    goals = s.affected().select("repo_id", "target").distinct().select(
        F.concat(F.lit("goal "), k).alias("goal_id"), "repo_id", "target", F.concat(words[(k.cast("int") / 4).cast("int") % len(GOALS)], F.lit(" in "), F.col("target")).alias("goal"))
    return answers.plan_steps(goals, s.affected().where("file <> target"))


GOALS = ("Add JWT login", "Move to postgres", "Use a redis cache", "Rename helpers", "Speed up the database")

QUERIES = {f.__name__: f for f in (service_risks, service_ownership, service_entry_points, service_layer_routes, service_change_risk,
                                   service_brief, service_affected, service_plans)}
