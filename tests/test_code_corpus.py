"""The rendered code corpus exercises every fact: no flag or count has a single value."""

import pytest
from conftest import SMALL

from archspark.plans import code_corpus as C
from archspark.plans import service_corpus as S
from archspark.sources import tables


@pytest.mark.parametrize("name, columns", [
    ("corpus_code_facts", ["parsed", "n_imports", "n_classes", "n_functions", "n_endpoints", "n_models", "fields0"]),
    ("corpus_path_parts", ["is_code", "is_database", "is_entry_point", "is_test", "is_ignored", "first_segment", "extension"]),
    ("corpus_file_facts", ["function_count", "class_count", "route_count", "import_count", "imported_by_count"]),
    ("corpus_routes", ["method", "route"]),
    ("corpus_coverage", ["ast_pct", "git_pct", "overall_pct", "confidence_pct"]),
    ("corpus_health", ["maintainability", "test_density", "structural_integrity", "documentation"]),
])
def test_values_vary(spark, name, columns):
    pdf = C.QUERIES[name](spark, SMALL).select(*columns).toPandas()
    assert {c: pdf[c].nunique() > 1 for c in columns} == dict.fromkeys(columns, True)


def test_tests_of_other_repositories_do_not_count(spark):
    from archspark.operators import risks
    ff = spark.createDataFrame([(r, "auth.py", ".py", 2000, 0, 0, 0, 0, 0) for r in ("a", "b")],
                               "repo_id string, path string, extension string, size long, function_count long, class_count long, "
                               "route_count long, import_count long, imported_by_count long")
    tests = spark.createDataFrame([("a", "tests/test_auth.py")], "repo_id string, path string")
    assert [r.repo_id for r in risks.missing_tests(ff, tests).collect()] == ["b"]
    assert [(r.repo_id, r.test) for r in risks.affected_tests(ff, tests).collect()] == [("a", "tests/test_auth.py")]


def test_sources_are_spread_and_parsed_once(spark, tmp_path, monkeypatch):
    part = spark.range(1, 61).selectExpr("id AS p_partkey", "'B' AS p_brand", "concat('a w', id) AS p_name", "'T' AS p_type", "id % 50 + 1 AS p_size")
    part.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    spark.range(1, 81).selectExpr("id AS c_custkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    monkeypatch.setattr(tables, "ROWS_A_PART", 20)
    t = tables.Tables(spark, str(tmp_path))
    assert t.spread("part", "p_partkey", "p_brand").rdd.getNumPartitions() == 3
    assert t.spread("customer", "c_custkey").rdd.getNumPartitions() == 4
    code, service = C.Code(t), S.Service(t)
    for df in (code.file_facts, code.imports, service.file_facts, service.coverage(), service.routes):
        plan = df._jdf.queryExecution().toString()
        assert "MapIn" not in plan and "repeat(" not in plan  # neither parsed nor rendered again
    assert code.file_facts.count() == 60 - 6 + 61 and "LeftSemi" not in code.parsed._jdf.queryExecution().toString()
