"""Every registered query with an oracle agrees with DuckDB on the smallest tables."""

import math

import pytest

import __spark_entry__ as E

from conftest import SMALL


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    got = _rows(E.queries()[name](spark, SMALL).toPandas())
    want = _rows(duck.sql(E.oracle_sql()[name]).df())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]


def test_every_query_runs(spark):
    for name, fn in E.queries().items():
        if name in E.oracle_sql():
            continue  # run and compared above
        df = fn(spark, SMALL)
        assert df.columns, name


def test_entry(spark):
    df = E.entry(spark)
    assert set(df.columns) == {"repo_id", "a", "b", "joint", "total_a", "pct"}
    assert df.count() >= 0
