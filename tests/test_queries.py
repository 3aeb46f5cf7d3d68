"""Every query with SQL gives what DuckDB gives, at the smallest size; plans have no cross joins."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def rows(pdf: pd.DataFrame) -> list:
    pdf = pdf[sorted(pdf.columns)].astype(object)
    pdf = pdf.where(pdf.notna(), None)
    return sorted((tuple(round(v, 6) if isinstance(v, float) else None if v is None else str(v) for v in r) for r in pdf.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_as_sql(spark, data, con, name):
    found = entry.queries()[name](spark, data).toPandas()
    expected = con.execute(entry.oracle_sql()[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows(found) == rows(expected)


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_runs(spark, data, name):
    """Their properties are tested beside the operators; here, that they have rows of one shape."""
    found = entry.queries()[name](spark, data)
    assert len(set(found.columns)) == len(found.columns) and found.count() > 0


def test_entry(spark, data):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["normalize_citations", "bib_consolidate", "dblp_best_match", "parse_bbl_files"])
def test_plans(spark, data, name):
    plan = entry.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "Python" not in plan


def test_core_does_not_need_the_training_operators():
    for path in glob.glob(os.path.join(os.path.dirname(entry.__file__), "citeloom/**/*.py"), recursive=True):
        if f"{os.sep}llm{os.sep}" not in path:
            assert "citeloom.llm" not in open(path).read(), path
