import os
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from pixelmill.sources.tables import TABLES
from tests.conftest import SF_SMALL

#: Whole grids take minutes; test_models.py and test_linear_fits.py cover them and svm_cv stands for them here.
SLOW = {"lr_cv", "rf_cv", "twin_lr_cv", "twin_rf_cv", "twin_svm_cv", "kernel_svm"}


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "avg_mean" in df.columns


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def _norm(v):
    if v is None or v is pd.NA:
        return None
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    return v


SPARK_TO_DUCK = {"double": "DOUBLE", "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "float": "FLOAT"}


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - SLOW))
def test_query_matches_oracle(spark, con, name):
    sdf = entry.queries()[name](spark, SF_SMALL)
    rel = con.sql(entry.oracle_sql()[name])
    duck_types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    assert {c: SPARK_TO_DUCK.get(t, t) for c, t in sdf.dtypes} == duck_types
    s = sdf.toPandas()
    d = rel.fetchdf()
    assert sorted(s.columns) == sorted(d.columns)
    cols = sorted(s.columns)

    def rows(df):
        return sorted((tuple(_norm(x) for x in r) for r in df[cols].itertuples(index=False)), key=repr)

    assert rows(s) == rows(d)


def test_entry_without_the_corpus_operators():
    """The rest of the library works where they have been removed."""
    code = """
import importlib.util, sys
real = importlib.util.find_spec
importlib.util.find_spec = lambda name, *a: None if name in ("pixelmill.llm", "corpus_pipeline") else real(name, *a)
import __spark_entry__ as e
names = set(e.queries())
assert "hash_split" in names and "pipeline" not in names and not any(n.startswith("op1") for n in names)
assert set(e.oracle_sql()) <= names
assert not any(m.startswith("pixelmill.llm") or m == "corpus_pipeline" for m in sys.modules)
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, env=os.environ | {"PYTHONPATH": root}, check=True)
