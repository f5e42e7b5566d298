import math
import sys

import duckdb
import pandas as pd
import pytest

from lakeloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return con


def number(v):
    return not isinstance(v, (str, bool)) and hasattr(v, "__float__")


def comparable(df):
    """Rows in order, for which numbers count to six digits only."""
    df = df[sorted(df.columns)]
    cell = lambda v: None if v is None or v is pd.NaT or v is pd.NA or v != v else float(v) if number(v) else str(v)
    rows = [tuple(cell(v) for v in r) for r in df.itertuples(index=False)]
    return sorted(rows, key=lambda r: [f"{v:.6g}" if isinstance(v, float) else str(v) for v in r])


def same(got, expected):
    near = lambda a, b: a == b or isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return len(got) == len(expected) and all(near(a, b) for x, y in zip(got, expected) for a, b in zip(x, y))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    expected = duck.sql(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    got, expected = comparable(got), comparable(expected)
    assert same(got, expected), next(((a, b) for a, b in zip(got, expected) if not same([a], [b])), (len(got), len(expected)))


def test_entry_imports_without_the_training_operators(monkeypatch):
    sys.modules.pop("__spark_entry__", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    import __spark_entry__

    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    sys.modules.pop("__spark_entry__", None)
