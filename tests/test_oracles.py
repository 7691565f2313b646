"""Every registered query of the library against its SQL, value by value."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from rentgrid.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def text(x) -> str:
    if isinstance(x, (list, np.ndarray)):
        return str([text(y) for y in x])
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, (float, np.floating)) and x != x):
        return "null"
    if isinstance(x, (int, float, np.integer, np.floating)) and not isinstance(x, (bool, np.bool_)):
        return repr(round(float(x), 6) + 0.0)
    return str(x)


def canonical(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    return [list(df.columns), *sorted([text(v) for v in r] for r in df.itertuples(index=False, name=None))]


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf, duck, name):
    got = QUERIES[name](spark, sf).toPandas()
    if name in ORACLES:
        assert canonical(got) == canonical(duck.execute(ORACLES[name]).df())
    else:
        assert len(got.columns) > 0


def test_entry_imports_and_lists_the_library(spark):
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLES) <= set(__spark_entry__.oracle_sql())
    assert __spark_entry__.entry(spark).count() > 0
