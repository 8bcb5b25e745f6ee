"""Every registered query of the core library against its DuckDB SQL."""

import duckdb
import pandas as pd
import pytest

from twinlake import queries as core

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(frame):
    def norm(v):
        if v is None or v is pd.NA or v != v:
            return "null"
        if isinstance(v, (int, float)) or type(v).__module__ == "numpy" and type(v).__name__ != "bool":
            return repr(round(float(v), 6))
        return str(v)

    return sorted(tuple(map(norm, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, duck, name):
    found = core.QUERIES[name](spark, DATA).toPandas()
    if name in core.SQL:
        assert rows(found) == rows(duck.execute(core.SQL[name]).df())
    else:
        assert len(found)
