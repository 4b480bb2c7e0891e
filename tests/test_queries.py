"""Every registered query of the engine against its DuckDB SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from insertframe.plans import io_queries  # noqa: F401  (registers its queries)
from insertframe.plans.queries import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    if name not in ORACLES:
        assert got
        return
    picked = ", ".join(f'"{c}"' for c in columns)
    assert got == sorted(map(repr, duck.sql(f"SELECT {picked} FROM ({ORACLES[name]})").fetchall()))
    assert sorted(duck.sql(ORACLES[name]).columns) == columns
