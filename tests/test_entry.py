"""Driver contract: entry(), and every registered query vs its DuckDB oracle at sf0.001."""
import duckdb
import pytest

import __spark_entry__ as E
from support import SF001
from vecsync.sources.tables import TABLES


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) >= 1
    assert "completion_after" in df.columns


def test_every_query_has_an_oracle_or_is_known_rows_only():
    from vecsync.plans.oracle import ORACLE
    from vecsync.plans.registry import QUERIES
    rows_only = {"knn_ivf", "knn_ivf_index"}
    assert set(QUERIES) - set(ORACLE) == rows_only
    assert set(QUERIES) <= set(E.queries()) and set(ORACLE) <= set(E.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return con


ALL_WITH_ORACLE = sorted(E.oracle_sql())


@pytest.mark.parametrize("name", ALL_WITH_ORACLE)
def test_query_matches_oracle_sf0001(spark, duck, name):
    import sys, os
    sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(__file__)), "tools"))
    from verify_oracle import digest
    sdf = E.queries()[name](spark, SF001)
    srows = [tuple(r) for r in sdf.collect()]
    cur = duck.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(sdf.columns) == sorted(ocols)
    assert len(srows) == len(orows)
    assert digest(sdf.columns, srows)[0] == digest(ocols, orows)[0]
