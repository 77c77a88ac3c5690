"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import os

import pytest

from tablesmith.plans import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(str(round(v, 5)) if isinstance(v, float) else str(v) for v in row) for row in frame.astype(object).itertuples(index=False))


#: The widest plans are left to the driver's own comparison.
@pytest.mark.parametrize("name", sorted(set(queries.ORACLE) - {"target_records", "broad_records", "template_four", "page_follow", "engine_retry"}))
def test_against_duckdb(spark, duck, name):
    mine, theirs = queries.QUERIES[name](spark, SF).toPandas(), duck.execute(queries.ORACLE[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert [tuple(c.removesuffix(".0") for c in r) for r in plain(mine.fillna("null"))] == [tuple(c.removesuffix(".0") for c in r) for r in plain(theirs.astype(object).where(theirs.notna(), "null"))]


def test_the_entry_imports_before_there_is_a_session():
    import subprocess
    import sys
    from pathlib import Path

    said = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(len(e.queries()))"
    found = subprocess.run([sys.executable, "-c", said], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True)
    assert found.returncode == 0, found.stderr[-500:]
    assert int(found.stdout.split()[-1]) >= len(queries.QUERIES)
