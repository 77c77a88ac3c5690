"""Registered queries of the subpackage against DuckDB on a small table set; test_digests.py holds those that SQL cannot express."""

import os

import pytest

from tablesmith.llm import queries

SF = "/root/testdata/sf0.001"
pytest.importorskip("public_tokenizers")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    text = lambda v: "" if v is None or v != v else str(int(v) if isinstance(v, float) and v == int(v) else v)  # noqa: E731  a nullable number comes as a float
    return sorted(tuple(map(text, row)) for row in frame.where(frame.notna(), None).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_duckdb(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    mine, theirs = queries.queries()[name](spark, SF).toPandas(), con.execute(queries.oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert plain(mine) == plain(theirs)
