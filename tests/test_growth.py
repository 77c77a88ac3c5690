"""Steps whose cost decides how queries grow: what they skip must not change what they give."""

import itertools

import pytest
from pyspark.sql import functions as F

from tablesmith.config import Config
from tablesmith.functions import text
from tablesmith.operators import grid, headers


def plain_normalize(x, flatten):
    import re

    lines = [re.sub("[ \t]{2,}", " ", line).strip() for line in (x or "").replace("\r\n", "\n").replace("\r", "\n").split("\n")]
    return (" ".join(line for line in lines if line) if flatten else "\n".join(lines)).strip()


@pytest.mark.parametrize("flatten", [False, True])
def test_cells_that_pass_at_once_need_nothing(spark, flatten):
    cells = ["".join(p) for k in range(4) for p in itertools.product(" \na|\ré", repeat=k)] + [None]
    rows = spark.createDataFrame([(c,) for c in cells], "c string")
    got = rows.select("c", text.normalize_cell("c", flatten).alias("n"), text.even_cells(F.array(F.lit("x"), "c", F.lit("x")), flatten).alias("even")).collect()
    for r in got:
        assert r.n == plain_normalize(r.c, flatten)
        assert not r.even or r.n == r.c
    assert any(r.even for r in got)


def test_tables_meet_by_their_document_once(spark):
    tables = spark.createDataFrame([("d", "e", 1, 1, 1, [["a", "b"], ["c", "d"]])], "doc_id string, engine string, page int, table_index int, arrival_seq long, grid array<array<string>>")
    plan = grid.select(tables, Config(min_score=-100.0))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_templates_alone_search_no_headers(spark):
    tables = spark.createDataFrame([([["ＣＩ證書 號碼", "mm²"], ["x", None]],)], "grid array<array<string>>")
    found = headers.describe(tables, searched=False)
    assert found.columns == ["grid", "compacts"]
    assert found.collect()[0].compacts == [["ci證書號碼", "mm2"], ["x", ""]]


def test_models_beyond_a_sheet_are_counted_on(spark, tmp_path, monkeypatch):
    from tablesmith.plans import book_queries
    from tablesmith.sinks import sheets

    monkeypatch.setattr(sheets, "SHEET_LIMIT", 8)
    spark.range(20).selectExpr("id as p_partkey", "concat('n', id) as p_name", "'b' as p_brand", "1 as p_size").write.parquet(f"{tmp_path}/part.parquet")
    got = book_queries.model_book(spark, str(tmp_path)).collect()
    assert sorted((r.row_index, r.path) for r in got) == [(k + 2, str(k)) for k in range(20)]


def test_each_large_workbook_is_read_by_its_own_task(tmp_path):
    from tablesmith.sources.books import LineReader

    for k in range(3):
        (tmp_path / f"{k}.xlsx").write_bytes(b"x" * (1 << 20))
    assert [len(p.files) for p in LineReader({"path": str(tmp_path)}).partitions()] == [1, 1, 1]


def test_a_sheet_in_memory_is_a_block(tmp_path):
    import io

    from tablesmith.sinks.books import packed
    from tablesmith.sources import books

    lines = [{"sheet_index": 1, "sheet": "s", "row_index": k, "values": ["a"], "kinds": ["s"], "styles": [0]} for k in range(20_001)]
    content, seen = packed(lines), []
    real = books.ElementTree.iterparse

    def watched(*args):
        for event, node in real(*args):
            if node.tag == books.SHEET_DATA:
                seen.append(node)
            yield event, node

    books.ElementTree.iterparse, restore = watched, real
    try:
        most = [len(seen[0]) for line in books.lines_of(io.BytesIO(content)) if line.row_index]
    finally:
        books.ElementTree.iterparse = restore
    assert len(most) == 20_000 and max(most) < 5000  # the parser reads blocks of 64 KB


def _shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_tables_of_a_document_are_shuffled_by_it_once_at_most(spark):
    from tablesmith import scratch
    from tablesmith.operators import templates

    schema = "doc_id string, engine string, page int, table_index int, arrival_seq long, grid array<array<string>>"
    tables = spark.createDataFrame([(f"d{k % 7}", "e", k, 1, k, [["a", "b"], ["c", f"{k}"]]) for k in range(40)], schema)
    together = tables.groupBy("doc_id").agg(F.collect_list("grid").alias("g")).select("doc_id", F.lit("e").alias("engine"), F.lit(1).alias("page"), F.lit(1).alias("table_index"), F.lit(1).alias("arrival_seq"), F.explode("g").alias("grid"))
    assert _shuffles(grid.select(together, Config(min_score=-100.0))) == 1
    found = scratch.written(grid.select(tables, Config(min_score=-100.0)), "candidates").withColumn("compacts", F.col("grid")).withColumn("header", F.lit("productinformationformodel"))
    assert _shuffles(templates.product_family(found)) == 0
    assert spark.catalog.listTables() == []


def test_written_tables_join_as_they_lie(spark):
    from tablesmith import scratch

    before = {k: spark.conf.get(k) for k in scratch.WRITING}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(500).select(F.concat(F.lit("d"), F.col("id") % 9).alias("doc_id"), (F.col("id") % 20).alias("seq"), "id")
        one, two = scratch.written(rows, "one"), scratch.written(rows.where("id < 100"), "two")
        both = one.join(two.withColumnRenamed("id", "other"), ["doc_id", "seq"])
        spark.conf.set(scratch.ALL_KEYS, "false")
        assert _shuffles(both) == 0 and both.count() == rows.join(rows.where("id < 100").withColumnRenamed("id", "other"), ["doc_id", "seq"]).count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set(scratch.ALL_KEYS, before[scratch.ALL_KEYS])
    assert {k: spark.conf.get(k) for k in scratch.WRITING} == before
    assert scratch.written(rows.drop("doc_id"), "plain").count() == 500


def test_the_first_of_equal_shapes_stays_whatever_is_missing(spark):
    rows = [("d", p, n, 2, s, k) for k, (p, n, s) in enumerate([(1, 2, 5.0), (1, 2, 7.0), (1, 2, 7.0), (None, 2, 1.0), (None, 2, 2.0), (1, 3, 0.0), (2, 2, 9.0)])] + [("e", 1, 2, 2, 1.0, 9)]
    found = spark.createDataFrame(rows, "doc_id string, page int, n_rows int, n_cols int, score double, arrival_seq int")
    assert sorted(r.arrival_seq for r in grid.deduplicate(found).collect()) == [1, 4, 5, 6, 9]


def test_documents_that_the_first_engine_reads_are_not_tried_again(spark, monkeypatch):
    from tablesmith.operators import phases

    head = ["Object / part No.", "Manufacturer / trademark", "Type / model", "Technical data", "Standard", "Mark(s) of conformity"]
    table = lambda name: [head, [name, "S", "A-1", "5 mm2", "EN 60335-1", "CE"]]
    schema = "doc_id string, engine string, page int, table_index int, arrival_seq long, grid array<array<string>>"
    tables = spark.createDataFrame([("a", "pdfplumber_x", 1, 1, 1, table("one")), ("a", "other", 1, 2, 2, table("two")), ("b", "other", 1, 1, 1, table("three")), ("c", "pdfplumber_x", 1, 1, 1, [["x"]])], schema)
    seen, real = [], phases.extract
    monkeypatch.setattr(phases, "extract", lambda t, c: seen.append(sorted({r.doc_id for r in t.select("doc_id").collect()})) or real(t, c))
    got = sorted((r.doc_id, r.object_part_no, r.attempt) for r in phases.extract_with_retry(tables).collect())
    assert got == [("a", "one", 0), ("b", "three", 1)] and seen == [["a", "c"], ["b", "c"]]
