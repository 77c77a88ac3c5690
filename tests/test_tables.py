"""Hand-worked tables: cleaning, scores, headers, phases, page following, layouts."""

import random

import pytest
from pyspark.sql import functions as F

from tablesmith.config import Config
from tablesmith.operators import grid, headers, phases, records

HEADER = ["Object / part No.", "Manufacturer / trademark", "Type / model", "Technical data", "Standard", "Mark(s) of conformity"]
FIVE = ["Component / part No.", "Manufacturer / brand", "Model / type", "Rating or characteristics", "Tested by"]
SCHEMA = "doc_id string, engine string, page int, table_index int, arrival_seq long, grid array<array<string>>"
CORE = [HEADER, ["Compressor", "ACME Co.", "QX-12A", "220 V, 50 Hz", "IEC 60335-2-34", "VDE"], ["", "", "", "R32,  2.5mm2", None, ""], ["Fan motor", "Bolt Ltd", "FM-7", "20 W", "EN 60335-1", "E12345"], ["(Alternative)", "Crest", "FM-8", "22 W", "EN 60335-1", "UL"], [""] * 6]


def part(name, kind="IEC 61810"):
    return [[name, "ACME", "R-1", "5 A", kind, "TUV"], [name + "2", "ACME", "R-2", "5 A", kind, "TUV"]]


def frame(spark, *tables):
    return spark.createDataFrame([(doc, "pdfplumber_lines", page, index, page * 100 + index, rows) for doc, page, index, rows in tables], SCHEMA)


MARKED = [["TABLE: Components information", *[""] * 5], HEADER, ["Compressor", "ACME", "C-1", "1 A", "IEC 1", "VDE"]]
TABLES = [
    ("core", 3, 1, CORE),
    ("marked", 1, 1, MARKED), ("marked", 2, 1, part("Relay")), ("marked", 3, 1, part("Fuse")), ("marked", 3, 2, [["TABLE: Heating test", "x", "y"], ["a", "b", "c"]]), ("marked", 4, 1, part("Lamp")),
    ("gap1", 1, 1, MARKED), ("gap1", 2, 1, [["x", "", "y", "", "", ""], ["", "z", "", "", "", "u"]]), ("gap1", 3, 1, part("Relay")),
    ("hole", 1, 1, MARKED), ("hole", 3, 1, part("Relay")),
    ("block", 1, 1, [["Alternative 1:", ""], ["Manufacturer:", "ACME"], ["Designation:", "QX-9"], ["Rating:", "220 V"], ["", "50 Hz"], ["Standard:", "IEC 60335, VDE"]]),
    ("window", 1, 1, [["1", "Relay part", "ACME", "R-1", "5 A: 250 V", "IEC 61810", "TUV"], ["2", "Relay part", "ACME", "R-2", "5 A: 250 V", "IEC 61810", "TUV"]]),
    ("five", 1, 1, [FIVE, ["Relay", "ACME", "R-1", "5 A", "KC"], ["", "", "", "250 V", ""]]), ("five", 2, 1, [["", "", "", "", "KC-2"], ["Fuse", "Bolt", "F-2", "3 A", "KC"]]),
    ("product", 1, 1, [["Product information for model", "x", "", "", "", ""], ["Model", "Name", "", "", "", ""], ["PM-1", "n", "", "", "", ""], HEADER, ["Fan", "B", "F-1", "1 W", "EN 1", "CE"]]), ("product", 2, 1, [["Coil", "C", "C-1", "2mm2", "EN 2", "CE"], ["remark x", "", "", "", "", ""]]), ("product", 4, 1, part("Skip")),
]


@pytest.fixture(scope="module")
def found(spark):
    described = headers.describe(grid.select(frame(spark, *TABLES), Config(min_score=-100.0))).persist()
    rows = phases.ordered(phases.candidate_records(described, Config(min_score=-100.0))).collect()
    return {doc: [r for r in rows if r["doc_id"] == doc] for doc in {t[0] for t in TABLES}}


def names(rows):
    return [r["object_part_no"] for r in rows]


def test_score_of_the_core_table(spark):
    row = grid.score(grid.clean(frame(spark, ("core", 3, 1, CORE)))).first()
    assert (row["n_rows"], row["n_cols"]) == (5, 6)
    assert row["score"] == pytest.approx(61.13529, abs=1e-5)


def test_empty_and_ragged_tables(spark):
    rows = {r["doc_id"]: r for r in grid.score(grid.clean(frame(spark, ("none", 1, 1, []), ("blank", 1, 1, [["", None]]), ("ragged", 1, 1, [["a"], ["b", "c"]])))).collect()}
    assert rows["none"]["score"] == rows["blank"]["score"] == -1e9
    assert rows["ragged"]["grid"] == [["a", ""], ["b", "c"]]


def test_wrapped_rows_join_and_full_alternatives_stay(found):
    rows = found["core"]
    assert [r["row_index_on_table"] for r in rows] == [1, 3, 4]
    assert rows[0]["technical_data"] == "220 V, 50 Hz\nR32, 2.5mm²"


def test_broad_policy_drops_the_wrapped_row(spark):
    rows = phases.ordered(phases.extract(frame(spark, ("core", 3, 1, CORE)), Config(policy="broad"))).collect()
    assert [r["technical_data"] for r in rows] == ["220 V, 50 Hz", "20 W", "22 W"]


def test_a_marked_table_ends_on_the_page_where_another_begins(found):
    assert names(found["marked"]) == ["Compressor", "Relay", "Relay2", "Fuse", "Fuse2"]


def test_one_page_without_rows_is_passed_over_but_not_one_without_tables(found):
    assert names(found["gap1"]) == ["Compressor", "Relay", "Relay2"]
    assert names(found["hole"]) == ["Compressor"]


def test_alternative_block(found):
    (row,) = found["block"]
    assert (row["object_part_no"], row["manufacturer_trademark"], row["type_model"], row["technical_data"], row["standard"], row["marks_of_conformity"]) == ("Alternative 1:", "ACME", "QX-9", "rating: 220 V\n50 Hz", "IEC", "VDE")


def test_six_window(found):
    assert names(found["window"]) == ["Relay part", "Relay part"]


def test_five_column_layout_continues_over_pages(found):
    assert [(r["object_part_no"], r["technical_data"], r["marks_of_conformity"]) for r in found["five"]] == [("Relay", "5 A 250 V", "KC；KC-2"), ("Fuse", "3 A", "KC")]


def test_product_layout_carries_model_and_columns_to_the_next_page(found):
    assert [(r["object_part_no"], r["product_model"], r["technical_data"]) for r in found["product"]] == [("Fan", "PM-1", "1 W"), ("Coil", "PM-1", "2mm²")]


def test_greedy_header_takes_trademark_for_marks(spark):
    norms = F.transform(F.lit(None).cast("array<array<string>>"), lambda r: r)
    row = spark.createDataFrame([([["object", "manufacturer", "trademark", "standard"]],)], "n array<array<string>>").select(headers.loose_header(F.col("n")).alias("h")).first()["h"]
    assert list(row["mapping"]) == [0, 1, -1, -1, 3, 2] and norms is not None


def test_first_of_equal_candidates_stays(spark):
    rows = [("d", 1, 2, 6, s, q) for s, q in ((10.0, 0), (12.0, 1), (12.0, 2))]
    assert grid.deduplicate(spark.createDataFrame(rows, "doc_id string, page int, n_rows int, n_cols int, score double, arrival_seq int")).first()["arrival_seq"] == 1


def test_results_do_not_depend_on_partitions(spark):
    tables = frame(spark, *TABLES[:6])
    seen = []
    for n in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append([tuple(r) for r in phases.ordered(phases.extract(tables.repartition(n), Config(min_score=-100.0))).collect()])
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert seen[0] == seen[1]


def test_chains_merge_like_whole_groups(spark):
    """Rests at the beginning, marked rests, repeated rows, a null key, one key with a third of the rows."""
    rnd = random.Random(0)
    rows = [("hot" if i % 3 == 0 else rnd.choice(["a", "b", None]), rnd.randint(0, 90), rnd.choice(["x", "", " ", "Alternative", "y"]), rnd.choice(["", "", "v"]), rnd.choice(["", "IEC 1"])) for i in range(300)]
    df = spark.createDataFrame([*rows, rows[0]], "k string, at int, name string, maker string, standard string")
    record = records.as_record(F.col("at"), F.lit("detail"), F.lit(""), F.array("name", "maker", F.lit(""), F.lit(""), "standard", F.lit("CE")))
    df = df.select("k", record.alias("r"))
    whole = df.groupBy("k").agg(F.array_sort(F.collect_list("r")).alias("rows"))
    merge = lambda x: sorted(map(str, x.select("k", F.explode(records.merged(F.col("rows"), F.lit(records.COMPONENTS))).alias("r")).collect()))
    assert merge(records.chained(df, "k")) == merge(whole)
    assert records.chained(df.limit(0), "k").count() == 0


def test_scratch_tables_go_with_their_owner(spark, tmp_path):
    import os

    from tablesmith import scratch
    from tablesmith.operators import phases

    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    before = set(os.listdir(folder))
    rows = [["Object / part No.", "Manufacturer / trademark", "Type / model", "Technical data", "Standard", "Mark(s) of conformity"], ["Fuse", "Maker", "F1", "5 A", "EN 1", "CE"]]
    tables = spark.createDataFrame([("d", "pdfplumber_lines", 1, 1, 1, rows)], "doc_id string, engine string, page int, table_index int, arrival_seq bigint, grid array<array<string>>")
    with scratch.owned(spark):
        phases.extract(tables).write.parquet(str(tmp_path / "out"))
        assert set(os.listdir(folder)) > before
    assert set(os.listdir(folder)) == before and spark.read.parquet(str(tmp_path / "out")).count() == 1
    with pytest.raises(ZeroDivisionError), scratch.owned(spark):
        scratch.written(tables, "lost")
        raise ZeroDivisionError
    assert set(os.listdir(folder)) == before
