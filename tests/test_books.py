"""Workbooks: written whole or not at all, copied with one sheet anew, read in parts, split each by its own header."""

import io
import json
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from tablesmith.operators import split
from tablesmith.sinks import books, sheets
from tablesmith.sources.books import LineReader, lines_of, read_lines


def line(index, sheet, row, values=(), kinds=None, styles=None, **more):
    values = list(values)
    return {"sheet_index": index, "sheet": sheet, "row_index": row, "values": values, "kinds": kinds or ["s" if v else "-" for v in values], "styles": styles or [0] * len(values), **more}


def book(*lines):
    return books.packed(list(lines))


def content_of(data):
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return {n: z.read(n) for n in z.namelist()}


LOOKS = [sheets.LOOKS[0], ("0.00", '<font><b/></font>', "", "", "", ""), ("yyyy", "", "", "", '<alignment wrapText="1"/>', '<protection locked="0"/>')]


def test_lines_come_back_as_written():
    rows = [line(1, "a<&\"'>", 0, formats=LOOKS, widths=[3.5, None, 7.0]), line(1, "a<&\"'>", 2, ["x ", None, "7", "1", "#N/A", "=A1+1", "\x01ü\n"], ["s", "-", "n", "b", "e", "f", "s"], [1, 2, 0, 0, 0, 0, 0], height=20.5), line(2, "empty", 0)]
    found = list(lines_of(io.BytesIO(book(*rows))))
    assert [(f.sheet_index, f.sheet, f.row_index) for f in found] == [(1, "a<&\"'>", 0), (1, "a<&\"'>", 2), (2, "empty", 0)]
    assert found[1].values == ["x ", None, "7", "1", "#N/A", "=A1+1", "ü\n"] and found[1].kinds == ["s", "-", "n", "b", "e", "f", "s"]
    assert found[1].styles == [1, 2, 0, 0, 0, 0, 0] and found[1].height == 20.5 and found[0].widths == [3.5, None, 7.0]
    assert [f[0] for f in found[0].formats] == ["General", "0.00", "yyyy"] and found[0].formats[2][4:] == ('<alignment wrapText="1"/>', '<protection locked="0"/>')


def test_a_copy_keeps_every_other_part(tmp_path):
    parts = content_of(book(line(1, "first", 1, ["a"]), line(2, split.RESULT_SHEET, 1, ["old"]), line(3, "third", 1, ["c"])))
    names = '<definedNames><definedName name="p" localSheetId="0">first!A1</definedName><definedName name="q" localSheetId="1">x</definedName><definedName name="r" localSheetId="2">third!A1</definedName><definedName name="s">1</definedName></definedNames>'
    parts["xl/workbook.xml"] = parts["xl/workbook.xml"].decode().replace("<sheets>", '<bookViews><workbookView activeTab="2"/></bookViews><sheets>').replace("</workbook>", f"{names}</workbook>").encode()
    parts["xl/_rels/workbook.xml.rels"] = parts["xl/_rels/workbook.xml.rels"].replace(b"</Relationships>", b'<Relationship Id="c" Type="http://x/calcChain" Target="calcChain.xml"/></Relationships>')
    parts["[Content_Types].xml"] = parts["[Content_Types].xml"].replace(b"</Types>", b'<Override PartName="/xl/calcChain.xml" ContentType="c"/></Types>')
    parts |= {"xl/calcChain.xml": b"<c/>", "xl/vbaProject.bin": bytes(range(256)), "xl/worksheets/_rels/sheet2.xml.rels": b"<Relationships/>", "docProps/app.xml": b"<p/>"}
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for n, c in parts.items():
            z.writestr(n, c)
    done = content_of(books.packed([line(1, split.RESULT_SHEET, 0, widths=[9.0], frozen=True, filtered=True), line(1, split.RESULT_SHEET, 1, ["new"])], raw.getvalue()))
    edited = {"xl/workbook.xml", "xl/_rels/workbook.xml.rels", "[Content_Types].xml"}
    gone = {"xl/worksheets/sheet2.xml", "xl/worksheets/_rels/sheet2.xml.rels", "xl/calcChain.xml"}
    assert {n: c for n, c in done.items() if n not in edited | {"xl/worksheets/sheet4.xml"}} == {n: c for n, c in parts.items() if n not in edited | gone}
    whole = done["xl/workbook.xml"].decode()
    assert re.findall(r'<sheet [^>]*?name="([^"]*)"', whole) == [split.RESULT_SHEET, "first", "third"] and "activeTab" not in whole
    assert re.findall(r'name="(\w)"(?: localSheetId="(\d)")?', whole.partition("definedNames")[2]) == [("p", "1"), ("r", "2"), ("s", "")]
    assert b"calcChain" not in done["[Content_Types].xml"] + done["xl/_rels/workbook.xml.rels"]
    assert b'autoFilter ref="A1:A1"' in done["xl/worksheets/sheet4.xml"] and b'state="frozen"' in done["xl/worksheets/sheet4.xml"]
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for n, c in done.items():
            z.writestr(n, c)
    assert [(f.sheet, f.values) for f in lines_of(buffer) if f.row_index] == [(split.RESULT_SHEET, ["new"]), ("first", ["a"]), ("third", ["c"])]


def lines_frame(spark, rows):
    schema = f"output string, {books_schema()}"
    return spark.createDataFrame([(o, r["sheet_index"], r["sheet"], r["row_index"], r.get("height"), r["values"], r["kinds"], r["styles"], r.get("widths"), r.get("formats")) for o, r in rows], schema)


def books_schema():
    from tablesmith.sources.books import LINES

    return LINES


def test_a_write_that_fails_leaves_no_file(spark, tmp_path):
    good = [(f"d{k}.xlsx", r) for k in range(6) for r in (line(1, "s", 0), line(1, "s", 1, ["x"]))]
    bad = ("d9.xlsx", line(1, "s", 1, ["x", "y"], ["s"], [0]))  # cells and kinds do not match
    with pytest.raises(Exception, match="zip"):
        books.save_books(lines_frame(spark, [*good, ("d9.xlsx", line(1, "s", 0)), bad]), str(tmp_path), partitions=4)
    assert [p for p in tmp_path.rglob("*") if p.is_file()] == [] and not list(tmp_path.glob("_staging*"))
    books.save_books(lines_frame(spark, good), str(tmp_path), partitions=4)
    assert sorted(p.name for p in tmp_path.iterdir()) == [f"d{k}.xlsx" for k in range(6)]


def test_existing_files_dry_runs_and_reports(spark, tmp_path):
    one = lambda text: lines_frame(spark, [("sub/a.xlsx", line(1, "s", 0)), ("sub/a.xlsx", line(1, "s", 1, [text]))])
    read = lambda: [r["values"] for r in read_lines(spark, str(tmp_path / "o")).where("row_index > 0").collect()]
    books.save_books(one("first"), str(tmp_path / "o"), dry_run=True, report=str(tmp_path / "r"))
    assert not (tmp_path / "o" / "sub").exists()
    books.save_books(one("first"), str(tmp_path / "o"), report=str(tmp_path / "r"))
    books.save_books(one("second"), str(tmp_path / "o"), existing="skip", report=str(tmp_path / "r"))
    assert read() == [["first"]]
    with pytest.raises(Exception, match="FileExistsError"):
        books.save_books(one("third"), str(tmp_path / "o"), existing="error")
    books.save_books(one("fourth"), str(tmp_path / "o"))
    assert read() == [["fourth"]]
    said = [json.loads(x) for p in (tmp_path / "r").iterdir() for x in p.read_text().splitlines()]
    assert sorted((s["action"], s["sheets"], s["rows"]) for s in said) == [("planned", 1, 1), ("skipped", 0, 0), ("written", 1, 1)]
    with pytest.raises(Exception, match="does not lie below"):
        books.save_books(one("x").withColumn("output", F.lit("../x.xlsx")), str(tmp_path / "o"))


def test_bytes_are_published_together(spark, tmp_path):
    rows = [("a/one.png", b"one"), ("two.png", b"")]
    df = spark.createDataFrame(rows, "output string, content binary")
    books.save_bytes(df, f"file:{tmp_path}")
    assert (tmp_path / "a/one.png").read_bytes() == b"one" and (tmp_path / "two.png").read_bytes() == b""
    with pytest.raises(Exception, match="no content"):
        books.save_bytes(spark.createDataFrame([("three", b"x"), ("four", None)], df.schema), str(tmp_path))
    with pytest.raises(Exception, match="several tasks"):
        books.save_bytes(spark.createDataFrame([("five", b"x"), ("five", b"y")], df.schema).repartition(2), str(tmp_path))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a", "two.png"]
    books.save_bytes(df.limit(0), str(tmp_path))


def test_only_what_is_asked_for_is_read(spark, tmp_path):
    rng = __import__("random").Random(1)
    noise = lambda n: ["".join(chr(rng.randint(33, 90)) for _ in range(200)) for _ in range(n)]
    data = book(line(1, "small", 1, ["x"]), *(line(2, "large", k + 1, noise(5)) for k in range(3000)))
    (tmp_path / "a.xlsx").write_bytes(data)
    (tmp_path / "broken.xlsx").write_bytes(b"no archive")

    def run(**options):
        reader, taken = LineReader({"path": str(tmp_path), **options}), [0]

        class Counting(io.BytesIO):
            def read(self, *a):
                out = super().read(*a)
                taken[0] += len(out)
                return out

        reader.open = lambda path: Counting(open(path, "rb").read())
        rows = [r for p in reader.partitions() for r in reader.read(p)]
        return rows, taken[0]

    every, all_bytes = run()
    few, few_bytes = run(sheets='["small"]')
    top, top_bytes = run(lastRow="30")
    assert len([r for r in every if r[1] == 2]) == 3001 and [r[2] for r in every if r[1] == 0] == ["error"]
    assert [r[3] for r in few if r[1]] == [0, 1] and len([r for r in top if r[1] == 2]) == 31
    assert few_bytes < all_bytes / 20 and top_bytes < all_bytes / 5
    frame = read_lines(spark, str(tmp_path), sheets=["small"])
    assert frame.where("row_index > 0").count() == 1 and frame.count() == 3  # the second scan is not held to the first one's filter
    assert read_lines(spark, str(tmp_path), "*.none").count() == 0


def test_each_workbook_is_split_by_its_own_header(spark, tmp_path):
    one = book(line(1, "Sheet1", 0, widths=[5.0, 6.0]), line(1, "Sheet1", 1, ["no", split.DETAIL]), line(1, "Sheet1", 2, ["1", "QX1-A 二台"], ["n", "s"], height=30.0), line(1, "Sheet1", 3, [None, ""]), line(1, "Sheet1", 4, ["9", None], ["n", "-"]))
    two = book(line(1, "Sheet1", 1, ["x"]), line(1, "Sheet1", 3, [f" {split.DETAIL}", "no", "more"]), line(1, "Sheet1", 4, ["QX2-B 5台 QX2-C", "2"], ["s", "n"]), line(1, "Sheet1", 5, ["not a detail", "no", None, "far"]))
    none = book(line(1, "Sheet1", 1, ["nothing"]))
    for name, data in (("a", one), ("b", two), ("c", none)):
        (tmp_path / f"{name}.xlsx").write_bytes(data)
    lines = read_lines(spark, str(tmp_path))
    rows = split.split_sheet(lines.where("row_index > 0"), path="path").collect()
    assert sorted((r["path"][-6], r["row_index"], r["model"], r["cnt"]) for r in rows if r["model"]) == [("a", 2, "QX1-A", 2), ("b", 4, "QX2-B", 5), ("b", 5, "not a detail", None)]
    found = {}
    for width in (False, True):
        books.save_books(split.split_books(lines, header_width=width), str(tmp_path / f"out{width}"))
        done = read_lines(spark, str(tmp_path / f"out{width}"), sheets=[split.RESULT_SHEET]).orderBy("path", "row_index").collect()
        assert {r["path"].rsplit("/")[-1] for r in done} == {f"a{split.SPLIT_SUFFIX}.xlsx", f"b{split.SPLIT_SUFFIX}.xlsx"}
        found[width] = [(r["path"].rsplit("/")[-1][0], r["values"], r["height"]) for r in done if r["row_index"]]
        assert [r["widths"] for r in done if r["path"].rsplit("/")[-1][0] == "a"][0] == [5.0, 6.0, 10.0]
    assert found[False][:3] == [("a", ["no", split.DETAIL, split.COUNT], None), ("a", ["1", "QX1-A", "2"], 30.0), ("a", ["9", ""], None)]
    assert found[False][3:] == [("b", [f" {split.DETAIL}", "no", "more", None, split.COUNT], None), ("b", ["QX2-B", "2", None, None, "5"], None), ("b", ["not a detail", "no", None, "far"], None)]
    assert found[True][3:] == [("b", [f" {split.DETAIL}", "no", "more", split.COUNT], None), ("b", ["QX2-B", "2", None, "5"], None), ("b", ["not a detail", "no"], None)]


def test_records_go_on_in_further_sheets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sheets, "SHEET_LIMIT", 4)
    df = spark.createDataFrame([(k, None if k == 3 else f"v{k}\nw") for k in range(7)] + [(None, "nowhere")], "n int, v string")
    lines = sheets.record_books(df, F.when(F.col("n").isNotNull(), F.lit("r.xlsx")), [F.col("n").desc()])
    books.save_books(lines, str(tmp_path))
    rows = read_lines(spark, str(tmp_path)).orderBy("sheet_index", "row_index").collect()
    assert [(r["sheet"], r["values"]) for r in rows if r["row_index"] == 2] == [("TARGET_6_ITEMS", ["6", "v6\nw"]), ("TARGET_6_ITEMS 2", ["3", ""]), ("TARGET_6_ITEMS 3", ["0", "v0\nw"])]
    assert [r["height"] for r in rows if r["sheet_index"] == 2 and r["row_index"] > 1] == [15.0, 30.0, 30.0] and rows[0]["widths"] == [12.0, 12.0]
    books.save_books(sheets.record_books(df.limit(0), F.lit("e.xlsx"), [F.col("n")]), str(tmp_path / "none"))
    assert read_lines(spark, str(tmp_path), "e.xlsx").count() == 0


def test_elements_made_at_once_are_those_made_one_by_one():
    import pyarrow as pa

    rows = [(1, None, ["a&<b>\n\"'", None, "7", "", "1", "#N/A", "x"], ["s", "-", "n", "s", "b", "e", "-"], [0, 3, 2, 0, 0, 1, 0]), (3, 20.5, [], [], []), (12, 15.0, ["ü"] * 30, ["s"] * 30, [2] * 30), (13, 1234567.0, [None], ["s"], [0])]

    def batch(rows):
        number, height, values, kinds, styles = map(list, zip(*rows, strict=True))
        return pa.record_batch({"row_index": pa.array(number, pa.int32()), "height": pa.array(height, pa.float64()), "values": pa.array(values, pa.list_(pa.string())), "kinds": pa.array(kinds, pa.list_(pa.string())), "styles": pa.array(styles, pa.list_(pa.int32()))})

    part, held = books.SheetPart(io.BytesIO(), [], False, False), []
    part._put = held.append
    for r in rows:
        part.line(*r)
    assert books.marked_rows(batch(rows)) == (held, [len(r[2]) for r in rows])
    assert books.marked_rows(batch(rows).slice(2)) == (held[2:], [30, 1])
    for values, kinds, styles in ((["=A1"], ["f"], [0]), (["\x01"], ["s"], [0]), (["a", "b"], ["s"], [0]), (None, None, None)):
        assert books.marked_rows(batch([*rows, (14, None, values, kinds, styles)])) is None


def test_plain_sheets_are_read_as_the_parser_reads_them(monkeypatch):
    from tablesmith.sources import books as source

    texts = [["a", "", " x\n y ", "ü"], ["7"]]
    plain = [line(1, "s", 0, widths=[3.5, None, 7.0]), *(line(1, "s", k + 1, t, styles=[0, 2, 0, 1][: len(t)], kinds=["s"] * len(t), height=20.5 if k else None) for k, t in enumerate(texts))]
    odd = {"gap": ["a", None, "c"], "reference": ["a&b"], "return": ["a\rb"], "number": ["7"]}
    data = {"plain": book(*plain), **{k: book(*plain, line(1, "s", 9, v, kinds=["n"] if k == "number" else ["s" if x else "-" for x in v])) for k, v in odd.items()}}
    edits = {"spans": (b'<row r="2"', b'<row spans="1:4" r="2"'), "comment": (b"<sheetData>", b"<sheetData><!-- <row r='5'></row> -->"), "hidden": (b'<col min="1"', b'<col hidden="1" min="1"')}
    for k, (old, new) in edits.items():
        parts, out = content_of(data["plain"]), io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for n, c in parts.items():
                z.writestr(n, c.replace(old, new))
        data[k] = out.getvalue()
    real, met = source.plain_lines, []
    monkeypatch.setattr(source, "plain_lines", lambda *a: met.append(real(*a)) or met[-1])
    quick = {(k, last): [f.fields() for f in lines_of(io.BytesIO(d), last_row=last)] for k, d in data.items() for last in (None, 1, 0)}
    assert len(met[0]) == 3 and len(met[1]) == 2 and len(met[2]) == 1 and not any(met[3::3])
    monkeypatch.setattr(source, "SMALL_PART", -1)
    for (k, last), found in quick.items():
        assert found == [f.fields() for f in lines_of(io.BytesIO(data[k]), last_row=last)], k
    two = book(line(1, "s", 1, ["a"]), line(2, "t", 1, ["b"]))
    assert [f.sheet for f in lines_of(io.BytesIO(two), without=frozenset("s"))] == ["t", "t"]


def test_tables_become_lines_in_one_pass(spark):
    rows = [("d", k, "e", 1, k, g, len(g), len(g[0]) if g else 0, 1.5, "x") for k, g in ((4, [["a", "b\ncc"], ["", "d"]]), (7, []))]
    found = spark.createDataFrame(rows, "doc_id string, seq int, engine string, page int, table_index int, grid array<array<string>>, n_rows int, n_cols int, score double, details string")
    lines = sheets.table_books(found, F.concat("doc_id", F.lit(".xlsx")))
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan and plan.count("Window [") == 1
    got = [(r["sheet"], r["row_index"], r["height"], r["values"], "".join(r["kinds"]), r["styles"], r["widths"], r["formats"] is not None) for r in lines.orderBy("sheet_index", "row_index").collect()]
    first, second = "T1_e_p1", "T2_e_p1"
    head = ["sheet", "engine", "page", "table_index_on_page", "rows", "cols", "score", "details"]
    assert got == [
        (first, 0, None, [], "", [], [12.0, 12.0], True), (first, 1, None, ["col_1", "col_2"], "ss", [1, 1], None, False), (first, 2, 30.0, ["a", "b\ncc"], "ss", [2, 2], None, False), (first, 3, 15.0, ["", "d"], "ss", [2, 2], None, False),
        (second, 0, None, [], "", [], [12.0], False), (second, 1, None, ["col_1"], "s", [1], None, False),
        ("SUMMARY", 0, None, [], "", [], None, False), ("SUMMARY", 1, None, head, "s" * 8, [4] * 8, None, False),
        ("SUMMARY", 2, None, [first, "e", "1", "4", "2", "2", "1.5", "x"], "ssnnnnns", [0] * 8, None, False), ("SUMMARY", 3, None, [second, "e", "1", "7", "0", "0", "1.5", "x"], "ssnnnnns", [0] * 8, None, False),
    ]


def test_workbooks_are_written_in_small_batches(spark, tmp_path, monkeypatch):
    seen, before = [], spark.conf.get(books.BATCH_ROWS)
    monkeypatch.setattr(books.BookSink, "name", classmethod(lambda cls: seen.append(spark.conf.get(books.BATCH_ROWS)) or "books_out"))
    books.save_books(lines_frame(spark, [("a.xlsx", line(1, "s", 0)), ("a.xlsx", line(1, "s", 1, ["x"]))]), str(tmp_path))
    assert spark.conf.get(books.BATCH_ROWS) == before and int(before) > books.ROWS_AT_ONCE
    assert read_lines(spark, str(tmp_path)).count() == 2
