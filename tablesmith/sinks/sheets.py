"""Sinks: sheets of tables, display sizes, workbooks, and the choice of outputs that are still to be written."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import even_cells, normalize_cell, once
from ..sources.books import FORMAT, FORMAT_FIELDS

# Sheet names and limits.
TARGET_SHEET, SUMMARY_SHEET, MODELS_SHEET, NAME_LENGTH = "TARGET_6_ITEMS", "SUMMARY", "型号提取结果", 31
LEAST_WIDTH, MOST_WIDTH, LINE_HEIGHT, MOST_HEIGHT = 12, 60, 15, 180
NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def with_sheet_names(candidates: DataFrame) -> DataFrame:
    """Adds sheet_index and sheet: a number and a name, at most 31 characters, for each table of a document in its order."""
    numbered = candidates.withColumn("sheet_index", F.row_number().over(W.partitionBy("doc_id").orderBy("seq")).cast("int"))
    name = F.concat(F.lit("T"), F.col("sheet_index").cast("string"), F.lit("_"), F.col("engine"), F.lit("_p"), F.col("page").cast("string"))
    return numbered.withColumn("sheet", F.substring(name, 1, NAME_LENGTH))


def summary(named: DataFrame) -> DataFrame:
    """One row a sheet."""
    return named.select("doc_id", "sheet", "engine", "page", F.col("table_index").alias("table_index_on_page"), F.col("n_rows").alias("rows"), F.col("n_cols").alias("cols"), F.round("score", 2).alias("score"), "details")


def as_text(df: DataFrame) -> DataFrame:
    """Every column as normalized text, null as empty, which is how sheets show it."""
    return df.select(*(normalize_cell(F.col(f"`{c}`").cast("string")).alias(c) for c in df.columns))


def lines_of(value: Column) -> Column:
    return F.split(F.coalesce(value, F.lit("")), "\n", -1)


def line_count(value: Column) -> Column:
    """How many lines a text has; most have one, and are not split."""
    return F.when(value.contains("\n"), F.size(lines_of(value))).otherwise(1)


def longest_line(value: Column) -> Column:
    """The length of a text's longest line."""
    return F.when(value.contains("\n"), F.array_max(F.transform(lines_of(value), F.length))).otherwise(F.length(F.coalesce(value, F.lit(""))))


def column_widths(df: DataFrame) -> DataFrame:
    """One row with each column's width: its longest line, header included, plus 2, from 12 to 60."""
    longest = lambda c: F.array_max(F.transform(lines_of(F.col(f"`{c}`")), F.length))
    return as_text(df).agg(*(F.least(F.greatest(F.coalesce(F.max(longest(c)), F.lit(0)) + 2, F.lit(max(len(c) + 2, LEAST_WIDTH))), F.lit(MOST_WIDTH)).alias(c) for c in df.columns))


def row_height(columns: list[Column]) -> Column:
    """15 for each line of the row's longest cell, 180 at most."""
    return F.least(F.greatest(*(F.size(lines_of(c)) for c in columns), F.lit(1)) * LINE_HEIGHT, F.lit(MOST_HEIGHT))


# Looks of header and body cells of a table, of a model list, and of a plain header; widths of the model list's columns.
_FONT, _BOLD = '<font><sz val="11"/><name val="Calibri"/></font>', '<font><b/><sz val="11"/><name val="Calibri"/></font>'
_LINES = "<border>" + "".join(f'<{side} style="thin"/>' for side in ("left", "right", "top", "bottom")) + "</border>"
_NO_FILL = '<fill><patternFill patternType="none"/></fill>'
_WRAP = '<alignment vertical="top" wrapText="1"/>'
LOOKS = (
    ("General", _FONT, _NO_FILL, "<border/>", "", ""),
    ("General", _BOLD, '<fill><patternFill patternType="solid"><fgColor rgb="FFEDEDED"/></patternFill></fill>', _LINES, "", ""),
    ("General", _FONT, _NO_FILL, _LINES, _WRAP, ""),
    ("General", '<font><b/><sz val="11"/><color rgb="FFFFFFFF"/><name val="Calibri"/></font>', '<fill><patternFill patternType="solid"><fgColor rgb="FF1F4E78"/></patternFill></fill>', _LINES, "", ""),
    ("General", _BOLD, _NO_FILL, _LINES, '<alignment horizontal="center" vertical="top"/>', ""),
)
PLAIN_LOOK, HEAD_LOOK, BODY_LOOK, LIST_LOOK, SUMMARY_LOOK = range(5)
MODEL_WIDTHS = (38, 72, 8, 28, 28, 72, 14, 14)
#: Rows that a sheet of the format can hold, header included.
SHEET_LIMIT = 1_048_576


def formats() -> Column:
    """LOOKS as line 0 of a file's first sheet holds them."""
    return F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(FORMAT_FIELDS, look, strict=True))) for look in LOOKS))


def _lines(df: DataFrame, **columns: Column) -> DataFrame:
    """Lines of sinks.books.save_books; what is not given is empty."""
    empty = {"height": F.lit(None).cast("double"), "values": F.array().cast("array<string>"), "kinds": F.array().cast("array<string>"), "styles": F.array().cast("array<int>"), "widths": F.lit(None).cast("array<double>"), "formats": F.lit(None).cast(f"array<{FORMAT}>"), "frozen": F.lit(False), "filtered": F.lit(False)}
    every = {"output": F.col("output"), "sheet_index": F.col("sheet_index"), "sheet": F.col("sheet"), "row_index": F.lit(0)} | empty | columns
    return df.select(*(c.alias(n) for n, c in every.items()))


def _alike(values: Column, what: object) -> Column:
    return F.transform(values, lambda _: F.lit(what))


def height_of(values: Column) -> Column:
    """:func:`row_height` of an array of cells."""
    most = F.array_max(F.transform(values, line_count))
    return F.least(F.greatest(F.coalesce(most, F.lit(1)), F.lit(1)) * LINE_HEIGHT, F.lit(MOST_HEIGHT)).cast("double")


def table_books(candidates: DataFrame, output: Column) -> DataFrame:
    """A workbook for each document: a sheet for each of its tables in order, and a summary at the end, as lines for sinks.books.save_books.

    candidates: doc_id, seq, engine, page, table_index, grid, n_rows, n_cols, score, details; ``output`` depends on
    doc_id alone. Body cells are normalized text, bordered and wrapped; columns are as wide as their longest line, rows
    as high as their lines. A table is one row until its lines are laid out; no document is held. A table without a row has its header alone. A
    document without a table has no workbook.
    """
    named = with_sheet_names(candidates).withColumn("output", output)
    body = F.transform("grid", lambda r: F.transform(r, lambda v: normalize_cell(v)))
    named = named.withColumn("grid", once(F.when(even_cells(F.flatten("grid")), F.col("grid")).otherwise(body)))
    named = named.withColumn("head", once(F.transform(F.sequence(F.lit(1), F.greatest("n_cols", F.lit(1))), lambda k: F.concat(F.lit("col_"), k.cast("string")))))
    longest = lambda k: F.array_max(F.transform("grid", lambda r: longest_line(F.get(r, k))))
    widths = F.transform("head", lambda h, k: F.least(F.lit(MOST_WIDTH), F.greatest(F.lit(LEAST_WIDTH), F.greatest(F.length(h), F.coalesce(longest(k), F.lit(0))) + 2)).cast("double"))
    cells = {"sheet": F.col("sheet"), "engine": F.col("engine"), "page": F.col("page"), "table_index_on_page": F.col("table_index"), "rows": F.col("n_rows"), "cols": F.col("n_cols"), "score": F.round("score", 2), "details": F.col("details")}
    names = list(cells)
    # all lines of a table are made from it at once: of the sheet itself, its header and its rows, then its line of the summary;
    # a document's first table adds the summary sheet and its header
    none = F.array().cast("array<string>")
    said = F.array(*(c.cast("string") for c in cells.values()))
    lines = F.concat(F.array(none), F.array("head"), F.coalesce("grid", F.array().cast("array<array<string>>")), F.array(said), F.when(F.col("sheet_index") == 1, F.array(none, F.array(*map(F.lit, names)))).otherwise(F.array().cast("array<array<string>>")))
    every = named.select("output", "sheet_index", "sheet", once(widths).alias("widths"), F.coalesce(F.size("grid"), F.lit(0)).alias("n"), F.posexplode(lines).alias("at", "values"))
    body, listed = (F.col("at") > 1) & (F.col("at") < F.col("n") + 2), F.col("at") - F.col("n") - 2  # listed: 0 is the line of the summary, 1 its sheet, 2 its header
    of_sheet = listed < 0
    alike = lambda what: F.array_repeat(F.lit(what), F.size("values"))
    kinds = F.array(*(F.when(F.get("values", F.lit(k)).isNull(), "-").otherwise("s" if n in ("sheet", "engine", "details") else "n") for k, n in enumerate(names)))
    look = F.when(body, BODY_LOOK).when(F.col("at") == 1, HEAD_LOOK).when(listed == 2, SUMMARY_LOOK).otherwise(PLAIN_LOOK)
    # the summary's lines come after all sheets
    return _lines(
        every, sheet_index=F.when(of_sheet, F.col("sheet_index")).otherwise(2**31 - 1), sheet=F.when(of_sheet, F.col("sheet")).otherwise(SUMMARY_SHEET),
        row_index=F.when(of_sheet, F.col("at")).when(listed == 0, F.col("sheet_index") + 1).otherwise((listed == 2).cast("int")), height=F.when(body, height_of(F.col("values"))),
        values=F.col("values"), kinds=F.when(listed == 0, kinds).otherwise(alike("s")), styles=F.array_repeat(look, F.size("values")),
        widths=F.when(F.col("at") == 0, F.col("widths")), formats=F.when((F.col("at") == 0) & (F.col("sheet_index") == 1), formats()),
    )


def record_books(df: DataFrame, output: Column, order: list[Column], sheet: str = TARGET_SHEET, widths: tuple[int, ...] | None = None, listing: bool = False) -> DataFrame:
    """A workbook for each ``output``, its rows in ``order`` under a header of the column names, as lines for sinks.books.save_books.

    Cells are normalized text. Widths are those of the longest lines over all of the output's rows, counted by an
    aggregate before anything is written, or as given. ``listing``: the look of the model list, header frozen and
    filtered, heights left to the reader. Rows beyond what a sheet can hold go on in further sheets. A row whose output is
    null is in no workbook.
    """
    names = df.columns
    text = [normalize_cell(F.col(f"`{c}`").cast("string")) for c in names]
    rows = df.withColumns({"__output": output, "__values": F.array(*text)}).where("__output is not null")
    number = F.row_number().over(W.partitionBy("__output").orderBy(*order, "__values")) - 1
    per = SHEET_LIMIT - 1
    rows = rows.select(F.col("__output").alias("output"), F.col("__values").alias("values"), number.alias("n"))
    rows = rows.withColumn("sheet_index", (F.floor(F.col("n") / per) + 1).cast("int"))
    rows = rows.withColumn("sheet", F.when(F.col("sheet_index") == 1, sheet).otherwise(F.concat(F.lit(sheet), F.lit(" "), F.col("sheet_index").cast("string"))))
    longest = [F.max(longest_line(F.get("values", F.lit(k)))) for k in range(len(names))]
    wide = F.array(*(F.least(F.greatest(w + 2, F.lit(max(len(c) + 2, LEAST_WIDTH))), F.lit(MOST_WIDTH)).cast("double") for c, w in zip(names, longest, strict=True)))
    given = F.array(*(F.lit(float(w)) for w in widths)) if widths else None
    sizes = rows.groupBy("output").agg((given if widths else wide).alias("w"))
    parts = rows.groupBy("output", "sheet_index", "sheet").agg(F.count("*").alias("size")).join(sizes, "output")
    look, body = (LIST_LOOK, BODY_LOOK) if listing else (HEAD_LOOK, BODY_LOOK)
    zero = _lines(parts, widths=F.col("w"), formats=F.when(F.col("sheet_index") == 1, formats()), frozen=F.lit(listing), filtered=F.lit(listing))
    head = _lines(parts, row_index=F.lit(1), values=F.array(*(F.lit(c) for c in names)), kinds=F.array_repeat(F.lit("s"), len(names)), styles=F.array_repeat(F.lit(look), len(names)))
    height = F.lit(None).cast("double") if listing else height_of(F.col("values"))
    lines = _lines(rows, row_index=(F.col("n") % per + 2).cast("int"), height=height, values=F.col("values"), kinds=_alike(F.col("values"), "s"), styles=_alike(F.col("values"), body))
    return zero.union(head).union(lines)


def output_path(path: Column, suffix: str) -> Column:
    """The sibling file with another ending."""
    return F.concat(F.regexp_replace(path, r"\.[^./]+$", ""), F.lit(suffix))


def pending(files: DataFrame, existing: DataFrame | None = None, suffix: str = ".xlsx", overwrite: bool = False) -> DataFrame:
    """files with output, those left out whose output exists (``existing``: a path column). Nothing runs: showing this is a dry run."""
    out = files.withColumn("output", output_path(F.col("path"), suffix))
    return out if overwrite or existing is None else out.join(existing.select(F.col("path").alias("output")), "output", "left_anti").select(*out.columns)


def run_counts(results: DataFrame, status: str = "status", by: str = "doc_id") -> DataFrame:
    """Rows and distinct documents by status."""
    return results.groupBy(status).agg(F.count("*").alias("rows"), F.countDistinct(by).alias("documents"))


def workbook(sheets: dict[str, list[list[object]]]) -> bytes:
    """A minimal xlsx of inline strings, header row frozen."""

    def name(k: int) -> str:
        out = ""
        while k >= 0:
            out, k = chr(65 + k % 26) + out, k // 26 - 1
        return out

    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as book:
        parts = range(1, len(sheets) + 1)
        types = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in parts)
        book.writestr("[Content_Types].xml", f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{types}</Types>')
        relation = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        book.writestr("_rels/.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{relation}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{k}" Type="{relation}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in parts) + "</Relationships>")
        book.writestr("xl/workbook.xml", f'<workbook {NS} xmlns:r="{relation}"><sheets>' + "".join(f'<sheet name="{escape(s[:NAME_LENGTH], {chr(34): "&quot;"})}" sheetId="{k}" r:id="r{k}"/>' for k, s in enumerate(sheets, 1)) + "</sheets></workbook>")
        for k, rows in enumerate(sheets.values(), 1):
            body = "".join(f'<row r="{r}">' + "".join(f'<c r="{name(c)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>' for c, v in enumerate(row) if v is not None) + "</row>" for r, row in enumerate(rows, 1))
            book.writestr(f"xl/worksheets/sheet{k}.xml", f'<worksheet {NS}><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews><sheetData>{body}</sheetData></worksheet>')
    return buffer.getvalue()


def workbooks(df: DataFrame, doc_col: str = "doc_id", sheet: str = TARGET_SHEET, order: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, content): an xlsx for each document. A task holds the rows of one document, as its workbook does."""
    names = [c for c in df.columns if c != doc_col and c not in order]
    columns = [c for c in df.columns if c != doc_col]

    def work(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values(list(order)) if order else group
        body = rows[names].astype(object).where(rows[names].notna(), "").values.tolist()
        return pd.DataFrame({"doc_id": [str(group[doc_col].iloc[0])], "content": [workbook({sheet: [names, *body]})]})

    return df.select(doc_col, *columns).groupBy(doc_col).applyInPandas(work, "doc_id string, content binary")
