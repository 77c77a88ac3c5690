"""Workbooks written line by line, new ones and copies of others with one sheet anew; files appear when the whole write has succeeded."""

from __future__ import annotations

import io
import json
import re
import shutil
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import count
from typing import BinaryIO
from xml.sax.saxutils import escape, quoteattr

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..sources.books import BUILT_IN, located

SHEET_NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
SHEET_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"
#: What a file cannot do without: the formats of cells that have none.
PLAIN = ("General", '<font><sz val="11"/><name val="Calibri"/></font>', '<fill><patternFill patternType="none"/></fill>', "<border/>", "", "")
GRAY = '<fill><patternFill patternType="gray125"/></fill>'


def column_name(k: int) -> str:
    out = ""
    while k >= 0:
        out, k = chr(65 + k % 26) + out, k // 26 - 1
    return out


def styles_xml(formats: list[tuple[str, ...]]) -> str:
    """The style part for cell formats: each distinct font, fill, border and number format once."""
    formats = formats or [PLAIN]
    tables = [list(dict.fromkeys([*first, *(f[k] or PLAIN[k] for f in formats)])) for k, first in ((1, []), (2, [PLAIN[2], GRAY]), (3, []))]
    known = {code: k for k, code in BUILT_IN.items()}
    numbers = {code: 164 + k for k, code in enumerate(c for c in dict.fromkeys(f[0] or "General" for f in formats) if c not in known)}
    head = f'<numFmts count="{len(numbers)}">' + "".join(f"<numFmt numFmtId={quoteattr(str(k))} formatCode={quoteattr(c)}/>" for c, k in numbers.items()) + "</numFmts>" if numbers else ""
    xfs = []
    for f in formats:
        ids = [table.index(f[k] or PLAIN[k]) for k, table in zip((1, 2, 3), tables, strict=True)]
        inner = (f[4] or "") + (f[5] or "")
        xfs.append(f'<xf numFmtId="{(known | numbers)[f[0] or "General"]}" fontId="{ids[0]}" fillId="{ids[1]}" borderId="{ids[2]}" xfId="0" applyNumberFormat="1" applyFont="1" applyFill="1" applyBorder="1"' + (f' applyAlignment="{int(bool(f[4]))}" applyProtection="{int(bool(f[5]))}">{inner}</xf>' if inner else "/>"))
    lists = "".join(f'<{name} count="{len(t)}">{"".join(t)}</{name}>' for name, t in zip(("fonts", "fills", "borders"), tables, strict=True))
    return f'<styleSheet {SHEET_NS}>{head}{lists}<cellStyleXfs count="1"><xf numFmtId="0" fontId="0" fillId="0" borderId="0"/></cellStyleXfs><cellXfs count="{len(xfs)}">{"".join(xfs)}</cellXfs></styleSheet>'


#: Characters that XML cannot hold.
UNFIT = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff￾￿]")


@cache
def place_of(k: int) -> str:
    return column_name(k)


#: The same characters as Arrow's search takes them; its texts hold no surrogates.
UNFIT_ARROW = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x{fffe}\x{ffff}]"
#: Bytes of a batch's cells whose markup is sure to fit Arrow's texts of 2 GB.
MARKED_BYTES = 1 << 27


def marked_rows(batch: pa.RecordBatch) -> tuple[list[str], list[int]] | None:
    """Each line's element and its number of cells, made for all lines of a batch at once, or None where cells need a closer look (formulas, characters that XML cannot hold, lists that do not match)."""
    values, kinds, styles, heights, numbers = (batch.column(n) for n in ("values", "kinds", "styles", "height", "row_index"))
    if any(c.null_count for c in (values, kinds, styles, numbers)):
        return None
    sizes = [pc.list_value_length(c).to_numpy(zero_copy_only=False) for c in (values, kinds, styles)]
    texts, kind, style = values.flatten(), kinds.flatten(), styles.flatten()
    if not all(np.array_equal(sizes[0], s) for s in sizes[1:]) or kind.null_count or style.null_count or texts.nbytes + 16 * len(texts) > MARKED_BYTES:
        return None
    kind, style = kind.dictionary_encode(), style.dictionary_encode()
    if "f" in kind.dictionary.to_pylist() or pc.any(pc.match_substring_regex(texts, UNFIT_ARROW)).as_py():
        return None
    named = lambda encoded, said: pa.array([said(x) for x in encoded.dictionary.to_pylist()], pa.string()).take(encoded.indices)
    ends = np.concatenate([[0], np.cumsum(sizes[0])]).astype(np.int32)
    row = np.repeat(np.arange(len(numbers)), sizes[0])
    places = pa.array([place_of(k) for k in range(int(sizes[0].max(initial=0)))], pa.string()).take(pa.array(np.arange(len(texts)) - ends[row]))
    number = numbers.cast(pa.string())
    mark = named(style, lambda s: f' s="{s}"' if s else "")
    begin = pc.binary_join_element_wise('<c r="', places, number.take(pa.array(row)), '"', mark, "")
    inner = pc.fill_null(texts, "")
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        if pc.any(pc.match_substring(inner, sign)).as_py():
            inner = pc.replace_substring(inner, sign, name)
    opened = named(kind, lambda k: ' t="inlineStr"><is><t xml:space="preserve">' if k == "s" else "><v>" if k == "n" else f' t="{k}"><v>')
    closed = named(kind, lambda k: "</t></is></c>" if k == "s" else "</v></c>")
    cells = pc.binary_join_element_wise(begin, opened, inner, closed, "")
    empty = pc.or_(pc.is_null(texts), pc.equal(kind.cast(pa.string()), "-"))
    if pc.any(empty).as_py():
        bare = pc.if_else(pc.equal(mark, ""), "", pc.binary_join_element_wise(begin, "/>", ""))
        cells = pc.if_else(empty, bare, cells)
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), cells), "")
    high = pc.fill_null(named(heights.dictionary_encode(), lambda h: f' ht="{h:g}" customHeight="1"'), "")
    return pc.binary_join_element_wise('<row r="', number, '"', high, ">", joined, "</row>", "").to_pylist(), sizes[0].tolist()


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch, with the element of each line where all are made at once; lists of texts and numbers are cut from one flat list a column, which is several times as fast as value by value."""
    marked = marked_rows(batch)
    if marked:
        batch = batch.drop_columns(["values", "kinds", "styles"])
    names, columns = [*batch.schema.names, *(("element", "wide") if marked else ())], []
    for column in batch.columns:
        if pa.types.is_list(column.type) and not pa.types.is_nested(column.type.value_type):
            flat, ends = column.values.to_pylist(), column.offsets.to_pylist()
            there = column.is_valid().to_pylist()
            columns.append([flat[a:b] if ok else None for ok, a, b in zip(there, ends, ends[1:], strict=False)])
        elif column.null_count == len(column):
            columns.append([None] * len(column))
        else:
            columns.append(column.to_pylist())
    for row in zip(*columns, *(marked or ()), strict=True):
        yield dict(zip(names, row, strict=True))


def cell_xml(place: str, value: str | None, kind: str, style: int) -> str:
    mark = f' s="{style}"' if style else ""
    if value is None or kind == "-":
        return f'<c r="{place}"{mark}/>' if style else ""
    if kind == "s":
        return f'<c r="{place}"{mark} t="inlineStr"><is><t xml:space="preserve">{escape(value if value.isprintable() else UNFIT.sub("", value))}</t></is></c>'
    if kind == "f":
        return f'<c r="{place}"{mark}><f>{escape(value[1:])}</f></c>'
    return f'<c r="{place}"{mark}' + ("" if kind == "n" else f' t="{kind}"') + f"><v>{escape(value)}</v></c>"


class SheetPart:
    """One sheet, line by line. Its filter's range is known at the end, its widths before the first line."""

    def __init__(self, out: BinaryIO, widths: list[float | None], frozen: bool, filtered: bool):
        self.out, self.filtered, self.wide, self.rows, self.held, self.size = out, filtered, 0, 0, [], 0
        pane = '<pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/>' if frozen else ""
        cols = "".join(f'<col min="{k}" max="{k}" width="{w:g}" customWidth="1"/>' for k, w in enumerate(widths or [], 1) if w is not None)
        self._put(f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<worksheet {SHEET_NS}><sheetViews><sheetView workbookViewId="0">{pane}</sheetView></sheetViews>{f"<cols>{cols}</cols>" if cols else ""}<sheetData>')

    def _put(self, text: str) -> None:
        """Lines go to the compressor in pieces of some 64 KB."""
        self.held.append(text)
        self.size += len(text)
        if self.size >= 1 << 16:
            self._flush()

    def _flush(self) -> None:
        self.out.write("".join(self.held).encode())
        self.held, self.size = [], 0

    def line(self, number: int, height: float | None, values: list[str | None], kinds: list[str], styles: list[int]) -> None:
        cells = "".join(cell_xml(f"{place_of(k)}{number}", v, kind, s) for k, (v, kind, s) in enumerate(zip(values, kinds, styles, strict=True)))
        self.element(number, f'<row r="{number}"' + (f' ht="{height:g}" customHeight="1"' if height is not None else "") + f">{cells}</row>", len(values))

    def element(self, number: int, text: str, wide: int) -> None:
        """A line whose element is made already."""
        self._put(text)
        self.wide, self.rows = max(self.wide, wide), max(self.rows, number)

    def close(self) -> None:
        area = f'<autoFilter ref="A1:{column_name(max(0, self.wide - 1))}{max(1, self.rows)}"/>' if self.filtered and self.wide else ""
        self._put(f"</sheetData>{area}</worksheet>")
        self._flush()
        self.out.close()


class NewBook:
    """A workbook whose sheets come one after the other."""

    def __init__(self, out: BinaryIO, formats: list[tuple[str, ...]]):
        self.book, self.names, self.part = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED), [], None
        self.book.writestr("xl/styles.xml", styles_xml(formats))

    def sheet(self, name: str, widths: list[float | None], frozen: bool, filtered: bool) -> None:
        self._end()
        self.names.append(name)
        self.part = SheetPart(self.book.open(f"xl/worksheets/sheet{len(self.names)}.xml", "w", force_zip64=True), widths, frozen, filtered)

    def _end(self) -> None:
        if self.part:
            self.part.close()
            self.part = None

    def close(self) -> None:
        self._end()
        each = list(enumerate(self.names, 1))
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{SHEET_TYPE}"/>' for k, _ in each)
        self.book.writestr("[Content_Types].xml", f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>{kinds}</Types>')
        self.book.writestr("_rels/.rels", f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        self.book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="styles" Type="{OFFICE}/styles" Target="styles.xml"/>' + "".join(f'<Relationship Id="rId{k}" Type="{OFFICE}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k, _ in each) + "</Relationships>")
        self.book.writestr("xl/workbook.xml", f'<workbook {SHEET_NS} xmlns:r="{OFFICE}"><sheets>' + "".join(f'<sheet name={quoteattr(n)} sheetId="{k}" r:id="rId{k}"/>' for k, n in each) + "</sheets></workbook>")
        self.book.close()


class PatchedBook:
    """Another file's package with one sheet of the given name in front: a sheet that had this name goes, every other part passes as it is.

    Only the workbook part, its relations and the list of types are edited. Names defined for a sheet follow its new
    place; those of the sheet that goes, and the calculation chain with it, go too.
    """

    def __init__(self, out: BinaryIO, source: BinaryIO):
        self.book, self.source, self.part = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED), zipfile.ZipFile(source), None

    def sheet(self, name: str, widths: list[float | None], frozen: bool, filtered: bool) -> None:
        if self.part:
            raise ValueError("a copy gets one new sheet")
        held = self.source
        taken = set(held.namelist())
        part = next(p for k in count(1) if (p := f"xl/worksheets/sheet{k}.xml") not in taken)
        book, links, types = (held.read(p).decode() for p in ("xl/workbook.xml", "xl/_rels/workbook.xml.rels", "[Content_Types].xml"))
        sheets = re.findall(r"<sheet\b[^>]*?/>", book)
        names = [_attribute(s, "name") for s in sheets]
        old = names.index(name) if name in names else None
        gone = set()
        relations = re.findall(r"<Relationship\b[^>]*?/>", links)
        where = {_attribute(r, "Id"): r for r in relations}
        if old is not None:
            link = where[_attribute(sheets[old], r"\w+:id")]
            gone |= {_part(_attribute(link, "Target"))}
            gone |= {re.sub(r"([^/]+)$", r"_rels/\1.rels", p) for p in set(gone)} & taken
            chain = [r for r in relations if _attribute(r, "Type").endswith("/calcChain")]
            gone |= {_part(_attribute(r, "Target")) for r in chain}
            for r in (link, *chain):
                links = links.replace(r, "")
            for p in gone:
                types = re.sub(rf"<Override\b[^>]*?PartName=\"/{re.escape(p)}\"[^>]*?/>", "", types)
            book = book.replace(sheets[old], "", 1)
        ids = [int(_attribute(s, "sheetId")) for s in sheets]
        key = next(k for n in count(1) if (k := f"new{n}") not in where)
        prefix = re.search(rf'xmlns:(\w+)="{re.escape(OFFICE)}"', book)
        book = re.sub(r"<sheets\b[^>]*>", lambda m: f'{m[0]}<sheet name={quoteattr(name)} sheetId="{max(ids, default=0) + 1}" {prefix[1]}:id="{key}"/>', book, count=1)

        def moved(m: re.Match) -> str:
            at = re.search(r'localSheetId="(\d+)"', m[0])
            if not at:
                return m[0]
            k = int(at[1])
            return "" if k == old else m[0].replace(at[0], f'localSheetId="{k + 1 - (old is not None and k > old)}"', 1)

        book = re.sub(r"<definedName\b.*?</definedName>", moved, book, flags=re.S)
        book = re.sub(r"<definedNames>\s*</definedNames>", "", book)
        book = re.sub(r' activeTab="\d+"', "", book)
        links = links.replace("</Relationships>", f'<Relationship Id="{key}" Type="{OFFICE}/worksheet" Target="{part.removeprefix("xl/")}"/></Relationships>')
        types = types.replace("</Types>", f'<Override PartName="/{part}" ContentType="{SHEET_TYPE}"/></Types>')
        edited = {"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": links, "[Content_Types].xml": types}
        for entry in held.infolist():
            if entry.filename in edited:
                self.book.writestr(entry.filename, edited[entry.filename])
            elif entry.filename not in gone:
                with held.open(entry) as a, self.book.open(entry.filename, "w", force_zip64=True) as b:
                    shutil.copyfileobj(a, b, 1 << 20)
        self.part = SheetPart(self.book.open(part, "w", force_zip64=True), widths, frozen, filtered)

    def close(self) -> None:
        if self.part:
            self.part.close()
        self.book.close()
        self.source.close()


def _attribute(tag: str, name: str) -> str:
    from xml.sax.saxutils import unescape

    found = re.search(rf'\s{name}=("([^"]*)"|\'([^\']*)\')', tag)
    return unescape((found[2] if found[2] is not None else found[3]) if found else "", {"&quot;": '"', "&apos;": "'"})


def _part(target: str) -> str:
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


@dataclass
class Written(WriterCommitMessage):
    """(staged, output, sheets, rows) of the files that a task has staged, or would have."""

    files: list[tuple[str | None, str, int, int]]


class Publisher(DataSourceArrowWriter):
    """Tasks write below a staging folder of the write; committing moves the files to their places, aborting drops the folder.

    Options: ``path``, the folder that outputs lie in; ``existing``: replace (default), skip or error; ``dryRun``: tasks
    count and write nothing; ``report``: a folder for a JSON line a file: output, action (written, skipped, planned),
    sheets, rows. A task that runs twice stages other files; only those of the attempt that is committed move.
    """

    def __init__(self, options: dict[str, str]):
        self.root, self.report = options["path"].rstrip("/"), options.get("report")
        self.existing, self.dry = options.get("existing", "replace"), options.get("dryrun", options.get("dryRun", "false")).lower() == "true"
        if self.existing not in ("replace", "skip", "error"):
            raise ValueError("existing is replace, skip or error")
        self.staging = f"{self.root}/_staging-{uuid.uuid4().hex}"

    def target(self, output: str) -> str:
        if output.startswith("/") or ".." in output.split("/"):
            raise ValueError(f"{output} does not lie below {self.root}")
        return f"{self.root}/{output}"

    def there(self, output: str) -> bool:
        from pyarrow import fs

        system, at = located(self.target(output))
        return system.get_file_info(at).type != fs.FileType.NotFound

    def wanted(self, output: str) -> bool:
        """Whether this file is to be written. An error for one that exists is raised before anything is moved."""
        if self.existing == "replace" or not self.there(output):
            return True
        if self.existing == "error":
            raise FileExistsError(self.target(output))
        return False

    def staged(self) -> tuple[str, BinaryIO]:
        path = f"{self.staging}/{uuid.uuid4().hex}"
        system, at = located(path)
        system.create_dir(at.rpartition("/")[0], recursive=True)
        return path, system.open_output_stream(at, buffer_size=1 << 16)

    def commit(self, messages: list[Written | None]) -> None:
        rows = [f for m in messages if m for f in m.files]
        seen = [f[1] for f in rows]
        if len(set(seen)) < len(seen):
            self.abort(messages)
            raise ValueError("one output came from several tasks: deal rows out by it")
        system, root = located(self.root)
        made: set[str] = set()
        for staged, output, _, _ in rows:
            if staged:
                goal = self.target(output).replace(self.root, root, 1)
                folder = goal.rpartition("/")[0]
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                system.move(staged.replace(self.root, root, 1), goal)
        self._drop()
        if self.report:
            system, at = located(f"{self.report.rstrip('/')}/part-{uuid.uuid4().hex}.json")
            system.create_dir(at.rpartition("/")[0], recursive=True)
            with system.open_output_stream(at) as out:
                for staged, output, sheets, lines in rows:
                    action = "planned" if self.dry and sheets >= 0 else "written" if staged else "skipped"
                    out.write((json.dumps({"output": output, "action": action, "sheets": max(sheets, 0), "rows": max(lines, 0)}) + "\n").encode())

    def abort(self, messages: list[Written | None]) -> None:
        self._drop()

    def _drop(self) -> None:
        system, at = located(self.staging)
        try:
            system.delete_dir(at)
        except FileNotFoundError:
            pass

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        raise NotImplementedError


class BookWriter(Publisher):
    """Lines in the order of output, sheet_index and row_index become workbooks. No more than a line and the compressor's buffer is held."""

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        done: list[tuple[str | None, str, int, int]] = []
        now, book, sheet, rows, sheets = None, None, None, 0, 0
        path, stream = None, None

        def end() -> None:
            nonlocal book, stream
            if book:
                book.close()
                stream.close()
            if now is not None:
                done.append((path, now, sheets, rows) if wanted else (None, now, -1, -1))
            book = stream = None

        wanted = False
        for batch in iterator:
            for r in rows_of(batch):
                if r["output"] != now:
                    end()
                    now, sheet, rows, sheets, path = r["output"], None, 0, 0, None
                    if now in {d[1] for d in done}:
                        raise ValueError("lines must come sorted by output")
                    wanted = self.wanted(now)
                    if wanted and not self.dry:
                        path, stream = self.staged()
                        if r.get("source"):
                            system, at = located(r["source"])
                            book = PatchedBook(stream, system.open_input_file(at))
                        else:
                            formats = [tuple(f.values()) for f in r["formats"] or []]
                            book = NewBook(stream, formats)
                if not wanted:
                    continue
                if (r["sheet_index"], r["sheet"]) != sheet:
                    sheet, sheets = (r["sheet_index"], r["sheet"]), sheets + 1
                    if book:
                        book.sheet(r["sheet"], r["widths"] or [], bool(r.get("frozen")), bool(r.get("filtered")))
                if r["row_index"] > 0:
                    rows += 1
                    if book and "element" in r:
                        book.part.element(r["row_index"], r["element"], r["wide"])
                    elif book:
                        book.part.line(r["row_index"], r["height"], r["values"], r["kinds"], r["styles"])
        end()
        return Written(done)


class BytesWriter(Publisher):
    """(output, content): each row a file, such as an image. A null content is an error of the write."""

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        done = []
        for batch in iterator:
            for r in batch.to_pylist():
                if r["content"] is None:
                    raise ValueError(f"{r['output']} has no content")
                wanted = self.wanted(r["output"])
                path = None
                if wanted and not self.dry:
                    path, stream = self.staged()
                    with stream:
                        stream.write(r["content"])
                done.append((path, r["output"], 0 if wanted else -1, 0))
        return Written(done)


class BookSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "books_out"

    def writer(self, schema, overwrite: bool) -> Publisher:
        return (BytesWriter if "content" in schema.fieldNames() else BookWriter)(dict(self.options))


def save_books(lines: DataFrame, folder: str, existing: str = "replace", dry_run: bool = False, report: str | None = None, partitions: int | None = None) -> None:
    """Writes workbooks below ``folder``: ``lines`` as sources.books gives them, with ``output`` (a path there) for path.

    Line 0 of a sheet carries its widths; that of a file's first sheet the formats. Optional columns: ``source``, a file
    whose package is copied with this one sheet in front; ``frozen`` and ``filtered`` (on line 0): header row frozen,
    filter over the range. A workbook is written by one task, as the format demands, line by line: one of a third of all
    rows takes time, not memory. Nothing appears before all is written.
    """
    # a given number: adaptive execution would put many workbooks into one task, as their lines are few bytes when shuffled. Several
    # for each core: with one each, some would have twice as many workbooks as others
    spark = lines.sparkSession
    dealt = lines.repartition(partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), "output")
    _save(dealt.sortWithinPartitions("output", "sheet_index", "row_index"), folder, existing, dry_run, report)


def save_bytes(df: DataFrame, folder: str, existing: str = "replace", dry_run: bool = False, report: str | None = None) -> None:
    """Writes (output, content) rows as files below ``folder``, all or none. Two rows of one output are an error."""
    _save(df.select("output", "content"), folder, existing, dry_run, report)


#: Rows that go to a Python worker at once. Spark measures a batch after each row, and that steps again over all null lists at
#: its end (as formats and widths are): time grows with the square of a batch.
BATCH_ROWS, ROWS_AT_ONCE = "spark.sql.execution.arrow.maxRecordsPerBatch", 500


def _save(df: DataFrame, folder: str, existing: str, dry_run: bool, report: str | None) -> None:
    spark = df.sparkSession
    spark.dataSource.register(BookSink)
    out = df.write.format("books_out").mode("append").option("existing", existing).option("dryRun", str(dry_run).lower())
    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, str(ROWS_AT_ONCE))
    try:
        (out.option("report", report) if report else out).save(folder)
    finally:
        spark.conf.set(BATCH_ROWS, before)


def packed(lines: list[dict], source: bytes | None = None) -> bytes:
    """One workbook in memory, of lines in order: for small files and tests."""
    out = io.BytesIO()
    book = PatchedBook(out, io.BytesIO(source)) if source else NewBook(out, [tuple(f) for f in lines[0].get("formats") or []])
    sheet = None
    for r in lines:
        if (r["sheet_index"], r["sheet"]) != sheet:
            sheet = (r["sheet_index"], r["sheet"])
            book.sheet(r["sheet"], r.get("widths") or [], r.get("frozen", False), r.get("filtered", False))
        if r["row_index"] > 0:
            book.part.line(r["row_index"], r.get("height"), r["values"], r["kinds"], r["styles"])
    book.close()
    return out.getvalue()


def with_formats(lines: DataFrame, source_col: str = "path", output_col: str = "output") -> DataFrame:
    """``lines`` of several files that go into one ``output``, their styles counted through one table of formats.

    Equal formats of all files of an output are one, at the place of the first by text; each file's styles are
    renumbered by a list that has a number for each of its formats (a file format allows 65,490). Formats stand on line 0
    of the output's first sheet; line 0 of each sheet has to be there.
    """
    named = lines.where(F.col("formats").isNotNull()).select(output_col, source_col, F.posexplode("formats").alias("old", "format"))
    distinct = named.groupBy(output_col).agg(F.array_sort(F.collect_set("format")).alias("every"))
    number = named.join(distinct, output_col).select(output_col, source_col, "old", (F.array_position("every", F.col("format")) - 1).cast("int").alias("new"))
    number = number.groupBy(output_col, source_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("old", "new"))), lambda x: x["new"]).alias("new"))
    out = lines.join(number, [output_col, source_col], "left").join(distinct, output_col, "left")
    first = F.min("sheet_index").over(_by(output_col))
    styles = F.zip_with("styles", "kinds", lambda s, k: F.when((s == 0) & (k == "-"), 0).otherwise(F.coalesce(F.get("new", s), F.lit(0))))
    formats = F.when((F.col("row_index") == 0) & (F.col("sheet_index") == first), F.col("every"))
    return out.withColumn("styles", styles).withColumn("formats", formats).drop("new", "every")


def _by(column: str):
    from pyspark.sql import Window

    return Window.partitionBy(column)
