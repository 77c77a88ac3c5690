"""Worksheets as a data source: lines with values, kinds, styles, heights and widths; options decide which parts of a file are read."""

from __future__ import annotations

import fnmatch
import json
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from typing import BinaryIO
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
FORMAT_FIELDS = ("number_format", "font", "fill", "border", "alignment", "protection")
FORMAT = "struct<" + ",".join(f"{f}:string" for f in FORMAT_FIELDS) + ">"
#: A line of a sheet. Line 0 stands for the sheet itself: its column widths and, on the first sheet of a file, the formats that styles count through.
#: Kinds: n number, s text, b boolean, e error, f formula, - nothing.
LINES = f"sheet_index int, sheet string, row_index int, height double, values array<string>, kinds array<string>, styles array<int>, widths array<double>, formats array<{FORMAT}>"
#: Number formats that files name by number only.
BUILT_IN = {0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 12: "# ?/?", 13: "# ??/??", 14: "mm-dd-yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm", 49: "@"}


@dataclass
class Line:
    sheet_index: int
    sheet: str
    row_index: int
    height: float | None = None
    values: list[str | None] = field(default_factory=list)
    kinds: list[str] = field(default_factory=list)
    styles: list[int] = field(default_factory=list)
    widths: list[float | None] | None = None
    formats: list[tuple[str, ...]] | None = None

    def fields(self) -> tuple:
        return (self.sheet_index, self.sheet, self.row_index, self.height, self.values, self.kinds, self.styles, self.widths, self.formats)


SHEET_DATA, COL, ROW, CELL, TEXT, VALUE, FORMULA, INLINE = (MAIN + t for t in ("sheetData", "col", "row", "c", "t", "v", "f", "is"))


@cache
def column_number(letters: str) -> int:
    out = 0
    for c in letters:
        out = out * 26 + ord(c) - 64
    return out - 1


def xml_text(node: ElementTree.Element | None) -> str:
    """A fragment without name spaces, attributes in order: equal formats are equal texts."""
    if node is None:
        return ""

    def plain(e: ElementTree.Element) -> str:
        from xml.sax.saxutils import escape, quoteattr

        name = e.tag.rpartition("}")[2]
        inner = escape(e.text or "") if (e.text or "").strip() else ""
        inner += "".join(plain(x) for x in e)
        return f"<{name}" + "".join(f" {k.rpartition('}')[2]}={quoteattr(v)}" for k, v in sorted(e.attrib.items())) + (f">{inner}</{name}>" if inner else "/>")

    return plain(node)


def formats_of(book: zipfile.ZipFile) -> list[tuple[str, ...]]:
    """The cell formats of a file in the order that style numbers count, each as its number format and the texts of its parts."""
    if "xl/styles.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    numbers = BUILT_IN | {int(n.get("numFmtId")): n.get("formatCode") for n in root.iter(f"{MAIN}numFmt")}
    table = lambda k: root.iterfind(f"{MAIN}{k}/*")
    parts = {k: [xml_text(x) for x in table(k)] for k in ("fonts", "fills", "borders")}
    pick = lambda k, at: parts[k][int(at or 0)] if int(at or 0) < len(parts[k]) else ""
    out = []
    for x in table("cellXfs"):
        number = int(x.get("numFmtId") or 0)
        out.append((numbers.get(number, f"builtin {number}"), pick("fonts", x.get("fontId")), pick("fills", x.get("fillId")), pick("borders", x.get("borderId")), xml_text(x.find(f"{MAIN}alignment")), xml_text(x.find(f"{MAIN}protection"))))
    return out


def sheet_parts(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(sheet, part) in the order of the workbook; its relations say where sheets stand."""
    parts = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    sheets = [(s.get("name"), parts[s.get(f"{RELATION}id")]) for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet")]
    return [(name, target.lstrip("/") if target.startswith("/") else f"xl/{target}") for name, target in sheets]


def shared_texts(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    return ["".join(t.text or "" for t in si.iter(f"{MAIN}t")) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{MAIN}si")]


def cell(node: ElementTree.Element, shared: list[str]) -> tuple[str | None, str]:
    """(value, kind)."""
    kind = node.get("t")
    if kind == "inlineStr" and len(node) == 1 and node[0].tag == INLINE and len(node[0]) == 1 and node[0][0].tag == TEXT:
        return node[0][0].text or "", "s"
    value, formula = node.find(VALUE), node.find(FORMULA)
    text = value.text if value is not None else None
    if formula is not None and formula.text:
        return f"={formula.text}", "f"
    if kind == "inlineStr":
        return "".join(t.text or "" for t in node.iter(f"{MAIN}t")), "s"
    if text is None:
        return None, "-"
    if kind == "s":
        return shared[int(text)], "s"
    return text, {"b": "b", "e": "e", "str": "s"}.get(kind or "n", "n")


#: A sheet's part up to this many bytes is parsed as one tree, a larger one in blocks.
SMALL_PART = 1 << 18


@cache
def column_place(k: int) -> str:
    out = ""
    while k >= 0:
        out, k = chr(65 + k % 26) + out, k // 26 - 1
    return out


def line_of(node: ElementTree.Element, index: int, name: str, shared: list[str]) -> Line:
    """A row's element as a line."""
    number, values, kinds, styles = node.get("r") or "0", [], [], []
    for c in node.iter(CELL):
        place, style = c.get("r") or "", c.get("s")
        if place and place != column_place(len(values)) + number:
            letters = place.rstrip("0123456789")
            gap = (column_number(letters) if letters else len(values)) - len(values)
            if gap > 0:
                values += [None] * gap
                kinds += ["-"] * gap
                styles += [0] * gap
        value, kind = cell(c, shared)
        values.append(value)
        kinds.append(kind)
        styles.append(int(style) if style else 0)
    return Line(index, name, int(number), float(node.get("ht")) if node.get("ht") else None, values, kinds, styles)


def width_of(node: ElementTree.Element, widths: list[float | None]) -> None:
    """Sets the widths that a column element gives."""
    if node.get("width"):
        low, high = int(node.get("min")), min(int(node.get("max")), 16384)
        widths.extend([None] * (high - len(widths)))
        widths[low - 1 : high] = [float(node.get("width"))] * (high - low + 1)


#: Sheets of plain texts, as sinks.books writes them: what other text than this a part has is left to the parser.
_PLAIN = r"[^\r&\x00-\x08\x0b\x0c\x0e-\x1f￾￿]"
PLAIN_PART = re.compile(rf'<\?xml version="1.0" encoding="UTF-8" standalone="yes"\?>\n<worksheet xmlns="{re.escape(MAIN[1:-1])}"><sheetViews>{_PLAIN}*?</sheetViews>(?:<cols>({_PLAIN}*?)</cols>)?<sheetData>({_PLAIN}*)</sheetData>(?:<autoFilter ref="[A-Z0-9:]*"/>)?</worksheet>')
PLAIN_COL = re.compile(r'<col min="([0-9]{1,5})" max="\1" width="([0-9]+(?:\.[0-9]+)?)" customWidth="1"/>')
PLAIN_ROW = re.compile(r'<row r="([0-9]+)"(?: ht="([0-9]+(?:\.[0-9]+)?)" customHeight="1")?>(.*?)</row>', re.S)
PLAIN_CELL = re.compile(r'<c r="([A-Z]+)[0-9]+"(?: s="([0-9]+)")? t="inlineStr"><is><t xml:space="preserve">([^<>]*)</t></is></c>')
TAGS_A_ROW, TAGS_A_CELL = 2, 6


def plain_lines(content: bytes, head: Line, last_row: int | None) -> list[Line] | None:
    """The lines of a part that holds texts only, in cells without a gap and without references or carriage returns; None for any other.

    Every tag of its rows and columns has to be in what is matched: counts of ``<`` tell. Such a part needs no parser.
    """
    try:
        found = PLAIN_PART.fullmatch(content.decode())
    except UnicodeDecodeError:
        return None
    if not found:
        return None
    cols, rows = PLAIN_COL.findall(found[1] or ""), PLAIN_ROW.findall(found[2])
    if (found[1] or "").count("<") != len(cols) or any(int(k) > 16384 for k, _ in cols):
        return None
    out, tags, beyond = [head], 0, False
    for number, height, row in rows:
        beyond = beyond or last_row is not None and int(number) > last_row
        if beyond:
            tags += TAGS_A_ROW + row.count("<")
            continue
        cells = PLAIN_CELL.findall(row)
        size = len(cells)
        tags += TAGS_A_ROW + TAGS_A_CELL * size
        letters, styles, values = zip(*cells, strict=True) if cells else ((), (), ())
        if letters != first_places(size):
            return None
        out.append(Line(head.sheet_index, head.sheet, int(number), float(height) if height else None, list(values), ["s"] * size, [int(s) if s else 0 for s in styles]))
    if tags != found[2].count("<"):
        return None
    for k, width in cols:
        head.widths.extend([None] * (int(k) - len(head.widths)))
        head.widths[int(k) - 1] = float(width)
    return out


@cache
def first_places(n: int) -> tuple[str, ...]:
    return tuple(map(column_place, range(n)))


def small_lines(root: ElementTree.Element, head: Line, shared: list[str], last_row: int | None) -> Iterator[Line]:
    """The lines of a sheet whose part is a tree in memory."""
    for child in root:
        if child.tag == SHEET_DATA:
            break
        for node in child.iter(COL):
            width_of(node, head.widths)
    yield head
    for node in root.iter(ROW):
        if last_row is not None and int(node.get("r") or 0) > last_row:
            return
        yield line_of(node, head.sheet_index, head.sheet, shared)


def lines_of(stream: BinaryIO, names: set[str] | None = None, indexes: set[int] | None = None, last_row: int | None = None, without: frozenset[str] = frozenset()) -> Iterator[Line]:
    """The lines of a file, row by row, of some sheets only (those in ``names``, not those in ``without``) and up to a row: other parts of the archive are not read."""
    with zipfile.ZipFile(stream) as book:
        shared: list[str] | None = None
        formats = formats_of(book)
        for index, (name, part) in enumerate(sheet_parts(book), 1):
            if names is not None and name not in names or name in without or indexes is not None and index not in indexes:
                continue
            widths: list[float | None] = []
            head = Line(index, name, 0, widths=widths, formats=formats if index == 1 else None)
            if shared is None:
                shared = shared_texts(book)
            if book.getinfo(part).file_size <= SMALL_PART:
                plain = plain_lines(text := book.read(part), head, last_row)
                if plain is not None:
                    yield from plain
                    continue
                try:
                    tree = ElementTree.fromstring(text)
                except ElementTree.ParseError:
                    tree = None  # what stands before the fault is given below
                if tree is not None:
                    yield from small_lines(tree, head, shared, last_row)
                    continue
            with book.open(part) as content:
                root = None
                for event, node in ElementTree.iterparse(content, ("start", "end")):
                    if event == "start":
                        if node.tag == SHEET_DATA:
                            yield head
                            head, root = None, node
                        continue
                    if node.tag == COL and head is not None:
                        width_of(node, widths)
                    if node.tag != ROW:
                        continue
                    if last_row is not None and int(node.get("r") or 0) > last_row:
                        break
                    yield line_of(node, index, name, shared)
                    # rows that are done leave the tree, so that a sheet of any length is a block of the parser in memory
                    if root is not None:
                        root.clear()
            if head is not None:
                yield head


def located(path: str) -> tuple[object, str]:
    """(file system, path there) of a path or URI that all executors reach."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", path))


#: Cells that a task gathers before they leave it.
CELLS_HELD = 1 << 16


def batch_of(lines: list[tuple]):
    """Lines with their paths as one Arrow batch of the reader's schema."""
    import pyarrow as pa

    looks = pa.struct([(f, pa.string()) for f in FORMAT_FIELDS])
    types = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(looks))
    names = ("path", "sheet_index", "sheet", "row_index", "height", "values", "kinds", "styles", "widths", "formats")
    columns = [list(c) for c in zip(*lines, strict=True)]
    columns[-1] = [None if f is None else [dict(zip(FORMAT_FIELDS, x, strict=True)) for x in f] for f in columns[-1]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], list(names))


@dataclass
class FileRange(InputPartition):
    """Some files of the listing."""

    files: list[str]


class LineReader(DataSourceReader):
    """Reads files in groups of about ``bytesPerPartition``. What is not asked for, sheets or lines below a row, is not read from the archive."""

    def __init__(self, options: dict[str, str]):
        self.root, self.pattern = options["path"], options.get("pattern", "*.xls[xm]")
        self.bytes_each = int(options.get("bytesPerPartition", 1 << 20))
        self.names = set(json.loads(options["sheets"])) if "sheets" in options else None
        self.indexes = set(json.loads(options["indexes"])) if "indexes" in options else None
        self.last_row = int(options["lastRow"]) if "lastRow" in options else None
        self.without = frozenset(json.loads(options.get("without", "[]")))

    def partitions(self) -> list[FileRange]:
        from pyarrow import fs

        system, at = located(self.root)
        found = system.get_file_info(at)
        found = [found] if found.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True))
        prefix = self.root[: len(self.root) - len(at)] if self.root.endswith(at) else ""
        files = sorted((prefix + f.path, f.size) for f in found if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, self.pattern) and not f.base_name.startswith(("_", ".")))
        out, room = [], 0
        for path, size in files:
            if room <= 0:
                out.append(FileRange([]))
                room = self.bytes_each
            out[-1].files.append(path)
            room -= size
        return out or [FileRange([])]

    def open(self, path: str) -> BinaryIO:
        system, at = located(path)
        return system.open_input_file(at)

    def read(self, partition: FileRange) -> Iterator[tuple]:
        for path in partition.files:
            try:
                with self.open(path) as stream:
                    for line in lines_of(stream, self.names, self.indexes, self.last_row, self.without):
                        yield path, *line.fields()
            except Exception as broken:  # one bad file does not end the run
                yield path, 0, "error", 0, None, [f"{type(broken).__name__}: {broken}"], ["e"], [0], None, None


class BatchReader(LineReader):
    """The same lines as Arrow batches, which Spark takes as they are: it would convert tuples value by value."""

    def read(self, partition: FileRange) -> Iterator:
        held, size = [], 0
        for row in super().read(partition):
            held.append(row)
            size += 1 + len(row[5])
            if size >= CELLS_HELD:
                yield batch_of(held)
                held, size = [], 0
        if held:
            yield batch_of(held)


class Books(DataSource):
    """``spark.read.format("books").load(folder)``: every line of every sheet of its xlsx and xlsm files."""

    @classmethod
    def name(cls) -> str:
        return "books"

    def schema(self) -> str:
        return f"path string, {LINES}"

    def reader(self, schema) -> LineReader:
        return BatchReader(self.options)


def read_lines(spark: SparkSession, path: str, pattern: str = "*.xls[xm]", sheets: list[str] | None = None, indexes: list[int] | None = None, last_row: int | None = None, without: list[str] | None = None) -> DataFrame:
    """(path, sheet_index, sheet, row_index, height, values, kinds, styles, widths, formats) of a file or a folder's files.

    ``sheets`` and ``indexes`` (from 1) choose sheets, ``without`` leaves some out, ``last_row`` ends each sheet: other parts of an archive are not read. These
    are options, not pushed filters: in Spark 4.1 a filter that one scan has pushed into a Python reader also holds in
    other scans of the same DataFrame. A file that cannot be read gives one row: sheet ``error``, index 0, the message as
    its value. An empty folder gives no row.
    """
    spark.dataSource.register(Books)
    source = spark.read.format("books").option("pattern", pattern)
    for name, value in (("sheets", sheets), ("indexes", indexes), ("lastRow", last_row), ("without", without)):
        source = source if value is None else source.option(name, json.dumps(value))
    return source.load(path)
