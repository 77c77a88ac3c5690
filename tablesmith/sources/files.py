"""File sources: listing, page ranges, tables and page text of PDFs, worksheets, prompts and settings."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import CELLS, PAGE_TEXT, SHEET_ROWS
from .books import lines_of

PDF_GLOB = "*.[pP][dD][fF]"
# Tolerances of the line-based table search.
LINE_SETTINGS = {"vertical_strategy": "lines", "horizontal_strategy": "lines", "snap_tolerance": 3, "join_tolerance": 3, "edge_min_length": 20, "min_words_vertical": 1, "min_words_horizontal": 1, "intersection_tolerance": 3, "text_tolerance": 3}


def list_files(spark: SparkSession, path: str, pattern: str = PDF_GLOB, recursive: bool = True, limit: int = 0) -> DataFrame:
    """(doc_id, file_name, path, length), sorted by path; ``limit`` 0 is all. No content is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", pattern).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    out = found.select(F.sha2("path", 256).alias("doc_id"), name.alias("file_name"), "path", "length").orderBy("path")
    return out.limit(limit) if limit > 0 else out


def page_ranges(text: str) -> list[tuple[int, int]] | None:
    """``all`` is None; ``1``, ``1,3,5``, ``2-8`` and ``1,3-5`` are ranges, ends included. Anything else raises ValueError."""
    if text.strip().lower() == "all":
        return None
    out = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        low, dash, high = part.partition("-")
        out.append((int(low), int(high if dash else low)))
    return out


def on_pages(text: str, page: Column | str = "page") -> Column:
    """The filter for a page range; it reaches the scan of a columnar table."""
    ranges = page_ranges(text)
    column = F.col(page) if isinstance(page, str) else page
    out = F.lit(ranges is None)
    for low, high in ranges or []:
        out = out | column.between(low, high)
    return out


def read_cells(spark: SparkSession, path: str, pages: str = "all", kind: str = "parquet") -> DataFrame:
    """The cell relation from Parquet, JSON or CSV, pruned to pages."""
    return spark.read.format(kind).schema(CELLS).load(path).where(on_pages(pages))


def read_page_text(spark: SparkSession, path: str, max_pages: int, kind: str = "parquet") -> DataFrame:
    return spark.read.format(kind).schema(PAGE_TEXT).load(path).where(F.col("page") <= max_pages)


def pdf_cells(spark: SparkSession, path: str, pages: str = "all", pattern: str = PDF_GLOB) -> DataFrame:
    """The cell relation of PDF files, file by file on the executors, with an error row (page null) for a file that cannot be read.

    Needs pdfplumber where the tasks run; without it the first task says so.
    """
    ranges = page_ranges(pages)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            import pdfplumber
        except ImportError as missing:
            raise RuntimeError("reading PDFs needs pdfplumber on the executors") from missing
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    with pdfplumber.open(io.BytesIO(content)) as pdf:
                        for number, page in enumerate(pdf.pages, 1):
                            if ranges is not None and not any(a <= number <= b for a, b in ranges):
                                continue
                            for k, table in enumerate(page.extract_tables(LINE_SETTINGS) or [], 1):
                                rows = [(name, "pdfplumber_lines", number, k, r, c, v) for r, row in enumerate(table) for c, v in enumerate(row)]
                                yield pd.DataFrame(rows, columns=[f.split()[0] for f in CELLS.split(", ")])
                except Exception as broken:  # one bad file does not end the run
                    yield pd.DataFrame([(name, "error", None, None, None, None, str(broken))], columns=[f.split()[0] for f in CELLS.split(", ")])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "content").mapInPandas(work, CELLS)


def sheet_rows(content: bytes) -> Iterator[tuple[str, int, int, list[str | None]]]:
    """(sheet, sheet_index, row_index, values) of a workbook, row by row. A formula's value is its text."""
    for line in lines_of(io.BytesIO(content)):
        if line.row_index > 0:
            yield line.sheet, line.sheet_index, line.row_index, line.values


def opened(workbooks: DataFrame) -> DataFrame:
    """(path, sheet_index, sheet, row_index, values) of workbooks given as path and content; one that cannot be read gives one row with sheet ``error``, index 0 and the message as its value."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows = [(name, k, s, r, v) for s, k, r, v in sheet_rows(content)]
                except Exception as broken:  # one bad file does not end the run
                    rows = [(name, 0, "error", 0, [f"{type(broken).__name__}: {broken}"])]
                yield pd.DataFrame(rows, columns=["path", "sheet_index", "sheet", "row_index", "values"])

    return workbooks.select("path", "content").mapInPandas(work, f"path string, sheet_index int, {SHEET_ROWS}")


def read_workbooks(spark: SparkSession, path: str, pattern: str = "*.xls[xm]") -> DataFrame:
    """:func:`opened` for the xlsx and xlsm files of a folder, file by file on the executors."""
    return opened(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path))


def settings(lines: DataFrame, value_col: str = "value", order: str | None = None) -> DataFrame:
    """(key, value) of ``KEY=VALUE`` lines: comments and other lines are skipped, quotes around values go. Of a repeated key the first counts, by the column ``order`` (a line number), else by the least value."""
    line = F.btrim(F.col(value_col))
    parts = F.split(line, "=", 2)
    value = F.regexp_replace(F.btrim(parts[1]), "^[\"']+|[\"']+$", "")
    found = lines.where(~F.startswith(line, F.lit("#")) & line.contains("=")).select(F.btrim(parts[0]).alias("key"), value.alias("value"), (F.col(order) if order else value).alias("__at"))
    return found.groupBy("key").agg(F.min_by("value", F.struct("__at", "value")).alias("value"))


def prompt(text: Column | str | None, file_text: Column | None = None) -> Column:
    """The prompt: the file's text before the literal one, without a byte order mark; a blank one is an error."""
    literal = F.lit(None).cast("string") if text is None else F.col(text) if isinstance(text, str) else text
    chosen = literal if file_text is None else F.coalesce(file_text, literal)
    bare = F.btrim(F.regexp_replace(F.coalesce(chosen, F.lit("")), "^﻿", ""))
    return F.when(bare != "", bare).otherwise(F.raise_error(F.lit("the prompt must not be empty")).cast("string"))


def fetch(pages: DataFrame, url_col: str = "url", timeout: int = 20) -> DataFrame:
    """(…, html, error): each row's page by HTTP GET on the executors, UTF-8 with bad bytes replaced. A page that cannot be had, a null url too, has null html and the reason."""
    kept = [f for f in pages.schema.fields if f.name not in ("html", "error")]
    columns = [f.name for f in kept]

    def get(url: str | None) -> tuple[str | None, str | None]:
        from http.client import HTTPException
        from urllib import error, request

        try:
            with request.urlopen(request.Request(url or "", headers={"User-Agent": "tablesmith/1.0", "Accept": "text/html"}), timeout=timeout) as answer:
                return answer.read().decode("utf-8", errors="replace"), None
        except error.HTTPError as failed:
            return None, f"HTTP {failed.code}"
        except (OSError, HTTPException, ValueError) as failed:
            return None, f"request failed: {failed}"

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [get(u) for u in batch[url_col]]
            yield batch.assign(html=[g[0] for g in got], error=[g[1] for g in got])[[*columns, "html", "error"]]

    return pages.mapInPandas(work, T.StructType(kept).add("html", "string").add("error", "string"))
