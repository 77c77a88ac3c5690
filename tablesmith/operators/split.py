"""Model and count pairs in a detail cell, and the worksheet that holds such cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import numeral
from ..functions.text import col, strip

# Names of the column, the result sheet and the count, and the grammar of a pair.
DETAIL, RESULT_SHEET, COUNT, SPLIT_SUFFIX = "物料明细", "拆分结果", "台数", "_台数已拆分"
MODEL = r"[A-Za-z]{1,6}\d*(?:[-.][A-Za-z0-9]+)+"
PAIR = rf"(?iU)({MODEL})\s*(?:样机|定频)?\s*(\d+|[零〇一二两三四五六七八九十百]+)\s*台"
HEADER_ROWS = 30


def details(x: Column | str) -> Column:
    """array<struct<model, cnt>>: all pairs; without any all bare models, count null; without any the text itself. Blank cells give none."""
    text = strip(F.coalesce(col(x), F.lit("")))
    names, counts = (F.regexp_extract_all(text, F.lit(PAIR), F.lit(k)) for k in (1, 2))
    pairs = F.zip_with(names, counts, lambda m, n: F.struct(m.alias("model"), numeral(n).alias("cnt")))
    bare = F.transform(F.regexp_extract_all(text, F.lit(f"(?iU){MODEL}"), F.lit(0)), lambda m: F.struct(m.alias("model"), F.lit(None).cast("int").alias("cnt")))
    whole = F.array(F.struct(text.alias("model"), F.lit(None).cast("int").alias("cnt")))
    return F.when(text == "", F.slice(whole, 1, 0)).when(F.size(pairs) > 0, pairs).when(F.size(bare) > 0, bare).otherwise(whole)


def find_header(rows: DataFrame, name: str = DETAIL, sheet: str | None = None, path: str | None = None) -> DataFrame:
    """(sheet, row_index, col_index) of the first cell equal to ``name`` in the first rows of the sheets, the result sheet left out.

    rows: sheet, sheet_index, row_index, values. With a ``path`` column each of its values is a workbook with a header of its own.
    """
    some = rows.where(F.col("row_index").between(1, HEADER_ROWS) & ((F.col("sheet") == sheet) if sheet else (F.col("sheet") != RESULT_SHEET)))
    hit = some.withColumn("col_index", F.array_position(F.transform("values", strip), name).cast("int") - 1).where("col_index >= 0")
    keys = [path] if path else []
    first = F.min_by(F.struct("sheet", "row_index", "col_index"), F.struct("sheet_index", "row_index")).alias("x")
    return hit.groupBy(*keys).agg(first).where("x is not null").select(*keys, "x.*")


def split(df: DataFrame, detail_col: str = DETAIL, count_col: str = COUNT) -> DataFrame:
    """One row for each pair of a row's details, the detail replaced by the model and the count added; a blank detail keeps its row, an entirely blank row goes."""
    some = F.lit(False)
    for c in df.columns:
        some = some | (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) != "")
    out = df.where(some).withColumn("__x", F.explode_outer(details(f"`{detail_col}`")))
    keep = [F.coalesce("__x.model", F.lit("")).alias(c) if c == detail_col else F.col(f"`{c}`") for c in df.columns]
    return out.select(*keep, F.col("__x.cnt").alias(count_col))


def _below(rows: DataFrame, name: str, sheet: str | None, path: str | None) -> DataFrame:
    """The rows of each workbook's source sheet from its header down, with the header's row and column as __row and __col."""
    keys = [path] if path else []
    head = find_header(rows, name, sheet, path).select(*keys, F.col("sheet").alias("__sheet"), F.col("row_index").alias("__row"), F.col("col_index").alias("__col"))
    at = (rows.sheet == F.col("__sheet")) & (rows.row_index >= F.col("__row"))
    if not path:
        return rows.join(F.broadcast(head), at)  # one row
    head = head.withColumnRenamed(path, "__path")
    return rows.join(head, (rows[path] == F.col("__path")) & at).drop("__path")


FILLED = "exists(values, v -> coalesce(v, '') <> '')"


def split_sheet(rows: DataFrame, name: str = DETAIL, sheet: str | None = None, path: str | None = None) -> DataFrame:
    """(row_index, at, values, model, cnt): the rows below the header of the sheet that has a ``name`` column, split; with a ``path`` column, of each workbook by its own header, and path kept."""
    keys = [path] if path else []
    below = _below(rows, name, sheet, path).where((F.col("row_index") > F.col("__row")) & F.expr(FILLED))
    out = below.select(*keys, "row_index", "values", "__col", F.posexplode_outer(details(F.get("values", F.col("__col")))).alias("at", "x"))
    values = F.transform("values", lambda v, i: F.when(i == F.col("__col"), F.coalesce("x.model", F.lit(""))).otherwise(v))
    return out.select(*keys, "row_index", F.coalesce("at", F.lit(0)).alias("at"), values.alias("values"), F.coalesce("x.model", F.lit("")).alias("model"), F.col("x.cnt").alias("cnt"))


def split_books(lines: DataFrame, name: str = DETAIL, sheet: str | None = None, count: str = COUNT, header_width: bool = False) -> DataFrame:
    """The result sheet of every workbook as lines for sinks.books.save_books: ``source`` is the workbook, whose other parts are kept.

    lines: as sources.books.read_lines gives them. Each row of the source sheet gives a row for each pair of its detail,
    the detail replaced by the model, the count added; every cell keeps its style, the count takes the detail's, rows
    keep their height and columns their width. Rows blank in all columns go; a workbook without the column gives no
    line. Columns run to the sheet's last one, or with ``header_width`` to the header's last filled one. A sheet has at most 1,048,576 rows, which
    bounds the group that is numbered.
    """
    rows = lines.where("row_index > 0")
    below = _below(rows, name, sheet, "path")
    filled = F.array_max(F.transform("values", lambda v, i: F.when(F.coalesce(v, F.lit("")) != "", i + 1).otherwise(0)))
    if header_width:
        wide = below.where(F.col("row_index") == F.col("__row")).select("path", filled.alias("__n"))
    else:
        heads = find_header(rows, name, sheet, "path").select(F.col("path").alias("__path"), F.col("sheet").alias("__sheet"))
        wide = rows.join(heads, (rows.path == F.col("__path")) & (rows.sheet == F.col("__sheet"))).groupBy("path").agg(F.max(F.size("values")).alias("__n"))
    upto = lambda c, blank: F.transform(F.sequence(F.lit(0), F.col("__n") - 1), lambda i: F.coalesce(F.get(c, i), F.lit(blank)))
    cut = below.join(wide, "path").withColumns({"values": F.transform(F.sequence(F.lit(0), F.col("__n") - 1), lambda i: F.get("values", i)), "kinds": upto("kinds", "-"), "styles": upto("styles", 0)})
    is_head = F.col("row_index") == F.col("__row")
    cut = cut.where(is_head | F.expr(FILLED))
    item = F.struct(F.lit("").alias("model"), F.lit(None).cast("int").alias("cnt"))
    found = details(F.get("values", F.col("__col")))
    items = F.when(is_head, F.array(item)).when(F.size(found) > 0, found).otherwise(F.array(item))
    out = cut.withColumn("__head", is_head).select("*", F.posexplode(items).alias("__at", "__x"))
    number = F.row_number().over(W.partitionBy("path").orderBy("row_index", "__at"))
    here = lambda c, new: F.transform(c, lambda v, i: F.when((i == F.col("__col")) & ~F.col("__head"), new).otherwise(v))
    last = F.when(F.col("__head"), F.lit(count)).otherwise(F.col("__x.cnt").cast("string"))
    kind = F.when(F.col("__head"), "s").when(last.isNull(), "-").otherwise("n")
    body = out.select(
        "path", F.lit(1).alias("sheet_index"), F.lit(RESULT_SHEET).alias("sheet"), number.cast("int").alias("row_index"), F.when(~F.col("__head"), F.col("height")).alias("height"),
        F.concat(here("values", F.col("__x.model")), F.array(last)).alias("values"), F.concat(here("kinds", F.lit("s")), F.array(kind)).alias("kinds"),
        F.concat("styles", F.array(F.get("styles", F.col("__col")))).alias("styles"), F.lit(None).cast("array<double>").alias("widths"),
    )
    named = find_header(rows, name, sheet, "path").select("path", "sheet")
    widths = lines.where("row_index = 0").select("path", "sheet", F.col("widths").alias("__w")).join(named, ["path", "sheet"]).join(wide, "path")
    empty = lambda kind: F.array().cast(f"array<{kind}>")
    head = widths.select("path", F.lit(1).alias("sheet_index"), F.lit(RESULT_SHEET).alias("sheet"), F.lit(0).alias("row_index"), F.lit(None).cast("double").alias("height"), empty("string").alias("values"), empty("string").alias("kinds"), empty("int").alias("styles"), F.concat(F.transform(F.sequence(F.lit(0), F.col("__n") - 1), lambda i: F.get("__w", i)), F.array(F.lit(10.0))).alias("widths"))
    file = F.element_at(F.split("path", "/"), -1)
    output = F.concat(F.regexp_replace(file, r"\.[^.]*$", ""), F.lit(SPLIT_SUFFIX), F.regexp_extract(file, r"\.[^.]*$", 0))
    return head.union(body).select(output.alias("output"), F.col("path").alias("source"), "*", F.lit(True).alias("frozen"), F.lit(True).alias("filtered")).drop("path")


def next_filled(df: DataFrame, doc: str, order: str, value: str) -> DataFrame:
    """The rows of each group before its first blank ``value``, in order."""
    so_far = W.partitionBy(doc).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("__blank", F.max((F.coalesce(F.col(value).cast("string"), F.lit("")) == "").cast("int")).over(so_far)).where("__blank = 0").drop("__blank")
