"""Tables as array<array<string>>: cleaning, scoring, candidates and their deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Config
from ..functions.text import even_cells, normalize_cell, once

#: What counts as a letter or digit, superscripts and circled digits among them.
TEXTUAL = r"[\p{L}\p{Nd}²³¹⁰⁴-⁹₀-₉①-⑨⑴-⑼⒈-⒐]"
# The weights of the score, and that of an empty table.
WEIGHTS = {"fill": 35, "text": 20, "long": 8, "lines": 7, "stable": 15, "size": 3, "tiny": -20}
LONG, EMPTY = 25, -1e9
#: Among cells joined by U+001F, one without a letter or digit.
BARE = rf"(?:\A|\x1f)[^{TEXTUAL[1:-1]}\x1f]*+(?:\x1f|\z)"


def grids(cells: DataFrame) -> DataFrame:
    """(doc_id, engine, page, table_index, grid) from one row a cell; holes are null. One exchange on the table's key."""
    row = F.sort_array(F.collect_list(F.struct("row_index", "col_index", "value")))
    tables = cells.groupBy("doc_id", "engine", "page", "table_index").agg(row.alias("cells"), F.max("row_index").alias("last"), F.max("col_index").cast("long").alias("wide"))
    place = F.transform("cells", lambda c: F.struct((c["row_index"].cast("long") * (F.col("wide") + 1) + c["col_index"]).alias("at"), c["value"].alias("value")))
    tables = tables.withColumn("placed", F.map_from_entries(place))
    grid = F.transform(F.sequence(F.lit(0), F.col("last")), lambda r: F.transform(F.sequence(F.lit(0), F.col("wide")), lambda c: F.try_element_at("placed", r.cast("long") * (F.col("wide") + 1) + c)))
    return tables.select("doc_id", "engine", "page", "table_index", grid.alias("grid"))


def clean(df: DataFrame, config: Config = Config(), grid: str = "grid") -> DataFrame:
    """Normalizes every cell, pads ragged rows, drops empty rows, then empty columns; adds n_rows and n_cols."""
    wide = F.array_max(F.transform(grid, F.size))
    even = lambda row: F.when(F.size(row) == F.col("__wide"), row).otherwise(F.transform(F.sequence(F.lit(1), F.col("__wide")), lambda c: F.get(row, c - 1)))
    cells = F.transform(grid, lambda row: F.transform(even(row), lambda c: normalize_cell(c, config.flatten_newlines, config.fix_superscript)))
    out = df.withColumn("__wide", F.coalesce(wide, F.lit(0)))
    if not config.fix_superscript:
        # most tables are rectangles of cells that need nothing: they pass as they are
        square = F.forall(grid, lambda row: F.size(row) == F.col("__wide"))
        cells = F.when(square & even_cells(F.flatten(grid), config.flatten_newlines), F.col(grid)).otherwise(cells)
    out = out.withColumn(grid, once(F.when(F.col("__wide") > 0, cells).otherwise(F.array().cast("array<array<string>>"))))
    # a table without an empty cell loses no row and no column, one with a row without an empty cell no column
    out = out.withColumn("__full", once(~F.array_contains(F.flatten(grid), "")))
    out = out.withColumn(grid, once(F.when(F.col("__full"), F.col(grid)).otherwise(F.filter(grid, lambda row: F.array_join(row, "") != ""))))
    every = F.sequence(F.lit(0), F.greatest(F.col("__wide") - 1, F.lit(0)))
    even_top = F.col("__full") | F.coalesce(~F.array_contains(F.get(grid, F.lit(0)), ""), F.lit(False))
    out = out.withColumn("__kept", once(F.when(even_top, every).otherwise(F.filter(every, lambda c: F.exists(grid, lambda row: F.get(row, c) != "")))))
    narrower = F.transform(grid, lambda row: F.transform("__kept", lambda c: F.get(row, c)))
    out = out.withColumn(grid, once(F.when(F.size("__kept") == F.col("__wide"), F.col(grid)).otherwise(narrower)))
    return out.withColumns({"n_rows": F.size(grid), "n_cols": F.when(F.size(grid) > 0, F.size("__kept")).otherwise(0)}).drop("__wide", "__full", "__kept")


def score(df: DataFrame, grid: str = "grid") -> DataFrame:
    """Adds score and details to cleaned tables: filled, textual, long and many-line cells, evenness of rows, and size."""
    out = df.withColumns({"__flat": once(F.array_remove(F.flatten(grid), "")), "__all": (F.col("n_rows") * F.col("n_cols")).cast("double")})
    out = out.withColumn("__joined", once(F.array_join("__flat", "\x1f")))
    # one search over all cells tells most tables: only others are counted cell by cell
    full = F.size("__flat") == F.col("__all")
    out = out.withColumn("__rows", once(F.when(~full, F.transform(grid, lambda row: F.size(F.array_remove(row, ""))))))
    share = {
        "fill": F.size("__flat"),
        "text": F.when(F.col("__joined").rlike(BARE), F.size(F.filter("__flat", lambda c: c.rlike(TEXTUAL)))).otherwise(F.size("__flat")),
        "long": F.size(F.filter("__flat", lambda c: F.length(c) >= LONG)),
        "lines": F.when(F.col("__joined").contains("\n"), F.size(F.filter("__flat", lambda c: c.contains("\n")))).otherwise(0),
    }
    out = out.withColumns({f"__{k}": n / F.greatest("__all", F.lit(1.0)) for k, n in share.items()})
    mean = F.aggregate("__rows", F.lit(0.0), lambda s, n: s + n) / F.greatest("n_rows", F.lit(1))
    out = out.withColumn("__mean", mean)
    spread = F.sqrt(F.aggregate("__rows", F.lit(0.0), lambda s, n: s + (n - F.col("__mean")) * (n - F.col("__mean"))) / F.greatest("n_rows", F.lit(1)))
    out = out.withColumn("__stable", F.when(full, 1.0).otherwise(1 / (1 + spread)))
    tiny = F.when((F.col("n_rows") < 2) | (F.col("n_cols") < 2), 1.0).otherwise(0.0)
    total = sum((F.col(f"__{k}") * WEIGHTS[k] for k in ("fill", "text", "long", "lines", "stable")), F.lit(0.0)) + F.log1p("__all") * WEIGHTS["size"] + tiny * WEIGHTS["tiny"]
    empty = F.col("__all") == 0
    details = F.format_string("r=%d,c=%d,fill=%.2f,text=%.2f,multi=%.2f,stable=%.2f,score=%.2f", "n_rows", "n_cols", "__fill", "__text", "__lines", "__stable", "score")
    out = out.withColumn("score", once(F.when(empty, F.lit(EMPTY)).otherwise(total))).withColumn("details", F.when(empty, F.lit("empty")).otherwise(details))
    return out.drop("__flat", "__joined", "__rows", "__all", "__mean", "__stable", *(f"__{k}" for k in share))


def in_order() -> list[Column]:
    """The order of candidates within a document: place, then better score, then arrival."""
    return [F.col("page"), F.col("table_index"), F.col("score").desc(), F.col("arrival_seq")]


def engine_union(*engines: DataFrame) -> DataFrame:
    """A bag union that keeps, in arrival_seq, the order of the inputs and of their tables."""
    out = None
    for k, tables in enumerate(engines):
        place = F.row_number().over(W.partitionBy("doc_id").orderBy("page", "table_index", "engine")) + F.lit(k * (1 << 40)).cast("bigint")
        tables = tables.withColumn("arrival_seq", place.cast("bigint"))
        out = tables if out is None else out.unionByName(tables)
    return out


def deduplicate(candidates: DataFrame) -> DataFrame:
    """The best table of each shape on a page; the first of equals. A document's tables are looked at in the order of their shapes: tables meet by their document alone."""
    shape = F.struct("page", "n_rows", "n_cols")
    before = F.lag(shape).over(W.partitionBy("doc_id").orderBy("page", "n_rows", "n_cols", F.col("score").desc(), "arrival_seq"))
    return candidates.withColumn("__again", F.equal_null(shape, before)).where("not __again").drop("__again")


def select(tables: DataFrame, config: Config = Config()) -> DataFrame:
    """Tables (with arrival_seq) cleaned, scored, deduplicated, numbered by seq in the order of their document, and held to the least score.

    The numbering comes before the filter: a filter right on the score would be pushed below its computation and repeat it.
    Tables are shuffled once, by their document, and not at all where they come so: both the choice of the best of each
    shape and the numbering are windows over documents.
    """
    found = score(clean(tables, config))
    found = deduplicate(found) if config.dedup else found
    found = found.withColumn("seq", F.row_number().over(W.partitionBy("doc_id").orderBy(*in_order())))
    return found.where((F.col("score") >= config.min_score) & (F.col("n_rows") > 0) & (F.col("n_cols") > 0))


def best_tables(candidates: DataFrame, n: int = 5) -> DataFrame:
    """The n tables of highest score, for a message when none passes."""
    return candidates.orderBy(F.col("score").desc(), "doc_id", "page", "table_index").limit(n)
