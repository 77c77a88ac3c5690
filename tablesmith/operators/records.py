"""From a table and a mapping to records, as column expressions: the rows of one table stay in one value, so nothing shuffles.

A record is struct<row, row_type, section_title, product_model, f>, f holding the six target fields in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import MARKS, STANDARDS, key_is, let, match_key, normalize_cell, once, strip, technical_units
from ..schemas import TARGET_FIELDS
from .headers import six_window, six_window_flat

# What a row that is a section title looks like.
SECTION = r"(?U)^[A-Za-z][A-Za-z0-9 /+\-.,&()]+:\s*$"
SECTION_MODEL = r"(?iU)\bW(?:19|27)-[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*\b"
ALTERNATIVE = "alternative"
COMPONENTS, COMPRESSOR = "components_information", "list_of_compressor"


def filled(values: Column) -> Column:
    return F.size(F.filter(values, lambda v: v != ""))


def as_record(row: Column, row_type: Column, title: Column, f: Column, model: Column | None = None) -> Column:
    model = F.lit(None).cast("string") if model is None else model
    return F.struct(row.cast("int").alias("row"), row_type.cast("string").alias("row_type"), title.cast("string").alias("section_title"), model.alias("product_model"), f.alias("f"))


def visible(c: Column) -> Column:
    """Whether a cell begins with a visible ASCII character."""
    return (c >= "!") & (c < "\x7f")


def section_title(row: Column) -> Column:
    """The only non-empty cell of a row when it reads like a title, else null."""
    some = F.filter(F.transform(row, strip), lambda c: c != "")
    # with two cells that begin with a visible ASCII character a row is no title: in most rows the first two do
    full = F.filter(row, visible)
    two = F.coalesce(visible(F.get(row, F.lit(0))) & visible(F.get(row, F.lit(1))), F.lit(False))

    def titled(title: Column) -> Column:
        def fits(key: Column) -> Column:
            header = key.contains("object") & key.contains("part") & (key.contains("no") | key.contains("number"))
            return (key != "") & ~key.isin(ALTERNATIVE, "componentsinformation") & ~header & (title.rlike(SECTION) | title.rlike(SECTION_MODEL))

        return F.when(let(match_key(title), fits), title)

    return F.when(~two & (F.size(full) < 2), let(some, lambda cells: F.when(F.size(cells) == 1, let(F.get(cells, F.lit(0)), titled))))


def valid(f: Column) -> Column:
    """Four fields at least, and a standard, a mark or technical data."""
    return (filled(f) >= 4) & _telling(f)


def _telling(f: Column) -> Column:
    return (F.get(f, F.lit(3)) != "") | F.get(f, F.lit(4)).rlike(STANDARDS) | F.get(f, F.lit(5)).rlike(MARKS)


def noise(f: Column) -> Column:
    """Remarks, the table's own title, repeated headers and their stray second lines."""
    at = lambda k: F.lower(strip(F.get(f, F.lit(k))))
    first = F.get(f, F.lit(0))

    def test(name: Column) -> Column:
        rest = (at(1) == "") & (at(2) == "") & (at(3) == "") & (at(4) == "")
        return (
            F.startswith(name, F.lit("remark"))
            | name.contains("table:") & name.contains("components information")
            | name.contains("object") & name.contains("part") & (name.contains("no") | name.contains("number"))
            | key_is(name, "no", "number") & (match_key(at(5)).contains("conformity") | rest)
        )

    return let(F.lower(F.when(visible(first), first).otherwise(strip(first))), test)


def projected(grid: Column, mapping: Column, start_row: Column, strict: bool) -> Column:
    """The records of a table from start_row on: titles as section rows; with ``strict`` all but noise, else valid ones only."""
    rows = F.transform(F.slice(grid, start_row + 1, F.greatest(F.size(grid), F.lit(1))), lambda r, i: F.struct((i + start_row).alias("row"), r.alias("cells"), section_title(r).alias("title")))

    def record(r: Column) -> Column:
        fields = F.transform(mapping, lambda c, k: F.when(k == 3, technical_units(_cell(r["cells"], c))).otherwise(_cell(r["cells"], c)))
        titled = F.transform(mapping, lambda c, k: F.when(k == 0, r["title"]).otherwise(F.lit("")))
        section = r["title"].isNotNull()
        return as_record(r["row"], F.when(section, "section").otherwise("detail"), F.coalesce(r["title"], F.lit("")), F.when(section, titled).otherwise(fields))

    keep = (lambda x: (x["row_type"] == "section") | ~noise(x["f"])) if strict else (lambda x: (x["row_type"] == "section") | valid(x["f"]))
    return F.filter(F.transform(rows, record), keep)


def _cell(cells: Column, at: Column) -> Column:
    return F.when(at >= 0, F.coalesce(F.get(cells, at), F.lit(""))).otherwise(F.lit(""))


def wrapped(f: Column) -> Column:
    """Fields of a row that is the rest of the record above: no object, or ``alternative`` with one other value at most."""
    name = F.get(f, F.lit(0))
    return ~visible(name) & (strip(name) == "") | key_is(name, ALTERNATIVE) & (filled(F.slice(f, 2, 5)) <= 1)


def chained(rows: DataFrame, key: str, record: str = "r") -> DataFrame:
    """Rows of one record each gathered into (key, chain, rows): a record with the rests that follow it, so that ``merged`` folds over them alone and a key with many records is never one value.

    Records are in the order of their fields, row first. Rests before the first record of a key are a chain of their own.
    """
    order = W.partitionBy(key).orderBy(record).rowsBetween(W.unboundedPreceding, 0)
    chain = F.sum(F.when(wrapped(F.col(f"{record}.f")), 0).otherwise(1)).over(order)
    return rows.withColumn("chain", chain).groupBy(key, "chain").agg(F.sort_array(F.collect_list(record)).alias("rows"))


def merged(records: Column, kind: Column) -> Column:
    """Wrapped rows joined to the record above, then records with an object and some technical data, standard or mark (for compressors: an object that says so). Section rows always stay.

    A row without an object, or an ``alternative`` with one other value at most, is such a rest. A value is appended on
    a line of its own unless it is contained already.
    """

    def joined(last: Column, r: Column) -> Column:
        mark = key_is(F.get(r["f"], F.lit(0)), ALTERNATIVE)
        name = F.get(last["f"], F.lit(0))
        named = F.when(mark & ~F.lower(name).contains(ALTERNATIVE), strip(F.concat(name, F.lit("\n"), F.get(r["f"], F.lit(0))))).otherwise(name)
        more = lambda old, new: F.when((new == "") | (old != "") & old.contains(new), old).when(old == "", new).otherwise(strip(F.concat(old, F.lit("\n"), new)))
        f = F.transform(F.zip_with(last["f"], r["f"], lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda p, k: F.when(k == 0, named).otherwise(more(p["a"], p["b"])))
        return F.struct(last["row"].alias("row"), last["row_type"].alias("row_type"), last["section_title"].alias("section_title"), last["product_model"].alias("product_model"), f.alias("f"))

    def step(done: Column, r: Column) -> Column:
        return F.when((F.size(done) > 0) & wrapped(r["f"]), F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(joined(F.element_at(done, -1), r)))).otherwise(F.concat(done, F.array(r)))

    # most tables have no such rows: theirs pass as they are
    folded = lambda all_: F.when(F.exists(all_, lambda r: wrapped(r["f"])), F.aggregate(all_, F.slice(all_, 1, 0), step)).otherwise(all_)
    at = lambda r, k: F.get(r["f"], F.lit(k))
    detail = lambda r: (at(r, 0) != "") & ((kind != COMPRESSOR) | F.lower(at(r, 0)).contains("compressor")) & ((at(r, 3) != "") | (at(r, 4) != "") | (at(r, 5) != ""))
    return F.filter(let(records, folded), lambda r: (r["row_type"] == "section") | detail(r))


def strict_records(grid: Column, header: Column, kind: Column) -> Column:
    """What a table yields under a header (start_row, mapping) in the strict phases."""
    return F.when(header.isNotNull(), merged(projected(grid, header["mapping"], header["start_row"], True), kind))


def table_points(score: Column, records: Column, n_cols: Column) -> Column:
    """A table's score with its records: 15 for each, 8 for each with an object, up to 12 for being six columns wide."""
    objects = F.size(F.filter(records, lambda r: F.get(r["f"], F.lit(0)) != ""))
    return score + 15 * F.size(records) + 8 * objects + F.greatest(F.lit(0), 12 - 4 * F.abs(n_cols - 6))


def window_records(grid: Column) -> Column:
    """Valid records from the best six neighbouring cells of each row."""
    # a valid record has four fields: a row with fewer filled cells gives none
    rows = F.transform(grid, lambda r, i: F.struct(i.alias("row"), r.alias("cells"), F.when(F.size(F.array_remove(r, "")) >= 4, six_window(r)).alias("at")))
    cut = lambda r: F.transform(F.slice(r["cells"], r["at"] + 1, 6), lambda c, k: F.when(k == 3, technical_units(normalize_cell(c))).otherwise(c))
    found = F.transform(F.filter(rows, lambda r: r["at"].isNotNull()), lambda r: as_record(r["row"], F.lit(None), F.lit(None), cut(r)))
    return F.filter(found, lambda r: valid(r["f"]))


def window_rows(tables: DataFrame, *keys: str) -> DataFrame:
    """``window_records`` as rows (keys, row, f): a table's rows stand alone, so all is generated code and no table is searched by interpreted functions."""
    rows = tables.select(*keys, F.posexplode("grid").alias("row", "cells")).where(F.size(F.array_remove("cells", "")) >= 4)
    rows = rows.withColumn("__at", once(six_window_flat(F.col("cells")))).where("__at is not null")
    cell = lambda k: F.get("cells", F.col("__at") + k)
    rows = rows.withColumn("__data", once(normalize_cell(cell(3)))).withColumn("f", once(F.array(*(technical_units("__data") if k == 3 else cell(k) for k in range(6)))))
    n = sum((F.when(F.get("f", F.lit(k)) != "", 1).otherwise(0) for k in range(6)), F.lit(0))
    return rows.where((n >= 4) & _telling(F.col("f"))).select(*keys, "row", "f")


def exploded(tables: DataFrame, records: str = "records") -> DataFrame:
    """One row a record with the target columns, doc_id and phase, seq and ord kept for ordering."""
    out = tables.withColumn("__r", once(records)).select("doc_id", "phase", "seq", "page", "table_index", "engine", F.posexplode("__r").alias("at", "r"))
    fields = [F.get("r.f", F.lit(k)).alias(name) for k, name in enumerate(TARGET_FIELDS)]
    return out.select(
        "doc_id", "phase", F.struct("seq", "at").alias("ord"), "page", F.col("table_index").alias("table_index_on_page"), F.col("r.row").alias("row_index_on_table"), "engine", "r.row_type", "r.section_title", "r.product_model", *fields
    )


def deduplicate(records: DataFrame) -> DataFrame:
    """Within a document and phase: section rows by place and title, others by product model and fields without regard to case; the first in place order stays."""
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    section = F.coalesce(F.col("row_type") == "section", F.lit(False))
    place = F.concat_ws(":", "page", "table_index_on_page", "row_index_on_table")
    key = F.when(section, F.array(F.lit("section"), place, low("section_title"))).otherwise(F.array(low("product_model"), *(low(c) for c in TARGET_FIELDS)))
    rank = F.row_number().over(W.partitionBy("doc_id", "phase", "__key").orderBy("page", "table_index_on_page", "row_index_on_table", "ord"))
    return records.withColumn("__key", key).withColumn("__rank", rank).where("__rank = 1").drop("__key", "__rank")
