"""Key-value blocks: a row that says ``alternative`` opens a block of labelled rows, which becomes one record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import let, marks, normalize_cell, standards, strip, technical_units
from .records import as_record, valid

# Labels that give each field, in order of preference, and rows to pass over.
MAKER = ("manufacturer", "material manufacturer", "manufacture", "trademark")
MODEL = ("designation", "model", "material designation", "type", "type/model")
TECHNICAL = ("technical data", "rating", "thickness(mm)", "thickness", "dimensions(mm)", "dimensions", "mounting", "refrigerant", "flammability rating", "insulation system", "details")
PASSED = ("page no", "master contract")
PAIRS = "array<struct<k:string,v:string>>"


def attributes(rows: Column) -> Column:
    """array<struct<k, v>> in order of first appearance: labelled rows set or extend their key, others extend the last one; without any, the first row is ``details``."""

    def put(pairs: Column, key: Column, value: Column) -> Column:
        there = F.exists(pairs, lambda p: p["k"] == key)
        longer = F.transform(pairs, lambda p: F.struct(p["k"].alias("k"), F.when(p["k"] == key, strip(F.concat_ws("\n", F.when(p["v"] != "", p["v"]), value))).otherwise(p["v"]).alias("v")))
        return F.when(there, longer).otherwise(F.concat(pairs, F.array(F.struct(key.alias("k"), strip(value).alias("v")))))

    def step(s: Column, row: Column) -> Column:
        cells, at = row["cells"], row["at"]
        first = F.coalesce(F.get(cells, F.lit(0)), F.lit(""))
        whole = strip(F.array_join(F.filter(cells, lambda c: c != ""), " "))
        rest = strip(F.array_join(F.filter(F.slice(cells, 2, F.greatest(F.size(cells), F.lit(1))), lambda c: c != ""), " "))
        # what stands before and behind the first colon
        said = let(F.split(normalize_cell(first), ":", 2), lambda p: F.struct(F.lower(strip(p[0])).alias("key"), strip(F.concat_ws(" ", strip(F.coalesce(F.get(p, F.lit(1)), F.lit(""))), rest)).alias("value")))

        def put_in(x: Column) -> Column:
            key, value, whole = x["said"]["key"], x["said"]["value"], x["whole"]
            passed = (whole == "") | key.contains(PASSED[0]) | key.contains(PASSED[1])
            labelled = (first.contains(":") | F.endswith(key, F.lit(")"))) & (key != "")
            pairs = (
                F.when(passed, s["pairs"])
                .when(labelled & (value != ""), put(s["pairs"], key, value))
                .when(labelled, s["pairs"])
                .when(s["last"] != "", put(s["pairs"], s["last"], whole))
                .when(at == 1, put(s["pairs"], F.lit("details"), whole))
                .otherwise(s["pairs"])
            )
            return F.struct(pairs.alias("pairs"), F.when(~passed & labelled, key).otherwise(s["last"]).alias("last"))

        return let(F.struct(said.alias("said"), whole.alias("whole")), put_in)

    start = F.struct(F.array().cast(PAIRS).alias("pairs"), F.lit("").alias("last"))
    return F.aggregate(rows, start, step, lambda s: s["pairs"])


def picked(pairs: Column, keys: tuple[str, ...]) -> Column:
    """The value of the first key, in their order, that has one."""
    value = lambda k: F.get(F.filter(pairs, lambda p: (p["k"] == k) & (p["v"] != "")), F.lit(0))["v"]
    return F.coalesce(*(value(k) for k in keys), F.lit(""))


def block_records(grid: Column) -> Column:
    """The valid records of a table's blocks; tables of one column have none."""

    def record(b: Column, texts: Column) -> Column:
        inside = F.transform(F.slice(grid, b["start"] + 2, F.greatest(b["end"] - b["start"] - 1, F.lit(0))), lambda r, i: F.struct(r.alias("cells"), (i + 1).alias("at")))
        return F.struct(b["start"].alias("start"), F.get(texts, b["start"]).alias("title"), attributes(inside).alias("pairs"))

    def shaped(b: Column) -> Column:
        pairs = b["pairs"]
        bit = lambda k: let(picked(pairs, (k,)), lambda v: F.when(v != "", F.concat(F.lit(f"{k}: "), v)))
        bits = [bit(k) for k in TECHNICAL]
        text = F.array_join(F.concat(F.array(b["title"]), F.transform(pairs, lambda p: F.concat(p["k"], F.lit(": "), p["v"]))), "\n")
        f = lambda text: F.array(b["title"], picked(pairs, MAKER), picked(pairs, MODEL), technical_units(strip(F.concat_ws("\n", *bits))), standards(text), marks(text))
        return as_record(b["start"], F.lit(None), F.lit(None), let(text, f))

    def blocks(texts: Column) -> Column:
        starts = F.filter(F.transform(texts, lambda t, i: F.when(t.rlike(r"(?iU)\balternative\b"), i)), lambda i: i.isNotNull())
        ends = let(starts, lambda all_: F.transform(all_, lambda s, i: F.struct(s.alias("start"), F.coalesce(F.get(all_, i + 1), F.size(grid)).alias("end"))))
        found = F.filter(F.transform(ends, lambda b: record(b, texts)), lambda b: F.size(b["pairs"]) > 0)
        return F.filter(F.transform(found, shaped), lambda r: valid(r["f"]))

    texts = F.transform(grid, lambda r: strip(F.array_join(F.filter(r, lambda c: c != ""), " | ")))
    found = let(texts, blocks)
    return F.when(F.size(F.get(grid, F.lit(0))) >= 2, found).otherwise(F.slice(found, 1, 0))
