"""Finding a table's header: which column holds which field. A mapping is an array of six columns in the order of TARGET_FIELDS, -1 for none."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import MARKS, STANDARDS, compact_any, compact_grid, compact_stable, let, match_key, once, stable_grid
from ..scratch import written

# Header hints by field, in order.
LOOSE = (
    ("objectpart", "objectpartno", "partno", "partnumber", "object", "alternative"),
    ("manufacturer", "manufacture", "trademark"),
    ("typemodel", "type", "model"),
    ("technicaldata", "technical"),
    ("standard", "standards"),
    ("marksofconformity", "marksof", "conformity", "mark"),
)
STRICT = (
    ("objectpart", "objectpartno"),
    ("manufacturer", "trademark"),
    ("typemodel", "type", "model"),
    ("technicaldata", "technical"),
    ("standard",),
    ("marksofconformity", "marksof", "conformity"),
)
# Texts that mark a table's kind, in the order of testing.
KINDS = (
    ("components_information", ("tablecomponentsinformation", "tablecriticalcomponentsinformation", "componentsinformation", "criticalcomponentsinformation")),
    ("list_of_compressor", ("tablelistofcompressor", "listofcompressor", "compressorlist")),
)
#: Letters of all markers, and of what an ordered and a strict header must name.
MARKER_LETTERS, HEADER_LETTERS = "ocmp", "jb"
LOOSE_ROWS, STRICT_ROWS, ORDERED_ROWS = 6, 10, 12
LEAST_LOOSE, LEAST_STRICT, WIDEST = 4, 5, 9
FOUND = "struct<start_row:int,mapping:array<int>>"


def any_of(text: Column, hints: Sequence[str]) -> Column:
    out = F.lit(False)
    for hint in hints:
        if not any(other in hint for other in hints if other != hint):  # a longer hint says nothing that a part of it does not
            out = out | text.contains(hint)
    return out


def all_of(text: Column, hints: Sequence[str]) -> Column:
    out = F.lit(True)
    for hint in hints:
        out = out & text.contains(hint)
    return out


def greedy(norms: Column, hints: Sequence[Sequence[str]]) -> Column:
    """From left to right each column takes the first field that is still free and has a hint in its text."""

    def step(taken: Column, cell: Column) -> Column:
        field = F.lit(None).cast("int")
        for k in reversed(range(len(hints))):
            field = F.when((taken[k] == -1) & any_of(cell["norm"], hints[k]), k).otherwise(field)
        return let(field, lambda at: F.when(at.isNull(), taken).otherwise(F.transform(taken, lambda c, k: F.when(k == at, cell["at"]).otherwise(c))))

    cells = F.transform(norms, lambda n, i: F.struct(n.alias("norm"), i.alias("at")))
    return F.aggregate(cells, F.array_repeat(F.lit(-1), len(hints)), step)


def taken(mapping: Column) -> Column:
    """How many fields have a column."""
    return F.size(F.filter(mapping, lambda c: c >= 0))


def columns_text(norms: Column, rows: int) -> Column:
    """The cells of the first rows joined down each column: what a row, alone or joined with the next, says in a cell stands here in one piece, so a table whose text lacks a hint is not searched."""
    some = F.slice(norms, 1, rows)
    wide = F.coalesce(F.array_max(F.transform(some, F.size)), F.lit(0))
    down = lambda all_: F.transform(F.sequence(F.lit(0), F.greatest(wide - 1, F.lit(0))), lambda c: F.array_join(F.transform(all_, lambda r: F.get(r, c)), ""))
    return F.array_join(let(some, down), "|")


def places(norms: Column, rows: int) -> Column:
    """What a header is searched in, in order: 2i is the i-th of the first rows, 2i + 1 that row joined with the next cell by cell."""
    n = F.least(F.size(norms), F.lit(rows))
    return F.when(n > 0, F.sequence(F.lit(0), 2 * n - 2)).otherwise(F.array().cast("array<int>"))


def cells_at(norms: Column, place: Column) -> Column:
    row = F.get(norms, F.shiftright(place, 1))
    return F.when(place % 2 == 0, row).otherwise(F.zip_with(row, F.get(norms, F.shiftright(place, 1) + 1), lambda a, b: F.concat(a, b)))


def start_at(place: Column) -> Column:
    """Where data would begin."""
    return (F.shiftright(place, 1) + 1 + place % 2).cast("int")


def tries(norms: Column, rows: int, fits: Callable[[Column], Column]) -> Column:
    """array<struct<order, start_row, norms>>: each place whose joined text fits."""
    some = F.filter(places(norms, rows), lambda o: let(F.array_join(cells_at(norms, o), "|"), fits))
    return F.transform(some, lambda o: F.struct(o.alias("order"), start_at(o).alias("start_row"), cells_at(norms, o).alias("norms")))


def first_try(norms: Column, rows: int, fits: Callable[[Column], Column], mapped: Callable[[Column], Column], whole: Callable[[Column], Column]) -> Column:
    """The header at the first place whose joined text fits and whose mapping is whole; later ones are not looked at."""

    def search(cells: Column, o: Column) -> Column:
        found = lambda m: F.when(whole(m), F.struct(start_at(o).alias("start_row"), m.alias("mapping")))
        return F.when(let(F.array_join(cells, "|"), fits), let(mapped(cells), found))

    return F.aggregate(places(norms, rows), F.lit(None).cast(FOUND), lambda found, o: F.when(found.isNotNull(), found).otherwise(let(cells_at(norms, o), lambda cells: search(cells, o))))


def loose_header(norms: Column) -> Column:
    """The row, of the first six, with most fields; at least four. The first of equals."""
    # four fields of six: one of the last three is there
    fits = lambda text: any_of(text, ("technical", "standard", "mark", "conformity"))
    some = F.filter(F.transform(F.slice(norms, 1, LOOSE_ROWS), lambda r, i: F.struct(r.alias("norms"), i.alias("at"))), lambda r: let(F.array_join(r["norms"], "|"), fits))
    rows = F.transform(some, lambda r: F.struct(greedy(r["norms"], LOOSE).alias("mapping"), r["at"].alias("at")))
    best = F.array_max(F.transform(rows, lambda r: F.struct(taken(r["mapping"]).alias("n"), (-r["at"]).alias("back"), r["mapping"].alias("mapping"))))
    found = let(best, lambda b: F.when(b["n"] >= LEAST_LOOSE, F.struct((1 - b["back"]).cast("int").alias("start_row"), b["mapping"].alias("mapping"))))
    return F.when(let(columns_text(norms, LOOSE_ROWS), fits), found)


def strict_header(norms: Column) -> Column:
    """As the loose one with stricter hints, over rows alone and joined with the next; five fields at least, the object among them."""
    # five fields of six: the technical data or the standard is there; a table that nowhere has the object gives nothing
    fits = lambda text: any_of(text, ("technical", "standard"))
    rows = F.transform(tries(norms, STRICT_ROWS, fits), lambda t: F.struct(greedy(t["norms"], STRICT).alias("mapping"), t["order"].alias("order"), t["start_row"].alias("start_row")))
    best = F.array_max(F.transform(rows, lambda r: F.struct(taken(r["mapping"]).alias("n"), (-r["order"]).alias("back"), r["start_row"].alias("start_row"), r["mapping"].alias("mapping"))))
    found = let(best, lambda b: F.when((b["n"] >= LEAST_STRICT) & (b["mapping"][0] >= 0), F.struct(b["start_row"].cast("int").alias("start_row"), b["mapping"].alias("mapping"))))
    return F.when(let(columns_text(norms, STRICT_ROWS), lambda text: fits(text) & text.contains("objectpart")), found)


def field_tests(norm: Column) -> list[Column]:
    """Whether a header cell's text names each field outright."""
    has = norm.contains
    return [
        has("object") & has("part") & (has("no") | has("number")),
        (has("manufacturer") | has("manufacture")) & has("trademark"),
        has("type") & has("model"),
        has("technical") & has("data"),
        has("standard"),
        has("mark") & has("conform"),
    ]


def ordered_header(norms: Column) -> Column:
    """The first row, alone or joined with the next, of the first twelve that names all six fields in their order, at most nine columns apart."""

    def step(found: Column, cell: Column) -> Column:
        fits = F.lit(False)
        for k, test in enumerate(field_tests(cell["norm"])):
            fits = F.when(F.size(found) == k, test).otherwise(fits)
        return F.when(fits, F.concat(found, F.array(cell["at"]))).otherwise(found)

    def mapped(row: Column) -> Column:
        cells = F.transform(row, lambda n, i: F.struct(n.alias("norm"), i.alias("at")))
        return F.aggregate(cells, F.array().cast("array<int>"), step)

    fits = lambda text: all_of(text, ("object", "manufactur", "standard", "conform"))
    whole = lambda m: (F.size(m) == 6) & (F.get(m, F.lit(5)) - F.get(m, F.lit(0)) <= WIDEST)
    return F.when(let(columns_text(norms, ORDERED_ROWS), fits), first_try(norms, ORDERED_ROWS, fits, mapped, whole))


def hinted_header(compacts: Column, hints: Sequence[Sequence[str]]) -> Column:
    """The first of the first six rows, alone or joined with the next, in which every hinted field has a column."""
    every = lambda text: all_of(text, [h[0] for h in hints if len(h) == 1])
    found = first_try(compacts, LOOSE_ROWS, every, lambda cells: greedy(cells, hints), lambda m: taken(m) == len(hints))
    return F.when(let(columns_text(compacts, LOOSE_ROWS), every), found)


def kind_of(text: Column) -> Column:
    """The marked kind that a table's whole normalized text names."""
    out = F.lit(None).cast("string")
    for kind, patterns in reversed(KINDS):
        out = F.when(any_of(text, patterns), kind).otherwise(out)
    return out


def without_empty_columns(mapping: Column, kept: Column, n_cols: Column) -> Column:
    """The mapping over the kept columns only; null when a mapped column is not kept."""
    used = F.filter(mapping, lambda c: c >= 0)
    moved = F.transform(mapping, lambda c: F.when(c >= 0, F.array_position(kept, c).cast("int") - 1).otherwise(-1))
    return F.when((n_cols > 1) & F.forall(used, lambda c: F.array_contains(kept, c)), F.when(F.size(kept) == n_cols, mapping).otherwise(moved))


def kept_columns(grid: Column, start_row: Column, sample: int = 12) -> Column:
    """The columns with some text in the ``sample`` rows from start_row (from the top when there is none)."""
    rows = F.when(start_row < F.size(grid), F.slice(grid, start_row + 1, sample)).otherwise(F.slice(grid, 1, sample))
    return F.filter(F.sequence(F.lit(0), F.size(F.get(grid, F.lit(0))) - 1), lambda c: F.exists(rows, lambda r: F.get(r, c) != ""))


def _window_points(row: Column, start: Column, base: Column) -> Column:
    """What the six cells from start say, added to the points of how many are filled: 10 at most."""
    cell: Callable[[int], Column] = lambda k: F.get(row, start + k)
    return (
        base
        + F.when(cell(0).rlike("(?iu)(alternative|varistor|object|part)"), 2).otherwise(0)
        + F.when(cell(3).contains(":") | cell(3).contains("\n"), 1).otherwise(0)
        + F.when(cell(4).rlike(STANDARDS), 3).otherwise(0)
        + F.when(cell(5).rlike(MARKS), 4).otherwise(0)
    )


def six_window(row: Column) -> Column:
    """Where the best six neighbouring cells of a row begin, null if none reaches 6 points; the first of equals."""
    # a row without an empty cell has six filled ones everywhere
    full = F.coalesce(~F.array_contains(row, ""), F.lit(False))

    def filled(start: Column) -> Column:
        return F.when(full, 12).otherwise(let(F.size(F.filter(F.slice(row, start + 1, 6), lambda c: c != "")), lambda n: 2 * n - F.when(n < 4, 6).otherwise(0)))

    def step(best: Column, start: Column) -> Column:
        # what cells say adds 10 at most: places that cannot win are not read
        better = lambda p: F.when(p > best["points"], F.named_struct(F.lit("points"), p, F.lit("at"), start)).otherwise(best)
        return let(filled(start), lambda base: F.when(base + 10 > best["points"], let(_window_points(row, start, base), better)).otherwise(best))

    none = F.struct(F.lit(5).alias("points"), F.lit(None).cast("int").alias("at"))
    return F.when(F.size(row) >= 6, F.aggregate(F.sequence(F.lit(0), F.size(row) - 6), none, step, lambda b: b["at"]))


def six_window_flat(row: Column, places: int = 8) -> Column:
    """``six_window`` of a row that is a column of its own, in generated code: the first ``places`` starts are compared one by one, a wider row is folded."""
    full = F.coalesce(~F.array_contains(row, ""), F.lit(False))

    def points(s: int) -> Column:
        n = sum((F.when(F.get(row, F.lit(s + k)) != "", 1).otherwise(0) for k in range(6)), F.lit(0))
        return _window_points(row, F.lit(s), F.when(full, 12).otherwise(2 * n - F.when(n < 4, 6).otherwise(0)))

    # points and start in one number: of equal points the first start is the greatest
    best = F.greatest(*(F.when(F.size(row) >= s + 6, points(s) * 65536 - s) for s in range(places)))
    near = F.when(best > 5 * 65536, F.negative(best).bitwiseAND(F.lit(65535)).cast("int"))
    return F.when(F.size(row) > places + 5, six_window(row)).otherwise(near)


def describe(candidates: DataFrame, templates: bool = True, searched: bool = True, broad: bool = True) -> DataFrame:
    """Adds kind, has_marker, loose, ordered and best (ordered, else strict) headers to candidates, and with ``templates`` their compact cells: each is computed once and read by all phases. Templates alone read compact cells only: without ``searched`` nothing else is computed. Only the ``broad`` phase reads loose headers."""
    if not searched:
        return candidates.withColumn("compacts", compact_grid("grid"))
    out = candidates.withColumn("__text", once(F.array_join(F.flatten("grid"), " ")))
    out = out.withColumn("__low", once(F.lower("__text")))
    # most tables lack some letter that every marker or, however it is cut between rows, every header has
    marked, headed = (all_of(F.col("__low"), letters) for letters in (MARKER_LETTERS, HEADER_LETTERS))
    norms = F.transform(F.slice("grid", 1, ORDERED_ROWS), lambda r: F.transform(r, match_key))
    out = out.withColumns({"__headed": once(headed), "__key": once(F.when(marked, match_key("__low")))})
    out = out.withColumn("norms", once(norms if broad else F.when(F.col("__headed"), norms)))
    out = out.withColumn("ordered", once(F.when(F.col("__headed"), ordered_header(F.col("norms")))))
    if broad:
        out = out.withColumn("loose", once(loose_header(F.col("norms"))))
    # the strict search counts only where the ordered one finds nothing
    out = out.withColumn("strict", once(F.when(F.col("__headed") & F.col("ordered").isNull(), strict_header(F.col("norms")))))
    out = out.withColumn("has_marker", F.col("__low").contains("table") & F.col("__text").rlike(r"(?iU)\btable\s*:"))
    out = out.withColumns({"kind": kind_of(F.col("__key")), "best": F.coalesce("ordered", "strict")}).drop("__text", "__low", "__key", "__headed", "norms", "strict")
    return out.withColumn("compacts", compact_grid("grid")) if templates else out


def written_candidates(candidates: DataFrame, searched: bool = True) -> DataFrame:
    """Described candidates with their compact cells, written. Tables that need Unicode normalization are written apart, so that no other passes by a Python worker."""
    found = describe(candidates, templates=False) if searched else candidates
    found = found.withColumn("__stable", once(F.coalesce(stable_grid("grid"), F.lit(True))))
    found = written(found.withColumn("compacts", F.when(F.col("__stable"), compact_stable("grid"))), "candidates")
    other = found.where("not __stable")
    if other.isEmpty():
        return found.drop("__stable")
    other = written(other.withColumn("compacts", compact_any("grid")), "candidates")
    return found.where("__stable").unionByName(other).drop("__stable")
