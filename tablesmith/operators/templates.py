"""Known report layouts: which family a document belongs to, and what each family's tables yield."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import join_distinct, once, technical_units
from ..scratch import written
from .headers import all_of, any_of, hinted_header
from .records import as_record

# The families, in the order of testing, and their short names.
PRODUCT, FOUR, FIVE, EXTENDED, SIX = "dekra_multi_page_6", "cvc_components_4", "korea_ktl_5", "taiwan_pmc_extended", "taiwan_etc_6"
ALIASES = {"cvc_components": FOUR, "korea_ktl": FIVE, "taiwan_etc": SIX, "taiwan_pmc": EXTENDED, "dekra_product_info": PRODUCT}
# Header texts of the families.
PRODUCT_TEXT = "productinformationformodel"
FOUR_TEXT = "tablecomponentsonlyusedinthesamples"
SIX_HINTS = (("objectpartno",), ("manufacturertrademark",), ("typemodel",), ("technicaldata",), ("standard",), ("marksofconformity",))
FOUR_HINTS = SIX_HINTS[:4]
EXTENDED_HINTS = (("零組件材料名稱",), ("製造商",), ("商標",), ("型號零組件",), ("技術規格電氣規格",), ("驗證標準",), ("驗證標誌及號碼",), ("ci證書號碼",))
FIVE_HEADER = ("componentpartno", "manufacturerbrand", "ratingorcharacteristics", "부품명회로기호")
HEADER_ROWS = 5


def header_text(compacts: Column) -> Column:
    """The compact cells of the first five rows."""
    return F.array_join(F.flatten(F.slice(compacts, 1, HEADER_ROWS)), "|")


def family_of(text: Column) -> Column:
    """The family that one table's header names; the product family is found over all headers of a document instead."""
    return (
        F.when(all_of(text, (FOUR_TEXT, "objectpartno", "manufacturertrademark", "typemodel", "technicaldata")), FOUR)
        .when(any_of(text, ("componentpartno", "componentspartno")) & all_of(text, ("manufacturerbrand", "modeltype")) & any_of(text, ("testedby", "approvedby")), FIVE)
        .when(all_of(text, ("ci證書號碼", "適用型號", "新申請", "驗證標誌及號碼")), EXTENDED)
        .when(all_of(text, ("objectpartno", "manufacturertrademark", "marksofconformity", "項次", "零組件", "取得標誌")), SIX)
    )


def families(candidates: DataFrame) -> DataFrame:
    """(doc_id, family): the product family if the document's headers together say so, else that of the first table that names one."""
    narrow = candidates.select("doc_id", "seq", once(header_text(F.col("compacts"))).alias("header"))
    together = F.lit(True)
    for hint in (PRODUCT_TEXT, "objectpartno", "manufacturertrademark", "marksofconformity"):
        together = together & F.bool_or(F.col("header").contains(hint))
    own = narrow.withColumn("__own", once(family_of(F.col("header"))))
    return own.groupBy("doc_id").agg(F.when(together, PRODUCT).otherwise(F.min_by("__own", F.when(F.col("__own").isNotNull(), F.col("seq")))).alias("family"))


def rows_under(tables: DataFrame, hints: tuple, header: Column) -> DataFrame:
    """One row for each table row from the header on: v, the hinted cells in order."""
    found = tables.withColumn("__h", header).where("__h is not null")
    out = found.select("*", F.posexplode(F.slice("grid", F.col("__h.start_row") + 1, F.greatest(F.size("grid"), F.lit(1)))).alias("__i", "__cells"))
    value = F.transform("__h.mapping", lambda c: F.when(c >= 0, F.coalesce(F.get(F.col("__cells"), c), F.lit(""))).otherwise(F.lit("")))
    return out.withColumns({"row": (F.col("__i") + F.col("__h.start_row")).cast("int"), "v": value}).drop("__h", "__i", "__cells")


def filled_down(rows: DataFrame) -> DataFrame:
    """name: the object cell, or the last one before it in the document."""
    order = W.partitionBy("doc_id").orderBy("seq", "row").rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("name", F.coalesce(F.last(F.nullif(F.col("v")[0], F.lit("")), ignorenulls=True).over(order), F.lit("")))


def listed(rows: DataFrame, fields: list[Column], model: Column | None = None) -> DataFrame:
    """Rows as tables of one record, phase 0, kept where the object and any other field is there."""
    f = F.array(*fields)
    kept = rows.withColumn("f", f).where((F.col("f")[0] != "") & F.exists(F.slice("f", 2, 5), lambda c: c != ""))
    record = as_record(F.col("row"), F.lit("detail"), F.lit(""), F.col("f"), F.lit("") if model is None else model)
    return kept.select("doc_id", F.lit(0).alias("phase"), "seq", "page", "table_index", "engine", F.array(record).alias("records"), F.col("row").alias("__row")).drop("__row")


def product_family(tables: DataFrame) -> DataFrame:
    """Headed tables, and a lone six-column table on the page right after a page that had some; the product model last named on a page before or on it is kept with every record."""
    doc = W.partitionBy("doc_id")
    cells = tables.withColumn("own", hinted_header(F.col("compacts"), SIX_HINTS))
    # the cell under the first ``model`` of the first rows; later tables of a page come after earlier ones
    heads = F.transform(F.slice("compacts", 1, F.least(F.size("compacts"), F.lit(6)) - 1), lambda r, i: F.struct(i.alias("row"), F.array_position(r, "model").cast("int").alias("at")))
    named = F.get(F.filter(F.when(F.col("header").contains(PRODUCT_TEXT) & (F.size("grid") > 1), heads), lambda h: h["at"] > 0), F.lit(0))
    cells = cells.withColumn("__named", named)
    cells = cells.withColumn("__model", F.nullif(F.get(F.get("grid", F.col("__named.row") + 1), F.col("__named.at") - 1), F.lit("")))
    # what a page says is told by windows over its tables, what pages before it say by windows over those of lesser number: tables of a
    # document stay together and meet no others
    page, order = W.partitionBy("doc_id", "page"), doc.orderBy("page")
    so_far, before = order.rangeBetween(W.unboundedPreceding, 0), order.rangeBetween(W.unboundedPreceding, -1)
    cells = cells.withColumns({"headed": F.bool_or(F.col("own").isNotNull()).over(page), "__tables": F.count("*").over(page), "__wide": F.max("n_cols").over(page), "__said": F.max_by("__model", F.when(F.col("__model").isNotNull(), F.col("seq"))).over(page)})
    cells = cells.withColumns({"__before": F.max("page").over(before), "__product": F.coalesce(F.last("__said", ignorenulls=True).over(so_far), F.lit(""))})
    carries = F.coalesce(~F.col("headed") & (F.col("__tables") == 1) & (F.col("__wide") == len(SIX_HINTS)) & (F.col("__before") == F.col("page") - 1), F.lit(False))
    # a page that carries is a target where the last page that does not is one
    found = cells.withColumn("__target", F.last(F.when(~carries, F.col("headed")), ignorenulls=True).over(so_far)).where("__target")
    plain = F.struct(F.lit(0).alias("start_row"), F.sequence(F.lit(0), F.lit(len(SIX_HINTS) - 1)).alias("mapping"))
    rows = rows_under(found, SIX_HINTS, F.when(F.col("headed"), F.col("own")).otherwise(plain))
    v = F.col("v")
    return listed(rows.where(~F.startswith(F.lower(v[0]), F.lit("remark"))), [v[0], v[1], v[2], technical_units(v[3]), v[4], v[5]], F.col("__product"))


def six_family(tables: DataFrame) -> DataFrame:
    rows = filled_down(rows_under(tables, SIX_HINTS, hinted_header(F.col("compacts"), SIX_HINTS)))
    v = F.col("v")
    return listed(rows, [F.col("name"), v[1], v[2], technical_units(v[3]), v[4], v[5]])


def four_family(tables: DataFrame) -> DataFrame:
    rows = rows_under(tables.where((F.col("n_cols") == 4) & F.col("header").contains(FOUR_TEXT)), FOUR_HINTS, hinted_header(F.col("compacts"), FOUR_HINTS))
    v = F.col("v")
    return listed(rows, [v[0], v[1], v[2], technical_units(v[3]), F.lit(""), F.lit("")])


def extended_family(tables: DataFrame) -> DataFrame:
    rows = filled_down(rows_under(tables, EXTENDED_HINTS, hinted_header(F.col("compacts"), EXTENDED_HINTS)))
    v = F.col("v")
    return listed(rows, [F.col("name"), join_distinct(v[1], v[2]), v[3], technical_units(v[4]), v[5], join_distinct(v[6], v[7])])


def five_family(tables: DataFrame) -> DataFrame:
    """Five-column tables read as one over their document: sparse rows without an object, and sparse first rows of a new page, continue the record before; the object fills down.

    Whether a sparse first row continues depends on the page of the last record made. Such a row never changes that page: it is a
    rest, or a record of the same page. So the page, like the object that fills down, is the last of a running window over
    rows that are records whatever the others are, and no value holds a document; a record is folded with its own rests
    only. Rests before the first record of a document are dropped.
    """
    some = tables.where("n_cols = 5").select("doc_id", "seq", "page", "table_index", "engine", F.posexplode(F.arrays_zip(F.col("grid").alias("v"), F.col("compacts").alias("c"))).alias("row", "x"))
    some = some.where(~any_of(F.array_join("x.c", "|"), FIVE_HEADER))
    v = F.transform("x.v", lambda cell, k: F.when(k == 3, technical_units(cell)).otherwise(cell))
    some = some.select("doc_id", "seq", "row", "page", "table_index", "engine", v.alias("v"), F.col("x.c").alias("c"), F.size(F.filter("x.v", lambda cell: cell != "")).alias("n"))
    order = W.partitionBy("doc_id").orderBy("seq", "row")
    before, so_far = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(W.unboundedPreceding, 0)
    yes = lambda c: F.coalesce(F.max(c.cast("int")).over(before) == 1, F.lit(False))
    named, body, sparse = F.get("v", F.lit(0)) != "", F.exists(F.slice("v", 2, 4), lambda cell: cell != ""), F.col("n") <= 2
    first = named & sparse & (F.col("row") == 0)
    rows = some.withColumns({"named": named, "body": body, "sparse": sparse, "first": first}).withColumn("some", yes(F.col("named") & F.col("body")))
    sure = F.col("named") & F.col("body") & ~F.col("first") | ~F.col("named") & ~F.col("sparse") & F.col("some") | F.col("first") & F.col("body") & ~F.col("some")
    rows = rows.withColumn("sure", sure).withColumn("last", F.last(F.when(F.col("sure"), F.col("page")), True).over(before))
    rest = F.col("some") & (~F.col("named") & F.col("sparse") | F.col("first") & (F.col("page") != F.col("last")))
    rows = rows.withColumn("rest", F.coalesce(rest, F.lit(False))).withColumn("made", ~F.col("rest") & (F.col("sure") | F.col("first") & F.col("body")))
    rows = rows.withColumn("filled", F.last(F.when(F.col("made") & F.col("named"), F.struct(F.get("v", F.lit(0)).alias("v"), F.get("c", F.lit(0)).alias("c"))), True).over(so_far))
    rows = rows.withColumn("number", F.sum(F.col("made").cast("int")).over(so_far)).where("made or rest")
    own = lambda n: F.transform(n, lambda cell, k: F.when(F.col("made") & (k == 0), F.coalesce(F.col(f"filled.{n}"), F.lit(""))).otherwise(cell)).alias(n)
    record = F.struct("seq", "row", "page", "table_index", "engine", own("v"), own("c"))
    chains = rows.groupBy("doc_id", "number").agg(F.sort_array(F.collect_list(record)).alias("rows"))

    def longer(last: Column, r: Column) -> Column:
        def more(p: Column, k: Column) -> Column:
            gap = F.when(p["old"] == "", "").when(k == 4, "；").otherwise(" ")
            skip = (p["new"] == "") | (p["old"] != "") & p["known"].contains(p["c"])
            return F.struct(F.when(skip, p["old"]).otherwise(F.concat(p["old"], gap, p["new"])).alias("v"), F.when(skip, p["known"]).otherwise(F.concat(p["known"], p["c"])).alias("c"))

        pairs = F.transform(F.arrays_zip(last["v"].alias("old"), last["c"].alias("known"), r["v"].alias("new"), r["c"].alias("c")), more)
        return F.struct(F.transform(pairs, lambda p: p["v"]).alias("v"), F.transform(pairs, lambda p: p["c"]).alias("c"))

    head = F.col("rows")[0]
    whole = F.aggregate(F.slice("rows", 2, F.size("rows")), F.struct(head["v"].alias("v"), head["c"].alias("c")), longer, lambda s: s["v"])
    x = F.col("x")
    record = as_record(F.col("row"), F.lit("detail"), F.lit(""), F.array(x[0], x[1], x[2], x[3], F.lit(""), x[4]), F.lit(""))
    out = chains.select("doc_id", *(head[n].alias(n) for n in ("seq", "row", "page", "table_index", "engine")), once(whole).alias("x"))
    return out.select("doc_id", F.lit(0).alias("phase"), "seq", "page", "table_index", "engine", F.array(record).alias("records"))


FAMILIES = {PRODUCT: product_family, FOUR: four_family, FIVE: five_family, EXTENDED: extended_family, SIX: six_family}


def template_records(candidates: DataFrame, template: str = "auto") -> DataFrame:
    """Records of the known families, phase -1 for a requested template and 0 for the detected family.

    A template is honoured where the document's family is unknown or the same; where it yields nothing the detected
    family is read. Families are told from header texts alone, and written as one row a document; tables are read for those that
    occur, and met by their document, which is how the families' windows want them.
    """
    narrow = written(families(candidates), "families")
    present = {r[0] for r in narrow.select("family").distinct().collect()}  # six values at most
    known = candidates.join(narrow, "doc_id").withColumn("header", header_text(F.col("compacts")))
    asked = (template or "auto").strip().lower()
    wanted = ALIASES.get(asked, asked)
    parts = [read(known.where(F.col("family") == name)) for name, read in FAMILIES.items() if name in present]
    if wanted in FAMILIES and None in present:
        parts.append(FAMILIES[wanted](known.where(F.col("family").isNull())).withColumn("phase", F.lit(-1)))
    if not parts:
        return six_family(known.limit(0))
    return reduce(DataFrame.unionByName, parts)
