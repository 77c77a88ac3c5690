"""Product models from page text and tables: four text rules and two table rules, the highest priority of a file wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import casefold, col, let, loose_text, strip

# Fixed values: (pattern, rule, priority) of the text rules.
TEXT_RULES = (
    (r"(?isU)本次申请型号\s*[:：]\s*(.+?)(?=\n\s*(?:差异说明|主检型号|覆盖型号|试验说明|本次检验)|\z)", "本次申请型号", 100),
    (r"(?isU)Model\s*/\s*Type\s+reference\s*[.\s]*:\s*(.+?)(?=\n\s*(?:Ratings?|Responsible\s+Testing|Tests?\s+performed|Summary\s+of)\b|\z)", "Model/Type reference", 90),
    (r"(?isU)(?:Identification|Bezeichnung)\s*/\s*(?:Type\s*no\.?|Typ-Nr\.?)\s*:\s*(.+?)(?=\n\s*(?:Order\s+content|Auftrags-Inhalt|Test\s+specification|Prüfgrundlage)\b|\z)", "Identification / Type no.", 85),
    (r"(?imdU)^\s*Models?\s*:\s*(.+?)\s*$", "Models文本行", 70),
)
KEY_RULE, LIST_RULE, TABLE_PRIORITY = "Models键值行", "Models列表表格", 80
# Words of a list's header; prefixes of a brand and of a role; where a rating begins; characters around a
# value and around a name; words of parts that are no names.
LIST_CONTEXT = ("brandname", "rating", "ratedcurrenta")
BRAND = r"(?iU)\bFor\s+([^,:;\n]+)\s+brand\s*:\s*"
ROLE_NAME = r"\d+\)\s*(?:Original|Co-license)\s+model\s*:\s*"
ROLE, LEADING_ROLE = rf"(?iU)(?:^|\s){ROLE_NAME}", rf"(?iU)^{ROLE_NAME}"
RATING = r"(?isU)\s+\d{2,3}(?:\s*[-–]\s*\d{2,3})?\s*V(?:ac)?(?:\s*[~～])?.*$"
VALUE_EDGES, NAME_EDGES = r"^[ \n,;:。]+|[ \n,;:。]+$", r"^[ .,:;，；。]+|[ .,:;，；。]+$"
NO_NAME, NAME_LENGTH = r"(?iU)\b(?:rating|refrigerant|clause)\b", 100
FOUND, NOT_FOUND, FAILED = "成功", "未识别", "失败"
MATCH = "array<struct<rule:string,priority:int,raw:string>>"


def clean_value(x: Column | str) -> Column:
    """Line-wrapped hyphens rejoined; brand and role prefixes dropped, with the brand before models too; cut at the first voltage rating, to the end."""
    text = F.regexp_replace(loose_text(x), r"(?U)-\s*\n\s*(?=[A-Za-z0-9])", "-")
    brands = F.transform(F.regexp_extract_all(text, F.lit(BRAND), F.lit(1)), strip)
    bare = F.regexp_replace(text, BRAND, "\n")
    bare = F.aggregate(brands, bare, lambda t, b: F.regexp_replace(t, F.concat(F.lit(r"(?imdU)(^|[,;\n]\s*)\Q"), b, F.lit(r"\E\s+(?=[A-Z0-9])")), F.lit("$1")))
    bare = F.regexp_replace(F.regexp_replace(bare, ROLE, "\n"), RATING, "")
    return F.regexp_replace(bare, VALUE_EDGES, "")


def split_models(x: Column | str) -> Column:
    """The distinct model names of a cleaned value: parts with a digit, of 100 characters at most, that do not speak of ratings, refrigerants or clauses."""
    parts = F.split(col(x), r"(?U)\s*[,;、]\s*|\n+")

    def tidy(part: Column) -> Column:
        part = F.regexp_replace(F.regexp_replace(part, "[ \t　]+", " "), NAME_EDGES, "")
        return strip(F.regexp_replace(F.regexp_replace(part, r"(?U)\s*-\s*", "-"), LEADING_ROLE, ""))

    fits = lambda m: m.rlike(r"(?U)\d") & (F.length(m) <= NAME_LENGTH) & ~m.rlike(NO_NAME)
    return F.array_distinct(F.filter(F.transform(parts, tidy), fits))


def text_matches(text: Column) -> Column:
    """array<struct<rule, priority, raw>> of the text rules, in their order."""
    found = [F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), _match(rule, priority)) for p, rule, priority in TEXT_RULES]
    return F.concat(*found).cast(MATCH)


def _match(rule: str, priority: int):  # noqa: ANN202
    return lambda raw: F.struct(F.lit(rule).alias("rule"), F.lit(priority).alias("priority"), raw.alias("raw"))


def table_matches(grid: Column) -> Column:
    """Of one table, row by row: the cells right of a key cell ``models``, and under a model column of a list header the values down to the first blank."""
    rows = F.transform(grid, lambda r: F.transform(r, lambda c: F.replace(loose_text(c), F.lit("\n"), F.lit(" "))))

    def of_rows(rows: Column) -> Column:
        keyed = F.transform(rows, lambda r, i: F.struct(i.alias("at"), r.alias("cells"), F.transform(r, lambda c: F.regexp_replace(F.lower(c), "[^a-z]", "")).alias("keys")))

        def of_row(r: Column) -> Column:
            places = F.filter(F.transform(r["keys"], lambda k, i: F.when(k == "models", i)), lambda i: i.isNotNull())
            rights = F.transform(places, lambda i: F.array_join(F.filter(F.slice(r["cells"], i + 2, F.greatest(F.size(r["cells"]), F.lit(1))), lambda c: c != ""), ", "))
            pairs = F.transform(F.filter(rights, lambda v: v != ""), _match(KEY_RULE, TABLE_PRIORITY))
            column = F.get(F.filter(F.transform(r["keys"], lambda k, i: F.when(k.isin("model", "models"), i)), lambda i: i.isNotNull()), F.lit(0))

            def under(column: Column) -> Column:
                below = F.transform(F.slice(rows, r["at"] + 2, F.greatest(F.size(rows), F.lit(1))), lambda cells: strip(F.coalesce(F.get(cells, column), F.lit(""))))
                return let(below, lambda b: let(F.array_position(b, "").cast("int"), lambda blank: F.when(blank > 0, F.slice(b, F.lit(1), blank - 1)).otherwise(b)))

            # only rows that are headers of a list look at what is below them
            headed = F.exists(r["keys"], lambda k: k.isin("model", "models")) & F.exists(r["keys"], lambda k: k.isin(*LIST_CONTEXT))
            listed = lambda values: F.when(F.size(values) > 0, F.array(_match(LIST_RULE, TABLE_PRIORITY)(F.array_join(values, "\n"))))
            return F.concat(pairs, F.coalesce(F.when(headed, let(let(column, under), listed)), F.slice(pairs, 1, 0)))

        return F.flatten(F.transform(keyed, of_row))

    return let(rows, of_rows).cast(MATCH)


def models(pages: DataFrame, tables: DataFrame | None = None, files: DataFrame | None = None, max_pages: int = 5) -> DataFrame:
    """file_name, path, page, model, rule, raw_value, status, note and source_text, with one row for a file without a model.

    pages: doc_id, file_name, path, page, text; tables: doc_id, page, table_index, grid; files: doc_id, file_name, path and an error for files that could
    not be read. Within a file the matches of highest priority count, and of names that are equal without regard to case (ß as ss) the first.
    """
    first = pages.where(F.col("page") <= max_pages)
    found = first.select("doc_id", "page", F.lit(0).alias("table_index"), F.posexplode(text_matches(loose_text("text"))).alias("at", "m"))
    if tables is not None:
        rows = tables.where(F.col("page") <= max_pages)
        found = found.unionByName(rows.select("doc_id", "page", F.col("table_index").cast("int").alias("table_index"), F.posexplode(table_matches(F.col("grid"))).alias("at", "m")))
    found = found.withColumn("raw_value", clean_value("m.raw"))
    found = found.withColumn("models", split_models("raw_value")).where(F.size("models") > 0)
    doc = W.partitionBy("doc_id")
    best = found.withColumn("__top", F.max("m.priority").over(doc)).where("m.priority = __top")
    order = F.struct("page", "table_index", "at", "k")
    named = best.select("doc_id", "page", "table_index", "at", F.col("m.rule").alias("rule"), "raw_value", F.col("m.raw").alias("source_text"), F.posexplode("models").alias("k", "model"))
    named = named.withColumn("__rank", F.row_number().over(W.partitionBy("doc_id", casefold("model")).orderBy(order))).where("__rank = 1")
    named = named.select("doc_id", "page", "model", "rule", "raw_value", "source_text", order.alias("ord"))
    known = pages.select("doc_id", "file_name", "path").distinct().withColumn("error", F.lit(None).cast("string"))
    if files is not None:
        known = files.select("doc_id", "file_name", "path", "error")
    note = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("model").isNull(), F.lit(f"前{max_pages}页未找到型号")).otherwise("")
    status = F.when(F.col("error").isNotNull(), FAILED).when(F.col("model").isNull(), NOT_FOUND).otherwise(FOUND)
    out = known.join(named, "doc_id", "left")
    return out.select("doc_id", "file_name", "path", "page", "model", "rule", "raw_value", status.alias("status"), note.alias("note"), "source_text", "ord")
