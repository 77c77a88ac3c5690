"""Queries over workbooks: written from the given tables by one write, read back as lines, and compared with SQL over those tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..operators import grid, payload, split
from ..scratch import new_path
from ..sinks import books as out
from ..sinks import sheets
from ..sources import files
from ..sources.books import FORMAT_FIELDS, read_lines
from .queries import SCORED, order_tables, query, table


def folder(spark: SparkSession, name: str) -> str:
    return new_path(spark, name)


def _file(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _part_of(at: int) -> Column:
    return F.get(F.col("values"), F.lit(at))


def part_books(spark: SparkSession, sf_dir: str, to: str) -> DataFrame:
    """A workbook for each brand, written to the folder ``to`` and read: a cover sheet, the parts with a detail column, an old result sheet and a later sheet with that column too.

    The header stands in row 1 to 5, in column 1 to 4, as the brand's number says. Formats differ by brand; rows alternate two of them.
    """
    part = table(spark, sf_dir, "part")
    brand = F.regexp_extract("p_brand", "[0-9]+", 0).cast("int")
    top, at = (brand % 5 + 1), (brand % 4)
    looks = F.array(*(F.struct(F.lit("General" if k != 1 else "0.000").alias("number_format"), F.concat(F.lit('<font><sz val="'), (brand % 7 + 8 + k).cast("string"), F.lit('"/><name val="Calibri"/></font>')).alias("font"), F.lit(sheets.LOOKS[0][2]).alias("fill"), F.lit("<border/>").alias("border"), F.lit('<alignment wrapText="1"/>' if k == 2 else "").alias("alignment"), F.lit("").alias("protection")) for k in range(3)))
    detail = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("QX"), F.col("p_size").cast("string"), F.lit("-A 三台, QY-"), F.col("p_partkey").cast("string"), F.lit("样机 12 台"))).when(F.col("p_size") % 3 == 1, F.concat(F.lit("QZ-"), F.col("p_partkey").cast("string"))).when(F.col("p_size") % 6 == 2, F.col("p_name")).otherwise("")
    base = part.select("p_brand", F.concat("p_brand", F.lit(".xlsx")).alias("output"), brand.alias("brand"), top.alias("top"), at.alias("at"), looks.alias("looks"), "p_partkey", "p_size", detail.alias("detail"))
    brands = base.groupBy("output", "p_brand", "brand", "top", "at").agg(F.first("looks").alias("looks"))
    none = F.array().cast("array<string>")

    def lines(df: DataFrame, index: int, sheet: str, row: Column | int, values: Column, style: Column | int = 0, **more: Column) -> DataFrame:
        row = F.lit(row) if isinstance(row, int) else row
        columns = {"height": F.lit(None).cast("double"), "widths": F.lit(None).cast("array<double>"), "formats": F.lit(None).cast(f"array<{sheets.FORMAT}>")} | more
        style = F.lit(style) if isinstance(style, int) else style
        return df.select("output", F.lit(index).alias("sheet_index"), F.lit(sheet).alias("sheet"), row.cast("int").alias("row_index"), values.alias("values"), F.transform(values, lambda v: F.when(v.rlike("^[0-9]+$"), "n").when(v == "", "-").otherwise("s")).alias("kinds"), F.transform(values, lambda v: style).alias("styles"), *(c.alias(k) for k, c in columns.items()))

    placed = lambda last: F.transform(F.sequence(F.lit(0), F.lit(4)), lambda c: F.when(c == F.col("at"), last).when(c == 4, F.col("p_partkey").cast("string")).otherwise(""))
    heads = brands.withColumn("p_partkey", F.lit("no"))
    widths = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda c: (c + F.col("brand")).cast("double"))
    rows = [
        lines(brands, 1, "cover", 0, none, formats=F.col("looks")), lines(brands, 1, "cover", 1, F.array(F.concat(F.lit("cover of "), "p_brand"), F.lit("7"))),
        lines(brands, 2, split.RESULT_SHEET, 0, none), lines(brands, 2, split.RESULT_SHEET, 1, F.array(F.lit(split.DETAIL))),
        lines(brands, 3, "data", 0, none, widths=widths), lines(heads, 3, "data", F.col("top"), placed(F.lit(f" {split.DETAIL} ")), 2),
        lines(base, 3, "data", F.col("p_partkey") + 10, placed(F.col("detail")), (F.col("p_partkey") % 2).cast("int"), height=F.when(F.col("p_partkey") % 2 == 0, 20.0 + F.col("brand"))),
        lines(brands, 4, "later", 0, none), lines(heads, 4, "later", 1, placed(F.lit(split.DETAIL))),
    ]
    made = rows[0]
    for r in rows[1:]:
        made = made.unionByName(r)
    out.save_books(made, to)
    return read_lines(spark, to)


def split_again(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(lines of the part workbooks, lines of their split copies)."""
    to, done = folder(spark, "parts"), folder(spark, "split")
    lines = part_books(spark, sf_dir, to)
    out.save_books(split.split_books(lines), done)
    return lines, read_lines(spark, done)


_BRAND = "CAST(regexp_extract(p_brand, '[0-9]+') AS INTEGER)"
_ITEMS = "CASE WHEN p_size % 3 = 0 THEN ['QX' || p_size || '-A|3', 'QY-' || p_partkey || '|12'] WHEN p_size % 3 = 1 THEN ['QZ-' || p_partkey || '|'] WHEN p_size % 6 = 2 THEN [p_name || '|'] ELSE ['|'] END"
_SPLIT = f"(SELECT p_brand, {_BRAND} AS brand, p_partkey, unnest({_ITEMS}) AS item, generate_subscripts({_ITEMS}, 1) AS nth FROM part)"


@query(f"SELECT p_brand || '{split.SPLIT_SUFFIX}.xlsx' AS file, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey, nth) + 1 AS INTEGER) AS row_index, p_partkey, string_split(item, '|')[1] AS model, string_split(item, '|')[2] AS cnt, CASE WHEN p_partkey % 2 = 0 THEN 20.0 + brand END AS height FROM {_SPLIT}")
def split_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the new sheet of every split copy: the detail's place differs by workbook, so each has its own header."""
    _, done = split_again(spark, sf_dir)
    rows = done.where((F.col("sheet") == split.RESULT_SHEET) & (F.col("row_index") > 1)).withColumn("brand", F.regexp_extract("path", "([0-9]+)[^/]*$", 1).cast("int"))
    cell = F.coalesce(F.get("values", F.col("brand") % 4), F.lit(""))
    return rows.select(_file(F.col("path")).alias("file"), "row_index", _part_of(4).cast("bigint").alias("p_partkey"), cell.alias("model"), F.coalesce(_part_of(5), F.lit("")).alias("cnt"), "height")


@query(f"SELECT p_brand || '{split.SPLIT_SUFFIX}.xlsx' AS file, unnest(['{split.RESULT_SHEET}', 'cover', 'data', 'later']) AS sheet, unnest([1, 2, 3, 4]) AS sheet_index, CAST(unnest([n + 1, 1, parts + 1, 1]) AS BIGINT) AS rows, CAST(unnest([0, 1, 1, 1]) AS INTEGER) AS same FROM (SELECT p_brand, count(*) AS n, count(DISTINCT p_partkey) AS parts FROM {_SPLIT} GROUP BY p_brand)")
def split_books_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sheet of the split copies in order, its rows, and whether all its lines equal the original's: the old result sheet went, all others passed untouched."""
    lines, done = split_again(spark, sf_dir)
    whole = F.xxhash64("sheet", "row_index", "height", "values", "kinds", "styles", "widths")
    digest = lambda df, name: df.groupBy(F.regexp_extract("path", "([0-9]+)[^/]*$", 1).alias("brand"), "sheet").agg(F.count_if(F.col("row_index") > 0).alias("rows"), F.sum(whole.cast("decimal(38,0)")).alias(name), F.max("sheet_index").alias("sheet_index"), F.max(_file(F.col("path"))).alias("file"))
    before = digest(lines, "before").select("brand", "sheet", "before")
    return digest(done, "after").join(before, ["brand", "sheet"], "left").select("file", "sheet", "sheet_index", "rows", F.coalesce((F.col("before") == F.col("after")).cast("int"), F.lit(0)).alias("same"))


_LOOK = "'<font><sz val=\"' || CAST(brand % 7 + 8 + {k} AS VARCHAR) || '\"/><name val=\"Calibri\"/></font>|' || CASE WHEN {k} = 1 THEN '0.000' ELSE 'General' END || '|' || CASE WHEN {k} = 2 THEN '<alignment wrapText=\"1\"/>' ELSE '' END"


@query(f"SELECT CAST(brand % 2 AS VARCHAR) || '.xlsx' AS file, p_partkey, nth, {_LOOK.format(k='(p_partkey % 2)')} AS looks FROM {_SPLIT}")
def split_styles_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split rows of all workbooks in two new ones, formats of all their sources in one table: each row's cells look as its source row does."""
    lines, done = split_again(spark, sf_dir)
    name = F.concat((F.regexp_extract("path", "([0-9]+)[^/]*$", 1).cast("int") % 2).cast("string"), F.lit(".xlsx"))
    number = F.regexp_extract("path", "([0-9]+)[^/]*$", 1).cast("int")
    # the formats of a copy stand on line 0 of its first sheet, which is the new one
    rows = done.where((F.col("sheet") == split.RESULT_SHEET) & (F.col("row_index") != 1)).select("path", name.alias("output"), number.alias("sheet_index"), number.cast("string").alias("sheet"), "row_index", "height", "values", "kinds", "styles", "widths", "formats")
    to = folder(spark, "merged")
    out.save_books(out.with_formats(rows), to)
    read = read_lines(spark, to)
    formats = read.where("formats is not null").select("path", F.col("formats").alias("every"))
    found = read.where("row_index > 0").join(formats, "path")
    look = F.get("every", F.get("styles", F.col("sheet").cast("int") % 4))
    said = F.concat_ws("|", look["font"], look["number_format"], look["alignment"])
    nth = F.row_number().over(sheets.W.partitionBy("path", "sheet", _part_of(4)).orderBy("row_index"))
    return found.select(_file(F.col("path")).alias("file"), _part_of(4).cast("bigint").alias("p_partkey"), nth.cast("bigint").alias("nth"), said.alias("looks"))


def _table_books(spark: SparkSession, sf_dir: str, **wanted: object) -> DataFrame:
    """All order tables as sheets of 50 workbooks, and the lines of those that are ``wanted``."""
    tables = order_tables(spark, sf_dir).withColumn("doc_id", (F.col("arrival_seq") % 50).cast("string"))
    found = grid.select(tables.withColumn("table_index", F.col("arrival_seq").cast("int")), Config(min_score=-100.0, dedup=False))
    to = folder(spark, "tables")
    out.save_books(sheets.table_books(found, F.concat(F.lit("d"), F.col("doc_id"), F.lit(".xlsx"))), to)
    return read_lines(spark, to, **wanted)


_CELLS = "list_filter(['Part ' || l_partkey, 'Supplier ' || l_suppkey, l_returnflag || '-' || l_linenumber, CASE WHEN wide = 1 THEN CASE WHEN l_linenumber % 3 <> 0 THEN CAST(l_quantity AS INTEGER) || ' mm2' ELSE '' END END, 'CE' || chr(10) || l_linestatus], lambda v: v IS NOT NULL)"
_NUMBERED = f"(SELECT l_orderkey % 50 AS doc, l_orderkey, wide, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) + 1 AS r, {_CELLS} AS cells, dense_rank() OVER (PARTITION BY l_orderkey % 50 ORDER BY l_orderkey) AS k FROM lineitem JOIN (SELECT l_orderkey AS o, max(CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE 1 END) AS wide FROM lineitem GROUP BY 1) ON o = l_orderkey)"


@query(f"SELECT 'd' || doc || '.xlsx' AS file, left('T' || k || '_pdfplumber_lines_p' || (l_orderkey % 50 + 1), 31) AS sheet, CAST(k AS INTEGER) AS sheet_index, CAST(r AS INTEGER) AS row_index, array_to_string(cells, '|') AS cells, 30.0 AS height FROM {_NUMBERED}")
def book_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of every table, with its height, in the sheet that its document's order gives it."""
    rows = _table_books(spark, sf_dir, without=[sheets.SUMMARY_SHEET]).where((F.col("sheet") != sheets.SUMMARY_SHEET) & (F.col("row_index") > 1))
    return rows.select(_file(F.col("path")).alias("file"), "sheet", "sheet_index", "row_index", F.array_join("values", "|").alias("cells"), "height")


@query(f"SELECT 'd' || doc || '.xlsx' AS file, CAST(k AS INTEGER) AS sheet_index, array_to_string(list_transform(range(1, len(longest) + 1), lambda i: least(60, greatest(12, greatest(longest[i], length('col_' || i)) + 2))), ',') AS widths FROM (SELECT doc, k, [max(length(cells[1])), max(length(cells[2])), max(length(cells[3]))] || CASE WHEN any_value(wide) = 1 THEN [max(length(cells[4]))] ELSE [] END || [2] AS longest FROM {_NUMBERED} GROUP BY doc, k)")
def book_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Widths of every sheet's columns as they stand in the file."""
    rows = _table_books(spark, sf_dir, without=[sheets.SUMMARY_SHEET], last_row=0).where((F.col("sheet") != sheets.SUMMARY_SHEET) & (F.col("row_index") == 0))
    return rows.select(_file(F.col("path")).alias("file"), "sheet_index", F.array_join(F.transform("widths", lambda w: w.cast("int").cast("string")), ",").alias("widths"))


@query(f"SELECT 'd' || (l_orderkey % 50) || '.xlsx' AS file, CAST(1 + count(*) OVER (PARTITION BY l_orderkey % 50) AS INTEGER) AS sheet_index, CAST(row_number() OVER (PARTITION BY l_orderkey % 50 ORDER BY l_orderkey) + 1 AS INTEGER) AS row_index, left('T' || row_number() OVER (PARTITION BY l_orderkey % 50 ORDER BY l_orderkey) || '_pdfplumber_lines_p' || (l_orderkey % 50 + 1), 31) AS sheet, CAST(n AS VARCHAR) AS rows, CAST(cols AS VARCHAR) AS cols, 'ssnnnnns' AS kinds FROM (SELECT l_orderkey, n, 4 + wide AS cols FROM {SCORED.replace('4 + wide AS cols, filled,', 'wide, filled,')})")
def book_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary sheet of every workbook, the last of its sheets: one row a table, numbers as numbers."""
    rows = _table_books(spark, sf_dir, sheets=[sheets.SUMMARY_SHEET]).where((F.col("sheet") == sheets.SUMMARY_SHEET) & (F.col("row_index") > 1))
    return rows.select(_file(F.col("path")).alias("file"), "sheet_index", "row_index", _part_of(0).alias("sheet"), _part_of(4).alias("rows"), _part_of(5).alias("cols"), F.array_join("kinds", "").alias("kinds"))


@query("SELECT 'models.xlsx' AS file, CAST(row_number() OVER (ORDER BY p_partkey) + 1 AS INTEGER) AS row_index, CAST(p_partkey AS VARCHAR) AS path, p_name AS model, p_brand AS status, CAST(NULL AS DOUBLE) AS height, '38,72,8,28,28,72,14,14' AS widths FROM part")
def model_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of models as one workbook, in the look of that list; rows beyond what a sheet holds are counted on in its next sheets."""
    part = table(spark, sf_dir, "part")
    rows = part.select(F.lit("f").alias("文件名"), F.col("p_partkey").alias("文件路径"), F.col("p_size").alias("页码"), F.col("p_name").alias("型号"), F.lit("r").alias("匹配规则"), F.lit(None).cast("string").alias("原始内容"), F.col("p_brand").alias("状态"), F.lit("").alias("说明"))
    to = folder(spark, "models")
    out.save_books(sheets.record_books(rows, F.lit("models.xlsx"), [F.col("文件路径")], sheets.MODELS_SHEET, sheets.MODEL_WIDTHS, listing=True), to)
    read = read_lines(spark, to)
    widths = read.where("row_index = 0").select("path", "sheet_index", F.array_join(F.transform("widths", lambda w: w.cast("int").cast("string")), ",").alias("w"))
    number = (F.col("row_index") + (F.col("sheet_index") - 1) * (sheets.SHEET_LIMIT - 1)).cast("int")
    return read.where("row_index > 1").join(widths, ["path", "sheet_index"]).select(_file(F.col("path")).alias("file"), number.alias("row_index"), _part_of(1).alias("path"), _part_of(3).alias("model"), _part_of(6).alias("status"), "height", F.col("w").alias("widths"))


@query("SELECT n_regionkey || '.xlsx' AS output, unnest(['planned', 'written', 'skipped']) AS action, count(*) + 1 AS rows FROM nation GROUP BY n_regionkey UNION ALL SELECT '9.xlsx', 'written', 2 FROM region WHERE r_regionkey = 0")
def outputs_reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What three writes report: a dry run, the write itself, and one more that skips what exists and adds a workbook."""
    to, said = folder(spark, "reported"), folder(spark, "report")
    nation = table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", "n_name")
    book = lambda df: sheets.record_books(df.select("n_nationkey", "n_name"), F.concat(F.col("n_regionkey").cast("string"), F.lit(".xlsx")), [F.col("n_nationkey")])
    more = nation.union(table(spark, sf_dir, "region").where("r_regionkey = 0").select(F.lit(9), F.lit(0), "r_name"))
    book = lambda df: sheets.record_books(df, F.concat(F.col("n_regionkey").cast("string"), F.lit(".xlsx")), [F.col("n_nationkey")])
    out.save_books(book(nation), to, dry_run=True, report=said)
    out.save_books(book(nation), to, report=said)
    out.save_books(book(more), to, existing="skip", report=said)
    found = spark.read.json(said)
    lines = read_lines(spark, to).where("row_index > 0").groupBy(_file(F.col("path")).alias("output")).agg(F.count("*").alias("there"))
    return found.join(lines, "output").select("output", "action", F.col("there").alias("rows"))


@query("SELECT p_partkey || '.png' AS file, p_name AS content, CAST(octet_length(encode(p_name)) AS BIGINT) AS length FROM part WHERE p_size % 2 = 0")
def images_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of response bodies written as files by one write and read again; bodies without one write none."""
    good = F.concat(F.lit('{"data":[{"b64_json":"'), F.base64(F.col("p_name").cast("binary")), F.lit('"}]}'))
    bodies = table(spark, sf_dir, "part").select(F.concat(F.lit("img/"), F.col("p_partkey").cast("string"), F.lit(".png")).alias("output"), payload.image_bytes(F.when(F.col("p_size") % 2 == 0, good).otherwise("{}")).alias("content"))
    to = folder(spark, "images")
    out.save_bytes(bodies.where("content is not null"), to)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(to)
    return found.select(_file(F.col("path")).alias("file"), F.col("content").cast("string").alias("content"), "length")


@query("SELECT p_brand || '.xlsx' AS file, dense_rank() OVER (ORDER BY p_brand || '.xlsx') AS place FROM part GROUP BY p_brand")
def files_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workbooks of a folder in the order of their paths."""
    to = folder(spark, "listed")
    part_books(spark, sf_dir, to)
    found = files.list_files(spark, to, "*.[xX][lL][sS][xXmM]")
    return found.select(F.col("file_name").alias("file"), F.row_number().over(sheets.W.orderBy("path")).cast("bigint").alias("place"))


@query(f"SELECT p_brand || '.xlsx' AS file, 'cover of ' || p_brand AS cover, '7' AS number FROM part GROUP BY p_brand")
def sheet_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of one sheet: no other sheet's part is opened."""
    to = folder(spark, "pruned")
    part_books(spark, sf_dir, to)
    rows = read_lines(spark, to, sheets=["cover"], last_row=1).where("row_index > 0")
    return rows.select(_file(F.col("path")).alias("file"), _part_of(0).alias("cover"), _part_of(1).alias("number"))
