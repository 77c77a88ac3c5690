"""The registered queries, each an operator applied to whole tables, and the same results in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Config
from ..functions import numbers, text
from ..operators import blocks, cards, follow, grid, headers, models, payload, phases, records, split, templates
from ..schemas import TARGET_FIELDS
from ..scratch import written
from ..sinks import sheets
from ..sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL when there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows of a small file dealt by their key: a file of one row group is one task, however much is done with each row."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, key)


STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
LINES = "array_to_string(list_transform(string_split(regexp_replace({}, '\\r\\n?', chr(10), 'g'), chr(10)), lambda l: " + STRIP.format("regexp_replace(l, '[ \\t]{{2,}}', ' ', 'g')") + "), chr(10))"
#: Letters beyond ASCII stand for word characters in both engines, whatever their idea of a word boundary.
WORDS = "regexp_replace(text, '[^\\x00-\\x7F]', '_', 'g')"


# ---- text and numbers


@query(f"SELECT doc_id, {STRIP.format(LINES.format('''('  ' || replace(text, ' the ', chr(9) || chr(9) || 'the ') || chr(13) || chr(10) || ' x   y ' || chr(13) || 'z')'''))} AS cell FROM documents")
def cell_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("  "), F.replace("text", F.lit(" the "), F.lit("\t\tthe ")), F.lit("\r\n x   y \rz"))
    return table(spark, sf_dir, "documents").select("doc_id", text.normalize_cell(raw).alias("cell"))


@query("SELECT p_partkey, regexp_replace(lower(p_name || ' / ' || p_brand), '[^a-z0-9]+', '', 'g') AS key FROM part")
def match_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.match_key(F.concat_ws(" / ", "p_name", "p_brand")).alias("key"))


@query("SELECT p_partkey, p_name || ' ' || p_size || ' mm² or 3 CM³, 5 m² of W2' AS fixed FROM part")
def unit_superscript(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"), F.lit(" mm^2 or 3 CM 3, 5 m**2 of W2"))
    return table(spark, sf_dir, "part").select("p_partkey", text.superscript_units(raw).alias("fixed"))


@query("SELECT p_partkey, p_size || 'mm², 3 CM 3, 4 dm² and xm2' AS fixed FROM part")
def technical_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.col("p_size").cast("string"), F.lit("mm2, 3 CM 3, 4 dm ^2 and xm2"))
    return table(spark, sf_dir, "part").select("p_partkey", text.technical_units(raw).alias("fixed"))


@query("SELECT p_partkey, lower(p_brand) AS label, p_name || ': ' || p_size AS value FROM part")
def label_value_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit(" "), "p_brand", F.lit(" :  "), "p_name", F.lit(": "), F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", text.label(raw).alias("label"), text.label_value(raw).alias("value"))


def _tokens_sql(source: str, words: str) -> str:
    return f"SELECT doc_id, coalesce(array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all({source}, '(?i)\\b({words})\\b', 1), lambda t: upper(t)))), ', '), '') AS tokens FROM documents"


@query(_tokens_sql(WORDS, "IEC|EN|UL|ASTM|ISO|DIN|JIS|GB"))
def standard_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.regexp_replace("text", "[^\\x00-\\x7F]", "_")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.sort_array(text.tokens(words, text.STANDARDS)), ", ").alias("tokens"))


@query(_tokens_sql(f"({WORDS} || ' vde E' || (1000 + doc_id % 7) || ' CE ce')", "UL|VDE|TUV|CSA|CQC|CE|ENEC|E\\d{2,}"))
def mark_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.concat(F.regexp_replace("text", "[^\\x00-\\x7F]", "_"), F.lit(" vde E"), (1000 + F.col("doc_id") % 7).cast("string"), F.lit(" CE ce"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.sort_array(text.tokens(words, text.MARKS)), ", ").alias("tokens"))


@query("SELECT c_custkey, c_custkey * 1000 AS number, CASE c_nationkey % 4 WHEN 0 THEN 12 WHEN 1 THEN 20 WHEN 2 THEN 105 ELSE c_nationkey END AS numeral FROM customer")
def numbers_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.when(F.col("c_nationkey") % 4 == 0, "十二").when(F.col("c_nationkey") % 4 == 1, "二十").when(F.col("c_nationkey") % 4 == 2, "一百零五").otherwise(F.col("c_nationkey").cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", numbers.grouped_number(F.concat(F.lit("stars: "), F.format_number(F.col("c_custkey") * 1000, 0), F.lit(" of 7"))).alias("number"), numbers.numeral(words).alias("numeral"))


# ---- tables: one for each order, a row for each line item


SORTED = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)"


def order_rows(cells: list[Column]) -> Column:
    """The cells of a line item, wrapped to be collected in a stable order."""
    return F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.array(*cells).alias("cells"))


def by_document(items: DataFrame, rows: Column) -> DataFrame:
    """(doc_id, rows, l_orderkey): items gathered by the document that they are of, under its name, so that what works on documents finds them together."""
    found = items.withColumn("doc_id", F.col("l_orderkey").cast("string")).groupBy("doc_id").agg(rows)
    return found.withColumn("l_orderkey", F.col("doc_id").cast("bigint"))


def order_tables(spark: SparkSession, sf_dir: str, header: list[str] | None = None) -> DataFrame:
    """doc_id, engine, page, table_index, arrival_seq, grid: six columns, the fifth empty unless there is a header, the fourth blank in every third line."""
    whole = header is not None
    cells = [
        F.concat(F.lit("Part "), F.col("l_partkey").cast("string")),
        F.concat(F.lit("Supplier "), F.col("l_suppkey").cast("string")),
        F.concat(F.col("l_returnflag"), F.lit("-"), F.col("l_linenumber").cast("string")),
        F.when(F.lit(whole) | (F.col("l_linenumber") % 3 != 0), F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(" mm2"))).otherwise(""),
        F.lit("EN 60335-1" if whole else ""),
        F.concat(F.lit("CE\n"), F.col("l_linestatus")),
    ]
    lines = by_document(table(spark, sf_dir, "lineitem"), F.sort_array(F.collect_list(order_rows(cells))).alias("rows"))
    rows = F.transform("rows", lambda r: r["cells"])
    if whole:
        rows = F.concat(F.array(F.array(*map(F.lit, header))), rows)
    return lines.select("doc_id", F.lit("pdfplumber_lines").alias("engine"), (F.col("l_orderkey") % 50 + 1).cast("int").alias("page"), F.lit(1).alias("table_index"), F.col("l_orderkey").alias("arrival_seq"), rows.alias("grid"))


HEADER = ["Object / part No.", "Manufacturer / trademark", "Type / model", "Technical data", "Standard", "Mark(s) of conformity"]
CLEANED = "(SELECT l_orderkey, count(*) AS n, sum(CASE WHEN l_linenumber % 3 = 0 THEN 4 ELSE 5 END) AS filled, max(CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE 1 END) AS wide, stddev_pop(CASE WHEN l_linenumber % 3 = 0 THEN 4 ELSE 5 END) AS spread FROM lineitem GROUP BY l_orderkey)"
SCORED = f"(SELECT l_orderkey, n, 4 + wide AS cols, filled, CAST(filled AS DOUBLE) / (n * (4 + wide)) * 55 + CAST(n AS DOUBLE) / (n * (4 + wide)) * 7 + 15 / (1 + spread) + 3 * ln(1 + n * (4 + wide)) - CASE WHEN n < 2 THEN 20 ELSE 0 END AS score FROM {CLEANED})"


@query(f"SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, CAST(n AS INTEGER) AS n_rows, CAST(4 + wide AS INTEGER) AS n_cols, CAST(filled AS INTEGER) AS filled FROM {CLEANED}")
def grid_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = grid.clean(order_tables(spark, sf_dir))
    return out.select("doc_id", "n_rows", "n_cols", F.size(F.filter(F.flatten("grid"), lambda c: c != "")).alias("filled"))


@query(f"SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, round(score, 6) AS score FROM {SCORED}")
def table_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.score(grid.clean(order_tables(spark, sf_dir))).select("doc_id", F.round("score", 6).alias("score"))


def _one_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order tables as those of a document for each customer-like group of orders, so that shapes meet on a page."""
    out = grid.score(grid.clean(order_tables(spark, sf_dir)))
    return out.withColumn("doc_id", (F.col("arrival_seq") % 1000).cast("string"))


@query(f"SELECT l_orderkey AS arrival_seq, CAST(n AS INTEGER) AS n_rows FROM {SCORED} QUALIFY row_number() OVER (PARTITION BY l_orderkey % 1000, n, cols ORDER BY round(score, 9) DESC, l_orderkey) = 1")
def candidate_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.deduplicate(_one_document(spark, sf_dir).withColumn("score", F.round("score", 9))).select("arrival_seq", "n_rows")


@query(f"SELECT CAST(l_orderkey % 50 + 1 AS INTEGER) AS page, count(*) AS tables FROM {SCORED} WHERE score >= 66.5 GROUP BY ALL")
def score_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = grid.select(order_tables(spark, sf_dir), Config(min_score=66.5, dedup=False))
    return kept.groupBy("page").agg(F.count("*").alias("tables"))


@query(f"SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, round(score, 6) AS score FROM {SCORED} ORDER BY round(score, 6) DESC, CAST(l_orderkey AS VARCHAR) LIMIT 5")
def topk_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = grid.score(grid.clean(order_tables(spark, sf_dir))).withColumn("score", F.round("score", 6))
    return grid.best_tables(scored).select("doc_id", "score")


@query("SELECT doc_id, engine, arrival_seq FROM (SELECT CAST(p_size AS VARCHAR) AS doc_id, 'a' AS engine, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS arrival_seq FROM part UNION ALL SELECT CAST(p_size AS VARCHAR), 'b', row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) + 1099511627776 FROM part)")
def engine_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_size").cast("string").alias("doc_id"), F.lit(1).alias("page"), F.col("p_partkey").alias("table_index"))
    return grid.engine_union(part.withColumn("engine", F.lit("a")), part.withColumn("engine", F.lit("b"))).select("doc_id", "engine", "arrival_seq")


@query("SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, count(*) AS cells FROM lineitem GROUP BY l_orderkey")
def cells_to_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")) - 1
    cells = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("doc_id"), F.lit("e").alias("engine"), F.lit(1).alias("page"), F.lit(1).alias("table_index"), place.alias("row_index"), F.lit(0).alias("col_index"), F.col("l_returnflag").alias("value"))
    return grid.grids(cells).select("doc_id", F.size(F.filter(F.flatten("grid"), lambda c: c.isNotNull())).cast("bigint").alias("cells"))


# ---- headers


def header_cells() -> list[Column]:
    size = F.col("p_size")
    return [
        F.concat(F.lit("Object/part No "), F.col("p_brand")), F.when(size % 2 == 0, "Manufacturer").otherwise("Trademark"), F.lit("Type"), F.when(size % 3 == 0, "Technical data").otherwise("x"), F.lit("Standard"), F.when(size % 5 == 0, "Conformity").otherwise("-"),
    ]


@query("SELECT p_partkey, '0,1,2,' || CASE WHEN p_size % 3 = 0 THEN '3' ELSE '-1' END || ',4,' || CASE WHEN p_size % 5 = 0 THEN '5' ELSE '-1' END AS mapping, CASE WHEN p_size % 3 = 0 OR p_size % 5 = 0 THEN 1 ELSE -1 END AS strict_row FROM part")
def header_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    norms = F.transform(F.array(F.array(*header_cells())), lambda r: F.transform(r, text.match_key))
    out = table(spark, sf_dir, "part").withColumn("norms", norms)
    return out.select("p_partkey", F.array_join(headers.loose_header(F.col("norms"))["mapping"].cast("array<string>"), ",").alias("mapping"), F.coalesce(headers.strict_header(F.col("norms"))["start_row"], F.lit(-1)).alias("strict_row"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 2 ELSE 3 END AS start_row, CASE WHEN p_size % 2 = 0 THEN '0,1,2,3,4,5' ELSE '1,2,3,4,5,6' END AS mapping FROM part")
def header_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.array(F.array(*(F.lit("x") for _ in range(6))), F.array(*map(F.lit, HEADER)))
    two = F.array(F.array(*(F.lit("x") for _ in range(7))), F.array(F.lit("No."), F.lit("Object / part"), *map(F.lit, HEADER[1:5]), F.lit("Mark(s) of")), F.array(F.lit(""), F.lit("No."), *(F.lit("") for _ in range(4)), F.lit("conformity1)")))
    norms = F.transform(F.when(F.col("p_size") % 2 == 0, one).otherwise(two), lambda r: F.transform(r, text.match_key))
    out = table(spark, sf_dir, "part").withColumn("norms", norms)
    found = headers.ordered_header(F.col("norms"))
    return out.select("p_partkey", found["start_row"].alias("start_row"), F.array_join(found["mapping"].cast("array<string>"), ",").alias("mapping"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'components_information' WHEN p_size % 3 = 1 THEN 'list_of_compressor' END AS kind FROM part")
def marked_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("p_size") % 3 == 0, "TABLE: Critical components information").when(F.col("p_size") % 3 == 1, "List of  Compressor").otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", headers.kind_of(text.match_key(raw)).alias("kind"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '0,1,2,3,4,5' END AS mapping FROM part")
def mapping_compress(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.col("p_size").cast("string")
    row = F.array(cell, F.lit(""), cell, cell, cell, cell, F.when(F.col("p_size") % 2 == 0, cell).otherwise(""))
    out = table(spark, sf_dir, "part").withColumn("kept", headers.kept_columns(F.array(row), F.lit(0)))
    found = headers.without_empty_columns(F.array(*(F.lit(k) for k in (0, 2, 3, 4, 5, 6))), F.col("kept"), F.lit(7))
    return out.select("p_partkey", F.array_join(found.cast("array<string>"), ",").alias("mapping"))


def _window_sql() -> str:
    cells = ["CAST(p_partkey AS VARCHAR)", "'Relay part'", "p_brand", "p_type", "'5 A: ' || p_size", "CASE WHEN p_size % 2 = 0 THEN 'IEC 1' ELSE p_name END", "'TUV'", "''"]
    points = []
    for s in range(3):
        c = cells[s : s + 6]
        filled = f"({' + '.join(f'(CASE WHEN {x} <> {chr(39) * 2} THEN 1 ELSE 0 END)' for x in c)})"
        test = lambda x, p: f"regexp_matches({x}, '(?i){p}')"
        points.append(f"2 * {filled} + CASE WHEN {test(c[0], '(alternative|varistor|object|part)')} THEN 2 ELSE 0 END + CASE WHEN {c[3]} LIKE '%:%' THEN 1 ELSE 0 END + CASE WHEN {test(c[4], chr(92) + 'b(IEC|EN|UL|ASTM|ISO|DIN|JIS|GB)' + chr(92) + 'b')} THEN 3 ELSE 0 END + CASE WHEN {test(c[5], chr(92) + 'b(UL|VDE|TUV|CSA|CQC|CE|ENEC|E' + chr(92) + 'd{2,})' + chr(92) + 'b')} THEN 4 ELSE 0 END")
    a, b, c = points
    return f"SELECT p_partkey, CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS start FROM (SELECT p_partkey, {a} AS a, {b} AS b, {c} AS c FROM part)"


@query(_window_sql())
def six_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.array(F.col("p_partkey").cast("string"), F.lit("Relay part"), "p_brand", "p_type", F.concat(F.lit("5 A: "), F.col("p_size").cast("string")), F.when(F.col("p_size") % 2 == 0, "IEC 1").otherwise(F.col("p_name")), F.lit("TUV"), F.lit(""))
    return table(spark, sf_dir, "part").withColumn("row", row).select("p_partkey", headers.six_window(F.col("row")).alias("start"))


# ---- records


@query("SELECT p_partkey, (CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END + 3 >= 4) AND (p_size % 2 = 0 OR p_size % 3 = 0) AS valid FROM part")
def record_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.array("p_name", "p_brand", "p_type", F.lit(""), F.when(F.col("p_size") % 2 == 0, "EN 1").otherwise(""), F.when(F.col("p_size") % 3 == 0, "CE").otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", records.valid(f).alias("valid"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN NULL WHEN n_nationkey % 3 = 1 THEN 'Nation ' || n_nationkey || ':' ELSE 'x W19-' || n_nationkey END AS title FROM nation")
def section_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("n_nationkey").cast("string")
    cell = F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name")).when(F.col("n_nationkey") % 3 == 1, F.concat(F.lit("Nation "), name, F.lit(": "))).otherwise(F.concat(F.lit("x W19-"), name))
    return table(spark, sf_dir, "nation").select("n_nationkey", records.section_title(F.array(F.lit(""), cell, F.lit(" "))).alias("title"))


@query(
    "SELECT conv_id, name, string_agg(mark, chr(10) ORDER BY turn) AS marks FROM (SELECT *, first_value(CASE WHEN role = 'user' THEN 'turn ' || turn ELSE '' END) OVER (PARTITION BY conv_id, island ORDER BY turn) AS name FROM ("
    "SELECT conv_id, turn, role, '#' || turn || '#' AS mark, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM conversations)) WHERE name <> '' GROUP BY conv_id, island, name"
)
def continuation_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("turn").cast("string")
    f = F.array(F.when(F.col("role") == "user", F.concat(F.lit("turn "), turn)).otherwise(""), F.concat(F.lit("#"), turn, F.lit("#")), F.lit(""), F.lit(""), F.lit(""), F.lit("CE"))
    row = records.as_record(F.col("turn"), F.lit("detail"), F.lit(""), f)
    turns = records.chained(table(spark, sf_dir, "conversations").select("conv_id", row.alias("r")), "conv_id")
    whole = records.merged(F.col("rows"), F.lit(records.COMPONENTS))
    return turns.select("conv_id", F.explode(whole).alias("r")).select("conv_id", F.col("r.f")[0].alias("name"), F.col("r.f")[1].alias("marks"))


@query("SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lower(" + STRIP.format(LINES.format("text")) + ") ORDER BY doc_id) = 1")
def record_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    empty = {f: F.lit("") for f in TARGET_FIELDS[1:]}
    rows = table(spark, sf_dir, "documents").select(
        F.lit("corpus").alias("doc_id"), F.lit(1).alias("phase"), F.col("doc_id").alias("page"), F.lit(1).alias("table_index_on_page"), F.lit(0).alias("row_index_on_table"), F.lit(0).alias("ord"), F.lit("detail").alias("row_type"), F.lit("").alias("section_title"), F.lit("").alias("product_model"), text.normalize_cell("text").alias(TARGET_FIELDS[0]), *(c.alias(f) for f, c in empty.items()),
    )
    return records.deduplicate(rows).select(F.col("page").alias("doc_id"))


@query("SELECT event_id, last_value(CASE WHEN event_type IN ('click', 'view') THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS name FROM events")
def forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("event_type").isin("click", "view"), F.col("event_type")).otherwise("")
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("doc_id"), F.lit(1).alias("seq"), F.col("event_id").alias("row"), F.array(value).alias("v"))
    return templates.filled_down(rows).select("event_id", F.nullif("name", F.lit("")).alias("name"))


@query("SELECT event_id, coalesce(last_value(CASE WHEN event_type = 'click' THEN event_id % 7 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), -1) AS col FROM events")
def carry_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    loose = F.when(F.col("event_type") == "click", F.struct(F.lit(1).alias("start_row"), F.array(F.col("event_id") % 7).alias("mapping")))
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), loose.alias("loose"))
    return phases.carried_header(rows).select("event_id", F.coalesce(F.col("carried")[0], F.lit(-1)).alias("col"))


@query("SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, phase FROM (SELECT o_orderkey, o_custkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS phase FROM orders) QUALIFY phase = min(phase) OVER (PARTITION BY o_custkey)")
def phase_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    phase = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("doc_id"), phase.alias("phase"))
    return phases.first_phase(rows).select("o_orderkey", "phase")


PAGED = "(SELECT l_orderkey, o_custkey, place + CASE WHEN place > 3 THEN 1 ELSE 0 END AS page FROM (SELECT o_orderkey AS l_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)))"


def _paged_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as pages of one document: the first one headed, and a page without tables after the third."""
    tables = order_tables(spark, sf_dir, HEADER).withColumn("o_orderkey", F.col("doc_id").cast("bigint"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    place = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    paged = tables.join(orders, "o_orderkey").withColumn("place", place)
    rows = F.when(F.col("place") > 1, F.slice("grid", 2, F.greatest(F.size("grid"), F.lit(1)))).otherwise(F.col("grid"))
    return paged.select(F.col("o_custkey").cast("string").alias("doc_id"), "engine", (F.col("place") + F.when(F.col("place") > 3, 1).otherwise(0)).cast("int").alias("page"), "table_index", F.col("o_orderkey").alias("arrival_seq"), rows.alias("grid"))


@query(f"SELECT CAST(o_custkey AS VARCHAR) AS doc_id, CAST(page AS INTEGER) AS page, count(*) AS records FROM lineitem JOIN {PAGED} USING (l_orderkey) WHERE page <= 3 GROUP BY ALL")
def page_follow(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = written(headers.describe(grid.select(_paged_orders(spark, sf_dir), Config(min_score=-100.0)).drop("details"), templates=False, broad=False), "candidates")
    rows = written(follow.chain_records(found, False, phases.TRACKED), "records")
    return rows.groupBy("doc_id", "page").agg(F.sum(F.size("records")).alias("records"))


TARGET_SQL = "'Part ' || l_partkey AS object_part_no, 'Supplier ' || l_suppkey AS manufacturer_trademark, l_returnflag || '-' || l_linenumber AS type_model, CAST(l_quantity AS INTEGER) || ' mm²' AS technical_data, 'EN 60335-1' AS standard, 'CE' || chr(10) || l_linestatus AS marks_of_conformity"


@query(f"SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS doc_id, CAST(l_orderkey % 50 + 1 AS INTEGER) AS page, {TARGET_SQL} FROM lineitem")
def target_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: from raw tables through all phases to deduplicated records."""
    return phases.extract(order_tables(spark, sf_dir, HEADER)).select("doc_id", "page", *TARGET_FIELDS)


@query(f"SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS doc_id, {TARGET_SQL} FROM lineitem")
def broad_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phases.extract(order_tables(spark, sf_dir, HEADER), Config(policy="broad")).select("doc_id", *TARGET_FIELDS)


@query("SELECT p_partkey, 'Alternative ' || p_partkey || ':' AS object_part_no, p_brand AS manufacturer_trademark, p_name AS type_model, 'rating: ' || p_size || ' V' || chr(10) || '50 Hz' AS technical_data, 'IEC' AS standard, 'VDE' AS marks_of_conformity FROM part")
def alternative_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    rows = [(F.concat(F.lit("Alternative "), F.col("p_partkey").cast("string"), F.lit(":")), F.lit("")), (F.lit("Manufacturer:"), F.col("p_brand")), (F.lit("Designation:"), F.col("p_name")), (F.lit("Rating:"), F.concat(size, F.lit(" V"))), (F.lit(""), F.lit("50 Hz")), (F.lit("Standard:"), F.lit("IEC 60335, VDE"))]
    out = spread(table(spark, sf_dir, "part"), "p_partkey").withColumn("grid", F.array(*(F.array(*r) for r in rows)))
    out = out.select("p_partkey", F.explode(blocks.block_records(F.col("grid"))).alias("r"))
    return out.select("p_partkey", *(F.col("r.f")[k].alias(f) for k, f in enumerate(TARGET_FIELDS)))


def _by_template(tables: DataFrame) -> DataFrame:
    found = headers.written_candidates(grid.select(tables, Config(min_score=-100.0)).drop("details"), searched=False)
    return records.exploded(templates.template_records(found))


FOUR_HEADER = ["TABLE: Components only used in the samples; Object / part No.", "Manufacturer / trademark", "Type / model", "Technical data"]


@query("SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, 'Part ' || l_partkey AS object_part_no, 'Supplier ' || l_suppkey AS manufacturer_trademark, l_returnflag || '-' || l_linenumber AS type_model, CAST(l_quantity AS INTEGER) || ' mm²' AS technical_data FROM lineitem")
def template_four(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = order_tables(spark, sf_dir, [*FOUR_HEADER, "", ""])
    four = raw.withColumn("grid", F.transform("grid", lambda r: F.slice(r, 1, 4)))
    return _by_template(four).select("doc_id", *TARGET_FIELDS[:4])


#: Line items by their place in an order, and what their cells say.
PLACED = f"(SELECT *, {SORTED} AS place FROM lineitem)"
NAME, MAKER, TYPE, SIZE = "'Part ' || l_partkey", "'Supplier ' || l_suppkey", "l_returnflag || '-' || l_linenumber", "CAST(l_quantity AS INTEGER)"
FILLED = "last_value(CASE WHEN place % 2 = 1 THEN 'Part ' || l_partkey END IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY place ROWS UNBOUNDED PRECEDING)"


def placed_tables(spark: SparkSession, sf_dir: str, head: list[list[str]], row: Callable[[Column, Column], list[Column]]) -> DataFrame:
    """A table for each order: ``head``, then ``row(line item, place from 1)`` for each of its items."""
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_quantity", "l_linestatus")
    lines = by_document(table(spark, sf_dir, "lineitem"), F.sort_array(F.collect_list(item)).alias("items"))
    rows = F.transform("items", lambda x, i: F.array(*row(x, i + 1)))
    top = [F.array(*map(F.lit, r)) for r in head]
    return lines.select("doc_id", F.lit("pdfplumber_lines").alias("engine"), F.lit(1).alias("page"), F.lit(1).alias("table_index"), F.col("l_orderkey").alias("arrival_seq"), (F.concat(F.array(*top), rows) if top else rows).alias("grid"))


def _said(x: Column) -> tuple[Column, Column, Column, Column]:
    """Name, maker, type and size of a line item."""
    return F.concat(F.lit("Part "), x["l_partkey"].cast("string")), F.concat(F.lit("Supplier "), x["l_suppkey"].cast("string")), F.concat(x["l_returnflag"], F.lit("-"), x["l_linenumber"].cast("string")), F.concat(x["l_quantity"].cast("int").cast("string"), F.lit(" mm2"))


@query(f"SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, {FILLED} AS object_part_no, {MAKER} AS manufacturer_trademark, {TYPE} AS type_model, {SIZE} || ' mm²' AS technical_data, 'EN 1' AS standard, 'CE' AS marks_of_conformity FROM {PLACED}")
def template_six(spark: SparkSession, sf_dir: str) -> DataFrame:
    def row(x: Column, i: Column) -> list[Column]:
        name, maker, kind, size = _said(x)
        return [F.when(i % 2 == 1, name).otherwise(""), maker, kind, size, F.lit("EN 1"), F.lit("CE")]

    return _by_template(placed_tables(spark, sf_dir, [["項次", "零組件", "取得標誌", "", "", ""], HEADER], row)).select("doc_id", *TARGET_FIELDS)


@query(
    f"SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, {FILLED} AS object_part_no, {MAKER} || CASE WHEN l_suppkey % 2 = 1 THEN '；Brand' ELSE '' END AS manufacturer_trademark, {TYPE} AS type_model, {SIZE} || ' mm²' AS technical_data, 'EN 1' AS standard, "
    f"'CE' || CASE WHEN place % 3 > 0 THEN '；N' || place ELSE '' END AS marks_of_conformity FROM {PLACED}"
)
def template_extended(spark: SparkSession, sf_dir: str) -> DataFrame:
    def row(x: Column, i: Column) -> list[Column]:
        name, maker, kind, size = _said(x)
        return [F.when(i % 2 == 1, name).otherwise(""), maker, F.when(x["l_suppkey"] % 2 == 1, "Brand").otherwise(maker), kind, size, F.lit("EN 1"), F.lit("CE"), F.when(i % 3 > 0, F.concat(F.lit("N"), i.cast("string"))).otherwise("")]

    top = [["適用型號", "新申請", *[""] * 6], ["零組件/材料名稱", "製造商", "商標", "型號(零組件)", "技術規格/電氣規格", "驗證標準", "驗證標誌及號碼", "ＣＩ證書號碼"]]
    return _by_template(placed_tables(spark, sf_dir, top, row)).select("doc_id", *TARGET_FIELDS)


@query(
    f"SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, {NAME} AS object_part_no, {MAKER} AS manufacturer_trademark, {TYPE} AS type_model, {SIZE} || ' mm²' || CASE WHEN more IS NULL OR contains({SIZE} || 'mm2', more || 'mm2') THEN '' ELSE ' ' || more || ' mm²' END AS technical_data, 'KC' AS marks_of_conformity "
    f"FROM (SELECT *, lead(CASE WHEN place % 3 = 0 THEN {SIZE} END) OVER (PARTITION BY l_orderkey ORDER BY place) AS more FROM {PLACED}) WHERE place % 3 > 0"
)
def template_five(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third row goes on with the one above it: its size is added unless what is there holds it already."""

    def row(x: Column, i: Column) -> list[Column]:
        name, maker, kind, size = _said(x)
        whole = lambda c: F.when(i % 3 > 0, c).otherwise("")
        return [whole(name), whole(maker), whole(kind), size, whole(F.lit("KC"))]

    top = [["Component / part No.", "Manufacturer / brand", "Model / type", "Rating or characteristics", "Tested by"]]
    return _by_template(placed_tables(spark, sf_dir, top, row)).select("doc_id", *TARGET_FIELDS[:4], TARGET_FIELDS[5])


@query(f"SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, 'PM-' || min(l_partkey) OVER (PARTITION BY l_orderkey) AS product_model, {NAME} AS object_part_no, {MAKER} AS manufacturer_trademark, {TYPE} AS type_model, {SIZE} || ' mm²' AS technical_data, 'EN 1' AS standard, 'CE' AS marks_of_conformity FROM {PLACED} QUALIFY place % 4 > 0")
def template_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth row is a remark; the model stands in the table's own third row."""

    def row(x: Column, i: Column) -> list[Column]:
        name, maker, kind, size = _said(x)
        return [F.when(i % 4 > 0, name).otherwise(F.concat(F.lit("Remark "), name)), maker, kind, size, F.lit("EN 1"), F.lit("CE")]

    tables = placed_tables(spark, sf_dir, [["Product information for model", "x", "", "", "", ""], ["Model", "Name", "", "", "", ""], HEADER], row)
    least = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("doc_id")).agg(F.concat(F.lit("PM-"), F.min("l_partkey").cast("string")).alias("named"))
    named = F.array(F.array("named", F.lit("n"), *(F.lit("") for _ in range(4))))
    tables = tables.join(least, "doc_id").withColumn("grid", F.concat(F.slice("grid", 1, 2), named, F.slice("grid", 3, F.size("grid")))).drop("named")
    return _by_template(tables).select("doc_id", "product_model", *TARGET_FIELDS)


@query(f"SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, CASE WHEN l_orderkey % 2 = 0 THEN -1 ELSE 0 END AS phase, {NAME} AS object_part_no, {MAKER} AS manufacturer_trademark, {TYPE} AS type_model, {SIZE} || ' mm²' AS technical_data, CASE WHEN l_orderkey % 2 = 0 THEN 'EN 1' ELSE '' END AS standard, CASE WHEN l_orderkey % 2 = 0 THEN 'CE' ELSE '' END AS marks_of_conformity FROM {PLACED}")
def template_requested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A template asked for by its short name holds where a document is of no known family; documents of another family are read as that."""

    def row(x: Column, i: Column) -> list[Column]:
        return [*_said(x), F.lit("EN 1"), F.lit("CE")]

    tables = placed_tables(spark, sf_dir, [], row)
    head = F.when(F.col("arrival_seq") % 2 == 0, F.array(F.array(*map(F.lit, HEADER)))).otherwise(F.array(F.array(*map(F.lit, FOUR_HEADER))))
    cut = F.when(F.col("arrival_seq") % 2 == 0, F.col("grid")).otherwise(F.transform("grid", lambda r: F.slice(r, 1, 4)))
    found = headers.written_candidates(grid.select(tables.withColumn("grid", F.concat(head, cut)), Config(min_score=-100.0)).drop("details"), searched=False)
    rows = phases.first_phase(records.exploded(templates.template_records(found, " Taiwan_ETC ")))
    return rows.select("doc_id", "phase", *TARGET_FIELDS)


@query(f"SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, CAST(place - 1 AS INTEGER) AS row_index, {NAME} AS object_part_no, {MAKER} AS manufacturer_trademark, {TYPE} AS type_model, {SIZE} || ' mm²: x' AS technical_data, 'EN 1' AS standard, 'CE' AS marks_of_conformity FROM {PLACED} WHERE place % 3 > 0")
def window_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of eight columns without a header: the best six neighbouring cells of each row are a record where they are valid; every third row has no more than three filled."""

    def row(x: Column, i: Column) -> list[Column]:
        name, maker, kind, size = _said(x)
        whole = lambda c: F.when(i % 3 > 0, c).otherwise("")
        return [F.lit("x"), name, whole(maker), whole(kind), whole(F.concat(size, F.lit(": x"))), whole(F.lit("EN 1")), whole(F.lit("CE")), F.lit("y")]

    found = grid.select(placed_tables(spark, sf_dir, [], row), Config(min_score=-100.0))
    rows = records.window_rows(found, "doc_id")
    return rows.select("doc_id", F.col("row").alias("row_index"), *(F.get("f", F.lit(k)).alias(n) for k, n in enumerate(TARGET_FIELDS)))


def placed_pages(spark: SparkSession, sf_dir: str, each: int, pages: Callable[[Column, Column], Column]) -> DataFrame:
    """An order's items as a document of several pages, ``each`` to a page: ``pages(page, items)`` is a page's grid."""
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_quantity", "l_linestatus")
    lines = by_document(table(spark, sf_dir, "lineitem"), F.sort_array(F.collect_list(item)).alias("items"))
    dealt = lines.select("doc_id", "l_orderkey", F.size("items").alias("n"), F.col("items"), F.explode(F.sequence(F.lit(1), F.ceil(F.size("items") / each).cast("int"))).alias("page"))
    mine = F.transform(F.slice("items", (F.col("page") - 1) * each + 1, each), lambda x, i: F.struct(((F.col("page") - 1) * each + i + 1).alias("place"), x.alias("x")))
    return dealt.select("doc_id", F.lit("pdfplumber_lines").alias("engine"), "page", F.lit(1).alias("table_index"), (F.col("l_orderkey") * 10 + F.col("page")).alias("arrival_seq"), pages(F.col("page"), mine).alias("grid"))


_FIVE = f"(SELECT l_orderkey, place, {NAME} AS name, {MAKER} AS maker, {TYPE} AS kind, {SIZE} AS size, lead({NAME}) OVER o AS next, lead({SIZE}) OVER o AS more, lag({NAME}, 3) OVER o AS filled, lag({NAME}) OVER o AS above FROM {PLACED} WINDOW o AS (PARTITION BY l_orderkey ORDER BY place))"
_SQUEEZED = "replace(lower({}), ' ', '')"


@query(
    f"SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, CAST((place + 1) // 2 AS INTEGER) AS page, CASE place % 4 WHEN 1 THEN name WHEN 0 THEN filled ELSE above || CASE WHEN next IS NULL OR contains({_SQUEEZED.format('above')}, {_SQUEEZED.format('next')}) THEN '' ELSE ' ' || next END END AS object_part_no, maker AS manufacturer_trademark, kind AS type_model, "
    f"size || ' mm²' || CASE WHEN place % 4 <> 2 OR more IS NULL OR contains(size || 'mm2', more || 'mm2') THEN '' ELSE ' ' || more || ' mm²' END AS technical_data, 'KC' AS marks_of_conformity FROM {_FIVE} WHERE place % 4 <> 3"
)
def template_five_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rows a page: the third of four stands first on its page with two values, so it goes on with the record of the page before; the second and fourth have no object, which fills down."""

    def pages(page: Column, items: Column) -> Column:
        def row(r: Column) -> Column:
            name, maker, kind, size = _said(r["x"])
            at = r["place"] % 4
            whole = lambda c: F.when(at != 3, c).otherwise("")
            return F.array(F.when(at.isin(1, 3), name).otherwise(""), whole(maker), whole(kind), size, whole(F.lit("KC")))

        top = F.array(F.array(*map(F.lit, ["Component / part No.", "Manufacturer / brand", "Model / type", "Rating or characteristics", "Tested by"])))
        # a blank cell in every row would take its column away: the header keeps all five
        return F.when(page == 1, F.concat(top, F.transform(items, row))).otherwise(F.concat(F.transform(items, row), F.slice(top, 1, 1)))

    return _by_template(placed_pages(spark, sf_dir, 2, pages)).select("doc_id", "page", *TARGET_FIELDS[:4], TARGET_FIELDS[5])


@query(f"SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, CAST(place AS INTEGER) AS page, CASE WHEN place < 4 THEN 'PM-' ELSE 'PN-' END || l_orderkey AS product_model, {NAME} AS object_part_no, {MAKER} AS manufacturer_trademark, {TYPE} AS type_model, {SIZE} || ' mm²' AS technical_data, 'EN 1' AS standard, 'CE' AS marks_of_conformity FROM {PLACED} WHERE place NOT IN (4, 5)")
def template_product_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a page: pages 2 and 3 and 7 have no header and follow one that had; page 4 names another model in a table that is no target, so page 5 follows nothing; page 6 has a header and keeps the model of page 4."""

    def pages(page: Column, items: Column) -> Column:
        name, maker, kind, size = _said(items[0]["x"])
        row = F.array(F.array(name, maker, kind, size, F.lit("EN 1"), F.lit("CE")))
        fixed = lambda *rows: F.array(*(F.array(*map(F.lit, r)) for r in rows))
        model = lambda start, n: F.array(F.array(F.concat(F.lit(start), F.col("l_orderkey").cast("string")), *(F.lit("n") for _ in range(n - 1))))
        first = F.concat(fixed(["Product information for model", "x", "", "", "", ""], ["Model", "Name", "", "", "", ""]), model("PM-", 6), fixed(HEADER), row)
        other = F.concat(fixed(["Product information for model", "x", "y", "z", "w"], ["Model", "N", "N", "N", "N"]), model("PN-", 5))
        return F.when(page == 1, first).when(page == 4, other).when(page == 6, F.concat(fixed(HEADER), row)).otherwise(row)

    return _by_template(placed_pages(spark, sf_dir, 1, pages)).select("doc_id", "page", "product_model", *TARGET_FIELDS)


@query(f"SELECT CAST(o_custkey AS VARCHAR) AS doc_id, CAST(page AS INTEGER) AS page, count(*) AS records FROM lineitem JOIN {PAGED} USING (l_orderkey) WHERE page <= 2 GROUP BY ALL")
def marked_follow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A marked table over a customer's pages; on the third another marked table begins, which ends the chain."""
    tables = _paged_orders(spark, sf_dir)
    title = lambda t: F.array(F.array(F.lit(t), *(F.lit("") for _ in range(5))))
    rows = F.when(F.col("page") == 1, F.concat(title("TABLE: Components information"), "grid")).when(F.col("page") == 3, F.concat(title("TABLE: Heating test"), "grid")).otherwise(F.col("grid"))
    found = written(headers.describe(grid.select(tables.withColumn("grid", rows), Config(min_score=-100.0)).drop("details"), templates=False, broad=False), "candidates")
    return written(follow.chain_records(found, True, phases.MARKED), "records").groupBy("doc_id", "page").agg(F.sum(F.size("records")).alias("records"))


#: Which item of an order stands on page p, and what each chain yields of it.
_ON_PAGE = f"(SELECT l_orderkey, page, {NAME} AS part, 'Compressor ' || l_partkey AS compressor, {MAKER} AS maker, {TYPE} AS kind, {SIZE} || ' mm²' AS size FROM (SELECT *, max(place) OVER (PARTITION BY l_orderkey) AS n FROM {PLACED}) JOIN (SELECT unnest(range(1, 10)) AS page) ON place = (page - 1) % n + 1)"


@query(
    f"SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, chain, CAST(page AS INTEGER) AS page, CAST(nth AS INTEGER) AS table_index, object_part_no, maker AS manufacturer_trademark, kind AS type_model, size AS technical_data, 'EN 1' AS standard, 'CE' AS marks_of_conformity FROM ("
    f"SELECT *, 'components_information' AS chain, part AS object_part_no, CASE page WHEN 2 THEN 1 + l_orderkey % 2 ELSE 1 END AS nth FROM {_ON_PAGE} WHERE page IN (1, 2, 3, 4, 6) UNION ALL "
    f"SELECT *, 'components_information', compressor, CASE page WHEN 2 THEN 1 + l_orderkey % 2 ELSE 1 END FROM {_ON_PAGE} WHERE page IN (2, 3) UNION ALL "
    f"SELECT *, 'list_of_compressor', compressor, CASE page WHEN 2 THEN 1 + l_orderkey % 2 ELSE 2 END FROM {_ON_PAGE} WHERE page <= 3)"
)
def follow_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two marked tables start on page 1. Page 2 has two tables, the larger first or second; page 3 heads the components anew with columns in another order, which ends the compressors after its other table; pages 5, 7 and 8 have remarks only: one miss is passed over, two end the chain before page 9."""
    turned = [*HEADER[:4], HEADER[5], HEADER[4]]
    fixed = lambda *rows: F.array(*(F.array(*map(F.lit, r)) for r in rows))
    title = lambda t: [t, "", "", "", "", ""]
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_quantity", "l_linestatus")
    lines = by_document(table(spark, sf_dir, "lineitem"), F.sort_array(F.collect_list(item)).alias("items"))
    paged = lines.select("doc_id", "l_orderkey", "items", F.explode(F.sequence(F.lit(1), F.lit(9))).alias("page"))
    x = F.get("items", (F.col("page") - 1) % F.size("items"))
    part, maker, kind, size = _said(x)
    compressor = F.concat(F.lit("Compressor "), x["l_partkey"].cast("string"))
    row = lambda name, late=False: F.array(F.array(name, maker, kind, size, *([F.lit("CE"), F.lit("EN 1")] if late else [F.lit("EN 1"), F.lit("CE")])))
    remarks = fixed(["Remark a", "x", "y", "z", "EN 1", "CE"], ["Remark b", "x", "y", "z", "EN 1", "CE"])
    large, small = F.concat(row(part), row(compressor)), row(F.lit("Part of the smaller table"))
    second = F.when(F.col("l_orderkey") % 2 == 0, F.array(large, small)).otherwise(F.array(small, large))
    grids = (
        F.when(F.col("page") == 1, F.array(F.concat(fixed(title("TABLE: Components information"), HEADER), row(part)), F.concat(fixed(title("TABLE: list of compressor"), HEADER), row(compressor))))
        .when(F.col("page") == 2, second).when(F.col("page") == 3, F.array(F.concat(fixed(title("TABLE: Components information"), turned), row(part, True), row(compressor, True)), row(compressor)))
        .when(F.col("page").isin(5, 7, 8), F.array(remarks)).otherwise(F.array(row(part, True)))
    )
    tables = paged.select("doc_id", "l_orderkey", "page", F.posexplode(grids).alias("at", "grid"))
    tables = tables.select("doc_id", F.lit("pdfplumber_lines").alias("engine"), "page", (F.col("at") + 1).alias("table_index"), (F.col("l_orderkey") * 100 + F.col("page") * 3 + F.col("at")).alias("arrival_seq"), "grid")
    found = written(headers.describe(grid.select(tables, Config(min_score=-100.0, dedup=False)).drop("details"), templates=False, broad=False), "candidates")
    rows = written(follow.chain_records(found, True, phases.MARKED), "records")
    chain = F.when(F.col("seq") >= 1_000_000, "list_of_compressor").otherwise("components_information")
    r = F.col("r")
    return rows.withColumn("chain", chain).select("doc_id", "chain", "page", "table_index", F.explode("records").alias("r")).select("doc_id", "chain", "page", "table_index", *(F.get(r["f"], F.lit(k)).alias(n) for k, n in enumerate(TARGET_FIELDS)))


@query(f"SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, CAST(CASE WHEN place % 2 = 1 THEN 1 ELSE 2 END AS INTEGER) AS page, count(*) AS records FROM {PLACED} WHERE place % 2 = 1 OR l_orderkey % 4 <= 2 GROUP BY ALL")
def column_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even rows stand on a second page without a header, in a table that is none to three columns wider: two are tolerated."""

    def row(x: Column, i: Column) -> list[Column]:
        name, maker, kind, size = _said(x)
        return [name, maker, kind, size, F.lit("EN 1"), F.lit("CE")]

    both = placed_tables(spark, sf_dir, [], row)
    pick = lambda k: F.filter("grid", lambda r, i: i % 2 == k)
    first = both.withColumn("grid", F.concat(F.array(F.array(*map(F.lit, HEADER))), pick(0)))
    wider = F.transform(pick(1), lambda r: F.concat(r, F.array_repeat(F.lit("x"), (F.col("arrival_seq") % 4).cast("int"))))
    second = both.withColumns({"grid": wider, "page": F.lit(2), "arrival_seq": F.col("arrival_seq") + (1 << 40)}).where(F.size("grid") > 0)
    found = written(headers.describe(grid.select(first.union(second), Config(min_score=-100.0)).drop("details"), templates=False, broad=False), "candidates")
    return written(follow.chain_records(found, False, phases.TRACKED), "records").groupBy("doc_id", "page").agg(F.sum(F.size("records")).alias("records"))


@query(f"SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, {NAME} AS object_part_no FROM {PLACED} WHERE place % 3 = 1")
def noise_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of three rows one is a part, one a remark, one the header once more."""

    def row(x: Column, i: Column) -> list[Column]:
        cells = [*_said(x), F.lit("EN 1"), F.lit("CE")]
        cells[0] = F.when(i % 3 == 2, F.concat(F.lit(" REMARKS: "), cells[0])).otherwise(cells[0])
        return [F.when(i % 3 == 0, F.lit(h)).otherwise(c) for h, c in zip(HEADER, cells, strict=True)]

    tables = placed_tables(spark, sf_dir, [], row)
    found = records.projected(F.col("grid"), F.array(*map(F.lit, range(6))), F.lit(0), True)
    return tables.select("doc_id", F.explode(found).alias("r")).select("doc_id", F.col("r.f")[0].alias("object_part_no"))


@query("SELECT p_partkey, CASE WHEN p_size % 15 <= 5 THEN p_size % 15 + 1 ELSE -1 END AS loose, CASE WHEN p_size % 15 <= 9 THEN p_size % 15 + 1 ELSE -1 END AS strict, CASE WHEN p_size % 15 <= 11 THEN p_size % 15 + 1 ELSE -1 END AS ordered FROM part")
def header_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A header below none to fourteen other rows: each search reads its own number of rows."""
    above = F.array_repeat(F.array(*(F.lit("x") for _ in range(6))), (F.col("p_size") % 15).cast("int"))
    norms = F.transform(F.concat(above, F.array(F.array(*map(F.lit, HEADER)))), lambda r: F.transform(r, text.match_key))
    out = spread(table(spark, sf_dir, "part"), "p_partkey").withColumn("norms", norms)
    found = {"loose": headers.loose_header, "strict": headers.strict_header, "ordered": headers.ordered_header}
    return out.select("p_partkey", *(F.coalesce(f(F.col("norms"))["start_row"], F.lit(-1)).alias(k) for k, f in found.items()))


@query("SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') || '零組件' || p_size || 'fi' AS cell FROM part")
def compact_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-width letters and digits and a ligature are read as what they stand for."""
    wide = F.translate(F.concat(F.upper("p_name"), F.lit(" / 零組件："), F.col("p_size").cast("string")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺ０１２３４５６７８９")
    out = table(spark, sf_dir, "part").withColumn("grid", F.array(F.array(F.concat(wide, F.lit("ﬁ")))))
    return out.select("p_partkey", text.compact_grid("grid")[0][0].alias("cell"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_brand WHEN p_size % 3 = 1 THEN p_brand || '；' || p_name ELSE p_name END AS joined FROM part")
def join_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size") % 3
    first, second = F.when(size < 2, F.col("p_brand")).otherwise(" "), F.when(size == 0, F.concat("p_brand", F.lit("\n"))).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", text.join_distinct(first, second).alias("joined"))


@query(
    f"WITH found AS (SELECT l_orderkey, {NAME.replace('Part ', 'AB-')} AS model, place FROM {PLACED} WHERE place < 3 AND l_orderkey % 7 > 0 AND l_orderkey % 5 > 0), known AS (SELECT DISTINCT l_orderkey FROM lineitem) "
    "SELECT CAST(k.l_orderkey AS VARCHAR) AS file_name, f.model, CASE WHEN k.l_orderkey % 7 = 0 THEN '失败' WHEN f.model IS NULL THEN '未识别' ELSE '成功' END AS status FROM known k LEFT JOIN (SELECT DISTINCT l_orderkey, model FROM found) f USING (l_orderkey)"
)
def model_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models listed under a header down to the third row, which is blank; every fifth file has no list, every seventh could not be read."""

    def row(x: Column, i: Column) -> list[Column]:
        cell = lambda c: F.when(i != 3, c).otherwise("")
        return [cell(F.concat(F.lit("AB-"), x["l_partkey"].cast("string"))), cell(F.lit("Z")), cell(F.lit("5 A"))]

    tables = placed_tables(spark, sf_dir, [["Model", "Brand name", "Rating"]], row)
    number = F.col("arrival_seq")
    files_ = tables.select("doc_id", F.col("doc_id").alias("file_name"), F.lit("").alias("path"), F.when(number % 7 == 0, "broken").alias("error"))
    pages = tables.where(number % 7 > 0).select("doc_id", F.col("doc_id").alias("file_name"), F.lit("").alias("path"), "page", F.lit("nothing here").alias("text"))
    return models.models(pages, tables.where((number % 7 > 0) & (number % 5 > 0)), files_).select("file_name", "model", "status")


@query("SELECT p_partkey AS row, 'QX' || p_size || '-A' AS model, CAST(3 AS INTEGER) AS cnt FROM part WHERE p_size % 2 = 0 UNION ALL SELECT p_partkey, p_name, -1 FROM part WHERE p_size % 2 = 1")
def sheet_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sheet is found by its column among sheets without one, a result sheet, and a later one that has it too."""
    detail = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("QX"), F.col("p_size").cast("string"), F.lit("-A 三台"))).otherwise(F.col("p_name"))
    body = table(spark, sf_dir, "part").select(F.lit("data").alias("sheet"), F.lit(3).alias("sheet_index"), (F.col("p_partkey") + 10).cast("int").alias("row_index"), F.array(F.col("p_partkey").cast("string"), detail).alias("values"))
    head = lambda sheet, k, row: table(spark, sf_dir, "region").where("r_regionkey = 0").select(F.lit(sheet).alias("sheet"), F.lit(k).alias("sheet_index"), F.lit(row).alias("row_index"), F.array(F.lit("no"), F.lit(f" {split.DETAIL} ")).alias("values"))
    rows = body.union(head("data", 3, 4)).union(head(split.RESULT_SHEET, 1, 1)).union(head("later", 4, 1)).union(head("deep", 2, 31))
    out = split.split_sheet(rows)
    return out.select(F.col("values")[0].cast("bigint").alias("row"), "model", F.coalesce("cnt", F.lit(-1)).alias("cnt"))


@query("SELECT CAST(n_regionkey AS VARCHAR) AS doc_id, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) + 1 AS INTEGER) AS row_index, n_name AS name, CAST(n_nationkey AS VARCHAR) AS number FROM nation UNION ALL SELECT CAST(r_regionkey AS VARCHAR), 1, 'n_name', 'n_nationkey' FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)")
def workbook_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workbook for each region, read back cell by cell."""
    rows = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("doc_id"), F.col("n_nationkey").alias("at"), "n_name", "n_nationkey")
    made = sheets.workbooks(rows, order=("at",))
    read = files.opened(made.select(F.col("doc_id").alias("path"), "content"))
    return read.select(F.col("path").alias("doc_id"), "row_index", F.col("values")[0].alias("name"), F.col("values")[1].alias("number"))


@query(f"SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, CASE WHEN l_orderkey % 2 = 0 THEN 'pdfplumber_lines' ELSE 'other' END AS engine, count(DISTINCT ({NAME}, {MAKER}, {TYPE}, {SIZE})) AS records FROM lineitem GROUP BY ALL")
def engine_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the documents have tables from the first engine; the others' come from a second one."""

    def row(x: Column, i: Column) -> list[Column]:
        return [*_said(x), F.lit("EN 1"), F.lit("CE")]

    tables = placed_tables(spark, sf_dir, [HEADER], row)
    mixed = tables.withColumn("engine", F.when(F.col("arrival_seq") % 2 == 0, "pdfplumber_lines").otherwise("other"))
    return phases.extract_with_retry(mixed).groupBy("doc_id", "engine").agg(F.count("*").alias("records"))


# ---- models, splitting, cards


@query(
    "SELECT CAST(conv_id AS VARCHAR) AS file_name, CAST(turn AS INTEGER) AS page, CASE WHEN top = 90 THEN 'QX-' || turn ELSE 'AB-' || turn || 'X' END AS model, top AS priority FROM (SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN 90 ELSE 70 END AS p, max(CASE WHEN turn % 2 = 1 THEN 90 ELSE 70 END) OVER (PARTITION BY conv_id) AS top FROM conversations WHERE turn <= 5) WHERE p = top"
)
def model_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("turn").cast("string")
    raw = F.when(F.col("turn") % 2 == 1, F.concat(F.lit("Model / Type reference ..: QX-"), turn, F.lit("\nRatings: 220 V"))).otherwise(F.concat(F.lit("x\nModels: AB-"), turn, F.lit("X\ny")))
    pages = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("doc_id"), F.col("conv_id").cast("string").alias("file_name"), F.lit("").alias("path"), F.col("turn").cast("int").alias("page"), raw.alias("text"))
    found = models.models(pages).where(F.col("status") == models.FOUND)
    return found.select("file_name", "page", "model", F.when(F.col("rule") == "Model/Type reference", 90).otherwise(70).alias("priority"))


#: Each file has what one rule takes, and the text line besides, which counts where there is nothing better.
_RULES = ("本次申请型号", "Identification / Type no.", "Models键值行", "Models列表表格", "Models文本行")


@query(
    "SELECT CAST(p_partkey AS VARCHAR) AS file_name, CAST(CASE p_partkey % 5 WHEN 4 THEN 2 ELSE 1 END AS INTEGER) AS page, unnest(CASE p_partkey % 5 WHEN 0 THEN ['AA-' || p_partkey, 'AB-' || p_size] WHEN 1 THEN ['BA-' || p_partkey] WHEN 2 THEN ['CA-' || p_partkey, 'CB-' || p_size] WHEN 3 THEN ['DA-' || p_partkey, 'DB-' || p_size] ELSE ['EA-' || p_partkey] END) AS model, "
    f"CASE p_partkey % 5 WHEN 0 THEN '{_RULES[0]}' WHEN 1 THEN '{_RULES[1]}' WHEN 2 THEN '{_RULES[2]}' WHEN 3 THEN '{_RULES[3]}' ELSE '{_RULES[4]}' END AS rule, "
    "CASE p_partkey % 5 WHEN 0 THEN 'AA-' || p_partkey || '、AB-' || p_size WHEN 1 THEN 'BA-' || p_partkey WHEN 2 THEN 'CA-' || p_partkey || ', CB-' || p_size WHEN 3 THEN 'DA-' || p_partkey || chr(10) || 'DB-' || p_size ELSE 'EA-' || p_partkey END AS raw_value FROM part"
)
def model_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules that model_extract leaves out, one a file: application and type number in the text, key cell and list in a table; page, rule and cleaned value are compared."""
    part = table(spark, sf_dir, "part").withColumn("doc_id", F.col("p_partkey").cast("string"))
    key, size = F.col("doc_id"), F.col("p_size").cast("string")
    low = F.concat(F.lit("x\nModels: EA-"), key)
    text_ = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("本次申请型号： AA-"), key, F.lit("、AB-"), size, F.lit("。\n差异说明 ZZ-1\n"), low)).when(F.col("p_partkey") % 5 == 1, F.concat(F.lit("Identification / Type no. : For Acme brand: BA-"), key, F.lit(" 220 V~ 50 Hz\nOrder content ZZ-2\n"), low)).otherwise(F.lit("nothing"))
    pages = part.select("doc_id", F.col("doc_id").alias("file_name"), F.lit("").alias("path"), F.lit(1).alias("page"), text_.alias("text"))
    pages = pages.union(part.select("doc_id", "doc_id", F.lit(""), F.lit(2), low)).union(part.select("doc_id", "doc_id", F.lit(""), F.lit(6), F.lit("本次申请型号：XX-9")))
    row = lambda *cells: F.array(*(F.lit(c) if isinstance(c, str) else c for c in cells))
    keyed = F.array(row("Name", "n", ""), row("Models:", F.concat(F.lit("CA-"), key), F.concat(F.lit("CB-"), size)))
    listed = F.array(row("Model", "Brand name"), row(F.concat(F.lit("DA-"), key), "b"), row(F.concat(F.lit("DB-"), size), "b"), row("", "b"), row("DC-1", "b"))
    grid_ = F.when(F.col("p_partkey") % 5 == 2, keyed).when(F.col("p_partkey") % 5 == 3, listed)
    tables = part.select("doc_id", F.lit(1).alias("page"), F.lit(1).alias("table_index"), grid_.alias("grid")).where("grid is not null")
    return models.models(pages, tables).select("file_name", "page", "model", "rule", "raw_value")


@query("SELECT p_partkey, 'QX-' || p_size || 'A; QX-' || p_partkey || 'B' AS models FROM part")
def model_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("For ACME brand: ACME QX-"), F.col("p_size").cast("string"), F.lit("A, QX-\n"), F.col("p_partkey").cast("string"), F.lit("B; rating 5，"), F.col("p_name"), F.lit(" 220-240 V~ QX-9"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(models.split_models(models.clean_value(raw)), "; ").alias("models"))


@query(
    "SELECT p_partkey, 'QX' || p_size || '-A' AS model, CASE p_size % 3 WHEN 0 THEN 12 WHEN 1 THEN 20 ELSE 7 END AS cnt FROM part WHERE p_size % 4 > 1 UNION ALL SELECT p_partkey, 'X1-' || p_partkey, 3 FROM part WHERE p_size % 4 > 1 "
    "UNION ALL SELECT p_partkey, 'X1-' || p_partkey, -1 FROM part WHERE p_size % 4 = 1 UNION ALL SELECT p_partkey, p_name, -1 FROM part WHERE p_size % 4 = 0"
)
def model_count_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, key = F.col("p_size"), F.col("p_partkey").cast("string")
    number = F.when(size % 3 == 0, "十二").when(size % 3 == 1, "二十").otherwise("7")
    raw = F.when(size % 4 > 1, F.concat(F.lit("QX"), size.cast("string"), F.lit("-A样机 "), number, F.lit("台, X1-"), key, F.lit(" 3 台"))).when(size % 4 == 1, F.concat(F.lit("only X1-"), key)).otherwise(F.col("p_name"))
    rows = table(spark, sf_dir, "part").select("p_partkey", raw.alias("detail"))
    return split.split(rows, "detail", "cnt").select("p_partkey", F.col("detail").alias("model"), F.coalesce("cnt", F.lit(-1)).alias("cnt"))


@query("SELECT event_id FROM (SELECT event_id, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS stopped FROM events) WHERE stopped = 0")
def takewhile_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("filled", F.when(F.col("event_type") != "error", F.col("event_type")))
    return split.next_filled(rows, "user_id", "event_id", "filled").select("event_id")


def _scenario_sql() -> str:
    low = f"lower(source || ' ' || {WORDS})"
    cases = "".join(f" WHEN {' OR '.join(f'contains({low}, {chr(39)}{w}{chr(39)})' for w in words)} THEN '{label}'" for words, label in cards.SCENARIOS)
    return f"SELECT doc_id, CASE WHEN regexp_matches({low}, '\\bai\\b') THEN '{cards.AI}'{cases} ELSE '{cards.OTHER}' END AS scenario FROM documents"


@query(_scenario_sql())
def scenario_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", cards.scenario("source", F.regexp_replace("text", "[^\\x00-\\x7F]", "_")).alias("scenario"))


@query("SELECT c_custkey, CASE " + " ".join(f"WHEN c_custkey * 10 >= {s} AND c_nationkey * 30 >= {f} THEN '{label}'" for s, f, label in cards.TIERS) + f" ELSE '{cards.EARLY}' END AS usability FROM customer")
def usability_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", cards.usability(F.col("c_custkey") * 10, F.col("c_nationkey") * 30).alias("usability"))


@query("SELECT page_id, 'o/r' || page_id AS name, 'An AI tool ' || page_id || '.' AS description, page_id * 1000 AS stars, CASE WHEN page_id % 2 = 0 THEN 'Python' ELSE '未知' END AS language FROM pages")
def card_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("page_id").cast("string")
    lang = F.when(F.col("page_id") % 2 == 0, '<span itemprop="programmingLanguage">Python</span>').otherwise("")
    card = F.concat(F.lit('<article class="Box-row x"><h2><a href="/o/r'), key, F.lit('">o / r</a></h2><p class="color-fg-muted"> An\nAI tool '), key, F.lit(".<br></p>"), lang, F.lit('<a href="/o/r/stargazers">'), F.format_number(F.col("page_id") * 1000, 0), F.lit("</a></article>"))
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(F.col("html"), card).alias("html"))
    return cards.cards(pages, keep=("page_id",)).select("page_id", "name", "description", "stars", "language")


@query("SELECT p_partkey, '{\"model\":\"' || p_brand || '\",\"prompt\":\"' || p_name || '\"' || CASE WHEN p_size % 2 = 0 THEN ',\"size\":\"' || p_size || '\"' ELSE '' END || '}' AS payload FROM part")
def payload_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise("")
    return table(spark, sf_dir, "part").select("p_partkey", payload.request_json("p_name", "p_brand", size, F.lit("")).alias("payload"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name END AS image, CASE WHEN p_size % 2 = 0 THEN 'ok' ELSE 'no valid data[0].b64_json' END AS status FROM part")
def response_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = F.concat(F.lit('{"data":[{"b64_json":"'), F.base64(F.col("p_name").cast("binary")), F.lit('"}]}'))
    body = F.when(F.col("p_size") % 2 == 0, good).when(F.col("p_size") % 3 == 0, '{"data":[{"b64_json":"@@@@"}]}').otherwise("{}")
    out = table(spark, sf_dir, "part").withColumn("body", body)
    return out.select("p_partkey", payload.image_bytes("body").cast("string").alias("image"), payload.image_status("body").alias("status"))


@query(
    "SELECT CAST(p_partkey + 1 AS VARCHAR) || '. [' || p_name || '](' || p_brand || ')' AS head, '- 社区指标：' || printf('%,d', p_partkey * 1000) AS stars FROM (SELECT * FROM part ORDER BY p_partkey LIMIT 10)".replace("printf('%,d', p_partkey * 1000)", "CASE WHEN p_partkey = 0 THEN '0' ELSE p_partkey || ',000' END")
)
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's feature is its limit of ten cards."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("at"), F.col("p_name").alias("name"), F.col("p_brand").alias("url"), F.lit("").alias("description"), F.lit("Python").alias("language"), (F.col("p_partkey") * 1000).alias("stars"), F.lit(0).alias("forks"), F.lit(0).alias("stars_today"))
    lines = cards.report(cards.assessed(rows), "at", F.lit("2024-01-02 03:04:05").cast("timestamp"), 10)
    heads = lines.where(F.startswith("line", F.lit("## "))).select(F.substring("line", 4, 1000).alias("head"), F.col("line_no"))
    stars = lines.where(F.startswith("line", F.lit("- 社区指标"))).select(F.split("line", " Stars")[0].alias("stars"), (F.col("line_no") - 4).alias("line_no"))
    return heads.join(stars, "line_no").select("head", "stars")


# ---- sinks and sources


@query("SELECT CAST(quality AS VARCHAR) || '/' || toxic AS status, count(*) AS rows, count(DISTINCT doc_id) AS documents FROM labels GROUP BY ALL")
def status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").withColumn("status", F.concat_ws("/", F.col("quality").cast("string"), F.col("toxic").cast("string")))
    return sheets.run_counts(rows)


@query("SELECT 'c/' || c_custkey || '.pdf' AS path, 'c/' || c_custkey || '.xlsx' AS output FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def existing_output_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda c, end: F.concat(F.lit("c/"), F.col(c).cast("string"), F.lit(end))
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(name("o_custkey", ".xlsx").alias("path")).distinct()
    return sheets.pending(table(spark, sf_dir, "customer").select(name("c_custkey", ".pdf").alias("path")), done)


@query("SELECT CAST(least(greatest(max(length(CAST(p_partkey AS VARCHAR))) + 2, 12), 60) AS INTEGER) AS p_partkey, CAST(least(greatest(max(length(p_name)) + 2, 12), 60) AS INTEGER) AS p_name, CAST(least(greatest(max(length(p_type)) + 2, 12), 60) AS INTEGER) AS p_type FROM part")
def column_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets.column_widths(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type"))


@query("SELECT doc_id, CAST(least(180, 15 * (length(text) - length(replace(text, chr(10), '')) + 1)) AS INTEGER) AS height FROM documents")
def row_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", sheets.row_height([F.col("text")]).alias("height"))


@query(f"SELECT left('T1_pdfplumber_lines_p' || (l_orderkey % 50 + 1), 31) AS sheet, CAST(n AS INTEGER) AS rows, CAST(cols AS INTEGER) AS cols, CAST(l_orderkey AS VARCHAR) AS doc_id FROM {SCORED}")
def table_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = grid.select(order_tables(spark, sf_dir), Config(min_score=-100.0, dedup=False))
    return sheets.summary(sheets.with_sheet_names(found)).select("sheet", "rows", "cols", "doc_id")


@query("SELECT conv_id, turn FROM conversations WHERE turn = 1 OR turn BETWEEN 3 AND 5")
def page_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where(files.on_pages("1,3-5", "turn")).select("conv_id", "turn")


@query("SELECT 'KEY_' || p_partkey AS key, p_name || '=' || p_size AS value FROM part WHERE p_size % 2 = 0")
def settings_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.when(F.col("p_size") % 2 == 0, "").otherwise("# "), F.lit(" KEY_"), F.col("p_partkey").cast("string"), F.lit(' = "'), F.col("p_name"), F.lit("="), F.col("p_size").cast("string"), F.lit('" '))
    return files.settings(table(spark, sf_dir, "part").select(line.alias("value")))


from . import book_queries  # noqa: E402, F401  registers its queries
