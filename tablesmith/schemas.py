"""Fixed schemas and the order of the target fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The six target fields and the output columns, in order.
TARGET_FIELDS = ("object_part_no", "manufacturer_trademark", "type_model", "technical_data", "standard", "marks_of_conformity")
TARGET_COLUMNS = ("page", "table_index_on_page", "row_index_on_table", "engine", "row_type", "section_title", "product_model", *TARGET_FIELDS)

CELLS = "doc_id string, engine string, page int, table_index int, row_index int, col_index int, value string"
PAGE_TEXT = "doc_id string, file_name string, path string, page int, text string"
SHEET_ROWS = "sheet string, row_index int, values array<string>"
CARDS = "name string, url string, description string, language string, stars bigint, forks bigint, stars_today bigint"
TARGET = "page int, table_index_on_page int, row_index_on_table int, engine string, row_type string, section_title string, product_model string, " + ", ".join(f"{f} string" for f in TARGET_FIELDS)
MODELS = "file_name string, path string, page int, model string, rule string, raw_value string, status string, note string"
RECORDS = "array<struct<row:int,row_type:string,section_title:string,product_model:string,f:array<string>>>"


def empty_target(spark: SparkSession) -> DataFrame:
    """A typed empty result."""
    return spark.createDataFrame([], TARGET)
