"""Extraction as files arrive: an addition, since documents come whole and need no state between batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from ..config import Config
from ..operators import grid, phases
from ..schemas import CELLS, TARGET_COLUMNS


def arriving_cells(spark: SparkSession, path: str, files: int = 1000) -> DataFrame:
    """The cell relation of Parquet files that land in a folder, at most ``files`` a batch."""
    return spark.readStream.schema(CELLS).option("maxFilesPerTrigger", files).parquet(path)


def extract_stream(cells: DataFrame, target: str, checkpoint: str, config: Config = Config()) -> DataStreamWriter:
    """A writer whose batches append target records to ``target``; a document's cells must arrive in one file. Each batch has a folder of its own, so a repeated batch replaces its rows."""

    def batch(rows: DataFrame, number: int) -> None:
        found = phases.extract(grid.engine_union(grid.grids(rows)), config)
        found.select("doc_id", *TARGET_COLUMNS).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return cells.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
