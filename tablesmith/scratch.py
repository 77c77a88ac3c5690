"""Tables that are written once to the folder that driver and executors share, and deleted by their owner."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWNERS: list[list[str]] = []


def scratch_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Only a local session, whose tasks all run on this machine, may go without."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="spark-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else has. Within :func:`owned` it goes when the owner ends."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _OWNERS:
        _OWNERS[-1].append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


@contextmanager
def owned(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, every scratch table that was written within it, also after an error. Results are lazy and read these tables: write them within.

    with owned(spark):
        phases.ordered(phases.extract(tables)).write.parquet(path)
    """
    _OWNERS.append([])
    try:
        yield
    finally:
        for path in _OWNERS.pop():
            delete(spark, path)


# Settings of a write. Its shuffle files are deleted when it has ended, as nothing reads them again; tasks hold a few bucket files open
# instead of sorting rows by bucket; tables in the same buckets are joined as they lie, also on further columns.
DROP_SHUFFLES, OPEN_FILES, ALL_KEYS = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.maxConcurrentOutputFileWriters", "spark.sql.requireAllClusterKeysForCoPartition"
WRITING = {DROP_SHUFFLES: "true", OPEN_FILES: "8", ALL_KEYS: "false"}


def written(df: DataFrame, name: str, by: str = "doc_id") -> DataFrame:
    """``df`` written and read back: cuts lineage, survives lost executors, and is computed once however often it is used.

    A table with the column ``by`` is bucketed by it: windows and groups of documents, and joins of such tables on it,
    shuffle nothing; neither do joins on it and other columns whose result is written. Buckets are known to the catalog
    only, which forgets the table at once; its files stay.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = {k: spark.conf.get(k) for k in WRITING}
    out = df.write.option("compression", "zstd")
    try:
        for k, v in WRITING.items():
            spark.conf.set(k, v)
        if by not in df.columns:
            out.parquet(path)
            return spark.read.schema(df.schema).parquet(path)
        table = f"scratch_{uuid.uuid4().hex}"
        out.format("parquet").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), by).option("path", path).saveAsTable(table)
        found = spark.table(table).select("*")
        spark.sql(f"DROP TABLE {table}")
        return found
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
