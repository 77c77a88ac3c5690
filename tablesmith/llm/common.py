"""What several operators share: scratch tables, the learn/hold-out rule, UTF-8 buffers and class ids over links."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task works on at a time; numpy's temporaries are a small multiple of it.
CHUNK_BYTES = 1_000_000
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session, whose tasks all run on this machine, may go without."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="spark-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def durable(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts lineage, survives lost executors, and is computed once however often it is used."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    # nothing reads this query's shuffle files after its table is written; small batches keep texts and sets in bounds
    wanted = {DROP_SHUFFLES: "true", BATCH_ROWS: "500"}
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables of :func:`durable` that nothing will read any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.scratch_path)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def sampled(df: DataFrame, id_col: str, limit: int, total: int | None = None) -> DataFrame:
    """At most ``limit`` rows, those of least hashed id (all ties of an id alike). ``total``, at least the number of rows, lets all but about twice the limit go before anything is sorted."""
    total = df.count() if total is None else total
    order = F.xxhash64(id_col)
    share = (2 * limit + 200) / max(total, 1)
    if share < 1:
        df = df.where(order < int(-(2**63) + 2**64 * share))
    return df.orderBy(order, id_col).limit(limit)


def free_prefix(df: DataFrame) -> str:
    """A prefix that no column of ``df`` begins with: names made with it clash with none."""
    out = "__"
    while any(c.lower().startswith(out) for c in df.columns):
        out += "_"
    return out


def held_out(doc_id: Column | str) -> Column:
    """True for the third of the documents that nothing is learned from: crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 3 == 1, F.lit(False))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, one text after the other, and the len + 1 places where they begin; null is empty."""
    filled = pc.fill_null(column, "").cast(pa.large_binary())
    _, places, data = filled.buffers()
    starts = np.frombuffer(places, np.int64)[filled.offset : filled.offset + len(filled) + 1] if len(filled) else np.zeros(1, np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[starts[0] : starts[-1]], starts - starts[0]


def spans_of(starts: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes together; a longer text has a range of its own."""
    first, last = 0, len(starts) - 1
    while first < last:
        end = int(np.searchsorted(starts, starts[first] + limit, side="right")) - 1
        end = min(max(end, first + 1), last)
        yield first, end
        first = end


def whole_runs(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """The same rows, sorted by ``column`` (bigint), in tables that no run of equal values reaches beyond."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        value = batch.column(column).to_numpy()
        last = int(np.searchsorted(value, value[-1])) if len(value) else 0
        if last or held and len(value) and held[-1].column(column)[-1].as_py() != value[0]:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        if len(value):
            held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def row_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over [starts[i], starts[i + 1]), empty ranges included."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), np.float64), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[starts[1:]] - total[starts[:-1]]


def classes(links: DataFrame, name: str = "classes", most_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable over ``links`` (a, b), for every node that has a link.

    Alternates the large-star and small-star steps on an edge table that shrinks towards stars, so the rounds grow
    with the logarithm of the longest chain. Hubs are pre-aggregated before the shuffle, and the join that sends the
    minimum back is an ordinary equi-join whose skewed partitions adaptive execution splits.
    """
    edges = durable(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    before = None
    for _ in range(most_rounds):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = durable(small, name)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"class ids over links did not settle in {most_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def with_text(df: DataFrame, added: list[pa.Field], work: Callable[[pa.Array], list[pa.Array]], text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``df``'s columns (``keep``: only those) and the ``added`` ones, which ``work`` makes of a run of texts. A clashing column is replaced."""
    from pyspark.sql.pandas.types import from_arrow_type

    names = [f.name for f in added]
    stay = [c for c in (df.columns if keep is None else keep) if c not in names]
    schema = df.select(*(f"`{c}`" for c in stay)).schema
    at = stay.index(text_col) if text_col in stay and schema[text_col].dataType.simpleString() == "string" else len(stay)
    for f in added:
        schema = schema.add(f.name, from_arrow_type(f.type))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(at)
            _, starts = utf8(text)
            for i, j in spans_of(starts):
                new = work(text.slice(i, j - i))
                old = [batch.column(k).slice(i, j - i) for k in range(len(stay))]
                yield pa.RecordBatch.from_arrays([*old, *new], [*stay, *names])

    text = [] if at < len(stay) else [F.col(f"`{text_col}`").cast("string").alias("__text")]
    return df.select(*(f"`{c}`" for c in stay), *text).mapInArrow(run, schema)
