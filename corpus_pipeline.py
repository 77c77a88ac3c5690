"""A corpus pipeline in five stages, each an operator of tablesmith.llm applied to what the stage before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesmith.llm import language, packing, pii, quality, simjoin
from tablesmith.llm.common import BATCH_ROWS, durable, free_prefix, read
from tablesmith.llm.queries import vocabulary

#: Near-duplicates share this percentage of their n-grams of so many words.
NEAR_WORDS, NEAR_PERCENT = 5, 80
#: Rows that travel to a Python worker at a time. Rows are whole texts here, so Spark's default of 10,000 would be large.
BATCH = 500


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier, trained on ``labels``, rejects.

    Null and empty texts are scored like any other; rows that share an id are judged each by its own text. Without a
    label that fits, every score is 0.5 and all rows stay. An empty table stays empty.
    """
    _bounded(spark)
    model = quality.fit(docs, read(spark, sf_dir, "labels", "doc_id", "quality"))
    mine = free_prefix(docs)
    return quality.score(docs, model, prefix=mine).where(f"`{mine}predicted` = 1").select(*_same(docs))


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that language identification, trained on their own ``lang``, rejects: no letter (null and empty texts too), or no language seen.

    Without a row that has a language there is no model and all rows go. Repeated rows are judged each.
    """
    _bounded(spark)
    mine = free_prefix(docs)
    return language.identify(docs, language.fit(docs), prefix=mine).where(f"not `{mine}rejected`").select(*_same(docs))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: the one of least id, the first as read of rows that share it.

    Rows are numbered, so of rows with one id only those go whose texts are near another's, and a row without an id stays
    where no row of its group has one. Texts without words are near nothing: rows with them all stay.
    """
    _bounded(spark)
    mine = free_prefix(docs)
    row = f"{mine}row"
    named = durable(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = simjoin.similar(named.select(row, "text"), NEAR_WORDS, NEAR_PERCENT, id_col=row)
    first = F.min_by(row, F.struct(F.col("doc_id").isNull(), "doc_id", row)).alias(row)
    stay = found.join(named.select(row, "doc_id"), row).groupBy("component_id").agg(first).select(row)
    return named.join(stay, row, "left_semi").select(*_same(docs))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in every text by its kind in brackets; n_chars follows. Null and empty texts stay as they are, and so do null n_chars; repeated rows are masked each."""
    _bounded(spark)
    mine, rest = free_prefix(docs), [c for c in docs.columns if c != "text"]
    out = pii.find(docs.withColumnsRenamed({c: f"{mine}{k}" for k, c in enumerate(rest)}), pii.fit(docs), keep=[f"{mine}{k}" for k in range(len(rest))], redact=True)
    out = out.select(F.col("redacted").alias("text"), *(F.col(f"{mine}{k}").alias(c) for k, c in enumerate(rest)))
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType))).select(*_same(docs))


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenizes all documents and packs them into sequences. Null and empty texts are one end id; repeated rows are packed each; an empty table gives no piece."""
    _bounded(spark)
    return packing.pack(packing.pieces(docs, vocabulary("byte_bpe_50k.json")))


def _bounded(spark: SparkSession) -> None:
    """From now on this application's batches are small; its stages are written by whoever calls them."""
    spark.conf.set(BATCH_ROWS, BATCH)


def _same(docs: DataFrame) -> list[str]:
    return [f"`{c}`" for c in docs.columns]


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_good),
    ("language ID", keep_known_language),
    ("n-gram Jaccard join", keep_one_of_each),
    ("PII", mask_personal_data),
    ("packing", pack_tokens),
]

#: Trained models and tokenizers are beyond SQL; tests/llm/test_pipeline.py compares the stages with plain references.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each written as Parquet to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
