"""A corpus pipeline in stages: each reads the documents that its predecessor wrote.

Every stage but the last returns the documents' own columns. Null texts and repeated rows pass as the operators define
(see their docstrings); columns beyond the five of ``documents`` are dropped at the start.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.llm import config_packing, minhash_components, pii_spans, quality_fm, raking
from tidemark.llm.texts import read
from tidemark.session import scratch_path, settle

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Share of all tokens that the mixture keeps, in expectation. No document is taken twice, so scarce categories stay below
#: their targets; the shares that are reached are logged.
KEEP = 0.9
#: Similarity from which the near-duplicate stage takes two documents for copies of each other; op9 itself takes 85.
PERCENT = 80


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; it is fitted on the labelled rows among those it is given."""
    docs = docs.select(*COLUMNS)
    return quality_fm.accepted(docs, quality_fm.train(docs, read(spark, sf_dir, "labels")))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near duplicates the document with the smallest id stays.

    Rows that repeat an id are one document, of which the row with the smallest text stays. Rows without an id stay.
    """
    docs = docs.select(*COLUMNS)
    gone = minhash_components.components(docs, PERCENT).where(~F.col("kept")).select("doc_id").distinct()
    left = minhash_components.without_ids(docs, gone)
    repeated = settle(left.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id"))
    if repeated.isEmpty():
        return left
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("text", "lang", "source", "n_chars"))
    one = left.join(repeated, "doc_id", "left_semi").withColumn("__rank", rank).where("__rank = 1").select(*COLUMNS)
    return minhash_components.without_ids(left, repeated).unionByName(one)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii_spans.redact(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    mix = raking.plan_mix(docs, keep=KEEP)
    raking.report(mix)
    return raking.sample(docs, mix)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return config_packing.pack(docs.select(*COLUMNS))


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each),
    ("personal_data", mask_personal_data),
    ("mixture", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; between stages they are written as Parquet and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


# Trained scores, token ids and a linear program are beyond SQL; the stages are tested against brute force.
ORACLE_SQL: str | None = None
