"""A training corpus from raw documents: toxic texts go, then exact and near copies; sources are mixed to their
target weights, and what is left is packed into sequences.

Defined results, of each stage and so of all: an empty table stays empty; null and empty texts count as texts without words
(they are not toxic, equal each other as exact copies, have no near copies, weigh nothing in a source and pack as one end
token); very long texts are read whole; a null id is a document like any other, but has no near copies; rows that repeat
an id and its text are one document from the second stage on, and texts that share an id are told apart by their text; all
columns, whatever their names, come through all stages but the last as they were. packed() gives a row for each piece, with
block, sequence, length, used, slot, at, doc_id, start and tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelwright.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from panelwright.llm.common import new_path


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold, by a model of the labelled rows."""
    labels = toxicity.training_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels))


def exact_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (but for white space) the longest, then that with the smallest id."""
    return exact_dedup.drop_exact_copies(docs)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by 80 % of their five-word shingles the one with the smallest id."""
    return near_dedup.drop_near_copies(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every copy drawn is a row; a document may come several times."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", toxic_out),
    ("exact_dedup", exact_copies_out),
    ("near_dedup", near_copies_out),
    ("mixing", mixed_sources),
    ("packing", packed),
]

#: The toxicity model is learned and the signatures are random: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
