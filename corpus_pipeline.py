"""The corpus pipeline: toxicity, near duplicates, secrets, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the docs of the next. All but the last return the columns of documents. run() starts from the
documents of a folder of tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import jaccard_join, mixing, packing, secrets, toxicity
from tideline.llm.common import fold, fresh, shared_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the convolutional classifier scores below its threshold.

    It learns from the labels of the tables, those of the held-out fold excepted.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(fold(3) != 1)
    model = toxicity.fit(docs, labels)
    column = fresh("score", docs.columns)
    return toxicity.score(docs, model, column).filter(F.col(column) < toxicity.THRESHOLD).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the exact Jaccard join: that of the smallest id."""
    return jaccard_join.deduplicate(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets masked; none is dropped."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled by the calibrated probability of their source, language and topic."""
    return mixing.weighted(docs).filter(F.col(mixing.names(docs)["sampled"])).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and the bins they are packed in."""
    return packing.best_fit(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixture", mix_sources),
    ("packing", pack_sequences),
]

#: The classifier, the raking and the packing are no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
