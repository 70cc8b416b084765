"""From raw documents to a mix: toxic documents go, one document of each group of near
copies stays, documents with benchmark passages go, personal data is taken out, and what
is left is mixed from its sources by weight.

Each stage reads what the one before it kept, written as Parquet in between. All stages but
the last return the columns of documents; further columns of the input are not carried. A
stage takes null ids, texts and sources and empty tables as its operator does.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phrasestream.llm import decontaminate, jaccard_join, mixing, pii, toxicity
from phrasestream.llm import words as W
from phrasestream.plans.stage import shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the model (fitted on the labels of this input) does not call toxic."""
    rows = W.text_frame(docs, *COLUMNS)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(rows, labels, W.fold_of(F.col("_id")) != 0)
    return toxicity.score(rows, model).filter("_predicted = 0").select(*COLUMNS)


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near copies. Repeated rows of one
    id stay together; documents without words or without id are no copies of anything."""
    rows = W.text_frame(docs, *COLUMNS)
    classes = jaccard_join.similar_documents(rows)
    gone = classes.filter("doc_id != class_id").select(F.col("doc_id").alias("_id")).distinct()
    return rows.join(gone, F.col("doc_id") == F.col("_id"), "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no passage is a benchmark item's."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.clean(W.text_frame(docs, *COLUMNS), benchmark)


def take_out_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with marks in place of personal data; n_chars is that of the new text."""
    rows = pii.sanitised(W.text_frame(docs, *COLUMNS))
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document left: doc_id, source, size, source_size, target, taken."""
    return mixing.mix(docs)


STAGES = [
    ("drop_toxic", drop_toxic),
    ("keep_one_of_group", keep_one_of_group),
    ("drop_contaminated", drop_contaminated),
    ("take_out_personal_data", take_out_personal_data),
    ("mix_sources", mix_sources),
]

#: A fitted model and a recall aimed at are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
