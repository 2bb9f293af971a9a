"""A corpus from raw documents: toxic ones go, then exact copies, then near copies; what stays is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents. A stage's own intermediate tables are removed once it is written.

Null and empty texts aren't toxic, are copies of each other, near no text, and packed as their end id. Rows without an id
stay unless they are toxic or exact copies. Ties: of equal texts the largest id stays, of similar ones the smallest.
Very long texts are read whole. An empty table gives no rows. Columns beyond those of documents, whatever their names,
pass all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm import exact_dedup, jaccard_forest, packing, toxicity
from tallymark.llm.common import fresh_path, scratch
from tallymark.llm.queries import table, tokenizer_file


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold; those without words stay."""
    net = toxicity.train(*toxicity.labelled_sample(docs, table(spark, sf_dir, "labels")))
    score = "_toxicity"
    while score in docs.columns:
        score += "_"
    scored = toxicity.with_scores(docs, net, docs.columns, score)
    return scored.where(F.col(score) < toxicity.THRESHOLD).select(*[F.col(f"`{c}`") for c in docs.columns])


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return exact_dedup.drop_exact_copies(docs)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of similar texts the document with the smallest id."""
    return jaccard_forest.drop_near_copies(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids in sequences."""
    return packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("toxicity", keep_clean),
    ("exact_dedup", keep_one_copy),
    ("near_copies", keep_one_of_near_copies),
    ("packing", pack),
]

#: A trained network can't be put in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        with scratch(spark):  # a stage's intermediate tables go when its result is written
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
