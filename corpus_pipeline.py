"""Training-corpus pipeline: toxicity, near duplicates, repeated passages, source mix, piece encoding.

Each stage takes (spark, docs, sf_dir) with the columns of ``documents`` and works on all rows its
predecessor kept; all but the last return the same columns. Nulls, empty texts and empty tables pass as the
operators define: texts without words are not toxic by themselves, are no duplicates, lose no words, weigh
nothing in the mix and encode to no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbline.llm.common import settle
from curbline.llm.mixing import mix_sources
from curbline.llm.neardup import keep_one
from curbline.llm.pieces import encode_pieces
from curbline.llm.substring import dedup_substrings
from curbline.llm.toxicity import toxicity_score, train_toxicity

TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below ``TOXIC``; the model learns from all labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train_toxicity(docs, labels)
    return docs.where(toxicity_score(spark, model, F.col("text")) < TOXIC)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class."""
    return keep_one(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 35 words or more that occur elsewhere; n_chars follows the text."""
    return dedup_substrings(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the source mix takes them."""
    return mix_sources(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every row, with the scores of its best segmentations."""
    return encode_pieces(docs, keep=("doc_id", "source"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("mixing", mix),
    ("sentencepiece", encode),
]

#: SQL can't express the stages; tests compare their operators with brute force, and follow planted texts through them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
