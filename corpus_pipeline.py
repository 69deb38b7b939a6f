"""A corpus from raw documents to training sequences.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before
it kept; its result is written as Parquet and reread as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripcast.durable import stored
from tripcast.llm import lines, packing, quality, shingles
from tripcast.llm.arrow import fresh


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier accepts."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    (score,) = fresh(docs, "score")
    return quality.score(docs, model, name=score).filter(F.col(score) >= quality.ACCEPT).drop(score)


def remove_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many sites share."""
    clean = lines.remove_spread_lines(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast("long"))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, Jaccard
    similarity of 0.8 or more, candidates by SimHash anchors. The contract of four words and 4 bits is op2's."""
    return shingles.keep_one(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_classifier", classify_quality),
    ("line_dedup", remove_boilerplate),
    ("simhash_near_dedup", remove_near_duplicates),
    ("best_fit_packing", pack_sequences),
]

ORACLE_SQL = None     # compressed sizes, 64-bit hashes of shingles and token ids are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
