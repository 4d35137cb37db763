"""The corpus pipeline: stages over the documents, each written as Parquet and read again before the next.

Every stage takes (spark, docs, sf_dir) and returns the columns of documents; the last one returns the packed pieces.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceloom.llm import linededup, mixing, neardup, packing, toxicity
from sourceloom.llm.queries import MIX, domain_of_source, table
from sourceloom.session import shared_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity of 0.5 or more go. The model is fitted on labelled rows that are not held out."""
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out))
    return _documents(toxicity.scored(_documents(docs), model).where("toxicity < 0.5"))


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of ten or more documents go from all of them; n_chars follows the text."""
    kept = linededup.dedup_lines(_documents(docs), min_docs=10)
    return _documents(kept.withColumn("n_chars", F.length("text").cast("bigint")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class stays; texts without words are only copies of equal ones."""
    return _documents(neardup.first_of_class(_documents(docs)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the target mix; those that a leaf's budget needs in several epochs come several times."""
    return _documents(mixing.mixed_documents(_documents(docs), MIX, domain_of_source()))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2,048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048)


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", drop_common_lines),
    ("near dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Learned scores, sampled candidates and packing are beyond SQL; the stages are tested against brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, with each stage's rows written to the cluster's shared folder and read back."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
