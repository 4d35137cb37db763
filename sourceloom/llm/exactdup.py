"""Exact deduplication: groups by a 128-bit content hash, whose members are compared byte by byte. JVM functions only.

Two texts are equal when they are identical without white space (``[\\x20\\x09-\\x0D]``). Of equal texts the row with the most
code points in its original text stays, then the one with the smallest id.

Defined results: a null text counts as empty; an empty table gives an empty table; a null id is the last choice among ties
and is its own keeper only in a group of null ids. An id names a document: repeated rows of a kept id are all ``kept``, and
each counts in ``group_size``. Other columns are never read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceloom.llm.common import BLANKS, digest128, saved, text_or_empty


def _best() -> list[Column]:
    """Of a group: number of rows, and what the keeper is chosen by."""
    return [F.count(F.lit(1)).alias("group_size"), F.min(F.struct(-F.col("points"), F.col("id").isNull(), F.col("id").alias("keep_id"))).alias("best")]


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", content_hash: Callable[[Column], Column] = digest128
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of ``docs``.

    The rows are reduced to hashes first, and groups are minima and counts taken before the shuffle, so a group with a
    third of all rows is no hot task. Only members of groups of two or more send their text, each to be compared with the
    text of its group's keeper; a join whose large keys Spark splits. Groups in which a text differs (a hash collision) are
    formed again by the bytes themselves.
    """
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    texts = texts.withColumn("norm", F.regexp_replace("text", BLANKS + "+", "")).withColumn("hash", content_hash(F.col("norm")))
    keys = saved(texts.select("id", "hash", F.unhex(F.sha2("norm", 256)).alias("sha"), F.length("text").alias("points")))
    groups = saved(keys.groupBy("hash").agg(*_best()).select("hash", "group_size", "best.keep_id"))

    several = groups.where("group_size > 1").select("hash", "keep_id")
    members = saved(texts.select("id", "hash", "norm").join(several, "hash").select("hash", "norm", F.col("id").eqNullSafe(F.col("keep_id")).alias("keeper")))
    keepers = saved(members.where("keeper").groupBy("hash").agg(F.first("norm").alias("kept_norm")))
    collided = saved(members.join(keepers, "hash").where("norm <> kept_norm").select("hash"))

    grouped = keys.join(groups, "hash")
    if not collided.isEmpty():
        collided = saved(collided.distinct())
        apart = texts.join(collided, "hash").select("id", "hash", "norm", F.unhex(F.sha2("norm", 256)).alias("sha"), F.length("text").alias("points"))
        exact = apart.groupBy("hash", "norm").agg(*_best()).select("hash", "norm", "group_size", "best.keep_id")
        apart = apart.join(exact, ["hash", "norm"]).select("id", "sha", "group_size", "keep_id")
        grouped = grouped.join(collided, "hash", "left_anti").select("id", "sha", "group_size", "keep_id").unionByName(apart)
    return grouped.select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
