"""Placement of rows for work that costs far more per byte than a shuffle."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window as W, functions as F

#: Bytes of input, as the files count them, that one task works on at most. Files are compressed, the code derived from them is some
#: times larger than their text, and it is sorted in rows: a task's share of these is a hundred times as large.
TASK_BYTES = 4 << 20
#: Larger estimates mean that Spark knows no size.
_UNKNOWN = 1 << 60


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows hash-placed by key over ``spark.sql.shuffle.partitions`` tasks, or more where the input is large.

    The number is explicit because adaptive execution sizes partitions by bytes. Parsing text is bound by
    the processor, and merging small partitions would leave most cores idle. The size of the files that are read raises the number,
    so that tasks do not grow with the data. Estimates behind a join would not do: they multiply its sides.
    """
    number = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    size = sum(x for x in sizes if x < _UNKNOWN)
    return rows.repartition(max(number, math.ceil(size / TASK_BYTES)), *keys)


def with_copies(files: DataFrame) -> DataFrame:
    """Files placed by path, those of a path behind each other, with the number of files that have it as last column."""
    return files.withColumn("copies", F.count(F.lit(1)).over(W.partitionBy("path")).cast("int"))


def by_copies(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files placed by path: those whose path stands once, and those that share it with others, which are read as one file."""
    counted = with_copies(files)
    return counted.where("copies = 1").drop("copies"), counted.where("copies > 1").drop("copies")
