"""Places of rows in the order of their group, without one task for a group."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourceloom.llm.common import saved, ship, tasks

#: Name of the column that breaks ties between equal rows; of names no input has.
_TIE = "__tie"


def placed(rows: DataFrame, group: str, order: Sequence[Column], name: str = "place") -> DataFrame:
    """``rows`` with the place (from 0) of each row in its group.

    Rows are dealt by ranges of (group, order) and sorted, and numbered inside their range. Only a range's first group can have
    rows in earlier ranges, so what the numbers are moved on by is one row for each range, which is broadcast. A group with most
    of the rows is spread over many ranges; equal rows too, as the number of a row among the given ones breaks ties. The numbered
    rows are written once, so a place does not change when tasks are repeated.
    """
    spark = rows.sparkSession
    ship(spark)
    given = saved(rows).withColumn(_TIE, F.monotonically_increasing_id())
    keys = [F.col(group).asc_nulls_first(), *order, F.col(_TIE)]
    dealt = given.repartitionByRange(tasks(spark), *keys).sortWithinPartitions(*keys).drop(_TIE)
    at = dealt.columns.index(group)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen, groups = TaskContext.get().partitionId(), (), 0, -1
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column(at).dictionary_encode(null_encoding="encode")
            values, codes = codes.dictionary.to_pylist(), codes.indices.to_numpy()
            starts = np.flatnonzero(np.diff(codes, prepend=-1))
            sizes = np.diff(np.append(starts, len(codes)))
            inside = np.arange(len(codes)) - np.repeat(starts, sizes)
            goes_on = (values[codes[0]],) == last
            if goes_on:
                inside[: sizes[0]] += seen
            number_of_group = np.repeat(np.arange(len(starts)), sizes) + groups + (not goes_on)
            seen = int(inside[-1]) + 1
            groups = int(number_of_group[-1])
            last = (values[codes[-1]],)
            columns = [np.full(len(codes), part, np.int32), number_of_group.astype(np.int64), inside.astype(np.int64)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, columns)], [*batch.schema.names, "__part", "__nth", "__inside"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields)
    numbered = saved(dealt.mapInArrow(number, f"{fields}, __part int, __nth bigint, __inside bigint"))
    # of each range its first group, and the last one with its rows there
    where = F.struct("__nth", "__inside")
    ends = numbered.groupBy("__part").agg(F.min_by(group, where).alias("first"), F.max_by(F.struct(F.col(group).alias("g"), "__inside"), where).alias("last"))
    known = ends.select("__part", F.col("last.g").alias("g"), (F.col("last.__inside") + 1).alias("n"), F.lit(1).alias("own"))
    asked = ends.select("__part", F.col("first").alias("g"), F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("own"))
    earlier = Window.partitionBy("g").orderBy("__part", "own").rowsBetween(Window.unboundedPreceding, -1)
    moves = known.unionByName(asked).withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).where("own = 0")
    moves = moves.select(F.col("__part").alias("__range"), "before")
    joined = numbered.join(F.broadcast(moves), F.col("__part") == F.col("__range"))  # one row for each range
    move = F.when(F.col("__nth") == 0, F.col("before")).otherwise(0)
    return joined.withColumn(name, F.col("__inside") + move).select(*rows.columns, name)
