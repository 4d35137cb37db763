"""Ordered look-back over keys of any size, as a segmented scan.

A window partitioned by a hot key would put all of its rows in one task. Here rows are dealt by ranges of (key, time, tie), so a key
with many rows, even all of one time, is spread over many ranges. Each range is scanned on its own. Only a range's first key can have
rows in earlier ranges: what it finds there is one small row for each range, carried over by a running value along the ranges.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import saved

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

#: Columns of the scan, of names no input has.
_PART, _RUN, _ROW = "__part", "__run", "__row"


def _scan(at: int, found: list[int]):
    """Of sorted batches: number of the range, of the key inside it and of the row; and for each of the columns ``found`` its last
    value on an earlier row of the key, and on this or an earlier one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, runs, rows = TaskContext.get().partitionId(), (), -1, 0
        kept: list[pa.Array] = []  # of each column, what it has last for the last key
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            codes = batch.column(at).dictionary_encode(null_encoding="encode")
            keys, codes = codes.dictionary.to_pylist(), codes.indices.to_numpy()
            starts = np.flatnonzero(np.diff(codes, prepend=-1))
            sizes = np.diff(np.append(starts, n))
            goes_on = (keys[codes[0]],) == last
            run_of = np.repeat(np.arange(len(starts)), sizes) + runs + (not goes_on)
            start_of = np.repeat(starts, sizes)
            columns, ends = [], []
            for k, place in enumerate(found):
                values = batch.column(place)
                one = kept[k] if goes_on else pa.nulls(1, values.type)
                both = pa.concat_arrays([one, values])  # place 0: what earlier batches left for the first key
                known = np.where(np.asarray(values.is_valid()), np.arange(1, n + 1), 0)
                seen = np.maximum.accumulate(known)
                seen = np.where(seen > start_of, seen, np.where(start_of == 0, 0, -1))  # of another key: none
                before = np.concatenate([[0], seen[:-1]])
                before[starts] = np.where(starts == 0, 0, -1)
                for index in (before, seen):
                    columns.append(both.take(pa.array(index, mask=index < 0)))
                ends.append(columns[-1].slice(n - 1, 1))
            kept, last, runs = ends, (keys[codes[-1]],), int(run_of[-1])
            numbers = [pa.array(np.full(n, part, np.int32)), pa.array(run_of.astype(np.int64)), pa.array(np.arange(rows, rows + n))]
            rows += n
            names = [*batch.schema.names, _PART, _RUN, _ROW, *[f"__{kind}{k}" for k in range(len(found)) for kind in ("before", "upto")]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *numbers, *columns], names)

    return run


def last_before(rows: DataFrame, key: str, ts: str, tie: str, values: dict[str, Column], tasks: int | None = None) -> DataFrame:
    """Adds, per named expression, its last non-null value on an earlier row of the same key (by ``ts``, ``tie``).

    Nulls of ``ts`` and ``tie`` come first; rows that are equal in all three are ordered by a hash of the whole row. The scanned
    rows are written once to the shared folder, so a repeated task sees the same ranges.
    """
    spark = rows.sparkSession
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    given = rows.select("*", *[v.alias(f"__value{k}") for k, v in enumerate(values.values())])
    order = [F.col(key), F.col(ts), F.col(tie), F.xxhash64(*rows.columns)]
    dealt = given.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    kinds = [given.schema[f"__value{k}"].dataType.simpleString() for k in range(len(values))]
    extra = [f"{_PART} int", f"{_RUN} bigint", f"{_ROW} bigint", *[f"__{kind}{k} {t}" for k, t in enumerate(kinds) for kind in ("before", "upto")]]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields]
    scan = _scan(given.columns.index(key), [given.columns.index(f"__value{k}") for k in range(len(values))])
    scanned = saved(dealt.mapInArrow(scan, ", ".join(fields + extra)))

    # of each range: its first key, and what it leaves for the last one
    upto = [F.max_by(f"__upto{k}", _ROW).alias(f"left{k}") for k in range(len(values))]
    ends = scanned.groupBy(_PART).agg(F.min_by(key, _ROW).alias("first"), F.max_by(key, _ROW).alias("last"), *upto)
    left = ends.select(_PART, F.col("last").alias("of"), F.lit(1).alias("own"), *[f"left{k}" for k in range(len(values))])
    asked = ends.select(_PART, F.col("first").alias("of"), F.lit(0).alias("own"), *[F.lit(None).cast(t).alias(f"left{k}") for k, t in enumerate(kinds)])
    earlier = W.partitionBy("of").orderBy(_PART, "own").rowsBetween(W.unboundedPreceding, -1)
    carried = left.unionByName(asked).select(
        F.col(_PART).alias("range"), "own", *[F.last(f"left{k}", True).over(earlier).alias(f"carried{k}") for k in range(len(values))]
    )
    joined = scanned.join(F.broadcast(carried.where("own = 0")), F.col(_PART) == F.col("range"))  # one row for each range
    first = F.col(_RUN) == 0
    found = [F.coalesce(f"__before{k}", F.when(first, F.col(f"carried{k}"))).alias(n) for k, n in enumerate(values)]
    return joined.select(*rows.columns, *found)
