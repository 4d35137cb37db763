"""Best-fit packing of documents into token sequences, large items first.

A document is its token ids and one end id. Only documents longer than a sequence are cut: into full sequences, with the shorter
rest as the first piece. Pieces are packed into as few sequences as the rule finds:

- large items (over a third of the capacity) go at most two to a sequence: from the longest on, each is matched with the longest
  other large one that fits, which leaves the fewest sequences for such items;
- the rest go, from the longest on, into the sequence with the smallest gap that holds them, or open a new one.

The rule only looks at lengths, so it runs on the number of pieces of each length (as many counts as the capacity, whatever the
size of the corpus) and gives runs: so many pieces of a length go to so many sequences from a number on, at one offset. Spark
numbers the pieces of each length, by counts per task and a running sum over tasks, and each piece looks up its run.

Defined results: a null or empty text is its end id alone; repeated rows are documents of their own; an empty table gives an
empty table. Names of special tokens in a text are ordinary text. Other columns are never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sourceloom.llm.bpe import Encoder
from sourceloom.llm.common import STEP_BYTES, buffers, release, saved, ship, steps

# ----- the plan ---------------------------------------------------------------------------------------------------


def plan(counts: np.ndarray, capacity: int) -> np.ndarray:
    """Runs (length, first rank, first sequence, offset), ordered by length and rank, for counts[length] pieces.

    The piece of rank r goes to sequence first sequence + (r - first rank), for the last run that begins at r or before.
    """
    left = counts.astype(np.int64).copy()
    used = np.zeros(capacity + 1, np.int64)  # ranks given away
    runs: list[tuple[int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> (first sequence, sequences)
    sequences = 0

    def give(length: int, n: int, sequence: int, offset: int) -> None:
        runs.append((length, int(used[length]), sequence, offset))
        used[length] += n
        left[length] -= n

    def opened(gap: int, sequence: int, n: int) -> None:
        if gap and n:
            gaps.setdefault(gap, []).append((sequence, n))

    third = capacity // 3
    for long in range(capacity, third, -1):
        other = min(long, capacity - long)
        while left[long]:
            while other > third and (left[other] == 0 or (other == long and left[long] < 2)):
                other -= 1
            if other > third:
                n = int(left[long] // 2 if other == long else min(left[long], left[other]))
                give(long, n, sequences, 0)
                give(other, n, sequences, long)
                opened(capacity - long - other, sequences, n)
            else:
                n = int(left[long])
                give(long, n, sequences, 0)
                opened(capacity - long, sequences, n)
            sequences += n
    for size in range(third, 0, -1):
        while left[size]:
            gap = min((g for g in gaps if g >= size), default=0)
            if not gap:
                n = -(-int(left[size]) // (capacity // size))
                opened(capacity, sequences, n)
                sequences += n
                continue
            first, n = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
            layers = gap // size
            full = min(n, int(left[size]) // layers)
            for k in range(layers if full else 0):
                give(size, full, first, capacity - gap + k * size)
            opened(gap - layers * size, first, full)
            if full < n:
                rest = int(left[size])
                for k in range(rest):
                    give(size, 1, first + full, capacity - gap + k * size)
                opened(gap - rest * size, first + full, 1 if rest else 0)
                opened(gap, first + full + (rest > 0), n - full - (rest > 0))
    table = np.array(runs, np.int64).reshape(-1, 4)
    return table[np.lexsort((table[:, 1], table[:, 0]))]


# ----- pieces and places ------------------------------------------------------------------------------------------


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, rank): rank numbers the pieces of one length within a task."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        encoder = Encoder(tokenizer)
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            texts = batch.column(1)
            for first, stop in steps(buffers(texts)[1], 4 * STEP_BYTES):
                ids, ends = encoder.encode([t or "" for t in texts[first:stop].to_pylist()])
                raw = ids.astype("<u4").tobytes()
                sizes = np.diff(ends, prepend=0) + 1
                pieces = -(-sizes // capacity)
                row = np.repeat(np.arange(stop - first), pieces)
                number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                short = sizes - (pieces - 1) * capacity
                start = np.where(number == 0, 0, short[row] + (number - 1) * capacity)
                length = np.where(number == 0, short[row], capacity)
                begin = (ends - (sizes - 1))[row] + start
                last = number == pieces[row] - 1
                sums = [
                    zlib.crc32(end, zlib.crc32(raw[4 * b : 4 * (b + n - 1)])) if e else zlib.crc32(raw[4 * b : 4 * (b + n)])
                    for b, n, e in zip(begin.tolist(), length.tolist(), last.tolist(), strict=True)
                ]
                order = np.argsort(length, kind="stable")
                ordered = length[order]
                new = np.flatnonzero(np.diff(ordered, prepend=-1))
                rank = np.empty(len(row), np.int64)
                rank[order] = np.arange(len(row)) - np.repeat(new, np.diff(np.append(new, len(row)))) + seen[ordered]
                seen += np.bincount(length, minlength=capacity + 1)
                columns = [batch.column(0)[first:stop].take(pa.array(row)), number.astype(np.int32), start, length, np.array(sums, np.int64), np.full(len(row), part, np.int32), rank]
                yield pa.RecordBatch.from_arrays([columns[0], *map(pa.array, columns[1:])], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(cut, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, part int, rank bigint")


def best_fit(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to ``token_pieces``."""
    spark = pieces.sparkSession
    pieces = saved(pieces)
    per_task = saved(pieces.groupBy("part", "length").count())
    counts = np.zeros(capacity + 1, np.int64)
    for row in per_task.groupBy("length").agg(F.sum("count").alias("n")).collect():  # at most one row per length
        counts[row.length] = row.n
    runs = spark.sparkContext.broadcast(plan(counts, capacity))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = saved(per_task.withColumn("before", F.coalesce(F.sum("count").over(earlier), F.lit(0))).select("part", "length", "before"))
    numbered = pieces.join(before, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("before"))
    numbered = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = runs.value
        keys = (table[:, 0] << 48) | table[:, 1]
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            run = table[np.searchsorted(keys, (length << 48) | rank, side="right") - 1] if len(table) else np.zeros((0, 4), np.int64)
            columns = [batch.column(k) for k in range(5)]
            columns += [pa.array(run[:, 2] + rank - run[:, 1]), pa.array(run[:, 3].copy())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = pieces.schema["doc_id"].dataType.simpleString()
    return numbered.mapInArrow(place, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return best_fit(token_pieces(docs, tokenizer, capacity, end_id, id_col, text_col), capacity)
