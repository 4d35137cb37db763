"""Line deduplication that can be taken back: exact reference counts per line, and sharded cuckoo filters of what to drop.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased, as a 128-bit hash. The reference count of
a key is the number of documents (rows) with such a line. Keys of ``min_docs`` documents or more are dropped everywhere.

A ``LineStore`` holds the counts (a table of keys) and, per shard, a cuckoo filter of the keys that are dropped now. Inserting
documents raises counts, deleting them lowers counts; keys that cross the threshold enter or leave the filter of their shard,
so a deletion undoes an insertion exactly. Cleaning asks the filters first, for the distinct keys of the documents, and only
keys they may hold are looked up in the exact table, which has the last word.

Defined results: a null or empty text is one empty line; empty keys are never dropped; repeated rows are documents of their
own; an empty table gives an empty table; deleting documents that were never inserted is an error of the caller and leaves no
count below one. Other columns pass through unchanged, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sourceloom.llm.common import saved, ship, smaller, text_or_empty

BLANK_BYTES = b" \t\n\v\f\r"

#: Keys of one shard that a task handles at a time, about.
SHARD_KEYS = 500_000

#: Slots of a bucket, and buckets of one table of a filter (a power of two). A shard's filter is a chain of such tables.
SLOTS, BUCKETS = 4, 1 << 12


def line_keys(text: str | None) -> list[bytes]:
    """The 16-byte key of each line; b"" for lines that are never dropped."""
    lines = (text or "").encode("utf-8", "surrogatepass").lower().split(b"\n")
    return [xxhash.xxh3_128_digest(k) if (k := line.strip(BLANK_BYTES)) else b"" for line in lines]


# ----- cuckoo filter of one shard ---------------------------------------------------------------------------------


class CuckooFilter:
    """Chain of cuckoo tables of equal shape, so that equal fingerprints stand for the same places in each of them."""

    def __init__(self, blob: bytes | None = None):
        tables = np.frombuffer(blob or b"", np.uint16).reshape(-1, BUCKETS, SLOTS)
        self.tables = [t.copy() for t in tables]

    def blob(self) -> bytes:
        return b"".join(t.tobytes() for t in self.tables)

    @staticmethod
    def places(low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(fingerprint, first bucket, second bucket) from the low half of the keys."""
        low = low.astype(np.int64).view(np.uint64)
        print_ = ((low >> np.uint64(40)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        first = (low & np.uint64(BUCKETS - 1)).astype(np.int64)
        return print_, first, first ^ CuckooFilter.shift(print_)

    @staticmethod
    def shift(print_: np.ndarray) -> np.ndarray:
        return ((print_.astype(np.uint64) * np.uint64(0x5BD1E995)) >> np.uint64(7)).astype(np.int64) & (BUCKETS - 1)

    def may_hold(self, low: np.ndarray) -> np.ndarray:
        print_, first, second = self.places(low)
        found = np.zeros(len(low), bool)
        for table in self.tables:
            found |= (table[first] == print_[:, None]).any(1) | (table[second] == print_[:, None]).any(1)
        return found

    def insert(self, low: np.ndarray) -> None:
        for p, a, b in zip(*map(np.ndarray.tolist, self.places(low)), strict=True):
            if not self.tables or not self._put(self.tables[-1], p, a, b):
                self.tables.append(np.zeros((BUCKETS, SLOTS), np.uint16))
                self._put(self.tables[-1], p, a, b)

    def _put(self, table: np.ndarray, print_: int, first: int, second: int) -> bool:
        """False leaves the table as it was: the chain of moves is only carried out once it ends in a free slot."""
        for bucket in (first, second):
            free = np.flatnonzero(table[bucket] == 0)
            if len(free):
                table[bucket, free[0]] = print_
                return True
        moves, bucket, taken = [], first, set()
        for step in range(200):
            slot = (print_ + step) % SLOTS
            if (bucket, slot) in taken:
                return False
            taken.add((bucket, slot))
            moves.append((bucket, slot))
            bucket ^= int(self.shift(np.array([table[bucket, slot]], np.uint16))[0])
            free = np.flatnonzero(table[bucket] == 0)
            if len(free):
                moves.append((bucket, int(free[0])))
                for (to, k), (at, j) in zip(moves[:0:-1], moves[-2::-1], strict=True):
                    table[to, k] = table[at, j]
                table[moves[0]] = print_
                return True
        return False

    def delete(self, low: np.ndarray) -> None:
        for p, a, b in zip(*map(np.ndarray.tolist, self.places(low)), strict=True):
            for table in self.tables:
                if (at := next(((x, int(s[0])) for x in (a, b) if len(s := np.flatnonzero(table[x] == p))), None)) is not None:
                    table[at] = 0
                    break


# ----- keys of documents ------------------------------------------------------------------------------------------


def _halves(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def document_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, mark, high, low): the distinct keys of each row. ``mark`` is a hash of the text; with the id it names the row."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in smaller(whole, 2)):
            found = [list({k for k in line_keys(t.as_py()) if k}) for t in batch.column(2)]
            rows = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
            high, low = _halves([k for x in found for k in x])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(high), pa.array(low)], ["id", "mark", "high", "low"])

    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), *_mark(text_col), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(keys, f"id {kind}, mark bigint, high bigint, low bigint")


def _mark(text_col: str) -> list[Column]:
    return [F.xxhash64(text_or_empty(text_col)).alias("mark")]


# ----- the store --------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class LineStore:
    """counts (shard, high, low, refs) and filters (shard, filter); both are saved tables and change only by new stores."""

    counts: DataFrame
    filters: DataFrame
    min_docs: int
    shards: int

    @classmethod
    def empty(cls, spark: SparkSession, min_docs: int = 10, shards: int | None = None, expected_keys: int = 0) -> LineStore:
        shards = shards or max(16, -(-expected_keys // SHARD_KEYS))
        counts = spark.createDataFrame([], "shard int, high bigint, low bigint, refs bigint")
        return cls(counts, spark.createDataFrame([], "shard int, filter binary"), min_docs, shards)

    def insert(self, keys: DataFrame) -> LineStore:
        return self._changed(keys, 1)

    def delete(self, keys: DataFrame) -> LineStore:
        return self._changed(keys, -1)

    def _shard(self) -> Column:
        return F.pmod("high", F.lit(self.shards)).cast("int")

    def _changed(self, keys: DataFrame, sign: int) -> LineStore:
        change = keys.groupBy("high", "low").agg((F.count(F.lit(1)) * sign).alias("more"))
        known = self.counts.select("high", "low", F.col("refs").alias("old"))
        merged = saved(
            known.join(change, ["high", "low"], "full")
            .select("high", "low", F.coalesce("old", F.lit(0)).alias("old"), (F.coalesce("old", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("refs"))
            .withColumn("shard", self._shard())
        )
        crossed = merged.where((F.col("old") >= self.min_docs) != (F.col("refs") >= self.min_docs))
        crossed = crossed.select("shard", "low", (F.col("refs") >= self.min_docs).alias("enters"))

        def apply(key: tuple, filters: pa.Table, changes: pa.Table) -> pa.Table:
            shard = CuckooFilter(filters.column("filter")[0].as_py() if filters.num_rows else None)
            enters = changes.column("enters").to_numpy().astype(bool)
            low = changes.column("low").to_numpy()
            shard.delete(low[~enters])
            shard.insert(low[enters])
            return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "filter": pa.array([shard.blob()], pa.binary())})

        filters = saved(self.filters.groupBy("shard").cogroup(crossed.groupBy("shard")).applyInArrow(apply, "shard int, filter binary"))
        counts = merged.where("refs > 0").select("shard", "high", "low", "refs")
        return LineStore(counts, filters, self.min_docs, self.shards)

    def dropped_keys(self, keys: DataFrame) -> DataFrame:
        """Distinct (high, low) of ``keys`` that are dropped now: possible ones by the filters, sure ones by the counts."""
        asked = keys.select("high", "low").distinct().withColumn("shard", self._shard())

        def probe(key: tuple, asked: pa.Table, filters: pa.Table) -> pa.Table:
            shard = CuckooFilter(filters.column("filter")[0].as_py() if filters.num_rows else None)
            maybe = shard.may_hold(asked.column("low").to_numpy())
            return asked.select(["high", "low"]).filter(pa.array(maybe))

        maybe = asked.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInArrow(probe, "high bigint, low bigint")
        sure = self.counts.where(F.col("refs") >= self.min_docs).select("high", "low")
        return maybe.join(sure, ["high", "low"])


def without_lines(docs: DataFrame, keys: DataFrame, store: LineStore, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the dropped lines taken out of the text, and the columns n_lines and n_dropped after the others.

    ``keys`` are the ``document_keys`` of ``docs``. A key that very many documents hold is joined by a join that Spark
    splits; what comes together per document is bounded by that document.
    """
    dropped = saved(store.dropped_keys(keys))
    per_row = keys.join(dropped, ["high", "low"]).groupBy("id", "mark").agg(F.collect_set(F.struct("high", "low")).alias("drop"))
    per_row = saved(per_row.select(F.col("id").alias("_sl_id"), F.col("mark").alias("_sl_mark"), F.col("drop").alias("_sl_drop")))
    names = docs.columns
    rows = docs.join(per_row, F.col(id_col).eqNullSafe(F.col("_sl_id")) & (_mark(text_col)[0] == F.col("_sl_mark")), "left")
    rows = rows.select(*[F.col(f"`{c}`") for c in names], "_sl_drop")
    place = names.index(text_col)

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in smaller(whole, place)):
            texts, counts, gone = [], [], []
            for text, drop in zip(batch.column(place), batch.column(len(names)), strict=True):
                text = text.as_py() or ""
                if not drop.is_valid:
                    texts.append(text)
                    counts.append(text.count("\n") + 1)
                    gone.append(0)
                    continue
                high, low = (drop.values.field(k).to_numpy() for k in (0, 1))
                out = {a.tobytes() + b.tobytes() for a, b in zip(high, low, strict=True)}
                lines = text.split("\n")
                kept = [line for line, key in zip(lines, line_keys(text), strict=True) if key not in out]
                texts.append("\n".join(kept))
                counts.append(len(lines))
                gone.append(len(lines) - len(kept))
            columns = [batch.column(k) for k in range(len(names))]
            columns[place] = pa.array(texts, batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(gone, pa.int64())], [*names, "n_lines", "n_dropped"])

    fields = [T.StructField(f.name, f.dataType) for f in docs.schema]
    schema = T.StructType([*fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    return rows.mapInArrow(rebuild, schema)


def dedup_lines(docs: DataFrame, min_docs: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Inserts ``docs`` into an empty store and cleans them by it."""
    keys = saved(document_keys(docs, id_col, text_col))
    store = LineStore.empty(docs.sparkSession, min_docs, expected_keys=keys.count()).insert(keys)
    return without_lines(docs, keys, store, id_col, text_col)
