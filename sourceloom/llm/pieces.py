"""SentencePiece ids and their decoding, by a table of distinct chunks.

The normalised text begins with a white-space marker and has one for each space. When no piece of the vocabulary holds a marker
behind another character, or a line feed beside one, no merge crosses the place before a run of markers or before a line feed. The
text falls apart there into chunks (mostly a marker and a word), and the ids of a text are those of its chunks, in order. So each
distinct chunk is segmented once and the ids are joined back by position:

- chunks are counted in Spark (summed in each task first); those with at least one occurrence in ``TABLE_CHUNKS`` of the corpus,
  so at most that many, are segmented once for all documents, and their table is broadcast;
- any other chunk is segmented where it occurs, once per task and then looked up. That table begins anew when it is full, so
  memory is bounded however many distinct words there are. No row leaves its task, and nothing is dropped.

A model for which this cannot be shown from its file (other normalisation, unknown pieces, pieces across markers) gets whole texts
as its chunks: the same ids, segmented text by text.

Defined results: a null or empty text has the end id alone and decodes to the empty text; very long texts are read whole; equal
and repeated rows each have their ids; an empty table gives an empty table. Names of control pieces in a text are ordinary text.
Bytes that are no UTF-8 become U+FFFD, as in the library. Columns of the input that have the name of a result column are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

from sourceloom.llm.common import saved, ship, smaller

MARKER = "▁"

#: At most so many chunks are in the table of the whole corpus, each of at most ``TABLE_BYTES`` bytes.
TABLE_CHUNKS, TABLE_BYTES = 1 << 18, 64
#: Chunks, and bytes of chunks, that a task keeps.
TASK_CHUNKS, TASK_BYTES = 500_000, 24 << 20

_CHUNK = re.compile(rb" +[^ \n]*|\n[^ \n]*")


class Segmenter:
    """A model file: the chunks of texts and the ids of a chunk. A chunk has spaces where the normalised text has markers."""

    def __init__(self, path: str):
        self.library = SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        plain, trained = model.normalizer_spec, model.trainer_spec
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        pieces = {p.piece: p.type for p in model.pieces}
        self.splits = (
            not plain.precompiled_charsmap
            and plain.add_dummy_prefix
            and plain.escape_whitespaces
            and not plain.remove_extra_whitespaces
            and not trained.treat_whitespace_as_suffix
            and trained.byte_fallback
            and trained.model_type == trained.BPE
            and MARKER in pieces
            and kinds.USER_DEFINED not in pieces.values()
            and not any(MARKER in p.lstrip(MARKER) or ("\n" in p and p != "\n") for p in pieces)
        )
        line = self.library.encode("\n") if self.splits else []  # the leading marker, then the line feed
        self.splits = self.splits and len(line) == 2
        self.marker = line[:1]
        self.end = self.library.eos_id()

    def chunks(self, text: bytes) -> list[bytes]:
        if not text:
            return []
        return _CHUNK.findall(b" " + text) if self.splits else [text]

    def ids(self, chunks: list[bytes]) -> list[list[int]]:
        """Ids of each chunk. The library puts a marker before what it is given: it stands for a chunk's own first marker."""
        encode = self.library.encode  # of one text: of a list it would start threads
        if not self.splits:
            return [encode(c) for c in chunks]
        found = [encode(c[1:] if c[0] == 32 else c) for c in chunks]
        return [self.marker if c == b" " else ids if c[0] == 32 else ids[1:] for c, ids in zip(chunks, found, strict=True)]


class ChunkTable(dict):
    """Ids (as unsigned 32-bit numbers in bytes) by chunk: the corpus' table, and what this task met beside it."""

    def __init__(self, segmenter: Segmenter, common: dict[bytes, bytes]):
        super().__init__(common)
        self.segmenter, self.common, self.size = segmenter, common, 0

    def __missing__(self, chunk: bytes) -> bytes:
        ids = np.array(self.segmenter.ids([chunk])[0], "<u4").tobytes()
        if len(chunk) > TABLE_BYTES << 4:
            return ids
        if len(self) - len(self.common) >= TASK_CHUNKS or self.size >= TASK_BYTES:
            self.clear()
            self.update(self.common)
            self.size = 0
        self.size += len(chunk) + len(ids)
        self[chunk] = ids
        return ids


def _bytes(column: pa.Array) -> list[bytes]:
    """Texts as bytes; null as empty. A marker in a text is a space to the model."""
    column = pc.replace_substring(column.cast(pa.large_binary()).fill_null(b""), MARKER.encode(), b" ")
    return column.to_pylist()


def _local(path: str) -> str:
    """The model's place in a task: the file sent with the session."""
    return SparkFiles.get(path.rsplit("/", 1)[-1])


def _send(spark: SparkSession, path: str) -> None:
    ship(spark)
    spark.sparkContext.addFile(path)


def chunk_counts(docs: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """(chunk, count) over all texts; (null, count) for all chunks that are too long for the table."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter, counts = Segmenter(_local(model)), Counter()

        def rows() -> pa.RecordBatch:
            long = sum(n for c, n in counts.items() if len(c) > TABLE_BYTES)
            short = {c: n for c, n in counts.items() if len(c) <= TABLE_BYTES}
            return pa.RecordBatch.from_arrays([pa.array([None, *short], pa.binary()), pa.array([long, *short.values()], pa.int64())], ["chunk", "count"])

        for batch in batches:
            for part in smaller(batch, 0):
                for text in _bytes(part.column(0)):
                    counts.update(segmenter.chunks(text))
                if len(counts) > TASK_CHUNKS:
                    yield rows()
                    counts.clear()
        yield rows()

    _send(docs.sparkSession, model)
    found = docs.select(F.col(text_col)).mapInArrow(count, "chunk binary, count bigint")
    return found.groupBy("chunk").agg(F.sum("count").alias("count"))


def chunk_table(docs: DataFrame, model: str, text_col: str = "text", limit: int = TABLE_CHUNKS) -> DataFrame:
    """(chunk, ids): the chunks with one occurrence in ``limit`` or more, each segmented once. At most ``limit`` rows."""

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = Segmenter(_local(model))
        for batch in batches:
            chunks = batch.column(0).to_pylist()
            ids = [np.array(x, "<u4").tobytes() for x in segmenter.ids(chunks)] if chunks else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["chunk", "ids"])

    counts = saved(chunk_counts(docs, model, text_col))
    total = counts.agg(F.sum("count")).first()[0] or 0
    often = counts.where(F.col("chunk").isNotNull() & (F.col("count") * limit >= total) & (F.col("count") > 1))
    return saved(often.select("chunk").mapInArrow(segment, "chunk binary, ids binary"))


def encoded(docs: DataFrame, model: str, text_col: str = "text", limit: int = TABLE_CHUNKS) -> DataFrame:
    """``docs`` without the text, with ``ids array<int>``: the library's ids of the whole text and the end id."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = Segmenter(_local(model))
        table = ChunkTable(segmenter, common.value)
        end = np.array([segmenter.end], "<u4").tobytes()
        look_up = table.__getitem__
        for batch in batches:
            for part in smaller(batch, place):
                ids = [b"".join([*map(look_up, segmenter.chunks(t)), end]) for t in _bytes(part.column(place))]
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int64) // 4
                values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(place)), lists], [*kept, "ids"])

    spark = docs.sparkSession
    _send(spark, model)
    kept = [c for c in docs.columns if c not in (text_col, "ids")]
    place = len(kept)
    rows = chunk_table(docs, model, text_col, limit).collect()  # at most ``limit`` rows of bounded size
    common = spark.sparkContext.broadcast({bytes(r.chunk): bytes(r.ids) for r in rows})
    chosen = docs.select(*kept, F.col(text_col))
    schema = [*chosen.schema.fields[:-1]]
    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in schema] + ["ids array<int>"])
    return chosen.mapInArrow(encode, fields)


def decoded(rows: DataFrame, model: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``rows`` with the texts of their ids; a null list is the empty text."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = SentencePieceProcessor(model_file=_local(model))
        for batch in batches:
            lists = batch.column(place)
            ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy())
            ids = lists.flatten().to_numpy()
            texts = [library.decode(ids[a:b].tolist()) if a < b else "" for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, text_col])

    _send(rows.sparkSession, model)
    kept = [c for c in rows.columns if c not in (text_col, ids_col)]
    place = len(kept)
    chosen = rows.select(*kept, F.col(ids_col))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields)
    return chosen.mapInArrow(decode, f"{fields}, `{text_col}` string")
