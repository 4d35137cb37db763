"""Helpers shared by the operators of this subpackage: checkpoints, row keys, and words of Arrow string columns as arrays."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sourceloom.session import shared_dir

#: Java's regular expression for the white space of the contracts: space, tab to carriage return.
BLANKS = r"[\x20\x09-\x0D]"

#: Bytes of text that one vectorised step handles; long documents are steps of their own.
STEP_BYTES = 1 << 19


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the tasks of the session, wherever its executors run."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="sourceloom-")) / "sourceloom.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted(package.rglob("*.py")):
                out.write(file, file.relative_to(package.parent))
        context.addPyFile(str(archive))  # the driver's copy is sent to each executor
        _SHIPPED.add(context.applicationId)


def saved(df: DataFrame) -> DataFrame:
    """The rows, computed once and written to the shared checkpoint folder, so that no lost executor repeats more.

    Spark deletes the files when nothing refers to them (``spark.cleaner.referenceTracking.cleanCheckpoints``).
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def tasks(spark: SparkSession) -> int:
    """Number of shuffle partitions the session is set to."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release() -> None:
    """Gives back the memory that earlier tasks of this Python worker freed, which its allocators keep otherwise."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def digest128(column: Column) -> Column:
    """128-bit content hash as 16 bytes."""
    return F.unhex(F.md5(column))


# ----- words of Arrow string columns ------------------------------------------------------------------------------

_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLACES = 64
#: A random value for each byte at each place of a word; words that differ share no algebra that sums of powers have.
_CELLS = np.random.default_rng(20240601).integers(0, 1 << 64, _PLACES * 256, dtype=np.uint64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the odd base, and of its inverse modulo 2^64."""
    if len(_POWERS[0]) <= n:
        size = max(n + 1, 2 * STEP_BYTES + 1)
        for k, base in enumerate((_ODD, _ODD_INVERSE)):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _POWERS[k] = np.cumprod(factors)
    return _POWERS[0], _POWERS[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_table(separators: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(byte is part of a word, byte after folding).

    ``separators`` None: words are runs of ASCII letters and digits and of all bytes beyond ASCII, A-Z folded to a-z.
    Else words are runs of anything but the given ASCII characters, unchanged.
    """
    folded = np.arange(256, dtype=np.uint8)
    if separators is not None:
        inside = np.ones(256, bool)
        inside[[ord(c) for c in separators]] = False
        return inside, folded
    inside = np.zeros(256, bool)
    for low, high in ((48, 58), (65, 91), (97, 123), (128, 256)):
        inside[low:high] = True
    folded[65:91] += 32
    return inside, folded


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def smaller(batch: pa.RecordBatch, column: int, limit: int = 8 * STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in parts of at most ``limit`` bytes of one column, so that what a task builds from them stays small."""
    for start, stop in steps(buffers(batch.column(column))[1], limit):
        yield batch.slice(start, stop - start)


def steps(offsets: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``limit`` bytes, or a single longer row."""
    start, n = 0, len(offsets) - 1
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        stop = min(n, max(start + 1, stop))
        yield start, stop
        start = stop


def word_hashes(data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of words that follow each other in ``data``: sums of random values by place and byte.

    Words of more than ``_PLACES`` bytes use the values again, mixed with the number of the round.
    """
    if not len(lengths):
        return np.zeros(0, np.uint64)
    firsts = np.cumsum(lengths) - lengths
    place = np.arange(len(data)) - np.repeat(firsts, lengths)
    cells = _CELLS[(place & (_PLACES - 1)) << 8 | data]
    far = np.flatnonzero(place >= _PLACES)
    if len(far):
        cells[far] = mixed(cells[far] + (place[far] // _PLACES).astype(np.uint64) * _ODD)
    return mixed(np.add.reduceat(cells, firsts) + lengths.astype(np.uint64) * _ODD)


class Words:
    """The words of some rows: 64-bit hash, place of their bytes, and for each row the range of its words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: tuple[np.ndarray, np.ndarray]):
        inside, folded = table
        n = len(data)
        self.data = data
        if n == 0:
            self.starts = self.ends = np.zeros(0, np.int64)
            self.hashes = np.zeros(0, np.uint64)
            self.rows = np.zeros(len(offsets), np.int64)
            return
        word = inside[data]
        edge = offsets[:-1][offsets[:-1] < n]  # first bytes of rows
        before = np.empty(n, bool)
        before[0] = False
        before[1:] = word[:-1]
        before[edge] = False
        after = np.empty(n, bool)
        after[-1] = False
        after[:-1] = word[1:]
        after[edge[edge > 0] - 1] = False
        self.starts = np.flatnonzero(word & ~before)
        self.ends = np.flatnonzero(word & ~after) + 1
        self.hashes = word_hashes(folded[data[word]], self.ends - self.starts)
        self.rows = np.searchsorted(self.starts, offsets)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), np.diff(self.rows))

    def span_hashes(self, firsts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Hashes of runs of words; equal to those of ``windows`` for equal words."""
        powers, inverse = _powers(len(self.hashes))
        sums = np.zeros(len(self.hashes) + 1, np.uint64)
        np.cumsum(self.hashes * powers[: len(self.hashes)], out=sums[1:])
        return mixed((sums[firsts + lengths] - sums[firsts]) * inverse[firsts] + lengths.astype(np.uint64))

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of all runs of ``length`` words inside a row."""
        n = len(self.hashes)
        if n < length:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        firsts = np.arange(n - length + 1)
        row_end = np.repeat(self.rows[1:], np.diff(self.rows))[: n - length + 1]
        firsts = firsts[firsts + length <= row_end]
        return firsts, self.span_hashes(firsts, np.full(len(firsts), length))


# ----- connected components ---------------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links ``a``, ``b``; root is the smallest node that it is linked to.

    In each round all nodes of a root take the smallest root next to any of them, and then that root's own new root, so
    chains halve. Rounds end when nothing changes. A node or root with very many links is no hot task: minima are taken
    before rows are shuffled.
    """
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))  # the links are computed once
    both = saved(edges.where("a <> b").select(F.inline(ways)).distinct())
    state = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root"))
    state = saved(state)
    while True:
        seen = both.join(state.select(F.col("node").alias("b"), F.col("root").alias("next")), "b").select(F.col("a").alias("node"), "next")
        near = seen.groupBy("node").agg(F.min("next").alias("near"))
        moves = state.join(near, "node").groupBy("root").agg(F.least(F.first("root"), F.min("near")).alias("next"))
        far = moves.select(F.col("root").alias("next"), F.col("next").alias("far"))
        moves = moves.join(far, "next", "left").select("root", F.coalesce("far", "next").alias("next"))
        new = saved(state.join(moves, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
        state = new.select("node", "root")
        if new.where("moved").isEmpty():
            return state
