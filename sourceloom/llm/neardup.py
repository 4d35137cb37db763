"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF word shingles, banded and verified.

A document is its runs of five words (ASCII letters, digits and all other characters beyond ASCII; A-Z folded), each weighted
by tf x (1 + ln((1 + N) / (1 + df))), with df at least ``level`` x N: rarer shingles weigh the same, so that the few words
which make a near copy differ, and which no other document has, do not outweigh what a group of copies shares. Two documents are near duplicates if the weighted Jaccard similarity, sum of minima over
sum of maxima, is 0.8 or more; a class is what such links connect.

1. Document frequencies: a count-min sketch of fixed size, summed over all documents. It never counts too little, and too
   much by about (shingles of a document / width) x N at any N, a fifth of the level for documents of 500 words. Every document
   sees the same weights.
2. Sampling: for each of ``bands`` x ``rows`` samples the shingle with the smallest a = c / (y e^r), with t = floor(ln w / r +
   b), y = e^(r (t - b)), and r, c from gamma(2, 1), b uniform, all drawn from the shingle's hash. A sample is (shingle, t).
3. Bands: exact copies count as one node; nodes that agree on a whole band share a bucket.
4. Links: each bucket's members are compared with one of them, its centre, so a bucket of n gives n - 1 pairs. The centre is the
   member with the highest score, (members of all its buckets) x (weighted mean of ln(1 + df) of its shingles): of a group of
   near copies the text they were made from, or the nearest to it, which more of them are like than are like each other. Scores
   are the same in all buckets, so buckets with the same members have the same centre and pairs.
5. Members of a bucket take the centre they are like as their label, so texts of one label are linked already. Buckets of three or
   more in which labels differ are not settled: their members are joined exactly. Each gives the prefix of its shingles, rarest
   first, without which no document can be similar to it, and members of two labels that share a shingle of their prefixes are
   compared unless what is left of both is too light. So every pair that shares a bucket is compared, connected, or shown to
   be below the threshold, however large and unlike the bucket.
6. Classes are connected components of the links of 4 and 5, found once.

Defined results: a text of one to four words is one shingle; a text without words (null, empty) is in a class with exact
copies only; repeated rows of an id are copies; a null id belongs to the class of its text, and the class id is the smallest
id that is not null. Other columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceloom.llm.common import Words, buffers, byte_table, components, digest128, mixed, release, saved, ship, steps, text_or_empty

_HASH_BITS = 44
_HASH_MASK = np.uint64((1 << _HASH_BITS) - 1)


@dataclass(frozen=True)
class Settings:
    shingle: int = 5
    threshold: float = 0.8
    level: float = 0.01
    bands: int = 10
    rows: int = 3
    sketch_width: int = 1 << 18
    sketch_rows: int = 2
    seed: int = 7


def _gamma2_quantiles(n: int) -> np.ndarray:
    """Values of gamma(2, 1) at n evenly spaced ranks: roots of 1 - (1 + x) e^-x = rank."""
    rank = (np.arange(n) + 0.5) / n
    low, high = np.zeros(n), np.full(n, 60.0)
    for _ in range(60):
        middle = (low + high) / 2
        below = 1 - (1 + middle) * np.exp(-middle) < rank
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    return low


_RANKS = 1 << 16
_TABLES: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    if not _TABLES:
        gamma = _gamma2_quantiles(_RANKS)
        _TABLES.extend([gamma.astype(np.float32), np.log(gamma).astype(np.float32)])
    return _TABLES


# ----- shingles ---------------------------------------------------------------------------------------------------


def shingles(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, times) of the distinct shingles of each row, ordered by row and hash."""
    words = Words(data, offsets, byte_table(None))
    firsts, hashes = words.windows(length)
    row = words.row_of_word()[firsts]
    counts = np.diff(words.rows)
    short = np.flatnonzero((counts > 0) & (counts < length))
    if len(short):
        hashes = np.concatenate([hashes, words.span_hashes(words.rows[short], counts[short])])
        row = np.concatenate([row, short])
    key = np.sort((row.astype(np.uint64) << np.uint64(_HASH_BITS)) | (hashes & _HASH_MASK))
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.append(new, len(key)))
    key = key[new]
    return (key >> np.uint64(_HASH_BITS)).astype(np.int64), key & _HASH_MASK, times


def _cells(hashes: np.ndarray, settings: Settings) -> list[np.ndarray]:
    spread = mixed(hashes + np.uint64(1))
    width = np.uint64(settings.sketch_width)
    return [((spread >> np.uint64(24 * k)) % width).astype(np.int64) for k in range(settings.sketch_rows)]


def frequency_sketch(docs: DataFrame, settings: Settings) -> np.ndarray:
    """Document counts of all shingles, sketch_rows x sketch_width, summed in a tree of tasks.

    The tree is deep enough that the driver adds a few sketches (about the fourth root of the number of tasks).
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros((settings.sketch_rows, settings.sketch_width), np.float32)
        for batch in batches:
            data, offsets = buffers(batch.column(0))
            for start, stop in steps(offsets):
                part = offsets[start : stop + 1]
                _, hashes, _ = shingles(data[part[0] : part[-1]], part - part[0], settings.shingle)
                for k, cells in enumerate(_cells(hashes, settings)):
                    sketch[k] += np.bincount(cells, minlength=settings.sketch_width)
        yield pa.RecordBatch.from_arrays([pa.array([sketch.tobytes()], pa.binary())], ["sketch"])

    def add(left: bytes, right: bytes) -> bytes:
        return (np.frombuffer(left, np.float32) + np.frombuffer(right, np.float32)).tobytes()

    parts = docs.mapInArrow(count, "sketch binary").rdd.map(lambda row: bytes(row.sketch))
    total = np.zeros((settings.sketch_rows, settings.sketch_width), np.float32)
    if parts.getNumPartitions():
        total += np.frombuffer(parts.treeReduce(add, depth=4), np.float32).reshape(total.shape)
    return total


def _seen(hashes: np.ndarray, sketch: np.ndarray, settings: Settings) -> np.ndarray:
    """Documents that have each shingle; never too few."""
    return np.minimum.reduce([sketch[k][cells] for k, cells in enumerate(_cells(hashes, settings))])


def weights(hashes: np.ndarray, times: np.ndarray, sketch: np.ndarray, n_docs: int, settings: Settings) -> np.ndarray:
    seen = np.clip(_seen(hashes, sketch, settings), np.float32(settings.level * n_docs), np.float32(n_docs))
    return (times * (1 + math.log1p(n_docs) - np.log1p(seen))).astype(np.float32)


# ----- samples ----------------------------------------------------------------------------------------------------


def band_hashes(row: np.ndarray, hashes: np.ndarray, weight: np.ndarray, n_rows: int, settings: Settings) -> np.ndarray:
    """(n_rows, bands) hashes of the samples; rows without shingles stay 0."""
    gamma, log_gamma = _tables()
    out = np.zeros((n_rows, settings.bands), np.uint64)
    if not len(row):
        return out
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    present = row[first]
    log_weight = np.log(weight)
    low = (mixed(hashes) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    base = hashes * np.uint64(0xD6E8FEB86659FD93)
    for band in range(settings.bands):
        joint = np.full(len(first), np.uint64(band + 1))
        for k in range(settings.rows):
            draw = mixed(base + np.uint64((settings.seed + 1) * 0x9E3779B97F4A7C15 * (band * settings.rows + k + 1) & (2**64 - 1)))
            r = gamma[draw & np.uint64(_RANKS - 1)]
            log_c = log_gamma[(draw >> np.uint64(16)) & np.uint64(_RANKS - 1)]
            b = ((draw >> np.uint64(32)) & np.uint64(0xFFFFFF)).astype(np.float32) * np.float32(2**-24)
            t = np.floor(log_weight / r + b)
            log_a = log_c - r * (t - b + 1)
            order = log_a.view(np.int32)
            order = (order ^ ((order >> 31) & 0x7FFFFFFF)).astype(np.int64)
            name = (low ^ (t.astype(np.int64) * 0x85EBCA6B)) & 0xFFFFFFFF
            least = np.minimum.reduceat((order << 32) | name, first)
            joint = mixed(joint * np.uint64(0x100000001B3) + (least & 0xFFFFFFFF).astype(np.uint64))
        out[present, band] = joint
    return out


def _sampled(docs: DataFrame, sketch: Broadcast, n_docs: int, settings: Settings) -> DataFrame:
    """(id, node, bands, common) of rows (id, node, text); common is the weighted mean of ln(1 + df) of a text's shingles.

    Of a group of near copies it is highest for the text that they were made from: its shingles are those that most others
    have, while each copy has some of its own.
    """

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            data, offsets = buffers(batch.column(2))
            for start, stop in steps(offsets):
                part = offsets[start : stop + 1]
                row, hashes, times = shingles(data[part[0] : part[-1]], part - part[0], settings.shingle)
                weight = weights(hashes, times, sketch.value, n_docs, settings)
                found = band_hashes(row, hashes, weight, stop - start, settings)
                total = np.bincount(row, weight, stop - start)
                common = np.bincount(row, weight * np.log1p(_seen(hashes, sketch.value, settings)), stop - start) / np.where(total > 0, total, 1)
                full = np.zeros(stop - start, bool)
                full[row] = True
                lengths = np.where(full, settings.bands, 0)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(found[full].ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[start:stop], batch.column(1)[start:stop], lists, pa.array(common)], ["id", "node", "bands", "common"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(sample, f"id {kind}, node binary, bands array<bigint>, common double")


def similarities(left: pa.Array, right: pa.Array, sketch: np.ndarray, n_docs: int, settings: Settings) -> np.ndarray:
    """Weighted Jaccard similarity of each pair of texts."""
    out = np.zeros(len(left))
    sides = [buffers(x) for x in (left, right)]
    both = sides[0][1] + sides[1][1]
    for start, stop in steps(both):
        keys, values, sums = [], [], []
        for data, offsets in sides:
            part = offsets[start : stop + 1]
            row, hashes, times = shingles(data[part[0] : part[-1]], part - part[0], settings.shingle)
            weight = weights(hashes, times, sketch, n_docs, settings).astype(np.float64)
            keys.append((row.astype(np.uint64) << np.uint64(_HASH_BITS)) | hashes)
            values.append(weight)
            sums.append(np.bincount(row, weight, stop - start))
        _, a, b = np.intersect1d(keys[0], keys[1], assume_unique=True, return_indices=True)
        shared = np.minimum(values[0][a], values[1][b])
        common = np.bincount((keys[0][a] >> np.uint64(_HASH_BITS)).astype(np.int64), shared, stop - start)
        total = sums[0] + sums[1] - common
        out[start:stop] = np.divide(common, total, out=np.zeros(stop - start), where=total > 0)
    return out


def _linked(pairs: DataFrame, texts: DataFrame, sketch: Broadcast, n_docs: int, settings: Settings) -> DataFrame:
    """The pairs (a, b, score) whose texts are similar."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            near = similarities(batch.column(3), batch.column(4), sketch.value, n_docs, settings) >= settings.threshold
            yield batch.select(["a", "b", "score"]).filter(pa.array(near))

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("left"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("right"))
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", "score", "left", "right")
    return rows.mapInArrow(verify, "a binary, b binary, score double")


# ----- the exact join of members still apart ----------------------------------------------------------------------

#: Bounds are this much looser than the threshold, so that rounding never loses a pair.
_SLACK = 1e-6


def prefixes(row: np.ndarray, hashes: np.ndarray, weight: np.ndarray, seen: np.ndarray, settings: Settings) -> tuple[np.ndarray, ...]:
    """(place, total, rest, short) of the shingles in the prefixes of all rows, rarest first.

    A similar document shares at least threshold x total of a row's weight, and 2 threshold / (1 + threshold) x total if it is
    not lighter, so one of the shingles before the last so much weight. ``short`` marks the shingles of that second, shorter
    prefix; ``rest`` is the weight behind a shingle. Shingles of one document only are left out: no other one shares them.
    """
    order = np.lexsort((hashes, seen, row))
    row, weight = row[order], weight[order].astype(np.float64)
    total = np.bincount(row, weight)[row] if len(row) else weight
    upto = np.cumsum(weight)
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
    before = np.repeat((upto - weight)[first], np.diff(np.append(first, len(row))))
    rest = total - (upto - before)
    share = (weight + rest) / np.where(total > 0, total, 1)
    t = settings.threshold
    wanted = np.flatnonzero((share >= t - _SLACK) & (seen[order] > 1))
    return order[wanted], total[wanted], rest[wanted], share[wanted] >= 2 * t / (1 + t) - _SLACK


ENTRIES = "hash bigint, node binary, root binary, total double, weight double, rest double, short boolean"


def _entries(members: DataFrame, sketch: Broadcast, n_docs: int, settings: Settings) -> DataFrame:
    """The prefixes of rows (node, root, text) as rows of ENTRIES."""
    names = [x.split()[0] for x in ENTRIES.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            data, offsets = buffers(batch.column(2))
            for start, stop in steps(offsets):
                part = offsets[start : stop + 1]
                row, hashes, times = shingles(data[part[0] : part[-1]], part - part[0], settings.shingle)
                weight = weights(hashes, times, sketch.value, n_docs, settings)
                place, total, rest, short = prefixes(row, hashes, weight, _seen(hashes, sketch.value, settings), settings)
                of = pa.array(start + row[place])
                columns = [hashes[place].view(np.int64), batch.column(0).take(of), batch.column(1).take(of), total, weight[place].astype(np.float64), rest, short]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names)

    return members.mapInArrow(cut, ENTRIES)


def _candidates(members: DataFrame, sketch: Broadcast, n_docs: int, settings: Settings) -> DataFrame:
    """(a, b, score) of all pairs of different roots that can be similar, from rows (node, root, text); the score is 0.

    Entries of the most frequent root of a shingle are only joined with those of other roots, so one large class is never
    joined with itself.
    """
    entries = saved(_entries(members, sketch, n_docs, settings))
    sizes = entries.groupBy("hash", "root").agg(F.count(F.lit(1)).alias("n"))
    hashes = sizes.groupBy("hash").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count(F.lit(1)).alias("roots"))
    entries = entries.join(hashes.where("roots > 1").select("hash", "main"), "hash")
    left = entries.where("root <> main").select("hash", *(F.col(c).alias(f"l_{c}") for c in ("node", "root", "total", "weight", "rest", "short")))
    right = entries.drop("main")
    lighter = F.struct("l_total", "l_node") < F.struct("total", "node")  # the lighter document needs its short prefix only
    need = settings.threshold / (1 + settings.threshold) - _SLACK
    most = F.least("l_weight", "weight") + F.least("l_rest", "rest")  # no more is shared from the first common shingle on
    able = (F.col("l_root") != F.col("root")) & F.when(lighter, F.col("l_short")).otherwise(F.col("short")) & (most >= need * (F.col("l_total") + F.col("total")))
    pairs = left.join(right, "hash").where(able)
    return pairs.select(F.least("l_node", "node").alias("a"), F.greatest("l_node", "node").alias("b")).distinct().withColumn("score", F.lit(0.0))


# ----- classes ----------------------------------------------------------------------------------------------------


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """(doc_id, class_id, class_size), one row per row of ``docs``."""
    return _classed(docs, id_col, text_col, settings).select(F.col("id").alias("doc_id"), F.col("best.id").alias("class_id"), "class_size")


def _classed(docs: DataFrame, id_col: str, text_col: str, settings: Settings) -> DataFrame:
    """(id, node, best, class_size): best is the id, or null, and the text's hash that stand for the class."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    rows = rows.withColumn("node", digest128(F.col("text"))).select("id", "node", "text")
    n_docs = rows.count()
    sketch = spark.sparkContext.broadcast(frequency_sketch(rows.select("text"), settings))
    sampled = saved(_sampled(rows, sketch, n_docs, settings))

    nodes = sampled.groupBy("node").agg(F.first("bands").alias("bands"), F.first("common").alias("common"), F.min("id").alias("rep"))
    places = nodes.select("node", "rep", "common", F.explode("bands").alias("bucket"))
    shared = places.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    found = [F.min("rep").alias("rep"), (F.sum("n") * F.first("common")).alias("score"), F.collect_list(F.struct("bucket", "n")).alias("places")]
    nodes = saved(places.join(shared, "bucket").groupBy("node").agg(*found))  # at most as many places as bands
    one = F.xxhash64("id", "node").alias("one")  # one row of each text, however many copies it has
    wanted = nodes.select(F.xxhash64(F.col("rep").alias("id"), "node").alias("one"), "node")
    texts = saved(rows.select(one, "node", "text").join(wanted, ["one", "node"]).groupBy("one", "node").agg(F.first("text").alias("text")).select("node", "text"))

    members = nodes.select("node", "score", F.explode("places").alias("place")).select("node", "score", "place.bucket")
    centres = members.groupBy("bucket").agg(F.max(F.struct("score", "node")).alias("centre"))
    stars = members.join(centres, "bucket").where(F.col("node") != F.col("centre.node"))
    stars = stars.select(F.col("node").alias("a"), F.col("centre.node").alias("b"), F.col("centre.score").alias("score")).distinct()
    links = saved(_linked(stars, texts, sketch, n_docs, settings))

    labels = links.groupBy(F.col("a").alias("node")).agg(F.max(F.struct("score", "b")).alias("label"))
    labelled = nodes.join(labels, "node", "left").select("node", F.coalesce("label.b", "node").alias("root"), F.explode("places").alias("place"))
    labelled = labelled.where("place.n > 2").select("node", "root", "place.bucket")
    several = labelled.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("bucket")
    apart = labelled.join(several, "bucket").groupBy("node").agg(F.first("root").alias("root"))
    rest = _candidates(apart.join(texts, "node").select("node", "root", "text"), sketch, n_docs, settings)
    roots = components(links.unionByName(_linked(rest, texts, sketch, n_docs, settings)))

    members = sampled.select("id", "node").join(roots, "node", "left").select("id", "node", F.coalesce("root", "node").alias("root"))
    best = F.min(F.struct(F.col("id").isNull(), "id", "node")).alias("best")
    classes = saved(members.groupBy("root").agg(best, F.count(F.lit(1)).alias("class_size")))
    return members.join(classes, "root").select("id", "node", "best", "class_size")


def first_of_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """``docs`` without all but the document with the smallest id of each class.

    A class without ids keeps one of its texts; of repeated rows of a kept id and text one stays. The decision is joined to the
    rows by id and a hash of the text, so copies spread evenly.
    """
    classed = _classed(docs, id_col, text_col, settings)
    kept = classed.where(F.col("id").eqNullSafe(F.col("best.id")) & (F.col("node") == F.col("best.node")))
    kept = saved(kept.groupBy(F.col("id").alias("_sl_id"), F.col("node").alias("_sl_node")).agg(F.count(F.lit(1)).alias("rows")))
    rows = docs
    if not kept.where("rows > 1").isEmpty():  # only then are texts shuffled a second time
        rows = docs.dropDuplicates([id_col, text_col])
    same = F.col(id_col).eqNullSafe(F.col("_sl_id")) & (digest128(text_or_empty(text_col)) == F.col("_sl_node"))
    return rows.join(kept, same, "left_semi")
