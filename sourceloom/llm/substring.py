"""Removal of long passages that a document with a smaller id holds too.

Words are runs of anything but ``[\\x20\\x09-\\x0D]``, unchanged. A window is ``length`` consecutive words of one document. Every
word is removed that lies in a window whose words also occur in a document with a smaller id, all judged on the input.

The windows are the edges of a De Bruijn graph of words. Only edges that may occur in several documents are ever made rows:

1. Copies of a whole word sequence are left to the smallest id among them; the others go without a look at their windows.
2. Seeds: of the runs of ``seed`` words in a window, the one with the smallest hash. Equal windows have equal seeds, so a window can
   only be repeated if its seed is; seeds of two or more documents are found by a count and a join.
3. Edges: the windows with such a seed, by a 96-bit hash; minima taken before the shuffle give each edge its owner, the smallest
   id, and the place in the owner's text. A join takes that back to all places of the edge.
4. Compaction: consecutive edges of a document that lead through consecutive places of one owner are one path, which ends where the
   graph branches. Paths are the spans that are removed, with the coordinates of their source.

Joins on seeds and edges carry no texts, and Spark splits their large keys; a passage that a third of all documents hold is one
row per task before it is shuffled.

Defined results: null and empty texts have no words. Ids are integers and name documents; an id compares with others only, so
rows that repeat an id do not remove each other. Rows without an id come after all others, in the order of a hash of their
text. Texts of fewer than ``length`` words stay whole. An empty table gives an empty table; other columns pass through unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sourceloom.llm.common import Words, buffers, byte_table, mixed, saved, ship, smaller, steps, text_or_empty

SEPARATORS = " \t\n\v\f\r"
_MOST = np.uint64(2**64 - 1)


def _sliding(values: np.ndarray, length: int, pick: np.ufunc) -> np.ndarray:
    """pick over values[i : i + length], for each i that has so many."""
    out, have = values, 1
    while have < length:
        step = min(have, length - have)
        out = pick(out[:-step], out[step:])
        have += step
    return out


def _seeds(words: Words, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash by word of the run that begins there, smallest hash by window, word is the start of a window)."""
    n = len(words.hashes)
    runs = np.full(n, _MOST)
    firsts, hashes = words.windows(seed)
    runs[firsts] = hashes
    row_end = np.repeat(words.rows[1:], np.diff(words.rows))
    window = np.arange(n) + length <= row_end
    least = np.zeros(n, np.uint64)
    width = length - seed + 1
    if n >= width:
        least[: n - width + 1] = _sliding(runs, width, np.minimum)
    least[~window] = 0
    return runs, least, window


def _chosen(runs: np.ndarray, least: np.ndarray, width: int) -> np.ndarray:
    """Words at which the seed of some window begins."""
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least])
    return np.flatnonzero((_sliding(padded, width, np.maximum) == runs) & (runs != _MOST))


def _parts(column: pa.Array) -> Iterator[tuple[int, int, Words]]:
    table = byte_table(SEPARATORS)
    data, offsets = buffers(column)
    for start, stop in steps(offsets):
        part = offsets[start : stop + 1]
        yield start, stop, Words(data[part[0] : part[-1]], part - part[0], table)


def _lists(rows: np.ndarray, n_rows: int, values: pa.Array) -> pa.Array:
    """Lists of values, which come in the order of their rows."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n_rows))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def with_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` and (_sl_id, _sl_mark), which name a row: rows with equal ones have equal texts."""
    mark = F.xxhash64(text_or_empty(text_col))
    last = F.lit(2**63 - 1) - F.abs(mark % F.lit(2**40))
    keys = [F.coalesce(F.col(id_col).cast("bigint"), last).alias("_sl_id"), mark.alias("_sl_mark")]
    # the filter holds for every row; written here, inner and outer joins read the rows by the same plan and share its shuffle
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns], *keys).where("_sl_id is not null")


def repeated_spans(keyed: DataFrame, length: int = 50, seed: int = 16, text_col: str = "text") -> DataFrame:
    """(id, mark, start, words, owner, owner_start) for rows ``with_keys``: runs of words to remove, and where the owner has them.

    ``owner_start`` is null for copies of a whole document. The rows are shuffled by their keys with all their columns, so
    that a later join of the same rows by these keys can use the same shuffle.
    """
    ship(keyed.sparkSession)
    width = length - seed + 1
    n_columns, at_text = len(keyed.columns), keyed.columns.index(text_col)
    texts = keyed.select(F.col("_sl_id").alias("id"), F.col("_sl_mark").alias("mark"), F.col(f"`{text_col}`").alias("text"))

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, words in _parts(batch.column(2)):
                runs, least, _ = _seeds(words, length, seed)
                at = _chosen(runs, least, width)
                rows = words.row_of_word()[at]
                joined = [xxhash.xxh3_128_digest(b" ".join((t.as_py() or "").encode("utf-8", "surrogatepass").split())) for t in batch.column(2)[start:stop]]
                columns = [
                    batch.column(0)[start:stop],
                    batch.column(1)[start:stop],
                    pa.array(joined, pa.binary()),
                    pa.array(np.diff(words.rows), pa.int64()),
                    _lists(rows, stop - start, pa.array(runs[at].view(np.int64))),
                    _lists(rows, stop - start, pa.array((at - words.rows[rows]).astype(np.int32))),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["id", "mark", "sequence", "n_words", "seeds", "places"])

    fields = "id bigint, mark bigint, sequence binary, n_words bigint, seeds array<bigint>, places array<int>"
    rows = saved(texts.mapInArrow(seeds, fields).where(F.col("n_words") >= length))

    first = saved(rows.groupBy("sequence").agg(F.min("id").alias("owner"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sequence", "owner"))
    with_owner = rows.join(first, "sequence", "left")
    copies = with_owner.where("owner < id").select("id", "mark", F.lit(0).cast("bigint").alias("start"), F.col("n_words").alias("words"), "owner", F.lit(None).cast("bigint").alias("owner_start"))
    sources = with_owner.where("owner is null or owner = id").select("id", "mark", F.explode(F.arrays_zip("seeds", "places")).alias("s")).select("id", "mark", F.col("s.seeds").alias("run"), F.col("s.places").alias("place"))
    again = sources.groupBy("run").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("run")
    places = sources.join(again, "run").groupBy("id", "mark").agg(F.sort_array(F.collect_set("place")).alias("places"))
    places = saved(places)

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, words in _parts(batch.column(at_text)):
                runs, least, window = _seeds(words, length, seed)
                marked = batch.column(n_columns)[start:stop]
                at = marked.flatten().to_numpy() + np.repeat(words.rows[:-1], marked.value_lengths().to_numpy())
                known = np.full(len(runs), _MOST)
                known[at] = runs[at]
                if len(runs) >= width:
                    window[: len(runs) - width + 1] &= _sliding(known, width, np.minimum) == least[: len(runs) - width + 1]
                firsts = np.flatnonzero(window)
                spans = np.full(len(firsts), length)
                hashes = words.span_hashes(firsts, spans)
                second = mixed(words.span_hashes(firsts + length // 3, spans - length // 3))
                row = words.row_of_word()[firsts]
                take = pa.array(row + start)
                columns = [
                    pa.array(hashes.view(np.int64)),
                    pa.array((second >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                    pa.array((firsts - words.rows[row]).astype(np.int32)),
                    batch.column(n_columns - 2).take(take),
                    batch.column(n_columns - 1).take(take),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["edge", "check", "place", "id", "mark"])

    near = keyed.join(places.select(F.col("id").alias("_sl_id"), F.col("mark").alias("_sl_mark"), "places"), ["_sl_id", "_sl_mark"])
    near = near.select(*[F.col(f"`{c}`") for c in keyed.columns], "places")
    graph = near.mapInArrow(edges, "edge bigint, check int, place int, id bigint, mark bigint")
    owners = graph.groupBy("edge", "check").agg(F.min("id").alias("owner"), F.max("id").alias("last"), F.min_by("place", "id").alias("owner_place"))
    # the join has a key of its own, so that both sides are shuffled for it and Spark may split large keys
    key = F.col("edge").bitwiseXOR(F.lit(1))
    owners = owners.where("owner < last").select(key.alias("key"), "check", "owner", "owner_place")
    hits = graph.select(key.alias("key"), "check", "place", "id", "mark").join(owners, ["key", "check"])
    hits = hits.where("owner < id").select("id", "mark", "place", "owner", "owner_place").repartition("id", "mark")

    in_order = Window.partitionBy("id", "mark").orderBy("place")
    follows = (F.col("place") == F.lag("place").over(in_order) + 1) & (F.col("owner") == F.lag("owner").over(in_order)) & (F.col("owner_place") == F.lag("owner_place").over(in_order) + 1)
    hits = hits.distinct().withColumn("path", F.sum(F.when(follows, 0).otherwise(1)).over(in_order))
    paths = hits.groupBy("id", "mark", "path").agg(F.min("place").cast("bigint").alias("start"), (F.count(F.lit(1)) + length - 1).alias("words"), F.min("owner").alias("owner"), F.min("owner_place").cast("bigint").alias("owner_start"))
    return paths.drop("path").unionByName(copies)


def without_repeats(docs: DataFrame, length: int = 50, seed: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the kept words, joined by one space, as text, and the columns n_words and n_removed after the others."""
    names = docs.columns
    keyed = with_keys(docs, id_col, text_col)
    spans = repeated_spans(keyed, length, seed, text_col)
    spans = spans.groupBy(F.col("id").alias("_sl_id"), F.col("mark").alias("_sl_mark")).agg(F.collect_set(F.struct("start", "words")).alias("_sl_spans"))
    rows = keyed.join(spans, ["_sl_id", "_sl_mark"], "left").select(*[F.col(f"`{c}`") for c in names], "_sl_spans")
    place = names.index(text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in smaller(whole, place)):
            texts, totals, removed = [], [], []
            for text, spans in zip(batch.column(place), batch.column(len(names)), strict=True):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                totals.append(len(words))
                if spans.is_valid:
                    keep = np.ones(len(words), bool)
                    for span in spans.as_py():
                        keep[span["start"] : span["start"] + span["words"]] = False
                    words = [words[k] for k in np.flatnonzero(keep)]
                removed.append(totals[-1] - len(words))
                texts.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            columns = [batch.column(k) for k in range(len(names))]
            columns[place] = pa.array(texts, batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(totals, pa.int64()), pa.array(removed, pa.int64())], [*names, "n_words", "n_removed"])

    fields = [T.StructField(f.name, f.dataType) for f in docs.schema]
    schema = T.StructType([*fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    return rows.mapInArrow(cut, schema)
