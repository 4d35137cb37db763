"""Exact top-k inner products by sorted lists without random access (NRA).

Candidates are divided into blocks, queries too; a task handles one block of queries against one block of candidates, so no
side is ever whole in a task or on the driver. For each component a block keeps the list of its candidates in order of
that component; a query reads it from the end that gives the larger products. All lists are read to the same depth, in turns:

- a candidate's lower bound is the sum of the products read so far, with the worst product of the list for each list in which it
  has not come up yet; its upper bound has the product at the depth reached instead;
- a query's threshold is its k-th largest lower bound. Candidates whose upper bound is below it, seen or not, cannot be among the
  k best. A query stops reading when at most ``resolve`` x k candidates are left;
- the final scores of those are resolved exactly, and the block's k best go on. The k best of all blocks are the result.

The bounds of all queries of a block against all candidates are four matrix products per turn. Ties go to the smaller id.

Components are floor(scale x value). Scores are integers, exact in 64 bits: arithmetic is in 32-bit floats where all partial
sums are below 2^24, in 64-bit floats below 2^53, else in 64-bit integers (which wrap around, as Spark's do).

Defined results: vectors that are null or hold null or non-finite components take no part; vectors of another length than the
query's are no candidates for it; empty vectors score 0; a row is no candidate for a query of the same id, also if
repeated; rows without an id take no part. An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourceloom.llm.common import saved, ship

#: Rows of a block of candidates and of queries. 8,192 x 1,024 bounds of 4 bytes are 32 MB, a few of which exist at a time.
CANDIDATES, QUERIES = 8192, 1024

#: Depths of the turns, as shares of a list; a query that is not resolved by then has read its lists to the end.
DEPTHS = (0.5, 0.75, 0.875, 1.0)


def _arithmetic(left: np.ndarray, right: np.ndarray) -> type:
    most = float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0)) * max(1, left.shape[1])
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64


class SortedLists:
    """The candidates of a block, and for each component their places in its order."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.values = ids[order], values[order]
        self.ranked = np.sort(self.values, axis=0)  # ascending: read from the end for positive weights, from the start for negative ones

    def bounds(self, positive: np.ndarray, negative: np.ndarray, depth: int, kind: type) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) bounds of queries (rows) and candidates (columns) after ``depth`` entries of each list."""
        n = len(self.ids)
        top, bottom = self.ranked[n - depth], self.ranked[depth - 1]  # last value read, from either end
        from_end, from_start = self.values >= top, self.values <= bottom
        upper = positive @ np.where(from_end, self.values, top).T.astype(kind)
        upper += negative @ np.where(from_start, self.values, bottom).T.astype(kind)
        if depth == n:
            return upper, upper
        lower = positive @ np.where(from_end, self.values, self.ranked[0]).T.astype(kind)
        lower += negative @ np.where(from_start, self.values, self.ranked[-1]).T.astype(kind)
        return lower, upper


def block_top(query_ids: np.ndarray, queries: np.ndarray, lists: SortedLists, k: int, resolve: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, candidate id, score) of the k best of a block for each query."""
    n = len(lists.ids)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    waiting = np.arange(len(query_ids))
    kind = _arithmetic(queries, lists.values)
    for share in DEPTHS:
        if not len(waiting) or not n:
            break
        depth = max(1, int(np.ceil(share * n)))
        own = queries[waiting].astype(kind)
        lower, upper = lists.bounds(np.maximum(own, 0), np.minimum(own, 0), depth, kind)
        itself = lists.ids[None, :] == query_ids[waiting][:, None]
        worst = np.iinfo(np.int64).min if kind is np.int64 else -np.inf
        lower = np.where(itself, worst, lower)
        left = ~itself
        if n > k:
            threshold = np.partition(lower, n - k, axis=1)[:, n - k]
            left &= upper >= threshold[:, None]
        done = (left.sum(1) <= resolve * k) | (depth == n)
        for row in np.flatnonzero(done):
            at = np.flatnonzero(left[row])
            score = (lists.values[at].astype(kind) @ own[row]).astype(np.int64)
            best = np.lexsort((lists.ids[at], -score))[:k]
            found.append((np.full(len(best), query_ids[waiting[row]]), lists.ids[at[best]], score[best]))
        waiting = waiting[~done]
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    values = flat.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(flat), -1) if len(flat) else values.reshape(0, 0)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k largest inner products of each query row with all other rows."""
    ship(vectors.sparkSession)
    values = F.transform(F.col(vector_col), lambda x: F.floor(F.lit(scale) * x.cast("double")))
    sound = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & sound)
    rows = saved(rows.select(F.col(id_col).cast("bigint").alias("id"), values.alias("values"), F.size(vector_col).alias("width"), is_query.alias("asks")))
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("asks"), 1)).alias("m")).first()
    candidate_blocks, query_blocks = -(-sizes.n // CANDIDATES) or 1, -(-sizes.m // QUERIES) or 1

    hashed = F.xxhash64("id", "values")
    candidates = rows.select("id", "values", "width", F.pmod(hashed, F.lit(candidate_blocks)).alias("cb"))
    candidates = candidates.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    queries = rows.where("asks").select("id", "values", "width", F.pmod(hashed, F.lit(query_blocks)).cast("int").alias("qb"))
    queries = queries.dropDuplicates(["id", "values"]).withColumn("cb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(candidate_blocks - 1).cast("bigint"))))

    def search(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64) for _ in range(3)]
        if queries.num_rows and candidates.num_rows:
            lists = SortedLists(candidates.column("id").to_numpy(), _matrix(candidates.column("values")))
            out = block_top(queries.column("id").to_numpy(), _matrix(queries.column("values")), lists, k)
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.int64())})

    cell = ["cb", "qb", "width"]
    found = queries.groupBy(*cell).cogroup(candidates.groupBy(*cell)).applyInArrow(search, "query_id bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
