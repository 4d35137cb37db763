"""Merkle manifest of a dataset, with an inclusion proof for each row, by a butterfly exchange.

A row is a leaf: the hash of its columns, each with its length in front. The leaves of a group, in the order of their ids, are
reduced in runs of ``fanout``; the roots of the groups, in the order of the groups, are reduced likewise to the root of all.

A partition of the tree is an aligned block of ``fanout ** levels`` consecutive leaves of a group. Each reduces its own leaves.
Then, round by round, blocks that differ in one digit of their number (base ``fanout``) swap the hashes of the subtrees they
stand in, and each computes the parent, redundantly with the other blocks below it. So after the last round each block holds all
upper siblings of its leaves and the root; nothing is passed down the tree. An exchange joins at most ``fanout`` rows, whatever
the size of a group: in the last subtree of a level, which may have fewer blocks, the last block stands in for those missing.
The roots of the groups go through the same exchange as leaves of one more tree.

Defined results: a null value is ``-``, an empty text ``0:``; null groups and ids come first; equal ids are ordered by their
hash, and repeated rows are leaves of their own; a group of one leaf is its own root; an empty table gives an empty table. Only
the named columns are read, so others cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourceloom.llm.common import saved, ship
from sourceloom.llm.ranks import placed

_STEP = "struct<before: string, after: string>"

#: Sibling hashes of one step up: those left of the node and those right of it, as joined hex.
Step = tuple[str, str]


def leaf_hash(columns: Sequence[Column]) -> Column:
    """Hash of values, each as its number of bytes, a colon and the value; null is ``-``."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def reduce_block(hashes: list[str], fanout: int, levels: int) -> tuple[str, list[list[Step]]]:
    """(root, the steps of each leaf) of one block after ``levels`` reductions."""
    steps: list[list[Step]] = [[] for _ in hashes]
    below = [[k] for k in range(len(hashes))]  # leaves under each node
    for _ in range(levels):
        parents, under = [], []
        for first in range(0, len(hashes), fanout):
            run = hashes[first : first + fanout]
            for k, _node in enumerate(run):
                step = ("".join(run[:k]), "".join(run[k + 1 :]))
                for leaf in below[first + k]:
                    steps[leaf].append(step)
            parents.append(_hash("".join(run)))
            under.append([leaf for nodes in below[first : first + fanout] for leaf in nodes])
        hashes, below = parents, under
    return hashes[0], steps


def fold(leaf: str, steps: list[Step]) -> str:
    """The root that a leaf and its siblings lead to."""
    for before, after in steps:
        leaf = _hash(before + leaf + after)
    return leaf


def _height(n: int, fanout: int) -> int:
    """Reductions until one node is left."""
    height = 0
    while n > 1:
        n, height = -(-n // fanout), height + 1
    return height


def _blocks(leaves: DataFrame, order: Sequence[Column], fanout: int, levels: int) -> DataFrame:
    """(grp, block, leaves): aligned blocks of the leaves of each group, one row each."""
    rows = placed(leaves, "grp", order).withColumn("block", F.floor(F.col("place") / fanout**levels))
    leaf = F.struct("place", *[c for c in leaves.columns if c != "grp"])
    return rows.groupBy("grp", "block").agg(F.sort_array(F.collect_list(leaf)).alias("leaves"))


def _own_levels(block: int, n: int, fanout: int, levels: int) -> int:
    """Reductions inside a block of n leaves: only a group's single block is reduced no further than to one node."""
    return levels if block else min(levels, _height(n, fanout))


def _block_roots(blocks: DataFrame, fanout: int, levels: int) -> DataFrame:
    """(grp, block, blocks, node): the hash that each block's own leaves reduce to, and the number of blocks of the group."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            nodes = [reduce_block(hashes, fanout, _own_levels(block, len(hashes), fanout, levels))[0] for block, hashes in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(nodes, pa.string())], ["grp", "block", "node"])

    kind = blocks.schema["grp"].dataType.simpleString()
    nodes = blocks.select("grp", "block", F.col("leaves.leaf").alias("hashes")).mapInArrow(reduce, f"grp {kind}, block bigint, node string")
    nodes = saved(nodes)
    sizes = nodes.groupBy(F.col("grp").alias("of")).agg((F.max("block") + 1).alias("blocks"))
    return nodes.join(sizes, F.col("grp").eqNullSafe(F.col("of"))).select("grp", "block", "blocks", "node")


def exchange(nodes: DataFrame, fanout: int) -> DataFrame:
    """Adds ``steps`` (from each block up to its group's root) to (grp, block, blocks, node); node becomes that root."""
    nodes = saved(nodes.withColumn("steps", F.expr(f"cast(array() as array<{_STEP}>)")))
    most = nodes.agg(F.max("blocks")).first()[0] or 1
    below = 1  # blocks under one node
    for _ in range(_height(most, fanout)):
        own = F.floor(F.col("block") / below)
        last = F.floor((F.col("blocks") - 1) / below)  # the level's last node, of which some blocks may be missing
        lacks = (F.col("block") == F.col("blocks") - 1) & (last > 0)
        low = F.col("block") % below
        # the block's own place in the swap, and those it stands in for
        sent = nodes.select(
            "*",
            own.alias("index"),
            F.explode(F.when(lacks & (low < below - 1), F.sequence(low, F.lit(below - 1).cast("bigint"))).otherwise(F.array(low))).alias("lane"),
            low.alias("low"),
        )
        party = Window.partitionBy("grp", F.floor(F.col("index") / fanout), "lane")
        met = sent.withColumn("run", F.sort_array(F.collect_list(F.struct("index", "node")).over(party))).where("lane = low")
        side = lambda test: F.array_join(F.transform(F.filter("run", test), lambda x: x.node), "")
        step = F.struct(side(lambda x: x["index"] < F.col("index")).alias("before"), side(lambda x: x["index"] > F.col("index")).alias("after"))
        up = last > 0  # the group still has several nodes
        nodes = met.select(
            "grp",
            "block",
            "blocks",
            F.when(up, F.sha2(F.array_join("run.node", ""), 256)).otherwise(F.col("node")).alias("node"),
            F.when(up, F.concat("steps", F.array(step))).otherwise(F.col("steps")).alias("steps"),
        )
        below *= fanout
    return nodes


def manifest(
    rows: DataFrame,
    columns: Sequence[str],
    group_col: str,
    id_col: str,
    fanout: int = 3,
    levels: int = 6,
    tampered: Sequence[Column] | None = None,
) -> DataFrame:
    """(id, leaf, subroot, root, proof, folded): one row per row of ``rows``.

    ``proof`` lists the siblings of each step, left and right of the node. ``folded`` is the root computed again from the proof and
    the leaf of the ``tampered`` columns (of the same length as ``columns``; None: untampered).
    """
    spark = rows.sparkSession
    ship(spark)
    leaf = leaf_hash([F.col(c) for c in columns])
    found = leaf if tampered is None else leaf_hash(list(tampered))
    leaves = rows.select(F.col(group_col).alias("grp"), F.col(id_col).alias("id"), leaf.alias("leaf"), found.alias("found"))
    blocks = saved(_blocks(leaves, [F.col("id").asc_nulls_first(), F.col("leaf")], fanout, levels))
    trees = saved(exchange(_block_roots(blocks, fanout, levels), fanout))

    roots = trees.where("block = 0").select(F.lit(0).alias("grp"), F.col("grp").alias("of"), F.col("node").alias("leaf"))
    tops = saved(_blocks(roots, [F.col("of").asc_nulls_first()], fanout, levels))
    above = exchange(_block_roots(tops, fanout, levels), fanout).select("block", F.col("node").alias("root"), F.col("steps").alias("over"))
    tops = tops.select("block", F.col("leaves.leaf").alias("hashes"), F.col("leaves.of").alias("of")).join(above, "block")
    group_kind = rows.schema[group_col].dataType.simpleString()
    id_kind = rows.schema[id_col].dataType.simpleString()

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, hashes, of, root, over in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                steps = reduce_block(hashes, fanout, _own_levels(block, len(hashes), fanout, levels))[1]
                over = [(s["before"], s["after"]) for s in over]
                made = [[dict(zip(("before", "after"), s, strict=True)) for s in [*x, *over]] for x in steps]
                kinds = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
                yield pa.RecordBatch.from_arrays([pa.array(of, batch.schema.field(2).type.value_type), pa.array([root] * len(of)), pa.array(made, kinds)], ["of", "root", "top"])

    tops = tops.select("block", "hashes", "of", "root", "over").mapInArrow(spread, f"of {group_kind}, root string, top array<{_STEP}>")
    subtrees = trees.select(F.col("grp").alias("tree"), F.col("block").alias("part"), F.col("node").alias("subroot"), "steps")
    upper = subtrees.join(tops, F.col("tree").eqNullSafe(F.col("of"))).select("tree", "part", "subroot", "root", F.concat("steps", "top").alias("steps"))
    whole = blocks.join(upper, F.col("grp").eqNullSafe(F.col("tree")) & (F.col("block") == F.col("part")))

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
        for batch in batches:
            for k in range(batch.num_rows):
                block, leaves, subroot, root, steps = (batch.column(c)[k].as_py() for c in range(5))
                hashes = [x["leaf"] for x in leaves]
                steps = [(s["before"], s["after"]) for s in steps]
                own = reduce_block(hashes, fanout, _own_levels(block, len(hashes), fanout, levels))[1]
                proofs = [[*x, *steps] for x in own]
                folded = [fold(x["found"], p) for x, p in zip(leaves, proofs, strict=True)]
                made = pa.array([[dict(zip(("before", "after"), s, strict=True)) for s in p] for p in proofs], kinds)
                ids = pa.array([x["id"] for x in leaves], batch.schema.field(1).type.value_type.field("id").type)
                columns = [ids, pa.array(hashes), pa.array([subroot] * len(hashes)), pa.array([root] * len(hashes)), made, pa.array(folded)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "leaf", "subroot", "root", "proof", "folded"])

    result = f"id {id_kind}, leaf string, subroot string, root string, proof array<{_STEP}>, folded string"
    return whole.select("block", "leaves", "subroot", "root", "steps").mapInArrow(prove, result)


def proof_hash(proof: Column) -> Column:
    """Hash of all siblings of a proof, from the leaf up, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), ""), 256)
