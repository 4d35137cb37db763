"""Conversation repair: the cheapest edits that give each conversation a legal order of roles.

A conversation is legal when its role initials are ``(s?(ua)+)?``. Rows are kept (0), given another role (3) or deleted (4, which
blank rows and repetitions require); empty rows can be inserted (3); a truncated row that stays costs 3 more. The edits' initials
in order are the audit; of equally cheap repairs the one with the least audit in ASCII order is taken.

That choice is one minimum over integers. The weight of a sequence of edits has its cost in the high digits and the letters of its
audit in digits of fixed width below, the first letter highest, padded with zeros behind the last: an audit sorts before those it
begins. Going backwards over the rows, an edit adds its cost and shifts its letter in, and each node of the graph (row, state of
the order) keeps the least weight.

Long conversations are cut into segments of ``SEGMENT`` rows, so that weights stay short and no task holds a conversation. A
segment takes any insertions before its rows and none behind, so two audits of a segment are never beginnings of each other, and
for each pair of states the least weight is best whatever follows. Segments are solved side by side for all pairs of states; a
pass from each conversation's end streams over them and picks, below the letters, by the order of what follows (one more digit);
a pass from its start follows the picks. Both hold a few numbers. Rows are then edited segment by segment.

Defined results: null roles and texts are one space; rows are ordered by turn (nulls first), role and text; a null id is one
conversation; repeated rows are repetitions of the first; a conversation without rows has no report and no repaired row (see
``repair_report``); an empty table gives an empty table. Other columns are never read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from sourceloom.llm.common import saved, ship, tasks
from sourceloom.llm.merkle import leaf_hash
from sourceloom.llm.ranks import placed

#: Rows of a segment.
SEGMENT = 128

#: White space of texts.
BLANK = " \t\n\x0b\x0c\r"

#: Letters of an audit in ASCII order; a letter's digit is its place, from 1.
LETTERS = "DIKR"
DELETE, INSERT, KEEP, REROLE = range(1, 5)
COSTS = {DELETE: 4, INSERT: 3, KEEP: 0, REROLE: 3}
TRUNCATED = 3

#: States of the order: nothing yet, behind a system row, behind a user row, behind an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
ROLES = {"u": "user", "a": "assistant"}
#: The initial that a changed or inserted row takes in each state.
WANTED = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
#: Insertions that end the order legally from each state.
CLOSING = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}

Row = dict[str, object]


# ----- the least weight of a segment ------------------------------------------------------------------------------


def _prepend(weight: int, letter: int, cost: int, bits: int) -> int:
    digits = weight & ((1 << bits) - 1)
    return ((weight >> bits) + cost) << bits | letter << (bits - 3) | digits >> 3


def _least(weights: list[int | None]) -> int | None:
    return min((w for w in weights if w is not None), default=None)


def segment_weights(symbols: str, bits: int) -> list[list[int | None]]:
    """weights[s][t]: the least weight of edits of the rows that lead from state s to state t; None if there are none.

    ``symbols`` has two characters for each row: its role's initial and its fault (k none, t truncated, b blank, d repetition).
    """
    columns = []
    for end in range(4):
        after: list[int | None] = [0 if s == end else None for s in range(4)]
        for k in range(len(symbols) - 2, -1, -2):
            initial, fault = symbols[k], symbols[k + 1]
            stays = TRUNCATED if fault == "t" else 0
            before: list[int | None] = []
            for s in range(4):
                moves = [(DELETE, s, 0)]
                if fault in "kt":
                    moves += [(REROLE, NEXT[s, WANTED[s]], stays)]
                    moves += [(KEEP, NEXT[s, initial], stays)] if (s, initial) in NEXT else []
                before.append(_least([_prepend(after[t], x, COSTS[x] + more, bits) for x, t, more in moves if after[t] is not None]))
            # insertions before the row: a second one would lead back to the state or cost more than deleting
            inserted = [before[NEXT[s, WANTED[s]]] for s in range(4)]
            after = [_least([w, None if i is None else _prepend(i, INSERT, COSTS[INSERT], bits)]) for w, i in zip(before, inserted, strict=True)]
        columns.append(after)
    return [[columns[t][s] for t in range(4)] for s in range(4)]


def letters(weight: int, bits: int) -> str:
    """The audit in a weight."""
    out = []
    for shift in range(bits - 3, -1, -3):
        digit = weight >> shift & 7
        if not digit:
            break
        out.append(LETTERS[digit - 1])
    return "".join(out)


# ----- streams over sorted rows -----------------------------------------------------------------------------------


def _stream(rows: DataFrame, step: Callable[[Iterator[Row]], Iterator[Row]], schema: str) -> DataFrame:
    """``step`` over the rows of each task, in their order."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[Row] = []
        size = 0
        for row in step(r for batch in batches for r in batch.to_pylist()):
            out.append(row)
            size += 64 + len(row.get("text") or "")
            if size > 1 << 20:
                yield pa.RecordBatch.from_pylist(out, kinds)
                out, size = [], 0
        yield pa.RecordBatch.from_pylist(out, kinds)

    ship(rows.sparkSession)
    return rows.mapInArrow(run, schema)


def _sorted(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Rows dealt by ``keys`` and sorted by them and ``order``; large groups spill, they are never held."""
    return rows.repartition(tasks(rows.sparkSession), *keys).sortWithinPartitions(*[F.col(k).asc_nulls_first() for k in keys], *order)


# ----- faults and segments ----------------------------------------------------------------------------------------


def ordered(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, place): the rows in order, place from 0 in each conversation."""
    blank = F.lit(" ")
    chosen = rows.select(
        F.col(id_col).alias("conv"), F.col(turn_col).cast("bigint").alias("turn"), F.coalesce(role_col, blank).alias("role"), F.coalesce(text_col, blank).alias("text")
    )
    return placed(chosen, "conv", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")])


def _segments(rows: DataFrame) -> DataFrame:
    """(conv, seg, symbols, turns): one row for each segment of ``ordered`` rows."""
    end = F.rtrim("text", F.lit(BLANK))
    marks = rows.select(
        "conv",
        "turn",
        "place",
        F.unhex(leaf_hash([F.col("conv"), F.col("role"), F.col("text")])).alias("same"),
        F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("-").alias("initial"),
        F.when(end == "", "b").when(~F.right(end, F.lit(1)).isin(".", "!", "?"), "t").otherwise("k").alias("fault"),
    )
    firsts = marks.groupBy("same").agg(F.min("place").alias("first"))
    marks = marks.join(firsts, "same")
    fault = F.when(F.col("fault") == "b", "b").when(F.col("first") < F.col("place"), "d").otherwise(F.col("fault"))
    row = F.struct("place", F.concat("initial", fault).alias("symbol"), "turn")
    segments = marks.groupBy("conv", F.floor(F.col("place") / SEGMENT).alias("seg")).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    return segments.select("conv", "seg", F.array_join("rows.symbol", "").alias("symbols"), F.col("rows.turn").alias("turns"))


def _solved(segments: DataFrame) -> DataFrame:
    """The segments with, for each state before them, the audit that is best for all that follows and the state it leads to."""
    bits = 3 * 2 * SEGMENT

    def solve(rows: Iterator[Row]) -> Iterator[Row]:
        conv: object = ()
        costs: list[int] = []
        ranks: list[int] = []
        for row in rows:
            if (row["conv"],) != conv:
                conv, ranks = (row["conv"],), [CLOSING[s] for s in range(4)]
                costs = [COSTS[INSERT] * n for n in ranks]
                last = True
            weights = segment_weights(row["symbols"], bits)
            # cost, letters, then the order of what follows
            best = [min(((w + (costs[t] << bits)) << 2 | ranks[t], t) for t, w in enumerate(ws) if w is not None) for ws in weights]
            costs = [w >> (bits + 2) for w, _ in best]
            strings = [w & ((1 << (bits + 2)) - 1) for w, _ in best]
            order = sorted(set(strings))
            ranks = [order.index(x) for x in strings]
            yield row | {"pieces": [letters(w >> 2 & ((1 << bits) - 1), bits) for w, _ in best], "leads": [t for _, t in best], "cost": costs[START], "last": last}
            last = False

    kind = segments.schema["conv"].dataType.simpleString()
    schema = f"conv {kind}, seg bigint, symbols string, turns array<bigint>, pieces array<string>, leads array<int>, cost bigint, last boolean"
    return saved(_stream(_sorted(segments, ["conv"], F.col("seg").desc()), solve, schema))


def plan(rows: DataFrame) -> DataFrame:
    """The repair of ``ordered`` rows, one row for each segment:

    (conv, seg, state, piece, closing, cost, blank, duplicate, truncated, illegal, turns, low, high): the state before the segment,
    its part of the audit, the insertions behind its last row, and what it adds to the counts of the conversation.
    """

    def follow(rows: Iterator[Row]) -> Iterator[Row]:
        conv: object = ()
        state, initial, turn = START, None, None
        for row in rows:
            if (row["conv"],) != conv:
                conv, state, initial, turn = (row["conv"],), START, None, None
            symbols, turns = row["symbols"], [x for x in row["turns"] if x is not None]
            initials = ([] if initial is None else [initial]) + list(symbols[::2])
            pairs = [a + b for a, b in zip(initials[:-1], initials[1:], strict=True)]
            known = len(set(turns)) - (bool(turns) and turns[0] == turn)
            piece, leads = row["pieces"][state], row["leads"][state]
            closing = CLOSING[leads] if row["last"] else 0
            faults = symbols[1::2]
            yield {
                "conv": row["conv"],
                "seg": row["seg"],
                "state": state,
                "piece": piece,
                "closing": closing,
                "cost": row["cost"] if row["seg"] == 0 else 0,
                "blank": faults.count("b"),
                "duplicate": faults.count("d"),
                "truncated": faults.count("t"),
                "illegal": sum(p not in ("su", "ua", "au") for p in pairs),
                "turns": known,
                "low": turns[0] if turns else None,
                "high": turns[-1] if turns else None,
            }
            state, initial, turn = leads, initials[-1], turns[-1] if turns else turn

    solved = _solved(_segments(rows))
    kind = solved.schema["conv"].dataType.simpleString()
    schema = (
        f"conv {kind}, seg bigint, state int, piece string, closing int, cost bigint, blank bigint, duplicate bigint, truncated bigint, "
        "illegal bigint, turns bigint, low bigint, high bigint"
    )
    return saved(_stream(_sorted(solved, ["conv"], F.col("seg")), follow, schema))


def repair_report(plans: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit), one row for each conversation of a ``plan``."""
    piece = F.concat("piece", F.expr("repeat('I', closing)"))
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    wide = F.max("high").cast("decimal(20,0)") - F.min("low") + 1 - F.sum("turns")
    gaps = F.least(F.coalesce(wide, F.lit(0)), F.lit((1 << 63) - 1).cast("decimal(20,0)")).cast("bigint").alias("gaps")
    audit = F.array_join(F.sort_array(F.collect_list(F.struct("seg", piece.alias("piece")))).getField("piece"), "").alias("audit")
    return plans.groupBy("conv").agg(gaps, *sums, audit)


def repaired(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """(conv, seg, line, edit, role, text): the rows of the repaired conversations, in the order of seg and line."""

    def edit(rows: Iterator[Row]) -> Iterator[Row]:
        audit, at, line, state, left = "", 0, 0, START, 0
        for row in rows:
            if row["piece"] is not None:
                audit, at, line, state, left = row["piece"], 0, 0, row["state"], row["n"]
                continue
            left -= 1
            stop = False
            while at < len(audit) and not (stop and left):
                letter = audit[at]
                if stop and letter != "I":
                    break
                at += 1
                stop = stop or letter != "I"
                if letter == "D":
                    continue
                initial = row["role"][:1] if letter == "K" else WANTED[state]
                state = NEXT[state, initial]
                role = row["role"] if letter == "K" else ROLES[initial]
                yield {"conv": row["conv"], "seg": row["seg"], "line": line, "edit": letter, "role": role, "text": "" if letter == "I" else row["text"]}
                line += 1

    seg = F.floor(F.col("place") / SEGMENT)
    given = rows.select("conv", seg.alias("seg"), "place", "role", "text", F.lit(None).cast("string").alias("piece"), F.lit(0).alias("state"), F.lit(0).alias("n"))
    piece = F.concat("piece", F.expr("repeat('I', closing)"))
    n = F.length(F.translate("piece", "I", ""))  # rows of the segment
    heads = plans.select("conv", "seg", F.lit(-1).cast("bigint").alias("place"), F.lit("").alias("role"), F.lit("").alias("text"), piece.alias("piece"), "state", n.alias("n"))
    kind = rows.schema["conv"].dataType.simpleString()
    both = _sorted(given.unionByName(heads), ["conv", "seg"], F.col("place"))
    return _stream(both, edit, f"conv {kind}, seg bigint, line int, edit string, role string, text string")


def digests(lines: DataFrame) -> DataFrame:
    """(conv, repaired_sha256): hash of the repaired ``role:text`` lines of each conversation, read as a stream."""

    def digest(rows: Iterator[Row]) -> Iterator[Row]:
        conv: object = ()
        hashed = hashlib.sha256()
        for row in rows:
            if (row["conv"],) != conv:
                if conv:
                    yield {"conv": conv[0], "repaired_sha256": hashed.hexdigest()}
                conv, hashed = (row["conv"],), hashlib.sha256()
            else:
                hashed.update(b"\n")
            hashed.update(f"{row['role']}:{row['text']}".encode())
        if conv:
            yield {"conv": conv[0], "repaired_sha256": hashed.hexdigest()}

    kind = lines.schema["conv"].dataType.simpleString()
    return _stream(_sorted(lines, ["conv"], F.col("seg"), F.col("line")), digest, f"conv {kind}, repaired_sha256 string")
