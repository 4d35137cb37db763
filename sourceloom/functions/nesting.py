"""Nesting inside of one file, in one pass over its code: what the marks and lines of a file enclose.

A file is one row, and what closes a declaration depends on all before it. Sorting every bracket and line of the corpus for windows
costs ten times as much as reading them in order, so these steps run in Python workers over Arrow batches and give one array of
structs a file. Placement, the fields of declarations, sums and joins stay with Spark.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import from_arrow_type

from .lexer import CLOSE, CODE_RANGE, CODES, CONTINUED, FIRST_CODE, HEAD, NOTE, OPEN, SOFT

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

#: Files whose results are held as Python objects at a time.
_STEP = 64

_INT, _LONG, _TEXT = pa.int32(), pa.int64(), pa.string()
#: A mark with the number of its piece, line and decision points there, and those where its block ends (NULL: nowhere).
SPAN = pa.struct(
    [("id", _INT), ("mark", _TEXT), ("line_no", _INT), ("decisions", _INT), ("end_line", _INT), ("end_decisions", _INT), ("all_decisions", _INT)]
)
#: A Python declaration: first and last line of its block, and what the lexer notes of its head.
DECLARATION = pa.struct([("word", _TEXT), ("name", _TEXT), ("start", _INT), ("last", _INT), ("detail", _TEXT)])
_SCOPES = pa.list_(pa.struct([("name", _TEXT), ("line_no", _INT), ("word", _TEXT)]))
#: A line (L), the begin (S) or the end (C) of a scope, or an else that counts (K), with the ``depth`` scopes around it, outermost first.
EVENT = pa.struct(
    [("kind", _TEXT), ("line_no", _INT), ("tokens", _INT), ("broken", pa.bool_()), ("name", _TEXT), ("detail", _TEXT), ("start", _INT)]
    + [("last", _INT), ("depth", _INT), ("around", _SCOPES)]
)

_TOKEN = re.compile(f"{OPEN}[^{CLOSE}]*+{CLOSE}|[(\\[{{]++|[)\\]]++|\\}}|\n++|{HEAD}++")
_TOKEN_BY_LINE = re.compile(f"{OPEN}[^{CLOSE}]*+{CLOSE}|[(\\[{{]++|[)\\]]++|\\}}|\n|{HEAD}++|;")


def spans(code: str, by_line: bool, by_semicolon: bool) -> list[tuple]:
    """Marks of a text of marks, brackets, line breaks, semicolons and decision points, each with the end of its block.

    A curly bracket answers the mark just before it on its level. A lambda ends at a line break or semicolon of its level, unless a
    bracket came between; so does a mark at a semicolon, if ``by_semicolon``.
    """
    out: list[list] = []
    latest: dict[int, int] = {}  # by level: the mark that waits, by place in ``out``; -1 for none
    level, line, points, piece = 0, 1, 0, 0
    split = by_line or by_semicolon
    if not split:
        code = code.replace("()", "").replace("[]", "").replace("()", "")
    for m in (_TOKEN_BY_LINE if split else _TOKEN).finditer(code):
        token = m[0]
        sign = token[0]
        if sign in "([{":
            level += len(token)
        elif sign in ")]":
            level -= len(token)
        elif sign == "}":
            level -= 1
            if by_semicolon:
                continue
            at = latest.get(level, -1)
            if at >= 0 and not out[at][1].startswith(_LAMBDA):
                out[at][4], out[at][5] = line, points
            latest[level] = -1
            piece += 1
        elif sign == OPEN:
            latest[level] = len(out)
            out.append([piece, token, line, points, None, None])
            piece += 1
        elif sign == HEAD:
            points += len(token)
        else:
            if sign == "\n" and (by_semicolon or not by_line):
                line += len(token)
                continue
            if split:
                at = latest.get(level, -1)
                if at >= 0 and (by_semicolon or out[at][1].startswith(_LAMBDA)):
                    out[at][4], out[at][5] = line, points
                    latest[level] = -1
                piece += 1
            line += sign == "\n"
    return [(*row, points) for row in out]


_LAMBDA = f"{OPEN}lambda|"

_SPACE = " \t\n\x0b\f\r"
_SCOPE = re.compile(r"[ \t\f]*(?:async[ \t]+)?(def|class)[ \t]+([A-Za-z0-9_]+)")
_DEF = re.compile(r"[ \t\f]*(?:async[ \t]+)?def[ \t]+[A-Za-z0-9_]")
_CLAUSE = re.compile(r"[ \t\f]*(?:async[ \t]+)?(if|elif|for|while|try|except|else)\b")
_DECISIONS = re.compile(r"\b(?:if|elif|for|while|except|and|or|assert)\b")
_CASE = re.compile(r"[ \t\f]*case[ \t]+[^ \t\n\x0b\f\r][^\n\r\x85\u2028\u2029]*:")
_CASE_REST = re.compile(r"[ \t\f]*case[ \t]+_[ \t]*:")
_GUARD = re.compile(r"([ \t\n\x0b\f\r]*case[ \t\n\x0b\f\r][^\n\r\x85\u2028\u2029]*?)[ \t\n\x0b\f\r]if[ \t\n\x0b\f\r]")
_LEVEL = re.compile(r"^([ \t\f]*)(?:async[ \t]+)?(?:def|class)[ \t]", re.M)
_ELSE_COUNTS = ("for", "while", "try", "except")


def _indent(lead: str) -> int:
    return len(lead) + 7 * lead.count("\t")


def _tokens(text: str, is_head: bool) -> int:
    """Decision points of a line; a signature and the guard word of a case do not count."""
    if is_head:
        if _DEF.match(text):
            text = text[text.index(HEAD) + 1 :] if HEAD in text else ""
        elif _CASE.match(text):
            guard = _GUARD.match(text)
            rest = f"{guard[1]} {text[guard.end():]}" if guard else text
            return len(_DECISIONS.findall(rest)) + (not _CASE_REST.match(text))
    return len(_DECISIONS.findall(text))


def _python(code: str, lines: bool) -> tuple[list[tuple], list[tuple]]:
    """Declarations in the order of their ends, and (if ``lines``) events of Python code with heads on one line each.

    A line that is indented less closes the scopes of the levels it leaves; so does the end of the file.
    """
    found: list[tuple] = []
    events: list[tuple] = []
    levels = sorted({_indent(lead) for lead in _LEVEL.findall(code)}, reverse=True)
    opened: dict[int, tuple | None] = {}  # by level: the scope that waits for its end
    clause: dict[int, str] = {}
    around: list[tuple] = []  # by depth: the scope opened last
    nest = depth = 0
    joined, last_no = False, None
    last_indent, top = None, None
    rows = code.split("\n")
    last = len(rows) - 1
    while last > 0 and not rows[last].split(NOTE, 1)[0].strip(_SPACE):
        last -= 1

    def close(level: int, line_no: int, broken: bool, before: int) -> None:
        nonlocal nest
        scope = opened.get(level)
        if scope is None:
            return
        opened[level] = None
        start, word, name, detail = scope
        end = max(before, start)
        found.append((word, name, start, end, detail))
        if lines:
            events.append(("C", line_no, 0, broken, None, None, start, end, nest, around[:nest]))
        nest -= 1

    for k, row in enumerate(rows[: last + 1]):
        text = row.partition(NOTE)[0]
        if not text.strip(_SPACE) and k:
            continue
        line_no = k + 1
        count = text.count
        delta = count("(") + count("[") + count("{") - count(")") - count("]") - count("}")
        continued = text[-1:] == CONTINUED
        if CONTINUED in text:
            text = text.replace(CONTINUED, "")
        is_head = depth <= 0 and not joined and bool(text.strip(_SPACE))
        softs = text.count(SOFT)
        after = depth + delta
        broken = after < 0 or '"' in text or "'" in text or (k == last and after != 0)
        indent = scope = word = None
        if is_head:
            lead = text[: len(text) - len(text.lstrip(" \t\f"))]
            indent = _indent(lead)
            if top is not None and indent <= top:
                for level in levels:
                    if indent <= level <= top:
                        close(level, line_no, broken, last_no)
            scope = _SCOPE.match(text)
            if scope:
                detail = row.rpartition(NOTE)[2] if NOTE in row else None
                opened[indent] = (line_no, scope[1], scope[2], detail)
                del around[nest:]
                around.append((scope[2], line_no, scope[1]))
                if lines:
                    events.append(("S", line_no, 0, broken, scope[2], detail, None, None, nest, around[: nest + 1]))
                nest += 1
            top = indent - (not scope)
        if lines:
            tokens = _tokens(text, is_head)
            places = ",".join([str(n) for n, part in enumerate(text.split(SOFT)) if part.strip(_SPACE)]) if softs else None
            events.append(("L", line_no, tokens, broken, None, places, None, None, nest, around[:nest]))
            if is_head:
                word = _CLAUSE.match(text)
                if word:
                    if word[1] == "else" and clause.get(indent) in _ELSE_COUNTS:
                        events.append(("K", line_no, 1, broken, None, None, None, None, nest, around[:nest]))
                    clause[indent] = word[1]
        depth, joined, last_no = after, continued, line_no + softs
        if k == last:
            for level in levels:
                close(level, line_no, broken, last_no)
    return found, events


def python_declarations(code: str) -> list[tuple]:
    return _python(code, False)[0]


def shared_python_declarations(codes: list[str]) -> list[tuple]:
    """``python_declarations`` of files that share their path: lines of the same number stand side by side, ends before begins."""
    rows = []
    for code in codes:
        levels = sorted({_indent(lead) for lead in _LEVEL.findall(code)}, reverse=True)
        texts = enumerate(code.split("\n"), 1)
        rows += [(k, row, levels) for k, row in texts if k == 1 or row.split(NOTE, 1)[0].strip(_SPACE)]
    rows.sort(key=lambda row: row[0])
    found: list[tuple] = []
    opened: dict[int, tuple | None] = {}
    depth, joined, before, top = 0, False, None, None
    begins: list[tuple] = []

    def close(level: int, until: int) -> None:
        scope = opened.get(level)
        opened[level] = None
        if scope is not None:
            start, word, name, detail = scope
            found.append((word, name, start, max(until, start), detail))

    for n, (k, row, levels) in enumerate(rows):
        text = row.partition(NOTE)[0]
        count = text.count
        delta = count("(") + count("[") + count("{") - count(")") - count("]") - count("}")
        continued = text[-1:] == CONTINUED
        text = text.replace(CONTINUED, "")
        if depth <= 0 and not joined and text.strip(_SPACE):
            indent = _indent(text[: len(text) - len(text.lstrip(" \t\f"))])
            if top is not None:
                for level in levels:
                    if indent <= level <= top:
                        close(level, before)
            scope = _SCOPE.match(text)
            if scope:
                begins.append((indent, (k, scope[1], scope[2], row.rpartition(NOTE)[2] if NOTE in row else None)))
            top = indent - (not scope)
        depth, joined, before = depth + delta, continued, k + text.count(SOFT)
        if n + 1 == len(rows) or rows[n + 1][0] != k:
            opened.update(begins)
            begins = []
    for level in rows[-1][2] if rows else ():
        close(level, before)
    return found


def python_events(code: str) -> list[tuple]:
    return _python(code, True)[1]


def django_operations(body: str) -> list[str]:
    """Operations in the list of a Django migration, in order.

    A line at nesting zero that ends in a comma closes an operation, and so does one that starts the next.
    """
    blocks: list[list[str]] = [[]]
    square = rounded = 0
    ended = False
    for line in body.split("\n"):
        square += line.count("[") - line.count("]")
        rounded += line.count("(") - line.count(")")
        flat = square == 0 and rounded == 0
        if ended or flat and "migrations." in line:
            blocks.append([])
        blocks[-1].append(line)
        ended = flat and line.strip().endswith(",")
    operations = ["\n".join(block).strip() for block in blocks]
    return [operation for operation in operations if "migrations." in operation]


def _columns(rows: list, kind: pa.DataType) -> pa.Array:
    """Tuples as an array of structs; lists of tuples as an array of lists of them."""
    if pa.types.is_list(kind):
        ends = [0]
        for row in rows:
            ends.append(ends[-1] + len(row or ()))
        flat = _columns([x for row in rows if row for x in row], kind.value_type)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat, type=kind, mask=pa.array([row is None for row in rows], pa.bool_()))
    if pa.types.is_struct(kind):
        fields = list(zip(*rows)) if rows else [()] * kind.num_fields
        return pa.StructArray.from_arrays([_columns(list(x), f.type) for x, f in zip(fields, kind)], fields=list(kind))
    return pa.array(rows, kind)


def _column(step: Callable[..., list[tuple]], item: pa.DataType) -> Callable:
    kind = pa.list_(item)

    @arrow_udf(from_arrow_type(kind))
    def run(*columns: pa.Array) -> pa.Array:
        def parts() -> Iterable[pa.Array]:
            for k in range(0, len(columns[0]), _STEP):
                rows = zip(*[c.slice(k, _STEP).to_pylist() for c in columns])
                yield _columns([None if row[0] is None else step(*row) for row in rows], kind)

        return pa.concat_arrays([pa.array([], kind), *parts()])

    return run


#: Column functions: of a marked text and its two switches, of the list of a migration, and of Python code.
spans_of, operations_of = _column(spans, SPAN), _column(django_operations, _TEXT)
declarations_of, events_of = _column(python_declarations, DECLARATION), _column(python_events, EVENT)


# ----- files as rows, whether they share their path or not ---------------------------------------------------------

#: Bytes of code that one step handles; longer files are steps of their own.
_STEP_BYTES = 1 << 22


def _gathered(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """Runs of files whose path stands once (False), and all files of one path that several share (True).

    Rows of a path follow each other, the last column has their number, and the last but one their code.
    """
    held: list[pa.RecordBatch] = []
    wanted = 0
    for batch in batches:
        copies = batch.column(batch.num_columns - 1).to_numpy()
        offsets = np.concatenate([[0], np.cumsum(_lengths(batch.column(batch.num_columns - 2)))])
        at, n = 0, len(copies)
        while at < n:
            if not wanted and copies[at] == 1:
                others = np.flatnonzero(copies[at:] != 1)
                fits = int(np.searchsorted(offsets, offsets[at] + _STEP_BYTES, side="right")) - 1
                stop = max(at + 1, min(fits, at + int(others[0]) if len(others) else n))
                yield batch.slice(at, stop - at), False
            else:
                wanted = wanted or int(copies[at])
                stop = min(n, at + wanted)
                held.append(batch.slice(at, stop - at))
                wanted -= stop - at
                if not wanted:
                    yield pa.Table.from_batches(held).combine_chunks().to_batches()[0], True
                    held = []
            at = stop


def _lengths(codes: pa.Array) -> np.ndarray:
    return np.diff(_buffers(codes)[1])


def _buffers(codes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of texts; NULL counts as empty."""
    codes = codes.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(codes.buffers()[1], np.int64)[codes.offset : codes.offset + len(codes) + 1]
    raw = codes.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


_IS_MARK, _IS_CLOSE, _IS_BREAK, _IS_SEMICOLON = 1, 2, 3, 4
_KINDS, _STEPS = np.zeros(256, np.int8), np.zeros(256, np.int8)
_KINDS[[ord(c) for c in "}\n;"]] = _IS_CLOSE, _IS_BREAK, _IS_SEMICOLON
_STEPS[[ord(c) for c in "([{)]}"]] = 1, 1, 1, -1, -1, -1
_SIGNS = (_KINDS != 0) | (_STEPS != 0)


def block_spans(data: np.ndarray, offsets: np.ndarray, by_line: np.ndarray, by_semicolon: np.ndarray) -> tuple[np.ndarray, ...]:
    """Marks of many texts, as ``spans`` finds them: (row, first byte, byte behind, number of its piece, line, line where its block
    ends or 0, decision points before it, those before its end, those of the text).

    A mark's block ends at the next sign of its level that answers it, unless another mark or closing bracket of the level stands
    between. So marks and signs are sorted by text, level and place, and each mark looks at its neighbour.
    """
    edges = np.flatnonzero((data == ord(OPEN)) | (data == ord(CLOSE)))
    opens = data[edges] == ord(OPEN)
    starts = edges[opens & ~np.concatenate([[False], opens[:-1]])]  # a mark inside of another one is part of it
    closes = edges[~opens]
    ends = closes[np.searchsorted(closes, starts)] if len(starts) else starts
    bounds = np.zeros(len(data) + 1, np.int8)
    bounds[starts] += 1
    bounds[ends + 1] -= 1
    outside = np.cumsum(bounds[:-1], dtype=np.int8) == 0
    signs = np.flatnonzero(_SIGNS[data] & outside)
    all_points = np.flatnonzero((data == ord(HEAD)) & outside)  # what ends a mark is no decision point
    place = np.concatenate([signs, starts])
    kind = np.concatenate([_KINDS[data[signs]], np.full(len(starts), _IS_MARK, np.int8)])
    step = np.concatenate([_STEPS[data[signs]], np.zeros(len(starts), np.int8)])
    order = np.argsort(place, kind="stable")
    place, kind, step = place[order], kind[order], step[order].astype(np.int64)
    firsts = np.searchsorted(place, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(firsts))
    first = firsts[row]  # the first event of each event's text
    is_break = (kind == _IS_BREAK).astype(np.int64)
    level, line = np.cumsum(step), np.cumsum(is_break) - is_break
    level, line = level - (level - step)[first], line - line[first] + 1
    is_mark = kind == _IS_MARK
    end_of, end_points = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    key = (row << 32) + level + (1 << 31)
    lined, lambdas = by_line[row], is_mark & by_line[row]
    for k, letter in enumerate(_LAMBDA.encode()):
        at = np.flatnonzero(lambdas)
        lambdas[at] = data[np.minimum(place[at] + k, len(data) - 1)] == letter
    plain, statement = ~by_semicolon[row], by_semicolon[row]
    piece = is_mark | (plain & ((kind == _IS_CLOSE) | (lined & (kind > 0)))) | (statement & (kind == _IS_SEMICOLON))
    pieces = np.cumsum(piece) - piece
    points = np.searchsorted(all_points, place)
    before, behind = (np.searchsorted(all_points, edge)[row] for edge in (offsets[:-1], offsets[1:]))
    for events, marks, answers in (
        (plain & (is_mark | (kind == _IS_CLOSE)), plain & ~lambdas, (_IS_CLOSE,)),
        (plain & lined & (kind > 0), plain & lambdas, (_IS_BREAK, _IS_SEMICOLON)),
        (statement & (is_mark | (kind == _IS_SEMICOLON)), statement, (_IS_SEMICOLON,)),
    ):
        at = np.flatnonzero(events)
        at = at[np.argsort(key[at], kind="stable")]
        this, after = at[:-1], at[1:]
        answered = is_mark[this] & marks[this] & (key[this] == key[after]) & np.isin(kind[after], answers)
        end_of[this[answered]] = line[after[answered]]
        end_points[this[answered]] = points[after[answered]]
    found = pieces - pieces[first], line, end_of, points - before, end_points - before, behind - before
    return row[is_mark], starts, ends + 1, *[x[is_mark] for x in found]


_WRITTEN = np.ones(256, bool)
_WRITTEN[[ord(OPEN), ord(CLOSE), ord(HEAD), *range(FIRST_CODE, FIRST_CODE + CODES)]] = False


def _texts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Parts of a text without marks and codes of brackets."""
    sizes = ends - starts
    if not len(sizes):
        return pa.array([], _TEXT)
    firsts = np.cumsum(sizes) - sizes
    signs = data[np.arange(sizes.sum()) + np.repeat(starts - firsts, sizes)]
    kept = _WRITTEN[signs]
    offsets = np.concatenate([[0], np.cumsum(np.add.reduceat(kept, firsts, dtype=np.int64))])
    return pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(signs[kept])]).cast(_TEXT)


_UNMARKED = re.compile(f"[{OPEN}{CLOSE}{HEAD}{CODE_RANGE}]")


def shared_spans(codes: list[str], by_line: list[bool], lines: list[int], by_semicolon: bool) -> list[tuple]:
    """(lines, piece, mark without codes, line, line where its block ends, decision points before it, those before its end, those of
    all) of files that share their path: pieces of the same number stand side by side."""
    pieces: list[tuple[int, int, str]] = []
    for n, code in enumerate(codes):
        ends = ";" if by_semicolon else "\n;}" if by_line[n] else "}"
        piece = re.compile(f"[^{OPEN}{ends}]*+(?:{OPEN}[^{CLOSE}]*+{CLOSE}|[{ends}])|[^{OPEN}{ends}]++\\Z")
        pieces += [(pos, n, m[0]) for pos, m in enumerate(piece.finditer(code))]
    pieces.sort(key=lambda x: x[0])
    marks: dict[int, list[tuple]] = {}
    end_of: dict[int, int] = {}
    end_points: dict[int, int] = {}
    last: dict[tuple[str, int], tuple] = {}  # by use and level: the piece that waits, and the kind of its mark
    level, broken, ended_lines, points, at = 0, 0, 0, 0, 0
    while at < len(pieces):
        stop = at
        while stop < len(pieces) and pieces[stop][0] == pieces[at][0]:
            stop += 1
        group = []
        for pos, n, piece in pieces[at:stop]:
            plain, is_mark, _ = piece.partition(OPEN)
            sign = "" if is_mark else piece[-1]
            count = plain.count
            level += sum(map(count, "([{")) - sum(map(count, ")]}"))
            broken += count("\n") - (sign == "\n")
            points += count(HEAD)
            group.append((pos, n, piece[len(plain) :] if is_mark else "", sign))
        closing = sum(sign == "}" for *_, sign in group)
        for pos, n, mark, sign in group:
            closing -= sign == "}"
            depth, line = level + closing, broken + ended_lines + 1
            ended_lines += sign == "\n"
            if mark:
                part = _UNMARKED.sub("", mark).split("|", 3)
                marks.setdefault(pos, []).append((part[0], part, line, lines[n], points))
                for use in ("block", "line", "statement"):
                    last[use, depth] = (pos, part[0])
                continue
            ended = None
            if by_semicolon and sign == ";":
                ended = last.get(("statement", depth), (None,))[0]
            elif not by_semicolon and sign == "}":
                waits, kind = last.get(("block", depth), (None, None))
                ended = waits if kind is not None and kind != "lambda" else None
            elif not by_semicolon and sign in ("\n", ";"):
                waits, kind = last.get(("line", depth), (None, None))
                ended = waits if kind == "lambda" else None
            if ended is not None:
                end_of[ended] = min(line, end_of.get(ended, line))
                end_points[ended] = min(points, end_points.get(ended, points))
            for use, answers in (("block", "}"), ("line", "\n;}"), ("statement", ";")):
                if sign and sign in answers:
                    last[use, depth] = (pos, None)
        at = stop
    out = []
    for pos, found in marks.items():
        best = max(found, key=lambda x: x[:3])
        out.append((max(x[3] for x in found), pos, "|".join(best[1]), best[2], end_of.get(pos), best[4], end_points.get(pos), points))
    return out


FILE_SPANS = (
    "path string, language string, lines int, id int, mark string, line_no bigint, end_line bigint, decisions bigint, "
    "end_decisions bigint, all_decisions bigint"
)


def file_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks without codes, with their lines and decision points (``FILE_SPANS``), of rows (path, language, lines, by_line, code,
    copies), see ``_gathered``."""
    names = [x.split()[0] for x in FILE_SPANS.split(", ")]
    kinds = (_INT, _INT, _TEXT, *[_LONG] * 5)
    for files, shared in _gathered(batches):
        path, language, lines, by_line, code, _ = files.columns
        if shared:
            kept = [x for x in zip(code.to_pylist(), by_line.to_pylist(), lines.to_pylist()) if x[0] is not None]
            found = shared_spans(*map(list, zip(*kept)), language[0].as_py() == "sql") if kept else []
            of = pa.array([0] * len(found), pa.int64())
            columns = [pa.array(x, kind) for x, kind in zip(list(zip(*found)) or [()] * len(kinds), kinds)]
        else:
            data, offsets = _buffers(code)
            lined = np.array(by_line.fill_null(False).to_pylist(), bool)
            row, start, stop, piece, line, end, *points = block_spans(data, offsets, lined, np.array([x == "sql" for x in language.to_pylist()], bool))
            of, none = pa.array(row), end == 0
            counts = [pa.array(x, _LONG, mask=mask) for x, mask in zip((line, end, *points), (None, none, None, none, None))]
            columns = [lines.take(of).cast(_INT), pa.array(piece, _INT), _texts(data, start, stop), *counts]
        yield pa.RecordBatch.from_arrays([path.take(of), language.take(of), *columns], names)


FILE_DECLARATIONS = "path string, word string, name string, start int, last int, detail string"


def file_declarations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Python declarations (``FILE_DECLARATIONS``) of rows (path, code, copies), see ``_gathered``."""
    names = [x.split()[0] for x in FILE_DECLARATIONS.split(", ")]
    for files, shared in _gathered(batches):
        paths, codes = files.column(0).to_pylist(), files.column(1).to_pylist()
        if shared:
            found = [(paths[0], *x) for x in shared_python_declarations([code for code in codes if code is not None])]
        else:
            found = [(path, *x) for path, code in zip(paths, codes) if code is not None for x in python_declarations(code)]
        columns = list(zip(*found)) or [()] * len(names)
        kinds = (_TEXT, _TEXT, _TEXT, _INT, _INT, _TEXT)
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds)], names)


# ----- measured functions of Python files -------------------------------------------------------------------------

#: A measured function: those outside of any other scope, and methods of outermost classes.
FUNCTIONS = "array<struct<line_number:int,name:string,complexity:bigint,end_line_number:int,is_method:boolean>>"
_FUNCTION = pa.struct([("line_number", _INT), ("name", _TEXT), ("complexity", _LONG), ("end_line_number", _INT), ("is_method", pa.bool_())])

_BLANK, _LEAD, _STEP_OF = np.zeros(128, bool), np.zeros(128, bool), np.zeros(128, np.int8)
_BLANK[[ord(c) for c in _SPACE]] = True
_LEAD[[ord(c) for c in " \t\f"]] = True
_STEP_OF[[ord(c) for c in "([{)]}"]] = 1, 1, 1, -1, -1, -1
_WORD = np.array([chr(c).isalnum() or c == ord("_") for c in range(128)])
_DECISION_WORDS = ("if", "or", "for", "and", "elif", "while", "except", "assert")
#: First two letters of words that begin a scope, an arm or a clause.
_BEGINS = {a << 8 | b: word for word in ("async", "def", "class", "case", "if", "elif", "for", "while", "try", "except") for a, b in [word[:2].encode()]}


def _word_mask(signs: np.ndarray) -> np.ndarray:
    """Which signs are parts of words."""
    known = _WORD[np.minimum(signs, 127)] & (signs < 128)
    others = np.unique(signs[signs > 127])
    letters = others[[chr(c).isalnum() for c in others.tolist()]] if len(others) else others
    return known | np.isin(signs, letters) if len(letters) else known


def _decisions(signs: np.ndarray) -> np.ndarray:
    """Places of the words that are decision points."""
    word = np.concatenate([[False], _word_mask(signs), [False]])
    edges = np.flatnonzero(word[1:] != word[:-1])
    begins, sizes = edges[::2], edges[1::2] - edges[::2]
    found = []
    for size in (2, 3, 4, 5, 6):
        at = begins[sizes == size]
        for wanted in _DECISION_WORDS:
            if len(wanted) == size:
                some = at[signs[at] == ord(wanted[0])]
                for k, letter in enumerate(wanted[1:], 1):
                    some = some[signs[some + k] == ord(letter)]
                found.append(some)
    return np.sort(np.concatenate(found))


def python_functions(codes: list[str]) -> list[tuple[list[tuple], bool]]:
    """Measured functions of each of many Python texts without notes, and whether the text is broken.

    Lines of deeper scopes belong to nobody. Signs are counted by line for all texts at once; only lines that begin with a word of
    interest are looked at one by one, and scopes are closed by the next line that is indented no more than they are.
    """
    text = "\n".join(codes) + "\n"
    signs = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    sizes = np.array([len(code) + 1 for code in codes])
    ends = np.flatnonzero(signs == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    first_line = np.searchsorted(starts, np.cumsum(sizes) - sizes)
    small = np.minimum(signs, 127)  # sign 127 is none of those looked for
    by_line = lambda mask: np.add.reduceat(mask, starts, dtype=np.int64)
    full = ~_BLANK[small]
    kept = by_line(full) > 0
    kept[first_line] = True
    is_code = (by_line(full & (signs != ord(CONTINUED))) > 0)[kept]
    delta, softs = by_line(_STEP_OF[small])[kept], by_line(signs == ord(SOFT))[kept]
    quoted = by_line((signs == 34) | (signs == 39))[kept] > 0
    file = (np.searchsorted(first_line, np.arange(len(starts)), side="right") - 1)[kept]
    line_no = np.flatnonzero(kept) - first_line[file] + 1
    starts, ends = starts[kept], ends[kept]
    top = np.searchsorted(file, np.arange(len(codes) + 1))  # the first kept line of each file
    total = np.cumsum(delta)
    after = total - (total - delta)[top[file]]
    is_last = np.zeros(len(file), bool)
    is_last[top[1:] - 1] = True
    continued = signs[np.maximum(ends - 1, 0)] == ord(CONTINUED)
    joined = np.concatenate([[False], continued[:-1]])
    joined[top[:-1]] = False
    head = (after - delta <= 0) & ~joined & is_code
    broken = np.zeros(len(codes), bool)
    broken[file[(after < 0) | quoted | (is_last & (after != 0))]] = True
    last_nos, line_nos = (line_no + softs).tolist(), line_no.tolist()

    code_at = np.flatnonzero(~_LEAD[small])
    begin = code_at[np.searchsorted(code_at, starts)]
    tabs = np.concatenate([[0], np.cumsum(signs == 9)])
    indent = begin - starts + 7 * (tabs[begin] - tabs[starts])

    points = _decisions(signs)
    tokens = np.searchsorted(points, ends) - np.searchsorted(points, starts)
    scopes: dict[int, tuple[str, str]] = {}
    bodies: dict[int, int] = {}
    clauses: dict[tuple[int, int], str] = {}
    pair = small[begin].astype(np.int64) << 8 | small[np.minimum(begin + 1, len(small) - 1)]
    looked = np.flatnonzero(head & np.isin(pair, list(_BEGINS)))
    for k, start, end in zip(looked.tolist(), starts[looked].tolist(), ends[looked].tolist()):
        scope = _SCOPE.match(text, start, end)
        if scope:
            scopes[k] = scope[1], scope[2]
            if scope[1] == "def":
                body = text.find(HEAD, start, end)
                bodies[k] = body if body >= 0 else end
            continue
        word = _CLAUSE.match(text, start, end)
        if word:
            level = int(file[k]), int(indent[k])
            tokens[k] += word[1] == "else" and clauses.get(level) in _ELSE_COUNTS
            clauses[level] = word[1]
        elif text.startswith("ca", int(begin[k])):
            tokens[k] = _tokens(text[start:end].replace(CONTINUED, ""), True)
    defs = np.fromiter(bodies, np.int64, len(bodies))
    tokens[defs] = np.searchsorted(points, ends[defs]) - np.searchsorted(points, np.fromiter(bodies.values(), np.int64, len(bodies)))
    points_to = np.concatenate([[0], np.cumsum(tokens)]).tolist()

    found: list[list[tuple]] = [[] for _ in codes]
    open_: list[tuple[int, int, bool]] = []  # scopes around a line: level, line, whether it is measured
    inner: list[int] = []  # decision points of the scopes directly inside of each

    def close(k: int) -> None:
        level, at, measured = open_.pop()
        own = points_to[k] - points_to[at]
        inside = inner.pop()
        if inner:
            inner[-1] += own
        if measured:
            end = max(last_nos[k - 1], line_nos[at])
            found[file[at]].append((line_nos[at], scopes[at][1], own - inside + 1, end, bool(open_)))

    heads = np.flatnonzero(head)
    edges = iter([*top[1:].tolist()])
    edge = next(edges)
    for k, level in zip(heads.tolist(), indent[heads].tolist()):
        while k >= edge:
            while open_:
                close(edge)
            edge = next(edges)
        while open_ and level <= open_[-1][0]:
            close(k)
        if k in scopes:
            is_def = scopes[k][0] == "def"
            open_.append((level, k, is_def and (not open_ or len(open_) == 1 and scopes[open_[0][1]][0] == "class")))
            inner.append(0)
    while open_:
        close(edge)
    return [(sorted(functions), bad) for functions, bad in zip(found, broken.tolist())]


def shared_python_functions(codes: list[str]) -> tuple[list[tuple], bool]:
    """``python_functions`` of files that share their path, which are read as one.

    Lines of the same number stand side by side. Of those the ends of scopes come first, then begins, lines and clauses.
    """
    rows = []
    for code in codes:
        levels = sorted({_indent(lead) for lead in _LEVEL.findall(code)}, reverse=True)
        rows += [(k, row, levels) for k, row in enumerate(code.split("\n"), 1) if k == 1 or row.strip(_SPACE)]
    rows.sort(key=lambda row: row[0])
    opened: dict[int, tuple | None] = {}
    clauses: dict[int, str] = {}
    found: dict[int, list] = {}
    outer = inner = before = top = None
    depth = nest = 0
    joined = broken = False

    def owner(inside: int) -> int | None:
        if inside == 1 and outer[1] == "def":
            return outer[0]
        return inner[0] if inside == 2 and outer[1] == "class" and inner[1] == "def" else None

    def close(ends: list[tuple]) -> None:
        nonlocal nest
        for _, scope, until in sorted(ends, key=lambda x: -x[0]):
            if owner(nest) == scope[0]:
                found[scope[0]][2] = max(found[scope[0]][2] or 0, until, scope[0])
            nest -= 1

    def answered(levels: Iterable[int], until: int) -> list[tuple]:
        ends = []
        for level in levels:
            if opened.get(level) is not None:
                ends.append((level, opened[level], until))
            opened[level] = None
        return ends

    at = 0
    while at < len(rows):
        stop = at
        ends, begins, points, words = [], [], 0, []
        while stop < len(rows) and rows[stop][0] == rows[at][0]:
            line_no, text, levels = rows[stop]
            count = text.count
            after = depth + sum(map(count, "([{")) - sum(map(count, ")]}"))
            continued = text[-1:] == CONTINUED
            text = text.replace(CONTINUED, "")
            is_head = depth <= 0 and not joined and bool(text.strip(_SPACE))
            broken |= after < 0 or '"' in text or "'" in text or (stop + 1 == len(rows) and after != 0)
            points += _tokens(text, is_head)
            if is_head:
                indent = _indent(text[: len(text) - len(text.lstrip(" \t\f"))])
                if top is not None:
                    ends += answered([level for level in levels if indent <= level <= top], before)
                scope, word = _SCOPE.match(text), _CLAUSE.match(text)
                if scope:
                    begins.append((indent, (line_no, scope[1], scope[2])))
                if word:
                    words.append((indent, word[1]))
                top = indent - (not scope)
            depth, joined, before = after, continued, line_no + text.count(SOFT)
            stop += 1
        close(ends)
        for indent, scope in sorted(begins, key=lambda x: -x[0]):
            opened[indent] = scope
            outer, inner = (scope if nest == 0 else outer), (scope if nest == 1 else inner)
            nest += 1
            of = owner(nest)
            if of is not None:
                function = found.setdefault(of, [0, None, None])
                function[1] = max(function[1] or ("", False), (scope[2], nest == 2))
        for indent, word in words:
            points += word == "else" and clauses.get(indent) in _ELSE_COUNTS
            clauses[indent] = word
        of = owner(nest)
        if of is not None:
            found[of][0] += points
        at = stop
    close(answered(rows[-1][2] if rows else (), before))
    return sorted((k, s[0], n + 1, end, s[1]) for k, (n, s, end) in found.items()), bool(broken)


def file_functions(names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row for each path, its columns ``names`` and (functions, total, broken), of rows (path, ..., code, copies), see ``_gathered``.

    Of files that share their path the largest value of the other columns stays.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for files, shared in _gathered(batches):
            files = files.filter(files.column(files.num_columns - 2).is_valid())
            codes = files.column(files.num_columns - 2).to_pylist()
            if not codes:
                continue
            columns = [files.column(k) for k in range(len(names))]
            if shared:
                columns = [pa.array([max((x for x in c.to_pylist() if x is not None), default=None)], c.type) for c in columns]
                found = [shared_python_functions(codes)]
            else:
                found = python_functions(codes)
            totals = pa.array([sum(f[2] for f in functions) for functions, _ in found], _LONG)
            made = [_columns([functions for functions, _ in found], pa.list_(_FUNCTION)), totals, pa.array([bad for _, bad in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*columns, *made], [*names, "functions", "total", "broken"])

    return run
