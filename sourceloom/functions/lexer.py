"""A pushdown lexer that blanks strings and comments and keeps the code inside of strings.

Templates and f-strings nest: code stands in strings, which stand in code. A regular expression cannot follow that, so this one
step runs in Python workers over Arrow batches. A stack holds the open literals and the code fields in them; regular expressions
find the next place where the state can change, so ordinary characters cost nothing. Each text is read once, forward only.

- A literal that holds code becomes the pieces of that code in round brackets; any other vanishes. Line breaks stay, so line
  numbers stay valid. A literal that does not end leaves its quote, and literals behind it are then read without fields.
- In brace languages each round bracket is followed by a code of its depth, of characters that are removed first. A pattern finds
  the bracket that belongs to another by repeating the code, however deep they nest (``brackets``).
- In Python the head of a declaration, and each decorator, stands on one line, followed by as many empty lines as it lost.
  ``HEAD`` ends a signature; behind ``NOTE`` come the decorators and parameters as written, with ``SOFT`` for line breaks.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_right
from collections.abc import Callable
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

#: Marks; these characters are removed from the input first.
OPEN, CLOSE, HEAD, CONTINUED, NOTE, PART = "\u0001", "\u0002", "\u0003", "\u0004", "\u0005", "\u0006"
#: A line break inside a head; white space to regular expressions.
SOFT = "\u000b"

#: Codes of bracket depths: one or more of these characters, which are removed from the input of coded texts first. They are of one
#: byte, so that a text of such characters stays one to Java, whose expressions and conversions take twice as long on others.
FIRST_CODE, CODES = 0x0E, 14
CODE_RANGE = "\x0e-\x1b"

_MARKS = re.compile("[\u0001-\u0006]")


def brackets(group: int) -> str:
    """Pattern of a round bracket and all up to the one that closes it; the ``group``-th group of the whole pattern is its code."""
    return rf"\(([{CODE_RANGE}]++)(?:[^)]++|\)(?!\{group}(?![{CODE_RANGE}])))*+\)\{group}"


def _depth_code(depth: int) -> str:
    code = chr(FIRST_CODE + depth % CODES)
    while depth >= CODES:
        depth //= CODES
        code += chr(FIRST_CODE + depth % CODES)
    return code


_DEPTH_CODES = [_depth_code(depth) for depth in range(4096)]


def _string(quote: str) -> str:
    """Pattern of a literal of one line with backslash escapes."""
    return rf"{quote}(?:[^{quote}\\\n]++|\\[\s\S])*+{quote}"


def _block(quote: str) -> str:
    """Pattern of a literal between triple quotes."""
    return rf"{quote * 3}(?:[^{quote}\\]++|\\[\s\S]|{quote}(?!{quote * 2}))*+{quote * 3}"


class Rules:
    """What a language's code consists of: patterns of its tokens, and how its literals with fields are written."""

    def __init__(self, comment: str, texts: dict[str, str], live: str, field: str, prefix: str = "", python: bool = False):
        self.comment, self.texts, self.live, self.field, self.prefix, self.python = comment, texts, live, field, prefix, python
        self.tokens: dict[tuple[bool, frozenset[str]], re.Pattern] = {}
        self.literals: dict[tuple[str, bool], re.Pattern] = {}

    def token(self, inside: bool, dead: frozenset[str]) -> re.Pattern:
        """Tokens of code, at the top or inside a field. Literals of the ``dead`` quotes are not looked for: they do not end."""
        if (inside, dead) not in self.tokens:
            texts = "|".join(pattern for quote, pattern in self.texts.items() if quote not in dead) or r"(?!)"
            shared = rf"(?P<comment>{self.comment})|(?P<live>{self.live})|(?P<text>{self.prefix}(?:{texts}))|(?P<quote>[\"'])"
            if self.python:
                rest = r"(?P<bracket>[()\[\]{}:]|![rsa](?=[:}])|!=)" if inside else r"(?P<joined>\\\n)"
            else:
                rest = r"(?P<slash>/)|(?P<bracket>\(++|\)++|[{}])" if inside else r"(?P<slash>/)|(?P<bracket>\(++|\)++)"
            self.tokens[inside, dead] = re.compile(f"{shared}|{rest}")
        return self.tokens[inside, dead]

    def literal(self, quote: str, verbatim: bool) -> re.Pattern:
        """Places in a literal where its state can change."""
        key = (quote, verbatim)
        if key not in self.literals:
            escape = '""' if verbatim else r"\\N\{[^{}\n]*\}|\\[^{]" if self.python else r"\\[\s\S]"
            double = r"|\{\{|\}\}" if self.field == "{" else ""
            self.literals[key] = re.compile(rf"(?P<skip>{escape}{double})|(?P<end>{re.escape(quote)})|(?P<field>{re.escape(self.field)})|(?P<line>\n)")
        return self.literals[key]

    def plain(self, quote: str, verbatim: bool) -> re.Pattern:
        """The rest of a literal that is read without fields."""
        q = quote[0]
        inner = '[^"]++|""' if verbatim else rf"[^{q}\\]++|\\[\s\S]|{q}(?!{q * 2})" if len(quote) == 3 else rf"[^{q}\\\n]++|\\[\s\S]" + (r"|\n" if q == "`" else "")
        return re.compile(rf"(?:{inner})*+{quote}")


_QUOTED = {q: _string(q) for q in "\"'"}
_BLOCKS = {q * 3: _block(q) for q in "\"'"}
_SLASHED = r"//[^\n]*+|/\*(?:[^*]++|\*(?!/))*+(?:\*/|\Z)"
_LIVE_PREFIX = r"(?<!\w)(?:[fFtT][rR]?|[rR][fFtT])"
RULES = {
    "python": Rules(
        comment=r"\#[^\n]*+",
        texts=_BLOCKS | _QUOTED,
        prefix=r"(?:(?<!\w)[rRbBuU]{1,2})?",
        live=rf"{_LIVE_PREFIX}(?:\"{{3}}|'{{3}}|\"|')",
        field="{",
        python=True,
    ),
    "script": Rules(comment=_SLASHED, texts=_QUOTED, live="`", field="${"),
    "brace": Rules(comment=_SLASHED, texts={'"""': rf"\$*{_block(chr(34))}", '@"': r"@\"(?:[^\"]++|\"\")*+\""} | _QUOTED, live=r"(?:\$@|@\$|\$)\"(?!\"\")", field="{"),
}

#: A regular expression literal; it stands behind an operator, a bracket, or a word that an expression follows.
_REGEX = re.compile(r"/(?![*/ ])(?:[^\n\\/\[]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*+\])++/[a-z]*")
_BEFORE_REGEX = re.compile(r"(?:[(=,:\[!&|?{};\n]|=>|\b(?:return|typeof|case))\Z")


class _Text:
    """The output so far, with the place in the input that each raw piece came from."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.places: list[int] = []

    def add(self, part: str, place: int = -1) -> None:
        if part:
            self.parts.append(part)
            self.places.append(place)

    def ends_for_regex(self) -> bool:
        tail = ""
        for part in reversed(self.parts):
            tail = part + tail
            kept = tail.rstrip(" \t")
            if kept and (len(kept) > 8 or kept[-1] not in "returntypeofcase"):
                break
        kept = re.sub(rf"\([{CODE_RANGE}]+\Z", "(", tail.rstrip(" \t"))
        return not kept or bool(_BEFORE_REGEX.search(kept))


def _lines(token: str, python: bool) -> str:
    """The line breaks of a token."""
    n = token.count("\n")
    if not n or not python or "\\\n" not in token:
        return "\n" * n
    return "".join((CONTINUED if token[k - 1] == "\\" else "") + "\n" for k in (m.start() for m in re.finditer("\n", token)))


def scan(text: str, rules: Rules, coded: bool = False) -> _Text:
    """Code of a text without its strings and comments; ``coded`` adds depth codes to round brackets."""
    out = _Text()
    stack: list[list] = []  # literals [quote, pattern, place in out, resume, fields, depth, one line]; fields [depth of brackets]
    at, depth, plain = 0, 0, False
    dead: dict[str, int] = {}  # quotes whose literals do not end before a place: all later ones up to there would not end either
    none: frozenset[str] = frozenset()

    def unended(quote: str, place: int) -> None:
        line = re.compile(rf"(?:[^{quote}\\\n]++|\\[\s\S]|{quote})*+") if quote in "\"'" else None
        dead[quote] = line.match(text, place).end() if line else len(text)

    def bracket(signs: str, place: int = -1) -> None:
        """One round bracket, or several of the same direction."""
        nonlocal depth
        n = len(signs)
        if signs[0] == "(":
            depths, depth = range(depth, depth + n), depth + n
        else:
            depths, depth = range(depth - 1, depth - n - 1, -1), max(depth - n, 0)
        if not coded:
            out.add(signs, place)
        elif max(depths[0], depths[-1]) < len(_DEPTH_CODES):
            out.add("".join([signs[0] + _DEPTH_CODES[max(d, 0)] for d in depths]), place)
        else:
            out.add("".join([signs[0] + _depth_code(max(d, 0)) for d in depths]), place)

    while True:
        if stack and len(stack[-1]) > 1:  # inside a literal
            literal = stack[-1]
            m = literal[1].search(text, at)
            kind = m.lastgroup if m else "none"
            if kind == "none" or (kind == "line" and literal[6]):
                first = stack[0]  # the outermost literal does not end: its quote stays, and nothing behind it has fields
                del out.parts[first[2] :], out.places[first[2] :]
                out.add(first[0], first[3] - 1)
                at, depth, plain, stack = first[3], first[5], True, []
                continue
            at = m.end()
            if kind == "line":
                out.add("\n")
                literal[4] += not rules.python
            elif kind == "skip" and "\n" in m[0]:
                out.add(_lines(m[0], rules.python))
            elif kind == "field":
                if literal[4]:
                    out.add(",")
                literal[4] += 1
                stack.append([0])
            elif kind == "end":
                stack.pop()
                if len(stack) and len(stack[-1]) > 1:  # the format behind a field ends with the field
                    continue
                depth = literal[5] + 1
                if literal[4]:
                    bracket(")")
                else:
                    depth = literal[5]
                    out.parts[literal[2]] = ""
            continue

        if dead:
            dead = {q: end for q, end in dead.items() if end > at}
        m = rules.token(bool(stack), frozenset(dead) if dead else none).search(text, at)
        if m is None:
            if not stack:
                out.add(text[at:], at)
                return out
            first = stack[0]
            del out.parts[first[2] :], out.places[first[2] :]
            out.add(first[0], first[3] - 1)
            at, depth, plain, stack = first[3], first[5], True, []
            continue
        out.add(text[at : m.start()], at)
        token, kind, at = m[0], m.lastgroup, m.end()
        if kind in ("comment", "text"):
            if kind == "text" and token[-2:] in ('""', "''") and text[at : at + 1] == token[-1]:
                unended(token[-1] * 3, at)  # an empty literal and a quote: three quotes that no others answer
            out.add(_lines(token, rules.python and kind == "text"))
        elif kind == "joined":
            out.add(CONTINUED + "\n")
        elif kind == "live":
            quote = token.lstrip("fFtTrR$@")
            verbatim = "@" in token
            if plain:  # as a literal without fields
                found = None if quote in dead else rules.plain(quote, verbatim).match(text, at)
                if not found and quote not in dead:
                    unended(quote, at)
                if found:
                    out.add(_lines(found[0], rules.python))
                    at = found.end()
                else:
                    out.add(quote, at - len(quote))
                continue
            one_line = len(quote) == 1 and quote != "`" and not verbatim
            stack.append([quote, rules.literal(quote, verbatim), len(out.parts), at, 0, depth, one_line])
            bracket("(")
        elif kind == "slash":
            found = None
            if "/" not in dead and out.ends_for_regex():
                found = _REGEX.match(text, at - 1)
                if not found:
                    line = text.find("\n", at)
                    dead["/"] = line if line >= 0 else len(text)
            at = found.end() if found else at
            if not found:
                out.add("/", at - 1)
        elif kind == "bracket" and not stack:
            bracket(token, at - len(token))
        elif kind == "bracket":
            inside = stack[-1]
            if token == "}" and inside[0] == 0:
                stack.pop()
            elif token == ":" and inside[0] == 0:
                # a format: literal text that ends with the field, and may hold fields itself
                outer = stack[-2]
                stack[-1] = ["}", _FORMAT, len(out.parts), outer[3], 1, depth, False]
            elif token[0] != "!" or token == "!=":
                inside[0] += len(token) * ((token[0] in "([{") - (token[0] in ")]}"))
                if token[0] in "()":
                    bracket(token, at - len(token))
                else:
                    out.add(token, at - len(token))
        else:
            if kind == "quote" and token not in dead:
                unended(token, at)
            out.add(token, at - 1)


#: A format specification ends with its field; it may hold fields.
_FORMAT = re.compile(r"(?P<end>\})|(?P<field>\{)|(?P<line>\n)")

_HEAD_LINE = re.compile(r"\n([ \t\f]*+)(?:(?:async[ \t]+)?(?:def|class)\b|@)")
# patterns that begin with one set of signs pass over all others at once
_HEAD_TOKEN = re.compile(rf"[()\[\]{{}}:\n{CONTINUED}](?:(?<=[(\[{{])[(\[{{]*+|(?<=[)\]}}])[)\]}}]*+|(?<={CONTINUED})\n|(?<=[:\n]))")
_HEAD_WORD = re.compile(r"[ \t\f]*(?:async[ \t]+)?(def|class)[ \t]+\w+[ \t]*")


def _gathered(out: _Text, source: str, noted: bool = True) -> str:
    """Python code with each head on one line, its signature's end marked and (if ``noted``) its written parts noted."""
    text = "".join(out.parts)
    starts = list(accumulate(map(len, out.parts), initial=0)) if noted else []

    def written(a: int, b: int) -> str:
        """The input between two raw characters of the output, both included."""
        place = lambda k: (out.places[i := bisect_right(starts, k) - 1], k - starts[i])
        (first, before), (last, behind) = place(a), place(b)
        whole = source[first + before : last + behind + 1] if first >= 0 and last >= 0 else text[a : b + 1]
        return whole.replace("\n", SOFT)

    done: list[str] = []
    at = counted = depth = 0
    decorators: list[str] = []
    for m in _HEAD_LINE.finditer("\n" + text):
        begin, word_end = m.start(), m.end() - 1  # the line's first sign, and the place behind its first word
        if begin < at:
            continue
        count = text[counted:begin].count
        depth += count("(") + count("[") + count("{") - count(")") - count("]") - count("}")
        counted = begin
        if depth > 0 or text[begin - 2 : begin] == CONTINUED + "\n":
            continue
        decorator = text[word_end - 1] == "@"
        name = None if decorator else _HEAD_WORD.match(text, begin)
        if name is None and not decorator:
            continue
        level, end, colon, opened, closed = 0, len(text), -1, -1, -1
        breaks: list[tuple[int, int]] = []
        for t in _HEAD_TOKEN.finditer(text, begin):
            signs = t[0]
            sign, n = signs[0], len(signs)
            if sign in "([{":
                if level <= 0 < level + n and signs[-level] == "(" and opened < 0:
                    opened = t.start() - level
                level += n
            elif sign in ")]}":
                if 0 < level <= n and opened >= 0 and closed < 0 and signs[level - 1] == ")":
                    closed = t.start() + level - 1
                level -= n
            elif sign == ":":
                if level == 0 and name:
                    colon, end = t.start(), t.end()
                    break
                continue
            elif level <= 0 and sign[0] != CONTINUED:
                end = t.start()
                break
            else:
                breaks.append(t.span())
        else:
            if level > 0:
                break  # the file ends inside a bracket: nothing further is gathered
        if name and colon < 0:
            continue
        done.append(text[at:begin])
        line, last = [], begin
        for a, b in breaks:
            line += [text[last:a], SOFT]
            last = b
        done += [*line, text[last:end]]
        rest = text.find("\n", end)
        rest = len(text) if rest < 0 else rest
        lost = "\n" * len(breaks)
        if name is None:
            if noted:
                last = end - 1
                while text[last] in f" \t\f{SOFT}":
                    last -= 1
                decorators.append(written(word_end - 1, last))
            done.append(lost)
            at = end
            continue
        done += [HEAD if name[1] == "def" else "", text[end:rest]]
        if noted:
            note = written(opened, closed) if 0 <= opened < colon and closed > 0 else ""
            done += [NOTE, SOFT.join(decorators), PART, note]
        done.append(lost)
        decorators = []
        at = rest
    done.append(text[at:])
    return "".join(done)


def _clean(text: str) -> str:
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    return _MARKS.sub("", text)


class _NotSimple(Exception):
    """A sign whose meaning depends on what stands around it."""


# Texts without literals that hold code, slashes in code and literals that do not end: what is left are tokens
# that are told apart by their own signs. Every branch begins with a plain character, so the search passes over all others at once.
_SIMPLE_STRINGS = rf"{_QUOTED[chr(34)]}|{_QUOTED[chr(39)]}|\"|'"
_SIMPLE_PYTHON = re.compile(rf"\#[^\n]*+|{_BLOCKS[chr(34) * 3]}|{_BLOCKS[chr(39) * 3]}|{_SIMPLE_STRINGS}|\\\n")
_SIMPLE_BRACES = re.compile(rf"//[^\n]*+|/\*(?:[^*]++|\*(?!/))*+(?:\*/|\Z)|/|{_SIMPLE_STRINGS}")
_PREFIX = re.compile(r"(?<!\w)[fFtTrRbBuU]{1,2}\Z")
_FIELDS = {"script": re.compile("`"), "brace": re.compile("[$@]\"|\"\"\"")}
_OWN_CODES = re.compile(f"[{CODE_RANGE}]")


def _coded(text: str) -> str:
    """A text with the code of its depth behind each round bracket."""
    if "(" not in text and ")" not in text:
        return text
    signs = np.frombuffer(text.encode(), np.uint8)
    at = np.flatnonzero((signs == 40) | (signs == 41))
    opens = signs[at] == 40
    total = np.cumsum(np.where(opens, 1, -1))
    depth = total - np.minimum(np.minimum.accumulate(total), 0) - opens  # a bracket that closes nothing leaves the depth at zero
    places, codes = [at + 1], [depth % CODES]
    while len(deeper := np.flatnonzero(depth >= CODES)):
        at, depth = at[deeper], depth[deeper] // CODES
        places.append(at + 1)
        codes.append(depth % CODES)
    return np.insert(signs, np.concatenate(places), (np.concatenate(codes) + FIRST_CODE).astype(np.uint8)).tobytes().decode()


def _simple_python(text: str) -> _Text | None:
    """As ``scan`` in one pass, for texts where each token is known by its first sign; None for others."""
    out = _Text()
    at = 0
    for m in _SIMPLE_PYTHON.finditer(text):
        token = m[0]
        if len(token) == 1 and token != "#":
            return None
        if token[-2:] in ('""', "''") and token[0] != "#" and text[m.end() : m.end() + 1] == token[-1]:
            return None
        before = text[at : m.start()]
        if token[0] in "\"'" and before[-1:] in "fFtTrRbBuU" and before:
            prefix = _PREFIX.search(text[max(at - 1, 0) : m.start()])
            if prefix and not set(prefix[0]).isdisjoint("fFtT"):
                return None
            if prefix:
                before = before[: -len(prefix[0])]
        out.add(before, at)
        at = m.end()
        if token[0] == "\\":
            out.add(CONTINUED + "\n")
        elif token[0] != "#" and "\n" in token:
            out.add(_lines(token, True))
    out.add(text[at:], at)
    return out


def _simple_braces(text: str, language: str) -> str | None:
    """As the coded ``scan`` in two passes, for texts where each token is known by its first sign; None for others."""
    if _FIELDS[language].search(text):
        return None

    def lines(m: re.Match) -> str:
        token = m[0]
        if len(token) == 1:
            raise _NotSimple
        return "\n" * token.count("\n")

    try:
        return _coded(_SIMPLE_BRACES.sub(lines, text))
    except _NotSimple:
        return None


# Texts whose literals all end, and whose fields hold as many opening as closing brackets: their depth is that of the text.
_SCRIPT_SIGN, _SCRIPT_FIELD_SIGN = re.compile("[`'\"/]"), re.compile("[`'\"/(){}]")
_TEMPLATE = re.compile(r"(?:[^`\\$\n]++|\\[^\n]|\$(?!\{))*+(`|\$\{|\n|\\\n)")
_STRINGS = {q: re.compile(p) for q, p in _QUOTED.items()}
_COMMENT = re.compile(_SLASHED)


def _ended_script(text: str) -> str | None:
    """As the coded ``scan``, for texts without surprises; None for others."""
    out = _Text()
    parts = out.parts
    add = parts.append
    at = 0
    levels: list[tuple[int, int, int, int]] = []  # around the innermost template: its place, its fields, signs and brackets open in the field
    place = fields = inside = round_ = -1  # of the innermost template; place -1: at the top
    in_field = False
    while True:
        if place >= 0 and not in_field:
            m = _TEMPLATE.match(text, at)
            if m is None:
                return None
            at, sign = m.end(), m[1]
            if sign == "${":
                if fields:
                    add(",")
                fields += 1
                inside = round_ = 0
                in_field = True
            elif sign == "`":
                if fields:
                    add(")")
                else:
                    parts[place] = ""
                place, fields, inside, round_ = levels.pop()
                in_field = place >= 0
            else:
                add("\n")
                fields += sign == "\n"
            continue
        m = (_SCRIPT_FIELD_SIGN if in_field else _SCRIPT_SIGN).search(text, at)
        if m is None:
            if in_field:
                return None
            add(text[at:])
            return _coded("".join(parts))
        stop = m.start()
        if stop > at:
            add(text[at:stop])
        sign, at = text[stop], stop + 1
        if sign == "`":
            levels.append((place, fields, inside, round_))
            place, fields, in_field = len(parts), 0, False
            add("(")
        elif sign == "}" and not inside:
            if round_:
                return None
            in_field = False
        elif sign in "(){}":
            inside += 1 if sign in "({" else -1
            round_ += (sign == "(") - (sign == ")")
            if round_ < 0:
                return None
            add(sign)
        else:
            if sign == "/":
                found = _COMMENT.match(text, stop)
                if found is None:
                    if out.ends_for_regex():
                        found = _REGEX.match(text, stop)
                        if found is None:
                            return None
                    else:
                        add("/")
                        continue
            else:
                found = _STRINGS[sign].match(text, stop)
                if found is None:
                    return None
            at = found.end()
            lines = text.count("\n", stop, at)
            if lines:
                add("\n" * lines)


_PYTHON_SIGN, _PYTHON_FIELD_SIGN = re.compile(r"[#'\"\\]"), re.compile(r"[#'\"()\[\]{}:!]")
_TEXTS = {q: re.compile(f"{_BLOCKS[q * 3]}|{_QUOTED[q]}") for q in "\"'"}
_LIVE, _DEAD = re.compile("[fFtT][rR]?|[rR][fFtT]"), re.compile("[rRbBuU]{1,2}")
_CONVERSION = re.compile("![rsa](?=[:}])")


def _rest_of_fstring(quote: str) -> re.Pattern:
    """What stands in a literal up to its end, a field or a line break."""
    q = quote[0]
    own = rf"|{q}(?!{q * 2})" if len(quote) == 3 else ""
    return re.compile(rf"(?:[^{q}\\{{\n]++|\\N\{{[^{{}}\n]*\}}|\\[^{{\n]|\\(?=\{{)|\{{\{{{own})*+({quote}|\{{|\n|\\\n)")


_FSTRINGS = {quote: _rest_of_fstring(quote) for quote in ("'", '"', "'''", '"""')} | {"}": re.compile(r"[^}{\n]*+(\}|\{|\n)")}


def _ended_python(text: str) -> _Text | None:
    """As ``scan``, for texts without surprises; None for others."""
    out = _Text()
    parts, places = out.parts, out.places
    at = 0
    levels: list[tuple[str, int, int, int]] = []  # around the innermost literal: its quote, its place, its fields, signs open in the field
    quote, place, fields, inside = "", -1, 0, 0  # of the innermost literal; place -1: at the top
    in_field = False

    def add(part: str, source: int = -1) -> None:
        parts.append(part)
        places.append(source)

    while True:
        if place >= 0 and not in_field:
            m = _FSTRINGS[quote].match(text, at)
            if m is None:
                return None
            at, sign = m.end(), m[1]
            if sign == "{":
                if fields:
                    add(",")
                fields += 1
                inside = 0
                in_field = True
            elif sign == quote:
                if quote == "}":  # a format ends with its field
                    quote, place, fields, inside = levels.pop()
                    continue
                if fields:
                    add(")")
                else:
                    parts[place] = ""
                quote, place, fields, inside = levels.pop()
                in_field = place >= 0
            elif len(quote) == 1 and quote != "}" and sign == "\n":
                return None
            else:
                add("\n" if sign == "\n" else CONTINUED + "\n")
            continue
        m = (_PYTHON_FIELD_SIGN if in_field else _PYTHON_SIGN).search(text, at)
        if m is None:
            if in_field:
                return None
            if at < len(text):
                add(text[at:], at)
            return out
        stop = m.start()
        sign = text[stop]
        if sign in "'\"":
            begin = stop
            if stop > at and text[stop - 1] in "fFtTrRbBuU":  # of one or two letters that are no end of a word
                two = stop - 2 >= at and (text[stop - 2].isalnum() or text[stop - 2] == "_")
                first = stop - 2 if two else stop - 1
                before = text[first - 1] if first else " "
                if not (before.isalnum() or before == "_"):
                    prefix = text[first:stop]
                    if _LIVE.fullmatch(prefix):
                        if first > at:
                            add(text[at:first], at)
                        levels.append((quote, place, fields, inside))
                        quote = sign * 3 if text.startswith(sign * 3, stop) else sign
                        place, fields, in_field = len(parts), 0, False
                        add("(")
                        at = stop + len(quote)
                        continue
                    if _DEAD.fullmatch(prefix):
                        begin = first
            found = _TEXTS[sign].match(text, stop)
            if found is None or found[0].endswith(sign * 2) and text.startswith(sign, found.end()):
                return None
            if begin > at:
                add(text[at:begin], at)
            at = found.end()
            if "\n" in found[0]:
                add(_lines(found[0], True))
            continue
        if stop > at:
            add(text[at:stop], at)
        at = stop + 1
        if sign == "#":
            at = text.find("\n", at)
            at = len(text) if at < 0 else at
        elif sign == "\\":
            if text.startswith("\n", at):
                add(CONTINUED + "\n")
                at += 1
            else:
                add("\\", stop)
        elif sign == "}" and not inside:
            in_field = False
        elif sign == ":" and not inside:
            # a format: literal text that ends with the field, and may hold fields itself
            levels.append((quote, place, fields, inside))
            quote, place, fields, in_field = "}", len(parts), 1, False
        elif sign != "!" or not _CONVERSION.match(text, stop):
            inside += (sign in "([{") - (sign in ")]}")
            add(sign, stop)
        else:
            at += 1


def lex_python(text: str, noted: bool = True) -> str:
    text = _clean(text).replace(SOFT, " ")
    return _gathered(_simple_python(text) or _ended_python(text) or scan(text, RULES["python"]), text, noted)


def lex_python_heads(text: str) -> str:
    """As ``lex_python``, without the decorators and parameters as written."""
    return lex_python(text, noted=False)


def lex_script(text: str) -> str:
    return _lex_coded(_clean(text), "script")


def lex_braces(text: str) -> str:
    return _lex_coded(_clean(text), "brace")


def _lex_coded(text: str, language: str) -> str:
    text = _OWN_CODES.sub("", text)
    code = _simple_braces(text, language)
    if code is None and language == "script":
        code = _ended_script(text)
    return "".join(scan(text, RULES[language], coded=True).parts) if code is None else code


def _column(lex: Callable[[str], str]) -> Callable[[Column], Column]:
    @arrow_udf(StringType())
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else lex(t) for t in texts.to_pylist()], pa.string())

    return run


#: Column functions of the three kinds of languages, and of Python without notes.
python_code, script_code, brace_code = _column(lex_python), _column(lex_script), _column(lex_braces)
python_heads = _column(lex_python_heads)
