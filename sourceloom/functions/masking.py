"""Blanking of strings and comments in SQL, so keyword counts see code only. Other languages: ``lexer``.

One left-to-right regular expression finds strings and comments, whichever starts first. Single-line
tokens vanish; a token that spans lines keeps its line breaks, so line numbers stay valid. Everything is a narrow column
expression. Quantifiers run over single characters: a long literal cannot exhaust the regex stack.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .lexer import CLOSE, OPEN

# the lookahead rejects ordinary characters at once
SQL_TOKENS = rf"(?=['/-])(?:(/\*[\s\S]*?(?:\*/|\z))|--[^\n]*|'[^'\n]*')"
_MARKS = r"\x{1}-\x{6}"


def _normalised(content: Column) -> Column:
    """Line breaks as \\n and no marks; most texts need no change."""
    cleaned = F.regexp_replace(F.regexp_replace(content, f"[{_MARKS}]", ""), r"\r\n?", "\n")
    return F.when(content.rlike(rf"[\r{_MARKS}]"), cleaned).otherwise(content)


def mask_sql(content: Column) -> Column:
    marked = F.regexp_replace(_normalised(content), SQL_TOKENS, f"{OPEN}$1{CLOSE}")
    # within a mark drop everything but line breaks; \G carries on from the previous match
    emptied = F.regexp_replace(marked, rf"(?:{OPEN}|(?!\A)\G(\n))[^\n{CLOSE}]*+", "$1")
    return F.replace(emptied, F.lit(CLOSE), F.lit(""))
