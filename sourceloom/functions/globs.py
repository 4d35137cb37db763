"""Exclude globs as one regular expression, so a scan filters with a single RLIKE."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F


def _literal(text: str) -> str:
    return re.sub(r"[\\^$.|?*+(){}\[\]]", r"\\\g<0>", text)


def _wildcards(glob: str) -> str:
    """Shell wildcards, where ``*`` also crosses ``/``."""
    out = []
    for piece in re.split(r"(\*|\?|\[!?[^\]]+\])", glob):
        if piece == "*":
            out.append(".*")
        elif piece == "?":
            out.append(".")
        elif piece.startswith("[") and piece.endswith("]") and len(piece) > 2:
            body = piece[1:-1].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append("[^" + body[1:] + "]" if body.startswith("!") else "[" + body + "]")
        else:
            out.append(_literal(piece))
    return "".join(out)


def glob_regex(glob: str) -> str:
    """Regular expression (to be matched against a whole relative path) of one exclude pattern."""
    if glob.startswith("**/"):
        return "(?:.*/)?" + _wildcards(glob[3:])
    if glob.endswith("/**"):
        return "(?:.*/)?" + _literal(glob[:-3]) + "(?:/.*)?"
    if "**" in glob:
        ends = glob.split("**")
        if len(ends) != 2:
            return "(?!)"
        return f"(?={_literal(ends[0].rstrip('/'))}).*(?<={_literal(ends[1].lstrip('/'))})"
    return f"(?:{_wildcards(glob)}|(?:.*/)?(?=[^/]*\\z){_wildcards(glob)})"


def excluded(path: Column, patterns: list[str]) -> Column:
    """Whether a relative path matches any of the patterns."""
    if not patterns:
        return F.lit(False)
    return path.rlike(r"(?s)\A(?:" + "|".join(glob_regex(p) for p in patterns) + r")\z")
