"""Unified diffs: parsing into hunks and application to file texts. Narrow, one row per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

_HEADER = r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
NO_HUNKS = "No valid hunks found in diff"


def _number(header: Column, group: int) -> Column:
    """Header field; a missing count is 1."""
    return F.coalesce(F.nullif(F.regexp_extract(header, _HEADER, group), F.lit("")).cast("int"), F.lit(1))


def hunks(diff: Column) -> Column:
    """Array of hunks. Lines before the first header, and other lines that begin with @@, are ignored."""
    pieces = F.split(F.concat(F.lit("\n"), diff), rf"\n(?={_HEADER})")

    def hunk(piece: Column) -> Column:
        lines = F.split(piece, "\n")
        body = F.filter(F.slice(lines, 2, F.size(lines)), lambda x: ~F.startswith(x, F.lit("@@")))
        return F.struct(
            _number(piece, 1).alias("old_start"),
            _number(piece, 2).alias("old_count"),
            _number(piece, 3).alias("new_start"),
            _number(piece, 4).alias("new_count"),
            body.alias("lines"),
        )

    return F.transform(F.slice(pieces, 2, F.size(pieces)), hunk)


def diff_hunks(diffs: DataFrame) -> DataFrame:
    """One row per hunk with its lines counted; a diff without hunks gives one error row."""
    parsed = diffs.select("path", F.posexplode_outer(hunks(F.col("diff"))).alias("pos", "h"))
    count = lambda sign: F.size(F.filter("h.lines", lambda x: F.startswith(x, F.lit(sign))))
    none = F.col("h").isNull()
    return parsed.select(
        "path",
        (F.col("pos") + 1).alias("hunk_no"),
        "h.old_start",
        "h.old_count",
        "h.new_start",
        "h.new_count",
        F.when(~none, count("+")).alias("added"),
        F.when(~none, count("-")).alias("removed"),
        F.when(~none, count(" ")).alias("context"),
        F.when(none, NO_HUNKS).alias("error"),
    )


def _replacement(hunk: Column) -> Column:
    """Lines a hunk leaves behind: added ones (but not +++) and context, without their sign."""
    added = lambda x: F.startswith(x, F.lit("+")) & ~F.startswith(x, F.lit("+++"))
    kept = F.filter(hunk.lines, lambda x: added(x) | F.startswith(x, F.lit(" ")))
    return F.transform(kept, lambda x: F.concat(F.substr(x, F.lit(2)), F.lit("\n")))


def _patched(lines: Column, found: Column) -> Column:
    """File lines with the hunks applied from last to first; context is not verified.

    Hunks in ascending order that do not overlap are applied in one pass: before each replacement stands the
    untouched stretch since the hunk above. Any other list is folded hunk by hunk, which gives the same meaning.
    """
    first = lambda h: F.greatest(h.old_start - 1, F.lit(0))
    last = lambda h: first(h) + h.old_count
    size = F.size(lines)
    following = F.slice(found, 2, F.size(found))
    ascending = F.forall(
        F.zip_with(F.slice(found, 1, F.size(found) - 1), following, lambda a, b: last(a) <= first(b)), lambda ok: ok
    )

    def stretch(h: Column, i: Column) -> Column:
        begin = F.coalesce(last(F.get(found, i - 1)), F.lit(0))
        return F.concat(F.slice(lines, begin + 1, F.greatest(first(h) - begin, F.lit(0))), _replacement(h))

    tail_from = last(F.element_at(found, -1))
    tail = F.slice(lines, tail_from + 1, F.greatest(size - tail_from, F.lit(0)))
    one_pass = F.concat(F.flatten(F.transform(found, stretch)), tail)

    def fold(acc: Column, h: Column) -> Column:
        rest = F.slice(acc, last(h) + 1, F.greatest(F.size(acc) - last(h), F.lit(0)))
        return F.concat(F.slice(acc, 1, first(h)), _replacement(h), rest)

    return F.when(ascending, one_pass).otherwise(F.aggregate(F.reverse(found), lines, fold))


def apply_patches(requests: DataFrame, files: DataFrame) -> DataFrame:
    """Result text per request (path, diff), or the reason it was refused.

    A request without a diff, or for a file that does not exist, is an error row, as is a diff without hunks.
    """
    joined = requests.select("path", "diff").join(files.select("path", "content"), "path", "left")
    # every line keeps its own line break
    pieces = F.split(F.regexp_replace("content", r"\r\n?", "\n"), r"(?<=\n)")
    lines = F.filter(pieces, lambda x: x != "")
    parsed = joined.select("path", "diff", "content", lines.alias("lines"), hunks(F.col("diff")).alias("hunks"))
    error = (
        F.when(F.col("path").isNull(), "apply_diff operation requires 'file' parameter")
        .when(F.col("diff").isNull(), "apply_diff operation requires 'diff' parameter")
        .when(F.col("content").isNull(), F.concat(F.lit("File not found: "), F.col("path")))
        .when(F.size("hunks") == 0, NO_HUNKS)
    )
    checked = parsed.withColumn("error", error)
    text = F.array_join(_patched(F.col("lines"), F.col("hunks")), "")
    return checked.select(
        "path",
        F.when(F.col("error").isNull(), "success").otherwise("error").alias("status"),
        F.when(F.col("error").isNull(), text).alias("patched"),
        "error",
    )
