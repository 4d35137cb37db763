"""Decoding, line and path expressions. All are narrow, built-in column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

from . import fixed_values as fv

# whitespace as str.strip() sees it, without the line breaks \n and \r
BLANKS = r"\t\x0b\f\x1c-\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
NEWLINE = r"\r\n|\r|\n"


def decode_utf8(raw: Column) -> Column:
    """UTF-8 text with undecodable bytes dropped."""
    return F.replace(F.make_valid_utf8(raw.cast("string")), F.lit("\ufffd"), F.lit(""))


def lookup(table: dict[str, str], key: Column) -> Column:
    """Constant lookup; an unknown key gives NULL."""
    pairs = [F.lit(x) for x in chain.from_iterable(table.items())]
    return F.create_map(*pairs)[key]


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    """Suffix with its dot as written, '' when there is none."""
    return F.regexp_extract(path, r"[^/](\.[^./]+)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]+$", "")


def loc_language(ext: Column) -> Column:
    return lookup(fv.EXTENSION_LANGUAGE, F.ltrim(F.lower(ext), F.lit(".")))


def comment_marker(ext: Column) -> Column:
    """Line-comment marker of an extension, with or without the dot; unknown gives NULL."""
    language = loc_language(ext)
    return (
        F.when(language.isin(*fv.HASH_COMMENT_LANGUAGES), "#")
        .when(language.isin(*fv.DASH_COMMENT_LANGUAGES), "--")
        .when(language.isNotNull(), "//")
    )


def metric_language(path: Column) -> Column:
    return lookup(fv.METRIC_LANGUAGE, F.lower(extension(path)))


def parser_language(path: Column) -> Column:
    return lookup(fv.PARSER_LANGUAGE, F.lower(extension(path)))


def prompt_language(path: Column) -> Column:
    found = F.coalesce(*[F.when(F.endswith(path, F.lit(e)), F.lit(l)) for e, l in fv.PROMPT_LANGUAGE.items()])
    return F.coalesce(found, F.lit("unknown"))


def is_blank(text: Column) -> Column:
    return ~text.rlike(rf"[^{BLANKS}\r\n]")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{BLANKS}\r\n]+|[{BLANKS}\r\n]+\z", "")


def is_code_line(text: Column, marker: Column) -> Column:
    lead = F.regexp_replace(text, rf"^[{BLANKS}\r\n]+", "")
    return (lead != "") & ~F.startswith(lead, marker)


def count_code_lines(content: Column, marker: Column) -> Column:
    """Non-blank lines that do not begin with the marker, counted in one pass without a shuffle.

    A match starts at a line start, passes over blanks and stops at the first code character.
    """

    def counter(mark: str) -> Column:
        return F.regexp_count(content, F.lit(rf"(?<![^\r\n])[{BLANKS}]*+(?!{mark})[^{BLANKS}\r\n]"))

    return F.when(marker == "#", counter("#")).when(marker == "--", counter("--")).when(marker == "//", counter("//"))


def count_lines(content: Column) -> Column:
    """Number of lines, a final line break not opening another one."""
    return F.regexp_count(content, F.lit(r"\r\n|\r|\n")) + F.when(content.rlike(r"[^\r\n]\z"), 1).otherwise(0)


#: Every line boundary of Unicode text, beside \\n and \\r: VT, FF, FS to RS, NEL, U+2028 and U+2029.
_RARE_BREAKS = "\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"


def count_split_lines(content: Column) -> Column:
    """Lines by every line boundary of Unicode text. Lengths without some characters are compared; no expression is searched for."""
    breaks = F.length(content) - F.length(F.translate(content, "\n\r" + _RARE_BREAKS, ""))
    pairs = F.length(content) - F.length(F.replace(content, F.lit("\r\n"), F.lit("\n")))
    open_end = (content != "") & ~F.right(content, F.lit(1)).isin(*("\n\r" + _RARE_BREAKS))
    return breaks - pairs + F.when(open_end, 1).otherwise(0)


def line_array(content: Column) -> Column:
    """Lines of a text; a final line break does not open another line."""
    return F.when(content == "", F.array().cast("array<string>")).otherwise(
        F.split(F.regexp_replace(content, r"(?:\r\n|\r|\n)\z", ""), NEWLINE)
    )


def is_json_object(text: Column) -> Column:
    """Whether a text is a valid JSON object."""
    return F.coalesce(F.startswith(F.schema_of_variant(F.try_parse_json(text)), F.lit("OBJECT")), F.lit(False))


def module_path(source: Column, target: Column) -> Column:
    """Relative module name used to import ``target`` from ``source``.

    Same folder ``.m``; below it ``.a.b.m``; above it one dot per level and one more; else the bare name.
    """
    here, there, name = dirname(source), dirname(target), stem(target)
    below = F.when(here == "", there != "").otherwise(F.startswith(there, F.concat(here, F.lit("/"))))
    above = F.when(there == "", here != "").otherwise(F.startswith(here, F.concat(there, F.lit("/"))))
    inner = F.when(here == "", there).otherwise(F.substr(there, F.length(here) + 2))
    outer = F.when(there == "", here).otherwise(F.substr(here, F.length(there) + 2))
    levels = F.size(F.split(outer, "/"))
    return (
        F.when(here == there, F.concat(F.lit("."), name))
        .when(below, F.concat(F.lit("."), F.replace(inner, F.lit("/"), F.lit(".")), F.lit("."), name))
        .when(above, F.concat(F.repeat(F.lit("."), levels + 1), name))
        .otherwise(name)
    )
