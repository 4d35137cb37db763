"""Declarations of all languages as one table, with filters, groupings and source text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import lexer, text
from . import brace_code, python_code
from .placement import spread

FUNCTION_TYPES = ("function", "method", "constructor")
CLASS_TYPES = ("class", "interface", "struct")

_COLUMNS = ["path", "language", "type", "name", "start_line", "end_line", "parameters", "heritage", "decorators"]


def constructs(files: DataFrame, rules: Iterable[tuple] = brace_code.DECLARATIONS) -> DataFrame:
    """Functions, classes, interfaces and tables with lines, parameters, heritage and (Python) decorators.

    ``rules`` are the declaration patterns of the brace languages and SQL; callers may add their own rows. All languages are read
    in one scan and shuffled once, by path and without strings and comments; both kinds of structure are found behind that.
    """
    language, content = text.parser_language(F.col("path")), F.col("content")
    python_code_of = lexer.python_code(F.when(F.col("language") == "python", content))
    read = files.withColumn("language", language).where(F.col("language").isin("python", *brace_code.LANGUAGES))
    code = read.select("path", "language", F.coalesce(python_code_of, brace_code.masked(F.col("language"), content)).alias("code"))
    # a condition on the number of the task is not moved below the shuffle, so both kinds share it
    placed = spread(code, "path").withColumn("kind", F.when(F.spark_partition_id() >= 0, F.col("language")))
    python = python_code.placed_declarations(placed.where(F.col("kind") == "python"))
    is_class = F.col("type") == "class"
    python = python.select(
        "path",
        F.lit("python").alias("language"),
        "type",
        "name",
        "start_line",
        "end_line",
        F.when(~is_class, F.col("detail")).alias("parameters"),
        F.when(is_class, F.col("detail")).alias("heritage"),
        "decorators",
    )
    others = brace_code.placed_declarations(placed.where(F.col("kind") != "python").select("path", "language", "code"), rules=rules).withColumn("decorators", F.lit(None).cast("string")).select(*_COLUMNS)
    return python.unionByName(others).withColumn("line_count", F.col("end_line") - F.col("start_line") + 1)


def split_valid(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that keep the invariants of a construct, and the quarantined rest."""
    ok = (
        (F.col("start_line") >= 1)
        & (F.col("end_line") >= F.col("start_line"))
        & (F.col("name") != "")
        & (F.col("type") != "")
    )
    ok = F.coalesce(ok, F.lit(False))
    return found.where(ok), found.where(~ok)


def by_type(found: DataFrame, kind: str) -> DataFrame:
    return found.where(F.col("type") == kind)


def by_language(found: DataFrame, language: str) -> DataFrame:
    return found.where(F.col("language") == language)


def by_name(found: DataFrame, name: str, exact: bool = True) -> DataFrame:
    return found.where(F.col("name") == name if exact else F.contains(F.lower("name"), F.lit(name.lower())))


def functions_of(found: DataFrame) -> DataFrame:
    return found.where(F.col("type").isin(*FUNCTION_TYPES))


def classes_of(found: DataFrame) -> DataFrame:
    return found.where(F.col("type").isin(*CLASS_TYPES))


def describe(found: DataFrame) -> DataFrame:
    """Display text and JSON form of each construct."""
    label = F.format_string(
        "%s '%s' at %s:%d (%d lines)", "type", "name", text.basename(F.col("path")), "start_line", "line_count"
    )
    fields = [c for c in found.columns if c != "label"]
    return found.withColumn("label", label).withColumn("document", F.to_json(F.struct(*fields)))


def count_by_file(found: DataFrame) -> DataFrame:
    return found.groupBy("path").agg(F.count(F.lit(1)).alias("constructs"), F.sum("line_count").alias("total_lines"))


def count_by_type(found: DataFrame) -> DataFrame:
    """Counts per type; partial sums keep a dominant type from becoming a bottleneck."""
    return found.groupBy("type").agg(
        F.count(F.lit(1)).alias("constructs"),
        F.sum("line_count").alias("total_lines"),
        F.max("line_count").alias("longest"),
    )


def construct_text(found: DataFrame, files: DataFrame) -> DataFrame:
    """Source text of each construct, cut from its file by line numbers.

    The constructs of a file are gathered first, so that a file's text is joined once, not once per construct.
    """
    spans = found.groupBy("path").agg(F.collect_list(F.struct(*found.columns)).alias("spans"))
    lines = files.select("path", text.line_array(F.col("content")).alias("lines"))

    def cut(span: Column) -> Column:
        body = F.array_join(F.slice("lines", span.start_line.cast("int"), span.line_count.cast("int")), "\n")
        return F.struct(span.alias("span"), body.alias("source_text"))

    texts = spans.join(lines, "path").select(F.explode(F.transform("spans", cut)).alias("t"))
    return texts.select("t.span.*", "t.source_text")


def find_function(files: DataFrame, name: str) -> DataFrame:
    """A function by name with its text; only files that mention the name are analysed."""
    candidates = files.where(F.contains("content", F.lit(name)))
    return construct_text(by_name(functions_of(constructs(candidates)), name), candidates)
