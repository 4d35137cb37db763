"""Prompt texts from files and metrics, checks of the answers, and checks of request values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as fv
from ..functions.text import is_json_object, lookup, prompt_language

RESPONSE = (
    "struct<file_path:string,language:string,strategy_used:string,suggestions:array<struct<title:string,"
    "description:string,strategy:string,priority:string,estimated_impact:string,diff:string,reason:string>>,"
    "summary:string>"
)
_TOP_FIELDS = ["file_path", "language", "strategy_used", "suggestions", "summary"]
_ITEM_FIELDS = ["title", "description", "strategy", "priority", "estimated_impact", "diff", "reason"]


def _number(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("N/A"))


def render_prompts(files: DataFrame, metrics: DataFrame) -> DataFrame:
    """Prompt per (path, content, strategy), with a metrics section where the file has metrics.

    ``metrics`` needs path, loc, function_count and cyclomatic_complexity.
    """
    wanted = F.lower("strategy")
    language = prompt_language(F.col("path"))
    joined = files.select("path", "content", wanted.alias("strategy")).join(
        metrics.select("path", "loc", "function_count", "cyclomatic_complexity", F.lit(True).alias("measured")),
        "path",
        "left",
    )
    numbers = F.concat(
        F.lit("METRICS:\n- Lines of Code: "),
        _number(F.col("loc")),
        F.lit("\n- Function Count: "),
        _number(F.col("function_count")),
        F.lit("\n- Cyclomatic Complexity: "),
        _number(F.col("cyclomatic_complexity")),
        F.lit("\n\n"),
    )
    advice = lookup(fv.STRATEGY_TEXT, F.col("strategy"))
    prompt = F.concat(
        F.lit("Review the following "),
        language,
        F.lit(" code and propose refactorings.\n\nFILE: "),
        F.col("path"),
        F.lit("\nSTRATEGY: "),
        F.col("strategy"),
        F.lit("\n\n"),
        F.when(F.col("measured"), numbers).otherwise(""),
        F.lit("CODE:\n```"),
        language,
        F.lit("\n"),
        F.col("content"),
        F.lit("\n```\n\nINSTRUCTIONS:\n"),
        advice,
        F.lit(
            "\n\nGive up to 3 suggestions, each with a title, an explanation, a priority (high/medium/low), the "
            "expected impact, a unified diff and the reason.\n"
        ),
    )
    bad = F.concat(
        F.lit("Invalid strategy: "), F.col("strategy"), F.lit(". Must be one of: " + ", ".join(fv.STRATEGIES))
    )
    return joined.select(
        "path", language.alias("language"), "strategy", prompt.alias("prompt"), F.when(advice.isNull(), bad).alias("error")
    )


def validate_responses(responses: DataFrame) -> DataFrame:
    """Answers (id, body) checked against the required fields: valid, number of suggestions, first missing field."""
    parsed = responses.select("id", F.when(is_json_object(F.col("body")), F.from_json("body", RESPONSE)).alias("r"))
    incomplete = lambda f: F.exists("r.suggestions", lambda s: s[f].isNull())
    missing = F.coalesce(
        *[F.when(F.col(f"r.{f}").isNull(), f) for f in _TOP_FIELDS],
        *[F.when(incomplete(f), f"suggestions.{f}") for f in _ITEM_FIELDS],
    )
    reason = F.when(F.col("r").isNull(), "not a JSON object").when(missing.isNotNull(), F.concat(F.lit("missing "), missing))
    return parsed.select(
        "id",
        reason.isNull().alias("valid"),
        F.greatest(F.coalesce(F.size("r.suggestions"), F.lit(0)), F.lit(0)).alias("suggestions"),
        reason.alias("reason"),
    )


def validate_requests(requests: DataFrame) -> DataFrame:
    """Requested values (id, kind, value) against the allowed ones: operation, strategy, provider, parser."""
    allowed = {
        "operation": fv.OPERATIONS,
        "strategy": fv.STRATEGIES,
        "provider": fv.PROVIDERS,
        "parser": fv.PARSERS,
    }
    kind = F.col("kind")
    value = F.when(kind == "strategy", F.lower("value")).otherwise(F.col("value"))
    accepted, listed = F.lit(False), F.lit(None).cast("string")
    for name, values in allowed.items():
        accepted = accepted | ((kind == name) & value.isin(*values))
        listed = F.when(kind == name, ", ".join(values)).otherwise(listed)
    reason = F.coalesce(
        F.concat(F.lit("Invalid "), kind, F.lit(": "), F.col("value"), F.lit(". Must be one of: "), listed),
        F.concat(F.lit("Unknown kind: "), kind),
    )
    return requests.select("id", "kind", "value", accepted.alias("accepted"), F.when(~accepted, reason).alias("reason"))
