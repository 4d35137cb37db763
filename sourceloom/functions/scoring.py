"""Grades, severities and recommendations."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def complexity_grade(x: Column) -> Column:
    return F.when(x <= 5, "A").when(x <= 10, "B").when(x <= 20, "C").when(x <= 30, "D").otherwise("F")


def severity(lines: Column, threshold: Column) -> Column:
    """Band of the relative excess over the threshold."""
    excess = (lines - threshold) / threshold
    return (
        F.when(lines <= threshold, "none")
        .when(excess <= 0.5, "low")
        .when(excess <= 1.0, "medium")
        .when(excess <= 2.0, "high")
        .otherwise("critical")
    )


def recommendations(lines: Column, functions: Column, complexity: Column, language: Column) -> Column:
    """First three of the advice texts that apply, most general first."""
    large = lines > 2000
    python, script = language == "python", language.isin("javascript", "typescript")
    advice = F.array(
        # fixed texts, in order of precedence
        F.when(lines > 3000, "Consider splitting into multiple modules")
        .when(large, "Split into logical components")
        .otherwise("Extract utility functions to separate file"),
        F.when(functions > 50, "Group related functions into classes or modules").when(
            functions > 30, "Extract some functions to utility modules"
        ),
        F.when(complexity > 20, "Reduce complexity by simplifying control flow").when(
            complexity > 15, "Refactor complex functions into smaller ones"
        ),
        F.when(python & large, "Create a Python package structure").when(script & large, "Split into ES modules"),
        F.when(python, "Consider using dataclasses or Pydantic models").when(
            script, "Use composition to break down large components"
        ),
    )
    return F.slice(F.array_compact(advice), 1, 3)
