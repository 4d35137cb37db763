"""File metrics and the codebase report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as fv, lexer, scoring, text
from ..functions.globs import excluded
from .brace_code import code_complexity, code_function_count
from .python_code import measured_files


def supported(files: DataFrame) -> DataFrame:
    return files.where(F.lower(text.extension(F.col("path"))).isin(*fv.METRIC_LANGUAGE))


def scan(files: DataFrame, excludes: list[str] | None = None) -> DataFrame:
    """Files kept by the default excludes plus the caller's."""
    return files.where(~excluded(F.col("path"), fv.ANALYSIS_EXCLUDES + (excludes or [])))


def code_lines(files: DataFrame) -> DataFrame:
    """Every code line (not blank, no comment) with its number."""
    marker = text.comment_marker(text.extension(F.col("path")))
    lines = files.select(
        "path", marker.alias("marker"), F.posexplode(text.line_array(F.col("content"))).alias("pos", "text")
    )
    return lines.where(text.is_code_line(F.col("text"), F.col("marker"))).select(
        "path", (F.col("pos") + 1).alias("line_no"), "text"
    )


def loc_column() -> Column:
    return text.count_code_lines(F.col("content"), text.comment_marker(text.extension(F.col("path"))))


def lines_of_code(files: DataFrame) -> DataFrame:
    """Code lines per file; an unknown extension gives an error instead. No shuffle."""
    ext = text.extension(F.col("path"))
    loc = loc_column()
    return files.select(
        "path",
        loc.alias("loc"),
        F.when(text.comment_marker(ext).isNull(), F.concat(F.lit("Unsupported file extension: "), ext)).alias("error"),
    )


def file_metrics(files: DataFrame) -> DataFrame:
    """Line, function and complexity numbers of every supported file, in one scan and one shuffle.

    Line counts and the numbers of JS and TS are narrow and computed first. Only Python text is shuffled (by path);
    the other files pass through with an empty text, so neither a second scan nor a join is needed.
    """
    content, is_python = F.col("content"), F.col("language") == "python"
    blank = text.is_blank(content)
    prepared = (
        supported(files)
        .select("path", "content", text.metric_language(F.col("path")).alias("language"))
        .withColumn("code", lexer.script_code(F.when(~is_python, content)))
        .select(
            "path",
            loc_column().alias("loc"),
            F.when(~is_python, F.when(blank, 0).otherwise(code_function_count(F.col("code")))).alias("script_functions"),
            F.when(~is_python, F.when(blank, 1).otherwise(code_complexity(F.col("code")))).alias("script_complexity"),
            F.when(is_python, content).otherwise("").alias("content"),
        )
    )
    measured = measured_files(prepared, ("loc", "script_functions", "script_complexity"))
    script = F.col("script_complexity").isNotNull()
    either = lambda other, own: F.when(script, F.col(other)).otherwise(F.col(own))
    return measured.select(
        "path",
        text.metric_language(F.col("path")).alias("language"),
        "loc",
        either("script_functions", "function_count").cast("bigint").alias("function_count"),
        either("script_complexity", "cyclomatic_complexity").cast("double").alias("cyclomatic_complexity"),
        either("script_complexity", "total_complexity").cast("bigint").alias("total_complexity"),
        "python_metrics_error",
    )


def metrics_batch(requests: DataFrame, files: DataFrame) -> DataFrame:
    """One row per requested path: metrics with status success, or an error. A bad path never fails the job."""
    ext = F.lower(text.extension(F.col("path")))
    asked = requests.select("path").distinct()
    known = files.select("path", F.lit(True).alias("present"))
    found = asked.join(known, "path", "left").join(file_metrics(files), "path", "left")
    names = ", ".join(sorted(fv.METRIC_LANGUAGE))
    error = F.when(F.col("present").isNull(), F.concat(F.lit("File not found: "), F.col("path"))).when(
        ~ext.isin(*fv.METRIC_LANGUAGE),
        F.concat(F.lit("Unsupported file extension: "), ext, F.lit(f". Supported: {names}")),
    )
    return found.select(
        "path",
        F.when(error.isNull(), "success").otherwise("error").alias("status"),
        error.alias("error"),
        "language",
        "loc",
        "function_count",
        "cyclomatic_complexity",
        "total_complexity",
    )


def check_threshold(threshold: int) -> None:
    low, high = fv.CONFIG_RANGES["thresholds.maxLines"]
    if not low <= threshold <= high:
        raise ValueError(f"threshold must lie between {low} and {high}, got {threshold}")


def violations(files: DataFrame, threshold: int = 1500, excludes: list[str] | None = None) -> DataFrame:
    """Files over the line threshold, longest first."""
    return _violations(files, threshold, excludes).orderBy(F.desc("lines"), "file")


def _violations(files: DataFrame, threshold: int, excludes: list[str] | None) -> DataFrame:
    """Files over the line threshold, in any order.

    Lines are counted first (narrow); only files over the threshold go through the complexity stage.
    """
    check_threshold(threshold)
    long = scan(supported(files), excludes).where(loc_column() > threshold)
    m = file_metrics(long)
    lines = F.col("loc")
    functions = F.coalesce("function_count", F.lit(0))
    complexity = F.coalesce("cyclomatic_complexity", F.lit(0.0))
    return m.select(
        F.col("path").alias("file"),
        F.col("language"),
        lines.alias("lines"),
        functions.alias("functions"),
        complexity.alias("complexity"),
        scoring.severity(lines, F.lit(threshold)).alias("severity"),
        scoring.recommendations(lines, functions, complexity, F.col("language")).alias("recommendations"),
    )


def codebase_summary(files: DataFrame, threshold: int = 1500, excludes: list[str] | None = None) -> DataFrame:
    """One row of totals. The average is rounded half to even, and is 0 without files."""
    check_threshold(threshold)
    counted = scan(supported(files), excludes).select(loc_column().alias("loc"))
    total, n = F.coalesce(F.sum("loc"), F.lit(0)), F.count("loc")
    return counted.agg(
        F.count(F.lit(1)).alias("total_files"),
        n.alias("files_analyzed"),
        F.count_if(F.col("loc") > threshold).alias("files_exceeding_threshold"),
        total.alias("total_lines"),
        F.coalesce(F.bround(F.try_divide(total, n), 0), F.lit(0)).cast("bigint").alias("average_file_size"),
    )


def report_documents(
    files: DataFrame, project: str, timestamp: str, threshold: int = 1500, excludes: list[str] | None = None
) -> DataFrame:
    """The report as JSON lines: one summary document and one document per violation.

    A single document with all violations would gather the whole corpus in one row.
    """
    summary = codebase_summary(files, threshold, excludes).select(
        F.lit("summary").alias("section"),
        F.lit("").alias("file"),
        F.to_json(
            F.struct(
                F.lit(timestamp).alias("timestamp"),
                F.lit(project).alias("projectPath"),
                F.struct(F.lit(threshold).alias("maxLines")).alias("thresholds"),
                F.struct(
                    F.col("total_files").alias("totalFiles"),
                    F.col("files_analyzed").alias("filesAnalyzed"),
                    F.col("files_exceeding_threshold").alias("filesExceedingThreshold"),
                    F.col("total_lines").alias("totalLines"),
                    F.col("average_file_size").alias("averageFileSize"),
                ).alias("summary"),
            )
        ).alias("document"),
    )
    found = _violations(files, threshold, excludes).select(
        F.lit("violation").alias("section"),
        "file",
        F.to_json(F.struct("file", "lines", "functions", "complexity", "severity", "recommendations")).alias(
            "document"
        ),
    )
    return summary.unionByName(found)
