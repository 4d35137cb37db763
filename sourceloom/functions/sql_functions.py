"""SQL functions for use in spark.sql: scoring rules, globs and line splitting."""

from __future__ import annotations

from pyspark.sql import SparkSession


def register(spark: SparkSession) -> None:
    """Registers temporary SQL functions; Catalyst inlines them, no Python worker runs."""
    spark.sql("""
        CREATE OR REPLACE TEMPORARY FUNCTION complexity_grade(x DOUBLE) RETURNS STRING
        RETURN CASE WHEN x <= 5 THEN 'A' WHEN x <= 10 THEN 'B' WHEN x <= 20 THEN 'C' WHEN x <= 30 THEN 'D' ELSE 'F' END
    """)
    spark.sql("""
        CREATE OR REPLACE TEMPORARY FUNCTION size_severity(lines BIGINT, threshold BIGINT) RETURNS STRING
        RETURN CASE WHEN lines <= threshold THEN 'none'
                    WHEN (lines - threshold) / threshold <= 0.5 THEN 'low'
                    WHEN (lines - threshold) / threshold <= 1.0 THEN 'medium'
                    WHEN (lines - threshold) / threshold <= 2.0 THEN 'high'
                    ELSE 'critical' END
    """)
    spark.sql(r"""
        CREATE OR REPLACE TEMPORARY FUNCTION text_lines(content STRING)
        RETURNS TABLE(line_no INT, text STRING)
        RETURN SELECT pos + 1, col FROM posexplode(split(content, "\\r\\n|\\r|\\n"))
    """)
