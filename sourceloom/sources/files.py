"""Source trees as tables of files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import fixed_values as fv
from ..functions.globs import excluded
from ..functions.text import NEWLINE, decode_utf8, extension, parser_language

_SCHEMA = "path string, rel_path string, ext string, language string, content string, size bigint, mtime timestamp"


def _plain(uri: Column) -> Column:
    """Path of a file URI without scheme and percent escapes."""
    return F.url_decode(F.replace(F.regexp_replace(uri, r"^[a-zA-Z][a-zA-Z0-9+.-]*:/+", "/"), F.lit("+"), F.lit("%2B")))


def read_tree(spark: SparkSession, root: str, excludes: list[str] | None = None, include: str | None = None) -> DataFrame:
    """Files under a folder that no exclude glob matches; a missing folder gives no rows.

    The globs test the file-metadata path, so excluded files are dropped when files are listed and
    never opened. ``include`` is an optional file-name glob.
    """
    patterns = fv.ANALYSIS_EXCLUDES + (excludes or [])
    base = root.rstrip("/") + "/"
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if include:
        reader = reader.option("pathGlobFilter", include)
    try:
        found = reader.load(root)
    except AnalysisException as problem:
        if problem.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], _SCHEMA)
        raise
    plain_root = "/" + base.split(":/", 1)[-1].lstrip("/")
    rel = F.substr(_plain(F.col("_metadata.file_path")), F.lit(len(plain_root) + 1))
    return found.where(~excluded(rel, patterns)).select(
        _plain(F.col("_metadata.file_path")).alias("path"),
        rel.alias("rel_path"),
        extension(rel).alias("ext"),
        parser_language(rel).alias("language"),
        decode_utf8(F.col("content")).alias("content"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("mtime"),
    )


def file_lines(files: DataFrame) -> DataFrame:
    """Numbered lines of every file, with universal line breaks."""
    lines = F.split("content", NEWLINE)
    # a final line break does not open another line
    kept = F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    exploded = files.select("path", F.posexplode(kept).alias("pos", "text"))
    return exploded.select("path", (F.col("pos") + 1).alias("line_no"), "text")
