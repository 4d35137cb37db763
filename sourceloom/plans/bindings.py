"""Code-shaped tables derived from the driver tables with narrow expressions (no shuffle)."""

from __future__ import annotations

from string import Template

from pyspark.sql import DataFrame, SparkSession

from ..operators.placement import spread
from . import line_templates as lt

# extensions of the code corpus by doc_id % 7, folders by doc_id % 6
CODE_EXTENSIONS = [".py", ".py", ".js", ".ts", ".java", ".cs", ".sql"]
CODE_FOLDERS = ["node_modules/pkg/", "src/", "app/migrations/", "app/tests/", "build/", ""]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document texts, dealt over all tasks: the queries derive far larger texts from them."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def _once(expression: str) -> str:
    """Evaluates an expression once per row: filters are not pushed through a generator."""
    return f"explode(array({expression}))"


def _lines(case: str) -> str:
    """Array of lines, one per word of ``text``."""
    body = Template(case).substitute(i="i", n="length(w)").replace("\\", "\\\\")
    return f"transform(split(text, ' '), (w, i) -> {body})"


def _pick(expr: str, choices: list[str]) -> str:
    return "element_at(array(" + ", ".join(f"'{c}'" for c in choices) + f"), CAST({expr} AS INT) + 1)"


CODE_PATH = (
    f"{_pick('doc_id % 6', CODE_FOLDERS)} || 'm' || CAST(doc_id AS STRING) || {_pick('doc_id % 7', CODE_EXTENSIONS)}"
)


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source file per document in seven languages, one line per word."""
    cases = [lt.PYTHON, lt.PYTHON, lt.JAVASCRIPT, lt.TYPESCRIPT, lt.JAVA, lt.CSHARP, lt.SQL]
    picked = "CASE doc_id % 7 " + " ".join(f"WHEN {k} THEN {_lines(c)}" for k, c in enumerate(cases)) + " END"
    return documents(spark, sf_dir).selectExpr(
        f"{CODE_PATH} AS path",
        _once(f"array_join({picked}, '\n')") + " AS content",
        "doc_id",
    )


def nested_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file per document whose strings hold code, with deep brackets and heads of several lines; four lines per word."""
    picked = f"CASE doc_id % 3 WHEN 0 THEN {_lines(lt.PYTHON_NESTED)} ELSE {_lines(lt.SCRIPT_NESTED)} END"
    path = f"'lib/d' || CAST(doc_id AS STRING) || {_pick('doc_id % 3', lt.NESTED_EXTENSIONS)}"
    return documents(spark, sf_dir).selectExpr(f"{path} AS path", _once(f"array_join({picked}, '\n')") + " AS content", "doc_id")


def sql_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One SQL script per document."""
    return documents(spark, sf_dir).selectExpr(
        "'db/s' || CAST(doc_id AS STRING) || '.sql' AS path",
        _once(f"array_join({_lines(lt.SQL)}, '\n')") + " AS content", "doc_id"
    )


def database_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ORM models, migrations, plain modules and scripts, one per document."""
    paths, texts = [], []
    for kind in lt.DATABASE_LINES:
        head, foot = lt.fill(lt.DATABASE_HEAD[kind]), lt.fill(lt.DATABASE_FOOT.get(kind, ""))
        paths.append(f"WHEN {kind} THEN {lt.fill(lt.DATABASE_PATH[kind])}")
        texts.append(f"WHEN {kind} THEN {head} || array_join({_lines(lt.database_case(kind))}, '\n') || {foot}")
    return documents(spark, sf_dir).selectExpr(
        f"CASE doc_id % 8 {' '.join(paths)} END AS path", _once(f"CASE doc_id % 8 {' '.join(texts)} END") + " AS content", "doc_id"
    )
