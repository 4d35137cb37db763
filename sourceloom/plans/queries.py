"""Named queries over the driver tables. Each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import fixed_values as fv, globs, ormtext, scoring, sqltext, text
from ..operators import brace_code, configs, constructs, dbfiles, diffs, ledger, metrics, migrations, prompts, python_code
from ..session import shared_dir
from ..sources import ledgers, trees
from ..sources.files import file_lines
from ..streaming import ledger_stream
from . import bindings as b, bindings_ledger as bl

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

NOW = "2001-09-01 00:00:00"
USER_EXCLUDES = ["app/tests/**", "m*2.js", "src/**.ts"]


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def joined(values: Column) -> Column:
    return F.array_join(values, "|")


def stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")


# --- scans, filters, scalar functions -------------------------------------------------


def _written_code(spark, sf_dir) -> str:
    """A folder with the code corpus as files."""
    folder = f"{shared_dir(spark)}/tree-{uuid.uuid4().hex}"
    trees.write_texts(b.code_files(spark, sf_dir), folder, "path", "content")
    return folder


@query
def scan_files(spark, sf_dir):
    """Files of a written tree left by the default excludes and the caller's."""
    return trees.scan_tree(spark, _written_code(spark, sf_dir), USER_EXCLUDES).select(F.col("rel_path").alias("path"))


@query
def scan_contents(spark, sf_dir):
    """Size and hash of the contents of a written tree."""
    found = trees.scan_tree(spark, _written_code(spark, sf_dir), USER_EXCLUDES)
    return found.select(F.col("rel_path").alias("path"), "ext", "size", F.md5("content").alias("content_md5"))


@query
def exclude_glob(spark, sf_dir):
    path = F.col("path")
    one = {"recursive": "**/tests/**", "folder": "node_modules/**", "middle": "app/**.py", "plain": "m*.js"}
    return b.code_files(spark, sf_dir).select(
        "path",
        *[globs.excluded(path, [p]).alias(name) for name, p in one.items()],
        globs.excluded(path, fv.CONFIG_EXCLUDES).alias("config_default"),
    )


@query
def decode_text(spark, sf_dir):
    """Texts with bad bytes spliced in; decoding drops them again."""
    raw = b.table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.concat(F.unhex(F.lit("FF41C3")), F.encode("text", "UTF-8"), F.unhex(F.lit("E282"))).alias("raw")
    )
    decoded = text.decode_utf8(F.col("raw"))
    return raw.select("doc_id", F.length(decoded).alias("chars"), F.md5(F.substring(decoded, 2, 2000000000)).alias("digest"))


@query
def split_lines(spark, sf_dir):
    return file_lines(b.code_files(spark, sf_dir))


QUERIES["file_lines"] = QUERIES.pop("split_lines")


@query
def code_lines(spark, sf_dir):
    """Code lines per file by exploding; agrees with the narrow count."""
    return metrics.code_lines(b.code_files(spark, sf_dir))


@query
def supported_files(spark, sf_dir):
    return metrics.supported(b.code_files(spark, sf_dir)).select("path")


@query
def lang_supported(spark, sf_dir):
    path = F.col("path")
    language = text.parser_language(path)
    return b.code_files(spark, sf_dir).select(
        "path", language.isNotNull().alias("supported"), language.alias("parser_language")
    )


@query
def comment_marker(spark, sf_dir):
    ext = text.extension(F.col("path"))
    both = b.code_files(spark, sf_dir).select("path").unionByName(b.database_files(spark, sf_dir).select("path"))
    marker = text.comment_marker(ext)
    return both.select(
        "path",
        marker.alias("marker"),
        F.when(marker.isNull(), F.concat(F.lit("Unsupported file extension: "), ext)).alias("error"),
    )


@query
def detect_language(spark, sf_dir):
    path = F.col("path")
    return b.code_files(spark, sf_dir).select(
        "path",
        text.metric_language(path).alias("metric_language"),
        text.parser_language(path).alias("parser_language"),
        text.prompt_language(path).alias("prompt_language"),
    )


@query
def complexity_grade(spark, sf_dir):
    return b.table(spark, sf_dir, "lineitem").groupBy(
        scoring.complexity_grade(F.col("l_quantity")).alias("grade")
    ).agg(F.count(F.lit(1)).alias("n"))


@query
def severity(spark, sf_dir):
    size = F.floor("o_totalprice").cast("bigint")
    return b.table(spark, sf_dir, "orders").select(
        "o_orderkey", scoring.severity(size, F.lit(150000)).alias("severity")
    )


@query
def recommendations(spark, sf_dir):
    language = F.element_at(F.array(*map(F.lit, ["python", "javascript", "typescript", "java"])), (F.col("p_size") % 4 + 1))
    lines = (F.col("p_partkey") * 7 % 4000).cast("bigint")
    advice = scoring.recommendations(lines, F.col("p_size"), F.col("p_retailprice") / 60, language)
    return b.table(spark, sf_dir, "part").select("p_partkey", joined(advice).alias("advice"))


@query
def module_path(spark, sf_dir):
    """Import path from every code file to a neighbour in another folder."""
    files = b.code_files(spark, sf_dir).select("doc_id", "path")
    other = F.concat(
        F.element_at(F.array(*map(F.lit, b.CODE_FOLDERS + ["src/a/b/", "app/"])), (F.col("doc_id") % 8 + 1).cast("int")),
        F.lit("t"),
        F.col("doc_id").cast("string"),
        F.lit(".py"),
    )
    return files.select("doc_id", text.module_path(F.col("path"), other).alias("module"))


# --- metrics and reports --------------------------------------------------------------


@query
def loc(spark, sf_dir):
    return metrics.lines_of_code(b.code_files(spark, sf_dir))


@query
def py_function_complexity(spark, sf_dir):
    return python_code.python_function_complexity(b.code_files(spark, sf_dir))


@query
def py_file_metrics(spark, sf_dir):
    m = python_code.python_file_metrics(b.code_files(spark, sf_dir))
    detail = F.transform("functions", lambda f: F.concat(f["name"], F.lit(":"), f["complexity"].cast("string")))
    return m.select(
        "path",
        "function_count",
        "cyclomatic_complexity",
        "total_complexity",
        joined(detail).alias("functions"),
        "python_metrics_error",
    )


def _scripts(files: DataFrame) -> DataFrame:
    return files.where(text.metric_language(F.col("path")).isin("javascript", "typescript"))


@query
def js_complexity(spark, sf_dir):
    return _scripts(b.code_files(spark, sf_dir)).select(
        "path", brace_code.script_complexity(F.col("content")).alias("complexity")
    )


@query
def js_function_complexity(spark, sf_dir):
    return brace_code.script_function_complexity(b.code_files(spark, sf_dir))


@query
def js_function_count(spark, sf_dir):
    return _scripts(b.code_files(spark, sf_dir)).select(
        "path", brace_code.script_function_count(F.col("content")).alias("functions")
    )


@query
def file_metrics(spark, sf_dir):
    return metrics.file_metrics(b.code_files(spark, sf_dir))


@query
def metrics_batch(spark, sf_dir):
    """Every file of the corpus and one missing path per document."""
    files = b.code_files(spark, sf_dir)
    gone = F.concat(F.lit("gone/m"), F.col("doc_id").cast("string"), F.lit(".py"))
    asked = files.select(F.explode(F.array("path", gone)).alias("path"))
    return metrics.metrics_batch(asked, files)


@query
def violations(spark, sf_dir):
    found = metrics.violations(b.code_files(spark, sf_dir), 500, USER_EXCLUDES)
    return found.withColumn("recommendations", joined(F.col("recommendations")))


@query
def codebase_summary(spark, sf_dir):
    return metrics.codebase_summary(b.code_files(spark, sf_dir), 500, USER_EXCLUDES)


@query
def codebase_report(spark, sf_dir):
    """Flagship: default excludes and threshold; totals and violations as one table of sections."""
    files = b.code_files(spark, sf_dir)
    totals = metrics.codebase_summary(files).select(
        F.lit("summary").alias("section"),
        F.lit("").alias("file"),
        F.col("total_lines").alias("lines"),
        F.col("total_files").alias("functions"),
        F.col("average_file_size").cast("double").alias("complexity"),
        F.col("files_exceeding_threshold").cast("string").alias("severity"),
        F.lit("").alias("recommendations"),
    )
    found = metrics.violations(files).select(
        F.lit("violation").alias("section"),
        "file",
        F.col("lines").cast("bigint").alias("lines"),
        "functions",
        "complexity",
        "severity",
        joined(F.col("recommendations")).alias("recommendations"),
    )
    return totals.unionByName(found)


@query
def report_json(spark, sf_dir):
    """The report documents, read back by field."""
    rows = metrics.report_documents(b.code_files(spark, sf_dir), "corpus", "2024-01-01T00:00:00Z")
    field = lambda p: F.get_json_object("document", p)
    return rows.select(
        "section",
        "file",
        F.coalesce(field("$.lines"), field("$.summary.totalLines")).cast("bigint").alias("lines"),
        field("$.severity").alias("severity"),
        field("$.projectPath").alias("project"),
        field("$.recommendations[0]").alias("advice"),
    )


# --- constructs -----------------------------------------------------------------------


def _constructs(spark, sf_dir) -> DataFrame:
    return constructs.constructs(b.code_files(spark, sf_dir))


@query
def constructs_all(spark, sf_dir):
    return _constructs(spark, sf_dir)


QUERIES["constructs"] = QUERIES.pop("constructs_all")


@query
def declaration_heads(spark, sf_dir):
    """Decorators and parameters as written, over several lines and forty brackets deep."""
    found = constructs.constructs(b.nested_files(spark, sf_dir))
    return found.select("path", "language", "type", "name", "start_line", "end_line", "parameters", "heritage", "decorators")


@query
def nested_code_complexity(spark, sf_dir):
    """Functions whose decisions stand in f-strings and templates."""
    files = b.nested_files(spark, sf_dir)
    python = python_code.python_function_complexity(files).select("path", "name", "complexity", "line_number")
    scripts = brace_code.script_function_complexity(files).select("path", "name", "complexity", "line_number")
    return python.unionByName(scripts)


@query
def nested_code_files(spark, sf_dir):
    """Functions and decisions of whole files whose strings hold code."""
    return metrics.file_metrics(b.nested_files(spark, sf_dir)).select("path", "function_count", "total_complexity", "python_metrics_error")


@query
def constructs_filter_type(spark, sf_dir):
    return constructs.by_type(_constructs(spark, sf_dir), "method").select("path", "name", "start_line")


@query
def constructs_filter_language(spark, sf_dir):
    return constructs.by_language(_constructs(spark, sf_dir), "typescript").select("path", "name", "start_line")


@query
def constructs_filter_name(spark, sf_dir):
    return constructs.by_name(_constructs(spark, sf_dir), "M1", exact=False).select("path", "name", "start_line")


@query
def constructs_filter_functions(spark, sf_dir):
    return constructs.functions_of(_constructs(spark, sf_dir)).select("path", "type", "name", "start_line")


@query
def constructs_filter_classes(spark, sf_dir):
    return constructs.classes_of(_constructs(spark, sf_dir)).select("path", "type", "name", "start_line")


@query
def constructs_project(spark, sf_dir):
    found = constructs.describe(_constructs(spark, sf_dir))
    return found.select(
        "path", "start_line", "name", "line_count", "label", F.get_json_object("document", "$.name").alias("json_name")
    )


@query
def constructs_by_file(spark, sf_dir):
    return constructs.count_by_file(_constructs(spark, sf_dir))


@query
def constructs_by_type(spark, sf_dir):
    return constructs.count_by_type(_constructs(spark, sf_dir))


@query
def construct_text(spark, sf_dir):
    files = b.code_files(spark, sf_dir)
    found = constructs.construct_text(constructs.functions_of(constructs.constructs(files)), files)
    return found.select("path", "name", "start_line", "source_text")


@query
def find_function(spark, sf_dir):
    return constructs.find_function(b.code_files(spark, sf_dir), "f15").select("path", "start_line", "source_text")


@query
def enclosing_construct(spark, sf_dir):
    return python_code.enclosing_declarations(b.code_files(spark, sf_dir))


@query
def imports(spark, sf_dir):
    return python_code.python_imports(b.code_files(spark, sf_dir))


@query
def function_dependencies(spark, sf_dir):
    found = python_code.function_dependencies(b.code_files(spark, sf_dir))
    return found.withColumn("symbols", joined(F.col("symbols")))


# --- database files -------------------------------------------------------------------


@query
def db_path_checks(spark, sf_dir):
    return dbfiles.path_checks(b.database_files(spark, sf_dir))


@query
def db_sql_files(spark, sf_dir):
    return dbfiles.path_checks(b.database_files(spark, sf_dir)).where("is_sql").select("path")


@query
def db_in_migration_dir(spark, sf_dir):
    return dbfiles.path_checks(b.database_files(spark, sf_dir)).where("in_migration_dir").select("path")


@query
def db_migration_name(spark, sf_dir):
    return dbfiles.path_checks(b.database_files(spark, sf_dir)).where("migration_name").select("path")


@query
def orm_type(spark, sf_dir):
    return b.database_files(spark, sf_dir).select("path", ormtext.orm_type(F.col("content")).alias("orm"))


@query
def db_file_type(spark, sf_dir):
    return dbfiles.typed(b.database_files(spark, sf_dir)).select("path", "file_type")


@query
def db_files(spark, sf_dir):
    return dbfiles.database_files(b.database_files(spark, sf_dir)).select("path")


@query
def sql_tables(spark, sf_dir):
    return b.sql_files(spark, sf_dir).select("path", joined(sqltext.table_names(F.col("content"))).alias("tables"))


@query
def sql_statement_types(spark, sf_dir):
    return b.sql_files(spark, sf_dir).select("path", joined(sqltext.statement_types(F.col("content"))).alias("kinds"))


@query
def sql_complexity(spark, sf_dir):
    return b.sql_files(spark, sf_dir).select("path", sqltext.complexity(F.col("content")).alias("complexity"))


@query
def sql_file_analysis(spark, sf_dir):
    found = dbfiles.sql_analysis(b.sql_files(spark, sf_dir))
    return found.select(
        "path",
        "file_type",
        F.size("tables").alias("tables"),
        joined(F.col("statements")).alias("statements"),
        "complexity",
        "line_count",
        "error",
    )


@query
def orm_models(spark, sf_dir):
    files = b.database_files(spark, sf_dir).withColumn("orm", ormtext.orm_type(F.col("content")))
    found = dbfiles.orm_analysis(files)
    return found.select(
        "path", "file_type", "orm_type", joined(F.col("models")).alias("models"), joined(F.col("tables")).alias("tables"), "model_count"
    )


@query
def migration_ops(spark, sf_dir):
    found = dbfiles.migration_analysis(b.database_files(spark, sf_dir))
    return found.select(
        "path",
        "file_type",
        joined(F.col("operations")).alias("operations"),
        joined(F.col("dependencies")).alias("dependencies"),
    )


@query
def migration_revision(spark, sf_dir):
    return dbfiles.migration_analysis(b.database_files(spark, sf_dir)).where(
        F.col("file_type") == "alembic_migration"
    ).select("path", "revision", "down_revision")


@query
def migration_edges(spark, sf_dir):
    return dbfiles.migration_edges(b.database_files(spark, sf_dir))


@query
def revision_parents(spark, sf_dir):
    return dbfiles.revision_parents(b.database_files(spark, sf_dir))


@query
def revision_chains(spark, sf_dir):
    return dbfiles.revision_chains(b.database_files(spark, sf_dir))


@query
def db_analysis(spark, sf_dir):
    found = dbfiles.analysis(b.database_files(spark, sf_dir))
    return found.select("path", "file_type", "complexity", "model_count", joined(F.col("operations")).alias("operations"))


# --- migrations -----------------------------------------------------------------------


@query
def sql_statements(spark, sf_dir):
    return migrations.sql_statements(b.sql_files(spark, sf_dir))


@query
def split_sql_migration(spark, sf_dir):
    return migrations.split_sql(b.sql_files(spark, sf_dir), 5)


@query
def split_sql_files(spark, sf_dir):
    """Files a split writes, read back: parts of SQL scripts and of Django migrations."""
    sql = migrations.split_sql(b.sql_files(spark, sf_dir), 20).select("out_path", "out_content")
    parts = sql.unionByName(migrations.split_django(b.database_files(spark, sf_dir), 20).select("out_path", "out_content"))
    folder = f"{shared_dir(spark)}/split-{uuid.uuid4().hex}"
    trees.write_texts(parts, folder, packed=True)
    found = trees.scan_tree(spark, folder, defaults=False)
    return found.select(F.substr("rel_path", F.instr("rel_path", "/") + 1).alias("out_path"), F.col("content").alias("out_content"))


@query
def sql_rollback(spark, sf_dir):
    return migrations.sql_rollbacks(b.sql_files(spark, sf_dir))


@query
def django_operations(spark, sf_dir):
    return migrations.django_operations(b.database_files(spark, sf_dir))


@query
def split_django_migration(spark, sf_dir):
    return migrations.split_django(b.database_files(spark, sf_dir), 5)


@query
def django_rollback(spark, sf_dir):
    return migrations.django_rollbacks(migrations.split_django(b.database_files(spark, sf_dir), 5))


@query
def migration_chain(spark, sf_dir):
    both = b.database_files(spark, sf_dir).unionByName(b.sql_files(spark, sf_dir))
    return migrations.migration_chain(both, 5)


@query
def split_dispatch(spark, sf_dir):
    both = b.database_files(spark, sf_dir).unionByName(b.sql_files(spark, sf_dir))
    return migrations.split_dispatch(both, 5)


@query
def extract_query(spark, sf_dir):
    found = migrations.extract_query(b.database_files(spark, sf_dir), "Report-Users.v2")
    return found.withColumn("modified_content", F.md5("modified_content"))


# --- diffs ----------------------------------------------------------------------------


@query
def diff_hunks(spark, sf_dir):
    return diffs.diff_hunks(bl.diffs(spark, sf_dir))


@query
def apply_patches(spark, sf_dir):
    done = diffs.apply_patches(bl.diffs(spark, sf_dir), b.code_files(spark, sf_dir))
    return done.select("path", "status", F.md5("patched").alias("digest"), F.length("patched").alias("chars"), "error")


# --- suggestions ----------------------------------------------------------------------


@query
def suggestions_list(spark, sf_dir):
    """Listing of pending suggestions, newest ten."""
    return ledger.listing(bl.suggestions(spark, sf_dir), status="pending", limit=10).withColumn(
        "created_at", stamp(F.col("created_at"))
    )


@query
def suggestions_filtered(spark, sf_dir):
    """All suggestions of one status with their summaries."""
    return ledger.listing(bl.suggestions(spark, sf_dir), status="approved").select("id", "file_path", "summary")


@query
def suggestion_preview(spark, sf_dir):
    return ledger.preview(bl.suggestions(spark, sf_dir))


@query
def suggestion_lookup(spark, sf_dir):
    asked = b.table(spark, sf_dir, "lineitem").selectExpr("'s' || CAST(l_orderkey * 2 AS STRING) AS id").distinct()
    found = ledger.lookup(asked, bl.suggestions(spark, sf_dir), "id")
    return found.select("id", "file_path", "status", "found")


@query
def suggestions_ingest(spark, sf_dir):
    accepted, rejected = ledger.ingest(bl.suggestions(spark, sf_dir))
    return accepted.select("file_path", "status", "metadata", F.lit(None).cast("string").alias("error")).unionByName(
        rejected.select(
            "file_path", F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("metadata"), "error"
        )
    )


@query
def suggestion_id_dups(spark, sf_dir):
    """Suggestions of customers share a short id here, so copies exist."""
    rows = bl.suggestions(spark, sf_dir).select(F.substring_index("file_path", "/", -1).alias("id"))
    return ledger.duplicate_ids(rows)


@query
def suggestion_stats_status(spark, sf_dir):
    return ledger.statistics_by_status(bl.suggestions(spark, sf_dir))


@query
def suggestion_stats_file(spark, sf_dir):
    return ledger.statistics_by_file(bl.suggestions(spark, sf_dir))


@query
def suggestions_expired(spark, sf_dir):
    return ledger.expired(bl.suggestions(spark, sf_dir), NOW, "rejected", 900).select("id", "file_path")


@query
def suggestions_cleared(spark, sf_dir):
    """Counts before and after a clearing run."""
    records = bl.suggestions(spark, sf_dir)
    kept = ledger.clear(records, NOW, None, 900)
    return (
        records.agg(F.count(F.lit(1)).alias("n"))
        .select(F.lit("all").alias("part"), "n")
        .unionByName(kept.agg(F.count(F.lit(1)).alias("n")).select(F.lit("kept").alias("part"), "n"))
    )


@query
def suggestions_current(spark, sf_dir):
    state = ledger.current_state(bl.suggestion_events(spark, sf_dir))
    return state.withColumn("created_at", stamp(F.col("created_at"))).withColumn("updated_at", stamp(F.col("updated_at")))


@query
def suggestions_deleted(spark, sf_dir):
    """Current state without the ids that have a rejection with an even event number (used as tombstones)."""
    events = bl.suggestion_events(spark, sf_dir)
    tombstones = events.where("status = 'rejected' AND event_id % 50 = 0")
    return ledger.remove(ledger.current_state(events), tombstones).select("id", "status")


@query
def suggestion_transitions(spark, sf_dir):
    found = ledger.transitions(bl.suggestion_events(spark, sf_dir))
    return found.withColumn("ts", stamp(F.col("ts")))


@query
def suggestions_apply_results(spark, sf_dir):
    results = b.table(spark, sf_dir, "orders").where("o_custkey % 3 <> 0").selectExpr(
        "'s' || CAST(o_orderkey AS STRING) AS id",
        "CASE WHEN o_orderstatus = 'F' THEN 'success' ELSE 'error' END AS outcome",
        "o_custkey % 5 = 0 AS dry_run",
    )
    return ledger.apply_results(bl.suggestions(spark, sf_dir), results)


# --- operations -----------------------------------------------------------------------


def _operations(spark, sf_dir) -> DataFrame:
    requests = bl.operation_requests(spark, sf_dir)
    recorded = ledger.record_operations(requests)
    return recorded.withColumn("rolled_back", F.col("operation_type") == "error")


def _branches(spark, sf_dir) -> DataFrame:
    return bl.operation_requests(spark, sf_dir).where("event_id % 4 <> 0").select(ledger.backup_branch(F.col("ts")).alias("branch"))


def _flat(operations: DataFrame) -> DataFrame:
    return operations.withColumns(
        {
            "timestamp": stamp(F.col("timestamp")),
            "files_modified": joined(F.col("files_modified")),
            "files_created": joined(F.col("files_created")),
        }
    )


@query
def operations_ingest(spark, sf_dir):
    return _flat(ledger.record_operations(bl.operation_requests(spark, sf_dir)))


@query
def operation_ids(spark, sf_dir):
    return bl.operation_requests(spark, sf_dir).select(
        "event_id",
        ledger.operation_id(F.col("ts")).alias("operation_id"),
        ledger.backup_branch(F.col("ts"), "save").alias("branch"),
        ledger.short_hash(F.col("commit_before")).alias("short"),
    )


@query
def operations_list(spark, sf_dir):
    found = ledger.list_operations(_operations(spark, sf_dir), limit=10)
    return found.select("operation_id", "operation_type", stamp(F.col("timestamp")).alias("timestamp"))


@query
def operations_status(spark, sf_dir):
    return _flat(ledger.operation_status(ledger.list_operations(_operations(spark, sf_dir), include_rolled_back=True)))


@query
def operation_lookup(spark, sf_dir):
    asked = bl.operation_requests(spark, sf_dir).select(
        F.explode(
            F.array(ledger.operation_id(F.col("ts")), F.concat(F.lit("none-"), F.col("event_id").cast("string")))
        ).alias("operation_id")
    )
    found = ledger.lookup(asked, _operations(spark, sf_dir), "operation_id")
    return found.select("operation_id", "operation_type", "found")


@query
def operations_missing_backup(spark, sf_dir):
    return ledger.missing_backups(_operations(spark, sf_dir), _branches(spark, sf_dir)).select("operation_id", "backup_branch")


@query
def rollback_effects(spark, sf_dir):
    asked = bl.operation_requests(spark, sf_dir).select(
        F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("none-"), F.col("event_id").cast("string")))
        .otherwise(ledger.operation_id(F.col("ts")))
        .alias("operation_id")
    )
    found = ledger.roll_back(asked, _operations(spark, sf_dir), _branches(spark, sf_dir))
    return found.withColumn("files_affected", joined(F.col("files_affected")))


@query
def operations_rolled_back(spark, sf_dir):
    """Ledger after rollback events."""
    events = bl.operation_requests(spark, sf_dir).where("operation_type = 'click'").select(
        ledger.operation_id(F.col("ts")).alias("operation_id"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("ts")
    )
    done = ledger.mark_rolled_back(_operations(spark, sf_dir), events)
    return done.select("operation_id", "rolled_back", stamp(F.col("rollback_timestamp")).alias("rollback_timestamp"))


@query
def execution_outcome(spark, sf_dir):
    results = bl.operation_requests(spark, sf_dir).select(
        ledger.operation_id(F.col("ts")).alias("operation_id"),
        F.expr("CASE WHEN operation_type <> 'click' THEN CASE WHEN value > 100 THEN 1 ELSE 0 END END").alias("exit_code"),
        F.expr("repeat(commit_before || ' ', 9)").alias("stderr"),
        F.expr("CASE WHEN operation_type = 'view' THEN 'no repository' END").alias("failure"),
    )
    return ledger.execution_outcomes(_operations(spark, sf_dir), results)


# --- configuration, prompts, requests -------------------------------------------------


@query
def nearest_config(spark, sf_dir):
    return configs.nearest_config(bl.project_files(spark, sf_dir), bl.project_configs(spark, sf_dir), "~/.config.json")


@query
def config_merge(spark, sf_dir):
    return configs.deep_merge(bl.layers(spark, sf_dir))


@query
def config_document(spark, sf_dir):
    merged = configs.merged_document(configs.deep_merge(bl.layers(spark, sf_dir)))
    keys = F.array_sort(F.map_keys("config"))
    return merged.select("scope", joined(keys).alias("keys"), F.col("config")["thresholds.maxLines"].alias("max_lines"))


@query
def config_violations(spark, sf_dir):
    return configs.config_violations(configs.deep_merge(bl.layers(spark, sf_dir)))


@query
def test_command(spark, sf_dir):
    customers = b.table(spark, sf_dir, "customer").selectExpr("'c' || CAST(c_custkey AS STRING) AS scope")
    asked = customers.select("scope", F.explode(F.array(F.lit("python"), F.lit("java"))).alias("language"))
    return configs.test_commands(asked, configs.deep_merge(bl.layers(spark, sf_dir)))


@query
def render_prompts(spark, sf_dir):
    files = b.code_files(spark, sf_dir)
    names = F.array(*map(F.lit, ["auto", "split", "Extract", "composition", "bogus"]))
    asked = files.withColumn("strategy", F.element_at(names, (F.col("doc_id") % 5 + 1).cast("int")))
    numbers = metrics.file_metrics(files).withColumn(
        "cyclomatic_complexity", F.floor(F.col("cyclomatic_complexity") * 100) / 100
    )
    done = prompts.render_prompts(asked, numbers)
    return done.select("path", "language", "strategy", F.md5("prompt").alias("digest"), "error")


@query
def validate_responses(spark, sf_dir):
    """Answers of varying completeness, one per order."""
    item = (
        "'{\"title\":\"t\",\"description\":\"d\",\"strategy\":\"s\",\"priority\":\"high\",\"estimated_impact\":\"i\"' || "
        "CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE ',\"diff\":\"x\"' END || ',\"reason\":\"r\"}'"
    )
    body = (
        "CASE WHEN o_orderkey % 11 = 0 THEN 'oops' ELSE '{\"file_path\":\"a.py\",\"language\":\"python\"' || "
        "CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE ',\"strategy_used\":\"auto\"' END || ',\"suggestions\":[' || "
        f"CASE WHEN o_orderkey % 2 = 0 THEN {item} ELSE '' END || '],\"summary\":\"s\"}}' END"
    )
    answers = b.table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", f"{body} AS body")
    return prompts.validate_responses(answers)


@query
def validate_requests(spark, sf_dir):
    values = F.array(
        *map(F.lit, ["apply_diff", "AUTO", "openai", "regex", "drop_table", "Split", "nobody", "tree-sitter", "ast"])
    )
    kinds = F.array(*map(F.lit, ["operation", "strategy", "provider", "parser", "colour"]))
    asked = b.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.element_at(kinds, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("kind"),
        F.element_at(values, (F.col("o_orderkey") % 9 + 1).cast("int")).alias("value"),
    )
    return prompts.validate_requests(asked)


# --- streams --------------------------------------------------------------------------


@query
def stream_ledger_state(spark, sf_dir):
    schema = b.table(spark, sf_dir, "events").schema
    events = ledger_stream.stream_events(spark, f"{sf_dir}/event*.parquet", schema)
    state = ledger_stream.latest_status(bl.events_as_status(events))
    rows = ledger_stream.run_to_table(state, ["id"], "update", "id string, status string, updated_at timestamp, events bigint")
    return rows.withColumn("updated_at", stamp(F.col("updated_at")))


@query
def stream_ledger_counts(spark, sf_dir):
    """Events in three batches, the last of which repeats all: kept, repeated and late rows of each batch, and the events in the state."""
    events = b.table(spark, sf_dir, "events")
    folder = f"{shared_dir(spark)}/events-{uuid.uuid4().hex}"
    for k, part in enumerate(("event_id % 2 = 0", "event_id % 4 = 1", "true")):  # files are read in the order they are written
        events.where(part).coalesce(1).write.parquet(f"{folder}/{k}")
    stream = ledger_stream.stream_events(spark, f"{folder}/*", events.schema, files_per_batch=1)
    state = ledger_stream.latest_status(bl.events_as_status(stream), late="5 days")
    rows, counts = ledger_stream.run_counted(state, ["id"], "update", "id string, status string, updated_at timestamp, events bigint")
    return counts.withColumn("in_state", F.lit(rows.agg(F.sum("events")).first()[0]))


@query
def stream_ops_daily(spark, sf_dir):
    schema = b.table(spark, sf_dir, "events").schema
    events = ledger_stream.stream_events(spark, f"{sf_dir}/event*.parquet", schema)
    daily = ledger_stream.daily_counts(events.withColumnRenamed("event_type", "operation_type"))
    rows = ledger_stream.run_to_table(
        daily, ["day", "operation_type"], "update", "day timestamp, operation_type string, operations bigint"
    )
    return rows.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


# --- ledger files ---------------------------------------------------------------------


def _scratch(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"


def _full_suggestions(spark, sf_dir) -> DataFrame:
    rows = bl.suggestions(spark, sf_dir).drop("request")
    return rows.withColumns({"updated_at": F.col("created_at"), "execution_result": F.lit(None).cast("string")})


@query
def suggestions_load(spark, sf_dir):
    """Suggestions written as JSON lines among corrupt, id-less and badly dated ones, and both halves of the ledger."""
    folder = _scratch(spark)
    good = _full_suggestions(spark, sf_dir).select(F.to_json(F.struct("*")).alias("value"))
    bad = b.table(spark, sf_dir, "customer").selectExpr(
        "CASE c_custkey % 3 WHEN 0 THEN 'not json ' || c_custkey WHEN 1 THEN '{\"file_path\":\"x' || c_custkey || '\"}' "
        "ELSE '{\"id\":\"b' || c_custkey || '\",\"created_at\":\"soon\"}' END AS value"
    )
    good.unionByName(bad).write.text(folder)
    records, lines = ledgers.load_suggestions(spark, folder)
    records = records.select(F.lit("good").alias("half"), "id", "file_path", "status", F.lit(None).cast("string").alias("line"))
    return records.unionByName(lines.select(F.lit("bad").alias("half"), "line"), allowMissingColumns=True)


@query
def suggestions_save(spark, sf_dir):
    """Suggestions appended to the saved ledger and read back."""
    folder = _scratch(spark)
    ledgers.save_suggestions(_full_suggestions(spark, sf_dir), folder)
    return ledgers.read_saved_suggestions(spark, folder).select("id", "status", "data")


@query
def operations_load(spark, sf_dir):
    """Operations written as JSON lines and loaded strictly."""
    folder = _scratch(spark)
    _operations(spark, sf_dir).write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(folder)
    return _flat(ledgers.load_operations(spark, folder)).select("operation_id", "timestamp", "files_modified", "rolled_back")


@query
def operations_clear(spark, sf_dir):
    """Records of a saved ledger before and after a confirmed clearing, and why an unconfirmed one is refused."""
    folder = _scratch(spark)
    ledgers.save_operations(_operations(spark, sf_dir), folder)
    saved = lambda: spark.read.schema(ledgers.OPERATIONS).parquet(folder)
    before = saved().count()
    try:
        ledgers.clear_operations(spark, folder)
    except ValueError as refusal:
        refused = str(refusal)
    kept = saved().count()
    ledgers.clear_operations(spark, folder, confirm=True)
    counts = {"before": F.lit(before), "refused": F.lit(refused), "kept": F.lit(kept)}
    return saved().agg(F.count(F.lit(1)).alias("after")).withColumns(counts)


@query
def config_load(spark, sf_dir):
    """Flat keys of one configuration file per customer, and the error of each broken one. Some are three hundred objects deep."""
    deep = 300
    document = F.to_json(
        F.struct(
            F.struct((F.col("c_custkey") % 2000).alias("maxLines")).alias("thresholds"),
            F.struct(F.struct(F.concat("c_mktsegment", F.lit(" {{ \"}")).alias("testCommand")).alias("python")).alias("languages"),
            F.lit("1.0").alias("version"),
        )
    )
    nested = F.concat(F.lit('{"k":' * deep), F.col("c_custkey").cast("string"), F.lit("}" * deep))
    kind = F.col("c_custkey") % 10
    files = b.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit("/config.json")).alias("out_path"),
        F.when(kind == 3, nested).when(kind == 7, F.substring(document, 1, 25)).otherwise(document).alias("out_content"),
    )
    folder = f"{shared_dir(spark)}/configs-{uuid.uuid4().hex}"
    trees.write_texts(files, folder, packed=True)
    loaded = ledgers.configs_in(trees.scan_tree(spark, folder, defaults=False)).withColumn("scope", F.regexp_extract("folder", "([^/]*)$", 1))
    keys = ledgers.config_keys(loaded, "scope").select("scope", "key_path", "value", F.lit(False).alias("broken"))
    broken = loaded.where("error IS NOT NULL").select("scope", F.lit(None).cast("string").alias("key_path"), F.lit(None).cast("string").alias("value"), F.lit(True).alias("broken"))
    return keys.unionByName(broken)
