"""Splitting of migrations into chained parts, rollback scripts and query extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import nesting, ormtext, sqltext, text
from .placement import by_copies, spread

UNSPLIT_SQL = "SQL migration does not need splitting"
UNSPLIT_DJANGO = "Migration does not need splitting"
ALEMBIC_PENDING = "Alembic migration splitting not yet implemented"


def split_kind(path: Column, content: Column) -> Column:
    """Which splitter handles a file: Django and Alembic by content, SQL by suffix, else NULL."""
    django = F.contains(content, F.lit("django.db")) & F.contains(content, F.lit("migrations"))
    return (
        F.when(django, "django")
        .when(F.contains(F.lower(content), F.lit("alembic")), "alembic")
        .when(text.extension(path) == ".sql", "sql")
    )


# --- SQL scripts: one row per file holds its statements, so nothing is shuffled ------


def sql_statements(files: DataFrame) -> DataFrame:
    exploded = files.select("path", F.posexplode(sqltext.statements(F.col("content"))).alias("pos", "statement"))
    return exploded.select("path", (F.col("pos") + 1).alias("n"), "statement")


def _sibling(path: Column, suffix: Column) -> Column:
    """Path of a new file beside another one."""
    folder = text.dirname(path)
    name = F.concat(text.stem(path), suffix)
    return F.when(F.contains(path, F.lit("/")), F.concat(folder, F.lit("/"), name)).otherwise(name)


def _part_path(path: Column, part: Column, ext: str) -> Column:
    return _sibling(path, F.concat(F.lit("_part"), part.cast("string"), F.lit(ext)))


def split_sql(files: DataFrame, size: int = 5) -> DataFrame:
    """Parts of the scripts with more than ``size`` statements: path, part, statements, new path and text."""
    script = files.select("path", sqltext.statements(F.col("content")).alias("s"))
    starts = F.sequence(F.lit(0), F.size("s") - 1, F.lit(size))
    chunks = F.transform(starts, lambda k: F.slice("s", k + 1, size))
    # a condition inside the expression, as a filter would compute the statements twice
    none = F.array().cast("array<array<string>>")
    parts = script.select("path", F.posexplode(F.when(F.size("s") > size, chunks).otherwise(none)).alias("pos", "chunk"))
    part = F.col("pos") + 1
    return parts.select(
        "path",
        part.alias("part"),
        F.size("chunk").alias("statements"),
        _part_path(F.col("path"), part, ".sql").alias("out_path"),
        F.array_join("chunk", "\n\n").alias("out_content"),
    )


def sql_rollbacks(files: DataFrame) -> DataFrame:
    """Rollback script per SQL file."""
    scripts = files.select("path", sqltext.statements(F.col("content")).alias("s"))
    return scripts.select("path", F.size("s").alias("statements"), sqltext.rollback_script(F.col("s")).alias("rollback"))


# --- Django migrations ----------------------------------------------------------------


def operations_text(content: Column) -> Column:
    """Text between ``operations = [`` and its matching bracket; '' when absent or unbalanced.

    The text is cut at every ``]``; a running count finds the first cut where the brackets balance.
    """
    lead = "operations = ["
    rest = F.substr(content, F.instr(content, lead) + len(lead))
    cuts = F.split(F.when(F.instr(content, lead) > 0, rest).otherwise(""), "\\]")
    state = F.struct(F.lit(1).alias("open"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(acc: Column, cut: Column) -> Column:
        left = acc.open + F.length(cut) - F.length(F.replace(cut, F.lit("["), F.lit(""))) - 1
        at = acc["at"] + 1
        end = F.when((acc.end == 0) & (left == 0), at).otherwise(acc.end)
        return F.struct(left.cast("int").alias("open"), at.alias("at"), end.alias("end"))

    end = F.aggregate(cuts, state, step, lambda acc: acc.end)
    # the piece after the last bracket has no bracket of its own
    return F.when((end > 0) & (end < F.size(cuts)), F.array_join(F.slice(cuts, 1, end), "]")).otherwise("")


def django_operations(files: DataFrame) -> DataFrame:
    """Operations of Django migrations in order: path, n, operation.

    A line at nesting zero that ends in a comma closes an operation, and so does one that starts the next.
    Files are shuffled once by path.
    """
    once, shared = by_copies(spread(files.select("path", "content"), "path"))
    found = once.select("path", F.posexplode(_operations(F.col("content"))).alias("pos", "operation"))
    found = found.select("path", (F.col("pos") + 1).alias("n"), "operation")
    return found.unionByName(_operations_by_windows(shared))


def _operations(content: Column) -> Column:
    return nesting.operations_of(operations_text(content))


def _operations_by_windows(body: DataFrame) -> DataFrame:
    """``django_operations`` of files that share their path: lines of the same number stand side by side."""
    body = body.select("path", operations_text(F.col("content")).alias("ops")).where(F.col("ops") != "")
    lines = body.select("path", F.posexplode(F.split("ops", "\n")).alias("pos", "line"))

    def net(left: str, right: str) -> Column:
        count = lambda c: F.length("line") - F.length(F.replace("line", F.lit(c), F.lit("")))
        return count(left) - count(right)

    order = W.partitionBy("path").orderBy("pos")
    running = order.rowsBetween(W.unboundedPreceding, 0)
    line = F.col("line")
    lines = (
        lines.withColumn("square", F.sum(net("[", "]")).over(running))
        .withColumn("round", F.sum(net("(", ")")).over(running))
        .withColumn("flat", (F.col("square") == 0) & (F.col("round") == 0))
        .withColumn("ends", F.col("flat") & F.endswith(text.strip(line), F.lit(",")))
        .withColumn("starts", F.col("flat") & F.contains(line, F.lit("migrations.")))
        .withColumn("cut", F.col("starts") | F.coalesce(F.lag("ends").over(order), F.lit(False)))
        .withColumn("block", F.sum(F.col("cut").cast("int")).over(running))
    )
    blocks = lines.groupBy("path", "block").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x.line), "\n").alias("o")
    )
    kept = blocks.select("path", "block", text.strip(F.col("o")).alias("operation")).where(
        F.contains("operation", F.lit("migrations."))
    )
    numbered = kept.withColumn("n", F.row_number().over(W.partitionBy("path").orderBy("block")))
    return numbered.select("path", "n", "operation")


def _django_file(operations: Column, dependency: Column, title: Column) -> Column:
    # fixed layout of a generated migration
    return F.concat(
        F.lit('from django.db import migrations, models\n\nclass Migration(migrations.Migration):\n    """\n    '),
        title,
        F.lit('\n    """\n    \n    dependencies = [\n        '),
        F.coalesce(dependency, F.lit("")),
        F.lit("\n    ]\n    \n    operations = [\n"),
        operations,
        F.lit("\n    ]"),
    )


def _origin(content: Column) -> Column:
    """First dependency of a migration, as written in Python."""
    first = F.get(ormtext.dependency_tuples(content), F.lit(0))
    return F.when(first.isNotNull(), F.concat(F.lit("('"), first.app, F.lit("', '"), first["name"], F.lit("')")))


def _chunks_by_windows(files: DataFrame, size: int) -> DataFrame:
    """Parts (path, part, operations, body, origin) of the files that share their path."""
    part = F.floor((F.col("n") - 1) / size).cast("int") + 1
    operations = _operations_by_windows(files).withColumn("part", part)
    chunks = operations.groupBy("path", "part").agg(
        F.count(F.lit(1)).alias("operations"),
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("n", "operation"))), lambda x: x.operation), ",\n"
        ).alias("body"),
    )
    whole = W.partitionBy("path")
    chunks = chunks.withColumn("total", F.sum("operations").over(whole)).where(F.col("total") > size).drop("total")
    # a column that is read in any case, so that both sides of the join share one shuffle
    origin = files.where(F.col("content").isNotNull()).select("path", _origin(F.col("content")).alias("origin"))
    return chunks.join(origin, "path")


def split_django(files: DataFrame, size: int = 5) -> DataFrame:
    """Parts of the Django migrations with more than ``size`` operations.

    Part 1 depends on the first dependency of the original, each later part on the part before it.
    """
    files = files.where(split_kind(F.col("path"), F.col("content")) == "django").where(F.col("path").isNotNull())
    once, shared = by_copies(spread(files.select("path", "content"), "path"))
    script = once.select("path", _origin(F.col("content")).alias("origin"), _operations(F.col("content")).alias("o"))
    starts = F.sequence(F.lit(0), F.size("o") - 1, F.lit(size))
    chunks = F.transform(starts, lambda k: F.slice("o", k + 1, size))
    none = F.array().cast("array<array<string>>")
    parts = script.select("path", "origin", F.posexplode(F.when(F.size("o") > size, chunks).otherwise(none)).alias("pos", "chunk"))
    chunks = parts.select(
        "path",
        (F.col("pos") + 1).alias("part"),
        F.size("chunk").cast("bigint").alias("operations"),
        F.array_join("chunk", ",\n").alias("body"),
        "origin",
    ).unionByName(_chunks_by_windows(shared, size))
    path, number = F.col("path"), F.col("part")
    app = text.basename(text.dirname(path))
    before = F.concat(
        F.lit("('"), app, F.lit("', '"), text.stem(path), F.lit("_part"), (number - 1).cast("string"), F.lit("')")
    )
    chained = chunks.withColumn("depends_on", F.when(number == 1, F.col("origin")).otherwise(before))
    title = F.concat(text.stem(path), F.lit(" - Part "), number.cast("string"))
    return chained.select(
        "path",
        "part",
        "operations",
        _part_path(path, number, ".py").alias("out_path"),
        "depends_on",
        _django_file(F.col("body"), F.col("depends_on"), title).alias("out_content"),
    )


def django_rollbacks(parts: DataFrame) -> DataFrame:
    """Shell lines that undo split Django migrations, last part first: path, step, command."""
    out = F.col("out_path")
    backwards = W.partitionBy("path").orderBy(F.desc("part"))
    return parts.select(
        "path",
        F.row_number().over(backwards).alias("step"),
        F.concat(
            F.lit("python manage.py migrate "),
            text.basename(text.dirname(out)),
            F.lit(" "),
            text.stem(out),
            F.lit(" --fake-initial"),
        ).alias("command"),
    )


def migration_chain(files: DataFrame, size: int = 5) -> DataFrame:
    """Every generated part with what it depends on (Django) or its place (SQL)."""
    django = split_django(files, size).select("path", "part", "out_path", "depends_on")
    sql = split_sql(files.where(split_kind(F.col("path"), F.col("content")) == "sql"), size)
    sql = sql.select("path", "part", "out_path", F.lit(None).cast("string").alias("depends_on"))
    return django.unionByName(sql)


def split_dispatch(files: DataFrame, size: int = 5) -> DataFrame:
    """Outcome per file: the splitter, the number of result files, and a message or an error."""
    kind = split_kind(F.col("path"), F.col("content"))
    marked = files.select("path", "content", kind.alias("kind"))
    parts = split_django(files, size).groupBy("path").agg(F.count(F.lit(1)).alias("django_parts"))
    statements = F.size(sqltext.statements(F.col("content")))
    sql_parts = F.when(statements > size, F.ceil(statements / size)).otherwise(1)
    counted = marked.select(
        "path", "kind", F.when(F.col("kind") == "sql", sql_parts).cast("bigint").alias("sql_parts")
    ).join(parts, "path", "left")
    files_out = F.when(F.col("kind") == "sql", F.col("sql_parts")).when(
        F.col("kind").isNotNull(), F.coalesce("django_parts", F.lit(1))
    )
    message = (
        F.when(F.col("kind") == "alembic", ALEMBIC_PENDING)
        .when((F.col("kind") == "sql") & (F.col("sql_parts") == 1), UNSPLIT_SQL)
        .when((F.col("kind") == "django") & F.col("django_parts").isNull(), UNSPLIT_DJANGO)
    )
    error = F.when(F.col("kind").isNull(), F.concat(F.lit("Unsupported migration type for file: "), F.col("path")))
    return counted.select(
        "path", "kind", files_out.alias("split_files"), message.alias("message"), error.alias("error")
    )


# --- query extraction -----------------------------------------------------------------


def extract_query(files: DataFrame, identifier: str, view: str | None = None) -> DataFrame:
    """First quoted SELECT of each file as a view, the changed source and a rollback text; else an error."""
    content = F.col("content")
    query = F.col("query")
    name = F.lit(view) if view else sqltext.view_name(F.lit(identifier))
    found = files.select("path", "content", sqltext.first_query(content).alias("query"))
    missing = query.isNull()
    return found.select(
        "path",
        F.when(~missing, name).alias("view_name"),
        query.alias("query"),
        F.when(~missing, F.concat(F.lit("database/views/"), name, F.lit(".sql"))).alias("view_path"),
        sqltext.view_ddl(name, query).alias("view_content"),
        F.when(~missing, _sibling(F.col("path"), F.concat(F.lit("_modified"), text.extension(F.col("path"))))).alias(
            "modified_path"
        ),
        F.when(~missing, F.replace(content, query, F.concat(F.lit("SELECT * FROM "), name))).alias("modified_content"),
        sqltext.view_rollback(name, query).alias("rollback"),
        F.when(missing, f"Could not find query identified by: {identifier}").alias("error"),
    )
