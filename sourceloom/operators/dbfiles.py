"""Detection and analysis of SQL, ORM and migration files, and the chains of revisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import ormtext, sqltext, text
from ..session import saved


def typed(files: DataFrame) -> DataFrame:
    return files.withColumn("file_type", ormtext.file_type(F.col("path"), F.col("content")))


def database_files(files: DataFrame) -> DataFrame:
    return typed(files).where(F.col("file_type") != "unknown")


def path_checks(files: DataFrame) -> DataFrame:
    """SQL extension, migration folder and migration file name per path."""
    path = F.col("path")
    return files.select(
        "path",
        ormtext.is_sql_file(path).alias("is_sql"),
        ormtext.in_migration_directory(path).alias("in_migration_dir"),
        ormtext.is_migration_name(text.basename(path)).alias("migration_name"),
    )


def sql_analysis(files: DataFrame) -> DataFrame:
    """Tables, statement kinds, complexity and line count; a missing text becomes an error record."""
    content = F.col("content")
    bad = content.isNull()
    empty = F.array().cast("array<string>")
    first = files.select("path", "content", sqltext.statement_types(content).alias("kinds"))
    return first.select(
        "path",
        F.lit("sql").alias("file_type"),
        F.when(bad, empty).otherwise(sqltext.table_names(content)).alias("tables"),
        F.when(bad, empty).otherwise(F.col("kinds")).alias("statements"),
        F.when(bad, 0).otherwise(sqltext.complexity(content, F.col("kinds"))).alias("complexity"),
        text.count_split_lines(content).alias("line_count"),
        F.when(bad, "content could not be read").alias("error"),
    )


def orm_analysis(files: DataFrame) -> DataFrame:
    """Models and tables of ORM files; ``orm`` names the framework."""
    content, orm = F.col("content"), F.col("orm")
    models = ormtext.models(content, orm)
    return files.select(
        "path",
        F.when(orm == "django", "django_model")
        .when(orm.isin("sqlalchemy", "flask_sqlalchemy"), "sqlalchemy_model")
        .otherwise("orm_model")
        .alias("file_type"),
        F.when(orm == "django", "django")
        .when(orm.isin("sqlalchemy", "flask_sqlalchemy"), "sqlalchemy")
        .otherwise("unknown")
        .alias("orm_type"),
        models.alias("models"),
        ormtext.model_tables(content, orm).alias("tables"),
        F.size(models).alias("model_count"),
    )


def migration_analysis(files: DataFrame) -> DataFrame:
    content = F.col("content")
    kind = ormtext.migration_kind(content)
    alembic = kind == "alembic_migration"
    return files.select(
        "path",
        kind.alias("file_type"),
        ormtext.migration_operations(content).alias("operations"),
        F.when(kind == "django_migration", ormtext.dependency_fragments(content)).alias("dependencies"),
        F.when(alembic, ormtext.revision(content)).alias("revision"),
        F.when(alembic, ormtext.down_revision(content)).alias("down_revision"),
    )


def analysis(files: DataFrame) -> DataFrame:
    """One analysis record per database file, chosen by file type, in one pass. Other files give no row."""
    content, detected = F.col("content"), F.col("detected")
    files = files.select("path", "content", ormtext.file_type(F.col("path"), content).alias("detected"))
    is_sql = detected == "sql_file"
    is_model = detected.isin("django_model", "sqlalchemy_model")
    is_migration = detected.isin("migration_file", "alembic_migration", "flask_migrate")
    orm = F.when(detected == "django_model", "django").when(detected == "sqlalchemy_model", "sqlalchemy")
    kind = ormtext.migration_kind(content)
    kinds = F.when(is_sql, sqltext.statement_types(content))
    models = F.when(is_model, ormtext.models(content, orm))
    found = files.withColumns({"kind": F.when(is_migration, kind), "kinds": kinds, "models": models})
    alembic = F.col("kind") == "alembic_migration"
    return found.where(detected != "unknown").select(
        "path",
        F.when(is_sql, "sql").when(is_model, detected).otherwise(F.col("kind")).alias("file_type"),
        F.when(is_sql, sqltext.table_names(content)).otherwise(ormtext.model_tables(content, orm)).alias("tables"),
        F.col("kinds").alias("statements"),
        F.when(is_sql, sqltext.complexity(content, F.col("kinds"))).alias("complexity"),
        F.when(is_sql, text.count_split_lines(content)).alias("line_count"),
        orm.alias("orm_type"),
        "models",
        F.when(is_model, F.size("models")).alias("model_count"),
        F.when(is_migration, ormtext.migration_operations(content)).alias("operations"),
        F.when(F.col("kind") == "django_migration", ormtext.dependency_fragments(content)).alias("dependencies"),
        F.when(alembic, ormtext.revision(content)).alias("revision"),
        F.when(alembic, ormtext.down_revision(content)).alias("down_revision"),
    )


def migration_edges(files: DataFrame) -> DataFrame:
    """Dependency edges: (app, name) tuples of Django files and down revisions of Alembic files."""
    content = F.col("content")
    kind = ormtext.migration_kind(content)
    django = files.where(kind == "django_migration").select(
        "path", F.posexplode(ormtext.dependency_tuples(content)).alias("position", "d")
    )
    alembic = files.where(kind == "alembic_migration").select(
        "path", ormtext.revision(content).alias("child"), ormtext.down_revision(content).alias("parent")
    )
    return django.select(
        "path", text.stem(F.col("path")).alias("child"), F.concat("d.app", F.lit("."), "d.name").alias("parent")
    ).unionByName(alembic.where(F.col("parent").isNotNull()))


def revision_parents(files: DataFrame) -> DataFrame:
    """Each Alembic revision with the file of its predecessor; a missing predecessor stays NULL.

    A predecessor is looked for in the same folder, as revisions repeat across forks and copied projects. If several files
    there carry the revision, the first path stands for them and ``candidates`` says how many there are, so the result has
    one row per file. A predecessor that very many files share is split by the adaptive skew join.
    """
    content = F.col("content")
    revisions = files.where(ormtext.migration_kind(content) == "alembic_migration").select(
        "path",
        text.dirname(F.col("path")).alias("folder"),
        ormtext.revision(content).alias("revision"),
        ormtext.down_revision(content).alias("down_revision"),
    )
    parents = revisions.groupBy("folder", F.col("revision").alias("down_revision")).agg(
        F.min("path").alias("parent_path"), F.count(F.lit(1)).alias("candidates")
    )
    joined = revisions.join(parents, ["folder", "down_revision"], "left")
    state = F.when(F.col("down_revision").isNull(), "root").when(F.col("parent_path").isNull(), "missing")
    return joined.select(
        "path",
        "revision",
        "down_revision",
        "parent_path",
        F.coalesce("candidates", F.lit(0)).alias("candidates"),
        F.coalesce(state, F.lit("linked")).alias("link"),
    )


def revision_chains(files: DataFrame) -> DataFrame:
    """Of each Alembic revision the file that its chain of predecessors begins with, and the number of steps to it.

    ``ends`` says how the chain ends: at a ``root``, at a predecessor that is ``missing``, or in a ``cycle`` (then there is no first
    file). Every file points to its predecessor, and in each round to where that one points, so a chain of n files takes about
    log2(n) rounds, whatever its shape. Files whose chain is known no longer take part.
    """
    links = saved(revision_parents(files).select("path", "parent_path", "link"))
    ended = links.where("parent_path IS NULL").select("path", F.col("path").alias("at"), F.lit(0).cast("bigint").alias("steps"), F.col("link").alias("ends"))
    steps = links.where("parent_path IS NOT NULL").select("path", F.col("parent_path").alias("at"), F.lit(1).cast("bigint").alias("steps"), F.lit(None).cast("string").alias("ends"))
    state = saved(ended.unionByName(steps))
    rounds = max(links.count(), 1).bit_length() + 1  # longer than that only cycles go on
    for _ in range(rounds):
        going = state.where("ends IS NULL")
        ahead = state.select(F.col("path").alias("at"), F.col("at").alias("next"), F.col("steps").alias("more"), F.col("ends").alias("then"))
        moved = going.join(ahead, "at").select("path", F.col("next").alias("at"), (F.col("steps") + F.col("more")).alias("steps"), F.col("then").alias("ends"))
        state = saved(state.where("ends IS NOT NULL").unionByName(moved))
        if state.where("ends IS NULL").isEmpty():
            break
    known = F.col("ends").isNotNull()
    return state.select(
        "path", F.when(known, F.col("at")).alias("first_path"), F.when(known, F.col("steps")).alias("steps"), F.coalesce("ends", F.lit("cycle")).alias("ends")
    )
