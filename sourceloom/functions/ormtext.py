"""Classification and analysis of ORM models and migrations from their text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import fixed_values as fv
from .text import basename, extension


def is_sql_file(path: Column) -> Column:
    return F.lower(extension(path)).isin(*fv.SQL_EXTENSIONS)


def in_migration_directory(path: Column) -> Column:
    return F.arrays_overlap(F.split(F.lower(path), "/"), F.array(*map(F.lit, fv.MIGRATION_DIRECTORIES)))


def is_migration_name(name: Column) -> Column:
    return name.rlike(fv.MIGRATION_NAME)


def orm_type(content: Column) -> Column:
    """First ORM with two or more pattern hits, else NULL."""

    def hits(patterns: list[str]) -> Column:
        return sum((content.rlike(p).cast("int") for p in patterns), F.lit(0))

    return F.coalesce(*[F.when(hits(p) >= 2, name) for name, p in fv.ORM_PATTERNS.items()])


def file_type(path: Column, content: Column) -> Column:
    orm = orm_type(content)
    low = F.lower(content)
    migration = in_migration_directory(path) | is_migration_name(basename(path))
    return (
        F.when(is_sql_file(path), "sql_file")
        .when(F.lower(extension(path)) != ".py", "unknown")
        .when(migration & F.contains(low, F.lit("alembic")), "alembic_migration")
        .when(
            migration & (F.contains(low, F.lit("flask-migrate")) | F.contains(content, F.lit("flask_migrate"))),
            "flask_migrate",
        )
        .when(migration, "migration_file")
        .when(orm == "django", "django_model")
        .when(orm.isNotNull(), "sqlalchemy_model")
        .otherwise("unknown")
    )


def _all(content: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(content, F.lit(pattern), F.lit(group))


def models(content: Column, orm: Column) -> Column:
    return (
        F.when(orm == "django", _all(content, r"class\s+(\w+)\s*\(\s*models\.Model\s*\)"))
        .when(orm.isin("sqlalchemy", "flask_sqlalchemy"), _all(content, r"class\s+(\w+)\s*\(\s*Base\s*\)"))
        .otherwise(F.array().cast("array<string>"))
    )


def model_tables(content: Column, orm: Column) -> Column:
    return F.when(
        orm.isin("sqlalchemy", "flask_sqlalchemy"), _all(content, r"""__tablename__\s*=\s*["'](\w+)["']""")
    )


def migration_kind(content: Column) -> Column:
    """Kind by content, Django first."""
    django = F.contains(content, F.lit("django.db")) & F.contains(content, F.lit("migrations"))
    return (
        F.when(django, "django_migration")
        .when(F.contains(F.lower(content), F.lit("alembic")), "alembic_migration")
        .otherwise("migration")
    )


def migration_operations(content: Column) -> Column:
    def present(names: list[str]) -> Column:
        return F.array_compact(F.array(*[F.when(F.contains(content, F.lit(n)), n) for n in names]))

    kind = migration_kind(content)
    return (
        F.when(kind == "django_migration", present(fv.DJANGO_OPERATIONS))
        .when(kind == "alembic_migration", present(fv.ALEMBIC_OPERATIONS))
        .otherwise(F.array().cast("array<string>"))
    )


def revision(content: Column) -> Column:
    return F.nullif(F.regexp_extract(content, r"""revision\s*=\s*["']([^"']+)["']""", 1), F.lit(""))


def down_revision(content: Column) -> Column:
    return F.nullif(F.regexp_extract(content, r"""down_revision\s*=\s*["']([^"']+)["']""", 1), F.lit(""))


def dependency_list(content: Column) -> Column:
    """Text between the brackets of ``dependencies = [...]``; '' when absent."""
    return F.regexp_extract(content, r"dependencies\s*=\s*\[([^\]]*)\]", 1)


def dependency_fragments(content: Column) -> Column:
    """The bracket text split at commas, as a plain list of fragments."""
    parts = F.transform(F.split(dependency_list(content), ","), lambda x: F.regexp_replace(x, r"^\s+|\s+\z", ""))
    return F.filter(parts, lambda x: x != "")


def dependency_tuples(content: Column) -> Column:
    """``(app, name)`` pairs in order."""
    pair = r"""\(['"](\w+)['"]\s*,\s*['"]([^'")]+)['"]\)"""
    inner = dependency_list(content)
    return F.zip_with(
        _all(inner, pair, 1), _all(inner, pair, 2), lambda a, b: F.struct(a.alias("app"), b.alias("name"))
    )
