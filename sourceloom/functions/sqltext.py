"""SQL-file expressions: tables, statement types, complexity, statements, rollback. No shuffle anywhere."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import fixed_values as fv
from .text import BLANKS

_IDENT = r"""([`"']?(?U:\w+)[`"']?)"""


def _keyword(pattern: str) -> str:
    """Case-insensitive pattern; the lookahead on its first letter rejects other positions at once."""
    first = pattern.removeprefix(r"\b")[0]
    return rf"(?=[{first}{first.lower()}])(?i:{pattern})"


def table_names(content: Column) -> Column:
    """Distinct table names after CREATE TABLE, FROM, JOIN, INSERT INTO and UPDATE, sorted, without quotes."""
    found = F.concat(
        *[F.regexp_extract_all(content, F.lit(_keyword(lead) + _IDENT), F.lit(1)) for lead in fv.SQL_TABLE_LEADS]
    )
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.btrim(x, F.lit("`\"'")))))


def statement_types(content: Column) -> Column:
    """Statement kinds that occur, in a fixed order."""
    hits = [F.when(content.rlike(_keyword(pattern)), kind) for kind, pattern in fv.SQL_STATEMENTS.items()]
    return F.array_compact(F.array(*hits))


def has_subquery(content: Column) -> Column:
    """SELECT, FROM, ``(`` and SELECT occurring in this order, found by position in linear time."""
    low = F.lower(content)

    def after(word: str, start: Column, skip: int) -> Column:
        return F.when(start > 0, F.position(F.lit(word), low, start + skip)).otherwise(0)

    outer = F.locate("select", low)
    source = after("from", outer, 6)
    paren = after("(", source, 4)
    return after("select", paren, 1) > 0


def complexity(content: Column, kinds: Column | None = None) -> Column:
    """2 per statement kind, 3 per JOIN and UNION, 1 per WHERE and 5 for a nested SELECT."""

    def words(word: str) -> Column:
        return F.regexp_count(content, F.lit(_keyword(rf"\b{word}\b")))

    return (
        2 * F.size(statement_types(content) if kinds is None else kinds)
        + 3 * (words("JOIN") + words("UNION"))
        + words("WHERE")
        + F.when(has_subquery(content), 5).otherwise(0)
    )


def statements(content: Column) -> Column:
    """Statements of a script in order.

    Blank and comment lines go; a line that ends in ``;`` ends a statement; a trailing remainder is kept.
    """
    # a line is blank or a comment: remove it with its line break
    kept = F.regexp_replace(content, rf"(?<![^\n])[{BLANKS}\r]*+(?:--[^\n]*+)?(?:\n|\z)", "")
    marked = F.regexp_replace(kept, rf";([{BLANKS}\r]*+)\n", ";$1\u0001")
    whole = F.regexp_replace(marked, r"\n\z", "")
    return F.filter(F.split(whole, "\u0001"), lambda s: s != "")


def rollback_statement(statement: Column) -> Column:
    """Statement that undoes a CREATE TABLE or ADD COLUMN; NULL for anything else."""
    upper = F.upper(statement)
    created = F.nullif(F.regexp_extract(statement, r"(?i)CREATE\s+TABLE\s+(\w+)", 1), F.lit(""))
    added = r"(?i)ALTER\s+TABLE\s+(\w+)\s+ADD\s+COLUMN\s+(\w+)"
    table, column = (F.nullif(F.regexp_extract(statement, added, k), F.lit("")) for k in (1, 2))
    return F.when(
        F.contains(upper, F.lit("CREATE TABLE")), F.concat(F.lit("DROP TABLE IF EXISTS "), created, F.lit(";"))
    ).when(
        F.contains(upper, F.lit("ALTER TABLE")) & F.contains(upper, F.lit("ADD COLUMN")),
        F.concat(F.lit("ALTER TABLE "), table, F.lit(" DROP COLUMN "), column, F.lit(";")),
    )


def rollback_script(script: Column) -> Column:
    """Undo statements in reverse order; ``script`` is an array of statements."""
    undo = F.transform(F.reverse(script), rollback_statement)
    return F.array_join(F.array_compact(undo), "\n\n")


# --- query extraction --------------------------------------------------------------


def first_query(code: Column) -> Column:
    """First quoted text that begins with SELECT, up to the next quote; NULL when there is none."""
    found = F.regexp_extract(code, r"(?is)[\"']+(SELECT[^\"']*)[\"']", 1)
    return F.nullif(F.regexp_replace(found, r"^\s+|\s+\z", ""), F.lit(""))


def view_name(identifier: Column) -> Column:
    return F.concat(F.lit("view_"), F.regexp_replace(F.lower(identifier), r"(?U)[^\w]", "_"))


def view_ddl(view: Column, query: Column) -> Column:
    return F.concat(
        F.lit("-- View: "), view, F.lit("\n\nCREATE OR REPLACE VIEW "), view, F.lit(" AS\n"), query, F.lit(";\n")
    )


def view_rollback(view: Column, query: Column) -> Column:
    return F.concat(
        F.lit("-- Rollback script for view: "),
        view,
        F.lit("\n\nDROP VIEW IF EXISTS "),
        view,
        F.lit(";\n\n-- Original query:\n-- "),
        query,
        F.lit("\n"),
    )
