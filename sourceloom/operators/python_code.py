"""Python structure: scopes, per-function complexity, declarations, imports and what functions need.

Files are shuffled once by path, before their lines are exploded. Every later window and aggregate is keyed by path (and
something else), so it reuses that placement. A file is one input row, which bounds the size of each group. Enclosing declarations take
one pass over each file instead (``nesting``), with windows only for files that share their path.

Nesting is solved without comparing pairs of lines. Each line that reduces the indentation emits one close marker per
declaration level it leaves; within (path, level) a marker closes the declaration just before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import lexer, nesting
from ..functions.lexer import CONTINUED, HEAD, NOTE, PART, SOFT
from ..functions.text import metric_language
from .placement import by_copies, spread, with_copies

_SCOPE = r"^[ \t\f]*(?:async[ \t]+)?(def|class)[ \t]+(\w+)"
_DEF = r"^[ \t\f]*(?:async[ \t]+)?def[ \t]+\w"
_SIGNATURE = rf"^[^{HEAD}]*{HEAD}"
_CLAUSE = r"^[ \t\f]*(?:async[ \t]+)?(if|elif|for|while|try|except|else)\b"
_DECISIONS = r"\b(?=[aefiow])(?:if|elif|for|while|except|and|or|assert)\b"
_CASE = r"^[ \t\f]*case[ \t]+\S.*:"
_CASE_REST = r"^[ \t\f]*case[ \t]+_[ \t]*:"

_EVENT = (
    "array<struct<level:int,seq:bigint,kind:string,line_no:int,tokens:int,name:string,word:string,"
    "detail:string,before:int>>"
)


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _indent(text: Column) -> Column:
    lead = F.regexp_extract(text, r"^([ \t\f]*)", 1)
    return F.length(lead) + 7 * _count(lead, "\t")


def python_files(files: DataFrame) -> DataFrame:
    return files.where(metric_language(F.col("path")) == "python")


def python_lines(files: DataFrame, keep: tuple[str, ...] = (), needs: bool = False) -> DataFrame:
    """Non-blank masked lines with bracket depth and logical-line heads; the first line is always kept.

    The head of a declaration is one line, whatever number of lines it has (to ``last_no``); ``note`` has its decorators and
    parameters. ``keep`` names file columns to carry along; they are set on the first line only.
    """
    # a Python step would lose the placement by path, so the text is read first and shuffled without strings and comments
    code = files.select("path", *keep, lexer.python_code(F.col("content")).alias("code"))
    return placed_lines(spread(code, "path"), keep, needs)


def placed_lines(code: DataFrame, keep: tuple[str, ...] = (), needs: bool = False) -> DataFrame:
    """``python_lines`` of files (path, code) that are read by the lexer and placed by path already."""
    leads = F.regexp_extract_all("code", F.lit(r"(?md)^([ \t\f]*)(?:async[ \t]+)?(?:def|class)[ \t]"), F.lit(1))
    # everything per file is computed before its lines are exploded
    imports = [_file_imports(F.col("code")).alias("imports")] if needs else []
    code = code.select("path", *keep, "code", F.array_distinct(F.transform(leads, _indent)).alias("levels"), *imports)
    names = F.regexp_extract_all(F.substring_index("text", NOTE, 1), F.lit(r"[A-Za-z_]\w*"), F.lit(0))
    used = F.filter("imports", lambda i: F.array_contains(names, i.accessible)) if needs else None
    carried = ["needs"] if needs else []
    lines = (
        code.select("path", *keep, "levels", *(["imports"] if needs else []), F.posexplode(F.split("code", "\n")).alias("pos", "text"))
        .select(
            "path",
            *[F.when(F.col("pos") == 0, F.col(k)).alias(k) for k in keep],
            "levels",
            (F.col("pos") + 1).alias("line_no"),
            F.substring_index("text", NOTE, 1).alias("text"),
            F.when(F.contains("text", F.lit(NOTE)), F.substring_index("text", NOTE, -1)).alias("note"),
            *([F.when(F.size(used) > 0, used).alias("needs")] if needs else []),
        )
        .where(F.col("text").rlike(r"\S") | (F.col("line_no") == 1))
    )
    delta = _count(F.col("text"), "([{") - _count(F.col("text"), ")]}")
    by_line = W.partitionBy("path").orderBy("line_no")
    before = by_line.rowsBetween(W.unboundedPreceding, -1)
    last_no = F.col("line_no") + _count(F.col("text"), SOFT)
    lines = lines.withColumns({"delta": delta, "continued": F.endswith("text", F.lit(CONTINUED)), "last_no": last_no})
    # windows of one ordering stand in one select, so that they share one pass
    lines = lines.select(
        "path",
        *keep,
        "levels",
        "line_no",
        "last_no",
        F.translate("text", CONTINUED, "").alias("text"),
        "note",
        *carried,
        "delta",
        F.coalesce(F.sum("delta").over(before), F.lit(0)).alias("depth"),
        F.coalesce(F.lag("continued").over(by_line), F.lit(False)).alias("joined"),
        F.lag("last_no").over(by_line).alias("before"),
        F.lead("line_no").over(by_line).isNull().alias("is_last"),
    )
    head = (F.col("depth") <= 0) & ~F.col("joined") & F.col("text").rlike(r"\S")
    return lines.withColumn("is_head", head)


def _line_tokens(text: Column, is_head: Column) -> Column:
    """Decision points of a line; a signature and the guard word of a case do not count."""
    case = is_head & text.rlike(_CASE)
    body = (
        F.when(is_head & text.rlike(_DEF) & ~F.contains(text, F.lit(HEAD)), "")
        .when(is_head & text.rlike(_DEF), F.regexp_replace(text, _SIGNATURE, ""))
        .when(case, F.regexp_replace(text, r"^(\s*case\s.*?)\sif\s", "$1 "))
        .otherwise(text)
    )
    arm = F.when(case & ~text.rlike(_CASE_REST), 1).otherwise(0)
    return F.regexp_count(body, F.lit(_DECISIONS)) + arm


def _events(lines: DataFrame, keep: tuple[str, ...] = (), sparse: bool = False, needs: bool = False) -> DataFrame:
    """Per line: closings it causes (C), a declaration (S), the line itself (L), a clause keyword (K).

    With ``sparse``, lines without decision points are left out unless they are the first or show an error; with ``needs`` also,
    only those stay that use an import.
    """
    by_line = W.partitionBy("path").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    head = F.col("is_head")
    lines = (
        lines.withColumn("indent", F.when(head, _indent(F.col("text"))))
        .withColumn("scope", F.when(head, F.nullif(F.regexp_extract("text", _SCOPE, 1), F.lit(""))))
        .withColumn("word", F.when(head, F.nullif(F.regexp_extract("text", _CLAUSE, 1), F.lit(""))))
        .withColumn("is_scope", F.when(head, F.col("scope").isNotNull()))
        .select(
            "*",
            F.last("indent", True).over(by_line).alias("last_indent"),
            F.last("is_scope", True).over(by_line).alias("last_scope"),
        )
    )
    top = F.col("last_indent") - F.when(F.col("last_scope"), 0).otherwise(1)
    empty = F.array().cast(_EVENT)

    def event(kind: str, rank: int, level: Column, **extra: Column) -> Column:
        none = F.lit(None)
        return F.struct(
            level.cast("int").alias("level"),
            (F.col("line_no").cast("bigint") * 8 + rank).alias("seq"),
            F.lit(kind).alias("kind"),
            F.col("line_no").cast("int").alias("line_no"),
            extra.get("tokens", F.lit(0)).cast("int").alias("tokens"),
            extra.get("name", none).cast("string").alias("name"),
            extra.get("word", none).cast("string").alias("word"),
            extra.get("detail", none).cast("string").alias("detail"),
            extra.get("before", none).cast("int").alias("before"),
        )

    lines = lines.withColumn("tokens", _line_tokens(F.col("text"), head))
    # the lines of a head with anything on them, counted from its first
    soft = F.split("text", SOFT)
    spread_over = F.array_join(F.filter(F.transform(soft, lambda x, k: F.when(x.rlike(r"\S"), k)), lambda k: k.isNotNull()), ",")
    line = F.array(event("L", 2, F.lit(-1), tokens=F.col("tokens"), detail=F.when(F.col("last_no") > F.col("line_no"), spread_over)))
    scope = F.array(
        event(
            "S",
            1,
            F.col("indent"),
            name=F.regexp_extract("text", _SCOPE, 2),
            word=F.col("scope"),
            detail=F.col("note"),
        )
    )
    clause = F.array(event("K", 3, F.col("indent"), word=F.col("word")))
    left = F.filter("levels", lambda v: (v >= F.col("indent")) & (v <= top))
    closing = F.transform(left, lambda v: event("C", 0, v, before=F.col("before")))
    ending = F.transform("levels", lambda v: event("C", 7, v, before=F.col("last_no")))
    after = F.col("depth") + F.col("delta")
    broken = (after < 0) | F.col("text").rlike("[\"']") | (F.col("is_last") & (after != 0))
    lines = lines.withColumn("broken", broken)
    wanted = (F.col("tokens") > 0) | F.col("broken") | (F.col("line_no") == 1) if sparse else F.lit(True)
    wanted = F.col("needs").isNotNull() if needs else wanted
    carried = [F.col("needs")] if needs else []
    rows = F.concat(
        F.when(head, closing).otherwise(empty),
        F.when(F.col("scope").isNotNull(), scope).otherwise(empty),
        F.when(wanted, line).otherwise(empty),
        F.when(F.col("word").isNotNull(), clause).otherwise(empty),
        F.when(F.col("is_last"), ending).otherwise(empty),
    )
    return lines.select("path", *keep, "broken", *carried, F.explode(rows).alias("e")).select(
        "path", *keep, "broken", *carried, "e.*"
    )


def python_scope_events(files: DataFrame, keep: tuple[str, ...] = (), sparse: bool = False, needs: bool = False) -> DataFrame:
    """Ordered events with nesting depth: S opens a scope at ``depth``; C carries the scope it closes."""
    return scope_events(python_lines(files, keep, needs), keep, sparse, needs)


def scope_events(lines: DataFrame, keep: tuple[str, ...] = (), sparse: bool = False, needs: bool = False) -> DataFrame:
    """``python_scope_events`` of lines."""
    events = _events(lines, keep, sparse, needs)
    level = W.partitionBy("path", "level").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    kind = F.col("kind")
    mark = F.when(
        kind.isin("S", "C"),
        F.struct("kind", F.col("line_no").alias("start"), "name", "word", "detail"),
    )
    events = (
        events.withColumns({"mark": mark, "key": F.when(kind == "K", F.col("word"))})
        .select("*", F.last("mark", True).over(level).alias("opened"), F.last("key", True).over(level).alias("clause"))
        .drop("mark", "key")
        .withColumn("closes", F.when((kind == "C") & (F.col("opened.kind") == "S"), F.col("opened")))
    )
    # an else counts when it belongs to a loop or a try
    loop_else = (kind == "K") & (F.col("word") == "else") & F.col("clause").isin("for", "while", "try", "except")
    events = events.where(kind.isin("L", "S") | F.col("closes").isNotNull() | loop_else)
    step = F.when(kind == "S", 1).when(kind == "C", -1).otherwise(0)
    running = W.partitionBy("path").orderBy("seq", F.desc("level"))
    return (
        events.withColumn("tokens", F.when(loop_else, 1).otherwise(F.col("tokens")))
        .withColumn("step", step)
        .withColumn(
            "depth", F.coalesce(F.sum("step").over(running.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        )
    )


def _placed_code(files: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Code of files read by the lexer and placed by path."""
    return spread(files.select("path", *keep, lexer.python_code(F.col("content")).alias("code")), "path")


def python_declarations(files: DataFrame) -> DataFrame:
    """All defs and classes at any depth with first and last line."""
    return placed_declarations(_placed_code(files))


def placed_declarations(code: DataFrame) -> DataFrame:
    """``python_declarations`` of files (path, code) that are read by the lexer and placed by path already."""
    found = with_copies(code.select("path", "code")).mapInArrow(nesting.file_declarations, nesting.FILE_DECLARATIONS)
    return found.select(
        "path",
        F.when(F.col("word") == "class", "class").otherwise("function").alias("type"),
        "name",
        F.col("start").alias("start_line"),
        F.col("last").alias("end_line"),
        _written(F.substring_index("detail", PART, -1)).alias("detail"),
        _written(F.substring_index("detail", PART, 1)).alias("decorators"),
    )


def declarations_in(lines: DataFrame) -> DataFrame:
    """Declarations of files that share their path: lines of the same number stand side by side."""
    closed = scope_events(lines, sparse=True).where(F.col("kind") == "C")
    return closed.select(
        "path",
        F.when(F.col("closes.word") == "class", "class").otherwise("function").alias("type"),
        F.col("closes.name").alias("name"),
        F.col("closes.start").alias("start_line"),
        F.greatest("before", "closes.start").alias("end_line"),
        _written(F.substring_index("closes.detail", PART, -1)).alias("detail"),
        _written(F.substring_index("closes.detail", PART, 1)).alias("decorators"),
    )


def _written(note: Column) -> Column:
    """Source text from the note of a head; none is NULL."""
    return F.nullif(F.replace(note, F.lit(SOFT), F.lit("\n")), F.lit(""))


def _measured(files: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per path, all files read as Python: its functions with their complexity, the sum, and whether it is broken.

    Measured are functions outside any other scope and methods of outermost classes. Lines of deeper
    scopes belong to nobody. Files that share their path are read as one.
    """
    code = spread(files.select("path", *keep, lexer.python_heads(F.col("content")).alias("code")), "path")
    names = ["path", *keep]
    kinds = [f"`{n}` {code.schema[n].dataType.simpleString()}" for n in names]
    found = [f"functions {nesting.FUNCTIONS}", "total bigint", "broken boolean"]
    return with_copies(code).mapInArrow(nesting.file_functions(names), ", ".join(kinds + found))


def python_function_complexity(files: DataFrame) -> DataFrame:
    """One row per measured function; files with syntax errors give none."""
    found = _measured(python_files(files)).where(~F.col("broken")).select("path", F.explode("functions").alias("f"))
    return found.select("path", "f.name", "f.complexity", "f.line_number", "f.end_line_number", "f.is_method")


def python_file_metrics(files: DataFrame) -> DataFrame:
    return measured_files(python_files(files))


def measured_files(files: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per file, read as Python: function count, mean and total complexity, function details, or an error.

    The details list is bounded by the functions of one file.
    """
    ok, n = ~F.col("broken"), F.size("functions").cast("bigint")
    return _measured(files, keep).select(
        "path",
        *keep,
        F.when(ok, n).alias("function_count"),
        F.when(ok, F.when(n > 0, F.col("total") / n).otherwise(0.0)).alias("cyclomatic_complexity"),
        F.when(ok, F.col("total")).alias("total_complexity"),
        F.when(ok, F.col("functions")).otherwise(F.slice("functions", 1, 0)).alias("functions"),
        F.when(~ok, F.concat(F.lit("Syntax error in "), F.col("path"))).alias("python_metrics_error"),
    )


# --- nearest enclosing declaration -------------------------------------------------


def _nested(events: DataFrame) -> DataFrame:
    """Line and declaration events (L, S), one row per nesting level, with the ``scope`` around them at that level (``nest``).

    At level k the enclosing scope is the last one opened at that level, so one window on (path, level)
    replaces an interval join; rows grow with nesting depth only. A declaration line belongs to the scope it opens.
    """
    opened = F.col("kind") == "S"
    inside = F.col("depth") + F.when(opened, 1).otherwise(0)
    levels = F.when(opened | (inside == 0), F.array(inside)).otherwise(F.sequence(F.lit(1).cast("bigint"), inside))
    events = events.withColumn("inside", inside).withColumn("nest", F.explode(levels))
    within = W.partitionBy("path", "nest").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    scope = F.last(F.when(opened, F.struct("name", "line_no", "word")), True).over(within)
    return events.withColumn("scope", F.when(F.col("nest") > 0, scope))


def line_scopes(files: DataFrame) -> DataFrame:
    """Every non-blank code line with each declaration around it, one row per nesting level; level 0 is the module."""
    once, shared = by_copies(_placed_code(python_files(files)))
    lines = once.select("path", F.explode(nesting.events_of(F.col("code"))).alias("e")).select("path", "e.*").where(F.col("kind") == "L")
    no_scope = F.array(F.lit(None).cast("struct<name:string,line_no:int,word:string>"))
    at = F.explode(F.coalesce(F.split("detail", ",").cast("array<int>"), F.array(F.lit(0))))
    lines = lines.select("path", "line_no", F.size("around").alias("inside"), at.alias("offset"), "around")
    lines = lines.select("*", F.posexplode(F.when(F.col("inside") > 0, F.col("around")).otherwise(no_scope)).alias("pos", "scope"))
    return lines.select(
        "path",
        (F.col("line_no") + F.col("offset")).alias("line_no"),
        F.col("inside").cast("bigint").alias("inside"),
        F.when(F.col("inside") > 0, F.col("pos") + 1).otherwise(0).cast("bigint").alias("nest"),
        F.col("scope.name").alias("name"),
        F.when(F.col("scope.word") == "class", "class").when(F.col("scope").isNotNull(), "function").alias("type"),
        F.col("scope.line_no").alias("start_line"),
    ).unionByName(_line_scopes_by_windows(shared))


def _line_scopes_by_windows(code: DataFrame) -> DataFrame:
    """``line_scopes`` of files that share their path."""
    events = scope_events(placed_lines(code)).where(F.col("kind").isin("L", "S"))
    offsets = F.coalesce(F.split("detail", ",").cast("array<int>"), F.array(F.lit(0)))
    return (
        _nested(events)
        .where(F.col("kind") == "L")
        .withColumn("offset", F.explode(offsets))
        .select(
            "path",
            (F.col("line_no") + F.col("offset")).alias("line_no"),
            "inside",
            "nest",
            F.col("scope.name").alias("name"),
            F.when(F.col("scope.word") == "class", "class").when(F.col("scope").isNotNull(), "function").alias("type"),
            F.col("scope.line_no").alias("start_line"),
        )
    )


def enclosing_declarations(files: DataFrame) -> DataFrame:
    """Innermost declaration around every non-blank code line (NULL at module level)."""
    return line_scopes(files).where(F.col("nest") == F.col("inside")).drop("inside").withColumnRenamed("nest", "depth")


# --- imports -----------------------------------------------------------------------


def _import_statements(lines: DataFrame) -> DataFrame:
    """Import statements glued to one line each."""
    order = W.partitionBy("path").orderBy("line_no")
    is_import = F.col("text").rlike(r"^[ \t\f]*(?:import|from)[ \t]")
    lines = lines.withColumns(
        {"starts": F.when(F.col("is_head"), is_import), "head": F.when(F.col("is_head"), F.col("line_no"))}
    )
    return (
        lines.select(
            "path",
            "line_no",
            "text",
            F.last("starts", True).over(order).alias("wanted"),
            F.last("head", True).over(order).alias("head_line"),
        )
        .where("wanted")
        .groupBy("path", "head_line")
        .agg(F.sort_array(F.collect_list(F.struct("line_no", "text"))).alias("part"))
        .select(
            "path",
            F.col("head_line").alias("line_no"),
            F.explode(F.split(F.array_join(F.col("part.text"), " "), ";")).alias("statement"),
        )
        .withColumn("statement", F.regexp_replace(F.trim("statement"), r"\s+", " "))
    )


def _accessible(imports: DataFrame) -> DataFrame:
    """Name under which an import is used."""
    plain = F.col("type") == "import"
    name = F.coalesce("alias", F.when(plain, F.substring_index("module", ".", 1)).otherwise(F.col("symbol")))
    return imports.withColumn("accessible", name)


def python_imports(files: DataFrame) -> DataFrame:
    """One row per imported name: type, module, symbol, alias."""
    return _imports_of(python_lines(python_files(files)))


def _imports_of(lines: DataFrame) -> DataFrame:
    statements = _import_statements(lines)
    source = r"^from ?(\.*[ ]?[\w.]*) import ?\(?(.*?)\)?$"
    from_module = F.regexp_extract("statement", source, 1)
    is_from = F.startswith("statement", F.lit("from"))
    body = F.when(is_from, F.regexp_extract("statement", source, 2)).otherwise(
        F.regexp_extract("statement", r"^import (.*)$", 1)
    )
    rows = statements.select(
        "path",
        "line_no",
        F.when(is_from, "from_import").otherwise("import").alias("type"),
        F.replace(from_module, F.lit(" "), F.lit("")).alias("source"),
        F.explode(F.split(body, ",")).alias("item"),
    ).withColumn("item", F.trim("item"))
    name = F.regexp_extract("item", r"^([\w.]+|\*)(?: as \w+)?$", 1)
    alias = F.nullif(F.regexp_extract("item", r" as (\w+)$", 1), F.lit(""))
    imported = rows.where(name != "").select(
        "path",
        "line_no",
        "type",
        F.when(F.col("type") == "import", name).otherwise(F.col("source")).alias("module"),
        F.when(F.col("type") == "from_import", name).alias("symbol"),
        alias.alias("alias"),
    )
    return _accessible(imported)


#: Import statements of a masked file, each with all of its lines.
_IMPORTS = rf"(?md)^[ \t\f]*(?:import|from)[ \t](?:[^\n{CONTINUED}(]|{CONTINUED}\n|\([^)]*\))*+"


def _file_imports(code: Column) -> Column:
    """Array of (accessible, type, module, symbol) of a masked file: what each imported name means.

    Of several imports under one name the last counts, and from-imports before plain ones.
    """
    glued = F.transform(F.regexp_extract_all(code, F.lit(_IMPORTS), F.lit(0)), lambda s: F.trim(F.regexp_replace(s, rf"[\s{CONTINUED}]+", " ")))
    statements = F.flatten(F.transform(glued, lambda s: F.transform(F.split(s, ";"), lambda x: F.trim(x))))
    source = r"^from ?(\.*[ ]?[\w.]*) import ?\(?(.*?)\)?$"

    def items(statement: Column, at: Column) -> Column:
        is_from = F.startswith(statement, F.lit("from"))
        body = F.when(is_from, F.regexp_extract(statement, source, 2)).otherwise(F.regexp_extract(statement, r"^import (.*)$", 1))
        module = F.replace(F.regexp_extract(statement, source, 1), F.lit(" "), F.lit(""))

        def item(text: Column) -> Column:
            name = F.regexp_extract(F.trim(text), r"^([\w.]+|\*)(?: as \w+)?$", 1)
            alias = F.nullif(F.regexp_extract(F.trim(text), r" as (\w+)$", 1), F.lit(""))
            own = F.when(is_from, name).otherwise(F.substring_index(name, ".", 1))
            return F.struct(
                is_from.alias("f"),
                at.alias("at"),
                F.when(is_from, module).otherwise(name).alias("module"),
                F.when(is_from, name).alias("symbol"),
                F.when(name != "", F.coalesce(alias, own)).alias("accessible"),
            )

        return F.transform(F.split(body, ","), item)

    found = F.filter(F.flatten(F.transform(statements, items)), lambda i: i.accessible.isNotNull())
    rank = lambda i: F.struct(i.f, i.at, i.module, i.symbol)
    return F.filter(found, lambda i: ~F.exists(found, lambda j: (j.accessible == i.accessible) & (rank(j) > rank(i))))


def function_dependencies(files: DataFrame) -> DataFrame:
    """Imports each function needs: identifiers used in it that an import of its file makes accessible.

    The imports of a file are found before its lines are exploded, so a line only keeps the identifiers that are imported and what
    they mean. Those travel with the line through the windows that find the functions around it: one scan, one shuffle of text.
    A module imported plainly is needed as a whole (``symbols`` NULL).
    """
    events = python_scope_events(python_files(files), sparse=True, needs=True).where(F.col("kind").isin("L", "S"))
    inner = _nested(events)
    around = inner.where((F.col("kind") == "L") & F.col("needs").isNotNull() & (F.col("scope.word") == "def"))
    needed = around.select("path", F.col("scope.name").alias("name"), F.col("scope.line_no").alias("start_line"), F.explode("needs").alias("i"))
    whole = F.max(F.col("i.symbol").isNull())
    return needed.groupBy("path", "name", "start_line", F.col("i.module").alias("module")).agg(
        F.when(~whole, F.array_sort(F.collect_set("i.symbol"))).alias("symbols")
    )
