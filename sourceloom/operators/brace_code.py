"""Structure of brace languages and SQL: declarations, function counts, complexity.

Whole-file numbers (function count, complexity) are narrow expressions on the masked text. Spans need
bracket matching: one pass over the marks and brackets of all files of a task (``nesting``). The same by windows is what that pass is
tested against: the text is cut behind every mark and every place where a declaration can end, with brackets, line breaks and decision
points of each piece counted, and within (path, nesting level) a closing bracket ends the declaration just before it.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import lexer, nesting
from ..functions.lexer import brackets
from ..functions.masking import mask_sql
from ..functions.text import parser_language
from .placement import spread, with_copies

# a declaration mark: OPEN kind | name | parameters | heritage CLOSE
_OPEN, _CLOSE = "\u0001", "\u0002"
# behind one of these signs or at the start of the text
_START = r"(?<![^\n{};,\u0002])([ \t]*+)"

_SCRIPT_WORDS = "if|for|while|switch|catch|function|return|with|super|do|else|new|await|typeof"
_TYPE_WORDS = "new|return|else|throw|case|await|yield|public|private|protected|static|if|for|while|switch|catch|using|lock"
_MODIFIER = (
    "(?:public|private|protected|internal|static|final|abstract|virtual|override|sealed|async|synchronized|"
    "partial|extern|unsafe|new|readonly|default|native|strictfp)"
)

# (language, kind, pattern, replacement groups for name, parameters, heritage); the user may add rows
# the kind may be a group; kinds: function, method, constructor, class, interface, struct, table; 'lambda' is a function without a block
DECLARATIONS: list[tuple[str, str, str, str, str, str]] = []
for _language in ("javascript", "typescript"):
    DECLARATIONS += [
        (
            _language,
            "function",
            r"(?=[aclvf])(?<![.\w$])(?:(?:const|let|var)\s+([\w$]+)\s*=\s*)?(?:async\s+)?function\b\s*\*?\s*([\w$]*)(?=\s*("
            + brackets(4)
            + "))",
            "$1$2",
            "$3",
            "",
        ),
        (
            _language,
            "function",
            r"(?=[cl])(?<![.\w$])(?:const|let)(?=\s+([\w$]+)\s*(?::[^=;\n]+)?=\s*(?:async\b\s*)?("
            + brackets(3)
            + r"|[\w$]+)\s*(?::[^=;{\n]+)?=>\s*\{)",
            "$1",
            "$2",
            "",
        ),
        (
            _language,
            "lambda",
            r"(?=[cl])(?<![.\w$\u0002])(?:const|let)(?=\s+([\w$]+)\s*(?::[^=;\n]+)?=\s*(?:async\b\s*)?("
            + brackets(3)
            + r"|[\w$]+)\s*(?::[^=;{\n]+)?=>)",
            "$1",
            "$2",
            "",
        ),
        (
            _language,
            "method",
            _START
            + r"(?:(?:static|async|get|set|public|private|protected|readonly|override)\s+)*+(?:\*\s*)?"
            + rf"(?!(?:{_SCRIPT_WORDS})\b)([\w$#]+)(?:<[^<>(){{}}]*>)?\s*(?=({brackets(4)})\s*(?::[^=(){{}};]+)?\{{)",
            "$2",
            "$3",
            "",
        ),
        (
            _language,
            "class",
            r"(?=[eadc])(?<![.\w$])(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([\w$]+)(?:<[^>{]*>)?(?=\s*(extends\s[^{]+?)?\s*\{)",
            "$1",
            "",
            "$2",
        ),
    ]
for _language in ("java", "csharp"):
    DECLARATIONS += [
        (
            _language,
            "constructor",
            _START + rf"(?:{_MODIFIER}\s+)++([\w]+)\s*(?=({brackets(4)})\s*(?:throws\s[^{{;]+|:\s*(?:base|this)\s*{brackets(5)}\s*)?\{{)",
            "$2",
            "$3",
            "",
        ),
        (
            _language,
            "method",
            _START
            + rf"(?:{_MODIFIER}\s+)*+(?:<[^>{{}}();]+>\s*)?(?!(?:{_TYPE_WORDS})\b)[\w.]+(?:<[^{{}}();]*>)?(?:\[\])*+\??\s+"
            + rf"(?!(?:{_TYPE_WORDS})\b)([\w]+)\s*(?=({brackets(4)})\s*(?:throws\s[^{{;]+)?\{{)",
            "$2",
            "$3",
            "",
        ),
        (
            _language,
            "$1",
            rf"(?=[a-z])(?<![.\w])(?:{_MODIFIER}\s+)*+(class|interface)\s+(\w+)(?:<[^>{{]*>)?"
            + r"(?=\s*((?:extends|implements|:)\s?[^{;]+?)?\s*\{)",
            "$2",
            "",
            "$3",
        ),
    ]
DECLARATIONS += [
    (
        "sql",
        "function",
        r"(?i)\bCREATE\s+(?:OR\s+REPLACE\s+)?(?:FUNCTION|PROCEDURE)\s+([\w.]+)",
        "$1",
        "",
        "",
    ),
    ("sql", "table", r"(?i)\bCREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?[`\"\[]?([\w.]+)", "$1", "", ""),
]

# decision points: branches, cases, handlers, logical operators and ternaries
_BRANCH = r"(?<![.\w$#])(?:if|for|while|case|catch)\b(?!\s*:)"
_LOGICAL = r"&&(?!=)|\|\|(?!=)|\?\?(?!=)"
_TERNARY = r"\?(?![?:),;\]=]|\.(?!\d))"
DECISIONS = rf"(?=[ifwc&|?])(?:{_BRANCH}|{_LOGICAL}|{_TERNARY})"

#: Marks a decision point; the lexers remove this character from the input.
_DECISION = "\u0003"


def _pieces(ends: str) -> str:
    """Pattern of the pieces of a marked text: up to a declaration mark, one of the ``ends``, or the end of the text."""
    return rf"[^{_OPEN}{ends}]*+(?:{_OPEN}[^{_CLOSE}]*+{_CLOSE}|[{ends}])|[^{_OPEN}{ends}]++\z"


SCRIPT_LANGUAGES = ("javascript", "typescript")
TYPED_LANGUAGES = ("java", "csharp")
LANGUAGES = (*SCRIPT_LANGUAGES, *TYPED_LANGUAGES, "sql")


def masked(language: Column, content: Column) -> Column:
    """Code without strings and comments. Each lexer is given the texts of its languages only."""
    script, typed = language.isin(*SCRIPT_LANGUAGES), language.isin(*TYPED_LANGUAGES)
    return F.when(language == "sql", mask_sql(content)).otherwise(
        F.coalesce(lexer.script_code(F.when(script, content)), lexer.brace_code(F.when(typed, content)))
    )


def marked(code: Column, language: str, declarations: Iterable[tuple] = DECLARATIONS) -> Column:
    """Masked text with a mark in front of every declaration of the language."""
    for lang, kind, pattern, name, params, heritage in declarations:
        if lang == language:
            code = F.regexp_replace(code, pattern, f"{_OPEN}{kind}|{name}|{params}|{heritage}{_CLOSE}$0")
    return code


def _by_language(language: Column, code: Column, names: Iterable[str], declarations) -> Column:
    first, *rest = names
    out = F.when(language == first, marked(code, first, declarations))
    for name in rest:
        out = out.when(language == name, marked(code, name, declarations))
    return out


def script_complexity(content: Column) -> Column:
    """Decision points of a JS or TS text plus one; a blank text has one."""
    return code_complexity(lexer.script_code(content))


def script_function_count(content: Column) -> Column:
    """Functions of every form in a JS or TS text, counted by position."""
    return code_function_count(lexer.script_code(content))


def code_complexity(code: Column) -> Column:
    """As ``script_complexity``, of ``lexer.script_code``."""
    return F.regexp_count(code, F.lit(DECISIONS)) + 1


def code_function_count(code: Column) -> Column:
    """As ``script_function_count``, of ``lexer.script_code``."""
    return F.transform(F.array(marked(code, "typescript")), _function_marks)[0]  # marked once


def _function_marks(code: Column) -> Column:
    """Marks of functions in a marked text. Lengths without them are compared; no expression is searched for."""
    marks = [f"{_OPEN}{kind}|" for kind in ("function", "lambda", "method")]
    return sum(F.length(code) - F.length(F.replace(code, F.lit(m), F.lit(m[:-1]))) for m in marks)


def declarations(files: DataFrame, languages: Iterable[str] = LANGUAGES, rules: Iterable[tuple] = DECLARATIONS) -> DataFrame:
    """Declarations with spans, parameters, heritage and the number of decision points inside."""
    languages = list(languages)
    code = files.withColumn("language", parser_language(F.col("path"))).where(F.col("language").isin(*languages))
    # a Python step would lose the placement by path, so the text is read first and shuffled without strings and comments
    code = code.select("path", "language", masked(F.col("language"), F.col("content")).alias("code"))
    return declarations_in(spread(code, "path"), languages, rules)


def declarations_in(code: DataFrame, languages: Iterable[str] = LANGUAGES, rules: Iterable[tuple] = DECLARATIONS) -> DataFrame:
    """``declarations`` of files (path, language, code) that are masked and placed by path already."""
    return _named(_spans(_with_decisions(_marked_files(code, languages, rules))))


def declarations_by_windows(code: DataFrame, languages: Iterable[str] = LANGUAGES, rules: Iterable[tuple] = DECLARATIONS) -> DataFrame:
    """As ``declarations_in``, in one stream behind one shuffle, whether paths repeat or not."""
    return _declarations_by_windows(_bare(code, languages, rules))


def placed_declarations(code: DataFrame, languages: Iterable[str] = LANGUAGES, rules: Iterable[tuple] = DECLARATIONS) -> DataFrame:
    """As ``declarations_in``, without decision points and positions."""
    return _named(_spans(_marked_files(code, languages, rules))).drop("complexity", "position")


def _spans(code: DataFrame) -> DataFrame:
    """Marks of files with the ends of their blocks, whether paths repeat or not: one pass over the marked texts of a task."""
    code = with_copies(code.select("path", "language", "lines", "by_line", "code"))
    found = code.mapInArrow(nesting.file_spans, nesting.FILE_SPANS).withColumn("part", F.split("mark", "\\|", 4))
    d = F.struct("language", F.col("part")[0].alias("kind"), "part", "line_no", "decisions")
    return found.select("path", "id", d.alias("d"), "end_line", F.col("lines").alias("last_line"), "end_decisions", "all_decisions")


def _with_decisions(code: DataFrame) -> DataFrame:
    """Marked files with a mark at every decision point outside of the marks: they are found while the text is whole."""
    return code.withColumn("code", F.regexp_replace("code", rf"({_OPEN}[^{_CLOSE}]*+)(?={_CLOSE})|{DECISIONS}", f"$1{_DECISION}"))


def _bare(code: DataFrame, languages: Iterable[str], rules: Iterable[tuple]) -> DataFrame:
    """Files with their number of lines, their marks, brackets, line breaks, semicolons and decision points, and how lambdas end."""
    code = _with_decisions(_marked_files(code, languages, rules))
    # only marks, brackets, line breaks and semicolons are kept, so that pieces are short
    bare = F.regexp_replace("code", rf"({_OPEN}[^{_CLOSE}]*+{_CLOSE})|[^{_OPEN}{_DECISION}(){{}}\[\]\n;]++", "$1")
    return code.select("path", "language", "lines", "by_line", bare.alias("code"))


def _marked_files(code: DataFrame, languages: Iterable[str], rules: Iterable[tuple]) -> DataFrame:
    """Files with their number of lines, their marked code, and whether it has a lambda."""
    code = code.select(
        "path", "language", _count_code_lines(F.col("code")).alias("lines"), _by_language(F.col("language"), F.col("code"), list(languages), rules).alias("code")
    )
    return code.withColumn("by_line", F.contains("code", F.lit(f"{_OPEN}lambda|")))


def _count_code_lines(code: Column) -> Column:
    """``count_lines`` of a masked text, whose line breaks are \\n only; lengths are compared."""
    breaks = F.length(code) - F.length(F.replace(code, F.lit("\n"), F.lit("")))
    return breaks + F.when(F.endswith(code, F.lit("\n")) | (code == ""), 0).otherwise(1)


def _named(found: DataFrame) -> DataFrame:
    """Fields of declarations from the parts of their marks (path, id, d, end_line, last_line, end_decisions, all_decisions)."""
    return found.select(
        "path",
        F.col("d.language").alias("language"),
        F.when(F.col("d.kind") == "lambda", "function").otherwise(F.col("d.kind")).alias("type"),
        F.coalesce(F.nullif(F.col("d.part")[1], F.lit("")), F.lit("<anonymous>")).alias("name"),
        F.col("d.line_no").alias("start_line"),
        F.coalesce("end_line", "last_line").alias("end_line"),
        F.nullif(F.col("d.part")[2], F.lit("")).alias("parameters"),
        F.nullif(F.trim(F.col("d.part")[3]), F.lit("")).alias("heritage"),
        (F.coalesce("end_decisions", "all_decisions") - F.col("d.decisions") + 1).alias("complexity"),
        F.col("id").alias("position"),
    )


def _parts(mark: Column) -> Column:
    return F.regexp_replace(mark, f"[{_OPEN}{_CLOSE}{_DECISION}{lexer.CODE_RANGE}]", "")


def _declarations_by_file(code: DataFrame) -> DataFrame:
    """Declarations of files whose path stands once."""
    spans = nesting.spans_of(F.col("code"), F.col("by_line"), F.col("language") == "sql")
    found = code.select("path", "language", "lines", F.explode(spans).alias("e")).withColumn("parts", _parts(F.col("e.mark")))
    d = F.struct(
        "language",
        F.substring_index("parts", "|", 1).alias("kind"),
        F.split("parts", "\\|", 4).alias("part"),
        F.col("e.line_no").alias("line_no"),
        F.col("e.decisions").alias("decisions"),
    )
    return _named(found.select("path", "e.*", d.alias("d"), F.col("lines").alias("last_line")).drop("line_no", "decisions"))


def _declarations_by_windows(code: DataFrame) -> DataFrame:
    """Declarations of files that share their path: pieces of the same number stand side by side."""
    cut = lambda ends: F.regexp_extract_all("code", F.lit(_pieces(ends)), F.lit(0))
    by_semicolon = F.col("language") == "sql"
    # only a function without a block ends at a line break
    pieces = F.when(by_semicolon, cut(";")).when(F.col("by_line"), cut("\n;}")).otherwise(cut("}"))
    stream = code.select("path", "language", "lines", F.posexplode(pieces).alias("pos", "piece"))
    is_mark, last = F.contains("piece", F.lit(_OPEN)), F.right("piece", F.lit(1))
    parts = _parts(F.substr("piece", F.instr("piece", _OPEN)))
    stream = stream.select(
        "path",
        "language",
        "lines",
        "pos",
        is_mark.alias("mark"),
        F.when(is_mark, parts).when(last.isin("\n", ";", "}"), last).otherwise("").alias("t"),
        F.when(is_mark, F.substring_index("piece", _OPEN, 1)).otherwise(F.col("piece")).alias("plain"),
    )
    count = lambda chars: F.regexp_count("plain", F.lit(f"[{chars}]"))
    stream = stream.select(
        "path",
        "language",
        "lines",
        "pos",
        "t",
        "mark",
        (count("(\\[{") - count(")\\]}")).alias("opened"),
        count("\n").alias("breaks"),
        count(_DECISION).alias("points"),
    )
    t, mark = F.col("t"), F.col("mark")
    closes = F.when(~mark & (t == "}"), 1).otherwise(0)
    breaks = F.when(~mark & (t == "\n"), 1).otherwise(0)
    order = W.partitionBy("path").orderBy("pos")
    running = order.rowsBetween(W.unboundedPreceding, 0)
    inside = order.rangeBetween(W.unboundedPreceding, W.currentRow)  # what pieces hold counts before what they end with
    whole = W.partitionBy("path")
    stream = stream.select(
        "path",
        "language",
        "lines",
        "pos",
        "t",
        "mark",
        (F.sum(F.col("opened") + closes).over(inside) - F.sum(closes).over(running)).alias("depth"),
        (F.sum(F.col("breaks") - breaks).over(inside) + F.sum(breaks).over(running) + 1 - breaks).alias("line_no"),
        F.sum("points").over(inside).alias("decisions"),
    ).withColumn("all_decisions", F.max("decisions").over(whole))
    part = F.split("t", "\\|", 4)
    kind = F.when(mark, F.substring_index("t", "|", 1))
    level = W.partitionBy("path", "depth").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    fields = F.struct(F.col("pos").alias("id"), kind.alias("kind"))
    # braces answer block declarations; a line break or semicolon answers lambdas and SQL statements
    pending = F.last(F.when(mark | (t == "}"), fields), True).over(level)
    simple = F.last(F.when(mark | t.isin("\n", ";", "}"), fields), True).over(level)
    statement = F.last(F.when(mark | (t == ";"), fields), True).over(level)
    ended = (
        F.when(by_semicolon & (t == ";"), statement.id)
        .when(~by_semicolon & (t == "}") & (pending.kind != "lambda"), pending.id)
        .when(~by_semicolon & t.isin("\n", ";") & (simple.kind == "lambda"), simple.id)
    )
    is_end = F.col("ended").isNotNull() & ~mark
    rows = stream.withColumn("kind", kind).withColumn("ended", ended).where(mark | is_end)
    return _named(
        rows.withColumn("id", F.when(mark, F.col("pos")).otherwise(F.col("ended")))
        .groupBy("path", "id")
        .agg(
            F.max(F.when(mark, F.struct("language", "kind", part.alias("part"), "line_no", "decisions"))).alias("d"),
            F.min(F.when(~mark, F.col("line_no"))).alias("end_line"),
            F.min(F.when(~mark, F.col("decisions"))).alias("end_decisions"),
            F.max("lines").alias("last_line"),
            F.max("all_decisions").alias("all_decisions"),
        )
        .where(F.col("d").isNotNull())
    )


def script_function_complexity(files: DataFrame) -> DataFrame:
    """Per function of JS and TS files; an inner function also counts for the outer one."""
    return (
        declarations(files, SCRIPT_LANGUAGES)
        .where(F.col("type").isin("function", "method"))
        .select("path", "name", "complexity", F.col("start_line").alias("line_number"), "end_line", "type")
    )
