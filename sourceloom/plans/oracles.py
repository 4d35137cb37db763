"""Reference SQL per query, for an independent engine (DuckDB dialect).

Where the data are generated code, many answers follow from how the words became lines, without any parsing: these
statements compute them from word positions and lengths.
"""

from __future__ import annotations

from string import Template

from ..functions import fixed_values as fv
from . import bindings_ledger as bl, line_templates as lt
from .bindings import CODE_EXTENSIONS, CODE_FOLDERS

ORACLES: dict[str, str] = {}


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


def _duck(case: str) -> str:
    return Template(case).substitute(i="i", n="n")


_PATH = f"{_list(CODE_FOLDERS)}[doc_id % 6 + 1] || 'm' || doc_id || {_list(CODE_EXTENSIONS)}[doc_id % 7 + 1]"

WORDS = """
WITH split_words AS (SELECT doc_id, string_split(text, ' ') AS ws FROM documents),
words AS (SELECT doc_id, len(ws) AS total, unnest(range(len(ws))) AS i, length(unnest(ws)) AS n FROM split_words),
"""

_CASES = [lt.PYTHON, lt.PYTHON, lt.JAVASCRIPT, lt.TYPESCRIPT, lt.JAVA, lt.CSHARP, lt.SQL]
_CODE_LINE = "CASE doc_id % 7 " + " ".join(f"WHEN {k} THEN {_duck(c)}" for k, c in enumerate(_CASES)) + " END"
CODE = (
    WORDS
    + f"""
paths AS (SELECT doc_id, {_PATH} AS path, {_list(CODE_EXTENSIONS)}[doc_id % 7 + 1] AS ext FROM documents),
code_lines AS (SELECT w.doc_id, path, ext, i, n, total, {_CODE_LINE.replace('doc_id', 'w.doc_id')} AS line
               FROM words w JOIN paths p ON w.doc_id = p.doc_id),
marked_lines AS (SELECT *, CASE WHEN ext = '.py' THEN '#' WHEN ext = '.sql' THEN '--' ELSE '//' END AS marker FROM code_lines),
file_loc AS (SELECT doc_id, path, ext, count(*) FILTER (WHERE trim(line) <> '' AND NOT starts_with(trim(line), marker)) AS loc
             FROM marked_lines GROUP BY ALL),
"""
)

SQL_TEXT = (
    WORDS
    + f"""
sql_lines AS (SELECT doc_id, 'db/s' || doc_id || '.sql' AS path, i, n, {_duck(lt.SQL)} AS line FROM words),
sql_text AS (SELECT doc_id, path, string_agg(line, chr(10) ORDER BY i) AS content FROM sql_lines GROUP BY ALL),
live AS (SELECT *, trim(line) LIKE '%;' AS ends FROM sql_lines WHERE trim(line) <> '' AND NOT starts_with(trim(line), '--')),
numbered AS (SELECT *, coalesce(sum(ends::int) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS s FROM live),
statements AS (SELECT doc_id, path, s AS n, string_agg(line, chr(10) ORDER BY i) AS statement FROM numbered GROUP BY ALL),
"""
)

_DB_LINE = (
    "CASE doc_id % 8 " + " ".join(f"WHEN {k} THEN {_duck(lt.database_case(k))}" for k in lt.DATABASE_LINES) + " END"
)


def _fill(template: str) -> str:
    return lt.fill(template)


_DB_PATH = "CASE doc_id % 8 " + " ".join(f"WHEN {k} THEN {_fill(t)}" for k, t in lt.DATABASE_PATH.items()) + " END"
_DB_HEAD = "CASE doc_id % 8 " + " ".join(f"WHEN {k} THEN {_fill(t)}" for k, t in lt.DATABASE_HEAD.items()) + " END"
DB_TEXT = (
    WORDS
    + f"""
db_body AS (SELECT doc_id, string_agg({_DB_LINE}, chr(10) ORDER BY i) AS body, any_value(total) AS total FROM words GROUP BY ALL),
db_text AS (SELECT doc_id, doc_id % 8 AS kind, total, {_DB_PATH} AS path,
            {_DB_HEAD} || body || CASE WHEN doc_id % 8 = 3 THEN {_fill(lt.DATABASE_FOOT[3])} ELSE '' END AS content FROM db_body),
"""
)

# --- Python ground truth: blocks of twelve words after three head lines ----------------------

PY = (
    CODE
    + """
py AS (SELECT doc_id, path, i, n, total, (i - 3) % 12 AS pos, floor((i - 3) / 12) AS blk FROM code_lines WHERE ext = '.py' AND i >= 3),
py_bad AS (SELECT doc_id FROM py WHERE i = total - 1 AND pos IN (7, 9)),
py_blocks AS (
    SELECT doc_id, path, blk, min(i) AS i0,
           max(n) FILTER (WHERE pos = 0) AS n0, max(n) FILTER (WHERE pos = 1) AS n1,
           coalesce(sum(CASE WHEN pos = 2 THEN CASE WHEN n % 3 = 0 THEN 3 ELSE 1 END WHEN pos = 3 THEN 1 WHEN pos = 5 THEN 2 END), 0) AS inner_points,
           coalesce(sum(CASE WHEN pos = 11 AND n % 5 = 0 THEN 1 END), 0) AS last_points,
           max(i + 1) FILTER (WHERE pos NOT IN (4, 6, 10)) AS end_outer,
           max(i + 1) FILTER (WHERE pos BETWEEN 1 AND 8 AND pos NOT IN (4, 6)) AS end_inner,
           coalesce(bool_or(pos = 2 AND n % 3 <> 0), false) AS uses_path, coalesce(bool_or(pos = 3), false) AS uses_js,
           coalesce(bool_or(pos = 5), false) AS uses_os, coalesce(bool_or(pos = 11 AND n % 5 <> 0), false) AS uses_dict
    FROM py GROUP BY ALL),
py_defs AS (
    SELECT doc_id, path, blk, 0 AS depth, CASE WHEN n0 % 4 = 0 THEN 'class' ELSE 'function' END AS type,
           CASE WHEN n0 % 4 = 0 THEN 'K' ELSE 'f' END || CAST(i0 AS BIGINT) AS name, CAST(i0 + 1 AS BIGINT) AS start_line, end_outer AS end_line,
           CASE WHEN n0 % 4 <> 0 THEN '(a, b=' || n0 || ')' END AS parameters, CASE WHEN n0 % 4 = 0 THEN '(Base)' END AS heritage,
           CASE WHEN n0 % 4 <> 0 THEN 1 + last_points + CASE WHEN n1 % 2 = 1 THEN 2 + inner_points ELSE 0 END END AS complexity, false AS is_method,
           uses_path, uses_js, uses_os, uses_dict
    FROM py_blocks
    UNION ALL
    SELECT doc_id, path, blk, 1, 'function', 'm' || CAST(i0 + 1 AS BIGINT), CAST(i0 + 2 AS BIGINT), end_inner, '(self, c)', NULL,
           CASE WHEN n0 % 4 = 0 THEN 1 + inner_points END, true, uses_path, uses_js, uses_os, false
    FROM py_blocks WHERE n1 % 2 = 0),
py_functions AS (SELECT * FROM py_defs WHERE type = 'function' AND complexity IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM py_bad)),
py_files AS (
    SELECT f.doc_id, f.path, f.loc, bad.doc_id IS NOT NULL AS broken, count(p.name) AS n, coalesce(sum(p.complexity), 0) AS total,
           coalesce(string_agg(p.name || ':' || p.complexity, '|' ORDER BY p.start_line), '') AS functions
    FROM file_loc f LEFT JOIN py_bad bad ON bad.doc_id = f.doc_id LEFT JOIN py_functions p ON p.doc_id = f.doc_id
    WHERE f.ext = '.py' GROUP BY ALL),
py_metrics AS (
    SELECT doc_id, path, loc, CASE WHEN NOT broken THEN n END AS function_count,
           CASE WHEN NOT broken THEN CASE WHEN n > 0 THEN CAST(total AS DOUBLE) / n ELSE 0.0 END END AS cyclomatic_complexity,
           CASE WHEN NOT broken THEN CAST(total AS BIGINT) END AS total_complexity, functions,
           CASE WHEN broken THEN 'Syntax error in ' || path END AS python_metrics_error FROM py_files),
"""
)

# --- JS and TS ground truth -------------------------------------------------------------------

JS = (
    PY
    + """
js AS (SELECT doc_id, path, ext, i, n, total, (i - 3) % 12 AS pos, floor((i - 3) / 12) AS blk FROM code_lines WHERE ext IN ('.js', '.ts') AND i >= 3),
js_points AS (
    SELECT *, blk % 3 = 2 AS in_class,
           CASE pos WHEN 1 THEN CASE WHEN blk % 3 = 2 THEN 0 ELSE 2 END WHEN 2 THEN 1 WHEN 3 THEN 1 WHEN 5 THEN 1 WHEN 7 THEN 2 WHEN 8 THEN 1 WHEN 9 THEN 1 ELSE 0 END AS points FROM js),
js_blocks AS (
    SELECT doc_id, path, ext, blk, in_class, min(i) AS i0, any_value(total - CASE WHEN (total - 4) % 12 = 6 THEN 1 ELSE 0 END) AS total, max(n) FILTER (WHERE pos = 0) AS n0, bool_or(pos = 1) AS has1,
           sum(points) AS points, max(i + 1) FILTER (WHERE pos = 11) AS end0, max(i + 1) FILTER (WHERE pos = 10) AS end1
    FROM js_points GROUP BY ALL),
js_functions AS (
    SELECT doc_id, path, CASE n0 % 3 WHEN 0 THEN 'h' WHEN 1 THEN 'f' ELSE 'g' END || i0 AS name, 1 + points AS complexity,
           i0 + 1 AS line_number, coalesce(end0, total) AS end_line, 'function' AS type,
           CASE WHEN ext = '.ts' AND n0 % 3 = 1 THEN '(a: number, b?: string)' ELSE '(a, b)' END AS parameters
    FROM js_blocks WHERE NOT in_class
    UNION ALL
    SELECT doc_id, path, 'm' || (i0 + 1), 1 + points, i0 + 2, coalesce(end1, total), 'method', '(a, b)' FROM js_blocks WHERE in_class AND has1
    UNION ALL
    SELECT doc_id, path, 'q' || i, 2, i + 1, i + 1, 'function', '(v)' FROM js WHERE pos = 3 AND n % 2 = 1),
js_counts AS (SELECT doc_id, count(*) AS functions FROM js_functions GROUP BY ALL),
js_sums AS (SELECT doc_id, sum(points) AS points FROM js_points GROUP BY ALL),
js_metrics AS (
    SELECT f.doc_id, f.path, f.ext, f.loc, coalesce(c.functions, 0) AS function_count, 1 + coalesce(s.points, 0) AS complexity
    FROM file_loc f LEFT JOIN js_counts c ON c.doc_id = f.doc_id LEFT JOIN js_sums s ON s.doc_id = f.doc_id WHERE f.ext IN ('.js', '.ts')),
all_metrics AS (
    SELECT doc_id, path, 'python' AS language, loc, function_count, cyclomatic_complexity, total_complexity, python_metrics_error FROM py_metrics
    UNION ALL
    SELECT doc_id, path, CASE ext WHEN '.js' THEN 'javascript' ELSE 'typescript' END, loc, function_count, CAST(complexity AS DOUBLE), CAST(complexity AS BIGINT), NULL FROM js_metrics),
"""
)

# --- constructs of all languages ----------------------------------------------------------------

CONSTRUCTS = (
    JS
    + """
typed AS (SELECT doc_id, path, ext, i, n, total - CASE WHEN (total - 4) % 12 = 6 THEN 1 ELSE 0 END AS total, (i - 3) % 12 AS pos, floor((i - 3) / 12) AS blk FROM code_lines WHERE ext IN ('.java', '.cs') AND i >= 3),
typed_blocks AS (SELECT doc_id, blk, max(i + 1) FILTER (WHERE pos = 11) AS end0, max(i + 1) FILTER (WHERE pos = 9) AS end1 FROM typed GROUP BY ALL),
typed_rows AS (SELECT t.*, b.end0, b.end1, CASE ext WHEN '.java' THEN 'java' ELSE 'csharp' END AS language FROM typed t JOIN typed_blocks b ON t.doc_id = b.doc_id AND t.blk = b.blk),
sql_code AS (SELECT doc_id, path, i, n, total, i % 10 AS pos FROM code_lines WHERE ext = '.sql'),
constructs AS (
    SELECT path, 'python' AS language, type, name, start_line, end_line, parameters, heritage FROM py_defs
    UNION ALL
    SELECT f.path, CASE WHEN f.path LIKE '%.ts' THEN 'typescript' ELSE 'javascript' END, type, name, line_number, end_line, parameters, NULL FROM js_functions f
    UNION ALL
    SELECT path, CASE ext WHEN '.ts' THEN 'typescript' ELSE 'javascript' END, 'class', 'K' || i0, i0 + 1, coalesce(end0, total), NULL, 'extends Base' FROM js_blocks WHERE in_class
    UNION ALL
    SELECT path, language, CASE WHEN blk % 3 = 2 THEN 'interface' ELSE 'class' END, CASE WHEN blk % 3 = 2 THEN 'I' ELSE 'K' END || i, i + 1, coalesce(end0, total), NULL,
           CASE WHEN blk % 3 <> 2 THEN CASE language WHEN 'java' THEN 'extends Base' ELSE ': Base' END END FROM typed_rows WHERE pos = 0
    UNION ALL
    SELECT path, language, 'method', 'm' || i, i + 1, coalesce(end1, total), '(int a, int b)', NULL FROM typed_rows WHERE pos = 1
    UNION ALL
    SELECT path, language, 'constructor', 'K' || i, i + 1, i + 1, '(int a)', NULL FROM typed_rows WHERE pos = 10 AND n % 3 = 0
    UNION ALL
    SELECT path, 'sql', 'table', CASE WHEN n % 2 = 0 THEN 't' || i ELSE 'q' || n END, i + 1, CASE WHEN n % 2 = 0 THEN i + 1 ELSE least(i + 2, total) END, NULL, NULL FROM sql_code WHERE pos = 0),
found AS (SELECT path, language, type, name, CAST(start_line AS BIGINT) AS start_line, CAST(end_line AS BIGINT) AS end_line, parameters, heritage, CAST(NULL AS VARCHAR) AS decorators, CAST(end_line - start_line + 1 AS BIGINT) AS line_count FROM constructs),
"""
)


def _add(name: str, sql: str, prefix: str = "") -> None:
    # a trailing comma of the shared part closes here
    ORACLES[name] = (prefix.rstrip().rstrip(",") + "\n" + sql) if prefix else sql


_KEPT = """regexp_matches(path, '^(node_modules/|.*/node_modules/)') OR regexp_matches(path, '^(build/|.*/build/)')
   OR path LIKE 'app/tests/%' OR regexp_matches(path, '(^|/)m[^/]*2\\.js$') OR (starts_with(path, 'src/') AND path LIKE '%.ts')"""
_DEFAULT_OUT = "(starts_with(path, 'node_modules/') OR starts_with(path, 'build/'))"

_add("scan_files", f"SELECT path FROM paths WHERE NOT ({_KEPT})", CODE)
_add(
    "scan_contents",
    f"""SELECT p.path, p.ext, strlen(content) AS size, md5(content) AS content_md5 FROM paths p JOIN (
        SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS content FROM code_lines GROUP BY doc_id) c ON p.doc_id = c.doc_id WHERE NOT ({_KEPT.replace("path", "p.path")})""",
    CODE,
)
_add(
    "exclude_glob",
    """SELECT path, path LIKE 'tests/%' OR path LIKE '%/tests/%' AS recursive, path LIKE 'node_modules/%' AS folder,
       starts_with(path, 'app') AND path LIKE '%.py' AS middle, regexp_matches(path, '(^|/)m[^/]*\\.js$') AS plain,
       starts_with(path, 'node_modules/') OR starts_with(path, 'build/') AS config_default FROM paths""",
    CODE,
)
_add("decode_text", "SELECT doc_id, length(text) + 1 AS chars, md5(text) AS digest FROM documents")
_add("file_lines", "SELECT path, i + 1 AS line_no, line AS text FROM code_lines WHERE NOT (i = total - 1 AND line = '')", CODE)
_add(
    "code_lines",
    "SELECT path, i + 1 AS line_no, line AS text FROM marked_lines WHERE trim(line) <> '' AND NOT starts_with(trim(line), marker)",
    CODE,
)
_add("supported_files", "SELECT path FROM paths WHERE ext IN ('.py', '.js', '.ts')", CODE)
_PARSER = "CASE ext WHEN '.py' THEN 'python' WHEN '.js' THEN 'javascript' WHEN '.ts' THEN 'typescript' WHEN '.java' THEN 'java' WHEN '.cs' THEN 'csharp' ELSE 'sql' END"
_add("lang_supported", f"SELECT path, true AS supported, {_PARSER} AS parser_language FROM paths", CODE)
_add(
    "comment_marker",
    f"""SELECT path, CASE WHEN path LIKE '%.py' THEN '#' WHEN lower(path) LIKE '%.sql' THEN '--' ELSE '//' END AS marker, CAST(NULL AS VARCHAR) AS error FROM (
        SELECT path FROM paths UNION ALL SELECT {_DB_PATH} AS path FROM documents)""",
    CODE,
)
_add(
    "detect_language",
    f"""SELECT path, CASE WHEN ext IN ('.py', '.js', '.ts') THEN {_PARSER} END AS metric_language, {_PARSER} AS parser_language,
        CASE WHEN ext IN ('.cs', '.sql') THEN 'unknown' ELSE {_PARSER} END AS prompt_language FROM paths""",
    CODE,
)
_add(
    "complexity_grade",
    """SELECT CASE WHEN l_quantity <= 5 THEN 'A' WHEN l_quantity <= 10 THEN 'B' WHEN l_quantity <= 20 THEN 'C' WHEN l_quantity <= 30 THEN 'D' ELSE 'F' END AS grade,
       count(*) AS n FROM lineitem GROUP BY 1""",
)
_SEVERITY = "CASE WHEN {x} <= {t} THEN 'none' WHEN {x} <= 1.5 * {t} THEN 'low' WHEN {x} <= 2 * {t} THEN 'medium' WHEN {x} <= 3 * {t} THEN 'high' ELSE 'critical' END"
_add(
    "severity",
    f"SELECT o_orderkey, {_SEVERITY.format(x='floor(o_totalprice)', t=150000)} AS severity FROM orders",
)


def _advice(lines: str, functions: str, complexity: str, language: str) -> str:
    return f"""array_to_string(list_filter([
        CASE WHEN {lines} > 3000 THEN 'Consider splitting into multiple modules' WHEN {lines} > 2000 THEN 'Split into logical components' ELSE 'Extract utility functions to separate file' END,
        CASE WHEN {functions} > 50 THEN 'Group related functions into classes or modules' WHEN {functions} > 30 THEN 'Extract some functions to utility modules' END,
        CASE WHEN {complexity} > 20 THEN 'Reduce complexity by simplifying control flow' WHEN {complexity} > 15 THEN 'Refactor complex functions into smaller ones' END,
        CASE WHEN {lines} > 2000 AND {language} = 'python' THEN 'Create a Python package structure' WHEN {lines} > 2000 AND {language} IN ('javascript', 'typescript') THEN 'Split into ES modules' END,
        CASE WHEN {language} = 'python' THEN 'Consider using dataclasses or Pydantic models' WHEN {language} IN ('javascript', 'typescript') THEN 'Use composition to break down large components' END
        ], lambda x: x IS NOT NULL)[1:3], '|')"""


_add(
    "recommendations",
    f"""SELECT p_partkey, {_advice('lines', 'p_size', 'p_retailprice / 60', 'language')} AS advice
        FROM (SELECT *, p_partkey * 7 % 4000 AS lines, ['python', 'javascript', 'typescript', 'java'][p_size % 4 + 1] AS language FROM part)""",
)
_add(
    "module_path",
    f"""SELECT doc_id, CASE
        WHEN here = there THEN '.t' || doc_id
        WHEN here = '' THEN '.' || replace(there, '/', '.') || '.t' || doc_id
        WHEN starts_with(there, here || '/') THEN '.' || replace(substr(there, length(here) + 2), '/', '.') || '.t' || doc_id
        WHEN there = '' THEN repeat('.', len(string_split(here, '/')) + 1) || 't' || doc_id
        WHEN starts_with(here, there || '/') THEN repeat('.', len(string_split(here, '/')) - len(string_split(there, '/')) + 1) || 't' || doc_id
        ELSE 't' || doc_id END AS module
        FROM (SELECT doc_id, rtrim({_list(CODE_FOLDERS)}[doc_id % 6 + 1], '/') AS here,
              rtrim({_list(CODE_FOLDERS + ['src/a/b/', 'app/'])}[doc_id % 8 + 1], '/') AS there FROM documents)""",
)

# --- metrics --------------------------------------------------------------------------------------

_add("loc", "SELECT path, loc, CAST(NULL AS VARCHAR) AS error FROM file_loc", CODE)
_add(
    "py_function_complexity",
    "SELECT path, name, complexity, start_line AS line_number, end_line AS end_line_number, is_method FROM py_functions",
    PY,
)
_add(
    "py_file_metrics",
    "SELECT path, function_count, cyclomatic_complexity, total_complexity, functions, python_metrics_error FROM py_metrics",
    PY,
)
_add("js_complexity", "SELECT path, complexity FROM js_metrics", JS)
_add("js_function_complexity", "SELECT path, name, complexity, line_number, end_line, type FROM js_functions", JS)
_add("js_function_count", "SELECT path, function_count AS functions FROM js_metrics", JS)
_METRICS = "path, language, loc, function_count, cyclomatic_complexity, total_complexity, python_metrics_error"
_add("file_metrics", f"SELECT {_METRICS} FROM all_metrics", JS)
_add(
    "metrics_batch",
    """SELECT p.path, CASE WHEN m.path IS NULL THEN 'error' ELSE 'success' END AS status,
       CASE WHEN m.path IS NULL THEN 'Unsupported file extension: ' || p.ext || '. Supported: .js, .jsx, .py, .ts, .tsx' END AS error,
       language, loc, function_count, cyclomatic_complexity, total_complexity FROM paths p LEFT JOIN all_metrics m ON m.path = p.path
       UNION ALL SELECT 'gone/m' || doc_id || '.py', 'error', 'File not found: gone/m' || doc_id || '.py', NULL, NULL, NULL, NULL, NULL FROM documents""",
    JS,
)


def _violations(threshold: int, out: str) -> str:
    return f"""SELECT path AS file, language, loc AS lines, coalesce(function_count, 0) AS functions, coalesce(cyclomatic_complexity, 0.0) AS complexity,
        {_SEVERITY.format(x='loc', t=threshold)} AS severity,
        {_advice('loc', 'coalesce(function_count, 0)', 'coalesce(cyclomatic_complexity, 0)', 'language')} AS recommendations
        FROM all_metrics WHERE NOT ({out}) AND loc > {threshold}"""


def _summary(threshold: int, out: str) -> str:
    return f"""SELECT count(*) AS total_files, count(*) AS files_analyzed, count(*) FILTER (WHERE loc > {threshold}) AS files_exceeding_threshold,
        CAST(sum(loc) AS BIGINT) AS total_lines, CAST(round_even(sum(loc) / count(*), 0) AS BIGINT) AS average_file_size
        FROM file_loc WHERE ext IN ('.py', '.js', '.ts') AND NOT ({out})"""


_add("violations", _violations(500, _KEPT), JS)
_add("codebase_summary", _summary(500, _KEPT), CODE)
_add(
    "codebase_report",
    f"""SELECT 'violation' AS section, file, lines, functions, complexity, severity, recommendations FROM ({_violations(1500, _DEFAULT_OUT)})
        UNION ALL SELECT 'summary', '', total_lines, total_files, CAST(average_file_size AS DOUBLE), CAST(files_exceeding_threshold AS VARCHAR), ''
        FROM ({_summary(1500, _DEFAULT_OUT)})""",
    JS,
)
_add(
    "report_json",
    f"""SELECT 'violation' AS section, file, lines, severity, CAST(NULL AS VARCHAR) AS project, split_part(recommendations, '|', 1) AS advice FROM ({_violations(1500, _DEFAULT_OUT)})
        UNION ALL SELECT 'summary', '', total_lines, NULL, 'corpus', NULL FROM ({_summary(1500, _DEFAULT_OUT)})""",
    JS,
)

# --- constructs -----------------------------------------------------------------------------------

_add("constructs", "SELECT * FROM found", CONSTRUCTS)
_NEST = "repeat('(', 40) || n || repeat(')', 40)"
NESTED = (
    WORDS
    + f"""
places AS (SELECT doc_id, 'lib/d' || doc_id || {_list(lt.NESTED_EXTENSIONS)}[doc_id % 3 + 1] AS path, i, n, 4 * i AS l, i % 4 AS k, doc_id % 3 = 0 AS py,
           ['python', 'javascript', 'typescript'][doc_id % 3 + 1] AS language FROM words),
heads AS (
    SELECT *, 'function' AS type, 'f' || i AS name, l + 3 AS start_line, l + 4 AS end_line, '(a, b=''if ' || n || ''',' || chr(10) || '    *, c=' || {_NEST} || ')' AS parameters,
           NULL AS heritage, '@app.route(''/p' || i || ''',' || chr(10) || '    methods=[' || n || '])' AS decorators, 2 AS complexity FROM places WHERE py AND k = 0
    UNION ALL
    SELECT *, 'class', 'K' || i, l + 2, l + 4, NULL, '(Base, key="' || n || '")', NULL, NULL FROM places WHERE py AND k = 1
    UNION ALL
    SELECT *, 'function', 'p' || i, l + 4, l + 4, '(self)', NULL, '@property', 3 FROM places WHERE py AND k = 1
    UNION ALL
    SELECT *, 'function', 'g' || i, l + 1, l + 4, '(' || chr(10) || '    x)', NULL, NULL, 2 FROM places WHERE py AND k = 2
    UNION ALL
    SELECT *, 'function', 'h' || i, l + 2, l + 2, '()', NULL, NULL, 1 FROM places WHERE py AND k = 3
    UNION ALL
    SELECT *, 'function', 'f' || i, l + 1, l + 4, '(a, b = g' || {_NEST} || ',' || chr(10) || '    c)', NULL, NULL, 3 FROM places WHERE NOT py AND k = 0
    UNION ALL
    SELECT *, 'function', 'h' || i, l + 1, l + 3, '(a)', NULL, NULL, 3 FROM places WHERE NOT py AND k = 1
    UNION ALL
    SELECT *, 'class', 'K' || i, l + 1, l + 3, NULL, NULL, NULL, NULL FROM places WHERE NOT py AND k = 2
    UNION ALL
    SELECT *, 'method', 'm' || i, l + 2, l + 2, '(a)', NULL, NULL, 2 FROM places WHERE NOT py AND k = 2
    UNION ALL
    SELECT *, 'function', '<anonymous>', l + 2, l + 4, '(z)', NULL, NULL, 3 FROM places WHERE NOT py AND k = 3),
"""
)
_add("declaration_heads", "SELECT path, language, type, name, start_line, end_line, parameters, heritage, decorators FROM heads", NESTED)
_add("nested_code_complexity", "SELECT path, name, complexity, start_line AS line_number FROM heads WHERE type <> 'class'", NESTED)
_add(
    "nested_code_files",
    """SELECT path, count(complexity) AS function_count,
       CASE WHEN any_value(py) THEN coalesce(sum(complexity), 0) ELSE 1 + coalesce(sum(complexity - 1), 0) END AS total_complexity, CAST(NULL AS VARCHAR) AS python_metrics_error
       FROM heads GROUP BY path""",
    NESTED,
)
_add("constructs_filter_type", "SELECT path, name, start_line FROM found WHERE type = 'method'", CONSTRUCTS)
_add("constructs_filter_language", "SELECT path, name, start_line FROM found WHERE language = 'typescript'", CONSTRUCTS)
_add("constructs_filter_name", "SELECT path, name, start_line FROM found WHERE lower(name) LIKE '%m1%'", CONSTRUCTS)
_add(
    "constructs_filter_functions",
    "SELECT path, type, name, start_line FROM found WHERE type IN ('function', 'method', 'constructor')",
    CONSTRUCTS,
)
_add(
    "constructs_filter_classes",
    "SELECT path, type, name, start_line FROM found WHERE type IN ('class', 'interface', 'struct')",
    CONSTRUCTS,
)
_add(
    "constructs_project",
    """SELECT path, start_line, name, line_count, type || ' ''' || name || ''' at ' || regexp_replace(path, '^.*/', '') || ':' || start_line || ' (' || line_count || ' lines)' AS label,
       name AS json_name FROM found""",
    CONSTRUCTS,
)
_add("constructs_by_file", "SELECT path, count(*) AS constructs, CAST(sum(line_count) AS BIGINT) AS total_lines FROM found GROUP BY path", CONSTRUCTS)
_add(
    "constructs_by_type",
    "SELECT type, count(*) AS constructs, CAST(sum(line_count) AS BIGINT) AS total_lines, max(line_count) AS longest FROM found GROUP BY type",
    CONSTRUCTS,
)
_TEXT = """SELECT f.path, f.name, f.start_line, string_agg(l.line, chr(10) ORDER BY l.i) AS source_text
    FROM found f JOIN code_lines l ON l.path = f.path AND l.i + 1 BETWEEN f.start_line AND f.end_line
    WHERE f.type IN ('function', 'method', 'constructor') {more} GROUP BY f.path, f.name, f.start_line"""
_add("construct_text", _TEXT.format(more=""), CONSTRUCTS)
_add(
    "find_function",
    f"SELECT path, start_line, source_text FROM ({_TEXT.format(more=chr(65) + 'ND f.name = ' + chr(39) + 'f15' + chr(39))})",
    CONSTRUCTS,
)
_add(
    "enclosing_construct",
    """SELECT c.path, c.i + 1 AS line_no,
       CASE WHEN c.i < 3 THEN 0 WHEN (c.i - 3) % 12 BETWEEN 1 AND 8 AND b.n1 % 2 = 0 THEN 2 ELSE 1 END AS depth,
       CASE WHEN c.i < 3 THEN NULL WHEN (c.i - 3) % 12 BETWEEN 1 AND 8 AND b.n1 % 2 = 0 THEN 'm' || CAST(b.i0 + 1 AS BIGINT)
            ELSE CASE WHEN b.n0 % 4 = 0 THEN 'K' ELSE 'f' END || CAST(b.i0 AS BIGINT) END AS name,
       CASE WHEN c.i < 3 THEN NULL WHEN (c.i - 3) % 12 BETWEEN 1 AND 8 AND b.n1 % 2 = 0 THEN 'function' WHEN b.n0 % 4 = 0 THEN 'class' ELSE 'function' END AS type,
       CASE WHEN c.i < 3 THEN NULL WHEN (c.i - 3) % 12 BETWEEN 1 AND 8 AND b.n1 % 2 = 0 THEN b.i0 + 2 ELSE b.i0 + 1 END AS start_line
       FROM code_lines c LEFT JOIN py_blocks b ON b.doc_id = c.doc_id AND c.i >= 3 AND b.blk = floor((c.i - 3) / 12)
       WHERE c.ext = '.py' AND (c.i < 3 OR (c.i - 3) % 12 NOT IN (4, 6, 10))""",
    PY,
)
_add(
    "imports",
    """SELECT c.path, c.i + 1 AS line_no, v.type, v.module, v.symbol, v.alias, v.accessible FROM code_lines c JOIN (VALUES
       (0, 'import', 'os', NULL, NULL, 'os'), (0, 'import', 'json', NULL, 'js', 'js'),
       (1, 'from_import', 'typing', 'Any', NULL, 'Any'), (1, 'from_import', 'typing', 'Dict', 'D', 'D'),
       (2, 'from_import', 'pathlib', 'Path', NULL, 'Path'), (2, 'from_import', 'pathlib', 'PurePath', NULL, 'PurePath')
       ) AS v(line, type, module, symbol, alias, accessible) ON v.line = c.i WHERE c.ext = '.py'""",
    CODE,
)
_add(
    "function_dependencies",
    """SELECT path, name, start_line, module, symbols FROM (
       SELECT path, name, start_line, type, unnest([CASE WHEN uses_path THEN 'pathlib' END, CASE WHEN uses_js THEN 'json' END, CASE WHEN uses_os THEN 'os' END, CASE WHEN uses_dict THEN 'typing' END]) AS module,
       unnest(['Path', NULL, NULL, 'Dict']) AS symbols FROM py_defs) WHERE type = 'function' AND module IS NOT NULL""",
    PY,
)

# --- database files ---------------------------------------------------------------------------------

_DB = DB_TEXT
_IS_SQL = "lower(path) LIKE '%.sql'"
_IN_DIR = "path LIKE '%/migrations/%' OR path LIKE 'alembic/%'"
_NAMED = "regexp_matches(regexp_replace(path, '^.*/', ''), '^(\\d{4}_\\d{2}_\\d{2}_.*|migration_\\d+|.*_migration|\\d+_.*|[a-f0-9]{12}_.*)\\.py$')"
_add("db_path_checks", f"SELECT path, {_IS_SQL} AS is_sql, {_IN_DIR} AS in_migration_dir, {_NAMED} AS migration_name FROM db_text", _DB)
_add("db_sql_files", f"SELECT path FROM db_text WHERE {_IS_SQL}", _DB)
_add("db_in_migration_dir", f"SELECT path FROM db_text WHERE {_IN_DIR}", _DB)
_add("db_migration_name", f"SELECT path FROM db_text WHERE {_NAMED}", _DB)


def _hits(name: str) -> str:
    return " + ".join("CAST(regexp_matches(content, '" + p + "') AS INT)" for p in fv.ORM_PATTERNS[name])


_ORM = " ".join(f"WHEN {_hits(name)} >= 2 THEN '{name}'" for name in fv.ORM_PATTERNS)
_ORM = f"CASE {_ORM} END"
_TYPE = f"""CASE WHEN {_IS_SQL} THEN 'sql_file' WHEN path NOT LIKE '%.py' THEN 'unknown'
    WHEN ({_IN_DIR} OR {_NAMED}) THEN CASE WHEN lower(content) LIKE '%alembic%' THEN 'alembic_migration' WHEN contains(content, 'flask_migrate') THEN 'flask_migrate' ELSE 'migration_file' END
    WHEN {_ORM} = 'django' THEN 'django_model' WHEN {_ORM} IS NOT NULL THEN 'sqlalchemy_model' ELSE 'unknown' END"""
_add("orm_type", f"SELECT path, {_ORM} AS orm FROM db_text", _DB)
_add("db_file_type", f"SELECT path, {_TYPE} AS file_type FROM db_text", _DB)
_add("db_files", f"SELECT path FROM db_text WHERE {_TYPE} <> 'unknown'", _DB)

_NAMES = " UNION ALL ".join(
    "SELECT path, unnest(regexp_extract_all(content, '" + lead + "([`\"'']?\\w+[`\"'']?)', 1, 'i')) AS name FROM sql_text"
    for lead in fv.SQL_TABLE_LEADS
)
_add(
    "sql_tables",
    f"""SELECT t.path, coalesce(n.tables, '') AS tables FROM sql_text t LEFT JOIN (
        SELECT path, string_agg(DISTINCT trim(name, '`"'''), '|' ORDER BY trim(name, '`"''')) AS tables FROM ({_NAMES}) GROUP BY path) n ON n.path = t.path""",
    SQL_TEXT,
)
_KINDS = [f"CASE WHEN regexp_matches(content, '{p}', 'i') THEN '{k}' END" for k, p in fv.SQL_STATEMENTS.items()]
_KINDS_LIST = f"list_filter([{', '.join(_KINDS)}], lambda x: x IS NOT NULL)"
_COUNT = lambda word: f"len(regexp_extract_all(content, '\\b{word}\\b', 0, 'i'))"
_COMPLEXITY = (
    f"2 * len({_KINDS_LIST}) + 3 * {_COUNT('JOIN')} + 3 * {_COUNT('UNION')} + {_COUNT('WHERE')} + "
    "CASE WHEN regexp_matches(content, 'SELECT.*FROM.*\\(.*SELECT', 'is') THEN 5 ELSE 0 END"
)
_add("sql_statement_types", f"SELECT path, array_to_string({_KINDS_LIST}, '|') AS kinds FROM sql_text", SQL_TEXT)
_add("sql_complexity", f"SELECT path, {_COMPLEXITY} AS complexity FROM sql_text", SQL_TEXT)
_add(
    "sql_file_analysis",
    f"""SELECT t.path, 'sql' AS file_type, coalesce(n.k, 0) AS tables, array_to_string({_KINDS_LIST}, '|') AS statements, {_COMPLEXITY} AS complexity,
        len(string_split(content, chr(10))) - CASE WHEN content = '' OR content LIKE '%' || chr(10) THEN 1 ELSE 0 END AS line_count, CAST(NULL AS VARCHAR) AS error
        FROM sql_text t LEFT JOIN (SELECT path, count(DISTINCT trim(name, '`"''')) AS k FROM ({_NAMES}) GROUP BY path) n ON n.path = t.path""",
    SQL_TEXT,
)
_add(
    "orm_models",
    f"""SELECT path, CASE orm WHEN 'django' THEN 'django_model' WHEN 'sqlalchemy' THEN 'sqlalchemy_model' WHEN 'flask_sqlalchemy' THEN 'sqlalchemy_model' ELSE 'orm_model' END AS file_type,
        CASE orm WHEN 'django' THEN 'django' WHEN 'sqlalchemy' THEN 'sqlalchemy' WHEN 'flask_sqlalchemy' THEN 'sqlalchemy' ELSE 'unknown' END AS orm_type,
        array_to_string(m, '|') AS models, CASE WHEN orm LIKE '%sqlalchemy' THEN array_to_string(regexp_extract_all(content, '__tablename__\\s*=\\s*["''](\\w+)["'']', 1), '|') END AS tables,
        len(m) AS model_count FROM (SELECT *, CASE WHEN orm = 'django' THEN regexp_extract_all(content, 'class\\s+(\\w+)\\s*\\(\\s*models\\.Model\\s*\\)', 1)
        WHEN orm IS NOT NULL THEN regexp_extract_all(content, 'class\\s+(\\w+)\\s*\\(\\s*Base\\s*\\)', 1) ELSE [] END AS m FROM (SELECT *, {_ORM} AS orm FROM db_text))""",
    _DB,
)
_KIND = """CASE WHEN contains(content, 'django.db') AND contains(content, 'migrations') THEN 'django_migration' WHEN lower(content) LIKE '%alembic%' THEN 'alembic_migration' ELSE 'migration' END"""


def _present(names: list[str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN contains(content, '{n}') THEN '{n}' END" for n in names) + "], lambda x: x IS NOT NULL)"


_OPS = f"CASE {_KIND} WHEN 'django_migration' THEN {_present(fv.DJANGO_OPERATIONS)} WHEN 'alembic_migration' THEN {_present(fv.ALEMBIC_OPERATIONS)} ELSE [] END"
_add(
    "migration_ops",
    f"""SELECT path, {_KIND} AS file_type, array_to_string({_OPS}, '|') AS operations,
        CASE WHEN {_KIND} = 'django_migration' THEN '(''app' || doc_id || '''|''0001_initial'')|("core"|"m' || doc_id || '")' END AS dependencies FROM db_text""",
    _DB,
)
_add(
    "migration_revision",
    "SELECT path, 'r' || doc_id AS revision, 'r' || (doc_id - 8) AS down_revision FROM db_text WHERE kind = 4",
    _DB,
)
_add(
    "migration_edges",
    """SELECT path, doc_id || '_auto' AS child, unnest(['app' || doc_id || '.0001_initial', 'core.m' || doc_id]) AS parent FROM db_text WHERE kind = 3
       UNION ALL SELECT path, 'r' || doc_id, 'r' || (doc_id - 8) FROM db_text WHERE kind = 4""",
    _DB,
)
_add(
    "revision_parents",
    """SELECT a.path, 'r' || a.doc_id AS revision, 'r' || (a.doc_id - 8) AS down_revision, b.path AS parent_path, CASE WHEN b.path IS NULL THEN 0 ELSE 1 END AS candidates, CASE WHEN b.path IS NULL THEN 'missing' ELSE 'linked' END AS link
       FROM db_text a LEFT JOIN db_text b ON b.doc_id = a.doc_id - 8 WHERE a.kind = 4""",
    _DB,
)
_add(
    "revision_chains",
    """SELECT path, first_value(path) OVER w AS first_path, (doc_id - first_value(doc_id) OVER w) // 8 AS steps, 'missing' AS ends
       FROM (SELECT *, doc_id - 8 * row_number() OVER (ORDER BY doc_id) AS island FROM db_text WHERE kind = 4) WINDOW w AS (PARTITION BY island ORDER BY doc_id)""",
    _DB,
)
_add(
    "db_analysis",
    f"""SELECT path, CASE WHEN t = 'sql_file' THEN 'sql' WHEN t IN ('django_model', 'sqlalchemy_model') THEN t ELSE {_KIND} END AS file_type,
        CASE WHEN t = 'sql_file' THEN {_COMPLEXITY} END AS complexity,
        CASE t WHEN 'django_model' THEN len(regexp_extract_all(content, 'class\\s+(\\w+)\\s*\\(\\s*models\\.Model\\s*\\)', 1)) WHEN 'sqlalchemy_model' THEN len(regexp_extract_all(content, 'class\\s+(\\w+)\\s*\\(\\s*Base\\s*\\)', 1)) END AS model_count,
        CASE WHEN t IN ('migration_file', 'alembic_migration', 'flask_migrate') THEN array_to_string({_OPS}, '|') END AS operations
        FROM (SELECT *, {_TYPE} AS t FROM db_text) WHERE t <> 'unknown'""",
    _DB,
)

# --- migrations ---------------------------------------------------------------------------------------

_add("sql_statements", "SELECT path, n, statement FROM statements", SQL_TEXT)


def _sql_parts(size: int) -> str:
    return f"""(SELECT doc_id, path, CAST(floor((n - 1) / {size}) + 1 AS BIGINT) AS part, count(*) AS statements, string_agg(statement, chr(10) || chr(10) ORDER BY n) AS out_content
        FROM statements WHERE doc_id IN (SELECT doc_id FROM statements GROUP BY doc_id HAVING count(*) > {size}) GROUP BY ALL)"""


_OUT = "'db/s' || doc_id || '_part' || part || '.sql'"
_add("split_sql_migration", f"SELECT path, part, statements, {_OUT} AS out_path, out_content FROM {_sql_parts(5)}", SQL_TEXT)

# one Django operation per word of the kind-3 documents
DJANGO = (
    SQL_TEXT
    + """
ops AS (SELECT doc_id, 'app/migrations/' || doc_id || '_auto.py' AS path, i + 1 AS n, total,
        CASE n % 4 WHEN 0 THEN 'migrations.CreateModel(' || chr(10) || '            name=''M' || i || ''',' || chr(10) || '            fields=[(''id'', ' || n || '), ],' || chr(10) || '        ),'
        WHEN 1 THEN 'migrations.AddField(''m'', ''f' || i || ''', ' || n || '),'
        WHEN 2 THEN 'migrations.AlterField(' || chr(10) || '            ''m'', ''g' || i || ''', ' || n || '),'
        ELSE 'migrations.RunPython(fn' || i || '),' END AS operation FROM words WHERE doc_id % 8 = 3),
"""
)


def _django_parts(size: int) -> str:
    return f"""(SELECT *, 'app/migrations/' || doc_id || '_auto_part' || part || '.py' AS out_path,
        CASE WHEN part = 1 THEN '(''app' || doc_id || ''', ''0001_initial'')' ELSE '(''migrations'', ''' || doc_id || '_auto_part' || (part - 1) || ''')' END AS depends_on FROM (
        SELECT doc_id, path, CAST(floor((n - 1) / {size}) + 1 AS BIGINT) AS part, count(*) AS operations, string_agg(operation, ',' || chr(10) ORDER BY n) AS body FROM ops WHERE total > {size} GROUP BY ALL))"""


_DJANGO_TEXT = """'from django.db import migrations, models' || chr(10) || chr(10) || 'class Migration(migrations.Migration):' || chr(10) || '    \"\"\"' || chr(10) || '    ' || doc_id || '_auto - Part ' || part
    || chr(10) || '    \"\"\"' || chr(10) || '    ' || chr(10) || '    dependencies = [' || chr(10) || '        ' || depends_on || chr(10) || '    ]' || chr(10) || '    ' || chr(10) || '    operations = [' || chr(10) || body || chr(10) || '    ]'"""
_add("django_operations", "SELECT path, n, operation FROM ops", DJANGO)
_add(
    "split_django_migration",
    f"SELECT path, part, operations, out_path, depends_on, {_DJANGO_TEXT} AS out_content FROM {_django_parts(5)}",
    DJANGO,
)
_add(
    "split_sql_files",
    f"SELECT {_OUT} AS out_path, out_content FROM {_sql_parts(20)} UNION ALL SELECT out_path, {_DJANGO_TEXT} FROM {_django_parts(20)}",
    DJANGO,
)
_add(
    "django_rollback",
    f"""SELECT path, row_number() OVER (PARTITION BY path ORDER BY part DESC) AS step, 'python manage.py migrate migrations ' || doc_id || '_auto_part' || part || ' --fake-initial' AS command
        FROM {_django_parts(5)}""",
    DJANGO,
)
_add(
    "migration_chain",
    f"""SELECT path, part, out_path, depends_on FROM {_django_parts(5)}
        UNION ALL SELECT path, part, {_OUT}, NULL FROM {_sql_parts(5)}""",
    DJANGO,
)
_add(
    "sql_rollback",
    """SELECT t.path, coalesce(r.k, 0) AS statements, coalesce(r.rollback, '') AS rollback FROM sql_text t LEFT JOIN (
       SELECT path, count(*) AS k, string_agg(undo, chr(10) || chr(10) ORDER BY n DESC) AS rollback FROM (
       SELECT path, n, CASE WHEN contains(upper(statement), 'CREATE TABLE') THEN 'DROP TABLE IF EXISTS ' || nullif(regexp_extract(statement, 'CREATE\\s+TABLE\\s+(\\w+)', 1, 'i'), '') || ';'
       WHEN contains(upper(statement), 'ALTER TABLE') AND contains(upper(statement), 'ADD COLUMN')
       THEN 'ALTER TABLE ' || regexp_extract(statement, 'ALTER\\s+TABLE\\s+(\\w+)\\s+ADD\\s+COLUMN\\s+(\\w+)', 1, 'i') || ' DROP COLUMN ' || regexp_extract(statement, 'ALTER\\s+TABLE\\s+(\\w+)\\s+ADD\\s+COLUMN\\s+(\\w+)', 2, 'i') || ';' END AS undo
       FROM statements) GROUP BY path) r ON r.path = t.path""",
    SQL_TEXT,
)
_DB_PART = DB_TEXT.replace(WORDS, "")
_add(
    "split_dispatch",
    f"""SELECT path, CASE kind WHEN 3 THEN 'django' WHEN 4 THEN 'alembic' WHEN 0 THEN CASE WHEN contains(content, 'migrations') THEN 'django' END END AS kind,
        CASE kind WHEN 3 THEN ceil(total / 5) WHEN 4 THEN 1 END AS split_files,
        CASE WHEN kind = 4 THEN 'Alembic migration splitting not yet implemented' WHEN kind = 3 AND total <= 5 THEN 'Migration does not need splitting' END AS message,
        CASE WHEN kind NOT IN (3, 4) THEN 'Unsupported migration type for file: ' || path END AS error FROM db_text
        UNION ALL SELECT t.path, 'sql', greatest(ceil(coalesce(k, 0) / 5), 1), CASE WHEN coalesce(k, 0) <= 5 THEN 'SQL migration does not need splitting' END, NULL
        FROM sql_text t LEFT JOIN (SELECT path, count(*) AS k FROM statements GROUP BY path) s ON s.path = t.path""",
    SQL_TEXT.rstrip() + _DB_PART,
)
_add(
    "extract_query",
    """SELECT path, CASE WHEN q IS NOT NULL THEN 'view_report_users_v2' END AS view_name, q AS query, CASE WHEN q IS NOT NULL THEN 'database/views/view_report_users_v2.sql' END AS view_path,
       '-- View: view_report_users_v2' || chr(10) || chr(10) || 'CREATE OR REPLACE VIEW view_report_users_v2 AS' || chr(10) || q || ';' || chr(10) AS view_content,
       CASE WHEN q IS NOT NULL THEN regexp_replace(path, '\\.py$', '_modified.py') END AS modified_path,
       md5(replace(content, q, 'SELECT * FROM view_report_users_v2')) AS modified_content,
       '-- Rollback script for view: view_report_users_v2' || chr(10) || chr(10) || 'DROP VIEW IF EXISTS view_report_users_v2;' || chr(10) || chr(10) || '-- Original query:' || chr(10) || '-- ' || q || chr(10) AS rollback,
       CASE WHEN q IS NULL THEN 'Could not find query identified by: Report-Users.v2' END AS error
       FROM (SELECT *, nullif(trim(regexp_extract(content, '["'']+(SELECT[^"'']*)["'']', 1, 'is')), '') AS q FROM db_text)""",
    _DB,
)

# --- diffs ------------------------------------------------------------------------------------------------

HUNKS = (
    CODE
    + """
diff_paths AS (SELECT doc_id, doc_id % 9 AS kind, CASE WHEN doc_id % 9 = 6 THEN 'gone/' || path ELSE path END AS path FROM paths),
hunk_words AS (SELECT w.doc_id, p.path, p.kind, i, n, total, CAST(floor(i / 10) AS BIGINT) AS k, count(*) OVER (PARTITION BY w.doc_id) AS hunks
               FROM words w JOIN diff_paths p ON p.doc_id = w.doc_id WHERE i % 10 = 1 AND kind NOT IN (4, 5)),
"""
)
_add(
    "diff_hunks",
    """SELECT path, CASE WHEN kind = 7 THEN hunks - k ELSE k + 1 END AS hunk_no, i + 1 AS old_start, 2 AS old_count, i + 1 AS new_start, 3 AS new_count, 2 AS added, 1 AS removed, 1 AS context, CAST(NULL AS VARCHAR) AS error FROM hunk_words
       UNION ALL SELECT path, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'No valid hunks found in diff' FROM diff_paths WHERE doc_id NOT IN (SELECT doc_id FROM hunk_words)""",
    HUNKS,
)
# hunks listed backwards are applied front to back, so each starts one line earlier in the original
_add(
    "apply_patches",
    """, places AS (SELECT *, CASE WHEN kind = 7 THEN 9 * k + 1 ELSE 10 * k + 1 END AS place FROM hunk_words),
       kept AS (SELECT c.doc_id, c.i, 1 AS sub, c.line || CASE WHEN c.i < c.total - 1 THEN chr(10) ELSE '' END AS piece FROM code_lines c
                WHERE NOT EXISTS (SELECT 1 FROM places p WHERE p.doc_id = c.doc_id AND c.i BETWEEN p.place AND p.place + 1)),
       pieces AS (SELECT * FROM kept UNION ALL
                  SELECT doc_id, place, 0, 'ctx' || n || chr(10) || 'new' || n || chr(10) || 'more' || chr(10) FROM places),
       texts AS (SELECT doc_id, string_agg(piece, '' ORDER BY i, sub) AS patched FROM pieces GROUP BY doc_id),
       checked AS (SELECT d.path, t.patched, CASE WHEN d.kind = 5 THEN 'apply_diff operation requires ''diff'' parameter' WHEN d.kind = 6 THEN 'File not found: ' || d.path
                   WHEN d.doc_id NOT IN (SELECT doc_id FROM hunk_words) THEN 'No valid hunks found in diff' END AS error FROM diff_paths d LEFT JOIN texts t ON t.doc_id = d.doc_id)
       SELECT path, CASE WHEN error IS NULL THEN 'success' ELSE 'error' END AS status, CASE WHEN error IS NULL THEN md5(patched) END AS digest,
       CASE WHEN error IS NULL THEN length(patched) END AS chars, error FROM checked""",
    HUNKS,
)

# --- suggestions ------------------------------------------------------------------------------------------

SUGGESTIONS = f"""
WITH suggestions AS (SELECT 's' || o_orderkey AS id, 'src/f' || o_custkey || '.py' AS file_path, {bl.SUGGESTION_STATUS} AS status, o_orderdate AS created_at, o_orderkey AS k,
    {bl.SUGGESTION_DATA} AS data, o_orderpriority FROM orders),
listed AS (SELECT *, CASE k % 7 WHEN 4 THEN substr(repeat('Split ' || o_orderpriority || ' ', 12), 1, 100) WHEN 5 THEN 'D' || k ELSE 'No summary available' END AS summary FROM suggestions),
"""
_TS = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f')"
_add(
    "suggestions_list",
    f"SELECT id, file_path, status, {_TS.format('created_at')} AS created_at, summary FROM (SELECT * FROM listed WHERE status = 'pending' ORDER BY created_at DESC, id LIMIT 10)",
    SUGGESTIONS,
)
_add("suggestions_filtered", "SELECT id, file_path, summary FROM listed WHERE status = 'approved'", SUGGESTIONS)
_add(
    "suggestion_preview",
    """SELECT id, CASE WHEN k % 7 IN (4, 6) THEN 'dry_run' ELSE 'error' END AS status, CASE k % 7 WHEN 4 THEN '@@ -1 +1 @@' WHEN 6 THEN 'd' || k END AS diff_preview,
       CASE k % 7 WHEN 0 THEN 'suggestion_json must contain at least one suggestion' WHEN 1 THEN 'suggestion_json must contain at least one suggestion' WHEN 2 THEN 'Invalid JSON in suggestion_json' WHEN 3 THEN 'Invalid JSON in suggestion_json'
       WHEN 4 THEN 'Dry run complete. Would apply: T' || k WHEN 5 THEN 'Suggestion must contain a ''diff'' field' ELSE 'Dry run complete. Would apply: Refactoring' END AS message FROM suggestions""",
    SUGGESTIONS,
)
_add(
    "suggestion_lookup",
    "SELECT a.id, file_path, status, s.id IS NOT NULL AS found FROM (SELECT DISTINCT 's' || (l_orderkey * 2) AS id FROM lineitem) a LEFT JOIN suggestions s ON s.id = a.id",
    SUGGESTIONS,
)
_add(
    "suggestions_ingest",
    """SELECT file_path, CASE WHEN k % 7 NOT IN (2, 3) THEN 'pending' END AS status, CASE WHEN k % 7 NOT IN (2, 3) THEN '{}' END AS metadata,
       CASE WHEN k % 7 IN (2, 3) THEN 'suggestion_data must be a dictionary' END AS error FROM suggestions""",
    SUGGESTIONS,
)
_add("suggestion_id_dups", "SELECT 'f' || o_custkey || '.py' AS id, count(*) AS copies FROM orders GROUP BY 1 HAVING count(*) > 1")
_add(
    "suggestion_stats_status",
    "SELECT v.status, count(s.id) AS suggestions FROM (VALUES ('pending'), ('approved'), ('rejected'), ('executed'), ('failed')) v(status) LEFT JOIN suggestions s ON s.status = v.status GROUP BY 1",
    SUGGESTIONS,
)
_add("suggestion_stats_file", "SELECT file_path, count(*) AS suggestions FROM suggestions GROUP BY 1", SUGGESTIONS)
_OLD = "floor((epoch_us(TIMESTAMP '2001-09-01') - epoch_us(created_at)) / 86400000000) >= 900"
_add("suggestions_expired", f"SELECT id, file_path FROM suggestions WHERE status = 'rejected' AND {_OLD}", SUGGESTIONS)
_add(
    "suggestions_cleared",
    f"SELECT 'all' AS part, count(*) AS n FROM suggestions UNION ALL SELECT 'kept', count(*) FROM suggestions WHERE NOT ({_OLD})",
    SUGGESTIONS,
)

EVENTS = f"""
WITH ev AS (SELECT 's' || user_id AS id, event_id, ts, {bl.EVENT_STATUS} AS status, CASE WHEN event_type IN ('purchase', 'error') THEN 'r' || event_id END AS execution_result,
    CASE WHEN event_type = 'click' AND event_id % 2 = 0 THEN 'why' || event_id END AS reason FROM events),
"""
_add(
    "suggestions_current",
    f"""SELECT id, arg_max(status, (ts, event_id)) AS status, {_TS.format('min(ts)')} AS created_at, {_TS.format('max(ts)')} AS updated_at,
        arg_max(execution_result, (ts, event_id)) FILTER (WHERE execution_result IS NOT NULL) AS execution_result,
        arg_max(reason, (ts, event_id)) FILTER (WHERE reason IS NOT NULL) AS rejection_reason, count(*) AS events FROM ev GROUP BY id""",
    EVENTS,
)
_add(
    "suggestions_deleted",
    """SELECT id, arg_max(status, (ts, event_id)) AS status FROM ev WHERE id NOT IN (SELECT id FROM ev WHERE status = 'rejected' AND event_id % 50 = 0) GROUP BY id""",
    EVENTS,
)
_add(
    "suggestion_transitions",
    f"""SELECT id, event_id, {_TS.format('ts')} AS ts, status AS requested, refused, CASE WHEN refused THEN 'Suggestion ' || id || ' has already been approved or executed' END AS error FROM (
        SELECT *, status IN ('approved', 'executed', 'failed') AND coalesce(decided, '') IN ('approved', 'executed') AS refused FROM (
        SELECT *, last_value(CASE WHEN status <> 'failed' THEN status END IGNORE NULLS) OVER (PARTITION BY id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS decided FROM ev))""",
    EVENTS,
)
_add(
    "suggestions_apply_results",
    """SELECT id, status AS before, CASE WHEN NOT asked OR refused THEN status WHEN dry THEN 'approved' WHEN outcome = 'success' THEN 'executed' ELSE 'failed' END AS after,
       CASE WHEN asked AND NOT refused AND NOT dry THEN outcome END AS execution_result, CASE WHEN refused THEN 'Suggestion ' || id || ' has already been ' || status END AS error FROM (
       SELECT s.id, s.status, o.o_custkey % 3 <> 0 AS asked, o.o_custkey % 3 <> 0 AND s.status IN ('executed', 'approved') AS refused, o.o_custkey % 5 = 0 AS dry,
       CASE WHEN o_orderstatus = 'F' THEN 'success' ELSE 'error' END AS outcome FROM suggestions s JOIN orders o ON o.o_orderkey = s.k)""",
    SUGGESTIONS,
)

# --- operations -------------------------------------------------------------------------------------------

OPERATIONS = f"""
WITH ops AS (SELECT event_id, value, ts, event_type AS operation_type, strftime(ts, '%Y%m%d%H%M%S%f') AS operation_id, {_TS.format('ts')} AS timestamp, 'backup-' || strftime(ts, '%Y%m%d%H%M%S') AS backup_branch,
    md5(CAST(event_id AS VARCHAR)) AS commit_before, CASE WHEN event_id % 4 <> 0 THEN md5('a' || event_id) END AS commit_after, 'src/u' || user_id || '.py' AS files_modified,
    CASE WHEN event_id % 3 = 0 THEN 'new/e' || event_id || '.py' ELSE '' END AS files_created, CASE WHEN event_id % 2 = 0 THEN props END AS details, event_type = 'error' AS rolled_back FROM events),
branches AS (SELECT DISTINCT backup_branch FROM ops WHERE event_id % 4 <> 0),
"""
_OP = "operation_id, operation_type, timestamp, backup_branch, commit_before, commit_after, files_modified, files_created"
_add("operations_ingest", f"SELECT {_OP}, coalesce(details, '{{}}') AS operation_details, false AS rolled_back FROM ops", OPERATIONS)
_add(
    "operation_ids",
    "SELECT event_id, operation_id, replace(backup_branch, 'backup', 'save') AS branch, substr(commit_before, 1, 7) AS short FROM ops",
    OPERATIONS,
)
_add(
    "operations_list",
    "SELECT operation_id, operation_type, timestamp FROM ops WHERE NOT rolled_back ORDER BY ts DESC, operation_id LIMIT 10",
    OPERATIONS,
)
_add(
    "operations_status",
    f"SELECT {_OP}, CASE WHEN rolled_back THEN 'rolled_back' ELSE 'success' END AS status, rolled_back, details AS operation_details FROM ops",
    OPERATIONS,
)
_add(
    "operation_lookup",
    "SELECT operation_id, operation_type, true AS found FROM ops UNION ALL SELECT 'none-' || event_id, NULL, false FROM ops",
    OPERATIONS,
)
_add(
    "operations_missing_backup",
    "SELECT operation_id, backup_branch FROM ops WHERE backup_branch NOT IN (SELECT backup_branch FROM branches)",
    OPERATIONS,
)
_add(
    "rollback_effects",
    """SELECT oid AS operation_id, CASE WHEN refusal IS NULL THEN 'success' ELSE 'error' END AS status, coalesce(refusal, 'Successfully rolled back operation ''' || oid || '''') AS message,
       CASE WHEN event_id % 7 = 0 THEN 'operation_not_found' WHEN refusal IS NOT NULL THEN 'rollback_failed' END AS error, CASE WHEN refusal IS NULL THEN backup_branch END AS restored_branch,
       CASE WHEN refusal IS NULL THEN files_modified || CASE WHEN files_created <> '' THEN '|' || files_created ELSE '' END END AS files_affected FROM (
       SELECT *, CASE WHEN event_id % 7 = 0 THEN 'Operation ID ''' || oid || ''' not found in history' WHEN rolled_back THEN 'Operation ''' || oid || ''' has already been rolled back'
       WHEN backup_branch NOT IN (SELECT backup_branch FROM branches) THEN 'Backup branch ''' || backup_branch || ''' no longer exists. Cannot perform rollback.' END AS refusal FROM (
       SELECT *, CASE WHEN event_id % 7 = 0 THEN 'none-' || event_id ELSE operation_id END AS oid FROM ops))""",
    OPERATIONS,
)
_add(
    "operations_rolled_back",
    f"""SELECT operation_id, operation_type IN ('error', 'click') AS rolled_back, CASE WHEN operation_type = 'click' THEN {_TS.format('ts + INTERVAL 1 HOUR')} END AS rollback_timestamp FROM ops""",
    OPERATIONS,
)
_add(
    "execution_outcome",
    """SELECT operation_id, CASE operation_type WHEN 'view' THEN 'error' WHEN 'click' THEN 'unknown' ELSE CASE WHEN value > 100 THEN 'rolled_back' ELSE 'success' END END AS status,
       CASE WHEN operation_type NOT IN ('view', 'click') THEN value <= 100 END AS tests_passed, operation_type NOT IN ('view', 'click') AND value > 100 AS rolled_back,
       CASE WHEN operation_type = 'view' THEN 'Refactoring failed: no repository' WHEN operation_type = 'click' THEN NULL WHEN value > 100
       THEN 'Refactoring applied but tests failed. Changes have been automatically rolled back. Test output: ' || substr(repeat(commit_before || ' ', 9), 1, 200)
       ELSE 'Refactoring ''' || operation_type || ''' applied successfully. All tests passed.' END AS message FROM ops""",
    OPERATIONS,
)

# --- configuration, prompts, requests -----------------------------------------------------------------------

_add(
    "nearest_config",
    """SELECT 'team' || doc_id % 10 || '/proj' || doc_id % 50 || '/src/m' || doc_id || '.py' AS path,
       CASE WHEN doc_id % 50 IN (SELECT n_nationkey FROM nation) THEN 'team' || doc_id % 10 || '/proj' || doc_id % 50 || '/config.json'
            WHEN doc_id % 10 IN (SELECT r_regionkey FROM region) THEN 'team' || doc_id % 10 || '/config.json' END AS project_config, '~/.config.json' AS home_config FROM documents""",
)
_BASE = " UNION ALL ".join(
    f"SELECT 'c' || c_custkey AS scope, -1 AS precedence, '{k}' AS key_path, {v} AS value FROM customer" for k, v in bl.BASE_LAYER.items()
)
LAYERS = f"""
WITH layers AS (SELECT * FROM ({_BASE}) WHERE value IS NOT NULL
    UNION ALL SELECT 'c' || o_custkey, o_orderkey, {bl.LAYER_KEY}, {bl.LAYER_VALUE} FROM orders),
merged AS (SELECT * FROM layers a WHERE NOT EXISTS (SELECT 1 FROM layers b WHERE b.scope = a.scope AND b.precedence > a.precedence
    AND (b.key_path = a.key_path OR starts_with(b.key_path, a.key_path || '.') OR starts_with(a.key_path, b.key_path || '.')))),
"""
_add("config_merge", "SELECT scope, key_path, value, precedence FROM merged", LAYERS)
_add(
    "config_document",
    "SELECT scope, string_agg(key_path, '|' ORDER BY key_path) AS keys, max(value) FILTER (WHERE key_path = 'thresholds.maxLines') AS max_lines FROM merged GROUP BY scope",
    LAYERS,
)
_add(
    "config_violations",
    """SELECT scope, key_path, value, problem, replace(key_path, '.', ' -> ') || ': ' || problem AS text FROM (SELECT *, CASE
       WHEN key_path = 'thresholds.maxLines' AND (CAST(value AS INT) < 1 OR CAST(value AS INT) > 10000) THEN 'must lie between 1 and 10000'
       WHEN key_path = 'thresholds.maxFunctions' AND value = 'many' THEN 'not a number'
       WHEN key_path = 'ai.provider' AND value = 'other' THEN 'Provider must be one of openai, anthropic, google, local'
       WHEN key_path = 'languages.python.parser' AND value = 'magic' THEN 'Parser must be one of ast, tree-sitter, regex'
       WHEN key_path = 'version' AND value = '2.x' THEN 'Version must be in format ''X.Y'''
       WHEN key_path IN ('ai', 'safety') THEN 'must be an object' WHEN key_path = 'thresholds.bogus' THEN 'Extra inputs are not permitted' END AS problem FROM merged) WHERE problem IS NOT NULL""",
    LAYERS,
)
_add(
    "test_command",
    """SELECT 'c' || c_custkey AS scope, 'python' AS language, CASE c_nationkey % 3 WHEN 0 THEN 'pytest' WHEN 2 THEN 'tox' END AS test_command,
       CASE WHEN c_nationkey % 3 = 1 THEN 'No test command configured for language: python' END AS error FROM customer
       UNION ALL SELECT 'c' || c_custkey, 'java', NULL, 'No test command configured for language: java' FROM customer""",
)
_ADVICE = "CASE strategy " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fv.STRATEGY_TEXT.items()) + " END"
_PROMPT_END = (
    "Give up to 3 suggestions, each with a title, an explanation, a priority (high/medium/low), the expected impact, a unified diff and the reason."
)
_add(
    "render_prompts",
    f"""SELECT path, language, strategy, md5('Review the following ' || language || ' code and propose refactorings.' || chr(10) || chr(10) || 'FILE: ' || path || chr(10) || 'STRATEGY: ' || strategy || chr(10) || chr(10)
        || CASE WHEN loc IS NOT NULL THEN 'METRICS:' || chr(10) || '- Lines of Code: ' || loc || chr(10) || '- Function Count: ' || coalesce(CAST(function_count AS VARCHAR), 'N/A') || chr(10)
        || '- Cyclomatic Complexity: ' || coalesce(CAST(floor(cyclomatic_complexity * 100) / 100 AS VARCHAR), 'N/A') || chr(10) || chr(10) ELSE '' END
        || 'CODE:' || chr(10) || '```' || language || chr(10) || content || chr(10) || '```' || chr(10) || chr(10) || 'INSTRUCTIONS:' || chr(10) || {_ADVICE} || chr(10) || chr(10) || '{_PROMPT_END}' || chr(10)) AS digest,
        CASE WHEN strategy = 'bogus' THEN 'Invalid strategy: bogus. Must be one of: auto, split, extract, composition' END AS error
        FROM (SELECT c.path, ['auto', 'split', 'extract', 'composition', 'bogus'][c.doc_id % 5 + 1] AS strategy, CASE WHEN c.ext IN ('.cs', '.sql') THEN 'unknown' ELSE {_PARSER} END AS language,
        m.loc, m.function_count, m.cyclomatic_complexity, string_agg(c.line, chr(10) ORDER BY c.i) AS content FROM code_lines c LEFT JOIN all_metrics m ON m.doc_id = c.doc_id GROUP BY ALL)""",
    JS,
)
_add(
    "validate_responses",
    """SELECT o_orderkey AS id, reason IS NULL AS valid, CASE WHEN o_orderkey % 11 <> 0 AND o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS suggestions, reason FROM (
       SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'not a JSON object' WHEN o_orderkey % 3 = 0 THEN 'missing strategy_used' WHEN o_orderkey % 4 = 0 THEN 'missing suggestions.diff' END AS reason FROM orders)""",
)
_add(
    "validate_requests",
    """SELECT id, kind, value, reason IS NULL AS accepted, reason FROM (SELECT id, kind, value, CASE
       WHEN (kind = 'operation' AND value = 'apply_diff') OR (kind = 'strategy' AND value IN ('AUTO', 'Split')) OR (kind = 'provider' AND value = 'openai') OR (kind = 'parser' AND value IN ('regex', 'tree-sitter', 'ast')) THEN NULL
       WHEN kind = 'colour' THEN 'Unknown kind: colour' ELSE 'Invalid ' || kind || ': ' || value || '. Must be one of: ' || CASE kind WHEN 'operation' THEN 'split_file, extract_function, apply_diff, rename_symbol, inline_function'
       WHEN 'strategy' THEN 'auto, split, extract, composition' WHEN 'provider' THEN 'openai, anthropic, google, local' ELSE 'ast, tree-sitter, regex' END END AS reason FROM (
       SELECT o_orderkey AS id, ['operation', 'strategy', 'provider', 'parser', 'colour'][o_orderkey % 5 + 1] AS kind,
       ['apply_diff', 'AUTO', 'openai', 'regex', 'drop_table', 'Split', 'nobody', 'tree-sitter', 'ast'][o_orderkey % 9 + 1] AS value FROM orders))""",
)

# --- streams ------------------------------------------------------------------------------------------------

_add(
    "stream_ledger_state",
    f"SELECT id, arg_max(status, (ts, event_id)) AS status, {_TS.format('max(ts)')} AS updated_at, count(*) AS events FROM ev GROUP BY id",
    EVENTS,
)
_add(
    "stream_ledger_counts",
    """WITH wm AS (SELECT (epoch_us(max(ts)) // 1000 - 5 * 86400000) * 1000 AS us FROM events WHERE event_id % 2 = 0),
       e AS (SELECT event_id % 2 = 0 AS first, event_id % 4 = 1 AS second, epoch_us(ts) <= us AS late FROM events, wm),
       c AS (
       SELECT 0 AS batch, count(*) AS received, count(*) AS kept, 0 AS duplicates, 0 AS late FROM e WHERE first UNION ALL
       SELECT 1, count(*), count(*), 0, 0 FROM e WHERE second UNION ALL
       SELECT 2, count(*), count(*) FILTER (NOT late AND NOT first AND NOT second), count(*) FILTER (NOT late AND (first OR second)), count(*) FILTER (late) FROM e)
       SELECT *, sum(kept) OVER () AS in_state FROM c""",
)
_add(
    "stream_ops_daily",
    """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type AS operation_type, count(*) AS operations FROM events GROUP BY ALL""",
)

# --- ledger files -------------------------------------------------------------------------------------------

_add(
    "suggestions_load",
    """SELECT 'good' AS half, id, file_path, status, NULL AS line FROM suggestions UNION ALL SELECT 'bad', NULL, NULL, NULL, CASE c_custkey % 3
       WHEN 0 THEN 'not json ' || c_custkey WHEN 1 THEN '{"file_path":"x' || c_custkey || '"}' ELSE '{"id":"b' || c_custkey || '","created_at":"soon"}' END FROM customer""",
    SUGGESTIONS,
)
_add("suggestions_save", "SELECT id, status, data FROM suggestions", SUGGESTIONS)
_add("operations_load", "SELECT operation_id, timestamp, files_modified, rolled_back FROM ops", OPERATIONS)
_add(
    "operations_clear",
    "SELECT 0 AS after, count(*) AS before, 'Must set confirm=True to clear history. This action is permanent.' AS refused, count(*) AS kept FROM ops",
    OPERATIONS,
)
_add(
    "config_load",
    """SELECT 'c' || c_custkey AS scope, unnest(['thresholds.maxLines', 'languages.python.testCommand', 'version']) AS key_path,
       unnest([CAST(c_custkey % 2000 AS VARCHAR), c_mktsegment || ' {{ "}', '1.0']) AS value, false AS broken FROM customer WHERE c_custkey % 10 NOT IN (3, 7)
       UNION ALL SELECT 'c' || c_custkey, repeat('k.', 299) || 'k', CAST(c_custkey AS VARCHAR), false FROM customer WHERE c_custkey % 10 = 3
       UNION ALL SELECT 'c' || c_custkey, NULL, NULL, true FROM customer WHERE c_custkey % 10 = 7""",
)
