"""Declarations and events of single files in one pass, against the windows that serve files that share their path."""

import random

from pyspark.sql import Window as W, functions as F

from sourceloom.functions import nesting
from sourceloom.operators import brace_code, constructs, metrics, migrations, python_code

PIECES = ["function f(a) {\n", "const g = (x) => x\n", "const h = (x) => {", "class K {", "m(a) {", "}", "}\n", ";", "\n", "([", "])", "if (a && b)", "{", "a ? b : c"]
ROWS = ["def f(a,\n  b): return a or b", "class K(B):", "    def m(self):", "  if a:", "  else:", "for x in y:", "else:", "\t@p", "    x = (1,", "  2)", "", "async def g():", "y = a \\", "    case 1 if a:", "'", "\tdef t(): pass", "]"]


def _rows(df):
    return sorted(map(str, df.collect()))


def test_spans_of_random_texts_are_those_of_the_windows(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(1, 25))) for _ in range(150)]
    rows = spark.createDataFrame([(f"d{k}.{('js', 'ts', 'java', 'sql')[k % 4]}", t) for k, t in enumerate(texts)], "path string, content string")
    language = brace_code.parser_language(F.col("path"))
    code = rows.select("path", language.alias("language"), brace_code.masked(language, F.col("content")).alias("code"))
    bare = brace_code._bare(code, brace_code.LANGUAGES, brace_code.DECLARATIONS)
    found = _rows(brace_code._declarations_by_file(bare))
    assert len(found) > 100 and found == _rows(brace_code._declarations_by_windows(bare))


def test_python_events_of_random_texts_are_those_of_the_windows(spark):
    rng = random.Random(6)
    texts = ["\n".join(rng.choice(ROWS) for _ in range(rng.randint(1, 14))) for _ in range(300)]
    rows = spark.createDataFrame([(f"d{k}.py", t) for k, t in enumerate(texts)], "path string, content string")
    code = python_code._placed_code(rows)
    lines = python_code.placed_lines(code)
    once = lambda step: code.select("path", F.explode(step(F.col("code"))).alias("e")).select("path", "e.*")
    assert _rows(once(nesting.declarations_of).select("path", "name", "start", F.col("last"))) == _rows(
        python_code.declarations_in(lines).select("path", "name", F.col("start_line").alias("start"), F.col("end_line").alias("last"))
    )
    columns = ["path", "kind", "line_no", "tokens", "broken", "depth"]
    assert _rows(once(nesting.events_of).select(*columns)) == _rows(python_code.scope_events(lines).select(*columns))
    assert _rows(python_code.line_scopes(rows)) == _rows(python_code._line_scopes_by_windows(code))


def test_files_that_share_a_path_are_still_read_as_one(spark):
    rows = spark.createDataFrame([("a.py", "def f():\n  a = 1\n"), ("a.py", "def f():\n  a = 1\n"), ("b.py", "def f():\n  a = 1\n")], "path string, content string")
    code = python_code._placed_code(rows)
    assert _rows(python_code.python_declarations(rows)) == _rows(python_code.declarations_in(python_code.placed_lines(code)))


def test_operations_of_random_migrations_are_those_of_the_windows(spark):
    rng = random.Random(7)
    parts = ["migrations.A('x'),", "  migrations.B(\n", "  'y', [", "]", "),", ")", ",", "# note", " ", "fields=[(1),]", "('app', 'm1'),"]
    head = "from django.db import migrations\ndependencies = [('app', 'm0')]\noperations = [\n"
    texts = [head + "\n".join(rng.choice(parts) for _ in range(rng.randint(0, 20))) + "\n]\n" for _ in range(200)]
    files = spark.createDataFrame([(f"app/m{k}.py", t) for k, t in enumerate(texts)], "path string, content string")
    found = _rows(migrations.django_operations(files))
    assert len(found) > 50 and found == _rows(migrations._operations_by_windows(files))
    chunk = ["path", "part", "operations"]
    assert _rows(migrations.split_django(files, 2).select(chunk)) == _rows(migrations._chunks_by_windows(files, 2).select(chunk))


def _placed(files):
    language = brace_code.parser_language(F.col("path"))
    code = files.select("path", language.alias("language"), F.coalesce(python_code.lexer.python_code(F.when(language == "python", F.col("content"))), brace_code.masked(language, F.col("content"))).alias("code"))
    return code.repartition(3, "path").cache()


def test_declarations_of_files_in_one_pass_are_those_of_the_windows(spark):
    """Files whose path stands once, equal files that share it (two, three, more than a batch holds), empty and NULL texts."""
    rng = random.Random(8)
    rows = []
    for k in range(240):
        kind = ("js", "ts", "java", "sql", "py")[k % 5]
        text = "\n".join(rng.choice(ROWS) for _ in range(rng.randint(1, 14))) if kind == "py" else "".join(rng.choice(PIECES + ["CREATE TABLE t", "é"]) for _ in range(rng.randint(1, 25)))
        rows += [(f"d{k}.{kind}", text)] * (1, 1, 2, 3)[k // 5 % 4]
    rows += [("n.js", None), ("n.py", None), ("e.js", ""), ("e.py", ""), ("s.js", None), ("s.js", "class A {}"), ("s.py", None), ("s.py", "def f(): pass")]
    placed = _placed(spark.createDataFrame(rows, "path string, content string"))
    columns = ["path", "language", "type", "name", "start_line", "end_line", "parameters", "heritage"]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        found = _rows(brace_code.placed_declarations(placed.where("language <> 'python'")).select(columns))
        python = _rows(python_code.placed_declarations(placed.where("language = 'python'")))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    windows = brace_code.declarations_by_windows(placed.where("language <> 'python'")).select(columns)
    assert len(found) > 200 and found == _rows(windows)
    assert brace_code.placed_declarations(placed.where("language <> 'python'")).select(columns).dtypes == windows.dtypes
    assert len(python) > 50 and python == _rows(python_code.declarations_in(python_code.placed_lines(placed.where("language = 'python'").select("path", "code"))))


def test_constructs_sort_files_not_lines(spark, tmp_path, files):
    files({"n.py": "def f(): pass", "a.js": "class A {}"}).write.parquet(f"{tmp_path}/f")
    plan = constructs.constructs(spark.read.parquet(f"{tmp_path}/f"))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("MapInArrow") == 2


def _functions_by_windows(code, keep):
    """Measured functions of each path from events of lines, in windows."""
    events = python_code.scope_events(python_code.placed_lines(code, keep), keep, sparse=True)
    order = W.partitionBy("path").orderBy("seq", F.desc("level")).rowsBetween(W.unboundedPreceding, 0)
    opened = F.col("kind") == "S"
    at = lambda d: F.when(opened & (F.col("depth") == d), F.struct("line_no", "word"))
    events = events.withColumns({"at0": at(0), "at1": at(1)}).select("*", F.last("at0", True).over(order).alias("outer"), F.last("at1", True).over(order).alias("inner"))
    inside = F.col("depth") + F.when(opened, 1).otherwise(0)
    is_method = (inside == 2) & (F.col("outer.word") == "class") & (F.col("inner.word") == "def")
    owner = F.when((inside == 1) & (F.col("outer.word") == "def"), F.col("outer.line_no")).when(is_method, F.col("inner.line_no"))
    ends = F.when((F.col("kind") == "C") & (F.col("closes.start") == owner), F.greatest("before", "closes.start"))
    per_owner = events.withColumns({"owner": owner, "ends": ends, "inside": inside}).groupBy("path", "owner").agg(
        (F.sum("tokens") + 1).alias("complexity"),
        F.max(F.when(opened, F.struct("name", (F.col("inside") == 2).alias("is_method")))).alias("s"),
        F.max("ends").alias("end_line_number"),
        F.max("broken").alias("broken"),
        *[F.max(k).alias(k) for k in keep],
    )
    detail = F.when(F.col("owner").isNotNull(), F.struct(F.col("owner").alias("line_number"), F.col("s.name").alias("name"), "complexity", "end_line_number", F.col("s.is_method").alias("is_method")))
    return per_owner.groupBy("path").agg(
        *[F.max(k).alias(k) for k in keep],
        F.sort_array(F.collect_list(detail)).alias("functions"),
        F.coalesce(F.sum(F.when(F.col("owner").isNotNull(), F.col("complexity"))), F.lit(0)).alias("total"),
        F.max("broken").alias("broken"),
    )


MORE_ROWS = ROWS[:-2] + ["", "    \\", "  def g(self): return [x for x in a if x] or 1", "class A: pass", "  class B:", "      async  def q(z,", "  else: b and c", "try:", "except E: pass", "case _ if a and b:", "\u00e9if = orif", "  case [a, b] if \u00e9 or c: assert a", "# def n", "x = '''\ndef no(): if\n'''", "x = f'{a if b else {1: 2}}'", "def \u00e9(): pass", "asserté", "@q(1,\n  2)"]


def test_measured_functions_of_random_texts_are_those_of_the_windows(spark):
    """Texts of their own path, equal texts and different ones that share a path, an empty and a NULL path, broken ones."""
    rng = random.Random(9)
    rows = [(None, 1, "def f(): return a or b"), ("n", 2, None), ("e", 3, ""), ("s", 4, None), ("s", None, "class K:\n  def m(self): pass\n\n"), ("b", 5, "  \\\n\ndef f():\n  return 1 and 2")]
    for k in range(600):
        text = "\n".join(rng.choice(MORE_ROWS if k % 9 else ROWS) for _ in range(rng.randint(1, 16)))
        rows += [(f"d{k}", k, text)] * (1, 1, 1, 2, 3)[k % 5]
    for k in range(100):
        made = ["\n".join(rng.choice(MORE_ROWS) for _ in range(rng.randint(1, 8))) for _ in range(2)]
        rows += [(f"t{k}", n, text) for n, text in enumerate(made)]
    files = spark.createDataFrame(rows, "path string, n int, content string").repartition(3, "path")
    code = files.select("path", "n", python_code.lexer.python_code(F.col("content")).alias("code")).repartition(3, "path")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        found = python_code._measured(files, ("n",)).cache()
        got = _rows(found)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    windows = _functions_by_windows(code, ("n",)).select(found.columns)
    assert found.dtypes == windows.dtypes
    once = lambda rows: [r for r in rows if "path='t" not in r]
    want = _rows(windows)
    assert sum("name=" in r and "broken=False" in r for r in got) > 100
    assert once(got) == once(want)
    assert len(got) == len(want) and sum(a == b for a, b in zip(got, want)) >= len(got) - 5


def test_metrics_sort_files_not_lines(spark, tmp_path, files):
    files({"n.py": "def f(): pass", "a.js": "class A {}"}).write.parquet(f"{tmp_path}/f")
    plan = metrics.file_metrics(spark.read.parquet(f"{tmp_path}/f"))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("MapInArrow") == 1 and plan.count("Sort ") == 1


def test_decisions_of_declarations_in_one_pass_are_those_of_the_windows(spark):
    """Each path once, twice and thrice; complexity and position too."""
    rng = random.Random(10)
    rows = [("n.js", None), ("e.ts", ""), ("n.js", "class A { m() { if (a) {} } }")]
    for k in range(200):
        text = "".join(rng.choice(PIECES + ["x = y || é;", "f((a ? 1 : 2))", "m(a = function (q) { if (r) {} }) { while (b) {} }"]) for _ in range(rng.randint(1, 25)))
        rows += [(f"d{k}.{('js', 'ts', 'java', 'sql')[k % 4]}", text)] * (1, 1, 2, 3)[k // 4 % 4]
    placed = _placed(spark.createDataFrame(rows, "path string, content string")).where("language <> 'python'")
    found, windows = brace_code.declarations_in(placed), brace_code.declarations_by_windows(placed)
    assert found.count() > 200 and _rows(found) == _rows(windows.select(found.columns)) and found.dtypes == windows.dtypes
    plan = brace_code.script_function_complexity(placed.withColumn("content", F.col("code")))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("MapInArrow") == 1


def test_marks_that_touch_each_other(spark):
    """A rule that finds the same place as another one: two marks side by side, and text with brackets behind them."""
    rules = brace_code.DECLARATIONS + [("java", "record", r"\bclass\s+(\w+)", "$1", "", "")]
    text = "class A { int m(int a) { return a; } }\nclass B {\n int n(int b) { return (b); } }\n"
    placed = _placed(spark.createDataFrame([("a.java", text), ("b.java", text), ("b.java", text)], "path string, content string"))
    found, windows = brace_code.declarations_in(placed, rules=rules), brace_code.declarations_by_windows(placed, rules=rules)
    assert found.count() == 12 and _rows(found) == _rows(windows.select(found.columns))
