"""Line counts, complexity, declarations and imports on small texts with known answers."""

from pyspark.sql import functions as F

from sourceloom.functions import lexer, scoring, text
from sourceloom.operators import brace_code, constructs, metrics, python_code

TWO = "def one(a):\n    return a\n\ndef two(b):\n    return b\n"
BRANCHES = """def walk(rows):
    if not rows:
        return 0
    for r in rows:
        if r > 0:
            pass
        elif r < 0:
            pass
    return 1
"""
NEST = '''import os, json as js
from typing import (Any,
   Dict as D)  # c
from . import z; import q.r
if x:
    def a(p, q=(1, 2), *r) -> int:
        """doc if
  or and"""
        def inner():
            if z and os: pass
        for i in z:
            pass
        else:
            pass
        return [k for k in i if k or
   D]

class C(B, metaclass=M):
    x = 1 if y else 2
    class N:
        def deep(self): return 1 if x else 2
    def m(self): return js.x if q else 3
    @dec
    async def n(self):
        match self:
            case 1 if a: pass
            case _: pass
        try:
            pass
        except E: pass
        else: assert 1
'''
SCRIPT = """// module
function regular(x, y) {
    return x + y;
}

const arrow = (a, b) => {
    return a * b;
};

class Box extends Base {
    add(x, y) {
        return x + y;
    }

    static scale(x, y) { if (x) { return x * y; } }
}

async function load(url) {
    return await fetch(url);
}

const named = function(value) {
    return value ? 1 : 2;
};
const short = async v => v ? 1 : v ?? 2;
foo(function* (z) { for (;;) {} });
"""


def test_comment_markers(spark):
    rows = spark.createDataFrame(
        [(".py", "#"), ("py", "#"), (".PY", "#"), (".tsx", "//"), (".cs", "//"), (".sql", "--"), (".xyz", None)],
        "ext string, want string",
    )
    assert all(r[0] == r[1] for r in rows.select(text.comment_marker(F.col("ext")), "want").collect())


def test_lines_of_code(files):
    cases = {
        "mixed.py": ("# c\n\nimport os\nx = 1  # t\n\t# no\n  \ny = 2", 3),
        "mixed.js": ("// c\r\nlet a = 1;\r\rlet b;\n/* block\n*/", 4),
        "empty.py": ("", 0),
        "comments.py": ("# a\n  # b\n", 0),
        "doc.py": ('"""\nModule\n"""\n\nx = 1\n', 4),
    }
    got = metrics.lines_of_code(files({p: c for p, (c, _) in cases.items()})).collect()
    assert {r.path: r["loc"] for r in got} == {p: n for p, (_, n) in cases.items()}
    exploded = metrics.code_lines(files({p: c for p, (c, _) in cases.items()})).groupBy("path").count().collect()
    assert {r.path: r["count"] for r in exploded} == {p: n for p, (_, n) in cases.items() if n}
    assert metrics.lines_of_code(files({"a.xyz": "x"})).first()["error"] == "Unsupported file extension: .xyz"


def test_grades_and_severity(spark):
    grades = spark.createDataFrame([(1, "A"), (5, "A"), (6, "B"), (11, "C"), (20, "C"), (21, "D"), (31, "F")], "x int, g string")
    assert all(r[0] == r[1] for r in grades.select(scoring.complexity_grade(F.col("x")), "g").collect())
    levels = spark.createDataFrame(
        [(100, 150, "none"), (150, 100, "low"), (180, 100, "medium"), (250, 100, "high"), (400, 100, "critical")],
        "n int, t int, s string",
    )
    assert all(r[0] == r[1] for r in levels.select(scoring.severity(F.col("n"), F.col("t")), "s").collect())


def test_masking_keeps_lines_and_survives_long_literals(spark):
    code = 'x = "' + "\\x00" * 50000 + '"\ny = """' + 'a"b\\n' * 50000 + '\n"""\nif z: pass\n'
    got = spark.createDataFrame([(code,)], "c string").select(lexer.python_code(F.col("c"))).first()[0]
    assert got == "x = \ny = \n\nif z: pass\n"


def test_python_metrics(files):
    texts = {"two.py": TWO, "branches.py": BRANCHES, "nest.py": NEST, "empty.py": "", "plain.py": "# v\nx = 1\n"}
    texts |= {"open.py": "def f(\n  x\n", "quote.py": 'x = "abc\n'}
    got = {r.path: r for r in python_code.python_file_metrics(files(texts)).collect()}
    assert (got["two.py"].function_count, got["two.py"].cyclomatic_complexity, got["two.py"].total_complexity) == (2, 1.0, 2)
    assert (got["branches.py"].function_count, got["branches.py"].total_complexity) == (1, 5)
    assert (got["nest.py"].function_count, got["nest.py"].total_complexity) == (3, 13)
    for empty in ("empty.py", "plain.py"):
        assert (got[empty].function_count, got[empty].total_complexity) == (0, 0)
    for broken in ("open.py", "quote.py"):
        assert got[broken].function_count is None and "Syntax error" in got[broken].python_metrics_error
    names = [f.name for f in got["nest.py"].functions]
    assert names == ["a", "m", "n"]


def test_python_scopes(files):
    found = python_code.python_declarations(files({"n.py": NEST})).collect()
    spans = {(r.type, r.name): (r.start_line, r.end_line) for r in found}
    assert spans[("function", "a")] == (6, 16)
    assert spans[("function", "inner")] == (9, 10)
    assert spans[("class", "C")] == (18, 31)
    assert spans[("class", "N")] == (20, 21)
    around = {r.line_no: r.name for r in python_code.enclosing_declarations(files({"n.py": NEST})).collect()}
    assert around[10] == "inner" and around[11] == "a" and around[19] == "C" and around[21] == "deep" and around[5] is None


def test_imports_and_dependencies(files):
    rows = python_code.python_imports(files({"n.py": NEST})).collect()
    assert {(r.module, r.symbol, r.alias) for r in rows} == {
        ("os", None, None),
        ("json", None, "js"),
        ("typing", "Any", None),
        ("typing", "Dict", "D"),
        (".", "z", None),
        ("q.r", None, None),
    }
    source = "import os\nfrom pathlib import Path\n\ndef run(name):\n    p = Path(name)\n    return os.path.exists(p)\n\ndef main():\n    run('t')\n"
    needs = python_code.function_dependencies(files({"f.py": source})).collect()
    assert {(r.name, r.module, tuple(r.symbols or ())) for r in needs} == {("run", "os", ()), ("run", "pathlib", ("Path",))}


def test_script_metrics(files):
    made = files({"a.js": SCRIPT, "e.js": ""})
    got = {
        r.path: (r.c, r.n)
        for r in made.select(
            "path",
            brace_code.script_complexity(F.col("content")).alias("c"),
            brace_code.script_function_count(F.col("content")).alias("n"),
        ).collect()
    }
    assert got["e.js"] == (1, 0)
    assert got["a.js"] == (6, 8)
    functions = {r.name: r for r in brace_code.script_function_complexity(files({"a.js": SCRIPT})).collect()}
    assert (functions["regular"].line_number, functions["regular"].end_line) == (2, 4)
    assert functions["short"].complexity == 3 and functions["scale"].complexity == 2
    assert functions["add"].type == "method" and functions["add"].line_number == 11


def test_constructs_filters_text_and_own_rules(files):
    made = files({"a.js": SCRIPT, "n.py": NEST, "t.sql": "CREATE TABLE a (\n x INT\n);\ncreate function f() returns int as 'x';"})
    found = constructs.constructs(made).cache()
    assert constructs.by_type(found, "table").first()["end_line"] == 3
    assert {r.name for r in constructs.classes_of(found).collect()} == {"Box", "C", "N"}
    assert {r.name for r in constructs.by_name(found, "SCALE", exact=False).collect()} == {"scale"}
    body = constructs.find_function(made, "arrow").first()["source_text"]
    assert body == "const arrow = (a, b) => {\n    return a * b;\n};"
    good, bad = constructs.split_valid(found.limit(1).withColumn("end_line", F.lit(0)))
    assert good.count() == 0 and bad.count() == 1
    own = brace_code.DECLARATIONS + [("sql", "view", r"(?i)\bCREATE\s+VIEW\s+(\w+)", "$1", "", "")]
    assert constructs.constructs(files({"v.sql": "CREATE VIEW v AS SELECT 1;"}), own).first()["type"] == "view"


def test_typed_languages(files):
    java = "public class A extends B implements C {\n  public A(int q) { super(q); }\n  public <T> List<T> run(Map<String, T> m) throws E {\n    String s = \"class Z {\";\n    return null;\n  }\n}\n"
    found = {(r.type, r.name): (r.start_line, r.end_line) for r in constructs.constructs(files({"A.java": java})).collect()}
    assert found == {("class", "A"): (1, 7), ("constructor", "A"): (2, 2), ("method", "run"): (3, 6)}


def test_codebase_report(files):
    body = "x = 1\n" * 200
    made = files({"big.py": body, "mid.js": "let a;\n" * 100, "node_modules/x.js": body, "note.txt": "t"})
    found = metrics.violations(made, 150).collect()
    assert [(r.file, r.lines, r.severity) for r in found] == [("big.py", 200, "low")]
    total = metrics.codebase_summary(made, 150).first()
    assert (total.total_files, total.average_file_size, total.files_exceeding_threshold) == (2, 150, 1)
    empty = metrics.codebase_summary(files({"a.txt": ""}), 150).first()
    assert (empty.total_files, empty.average_file_size) == (0, 0)
    for bad in (0, -1, 10001):
        try:
            metrics.violations(made, bad)
            raise AssertionError("threshold accepted")
        except ValueError:
            pass


def test_repartitioning_does_not_change_results(files):
    made = files({f"f{k}.py": NEST for k in range(20)})
    a = {tuple(r) for r in python_code.python_function_complexity(made.repartition(1)).collect()}
    b = {tuple(r) for r in python_code.python_function_complexity(made.repartition(7)).collect()}
    assert a == b and len(a) == 60


def test_one_shuffle_for_python_metrics(files):
    plan = python_code.python_file_metrics(files({"a.py": TWO}))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "BatchEvalPython" not in plan and "NestedLoop" not in plan


NEEDS = '''"""import no"""
import os, json as js; import a.b.c
from x.y import (p as q,
    r,  # import t
    s)
from . import local
from x.y import \\
    late
import r
from z import *

def outer(v=os.sep):
    """q"""
    def inner():
        return f"{q(v)!r}"
    return (js
        .loads(v))

class K(local.Base):
    from inside import w
    def m(self):
        return [r, a.b, late, w]
print(s)
'''


def test_dependencies_of_nested_functions(files):
    got = {(r.name, r.module, tuple(r.symbols) if r.symbols is not None else None) for r in python_code.function_dependencies(files({"n.py": NEEDS})).collect()}
    assert got == {
        ("outer", "os", None),
        ("outer", "x.y", ("p",)),
        ("inner", "x.y", ("p",)),
        ("outer", "json", None),
        ("m", "x.y", ("late", "r")),
        ("m", "a.b.c", None),
        ("m", "inside", ("w",)),
    }


def test_dependencies_in_one_scan_and_one_shuffle(spark, tmp_path, files):
    files({"n.py": NEEDS}).write.parquet(f"{tmp_path}/f")
    plan = python_code.function_dependencies(spark.read.parquet(f"{tmp_path}/f"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("FileScan") == 1 and plan.count("ArrowEvalPython") == 1 and "Join" not in plan


def test_constructs_of_all_languages_in_one_scan(spark, tmp_path, files):
    files({"n.py": NEEDS, "a.js": SCRIPT, "t.sql": "CREATE TABLE a (x INT);"}).write.parquet(f"{tmp_path}/f")
    found = constructs.constructs(spark.read.parquet(f"{tmp_path}/f"))
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan") == 1 and plan.count("ReusedExchange") == 1 and plan.count("ArrowEvalPython") == 1
