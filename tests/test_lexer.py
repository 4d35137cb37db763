"""The pushdown lexer: code in strings, deep brackets, heads of declarations, and texts that do not end."""

import ast
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from sourceloom.functions import lexer
from sourceloom.operators import brace_code, constructs, python_code


def plain(code):
    """Without the marks of heads and the codes of brackets."""
    return re.sub(f"[{lexer.CODE_RANGE}{lexer.HEAD}]|{lexer.NOTE}[^\n]*", "", code)


def expression(rng, depth):
    pick = rng.randrange(8 if depth else 3)
    inner = lambda: expression(rng, depth - 1)
    quote = rng.choice(['"', "'", '"""', "'''"])
    return [
        lambda: "a",
        lambda: rng.choice(["'if'", '"or # b"', "r'\\d'", "b'and'", '"\\""']),
        lambda: "1",
        lambda: f"({inner()} if {inner()} else {inner()})",
        lambda: f"({inner()} or {inner()})",
        lambda: f"[{inner()}][0:1]",
        lambda: f"f{quote}if {{{inner()}!r:>{{{inner()}}}}} {{{{and}}}} {{{inner()}}} or{quote}",
        lambda: f"f{quote}{{{inner()} }}{quote}" if quote in "\"'" else f"f{quote}\n{{{inner()}}}\n while{quote}",
    ][pick]()


def test_code_in_fstrings_is_what_the_parser_sees():
    rng = random.Random(7)
    nested = 0
    for _ in range(600):
        source = f"x = {expression(rng, 5)}\n"
        want = sum(
            (1 if isinstance(n, ast.IfExp) else len(n.values) - 1 if isinstance(n, ast.BoolOp) else 0) for n in ast.walk(ast.parse(source))
        )
        code = lexer.lex_python(source)
        got = len(re.findall(r"\b(?:if|or|and)\b", code))
        assert got == want, (source, code)
        assert code.count("\n") == source.count("\n")
        nested += source.count("f'") + source.count('f"') > 2
    assert nested > 50


@pytest.mark.parametrize(
    "source, code",
    [
        ("`x ${a ? `y ${b && c}` : d} z`", "(a ? (b && c) : d)"),
        ("`a\nb`", "(\n)"),
        ("`${a}${b}`;", "(a,b);"),
        ("`\\${a ? b : c}`", ""),
        ("`${ {a: {b: 1}} }` // ${c ? d : e}", "( {a: {b: 1}} ) "),
        ("`${a", "`${a"),
        ("`${`\nx = `b`", "`${\nb`"),
        ("x = a / b; y = /[/`]/.test(a) ? /\\//g : 'a/b'", "x = a / b; y = .test(a) ?  : "),
        ("return /'/", "return "),
        ('"a\nb" `${c || d}', '"a\nb" `${c || d}'),
    ],
)
def test_templates(source, code):
    assert plain(lexer.lex_script(source)) == code


@pytest.mark.parametrize(
    "source, code",
    [
        ('var s = $"a {b ?? c} {{x}}";', "var s = (b ?? c);"),
        ('var t = @"c:\\"; char c = \'"\'; f("/*");', "var t = ; char c = ; f();"),
        ('s = """\n class X {\n""" + $@"{a}""{b}\n";', "s = \n\n + (a,b\n);"),
        ("/* open\n", "\n"),
    ],
)
def test_typed_literals(source, code):
    assert plain(lexer.lex_braces(source)) == code


def test_literals_that_do_not_end_leave_their_quote():
    assert lexer.lex_python("x = f'{a if b\ny = 'c'\n") == "x = '{a if b\ny = \n"
    assert lexer.lex_python('x = f"{" \ny = """') == 'x = "{" \ny = "'
    assert plain(lexer.lex_script("a = `${`b`")).count("`") >= 1


def test_long_and_hostile_texts_take_linear_time():
    for lex, text in (
        (lexer.lex_script, "`${" * 100_000),
        (lexer.lex_script, "`" * 100_001),
        (lexer.lex_script, "`${a}" * 100_000),
        (lexer.lex_script, "/" * 200_000 + "\n" + " /" * 100_000),
        (lexer.lex_script, "(" * 100_000),
        (lexer.lex_python, "f'{" * 100_000),
        (lexer.lex_python, "f'{x" * 60_000 + "}'" * 60_000),
        (lexer.lex_python, "'\\" * 100_000),
        (lexer.lex_python, "f'\\" * 100_000),
        (lexer.lex_python, 'x\\"""' * 60_000),
        (lexer.lex_script, "=/[" * 100_000),
        (lexer.lex_script, "`\\" * 100_000),
        (lexer.lex_python, "def f(\n" * 60_000),
        (lexer.lex_python, "@a(\n)\n" * 60_000 + "def f(): pass"),
        (lexer.lex_braces, '$"{' * 100_000),
    ):
        start = time.time()
        lex(text)
        assert time.time() - start < 6, (lex, text[:20])


HEADS = '''@app.route("/x",  # comment (
           methods=["if"])
@cached
async def first(a, b="x if y", *, c=((1), (2, (3))),
                d=lambda q: q or 1) -> Dict[str, "int"]:
    return [a if b else c]

class Plain:
    x = (1
         @ second)

    @property

    def third(
        self,

        # nothing
    ): return f"{self.x if self else 0}"


class Deep(Base, metaclass=make("k", (1,))):
    """@no
    def inside(): pass
    """
    @staticmethod
    def last(): pass
'''


def test_heads_of_declarations(files):
    found = {r.name: r for r in constructs.constructs(files({"h.py": HEADS})).collect()}
    assert set(found) == {"first", "Plain", "third", "Deep", "last"}
    first = found["first"]
    assert (first.start_line, first.end_line) == (4, 6)
    assert first.parameters == '(a, b="x if y", *, c=((1), (2, (3))),\n                d=lambda q: q or 1)'
    assert first.decorators == '@app.route("/x",  # comment (\n           methods=["if"])\n@cached'
    assert (found["Plain"].heritage, found["Plain"].decorators, found["Plain"].parameters) == (None, None, None)
    third = found["third"]
    assert (third.start_line, third.end_line, third.decorators) == (14, 18, "@property")
    assert third.parameters == "(\n        self,\n\n        # nothing\n    )"
    assert found["Deep"].heritage == '(Base, metaclass=make("k", (1,)))' and found["Deep"].end_line == 26
    assert (found["last"].start_line, found["last"].decorators) == (26, "@staticmethod")
    points = {r.name: r.complexity for r in python_code.python_function_complexity(files({"h.py": HEADS})).collect()}
    assert points == {"first": 2, "third": 2, "last": 1}


def test_every_line_of_a_head_has_its_scope(files):
    source = "class K:\n    def f(a,\n\n          b):\n        return a\nx = 1\n"
    around = {r.line_no: r.name for r in python_code.enclosing_declarations(files({"s.py": source})).collect()}
    assert around == {1: "K", 2: "f", 4: "f", 5: "f", 6: None}


def test_heads_in_broken_files(files):
    texts = {"a.py": "def f(a,\n", "b.py": "@x(\ndef f(): pass\n", "c.py": "class\ndef\n@\n", "d.py": "def f(a)\n    pass\n", "e.py": "x = f'{a\n"}
    got = {r.path: r.python_metrics_error for r in python_code.python_file_metrics(files(texts)).collect()}
    assert {p for p, e in got.items() if e} == {"a.py", "b.py", "e.py"}


@pytest.mark.parametrize("depth", [1, 40, 7000])
def test_brackets_of_any_depth(files, depth):
    deep = "(" * depth + "1" + ")" * depth
    script = f"function f(a = g{deep}, b = [{'(1),' * 3000}]) {{\n  return a ? b : 1;\n}}\nfoo((x, y) => {{}}, function z(q) {{ return q; }});\n"
    found = {r.name: r for r in constructs.constructs(files({"a.js": script})).collect()}
    assert found["f"].parameters == f"(a = g{deep}, b = [{'(1),' * 3000}])" and found["z"].parameters == "(q)"
    java = f"class A {{\n  public A(int a) {{ super({deep}); }}\n  int m(@X({deep}) int b) {{ return 1; }}\n}}\n"
    typed = {(r.type, r.name): r.parameters for r in constructs.constructs(files({"A.java": java})).collect()}
    assert typed == {("class", "A"): None, ("constructor", "A"): "(int a)", ("method", "m"): f"(@X({deep}) int b)"}


def test_script_counts_in_templates(spark):
    code = "const f = (a) => `${a ? `${b || c}` : d}`;\nclass K { m() { return `${() => { if (x) { y; } }}`; } }"
    row = spark.createDataFrame([(code,), ("",), (None,)], "c string").select(
        brace_code.script_complexity(F.col("c")).alias("c"), brace_code.script_function_count(F.col("c")).alias("n")
    )
    assert [tuple(r) for r in row.collect()] == [(4, 2), (1, 0), (None, None)]


PLAIN = {
    "python": "x = r'a\\'#' + \"b\" # it's\ny = \"\"\"if (\n\\\n\"\"\" \\\n  + u'('\nz = bar'\\''\n",
    "script": "f((a), ')') // (\n/* \" \n*/ g({b: \"\\\"(\"});)) h(())\n",
    "brace": "class A { /* ' */ int f(int a) { return g((a)); } // \"\n String s = \"{(\"; char c = '\\''; }\n",
}


@pytest.mark.parametrize("language", PLAIN)
def test_plain_texts_are_read_in_one_pass_with_the_same_code(language):
    text = PLAIN[language]
    if language == "python":
        assert "".join(lexer._simple_python(text).parts) == "".join(lexer.scan(text, lexer.RULES[language]).parts)
    else:
        assert lexer._simple_braces(text, language) == "".join(lexer.scan(text, lexer.RULES[language], coded=True).parts)


def test_texts_that_are_not_plain_are_left_to_the_full_lexer():
    assert lexer._simple_python("a = f'{b}'\n") is None
    assert lexer._simple_python("a = '\n") is None
    for text in ("a = `${b}`", "a = b / c", "a = '"):
        assert lexer._simple_braces(text, "script") is None
    assert lexer._simple_braces('s = $"{a}";', "brace") is None


SCRIPT_PIECES = ["`", "${", "}", "{", "(", ")", "((", "))", "a", " ", "\n", "'x'", '"', "/", "//c", "/*\n*/", "/[`/]/", "\\`", "\\\n", "$", "return ", "=>", "=", "`a${b}c`", "`${f(x)}`", "`x`", "é", "`\n`", "`${`${a}`}`", ","]
PYTHON_PIECES = ["f'", 'f"""', "'", '"""', "{", "}", "{{", "(", "]", ":", "!r", "!=", "a", "if ", "\n", "#c", "\\", "\\\n", "\\N{x}", "\\{", "Rb'", "xf'", "f''", "''", "def f(", "):", "\n@d(", "\nclass K(", "):\n", ">{n}", "f'{a!r:>{b}}'", "f\"{x if y else f'{z}'}\"", "é", "u'a'", "t'{x}'"]


def test_texts_whose_literals_end_are_read_with_the_same_code():
    rng = random.Random(3)
    ended = [0, 0]
    for _ in range(6000):
        text = "".join(rng.choice(SCRIPT_PIECES) for _ in range(rng.randint(1, 14)))
        code = lexer._ended_script(text)
        ended[0] += code is not None
        assert code in (None, "".join(lexer.scan(text, lexer.RULES["script"], coded=True).parts)), text
        text = "".join(rng.choice(PYTHON_PIECES) for _ in range(rng.randint(1, 14)))
        code, full = lexer._ended_python(text), lexer.scan(text, lexer.RULES["python"])
        ended[1] += code is not None
        assert code is None or "".join(code.parts) == "".join(full.parts) and lexer._gathered(code, text) == lexer._gathered(full, text), text
    assert min(ended) > 1500


def test_ordinary_templates_and_fstrings_do_not_need_the_full_lexer(monkeypatch):
    monkeypatch.setattr(lexer, "scan", None)
    deep = "(" * 40 + "1" + ")" * 40
    script = f"function f(a = g{deep}) {{\n return /[`/\"]/.test(`x ${{a ? `y ${{b && 5}}` : c}} if`) / 2;\n}}\n"
    assert plain(lexer.lex_script(script)) == f"function f(a = g{deep}) {{\n return .test((a ? (b && 5) : c)) / 2;\n}}\n"
    source = "@p('/x',\n  [1])\ndef f(a, b='if',\n  c=" + deep + "): return f\"{a or f'{b and 1}'} {{if}} {c!r:>{d}}\"\n"
    assert plain(lexer.lex_python(source)).endswith("return (a or (b and 1),c,d)\n\n")
