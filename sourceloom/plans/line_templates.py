"""Line templates that turn the words of a document into source code.

Word number i (from 0) with n characters becomes line i+1. ``{i}`` and ``{n}`` stand for the two numbers in a template.
After three head lines the lines repeat in blocks of twelve. The CASE expressions built here are SQL that Spark and
DuckDB read alike, once ``$i`` and ``$n`` are replaced.
"""

from __future__ import annotations

import re


def _text(template: str) -> str:
    """SQL expression of a template with {i} and {n}."""
    parts = []
    for piece in re.split(r"(\{[in]\})", template):
        if piece == "{i}":
            parts.append("CAST($i AS STRING)")
        elif piece == "{n}":
            parts.append("CAST($n AS STRING)")
        elif piece:
            parts.append("'" + piece.replace("'", "''").replace("$", "$$") + "'")
    return " || ".join(parts) if parts else "''"


def case_sql(head: list[str], block: list[str | list[tuple[str, str]]]) -> str:
    """CASE expression over i and n. A block entry is a template or (condition, template) choices."""
    lines = ["CASE"]
    for k, template in enumerate(head):
        lines.append(f"WHEN $i = {k} THEN {_text(template)}")
    for k, entry in enumerate(block):
        choices = [("true", entry)] if isinstance(entry, str) else entry
        for condition, template in choices:
            lines.append(f"WHEN ($i - {len(head)}) % {len(block)} = {k} AND {condition} THEN {_text(template)}")
    return "\n".join(lines + ["END"])


PYTHON = case_sql(
    ["import os, json as js", "from typing import Any, Dict as D", "from pathlib import (Path, PurePath)"],
    [
        [("$n % 4 = 0", "class K{i}(Base):"), ("true", "def f{i}(a, b={n}):")],
        [("$n % 2 = 0", "    def m{i}(self, c):"), ("true", "    if a and b:")],
        [
            ("$n % 3 = 0", "        total = [x for x in a if x or {n}]"),
            ("true", "        for x in range({n}): Path(x)"),
        ],
        "        x = js.loads(a) if b else {n}",
        "        # note if {n}",
        "        while a or b: a -= os.getpid()",
        "",
        "        call({n},",
        "  b)",
        '    text = """if {n} and b',
        '    or c while # d"""',
        [("$n % 5 = 0", "    assert a, 'no # comment'"), ("true", "    return D(a)")],
    ],
)

_CLASS = "floor(($i - 3) / 12) % 3 = 2"


def _script(typed: bool) -> str:
    typed_head = "function f{i}(a: number, b?: string): void {" if typed else "function f{i}(a, b) {"
    number = "    const t{i}: number | undefined = a ?? {n};" if typed else "    total = a ?? {n};"
    return case_sql(
        ["// head {n}", "", '"use strict";'],
        [
            [
                (_CLASS, "class K{i} extends Base {"),
                ("$n % 3 = 0", "const h{i} = (a, b) => {"),
                ("$n % 3 = 1", typed_head),
                ("true", "async function g{i}(a, b) {"),
            ],
            [(_CLASS, "  m{i}(a, b) {"), ("true", "  if (a && b) {")],
            number,
            [
                ("$n % 2 = 0", "    try { run(a); } catch (e) { log(e); }"),
                ("true", "    const q{i} = function (v) { return v ? v : {n}; };"),
            ],
            "    // note if {n}",
            '    for (const x of items) { x.y = "if && {n}"; }',
            "",
            "    while (a || b) { a -= {n}; }",
            "    switch (a) { case {n}: break; default: stop(); }",
            "    /* if (b) { */ a = b ? a : {n};",
            "  }",
            "}",
        ],
    )


JAVASCRIPT = _script(False)
TYPESCRIPT = _script(True)


def _typed(base: str) -> str:
    return case_sql(
        ["// head {n}", "", "/* block {n} */"],
        [
            [(_CLASS, "public interface I{i} {"), ("true", "public class K{i} " + base + " Base {")],
            "    public int m{i}(int a, int b) {",
            "        int t{i} = a + {n};",
            [
                ("$n % 2 = 0", "        if (a > {n}) { run(a); }"),
                ("true", "        for (int j = 0; j < a; j++) { run(j); }"),
            ],
            "        // note if {n}",
            '        String s = "class X {";',
            "",
            "        /* public int no{i}() { */",
            "        return a;",
            "    }",
            [("$n % 3 = 0", "    public K{i}(int a) { run(a); }"), ("true", "    // end")],
            "}",
        ],
    )


JAVA = _typed("extends")
CSHARP = _typed(":")

#: Round brackets forty deep.
NEST = "(" * 40 + "{n}" + ")" * 40

# code inside of strings, deep brackets, decorators and heads of several lines: each word becomes four lines
PYTHON_NESTED = case_sql(
    [],
    [
        "@app.route('/p{i}',\n    methods=[{n}])\ndef f{i}(a, b='if {n}',\n    *, c=" + NEST + ") -> Dict[str, int]: return a if b else {n}",
        "# note {n}\nclass K{i}(Base, key=\"{n}\"):\n    @property\n"
        "    def p{i}(self): return f\"{self.a or f'{self.b and {n}}'} {{if}} {self.c!r:>{n}}\"",
        'async def g{i}(\n    x): return f"""{x if x\n  else {n}} and\n  or {x}"""',
        "if a and {n}:\n    def h{i}(): pass\nelse:\n    y = f'{a if b else {n}}'",
    ],
)
SCRIPT_NESTED = case_sql(
    [],
    [
        "function f{i}(a, b = g" + NEST + ",\n    c) {\n  return `x ${a ? `y ${b && {n}}` : c} if`;\n}",
        "const h{i} = (a) => `${a || {n}}\n  if ${\n  a ?? b} while`\n;",
        "class K{i} {\n  m{i}(a) { return /[`/\"]/.test(a) ? `{${a}}` : {n}; }\n}\n// `${ if",
        "const s{i} = '`${if}';\nfoo(function (z) {\n  return `\\${if} ${z && `${z || {n}}`}`;\n});",
    ],
)
NESTED_EXTENSIONS = [".py", ".js", ".ts"]

# SQL scripts repeat in blocks of ten, without head lines
SQL = case_sql(
    [],
    [
        [("$n % 2 = 0", "CREATE TABLE t{i} (id INT);"), ("true", 'CREATE TABLE IF NOT EXISTS "q{n}" (')],
        "  id INT);",
        "-- note; {n}",
        "SELECT a, b FROM u{n}",
        "  JOIN v{n} ON u.id = v.id",
        [
            ("$n % 3 = 0", "  WHERE a IN (SELECT b FROM w{n});"),
            ("$n % 3 = 1", "  union select c from x{n};  "),
            ("true", "  WHERE a = {n};"),
        ],
        "",
        "INSERT INTO y{n} VALUES ({i});",
        [("$n % 2 = 0", "ALTER TABLE z{n} ADD COLUMN c{i} INT;"), ("true", "UPDATE z{n} SET a = {i};")],
        [
            ("$n % 4 = 0", "DELETE FROM d{n};"),
            ("$n % 4 = 1", "DROP TABLE e{n};"),
            ("$n % 4 = 2", "TRUNCATE TABLE g{n};"),
            ("true", "   "),
        ],
    ],
)

# database files of eight kinds, one line or operation per word
DATABASE_LINES = {
    0: [("$n % 3 = 0", "class M{i}(models.Model):"), ("true", "    f{i} = models.CharField(max_length={n})")],
    1: [
        ("$n % 3 = 0", "class T{i}(Base):"),
        ("$n % 3 = 1", "    __tablename__ = 't{i}'"),
        ("true", "    c{i} = Column({n})"),
    ],
    2: [("$n % 3 = 0", "class P{i}(db.Model):"), ("true", "    x{i} = {n}")],
    3: [
        (
            "$n % 4 = 0",
            "        migrations.CreateModel(\n            name='M{i}',\n            fields=[('id', {n}), ],\n        ),",
        ),
        ("$n % 4 = 1", "        migrations.AddField('m', 'f{i}', {n}),"),
        ("$n % 4 = 2", "        migrations.AlterField(\n            'm', 'g{i}', {n}),"),
        ("true", "        # remark {n}\n        migrations.RunPython(fn{i}),"),
    ],
    4: [
        ("$n % 5 = 0", "    op.create_table('t{i}')"),
        ("$n % 5 = 1", "    op.drop_column('t{i}', 'c{n}')"),
        ("$n % 5 = 2", "    op.add_column('t{i}', 'c{n}')"),
        ("true", "    op.execute('select {n}')"),
    ],
    5: [("true", "    batch_op.execute('{n}')")],
    6: [
        ("$n % 7 = 0", "    q{i} = \"SELECT a FROM t{n} WHERE b = 1\""),
        ("true", "x{i} = {n}"),
    ],
    7: [("true", "SELECT {n};")],
}


def database_case(kind: int) -> str:
    return case_sql([], [DATABASE_LINES[kind]])


# head and foot of each kind; {d} is the document number, {p} the number eight below it
DATABASE_HEAD = {
    0: "from django.db import models\n\n",
    1: "from sqlalchemy import Column\n\n",
    2: "from flask_sqlalchemy import SQLAlchemy\ndb = SQLAlchemy(app)\n",
    3: "from django.db import migrations, models\n\n\nclass Migration(migrations.Migration):\n\n    dependencies = [\n"
    "        ('app{d}', '0001_initial'),\n        (\"core\", \"m{d}\"),\n    ]\n\n    operations = [\n",
    4: "from alembic import op\n\nrevision = 'r{d}'\ndown_revision = 'r{p}'\n\n\ndef upgrade():\n",
    5: "# made with flask_migrate\ndef upgrade():\n",
    6: "import os\n",
    7: "-- script {d}\n",
}
DATABASE_FOOT = {3: "\n    ]\n"}
DATABASE_PATH = {
    0: "app/models{d}.py",
    1: "app/tables{d}.py",
    2: "web/tables{d}.py",
    3: "app/migrations/{d}_auto.py",
    4: "alembic/versions/r{d}.py",
    5: "web/{d}_change.py",
    6: "src/util{d}.py",
    7: "db/s{d}.SQL",
}


def fill(template: str) -> str:
    """SQL expression of a template with {d} (document number) and {p} (d - 8)."""
    parts = []
    for piece in re.split(r"(\{[dp]\})", template):
        if piece == "{d}":
            parts.append("CAST(doc_id AS STRING)")
        elif piece == "{p}":
            parts.append("CAST(doc_id - 8 AS STRING)")
        elif piece:
            parts.append("'" + piece.replace("'", "''") + "'")
    return " || ".join(parts) if parts else "''"
