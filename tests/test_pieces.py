from pyspark.sql import functions as F

from sourceloom.operators import brace_code


def test_brackets_and_line_breaks_of_a_block_make_no_rows_of_their_own(spark):
    text = "(((((((a\n))))))) b[c]\n}" * 3 + "((tail"
    rows = spark.createDataFrame([(text,)], "code string").select(F.explode(F.regexp_extract_all("code", F.lit(brace_code._pieces("}")), F.lit(0))))
    assert [r[0] for r in rows.collect()] == ["(((((((a\n))))))) b[c]\n}"] * 3 + ["((tail"]


def test_spans_and_decisions_across_pieces(files):
    text = "function f(a, b = ((((1)))) || 2) {\n  if (a) { return a ? b : [1, {c: a && b}]; }\n}\nconst g = (x) => x\n  || 1;\nclass K {\n  m(a) { while (a) {} }\n}\n"
    got = brace_code.declarations(files({"a.js": text})).select("type", "name", "start_line", "end_line", "complexity").collect()
    assert {(r.type, r.name, r.start_line, r.end_line) for r in got} >= {("function", "f", 1, 3), ("class", "K", 6, 8), ("method", "m", 7, 7)}
    assert {r.name: r.complexity for r in got}["m"] == 2
