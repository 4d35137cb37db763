"""Ordinary texts beyond the generated ones: deep brackets, long signatures, odd ledgers and configurations, streams in parts."""

import json
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from sourceloom.functions import text
from sourceloom.operators import brace_code, configs, dbfiles, python_code
from sourceloom.session import shared_dir
from sourceloom.sources import ledgers
from sourceloom.streaming import ledger_stream


def test_declarations_with_nested_defaults(files):
    source = "function f(a = g(h(i(1)))) {\n}\nclass K {\n  m(a = g(h(1))) {\n  }\n}\nconst z = (a = g(h(k(1)))) => {\n};\n"
    got = brace_code.declarations(files({"a.js": source})).select("type", "name", "parameters").collect()
    assert {(r.type, r.name) for r in got} == {("function", "f"), ("class", "K"), ("method", "m"), ("function", "z")}
    assert {r.parameters for r in got if r.name == "f"} == {"(a = g(h(i(1))))"}


def test_signatures_do_not_count(files):
    deep = "def f(a, b=g(h(1 if x else 2))):\n    return a\n"
    several = "def f(a,\n      b=1 if x else 2,\n      c=g(1 if y else 2)) -> int:\n    return a and b\n"
    inline = "def f(\n    a=1 if x else 2): return a or b\n"
    made = files({"deep.py": deep, "several.py": several, "inline.py": inline})
    got = {r.path: r.complexity for r in python_code.python_function_complexity(made).collect()}
    assert got == {"deep.py": 1, "several.py": 2, "inline.py": 2}


@pytest.mark.parametrize(
    "code, points",
    [
        ('return /"/.test(a) || b === "x"', 2),
        (" " * 12 + 'x = 1;\n            /"/.test(a) && b', 2),
        ("const f = a => /'/.test(a) ? 1 : 2", 2),
        ("x = a / b / c ? 1 : 2", 2),
    ],
)
def test_regular_expressions_are_masked(spark, code, points):
    got = spark.createDataFrame([(code,)], "code string").select(brace_code.script_complexity(F.col("code"))).first()[0]
    assert got == points


def test_split_lines(spark):
    texts = ["", "a", "a\n", "a\x0bb\x0cc", "a\x1cb\x1dc\x1ed", "a\x85b c ", "a\r\nb\rc", "\n\n"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.count_split_lines(F.col("t")).alias("n"))
    assert {r.t: r.n for r in rows.collect()} == {t: len(t.splitlines()) for t in texts}


def test_every_ledger_line_is_in_one_half(spark, tmp_path):
    lines = ['{"id":"a","status":"pending","created_at":"2024-01-01T00:00:00Z"}', '{"status":"x"}', '{"id":"b","created_at":"soon"}', "not json", "", "[1]"]
    (tmp_path / "l.jsonl").write_text("\n".join(lines))
    good, bad = ledgers.load_suggestions(spark, str(tmp_path))
    assert [r.id for r in good.collect()] == ["a"] and good.select("status").count() == 1
    assert sorted(r.line for r in bad.collect()) == sorted(x for x in lines[1:] if x)


def test_configurations_of_any_depth(spark):
    document = {"a": {"b": {"c": {"d": {"e": {"f": 1}}}}}, "testCommand": "{venv}/bin/pytest", "empty": {}, "list": [1, {"x": 2}], "on": True, "none": None}
    rows = spark.createDataFrame([("p", json.dumps(document)), ("q", "[1]"), ("r", "no json")], "config_path string, document string")
    got = {r.key_path: r.value for r in ledgers.config_keys(rows).where("scope = 'p'").collect()}
    assert got == {"a.b.c.d.e.f": "1", "testCommand": "{venv}/bin/pytest", "empty": "{}", "list": '[1,{"x":2}]', "on": "true", "none": None}
    assert ledgers.config_keys(rows.limit(0)).count() == 0


def test_configuration_types(spark):
    rows = [("thresholds.maxLines", "1500.5"), ("thresholds.maxLines", "1500"), ("safety.requireTests", "banana"), ("ai", "none"), ("ai.temperature", "0.5"), ("languages.python.enabled", "yes")]
    frame = spark.createDataFrame([("s", *r) for r in rows], "scope string, key_path string, value string")
    got = {(r.key_path, r.value): r.problem for r in configs.config_violations(frame).collect()}
    assert got == {
        ("thresholds.maxLines", "1500.5"): "not an integer",
        ("safety.requireTests", "banana"): "not a boolean",
        ("ai", "none"): "must be an object",
        ("languages.python.enabled", "yes"): "not a boolean",
    }


def test_revision_parents_stay_linear(files):
    body = "from alembic import op\nrevision = 'aaaaaaaaaaaa'\ndown_revision = 'aaaaaaaaaaaa'\ndef upgrade():\n    op.execute('x')\n"
    copies = {f"alembic/versions/c{k}.py": body for k in range(30)} | {"fork/alembic/versions/c.py": body}
    got = dbfiles.revision_parents(files(copies)).collect()
    assert len(got) == 31
    assert {(r.parent_path, r.candidates) for r in got} == {("alembic/versions/c0.py", 30), ("fork/alembic/versions/c.py", 1)}


@pytest.mark.parametrize("master, configured, fails", [("spark://host:7077", None, True), ("local-cluster[2,1,1024]", None, True), ("yarn", "hdfs:///shared/", False), ("local[4]", None, False)])
def test_shared_folder_is_required_on_a_cluster(master, configured, fails):
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: configured), sparkContext=SimpleNamespace(master=master))
    if fails:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(session)
    else:
        assert shared_dir(session) == "hdfs:///shared" if configured else shared_dir(session) != shared_dir(session)


def test_streams_in_several_batches(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    days = sorted({r.day for r in events.selectExpr("CAST(ts AS DATE) AS day").distinct().collect()})
    for k in range(4):  # files in the order of time
        part = days[k * len(days) // 4 : (k + 1) * len(days) // 4]
        events.where(F.col("ts").cast("date").isin(part)).coalesce(1).write.parquet(f"{tmp_path}/{k}")
    stream = ledger_stream.stream_events(spark, f"{tmp_path}/*", events.schema, files_per_batch=1)
    daily = ledger_stream.daily_counts(stream.withColumnRenamed("event_type", "operation_type"))
    rows = ledger_stream.run_to_table(daily, ["day", "operation_type"], "update", "day timestamp, operation_type string, operations bigint")
    want = events.groupBy(F.date_trunc("day", "ts").cast("timestamp").alias("day"), "event_type").count()
    assert sorted(map(tuple, rows.select("day", "operation_type", "operations").collect())) == sorted(map(tuple, want.collect()))


def test_no_row_of_a_stream_goes_unaccounted_for(spark, tmp_path):
    """Four batches with repeated rows and rows behind the watermark: kept, repeated and late rows are all rows."""
    events = spark.createDataFrame([(k, 86400 * (k % 40)) for k in range(400)], "event_id bigint, s bigint").select(
        "event_id", F.timestamp_seconds("s").alias("ts"), F.concat(F.lit("i"), F.col("event_id") % 7).alias("id"), F.lit("pending").alias("status")
    )
    for k, part in enumerate(("event_id % 3 = 0", "event_id % 3 = 1", "event_id % 2 = 0", "true")):
        events.where(part).coalesce(1).write.parquet(f"{tmp_path}/{k}")
    stream = ledger_stream.stream_events(spark, f"{tmp_path}/*", events.schema, files_per_batch=1)
    state = ledger_stream.latest_status(stream, late="10 days")
    rows, counts = ledger_stream.run_counted(state, ["id"], "update", "id string, status string, updated_at timestamp, events bigint")
    got = counts.orderBy("batch").collect()
    assert [r.received for r in got] == [134, 133, 200, 400]
    assert all(r.received == r.kept + r.duplicates + r.late for r in got)
    assert got[2].late > 0 and got[3].late > got[2].late and got[3].duplicates > 0
    assert rows.agg(F.sum("events")).first()[0] == sum(r.kept for r in got)
