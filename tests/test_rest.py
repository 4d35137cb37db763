"""Globs, database files, migrations, diffs, ledgers, configuration, sources and streams."""

import json

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sourceloom.functions import globs, ormtext, sql_functions, sqltext, text
from sourceloom.operators import blocks, configs, dbfiles, diffs, ledger, migrations, prompts
from sourceloom.sources import files as tree, ledgers


@pytest.mark.parametrize(
    "path,pattern,hit",
    [
        ("a/node_modules/x/y.js", "**/node_modules/**", True),
        ("node_modules/x", "**/node_modules/**", True),
        ("src/test.py", "test.py", True),
        ("a/b/test_x.py", "test_*.py", True),
        ("tests/a.py", "tests/**", True),
        ("src/x.py", "src/**/*.py", False),
        ("srcq/tests/x.py", "src/**/x.py", True),
        ("a.pyc", "**/*.pyc", True),
        ("a+b.py", "a+b.py", True),
        ("b.py", "[!a].py", True),
    ],
)
def test_globs(spark, path, pattern, hit):
    assert spark.range(1).select(globs.excluded(F.lit(path), [pattern])).first()[0] is hit


def test_module_paths(spark):
    rows = [("src/a/m.py", "src/a/h.py", ".h"), ("src/m.py", "src/u/v/h.py", ".u.v.h"), ("src/a/b/m.py", "src/h.py", "...h"), ("x/m.py", "y/h.py", "h")]
    got = spark.createDataFrame(rows, "a string, b string, w string").select(text.module_path(F.col("a"), F.col("b")), "w")
    assert all(r[0] == r[1] for r in got.collect())


def test_tree_source(spark, tmp_path):
    (tmp_path / "src dir").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src dir" / "a+b.py").write_bytes(b"x = 1\r\n\xff\xfey = 2")
    (tmp_path / "node_modules" / "z.js").write_text("let a;")
    got = tree.read_tree(spark, str(tmp_path)).collect()
    assert [(r.rel_path, r.ext, r.content) for r in got] == [("src dir/a+b.py", ".py", "x = 1\r\ny = 2")]
    assert tree.read_tree(spark, str(tmp_path / "none")).count() == 0
    lines = tree.file_lines(tree.read_tree(spark, str(tmp_path))).collect()
    assert [(r.line_no, r.text) for r in sorted(lines)] == [(1, "x = 1"), (2, "y = 2")]


def test_sql_text(spark, files):
    script = "-- c\nCREATE TABLE a (\n  id INT\n);\n\nINSERT INTO `b` VALUES (1);  \nSELECT * FROM a JOIN c ON 1 WHERE x IN (SELECT 1)"
    row = dbfiles.sql_analysis(files({"s.sql": script})).first()
    assert list(row.tables) == ["a", "b", "c"] and list(row.statements) == ["CREATE", "INSERT", "SELECT"]
    assert row.complexity == 2 * 3 + 3 + 1 + 5 and row.line_count == 7
    got = [r.statement for r in migrations.sql_statements(files({"s.sql": script})).orderBy("n").collect()]
    assert got[0] == "CREATE TABLE a (\n  id INT\n);" and len(got) == 3 and got[2].startswith("SELECT")
    # no match and long input: stays linear
    long = "SELECT x FROM y " * 20000
    assert spark.createDataFrame([(long,)], "c string").select(sqltext.has_subquery(F.col("c"))).first()[0] is False
    missing = dbfiles.sql_analysis(spark.createDataFrame([("p.sql", None)], "path string, content string")).first()
    assert missing.error and missing.complexity == 0


def test_split_sql_preserves_statements(files):
    script = "\n".join(f"CREATE TABLE t{k} (id INT);" for k in range(10)) + "\nALTER TABLE t1 ADD COLUMN c INT;\n"
    parts = migrations.split_sql(files({"db/m.sql": script}), 3).orderBy("part").collect()
    assert [p.statements for p in parts] == [3, 3, 3, 2] and parts[0].out_path == "db/m_part1.sql"
    assert "\n".join(p.out_content for p in parts).replace("\n\n", "\n") == script.strip()
    undo = migrations.sql_rollbacks(files({"db/m.sql": script})).first()["rollback"].split("\n\n")
    assert undo[0] == "ALTER TABLE t1 DROP COLUMN c;" and undo[1] == "DROP TABLE IF EXISTS t9;" and len(undo) == 11
    assert migrations.split_sql(files({"a.sql": "SELECT 1;\nSELECT 2;"}), 3).count() == 0


def test_django_split(files):
    ops = "".join(
        f"        migrations.AddField(\n            'm', 'f{k}', models.CharField(choices=[(1, 'a'), ]),\n        ),\n" for k in range(8)
    )
    source = "from django.db import migrations, models\n\nclass Migration(migrations.Migration):\n    dependencies = [('app', '0001_initial')]\n    operations = [\n" + ops + "    ]\n"
    made = files({"app/migrations/0002_more.py": source, "app/migrations/0003.py": source.replace("    ]\n", "", 1)})
    parts = migrations.split_django(made, 3).orderBy("part").collect()
    assert [p.operations for p in parts] == [3, 3, 2]
    assert [p.depends_on for p in parts] == ["('app', '0001_initial')", "('migrations', '0002_more_part1')", "('migrations', '0002_more_part2')"]
    outcome = {r.path: r for r in migrations.split_dispatch(made, 3).collect()}
    assert outcome["app/migrations/0002_more.py"].split_files == 3
    assert outcome["app/migrations/0003.py"].message == migrations.UNSPLIT_DJANGO


def test_database_types(files):
    made = files(
        {
            "schema.SQL": "select 1",
            "app/models.py": "from django.db import models\nclass U(models.Model):\n  pass\n",
            "t.py": "from sqlalchemy import C\nclass U(Base):\n  __tablename__ = 'us'\n",
            "migrations/0001_initial.py": "from django.db import migrations",
            "alembic/versions/x.py": "from alembic import op\nrevision = 'abc'\ndown_revision = None\nop.create_table('t')",
            "utils.py": "x = 1",
        }
    )
    kinds = {r.path: r.file_type for r in dbfiles.typed(made).collect()}
    assert list(kinds.values()) == ["sql_file", "django_model", "sqlalchemy_model", "migration_file", "alembic_migration", "unknown"]
    found = {r.path: r for r in dbfiles.analysis(made).collect()}
    assert "utils.py" not in found and list(found["app/models.py"].models) == ["U"] and list(found["t.py"].tables) == ["us"]
    assert found["alembic/versions/x.py"].revision == "abc" and found["alembic/versions/x.py"].down_revision is None


def test_query_extraction(files):
    made = files({"a.py": 'q = """SELECT id\nFROM users"""\nr = q', "b.py": "x = 1"})
    rows = {r.path: r for r in migrations.extract_query(made, "Get Users").collect()}
    assert rows["a.py"].view_name == "view_get_users" and "SELECT * FROM view_get_users" in rows["a.py"].modified_content
    assert rows["b.py"].error


def _apply(original: str, diff: str) -> str:
    """Plain restatement of sequential hunk application, last hunk first."""
    import re

    lines = original.splitlines(keepends=True)
    found, current = [], None
    for line in diff.split("\n"):
        head = re.match(r"@@ -(\d+)(?:,(\d+))? \+\d+(?:,\d+)? @@", line)
        if head:
            current = (int(head[1]), int(head[2] or 1), [])
            found.append(current)
        elif current and not line.startswith("@@"):
            current[2].append(line)
    for start, count, body in reversed(found):
        begin = max(start - 1, 0)
        lines[begin : begin + count] = [x[1:] + "\n" for x in body if x[:1] == " " or (x[:1] == "+" and x[:3] != "+++")]
    return "".join(lines)


def test_patches_match_sequential_application(spark, files):
    original = "".join(f"l{k}\n" for k in range(1, 21))
    hunk = lambda at, n: f"@@ -{at},{n} +{at},2 @@ f\n l{at}\n-x\n+new{at}\n\n+++keep"
    cases = {
        "plain": "--- a\n+++ b\n" + hunk(3, 2) + "\n" + hunk(9, 1),
        "reversed": hunk(9, 2) + "\n" + hunk(3, 2),
        "overlap": hunk(3, 4) + "\n" + hunk(5, 2),
        "end": hunk(20, 5),
        "top": "@@ -0,0 +1,2 @@\n+a\n+b",
        "same": hunk(4, 0) + "\n" + hunk(4, 0),
    }
    requests = spark.createDataFrame(
        list(cases.items()) + [("none", "no hunks"), ("empty", None), ("gone", "x")], "path string, diff string"
    )
    got = {r.path: r for r in diffs.apply_patches(requests, files({k: original for k in [*cases, "none", "empty"]})).collect()}
    for name, diff in cases.items():
        assert got[name].patched == _apply(original, diff), name
    assert got["none"].error == diffs.NO_HUNKS and got["gone"].error.startswith("File not found") and "diff" in got["empty"].error


def test_revision_chains_by_jumps(files):
    """A chain of 10,000, a star, two cycles with files that lead into them, a missing predecessor, and a folder of its own."""
    down = {f"c{k}": f"c{k - 1}" if k else None for k in range(10_000)}
    down |= {"s": None} | {f"s{k}": "s" for k in range(50)} | {"gone": "nowhere", "gone2": "gone"}
    down |= {"x": "y", "y": "z", "z": "x", "into": "x", "into2": "into", "self": "self"}
    head = "from alembic import op\n"
    body = lambda r, d: f"{head}revision = '{r}'\ndown_revision = {d!r}\ndef upgrade():\n    op.execute('x')\n"
    made = files({f"alembic/versions/{r}.py": body(r, d) for r, d in down.items()} | {"fork/alembic/versions/c5.py": body("c5", "c4")})
    got = {r.path: (r.first_path, r.steps, r.ends) for r in dbfiles.revision_chains(made.repartition(4)).collect()}
    want = {"fork/alembic/versions/c5.py": ("fork/alembic/versions/c5.py", 0, "missing")}
    for revision in down:
        at, steps, seen = revision, 0, set()
        while down[at] is not None and down[at] in down and at not in seen:
            seen.add(at)
            at, steps = down[at], steps + 1
        cycle = at in seen
        first = f"alembic/versions/{at}.py"
        want[f"alembic/versions/{revision}.py"] = (None, None, "cycle") if cycle else (first, steps, "root" if down[at] is None else "missing")
    assert got == want
    assert dbfiles.revision_chains(made.limit(0)).count() == 0


@pytest.mark.parametrize("times", [1000, 1])
@pytest.mark.parametrize("tasks", [1, 3, 16])
def test_look_back_along_ranges_agrees_with_plain_window(spark, times, tasks):
    """A hot key, all of its rows at one time or not, null keys and times, and batches of few rows."""
    kinds = F.element_at(F.array(*map(F.lit, ["pending", "approved", "failed", "executed", "rejected"])), (F.col("id") * 7 % 5 + 1).cast("int"))
    events = spark.range(4000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 7, None).otherwise(F.concat(F.lit("k"), (F.col("id") % 90).cast("string"))).alias("key"),
        F.col("id").alias("event_id"),
        F.when(F.col("id") % 41 != 0, F.timestamp_seconds(F.col("id") * 13 % times)).alias("ts"),
        kinds.alias("status"),
    ).withColumnRenamed("key", "id")
    values = {"some": F.when(F.col("event_id") % 11 == 0, F.col("status")), "number": F.when(F.col("event_id") % 400 == 3, F.col("event_id"))}
    earlier = W.partitionBy("id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, -1)
    want = events.select("*", *[F.last(v, True).over(earlier).alias(n) for n, v in values.items()])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 70)
    try:
        found = blocks.last_before(events.repartition(5), "id", "ts", "event_id", values, tasks)
        assert found.columns == want.columns
        got = sorted(map(tuple, found.collect()), key=str)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == sorted(map(tuple, want.collect()), key=str)
    assert blocks.last_before(events.limit(0), "id", "ts", "event_id", values, tasks).count() == 0


def test_one_key_is_spread_over_ranges(spark):
    """All rows have one key and one time, and no range has most of them."""
    events = spark.range(5000).select(F.lit("k").alias("id"), F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1)).alias("ts"), F.lit("approved").alias("status"))
    found = blocks.last_before(events, "id", "ts", "event_id", {"decided": F.col("status")}, 8)
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 1500 and found.where("decided IS NULL").count() == 1


def test_suggestion_ledger(spark, tmp_path):
    data = json.dumps({"suggestions": [{"description": "x" * 150, "title": "T", "diff": "d"}]})
    rows = [(k, "t%d.py" % (k % 2), data if k else "[1]", f"2024-01-0{k + 1} 00:00:00", None) for k in range(4)]
    made = spark.createDataFrame(rows, "request int, file_path string, data string, created_at string, metadata string")
    accepted, rejected = ledger.ingest(made.withColumn("created_at", F.to_timestamp("created_at")))
    assert accepted.count() == 3 and rejected.count() == 1 and ledger.duplicate_ids(accepted).count() == 0
    listed = ledger.listing(accepted, limit=2).collect()
    assert len(listed) == 2 and len(listed[0].summary) == 100 and listed[0].created_at > listed[1].created_at
    assert ledger.expired(accepted, "2024-01-10 12:00:00", None, 8).count() == 1
    assert ledger.clear(accepted, "2024-01-10 12:00:00", None, 8).count() == 2
    assert ledger.clear(accepted, "2024-01-10 12:00:00").count() == 0
    stats = {r.status: r.suggestions for r in ledger.statistics_by_status(accepted).collect()}
    assert stats == {"pending": 3, "approved": 0, "rejected": 0, "executed": 0, "failed": 0}
    ledgers.save_suggestions(accepted, str(tmp_path / "s"))
    ledgers.save_suggestions(accepted, str(tmp_path / "s"))
    assert ledgers.read_saved_suggestions(spark, str(tmp_path / "s")).count() == 6
    (tmp_path / "s.json").write_text('{"id": "a", "status": "pending"}\n{broken\n')
    good, bad = ledgers.load_suggestions(spark, str(tmp_path / "s.json"))
    assert good.count() == 1 and bad.count() == 1
    (tmp_path / "whole.json").write_text(json.dumps({"x1": {"id": "x1", "status": "failed", "data": {"k": 1}}}))
    assert ledgers.load_suggestion_object(spark, str(tmp_path / "whole.json")).first()["data"] == '{"k":1}'


def test_operation_ledger(spark, tmp_path):
    (tmp_path / "bad.json").write_text('{"operation_id": "1"}\n{oops\n')
    with pytest.raises(Exception):
        ledgers.load_operations(spark, str(tmp_path / "bad.json")).collect()
    requests = spark.createDataFrame(
        [("2024-01-02 03:04:05.123456", "x", "a", None, ["m.py"], None, None)],
        "ts string, operation_type string, commit_before string, commit_after string, files_modified array<string>, files_created array<string>, operation_details string",
    ).withColumn("ts", F.to_timestamp("ts"))
    recorded = ledger.record_operations(requests)
    row = recorded.first()
    assert row.operation_id == "20240102030405123456" and row.backup_branch == "backup-20240102030405" and row.files_created == []
    path = str(tmp_path / "ops")
    ledgers.save_operations(recorded, path)
    assert spark.read.parquet(path).count() == 1
    with pytest.raises(ValueError):
        ledgers.clear_operations(spark, path)
    ledgers.clear_operations(spark, path, confirm=True)
    assert spark.read.schema(ledgers.OPERATIONS).parquet(path).count() == 0


def test_configuration(spark, tmp_path):
    layers = spark.createDataFrame(
        [
            ("p", 1, "thresholds.maxLines", "2000"),
            ("p", 1, "thresholds.maxFunctions", "60"),
            ("p", 2, "thresholds.maxLines", "1500"),
            ("p", 1, "ai.model", "m"),
            ("p", 2, "ai", "off"),
            ("p", 1, "safety", "off"),
            ("p", 2, "safety.maxFilesPerOperation", "5"),
        ],
        "scope string, precedence int, key_path string, value string",
    )
    got = {r.key_path: r.value for r in configs.deep_merge(layers).collect()}
    assert got == {"thresholds.maxLines": "1500", "thresholds.maxFunctions": "60", "ai": "off", "safety.maxFilesPerOperation": "5"}
    values = [("thresholds.maxLines", v) for v in ("-100", "0", "15000", "1500")] + [("version", "1"), ("nope", "1"), ("ai.provider", "google")]
    bad = configs.config_violations(spark.createDataFrame([("s", k, v) for k, v in values], "scope string, key_path string, value string"))
    assert sorted((r.key_path, r.value) for r in bad.collect()) == sorted(values[:3] + [("version", "1"), ("nope", "1")])
    (tmp_path / "c.json").write_text('{"a": {"b": {"c": 1}, "d": [1, {"x": 2}]}, "e": "t"}')
    (tmp_path / "bad.json").write_text("{oops")
    loaded = ledgers.load_configs(spark, str(tmp_path))
    assert loaded.where("error IS NOT NULL").count() == 1
    flat = {r.key_path: r.value for r in ledgers.config_keys(loaded).collect()}
    assert flat == {"a.b.c": "1", "a.d": '[1,{"x":2}]', "e": "t"}


def test_nearest_config(spark):
    made = spark.createDataFrame([("a/b/c/x.py",), ("a/y.py",), ("z.py",), ("q/w.py",)], "path string")
    known = spark.createDataFrame([("a", "a/c.json"), ("a/b", "a/b/c.json"), ("q/r", "q/r/c.json")], "folder string, config_path string")
    got = {r.path: r.project_config for r in configs.nearest_config(made, known).collect()}
    assert got == {"a/b/c/x.py": "a/b/c.json", "a/y.py": "a/c.json", "z.py": None, "q/w.py": None}
    rooted = known.unionByName(spark.createDataFrame([("", "c.json")], "folder string, config_path string"))
    assert {r.path: r.project_config for r in configs.nearest_config(made, rooted).collect()}["z.py"] == "c.json"


def test_prompts(files):
    made = files({"t.py": "x = 1"}).withColumn("strategy", F.lit("AUTO"))
    numbers = made.select("path", F.lit(100).alias("loc"), F.lit(5).alias("function_count"), F.lit(None).cast("double").alias("cyclomatic_complexity"))
    text_ = prompts.render_prompts(made, numbers).first()["prompt"]
    assert "t.py" in text_ and "Lines of Code: 100" in text_ and "Function Count: 5" in text_ and "Complexity: N/A" in text_
    assert "automatically determine the best refactoring approach" in text_
    bare = prompts.render_prompts(made.withColumn("strategy", F.lit("nope")), numbers.where("false")).first()
    assert bare["prompt"] is None and "Invalid strategy" in bare["error"]


def test_sql_functions(spark):
    sql_functions.register(spark)
    assert spark.sql("SELECT complexity_grade(12), size_severity(250, 100)").first()[:] == ("C", "high")
    assert [r.text for r in spark.sql("SELECT text FROM text_lines('a\\r\\nb') ORDER BY line_no").collect()] == ["a", "b"]


def test_every_query_has_reference_sql():
    from sourceloom.plans.oracles import ORACLES
    from sourceloom.plans.queries import QUERIES

    assert set(QUERIES) == set(ORACLES)
