"""Trees read and written by tasks, and configuration documents of any shape."""

import json
import os
import random
import tarfile
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from sourceloom.functions.flat_json import flat_members
from sourceloom.sources import files as spark_files
from sourceloom.sources import ledgers, trees


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    texts = {"a.py": "x = 1\n", "src/b.js": "let b;", "src/deep/er/c.sql": "SELECT 1;", "node_modules/d.js": "no", "src/__pycache__/e.py": "no", "odd name %41+é.py": "y", "src/f.txt": ""}
    for name, text in texts.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (root / "bytes.py").write_bytes(b"z = '\xff'\r\n")
    os.symlink(root, root / "loop")
    with zipfile.ZipFile(root / "src/packed.zip", "w") as packed:
        for name in ("in/g.py", "node_modules/h.py", "../../i.py"):
            packed.writestr(name, f"# {name}")
    with tarfile.open(root / "p.tar.gz", "w:gz") as packed:
        packed.add(root / "src/b.js", "t/b.js")
    (root / "broken.zip").write_bytes(b"PK no")
    return str(root)


@pytest.mark.parametrize("folders", [1, 3, 1000])
def test_scan_of_a_tree(spark, tree, folders):
    rows = trees.scan_tree(spark, tree, folders=folders).collect()
    got = {r.rel_path: r.content for r in rows}
    assert len(rows) == len(got)
    assert got == {
        "a.py": "x = 1\n",
        "src/b.js": "let b;",
        "src/deep/er/c.sql": "SELECT 1;",
        "odd name %41+é.py": "y",
        "src/f.txt": "",
        "bytes.py": "z = ''\r\n",
        "src/packed.zip/in/g.py": "# in/g.py",
        "src/packed.zip/i.py": "# ../../i.py",
        "p.tar.gz/t/b.js": "let b;",
    }
    others = ["*.zip", "*.gz", "loop/**"]  # Spark's own listing follows the link
    plain = trees.scan_tree(spark, tree, others, archives=False, folders=folders)
    old = spark_files.read_tree(spark, tree, others)  # which has no files without bytes
    key = lambda frame: sorted(map(tuple, frame.select("path", "rel_path", "ext", "language", "content", "size").collect()))
    assert key(plain.where("size > 0")) == key(old) and plain.columns == old.columns


def test_missing_and_empty_folders(spark, tmp_path):
    assert trees.scan_tree(spark, str(tmp_path / "none")).count() == 0
    assert trees.scan_tree(spark, str(tmp_path)).count() == 0
    assert trees.scan_tree(spark, f"file:{tmp_path}").count() == 0


def test_driver_opens_a_bounded_number_of_folders(tmp_path):
    for k in range(40):
        (tmp_path / f"d{k}/e/f").mkdir(parents=True)
    parts = trees._Reader(str(tmp_path), 30).partitions()
    assert sum(len(p.shallow) for p in parts) == 1 and sum(len(p.deep) for p in parts) == 40
    assert len(trees._Reader(str(tmp_path), 10_000).partitions()) == 121


def test_written_files_are_read_back(spark, tmp_path):
    rows = [(f"a{k % 7}/b/f{k}.txt", f"text {k}\né") for k in range(300)] + [("empty.txt", None), ("./x/../plain.txt", "p"), (None, "left out")]
    frame = spark.createDataFrame(rows, "out_path string, out_content string").repartition(5)
    (tmp_path / "out").mkdir()
    (tmp_path / "out/plain.txt").write_text("old")
    assert trees.write_texts(frame, str(tmp_path / "out")) == 302
    got = {r.rel_path: r.content for r in trees.scan_tree(spark, str(tmp_path / "out"), defaults=False).collect()}
    assert got == {p: t or "" for p, t in rows[:301]} | {"plain.txt": "p"}
    assert not any(x.startswith("_staging") for x in os.listdir(tmp_path / "out"))
    assert trees.write_texts(frame.limit(0), str(tmp_path / "none")) == 0


@pytest.mark.parametrize("bad", ["../out.txt", "/abs.txt", "a/../../b", ".", "twice.txt"])
def test_refused_paths_write_nothing(spark, tmp_path, bad):
    rows = [("good.txt", "g"), ("twice.txt", "t"), (bad, "b")]
    with pytest.raises(Exception, match="path"):
        trees.write_texts(spark.createDataFrame(rows, "out_path string, out_content string"), str(tmp_path / "out"))
    assert trees.scan_tree(spark, str(tmp_path / "out")).count() == 0


def test_attempts_that_fail_are_not_published(spark, tmp_path):
    """A task that fails once leaves its staged files behind; the second attempt's files are those published."""
    flag = tmp_path / "failed"

    def once(batches):
        import pathlib

        import pyarrow as pa

        for batch in batches:
            yield batch
        if not pathlib.Path(str(flag)).exists():
            pathlib.Path(str(flag)).touch()
            raise RuntimeError("first attempt")
        yield pa.RecordBatch.from_arrays([pa.array(["last.txt"]), pa.array(["l"])], ["out_path", "out_content"])

    rows = spark.createDataFrame([(f"f{k}.txt", str(k)) for k in range(20)], "out_path string, out_content string").coalesce(1)
    try:
        trees.write_texts(rows.mapInArrow(once, "out_path string, out_content string"), str(tmp_path / "out"))
    except Exception:  # local masters do not repeat tasks: nothing may be there then
        assert trees.scan_tree(spark, str(tmp_path / "out")).count() == 0
        trees.write_texts(rows.mapInArrow(once, "out_path string, out_content string"), str(tmp_path / "out"))
    assert trees.scan_tree(spark, str(tmp_path / "out")).count() == 21


# ----- configuration documents ------------------------------------------------------------------------------------


def flattened(value, path=""):
    if isinstance(value, dict) and (value or not path):
        return {k: v for name, x in value.items() for k, v in flattened(x, f"{path}.{name}" if path else name).items()}
    return {path: value}


def document(rng, depth):
    pick = rng.randrange(8 if depth else 6)
    if pick < 6:
        return [1, -2.5, "t{]\"\\", None, True, rng.choice([[], {}, [{"a": [1, "]"]}, "}"], "é\n", 10**20])][pick]
    return {rng.choice(["a", "b.c", "d\"", "é", ""]): document(rng, depth - 1) for _ in range(rng.randrange(4))}


def test_members_are_those_of_the_parser():
    rng = random.Random(5)
    for _ in range(500):
        value = {"root": document(rng, 5), "x": document(rng, 3)}
        text = json.dumps(value, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 2]))
        got = {m["key_path"]: json.loads(m["json"]) for m in flat_members(text)}
        assert got == flattened(value)
    assert flat_members('{"a":{"x":1,"y":2},"a":{"z":3},"b":1,"b":2}') == [{"key_path": "a.z", "json": "3"}, {"key_path": "b", "json": "2"}]
    assert flat_members("[1]") == flat_members("1") == flat_members("{}") == []
    assert flat_members("{") is None and flat_members("") is None and flat_members("{'a': 1}") is None


def test_deep_and_odd_configuration_files(spark, tmp_path):
    deep = '{"k":' * 500 + "1" + "}" * 500
    texts = {"a": deep, "b": json.dumps({"t": "{" * 5000, "e": {}, "n": None, "l": [1, {"x": 2}], "f": 1.50}), "c": "{broken", "d": "[1]", "e": " ", "f": '{"a": NaN}'}
    for name, text in texts.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "config.json").write_text(text)
    start = time.time()
    loaded = ledgers.load_configs(spark, f"{tmp_path}/*/config.json").withColumn("name", F.regexp_extract("folder", "([^/]*)$", 1))
    errors = {r.name: r.error for r in loaded.collect()}
    assert {k for k, e in errors.items() if e} == {"c", "e"} and errors["c"].startswith("Invalid JSON in configuration file ")
    got = {(r.scope, r.key_path): r.value for r in ledgers.config_keys(loaded, "name").collect()}
    assert got == {
        ("a", ".".join("k" * 500)): "1",
        ("b", "t"): "{" * 5000,
        ("b", "e"): "{}",
        ("b", "n"): None,
        ("b", "l"): '[1,{"x":2}]',
        ("b", "f"): "1.5",
        ("f", "a"): "NaN",
    }
    assert time.time() - start < 30
