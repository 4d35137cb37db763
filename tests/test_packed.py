import os

import pytest
from pyspark.sql import functions as F

from sourceloom.sources import ledgers, trees


def test_packed_texts_are_few_files(spark, tmp_path):
    rows = [(f"a{k % 7}/\u00fc {k}.txt", f"text {k}\n") for k in range(300)] + [("empty", None), (None, "x")]
    texts = spark.createDataFrame(rows, "out_path string, out_content string")
    assert trees.write_texts(texts, str(tmp_path / "t"), packed=True) == 301
    written = [f for _, _, names in os.walk(tmp_path / "t") for f in names]
    assert 0 < len(written) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = trees.scan_tree(spark, str(tmp_path / "t"), defaults=False).withColumn("name", F.substr("rel_path", F.instr("rel_path", "/") + 1))
    assert {r["name"]: r.content for r in found.collect()} == {p: c or "" for p, c in rows if p}
    assert found.count() == 301


def test_packed_path_that_comes_twice_fails(spark, tmp_path):
    texts = spark.createDataFrame([("a", "1"), ("a", "2")], "out_path string, out_content string")
    with pytest.raises(Exception, match="two texts for one path"):
        trees.write_texts(texts, str(tmp_path / "t"), packed=True)
    assert not list(tmp_path.rglob("*.zip"))


def test_configs_of_a_packed_tree(spark, tmp_path):
    rows = [("a/config.json", '{"k": {"m": 1}}'), ("b/config.json", '{"k": ')]
    trees.write_texts(spark.createDataFrame(rows, "out_path string, out_content string"), str(tmp_path / "t"), packed=True)
    loaded = ledgers.configs_in(trees.scan_tree(spark, str(tmp_path / "t"), defaults=False))
    loaded = loaded.withColumn("scope", F.regexp_extract("folder", "([^/]*)$", 1))
    assert [tuple(r) for r in ledgers.config_keys(loaded, "scope").select("scope", "key_path", "value").collect()] == [("a", "k.m", "1")]
    assert [r.scope for r in loaded.where("error IS NOT NULL").collect()] == ["b"]
