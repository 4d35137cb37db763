from pyspark.sql import functions as F

from sourceloom.operators import placement


def test_number_of_tasks_follows_the_files_read_and_not_a_join(spark, tmp_path):
    spark.range(20000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text")).write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    joined = rows.join(rows.groupBy("id").agg(F.count("text").alias("n")), "id")
    assert placement.spread(joined, "id").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_larger_files_give_more_tasks(spark, tmp_path, monkeypatch):
    spark.range(20000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text")).write.parquet(str(tmp_path / "t"))
    monkeypatch.setattr(placement, "TASK_BYTES", 50_000)
    assert placement.spread(spark.read.parquet(str(tmp_path / "t")), "id").rdd.getNumPartitions() > 20
