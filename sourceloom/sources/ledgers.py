"""Loading and saving of suggestion and operation ledgers and of configuration files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.flat_json import members

SUGGESTIONS = (
    "id string, file_path string, data string, status string, created_at timestamp, updated_at timestamp, "
    "metadata string, execution_result string"
)
OPERATIONS = (
    "operation_id string, operation_type string, timestamp timestamp, backup_branch string, commit_before string, "
    "commit_after string, files_modified array<string>, files_created array<string>, operation_details string, "
    "rolled_back boolean"
)


def load_suggestions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Records of a JSON-lines ledger, and its corrupt lines (set aside, not erased).

    Every line that is not blank is in exactly one of the two: it is parsed once, and what is not whole JSON of the right
    types, or has no id, is set aside as it was written.
    """
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.col("value").alias("line"))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = lines.select("line", F.from_json("line", SUGGESTIONS + ", _corrupt string", options).alias("r"))
    good = F.coalesce(F.col("r._corrupt").isNull() & F.col("r.id").isNotNull(), F.lit(False))
    return parsed.where(good).select("r.*").drop("_corrupt"), parsed.where(~good).select("line")


def load_suggestion_object(spark: SparkSession, path: str) -> DataFrame:
    """Records of a ledger kept as one JSON object with the ids as keys. One task parses it: for the import of small files."""
    whole = spark.read.text(path, wholetext=True)
    records = F.from_json("value", "map<string,string>")
    return (
        whole.select(F.explode(records).alias("id", "record"))
        .select(F.from_json("record", SUGGESTIONS).alias("r"))
        .select("r.*")
    )


def _by_month(rows: DataFrame, ts: str) -> DataFrame:
    """Rows with their month, gathered into few files per month; a very large month is split."""
    return rows.withColumn("month", F.date_format(ts, "yyyy-MM")).hint("rebalance", "month")


def save_suggestions(records: DataFrame, path: str) -> None:
    """Appends records, partitioned by month; nothing already written is touched."""
    _by_month(records, "created_at").write.mode("append").partitionBy("month").parquet(path)


def read_saved_suggestions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("month")


def load_operations(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSON-lines operation ledger; a corrupt line is an error."""
    return spark.read.schema(OPERATIONS).option("mode", "FAILFAST").json(path)


def save_operations(operations: DataFrame, path: str) -> None:
    _by_month(operations, "timestamp").write.mode("append").partitionBy("month").parquet(path)


def clear_operations(spark: SparkSession, path: str, confirm: bool = False) -> None:
    """Empties a saved operation ledger; refused unless confirmed."""
    if not confirm:
        raise ValueError("Must set confirm=True to clear history. This action is permanent.")
    # partitionOverwriteMode is pinned: a dynamic overwrite with no rows would keep every month
    empty = spark.createDataFrame([], OPERATIONS + ", month string")
    empty.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("month").parquet(path)


def load_configs(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Configuration files as (config_path, folder, document, error); invalid JSON gives an error. Spark skips files of no bytes.

    The driver lists the files; for very many there is ``trees.scan_tree``, then ``configs_in``.
    """
    texts = spark.read.text(paths, wholetext=True).select(
        F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))).alias("config_path"), "value"
    )
    return configs_in(texts.withColumnRenamed("config_path", "path").withColumnRenamed("value", "content"))


def configs_in(files: DataFrame) -> DataFrame:
    """``load_configs`` of files (path, content) that are read already, as by ``trees.scan_tree``, whose tasks list the files."""
    invalid = F.concat(F.lit("Invalid JSON in configuration file "), F.col("path"))
    return files.select(
        F.col("path").alias("config_path"),
        F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"),
        F.col("content").alias("document"),
        F.when(members(F.col("content")).isNull(), invalid).alias("error"),
    )


def config_keys(configs: DataFrame, scope: str = "config_path", precedence: int = 0) -> DataFrame:
    """Flat keys of configuration documents. Objects are opened by their JSON type, to any depth; lists stay values.

    A text that looks like an object stays a text, and an empty object is a key with the value ``{}``. Each document is read
    once; documents that are no JSON have no keys.
    """
    if "error" in configs.columns:
        configs = configs.where(F.col("error").isNull())
    keys = configs.select(F.col(scope).alias("scope"), F.explode(members(F.col("document"))).alias("m"))
    json = F.col("m.json")
    value = F.when(json != "null", F.coalesce(F.try_parse_json(json).cast("string"), json))
    return keys.select("scope", F.col("m.key_path").alias("key_path"), value.alias("value"), F.lit(precedence).alias("precedence"))
