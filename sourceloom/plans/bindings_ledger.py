"""Ledgers, configuration layers, diffs and requests derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .bindings import CODE_PATH, documents, table

# shared by Spark and DuckDB
SUGGESTION_STATUS = (
    "CASE o_orderkey % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'approved' WHEN 2 THEN 'rejected' "
    "WHEN 3 THEN 'executed' ELSE 'failed' END"
)
_K = "CAST(o_orderkey AS STRING)"
SUGGESTION_DATA = f"""CASE o_orderkey % 7
    WHEN 0 THEN '{{"suggestions":[]}}'
    WHEN 1 THEN '{{}}'
    WHEN 2 THEN 'not json {{' || {_K}
    WHEN 3 THEN '[' || {_K} || ']'
    WHEN 4 THEN '{{"suggestions":[{{"title":"T' || {_K} || '","description":"' || repeat('Split ' || o_orderpriority || ' ', 12) || '","diff":"@@ -1 +1 @@"}}]}}'
    WHEN 5 THEN '{{"suggestions":[{{"description":"D' || {_K} || '"}},{{"description":"other"}}]}}'
    ELSE '{{"suggestions":[{{"title":null,"diff":"d' || {_K} || '"}}]}}' END"""
EVENT_STATUS = (
    "CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'approved' WHEN 'purchase' THEN 'executed' "
    "WHEN 'error' THEN 'failed' ELSE 'rejected' END"
)
LAYER_KEY = (
    "CASE o_orderkey % 6 WHEN 0 THEN 'thresholds.maxLines' WHEN 1 THEN 'ai' WHEN 2 THEN 'ai.provider' "
    "WHEN 3 THEN 'safety.requireTests' WHEN 4 THEN 'version' ELSE "
    "CASE WHEN o_orderstatus = 'F' THEN 'languages.python.parser' ELSE 'thresholds.bogus' END END"
)
LAYER_VALUE = (
    "CASE o_orderkey % 6 WHEN 0 THEN CAST(o_orderkey % 12000 - 500 AS STRING) WHEN 1 THEN 'none' "
    "WHEN 2 THEN CASE WHEN o_orderstatus = 'F' THEN 'openai' ELSE 'other' END WHEN 3 THEN 'true' "
    "WHEN 4 THEN CASE WHEN o_orderstatus = 'P' THEN '2.x' ELSE '1.0' END "
    "ELSE CASE WHEN o_orderpriority = '5-LOW' THEN 'magic' ELSE 'ast' END END"
)
BASE_LAYER = {
    "thresholds.maxLines": "CAST(1000 + c_custkey % 100 AS STRING)",
    "thresholds.maxFunctions": "CASE WHEN c_nationkey % 4 = 0 THEN 'many' ELSE '60' END",
    "safety": "CASE WHEN c_nationkey % 5 = 0 THEN 'off' END",
    "safety.maxFilesPerOperation": "CASE WHEN c_nationkey % 5 <> 0 THEN '10' END",
    "ai.model": "'m' || CAST(c_nationkey AS STRING)",
    "ai.temperature": "'0.5'",
    "languages.python.testCommand": "CASE c_nationkey % 3 WHEN 0 THEN 'pytest ' WHEN 1 THEN '  ' ELSE 'tox' END",
}


def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        f"'s' || {_K} AS id",
        "'src/f' || CAST(o_custkey AS STRING) || '.py' AS file_path",
        f"{SUGGESTION_DATA} AS data",
        f"{SUGGESTION_STATUS} AS status",
        "CAST(o_orderdate AS TIMESTAMP) AS created_at",
        "o_orderkey AS request",
        "CAST(NULL AS STRING) AS metadata",
    )


def suggestion_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_as_status(table(spark, sf_dir, "events"))


def events_as_status(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        "'s' || CAST(user_id AS STRING) AS id",
        "event_id",
        "CAST(ts AS TIMESTAMP) AS ts",
        f"{EVENT_STATUS} AS status",
        "CASE WHEN event_type IN ('purchase', 'error') THEN 'r' || CAST(event_id AS STRING) END AS execution_result",
        "CASE WHEN event_type = 'click' AND event_id % 2 = 0 THEN 'why' || CAST(event_id AS STRING) END AS reason",
    )


def operation_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id",
        "value",
        "CAST(ts AS TIMESTAMP) AS ts",
        "event_type AS operation_type",
        "md5(CAST(event_id AS STRING)) AS commit_before",
        "CASE WHEN event_id % 4 <> 0 THEN md5('a' || CAST(event_id AS STRING)) END AS commit_after",
        "array('src/u' || CAST(user_id AS STRING) || '.py') AS files_modified",
        "CASE WHEN event_id % 3 = 0 THEN array('new/e' || CAST(event_id AS STRING) || '.py') END AS files_created",
        "CASE WHEN event_id % 2 = 0 THEN props END AS operation_details",
    )


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configuration keys per customer: a base layer, and one layer per order."""
    pairs = ", ".join(f"'{k}', {v}" for k, v in BASE_LAYER.items())
    base = (
        table(spark, sf_dir, "customer")
        .selectExpr("'c' || CAST(c_custkey AS STRING) AS scope", f"stack({len(BASE_LAYER)}, {pairs}) AS (key_path, value)")
        .selectExpr("scope", "CAST(-1 AS BIGINT) AS precedence", "key_path", "value")
        .where("value IS NOT NULL")
    )
    over = table(spark, sf_dir, "orders").selectExpr(
        "'c' || CAST(o_custkey AS STRING) AS scope",
        "o_orderkey AS precedence",
        f"{LAYER_KEY} AS key_path",
        f"{LAYER_VALUE} AS value",
    )
    return base.unionByName(over)


def project_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(
        "'team' || CAST(doc_id % 10 AS STRING) || '/proj' || CAST(doc_id % 50 AS STRING) || '/src/m' || "
        "CAST(doc_id AS STRING) || '.py' AS path"
    )


def project_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    teams = table(spark, sf_dir, "region").selectExpr("'team' || CAST(r_regionkey AS STRING) AS folder")
    projects = table(spark, sf_dir, "nation").selectExpr(
        "'team' || CAST(n_nationkey % 10 AS STRING) || '/proj' || CAST(n_nationkey AS STRING) AS folder"
    )
    return teams.unionByName(projects).selectExpr("folder", "folder || '/config.json' AS config_path")


def diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A diff per code file, with one hunk per ten words; some are empty, missing, misplaced or out of order."""
    hunk = (
        "'@@ -' || CAST(i + 1 AS STRING) || ',2 +' || CAST(i + 1 AS STRING) || ',3 @@ fn\n ctx' || "
        "CAST(length(w) AS STRING) || '\n-old\n+new' || CAST(length(w) AS STRING) || '\n+more'"
    )
    found = f"filter(transform(split(text, ' '), (w, i) -> CASE WHEN i % 10 = 1 THEN {hunk} END), x -> x IS NOT NULL)"
    cut = documents(spark, sf_dir).selectExpr("doc_id", f"{CODE_PATH} AS path", f"explode(array({found})) AS h")
    body = "'--- a/x\n+++ b/x\n' || array_join(CASE WHEN doc_id % 9 = 7 THEN reverse(h) ELSE h END, '\n')"
    return cut.selectExpr(
        "doc_id",
        "CASE WHEN doc_id % 9 = 6 THEN 'gone/' || path ELSE path END AS path",
        f"CASE doc_id % 9 WHEN 4 THEN 'no hunks here' WHEN 5 THEN NULL ELSE {body} END AS diff",
    )
