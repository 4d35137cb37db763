"""Layered configuration: discovery, deep merge, validation and look-ups.

A configuration is a table of flat keys, ``config_kv(scope, precedence, key_path, value)``, with keys such as
``thresholds.maxLines``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as fv
from ..functions.text import dirname, lookup


def nearest_config(files: DataFrame, configs: DataFrame, home: str | None = None) -> DataFrame:
    """Configuration of the closest ancestor folder per file; ``home`` names the lower layer.

    Folders are made distinct first, and each looks for its ancestors by equi-join.
    """
    placed = files.select("path", dirname(F.col("path")).alias("folder"))
    parts = F.split("folder", "/")
    depth = F.when(F.col("folder") == "", 0).otherwise(F.size(parts))
    ancestors = F.transform(
        F.sequence(F.lit(0), depth),
        lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("ancestor")),
    )
    folders = placed.select("folder").distinct().select("folder", F.explode(ancestors).alias("a")).select("folder", "a.*")
    known = configs.select(F.col("folder").alias("ancestor"), "config_path")
    nearest = (
        folders.join(known, "ancestor").groupBy("folder").agg(F.max_by("config_path", "depth").alias("project_config"))
    )
    return placed.join(nearest, "folder", "left").select("path", "project_config", F.lit(home).alias("home_config"))


def _prefixes(key: Column) -> Column:
    """Strict prefixes of a dotted key."""
    parts = F.split(key, "\\.")
    steps = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, lambda k: F.array_join(F.slice(parts, 1, k), "."))


def deep_merge(layers: DataFrame) -> DataFrame:
    """One value per (scope, key): the highest layer wins, objects merge, a scalar replaces an object and vice versa.

    First only the top layer of each key is kept. A key then falls when a prefix of it, or a longer key below it, comes
    from a higher layer. Both tests are equi-joins on (scope, key).
    """
    top = layers.groupBy("scope", "key_path").agg(
        F.max_by("value", "precedence").alias("value"), F.max("precedence").alias("precedence")
    )
    above = top.select("scope", "key_path", F.explode(_prefixes(F.col("key_path"))).alias("prefix"), "precedence")
    longer = above.groupBy("scope", F.col("prefix").alias("key_path")).agg(F.max("precedence").alias("longer"))
    keys = top.select("scope", F.col("key_path").alias("prefix"), F.col("precedence").alias("p"))
    shorter = (
        above.join(keys, ["scope", "prefix"]).groupBy("scope", "key_path").agg(F.max("p").alias("shorter"))
    )
    joined = top.join(longer, ["scope", "key_path"], "left").join(shorter, ["scope", "key_path"], "left")
    beaten = F.greatest("longer", "shorter") > F.col("precedence")
    return joined.where(~F.coalesce(beaten, F.lit(False))).select("scope", "key_path", "value", "precedence")


def merged_document(merged: DataFrame) -> DataFrame:
    """Merged keys of a scope as one map. Keys are unique, and a configuration has few of them."""
    entries = F.map_from_entries(F.sort_array(F.collect_list(F.struct("key_path", "value"))))
    return merged.groupBy("scope").agg(entries.alias("config"))


def _rules(key: Column, value: Column) -> Column:
    number = value.try_cast("double")
    low = lookup({k: str(r[0]) for k, r in fv.CONFIG_RANGES.items()}, key).cast("double")
    high = lookup({k: str(r[1]) for k, r in fv.CONFIG_RANGES.items()}, key).cast("double")
    span = F.concat(
        F.lit("must lie between "), low.cast("bigint").cast("string"), F.lit(" and "), high.cast("bigint").cast("string")
    )
    language = key.rlike(r"^languages\.[^.]+\.(?:enabled|parser|testCommand)$")
    return (
        F.when(key.isin(*fv.CONFIG_SECTIONS), "must be an object")
        .when(low.isNotNull() & number.isNull(), "not a number")
        .when(low.isNotNull() & (key != "ai.temperature") & (number != F.floor(number)), "not an integer")
        .when((key.isin(*fv.CONFIG_FLAGS) | key.rlike(r"^languages\.[^.]+\.enabled$")) & ~F.lower(value).isin("true", "false"), "not a boolean")
        .when(low.isNotNull() & ((number < low) | (number > high)), span)
        .when((key == "ai.provider") & ~value.isin(*fv.PROVIDERS), "Provider must be one of " + ", ".join(fv.PROVIDERS))
        .when(
            language & F.endswith(key, F.lit(".parser")) & ~value.isin(*fv.PARSERS),
            "Parser must be one of " + ", ".join(fv.PARSERS),
        )
        .when((key == "version") & ~value.rlike(r"^\d+\.\d+$"), "Version must be in format 'X.Y'")
        .when(
            low.isNull() & ~language & ~key.isin("ai.provider", "version", *fv.CONFIG_FREE_KEYS),
            "Extra inputs are not permitted",
        )
    )


def config_violations(config: DataFrame) -> DataFrame:
    """Keys that break a rule or are unknown, with the reason and a formatted line."""
    problem = _rules(F.col("key_path"), F.col("value"))
    found = config.withColumn("problem", problem).where(F.col("problem").isNotNull())
    location = F.replace("key_path", F.lit("."), F.lit(" -> "))
    return found.select(
        "scope", "key_path", "value", "problem", F.concat(location, F.lit(": "), F.col("problem")).alias("text")
    )


def test_commands(requests: DataFrame, config: DataFrame) -> DataFrame:
    """Test command per (scope, language); an empty or missing one is an error."""
    key = r"^languages\.([^.]+)\.testCommand$"
    commands = config.where(F.col("key_path").rlike(key)).select(
        "scope", F.regexp_extract("key_path", key, 1).alias("language"), F.trim("value").alias("command")
    )
    joined = requests.select("scope", "language").join(commands, ["scope", "language"], "left")
    command = F.nullif(F.col("command"), F.lit(""))
    missing = F.concat(F.lit("No test command configured for language: "), F.col("language"))
    return joined.select(
        "scope", "language", command.alias("test_command"), F.when(command.isNull(), missing).alias("error")
    )
