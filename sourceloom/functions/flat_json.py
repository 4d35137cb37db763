"""Members of JSON documents as flat keys, to any depth, in one pass over the text.

The nesting of a document cannot be opened by a fixed number of expressions, and a round for each level makes the plan grow with
the data. So one step reads the tokens of each document once, in Python workers over Arrow batches, with the open objects on a
stack. Values stay JSON text, cut from the document as written; Spark's own JSON types read them afterwards.
"""

from __future__ import annotations

import json
import re
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

_TOKEN = re.compile(r'"(?:[^"\\]++|\\.)*+"|[{}\[\]:,]|[^\s{}\[\]:,"]++', re.S)


def flat_members(document: str) -> list[dict[str, str]] | None:
    """``key_path`` (names joined by dots) and JSON text of each value of a JSON object; None if the text is no JSON.

    Objects with members are opened; lists and empty objects are values. Of a name that comes twice the last value counts.
    A document that is no object has no members.
    """
    try:
        if not isinstance(json.loads(document), dict):
            return []
    except (ValueError, RecursionError):
        return None
    found: dict[str, str] = {}
    prefixes: list[str] = []  # of the open objects
    names: list[set[str]] = []  # of their members
    name, is_value = "", True  # the root is a value without a name
    lists, start = 0, 0  # depth inside a list, and where the list begins

    for m in _TOKEN.finditer(document):
        token = m[0]
        if lists:
            lists += (token in "[{") - (token in "]}")
            if not lists:
                found[name] = document[start : m.end()]
                is_value = False
        elif token == ":":
            is_value = True
        elif token == ",":
            is_value = False
        elif token == "}":
            path, members = prefixes.pop(), names.pop()
            if not members and prefixes:
                found[path] = "{}"
            is_value = False
        elif not is_value:
            key = json.loads(token)
            name = f"{prefixes[-1]}.{key}" if len(prefixes) > 1 else key
            if key in names[-1]:
                for old in [k for k in found if k == name or k.startswith(f"{name}.")]:
                    del found[old]
            names[-1].add(key)
        elif token == "{":
            prefixes.append(name)
            names.append(set())
            is_value = False
        elif token == "[":
            lists, start = 1, m.start()
        else:
            found[name] = token
            is_value = False
    return [{"key_path": k, "json": v} for k, v in found.items()]


_MEMBERS = ArrayType(StructType([StructField("key_path", StringType()), StructField("json", StringType())]))
_ARROW = pa.list_(pa.struct([("key_path", pa.string()), ("json", pa.string())]))


@arrow_udf(_MEMBERS)
def members(documents: pa.Array) -> pa.Array:
    """``flat_members`` of each document; NULL for NULL and for texts that are no JSON."""
    return pa.array([None if d is None else flat_members(d) for d in documents.to_pylist()], _ARROW)
