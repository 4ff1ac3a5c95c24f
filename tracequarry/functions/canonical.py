"""Byte-exact JSON: canonical text, hashes, flattening.

``to_json`` of a VARIANT doesn't keep ``1`` and ``1.0`` apart, so these are Arrow functions.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from hashlib import sha256
from typing import Any

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf, udtf
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from tracequarry.config import EXCLUDED_FIELDS, MAX_VALUE_CHARS, VOLATILE_FIELDS


def canonical(value: Any) -> str:
    """Compact JSON with sorted keys."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"))


def without(value: Any, names: frozenset[str]) -> Any:
    """A copy without the named keys at any depth."""
    if isinstance(value, dict):
        return {k: without(v, names) for k, v in value.items() if k not in names}
    if isinstance(value, list):
        return [without(v, names) for v in value]
    return value


def shortened(value: Any, most: int = MAX_VALUE_CHARS) -> Any:
    """Strings of over ``most`` characters become a note of their length."""
    if isinstance(value, str):
        return value if len(value) <= most else f"<{len(value)} chars omitted>"
    if isinstance(value, dict):
        return {k: shortened(v, most) for k, v in value.items()}
    if isinstance(value, list):
        return [shortened(v, most) for v in value]
    return value


def flat_items(value: dict[str, Any], prefix: str = "") -> Iterator[tuple[str, Any]]:
    """Dotted keys of nested objects. Lists are values; empty objects leave nothing."""
    for k, v in value.items():
        key = f"{prefix}.{k}" if prefix else str(k)
        if isinstance(v, dict):
            yield from flat_items(v, key)
        else:
            yield key, v


def nested(flat: dict[str, Any]) -> dict[str, Any]:
    """The inverse of ``flat_items``."""
    out: dict[str, Any] = {}
    for key, value in flat.items():
        *path, last = key.split(".")
        at = out
        for p in path:
            at = at.setdefault(p, {})
        at[last] = value
    return out


def excluded(key: str) -> bool:
    return any(x in key for x in EXCLUDED_FIELDS)


@pandas_udf(StringType())
def launch_hash(raw: pd.Series) -> pd.Series:
    """First 16 hex digits of the sha256 of a launch without its volatile fields."""
    names = frozenset(VOLATILE_FIELDS)
    return raw.map(lambda r: None if r is None else sha256(canonical(without(json.loads(r), names)).encode()).hexdigest()[:16])


@pandas_udf(StringType())
def canonical_json(raw: pd.Series) -> pd.Series:
    return raw.map(lambda r: None if r is None else canonical(json.loads(r)))


@pandas_udf(StringType())
def shorten_json(raw: pd.Series) -> pd.Series:
    return raw.map(lambda r: None if r is None else json.dumps(shortened(json.loads(r)), separators=(",", ":")))


@pandas_udf(ArrayType(StructType([StructField("key", StringType()), StructField("value", StringType())])))
def fields_of(raw: pd.Series) -> pd.Series:
    """Fields of a JSON object in their order, values as canonical JSON; null for anything else."""

    def one(r: str | None) -> list[dict[str, str]] | None:
        value = None if r is None else json.loads(r)
        return [{"key": k, "value": canonical(v)} for k, v in value.items()] if isinstance(value, dict) else None

    return raw.map(one)


@udtf(returnType="key string, value string")
class FlattenJson:
    """Rows ``key``, ``value`` (canonical JSON) of an object's flattened fields."""

    def eval(self, raw: str):
        if raw is not None:
            for key, value in flat_items(json.loads(raw)):
                yield key, canonical(value)


def flatten_rows(df, raw: str = "raw"):
    """``df`` with a row for each flattened field of the JSON object in ``raw``."""
    spark = df.sparkSession
    spark.udtf.register("tracequarry_flatten", FlattenJson)
    return spark.sql(f"select t.*, f.key, f.value from {{rows}} t, lateral tracequarry_flatten(t.{raw}) f", rows=df)


def coerce_keys(column):
    """A map with string keys."""
    return F.transform_keys(column, lambda k, v: k.cast("string"))
