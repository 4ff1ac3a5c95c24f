"""Fields of events, argument values and predicates over them.

Events are VARIANT columns. ``0``, ``""`` and ``{}`` count as missing where a fallback follows.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once; a column used in a lambda is computed in each call."""
    return F.element_at(F.transform(F.array(value), f), 1)


def field(v: Column, path: str, kind: str = "string") -> Column:
    """A field of a VARIANT by path; null where it is missing or of another kind."""
    return F.try_variant_get(v, "$." + path if not path.startswith("[") else "$" + path, kind)


def text_or_null(column: Column) -> Column:
    return F.nullif(column, F.lit(""))


def kernel_name(v: Column) -> Column:
    return F.coalesce(text_or_null(field(v, "kernel_name")), text_or_null(field(v, "payload.metadata.name")), F.lit("unknown"))


def kernel_hash(v: Column) -> Column:
    return F.coalesce(*(text_or_null(field(v, p)) for p in ("kernel_hash", "payload.metadata.hash", "compilation_metadata.hash")), F.lit(""))


def event_source(v: Column) -> Column:
    """Python source of a compilation, wherever a producer puts it."""
    return F.coalesce(*(text_or_null(field(v, p)) for p in ("payload.python_source.content", "payload.python_source.code", "payload.python")), F.lit(""))


#: A stack as typed frames.
STACK = "array<struct<line:int,name:string,filename:string,loc:string>>"


def stack_of(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$.stack", STACK), F.array().cast(STACK))


def parse_literal(text: str) -> Any:
    """``true``/``false``, JSON list, integer, number, or else the text itself."""
    low = text.strip().lower()
    if low in ("true", "false"):
        return low == "true"
    if text.strip().startswith("["):
        try:
            return json.loads(text)
        except ValueError:
            return text
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def parse_filters(text: str | None) -> dict[str, Any]:
    """``k=v,k2=v2``. Commas inside brackets belong to the value."""
    out: dict[str, Any] = {}
    depth, part, parts = 0, "", []
    for c in text or "":
        depth += (c == "[") - (c == "]")
        if c == "," and depth == 0:
            parts.append(part)
            part = ""
        else:
            part += c
    for p in [*parts, part]:
        if not p.strip():
            continue
        if "=" not in p:
            raise ValueError(f"not of the form key=value: {p!r}")
        key, value = p.split("=", 1)
        out[key.strip()] = parse_literal(value.strip())
    return out


#: Where a launch's values are looked up, in this order.
SOURCES = ("compilation_metadata", "extracted_args", "extracted_inductor_args")


def launch_value(raw: Column, key: str) -> Column:
    """JSON text of ``key`` (``a.b[0].c``) in the first source that has its first part. A value
    that is an object with ``value`` stands for that."""
    head = key.split(".")[0].split("[")[0]
    out = None
    for s in SOURCES:
        has = F.array_contains(F.coalesce(F.json_object_keys(F.get_json_object(raw, f"$.{s}")), F.array().cast("array<string>")), head)
        whole = F.get_json_object(raw, f"$.{s}.{key}")
        value = F.coalesce(F.when(whole.startswith("{"), F.get_json_object(whole, "$.value")), whole)
        out = F.when(has, value) if out is None else out.when(has, value)
    return out


def filter_condition(raw: Column, filters: dict[str, Any]) -> Column:
    """All filters hold. Numbers compare as numbers, lists as JSON."""

    def one(key: str, wanted: Any) -> Column:
        got = launch_value(raw, key)
        if isinstance(wanted, bool):
            return got == str(wanted).lower()
        if isinstance(wanted, (int, float)):
            return got.try_cast("double") == float(wanted)
        if isinstance(wanted, list):
            return F.regexp_replace(got, r"\s", "") == json.dumps(wanted, separators=(",", ":"))
        return got == wanted

    return reduce(lambda a, b: a & b, (F.coalesce(one(k, v), F.lit(False)) for k, v in filters.items()), F.lit(True))


def glob_condition(name: Column, patterns: str | None) -> Column:
    """Whether a name fits any of the comma-separated shell patterns; true without patterns."""
    wanted = [p.strip() for p in (patterns or "").split(",") if p.strip()]
    if not wanted:
        return F.lit(True)

    def regex(pattern: str) -> str:
        out = ""
        for c in pattern:
            out += ".*" if c == "*" else "." if c == "?" else c if c in "[]" else "\\" + c if not c.isalnum() and c != "_" else c
        return "(?s)^" + out.replace("[!", "[^") + "$"

    return F.coalesce(reduce(lambda a, b: a | b, (name.rlike(regex(p)) for p in wanted)), F.lit(False))


def is_tensor(kind: Column) -> Column:
    return F.coalesce(F.lower(F.trim(kind)) == "tensor", F.lit(False))


def num_ctas(grid: Column) -> Column:
    """Product of a grid's dimensions; null for none, an empty one, or a null within."""
    return F.when(F.size(grid) > 0, F.aggregate(grid.cast("array<bigint>"), F.lit(1).cast("long"), lambda a, x: a * x))


def config_similarity(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """0.4 for equal stages, 0.4 for equal warps, 0.2 times the ratio of shared memory."""
    sa, sb = F.coalesce(a["shared"], F.lit(0)), F.coalesce(b["shared"], F.lit(0))
    ratio = F.when((sa > 0) & (sb > 0), 0.2 * F.least(sa, sb) / F.greatest(sa, sb)).when(sa == sb, F.lit(0.2)).otherwise(F.lit(0.0))
    same = lambda k: F.when(a[k].eqNullSafe(b[k]), F.lit(0.4)).otherwise(F.lit(0.0))
    return same("num_stages") + same("num_warps") + ratio


def device(name: Column) -> Column:
    """``cuda:3`` to ``cuda:0``; blank or null to ``cpu``."""
    trimmed = F.trim(name)
    return F.when(trimmed.isNull() | (trimmed == ""), "cpu").when(trimmed.contains(":"), F.concat(F.split_part(trimmed, F.lit(":"), F.lit(1)), F.lit(":0"))).otherwise(trimmed)
