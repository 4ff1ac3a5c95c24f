"""Source text, IR text and free text."""

from __future__ import annotations

import difflib
import json
import re
from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, StringType

from tracequarry.config import AUTOTUNER_FILE, DTYPE_BITS, OPERATIONS
from tracequarry.functions.values import let


def lines_of(text: Column) -> Column:
    """Lines as Python's ``splitlines`` gives them for line feeds: a last empty one is none."""
    text = F.regexp_replace(text, "\r\n?", "\n")
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, "\n$", ""), "\n", -1))


def in_frame(stack: Column, function: str) -> Column:
    return F.exists(stack, lambda f: F.coalesce(f["filename"].contains(AUTOTUNER_FILE) & (f["name"] == function), F.lit(False)))


def is_benchmark(stack: Column) -> Column:
    return in_frame(stack, "_bench")


def is_autotuned(stack: Column) -> Column:
    return in_frame(stack, "run")


def is_winner_run(stack: Column) -> Column:
    return is_autotuned(stack) & ~is_benchmark(stack)


def user_stack(stack: Column) -> Column:
    """The frames before the first one of the autotuner; null if there is none, or none before."""
    marks = F.transform(stack, lambda f: F.coalesce(f["filename"].contains(AUTOTUNER_FILE) & f["name"].isin("run", "_bench"), F.lit(False)))
    at = F.array_position(marks, F.lit(True)).cast("int")
    return F.when(at > 1, F.slice(stack, F.lit(1), at - 1))


def session_id(stack: Column) -> Column:
    """First 16 hex digits of the sha256 of ``file:line:name`` of the user's frames."""
    frames = F.transform(user_stack(stack), lambda f: F.concat_ws(":", F.coalesce(f["filename"], F.lit("")), F.coalesce(f["line"].cast("string"), F.lit("")), F.coalesce(f["name"], F.lit(""))))
    return F.substring(F.sha2(F.array_join(frames, "|"), 256), 1, 16)


def operations(text: Column, stage: str) -> Column:
    """All operations of an IR text, in order."""
    if stage not in OPERATIONS:
        return F.array().cast("array<string>")
    return F.coalesce(F.regexp_extract_all(text, F.lit(OPERATIONS[stage]), F.lit(1)), F.array().cast("array<string>"))


def normalized_source(source: Column) -> Column:
    """Without blank lines and comment lines."""
    kept = F.filter(F.split(source, "\n", -1), lambda x: (F.trim(x) != "") & ~F.ltrim(x).startswith("#"))
    return F.trim(F.array_join(kept, "\n"))


def source_line(source: Column, number: Column, start: Column) -> Column:
    """Line ``number`` of a file of which ``source`` begins at line ``start``."""
    at = number - F.coalesce(start, F.lit(1)) + 1
    return F.when(at > 0, F.try_element_at(F.split(source, "\n", -1), at.cast("int")))


def kernel_source(code: Column) -> Column:
    """From the first jit decorator on."""
    return F.substr(code, F.greatest(F.lit(1), F.instr(code, "@triton.jit")))


def after_glog_prefix(line: Column) -> Column:
    """The text behind the first ``] ``; null without one."""
    at = F.instr(line, "] ")
    return F.when(at > 0, F.substr(line, at + 2))


def file_extension(name: Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1)


def dtype_bits(token: Column) -> Column:
    def known(low: Column) -> Column:
        out = None
        for key, bits in DTYPE_BITS:
            out = F.when(low.contains(key), bits) if out is None else out.when(low.contains(key), bits)
        return out

    return let(F.lower(F.trim(token)), known)


def dot_shape(ir: Column) -> Column:
    """Struct ``tile_m``, ``tile_n``, ``tile_k``, ``input_dtype``, ``output_dtype`` of the first
    matrix product with a readable signature."""
    shape = r"tensor<(\d+)x(\d+)x([a-zA-Z0-9]+)"
    pattern = rf"tt\.dot[^:]*:\s*{shape}[^*]*\*\s*{shape}[^-]*->\s*{shape}"

    def parts(found: Column) -> Column:
        part = lambda i, kind: F.regexp_extract(found, pattern, i).try_cast(kind)
        return F.struct(
            part(7, "int").alias("tile_m"), part(8, "int").alias("tile_n"), part(2, "int").alias("tile_k"),
            F.nullif(part(3, "string"), F.lit("")).alias("input_dtype"), F.nullif(part(9, "string"), F.lit("")).alias("output_dtype"),
        )

    return let(F.regexp_extract(ir, pattern, 0), parts)  # the text is searched once


def count_of(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("long")


def lines_with(text: Column, part: str) -> Column:
    return F.size(F.filter(F.split(text, "\n", -1), lambda x: x.contains(part))).cast("long")


def truncated(text: Column, most: int, keep: str = "head", mark: str = "...") -> Column:
    """At most ``most`` characters, with ``mark`` for what is left out."""
    room = max(0, most - len(mark))
    if keep == "head":
        cut = F.concat(F.substring(text, 1, room), F.lit(mark))
    elif keep == "tail":
        cut = F.concat(F.lit(mark), F.substring(text, -room, room) if room else F.lit(""))
    else:
        front, back = room // 2, room - room // 2
        cut = F.concat(F.substring(text, 1, front), F.lit(mark), F.substring(text, -back, back) if back else F.lit(""))
    return F.when(F.length(text) > most, cut).otherwise(text)


def handle_text(handle: Column, kind: str = "str", most: int = 256) -> Column:
    """An opaque handle: as it is if short, else a note of its size."""
    return F.when(F.length(handle) > most, F.concat(F.lit(f"<{kind}: "), F.length(handle).cast("string"), F.lit(" chars omitted>"))).otherwise(handle)


def fenced_block(text: Column, language: str | None = None) -> Column:
    tag = language or r"[A-Za-z0-9_+\-]*"
    return text_or_none(F.regexp_extract(text, rf"(?s)```{tag}[ \t]*\n(.*?)```", 1))


def text_or_none(column: Column) -> Column:
    return F.nullif(column, F.lit(""))


def json_in(text: Column) -> Column:
    """The text as JSON, or the first fenced block that is."""
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(fenced_block(text, "json")), F.try_parse_json(fenced_block(text)))


def commit_hash(text: Column) -> Column:
    """The first line that is a hash of 7 to 40 hex digits."""
    return text_or_none(F.regexp_extract(text, r"(?m)^\s*([0-9a-f]{7,40})\s*$", 1))


def culprit(text: Column) -> Column:
    """The hash that a bisection blames: 40 digits, else 7 to 12."""
    return F.coalesce(text_or_none(F.regexp_extract(text, r"([0-9a-f]{40}) is the first bad commit", 1)), text_or_none(F.regexp_extract(text, r"\b([0-9a-f]{7,12}) is the first bad commit", 1)))


def failing_files(log: Column) -> Column:
    """Paths with errors in a compiler's log, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(log, F.lit(r"(?m)^([^\s:]+\.(?:cpp|cc|c|h|hpp|td|py|cu)):\d+(?::\d+)?: (?:fatal )?error"), F.lit(1)))


def ratio(a: str | None, b: str | None) -> float:
    """``difflib.SequenceMatcher(None, a, b).ratio()``, 0 if either is empty.

    Blocks are found as difflib finds them, but only at places of ``a`` whose letter can begin one:
    in texts of 200 letters or more the popular letters can't, and these are nearly all of a text."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    starts = [c for c in dict.fromkeys(b) if len(b) < 200 or b.count(c) <= len(b) // 100 + 1]
    where: dict[str, list[int]] = {c: [] for c in starts}
    places: list[int] = []
    if starts:
        some = re.compile("[" + "".join(map(re.escape, starts)) + "]")
        for m in some.finditer(b):
            where[m[0]].append(m.start())
        places = [m.start() for m in some.finditer(a)]
    matched, left = 0, [(0, len(a), 0, len(b))]
    while left:
        alo, ahi, blo, bhi = left.pop()
        i, j, size = _longest(a, b, where, places, alo, ahi, blo, bhi)
        if size:
            matched += size
            if alo < i and blo < j:
                left.append((alo, i, blo, j))
            if i + size < ahi and j + size < bhi:
                left.append((i + size, ahi, j + size, bhi))
    return 2.0 * matched / (len(a) + len(b))


def _longest(a: str, b: str, where: dict[str, list[int]], places: list[int], alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
    """The longest block, the first in ``a`` and then in ``b`` of several, widened by equal letters on
    either side."""
    besti, bestj, best, runs = alo, blo, 0, {}
    stop = bisect_left(places, ahi)
    for at in range(bisect_left(places, alo), stop):
        i = places[at]
        own = where[a[i]]
        own = own[bisect_left(own, blo) : bisect_left(own, bhi)]
        if own and not best:
            besti, bestj, best = i, own[0], 1
        # Runs that end here are needed only if the next letter can go on with them.
        goes_on = at + 1 < stop and places[at + 1] == i + 1
        now = dict.fromkeys(own, 1) if goes_on else {}
        if runs:
            for j in own:
                if j - 1 in runs:
                    k = now[j] = runs[j - 1] + 1
                    if k > best:
                        besti, bestj, best = i - k + 1, j - k + 1, k
        runs = now if goes_on else {}
    while besti > alo and bestj > blo and a[besti - 1] == b[bestj - 1]:
        besti, bestj, best = besti - 1, bestj - 1, best + 1
    while besti + best < ahi and bestj + best < bhi and a[besti + best] == b[bestj + best]:
        best += 1
    return besti, bestj, best


@pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity by longest matching blocks; order matters. 0 if either is empty."""
    return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


@pandas_udf(ArrayType(StringType()))
def unified_diff(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([list(difflib.unified_diff((x or "").splitlines(), (y or "").splitlines(), "a", "b", lineterm="")) for x, y in zip(a, b, strict=True)], dtype=object)


@pandas_udf(StringType())
def tensor_summary(raw: pd.Series) -> pd.Series:
    """``shape=[..] dtype=..`` of a tensor argument, from its own fields or those of ``value``."""

    def one(r):
        d = json.loads(r) if r else None
        if not isinstance(d, dict) or str(d.get("type", "")).strip().lower() != "tensor":
            return None
        inner = d.get("value") if isinstance(d.get("value"), dict) else {}
        found = [(k, d.get(k, inner.get(k))) for k in ("shape", "dtype", "device", "stride", "numel")]
        return " ".join(f"{k}={json.dumps(x) if isinstance(x, list) else x}" for k, x in found if x is not None)

    return raw.map(one)
