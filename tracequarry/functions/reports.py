"""Reading reports of test runs, bisections and assistants."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BooleanType, MapType, StringType, StructField, StructType

from tracequarry.functions.text import fenced_block, text_or_none


def pair_result(output: Column, exit_code: Column) -> Column:
    """Struct ``outcome`` (build_failed, error, all_passed, failing, unknown), ``index`` of the
    pair (from 0), ``triton`` and ``llvm`` of a failing one."""
    built = F.regexp_extract(output, r"(?s)Status: Build Failed.*?Position: Pair (\d+) of (\d+)", 1)
    failed = F.regexp_extract(output, r"(?s)TEST FAILED.*?Position: Pair (\d+) of (\d+)", 1)
    passed = output.contains("All Passed") | output.contains("All commit pairs tested successfully")
    outcome = F.when(exit_code == 1, F.when(built != "", "build_failed").otherwise("error")).when(passed, "all_passed").when(failed != "", "failing").otherwise("unknown")
    index = F.when(exit_code == 1, built).when(~passed, failed).try_cast("int") - 1
    after = lambda word: F.when(outcome == "failing", text_or_none(F.regexp_extract(output, rf"(?s)TEST FAILED.*?{word} Commit: ([a-fA-F0-9]+)", 1)))
    return F.struct(outcome.alias("outcome"), index.alias("index"), after("Triton").alias("triton"), after("LLVM").alias("llvm"))


# Why a result file tells nothing.
NO_RESULT_FILE, RESULT_FILE_MISSING = "Could not parse test output", "Result file not found: "
RESULT_FILE_SHORT, RESULT_FILE_UNREAD = "Invalid result file format", "Could not parse result file"


def result_file(output: Column) -> Column:
    """The text file that a test's output names for its result, else null."""
    return text_or_none(F.regexp_extract(output, r"Result file: (.+\.txt)", 1))


def file_result(output: Column, content: Column, llvms: Column) -> Column:
    """What the file of ``result_file`` says where the output itself doesn't: struct ``found``,
    ``index`` (from 0), ``good_llvm``, ``bad_llvm``, ``triton`` and ``error``.

    ``content`` is the file's text, null if there is none, and ``llvms`` the tested pairs' second
    commits in order. The first line holds both commits; the last good one is that of the pair
    before. Files of fewer than two lines or without a position are errors."""
    text = F.regexp_replace(content, r"^\s+|\s+$", "")
    first = F.split(F.element_at(F.split(text, "\n"), 1), ",")
    index = text_or_none(F.regexp_extract(content, r"Position: Pair (\d+) of (\d+)", 1)).try_cast("int") - 1
    named = result_file(output)
    error = F.when(named.isNull(), NO_RESULT_FILE).when(content.isNull(), F.concat(F.lit(RESULT_FILE_MISSING), named))
    error = error.when(~text.contains("\n"), RESULT_FILE_SHORT).when(index.isNull(), RESULT_FILE_UNREAD)
    told = lambda c: F.when(error.isNull(), c)
    good = F.when((index > 0) & (index <= F.size(llvms)), F.get(llvms, index - 1))
    return F.struct(
        error.isNull().alias("found"), told(index).alias("index"), told(good).alias("good_llvm"), told(F.trim(F.get(first, F.lit(1)))).alias("bad_llvm"), told(F.trim(F.get(first, F.lit(0)))).alias("triton"), error.alias("error")
    )


def skip_candidates(output: Column) -> Column:
    """Full hashes that a bisection could not tell apart."""
    block = F.regexp_extract(output, r"first bad commit could be any of[^\n]*\n\s*((?:[ \t]*[a-f0-9]{40}[ \t]*\n?)+)", 1)
    return F.regexp_extract_all(block, F.lit(r"([a-f0-9]{40})"), F.lit(1))


def diff_patch(text: Column) -> Column:
    """A fenced diff; else the text from its first diff line on, without what follows the last."""
    lines = F.split(text, "\n", -1)
    starts = F.transform(lines, lambda x: x.startswith("diff --git") | x.startswith("--- "))
    at = F.array_position(starts, F.lit(True)).cast("int")
    rest = F.slice(lines, F.greatest(at, F.lit(1)), F.size(lines))
    fits = F.transform(rest, lambda x: (F.trim(x) != "") & x.rlike(r"^(diff |index |--- |\+\+\+ |@@|[ +\-\\]|new file|deleted file|rename |similarity )"))
    keep = F.size(rest) - F.array_position(F.reverse(fits), F.lit(True)).cast("int") + 1
    raw = F.when((at > 0) & F.array_contains(fits, True), F.array_join(F.slice(rest, F.lit(1), keep), "\n"))
    return F.coalesce(fenced_block(text, "diff"), raw)


# What a configuration says about compiling.
COMPILE_PARAMS = ("num_warps", "num_stages", "num_ctas", "maxnreg")


def _config(node: ast.AST, names: dict[str, ast.Dict]) -> dict[str, object] | None:
    if not (isinstance(node, ast.Call) and (getattr(node.func, "attr", None) or getattr(node.func, "id", None)) == "Config"):
        return None
    out: dict[str, object] = {}
    for x in [*node.args[:1], *(k.value for k in node.keywords if k.arg == "kwargs")]:
        x = names.get(x.id) if isinstance(x, ast.Name) else x
        if isinstance(x, ast.Dict):
            out |= {k.value: v.value for k, v in zip(x.keys, x.values, strict=True) if isinstance(k, ast.Constant) and isinstance(v, ast.Constant)}
    return out | {k.arg: k.value.value for k in node.keywords if k.arg in COMPILE_PARAMS and isinstance(k.value, ast.Constant)}


def kernel_configs(source: str, function: str) -> list[dict[str, object]] | None:
    """The configurations that a kernel's own autotune decorator lists, in place or through a
    variable; None if there are none or a call makes them."""
    try:
        tree = ast.parse(source)
    except SyntaxError:
        return None
    names = {t.id: s.value for s in ast.walk(tree) if isinstance(s, ast.Assign) for t in s.targets if isinstance(t, ast.Name)}
    own = next((n for n in ast.walk(tree) if isinstance(n, ast.FunctionDef) and n.name == function), None)
    for d in own.decorator_list if own else ():
        if isinstance(d, ast.Call) and (getattr(d.func, "attr", None) or getattr(d.func, "id", None)) == "autotune":
            listed = next((k.value for k in d.keywords if k.arg == "configs"), None)
            listed = names.get(listed.id) if isinstance(listed, ast.Name) else listed
            if isinstance(listed, ast.List):
                found = [c for c in (_config(x, {n: v for n, v in names.items() if isinstance(v, ast.Dict)}) for x in listed.elts) if c]
                return found or None
    return None


def config_params(source: str) -> list[str]:
    """Names that any configuration of a source provides."""
    try:
        tree = ast.parse(source)
    except SyntaxError:
        return []
    names = {t.id: s.value for s in ast.walk(tree) if isinstance(s, ast.Assign) and isinstance(s.value, ast.Dict) for t in s.targets if isinstance(t, ast.Name)}
    found = (_config(n, names) for n in ast.walk(tree))
    return sorted({k for c in found if c for k in c if k not in COMPILE_PARAMS})


def chosen_config(configs: list[dict[str, object]], args: dict[str, object]) -> dict[str, object] | None:
    """Compile parameters: those on which all configurations agree, else those of the first whose
    other parameters the arguments equal."""
    every = {p: {c[p] for c in configs if p in c} for p in COMPILE_PARAMS}
    if configs and any(every.values()) and all(len(v) <= 1 for v in every.values()):
        return {p: next(iter(v)) for p, v in every.items() if v}
    for c in configs:
        own = {k: v for k, v in c.items() if k not in COMPILE_PARAMS}
        if own and all(args.get(k) == v for k, v in own.items()):
            return {k: v for k, v in c.items() if k in COMPILE_PARAMS}
    return None


def parameters(source: str) -> list[tuple[str, bool, bool]]:
    """Name, whether it is by keyword (has a default or is a constant expression), and whether it
    is annotated as one, of the first function's parameters."""
    try:
        own = next((n for n in ast.walk(ast.parse(source)) if isinstance(n, ast.FunctionDef)), None)
    except SyntaxError:
        return []
    if own is None:
        return []
    plain = [*own.args.posonlyargs, *own.args.args]
    defaults = len(plain) - len(own.args.defaults)
    constant = lambda a: a.annotation is not None and "constexpr" in ast.unparse(a.annotation)
    return [(a.arg, i >= defaults or constant(a), constant(a)) for i, a in enumerate(plain)] + [(a.arg, True, constant(a)) for a in own.args.kwonlyargs]


@pandas_udf(ArrayType(MapType(StringType(), StringType())))
def autotune_configs(source: pd.Series, function: pd.Series) -> pd.Series:
    return pd.Series([None if (c := kernel_configs(s or "", f or "")) is None else [{k: str(v) for k, v in x.items()} for x in c] for s, f in zip(source, function, strict=True)], dtype=object)


@pandas_udf(ArrayType(StructType([StructField("name", StringType()), StructField("keyword", BooleanType()), StructField("constexpr", BooleanType())])))
def signature(source: pd.Series) -> pd.Series:
    return pd.Series([[{"name": n, "keyword": k, "constexpr": c} for n, k, c in parameters(s or "")] for s in source], dtype=object)


def longest_suffix(paths, catalogue):
    """The file of a catalogue (``file``) that ends like each path (``path``) for the most parts."""
    parts = F.split("path", "/", -1)
    tails = paths.select("path", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("skip", "tail"))
    hits = tails.where("tail <> ''").join(catalogue, F.col("tail") == F.col("file"))
    return paths.select("path").distinct().join(hits.groupBy("path").agg(F.min_by("file", "skip").alias("file")), "path", "left")
