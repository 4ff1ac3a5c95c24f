"""Source maps and analyses of whole compilations.

Compilations of one hash have the same texts on every rank, so one stands for all of them.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequarry.config import BACKEND_STAGES, enabled
from tracequarry.functions.text import count_of, dot_shape, source_line
from tracequarry.operators import ir_analysis, source_map
from tracequarry.operators.ordering import first_wins, settled

KEYS = ["hash"]
#: Parser of each stage that can be mapped; backends agree where they share a stage.
PARSERS = {s[0]: s[5] for stages in BACKEND_STAGES.values() for s in stages if s[4]}


def stage_texts(comps: DataFrame) -> DataFrame:
    """A row per stage of each compilation (``hash``, ``ord``, ``raw``): ``hash``, ``stage`` (what
    follows the first dot of the file's name), ``text``. Of several files of a stage the first
    by name counts; stages that hold no text, and rows without a hash, are left out."""
    files = F.from_json(F.get_json_object("raw", "$.payload.file_content"), "map<string,string>")
    one = first_wins(comps.where("hash is not null").select("hash", "ord", "raw"), KEYS, "ord")
    rows = one.select("hash", F.explode(files).alias("key", "text")).where("text is not null")
    rows = rows.withColumn("stage", F.try_element_at(F.split("key", r"\."), F.lit(2))).where("stage is not null")
    return rows.groupBy("hash", "stage").agg(F.min_by("text", "key").alias("text"))


def has_source_mappings(v: Column) -> Column:
    """Whether an event already brings source maps."""
    held = F.try_variant_get(v, "$.payload.source_mappings", "map<string,variant>")
    return F.coalesce(F.size(held) > 0, F.lit(False))


def source_mappings(stages: DataFrame) -> DataFrame:
    """Source place of the lines of all stages (``stage_texts``) by their parsers: ``hash``,
    ``stage``, ``ir_line``, ``file``, ``line``, ``column``, ``kind``. Stages without a parser
    have none."""
    of = lambda kind: [s for s, p in PARSERS.items() if p == kind]
    columns = ["hash", "stage", "ir_line", "file", "line", "column", "kind"]
    generic = settled(source_map.generic_map(stages.where(F.col("stage").isin(of("generic_loc"))), ["hash", "stage"]).select(*columns))
    out, others = generic, generic.select("hash", "file").distinct()
    for stage in ("ptx", "amdgcn"):
        own = stages.where(F.col("stage") == stage).select("hash", "text")
        rows = source_map.assembly_map(own, KEYS, stage, others).withColumn("stage", F.lit(stage)).withColumn("kind", F.lit("line"))
        out = out.unionByName(rows.select(*columns))
    sass = source_map.sass_map(stages.where("stage = 'sass'").select("hash", "text"), KEYS)
    return out.unionByName(sass.withColumn("stage", F.lit("sass")).withColumn("kind", F.lit("line")).select(*columns))


def linked_stages(maps: DataFrame) -> DataFrame:
    """For each line of each stage the lines of every other stage from the same place: ``hash``,
    ``source_stage``, ``target_stage``, ``ir_line``, ``target_lines``. Machine code is linked by
    lines, which have no columns there."""
    lines = maps.where("kind <> 'loc_def'")
    column = F.when((F.col("source_stage") == "sass") | (F.col("target_stage") == "sass"), 0).otherwise(F.col("column"))
    names = F.array(*map(F.lit, sorted(PARSERS)))
    there = lines.withColumn("other", F.explode(names)).where("other <> stage")
    side = lambda a, b: there.withColumnsRenamed({"stage": a, "other": b}).withColumn("column", column)
    source, target = side("source_stage", "target_stage"), side("target_stage", "source_stage")
    return source_map.link_stages(source, target, ["hash", "source_stage", "target_stage"])


def lines_for(by_line: DataFrame, line: int, stage: str) -> DataFrame:
    """Lines of a stage from one source line, from ``source_map.by_python_line``."""
    return by_line.where((F.col("line") == line) & (F.col("stage") == stage)).select("hash", "file", "ir_lines")


def python_lines(maps: DataFrame, path: str, first: int, last: int) -> DataFrame:
    """Source line of each line of a stage, for one file (a part of its path) and range of lines."""
    return maps.where(F.col("file").contains(path) & F.col("line").between(first, last)).select("hash", "stage", "ir_line", "line")


def base_warps(metadata: Column, ttgir: Column) -> Column:
    """Warps that a kernel was written for (``metadata``: JSON text): what the producer says, else
    the module's attribute, else the warps it runs with."""
    told = F.get_json_object(metadata, "$.num_warps_base").try_cast("int")
    attribute = F.nullif(F.regexp_extract(ttgir, r'"ttg\.num-warps"\s*=\s*(\d+)', 1), F.lit("")).try_cast("int")
    return F.coalesce(told, attribute, F.get_json_object(metadata, "$.num_warps").try_cast("int"))


def load_checks(text: str) -> list[dict]:
    """Procedure checks from JSON text: an object whose list ``procedures`` holds ``name`` and
    ``pattern_checks`` (a list of texts or one text); ``heading`` is the name by default."""
    data = json.loads(text)
    listed = data.get("procedures", []) if isinstance(data, dict) else None
    if not isinstance(listed, list):
        raise ValueError("procedure checks: not an object with a list of procedures")
    out = []
    for n, own in enumerate(listed):
        missing = [k for k in ("name", "pattern_checks") if not isinstance(own, dict) or not own.get(k)]
        if missing:
            raise ValueError(f"procedure {n} has no {' and no '.join(missing)}")
        patterns = own["pattern_checks"]
        out.append({**own, "heading": own.get("heading", own["name"]), "patterns": patterns if isinstance(patterns, str) else "\n".join(patterns)})
    return out


def attributes(ir: Column, wanted: list[dict], given: dict[str, Column]) -> dict[str, Column]:
    """Attributes of an IR text as columns. Each of ``wanted`` has a ``name`` and a ``kind``:
    ``regex`` (first group of ``pattern``), ``count`` (of ``pattern``, a plain text), ``dot`` (a
    ``part`` of the first product's shape), ``given`` (a column by name), ``clusters`` (from the
    names in ``of``: warps, barriers, products) or ``tile_bits``."""
    found: dict[str, Column] = {}
    for a in wanted:
        kind = a["kind"]
        if kind == "regex":
            found[a["name"]] = F.nullif(F.regexp_extract(ir, a["pattern"], 1), F.lit(""))
        elif kind == "count":
            found[a["name"]] = count_of(ir, a["pattern"])
        elif kind == "dot":
            found[a["name"]] = dot_shape(ir)[a["part"]]
        elif kind == "given":
            found[a["name"]] = given[a["name"]]
        elif kind == "tile_bits":
            found[a["name"]] = ir_analysis.tile_bits(ir)
        elif kind == "clusters":
            found[a["name"]] = ir_analysis.pingpong_clusters(*(found[n] if n in found else given[n] for n in a["of"]))
        else:
            raise ValueError(f"unknown kind of attribute: {kind}")
    return found


@dataclass
class Context:
    """What analyses read. ``launches``: ``hash``, ``launch_index``, ``grid``, ``args``;
    ``sources``: ``hash``, ``code``, ``start_line``."""

    stages: DataFrame
    maps: DataFrame
    sources: DataFrame
    launches: DataFrame | None = None
    checks: tuple[dict, ...] = ()

    def text(self, stage: str) -> DataFrame:
        return self.stages.where(F.col("stage") == stage).select("hash", "text")


@dataclass(frozen=True)
class Analysis:
    """An analysis by name: its level, the stages it can't do without, and how it is made."""

    name: str
    level: str
    needs: tuple[str, ...]
    make: Callable[[Context], DataFrame]


ANALYSES: dict[str, Analysis] = {}


def register(name: str, level: str, *needs: str):
    """Add an analysis, a function of a ``Context`` that gives rows with ``hash``. ``level`` is
    ``compile`` or ``launch``."""
    if level not in ("compile", "launch"):
        raise ValueError(f"unknown level: {level}")

    def add(make: Callable[[Context], DataFrame]):
        if name in ANALYSES:
            raise ValueError(f"{name} is registered already")
        ANALYSES[name] = Analysis(name, level, needs, make)
        return make

    return add


def chosen(level: str, setting: str | None = None) -> list[Analysis]:
    """Registered analyses of a level that a comma list names (``all`` by default, ``none``).
    Unknown names are refused."""
    wanted = enabled(setting)
    unknown = sorted((wanted or frozenset()) - {n.lower() for n in ANALYSES})
    if unknown:
        raise ValueError(f"unknown analyses: {', '.join(unknown)}")
    return [a for a in ANALYSES.values() if a.level == level and (wanted is None or a.name.lower() in wanted)]


@register("buffer_ops", "compile", "ttgir", "amdgcn")
def _buffer_ops(ctx: Context) -> DataFrame:
    both = ctx.text("ttgir").withColumnRenamed("text", "ttgir").join(ctx.text("amdgcn").withColumnRenamed("text", "amdgcn"), "hash")
    return ir_analysis.buffer_ops(both).drop("ttgir", "amdgcn")


@register("loop_schedules", "compile", "ttir", "ttgir")
def _loop_schedules(ctx: Context) -> DataFrame:
    of = lambda s: ctx.maps.where((F.col("stage") == s) & (F.col("kind") == "line"))
    code = source_line(F.col("code"), F.col("line"), F.col("start_line"))
    python = of("ttgir").join(ctx.sources, "hash").groupBy("hash", "ir_line").agg(F.min(code).alias("code"))
    return ir_analysis.loop_schedule(ctx.text("ttir"), ctx.text("ttgir"), source_map.link_stages(of("ttir"), of("ttgir"), KEYS), python)


@register("procedures", "compile", "ttgir")
def _procedures(ctx: Context) -> DataFrame:
    if not ctx.checks:
        return ctx.text("ttgir").where(F.lit(False)).select("hash")
    return ir_analysis.procedure_checks(ctx.text("ttgir"), [(c["name"], c["patterns"]) for c in ctx.checks])


@register("roofline", "launch", "ttir")
def _roofline(ctx: Context) -> DataFrame:
    kernels = ctx.text("ttir").withColumnRenamed("text", "ttir")
    return ir_analysis.roofline(kernels, ctx.launches)


def analyse(ctx: Context, level: str, setting: str | None = None) -> DataFrame:
    """All chosen analyses of a level: ``hash``, ``analysis`` and ``result`` (JSON). Kernels without
    the stages that one needs have no row of it; ``launch`` needs the context's launches."""
    if level == "launch" and ctx.launches is None:
        raise ValueError("analyses of launches need launches")
    out = ctx.stages.sparkSession.createDataFrame([], "hash string, analysis string, result string")
    have = ctx.stages.groupBy("hash").agg(F.collect_set("stage").alias("_have"))
    for a in chosen(level, setting):
        fit = have.where(F.size(F.array_except(F.array(*map(F.lit, a.needs)), "_have")) == 0).select("hash")
        rows = a.make(ctx)
        body = F.to_json(F.struct(*[c for c in rows.columns if c != "hash"])) if len(rows.columns) > 1 else F.lit("{}")
        out = out.unionByName(rows.join(fit, "hash", "left_semi").select("hash", F.lit(a.name).alias("analysis"), body.alias("result")))
    return out


def context_of(comps: DataFrame, runs: DataFrame | None = None, checks: tuple[dict, ...] = ()) -> Context:
    """The context of merged compilations and launches (``plans.merge``)."""
    stages = settled(stage_texts(comps))
    one = first_wins(comps.where("hash is not null").select("hash", "ord", "raw"), KEYS, "ord")
    get = lambda k: F.get_json_object("raw", f"$.payload.python_source.{k}")
    sources = one.select("hash", F.coalesce(get("code"), get("content")).alias("code"), get("start_line").try_cast("int").alias("start_line"))
    launches = None
    if runs is not None:
        args = F.from_json(F.get_json_object("raw", "$.extracted_args"), "map<string,string>")
        launches = runs.where("hash is not null").select("hash", "launch_index", F.try_variant_get("v", "$.grid", "array<bigint>").alias("grid"), args.alias("args"))
    return Context(stages, settled(source_mappings(stages)), sources, launches, checks)


def compile_info(comps: DataFrame, known: DataFrame) -> DataFrame:
    """Which compile made each compilation (``hash``, ``ord``, ``raw``, ``stack``): the columns of
    ``known`` (a row for each ``kernel_path``, as ``sources.glog`` gives them) by the path of its
    own source, else by the first frame of generated code that is known; null if none is."""
    rest = [c for c in known.columns if c != "kernel_path"]
    known = known.select(F.col("kernel_path").alias("_path"), *rest)
    own = F.get_json_object("raw", "$.payload.python_source.file_path")
    generated = F.transform("stack", lambda f: F.when(f["filename"].contains("torchinductor") & f["filename"].endswith(".py"), f["filename"]))
    paths = comps.select("hash", "ord", F.posexplode(F.concat(F.array(own), generated)).alias("_at", "_path")).where("_path is not null")
    found = paths.join(known, "_path").groupBy("hash", "ord").agg(F.min_by(F.struct(*rest), "_at").alias("_info"))
    found = found.select(F.col("hash").alias("_h"), F.col("ord").alias("_o"), "_info.*")
    return comps.join(found, F.col("hash").eqNullSafe(F.col("_h")) & (F.col("ord") == F.col("_o")), "left").drop("_h", "_o")
