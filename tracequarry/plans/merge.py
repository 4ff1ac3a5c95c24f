"""From raw trace files to merged events: the whole parse as one DataFrame plan.

Files of one rank merge by kernel hash. The first real compilation of a hash wins; a hash that
was launched but never compiled gets a stand-in made from its first launch. Launches get their
group hash, session and type; kernels get their launch differences, source maps, rooflines and
autotuning analyses. Order is always (``file_ord``, ``line_no``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracequarry.config import CONFIG_FIELDS
from tracequarry.functions.canonical import flatten_rows, launch_hash, shorten_json
from tracequarry.functions.values import field, stack_of, text_or_null
from tracequarry.operators import autotune, ir_analysis, launch_diff, source_map
from tracequarry.operators.ordering import first_wins, join_on, settled
from tracequarry.plans import source_maps

# What a stand-in keeps of a launch's metadata.
STAND_IN_FIELDS = ("hash", "name", "num_warps", "num_stages", "num_ctas", "backend_name", "arch")


@dataclass
class Merged:
    """Tables of one rank (or of all, by ``rank``)."""

    compilations: DataFrame
    launches: DataFrame
    sessions: DataFrame
    winner_counts: DataFrame
    differences: DataFrame
    rooflines: DataFrame
    session_arguments: DataFrame
    session_differences: DataFrame

    def described(self, checks: tuple[dict, ...] = (), analyses: str | None = None, known: DataFrame | None = None) -> dict[str, DataFrame]:
        """Tables about the compilations' texts: ``source_maps``, ``stage_links``, ``python_lines``
        and ``analyses`` (those that a comma list names, all by default). With ``known``
        (``sources.glog.kernel_paths``) also ``compile_info``."""
        ctx = source_maps.context_of(self.compilations, checks=checks)
        out = {
            "source_maps": ctx.maps, "stage_links": source_maps.linked_stages(ctx.maps),
            "python_lines": source_map.by_python_line(ctx.maps, ["hash"]), "analyses": source_maps.analyse(ctx, "compile", analyses),
        }
        if known is not None:
            out["compile_info"] = source_maps.compile_info(self.compilations.select("hash", "ord", "raw", "stack"), known).drop("raw", "stack")
        return out


def ordered(events: DataFrame) -> DataFrame:
    """Events with ``rank``, ``ord`` and the fields that everything joins on. Needs ``path``,
    ``file_ord``, ``line_no``, ``raw``, ``v`` and, if there are ranks, ``rank``."""
    v = F.col("v")
    if "rank" not in events.columns:
        events = events.withColumn("rank", F.lit(None).cast("int"))
    hash_ = F.when(F.col("event_type") == "compilation", field(v, "payload.metadata.hash")).otherwise(field(v, "compilation_metadata.hash"))
    out = events.withColumn("ord", F.struct("file_ord", "line_no")).withColumn("hash", text_or_null(hash_)).withColumn("stack", stack_of(v))
    return autotune.with_session(out)


def compilations(events: DataFrame) -> DataFrame:
    """One compilation per rank and hash: the first real one, else a stand-in (``is_fake``) from
    the first launch, in the order of launches."""
    real = events.where("event_type = 'compilation' and hash is not null")
    launched = events.where("event_type = 'launch' and hash is not null")
    first = first_wins(real, ["rank", "hash"], "ord").select("rank", "hash", "ord", "raw", "v", "stack", "session_id", F.lit(False).alias("is_fake"))
    missing = join_on(launched, first.select("rank", "hash"), ["rank", "hash"], "left_anti")
    lone = first_wins(missing, ["rank", "hash"], "ord")
    kept = F.map_filter(F.from_json(F.get_json_object("raw", "$.compilation_metadata"), "map<string,string>"), lambda k, x: k.isin(*STAND_IN_FIELDS))
    payload = F.struct(F.struct(F.lit("compilation").alias("event_type"), F.get_json_object("raw", "$.pid").cast("long").alias("pid"), F.get_json_object("raw", "$.timestamp").alias("timestamp"), F.lit(True).alias("is_fake"), F.lit("No compilation event found").alias("fake_reason"), F.struct(kept.alias("metadata")).alias("payload")).alias("e"))
    lone = lone.withColumn("raw", F.to_json(payload["e"])).withColumn("v", F.parse_json("raw"))
    return first.unionByName(lone.select("rank", "hash", "ord", "raw", "v", "stack", "session_id", F.lit(True).alias("is_fake")))


def launches(events: DataFrame) -> DataFrame:
    """All launches with ``group_hash`` (made before long strings are cut), ``launch_type``,
    ``launch_index`` (place among all launches of the rank) and ``ordinal`` (among the hash's)."""
    out = events.where("event_type = 'launch'").withColumn("group_hash", launch_hash(F.col("raw"))).withColumn("raw", shorten_json(F.col("raw")))
    out = out.withColumn("name", F.coalesce(text_or_null(field(F.col("v"), "compilation_metadata.name")), text_or_null(field(F.col("v"), "name"))))
    out = autotune.launch_types(out)
    places = _numbered(_numbered(out.select("rank", "hash", "ord"), "launch_index"), "ordinal", ["rank", "hash"])
    return join_on(out, places.drop("hash"), ["rank", "ord"], "inner")


def _numbered(rows: DataFrame, name: str, keys: list[str] | None = None) -> DataFrame:
    """Number rows with ``ord`` from 0 within each rank, or ``keys``. Each file is numbered by
    itself; sums over files say where it starts, so that no rank is sorted in one task. Give slim
    rows and join what belongs to them afterwards."""
    keys = keys or ["rank"]
    rows = rows.withColumn("_f", F.col("ord.file_ord"))
    counts = rows.groupBy(*keys, "_f").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_f").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*keys, "_f", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys, "_f").orderBy("ord")))
    out = join_on(rows, counts, [*keys, "_f"], "inner")
    return out.withColumn(name, F.col("_before") + F.col("_nth") - 1).drop("_f", "_nth", "_before")


def occurrence_ids(comps: DataFrame, runs: DataFrame) -> DataFrame:
    """``rank``, ``ord`` and ``occurrence_id``: numbers of kept real compilations and of all
    launches in order."""
    both = comps.where("not is_fake").select("rank", "ord").unionByName(runs.select("rank", "ord"))
    return _numbered(both, "occurrence_id").select("rank", "ord", "occurrence_id")


def differences(runs: DataFrame) -> DataFrame:
    """Launch differences of every hash."""
    own = runs.where("hash is not null").select("rank", "hash", F.col("ordinal").alias("i"), "raw")
    return launch_diff.launch_diff(flatten_rows(own), ["rank", "hash"])


def merge(events: DataFrame) -> Merged:
    """All tables from parsed lines (``sources.trace.events``). Compilations and launches are made
    once, in the checkpoint folder where one is set, since every other table reads them."""
    e = ordered(events)
    comps, runs = compilations(e), launches(e)
    ids = occurrence_ids(comps, runs)
    comps, runs = join_on(comps, ids, ["rank", "ord"]), join_on(runs, ids, ["rank", "ord"])
    comps = settled(comps.withColumn("occurrence_id", F.when(~F.col("is_fake"), F.col("occurrence_id"))))
    runs = settled(runs)
    observed = e.where("event_type = 'compilation' and hash is not null")
    seen = observed.select("rank", "session_id", "hash", "ord", "raw").unionByName(comps.where("is_fake").select("rank", "session_id", "hash", "ord", "raw"))
    setting = [F.get_json_object("raw", f"$.payload.metadata.{p}") for p in CONFIG_FIELDS]
    params = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, CONFIG_FIELDS)), F.array(*setting)), lambda k, x: x.isNotNull())
    seen = seen.select("rank", "session_id", "hash", "ord", params.alias("params"))
    ttir = comps.withColumn("_f", F.from_json(F.get_json_object("raw", "$.payload.file_content"), "map<string,string>"))
    key = F.element_at(F.filter(F.map_keys("_f"), lambda k: k.endswith(".ttir")), 1)
    ttir = ttir.select("rank", "hash", F.try_element_at("_f", key).alias("ttir")).where("ttir is not null")
    args = F.from_json(F.get_json_object("raw", "$.extracted_args"), "map<string,string>")
    grids = runs.where("hash is not null").select("rank", "hash", "launch_index", F.try_variant_get("v", "$.grid", "array<bigint>").alias("grid"), args.alias("args"))
    sessions = join_on(autotune.analyses(seen, runs), autotune.results(e), ["rank", "session_id"])
    return Merged(
        comps, runs, sessions, autotune.summary(runs), differences(runs), ir_analysis.roofline(ttir, grids),
        autotune.argument_summary(seen, runs), autotune.parameter_differences(runs),
    )
