"""Autotuning sessions: which configurations were tried, what they shared, which one won.

A session belongs to a rank: tables with a ``rank`` column are analysed by rank and session, so that
several ranks together give what each gives alone. Null ranks are one rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracequarry.config import CONFIG_FIELDS
from tracequarry.functions.canonical import fields_of, flatten_rows
from tracequarry.functions.text import is_benchmark, session_id
from tracequarry.operators import launch_diff
from tracequarry.operators.ordering import islands, join_on, range_text

# What a tuner reports of its result.
RESULT_FIELDS = ("best_config", "configs_timings", "duration", "cache_hit")


def by_rank(df: DataFrame, *names: str) -> list[str]:
    """Key columns: ``names``, and ``rank`` before them if there are ranks."""
    return [*(["rank"] if "rank" in df.columns else []), *names]


def with_session(df: DataFrame, stack: str = "stack") -> DataFrame:
    return df.withColumn("session_id", session_id(F.col(stack))).withColumn("is_benchmark", is_benchmark(F.col(stack)))


def launch_types(launches: DataFrame, order: str = "ord") -> DataFrame:
    """Add ``launch_type``: ``benchmark``; ``winner`` if a benchmark of the session came before;
    else ``cached_winner``. Null outside sessions, whose launches are spread over many keys."""
    keys = by_rank(launches, "session_id")
    first = launches.where("session_id is not null and is_benchmark").groupBy(*keys).agg(F.min(order).alias("_first"))
    first = first.withColumn("_session", F.concat(F.lit("s"), F.col("session_id").cast("string"))).drop("session_id")
    spread = F.coalesce(F.concat(F.lit("s"), F.col("session_id").cast("string")), F.pmod(F.xxhash64(order), F.lit(4096)).cast("string"))
    keys = [k for k in keys if k != "session_id"]
    out = join_on(launches.withColumn("_session", spread), first, [*keys, "_session"])
    seen = F.coalesce(F.col("_first") < F.col(order), F.lit(False))
    kind = F.when(F.col("is_benchmark"), "benchmark").when(seen, "winner").otherwise("cached_winner")
    return out.withColumn("launch_type", F.when(F.col("session_id").isNotNull(), kind)).drop("_session", "_first")


def session_configs(compilations: DataFrame, order: str = "ord") -> DataFrame:
    """The distinct configurations of each session, by first appearance: ``hashes``, ``n_configs``
    and, if there is a ``params`` column, ``configs`` (``hash``, ``params``). A compilation that
    several processes report counts once; those without a hash count each."""
    keys = by_rank(compilations, "session_id")
    params = F.col("params") if "params" in compilations.columns else F.lit(None).cast("map<string,string>")
    own = compilations.where("session_id is not null").withColumn("_params", params)
    own = own.groupBy(*keys, "hash").agg(F.min(order).alias("_first"), F.min_by("_params", order).alias("params"), F.count("*").alias("_n"))
    named = F.when(F.coalesce(F.col("hash"), F.lit("")) != "", F.struct("_first", "hash", F.map_entries("params").alias("params")))
    n = F.sum(F.when(F.col("hash").isNull(), F.col("_n")).otherwise(1)).alias("n_configs")
    listed = own.groupBy(*keys).agg(n, F.array_sort(F.collect_list(named)).alias("_l"))
    configs = F.transform("_l", lambda x: F.struct(x["hash"].alias("hash"), F.map_from_entries(x["params"]).alias("params")))
    return listed.select(*keys, "n_configs", F.transform("_l", lambda x: x["hash"]).alias("hashes"), configs.alias("configs"))


def winners(launches: DataFrame, order: str = "ord") -> DataFrame:
    """The last launch with a hash of each session that is no benchmark: ``group_hash`` and the
    compilation's ``hash``. Of launches with one group hash the last stands for all."""
    own = launches.where("session_id is not null and not is_benchmark and coalesce(hash, '') <> ''")
    last = own.groupBy(*by_rank(launches, "session_id")).agg(F.max_by(F.struct("group_hash", "hash"), order).alias("w"))
    return last.select(*by_rank(launches, "session_id"), "w.group_hash", F.col("w.hash").alias("winner_hash"))


def groups_by_hash(configs: DataFrame) -> DataFrame:
    """``hash`` and ``groups``: the configuration lists of sessions with two or more, by first
    member; each list once."""
    own = configs.where("n_configs >= 2 and size(hashes) > 0")
    keys = by_rank(configs)
    return own.select(*keys, F.explode(F.array_distinct("hashes")).alias("hash"), "hashes").groupBy(*keys, "hash").agg(F.array_sort(F.collect_set("hashes")).alias("groups"))


def analyses(compilations: DataFrame, launches: DataFrame, order: str = "ord", number: str = "occurrence_id") -> DataFrame:
    """A row per real session (two benchmark launches or two configurations): its configs, the
    winner, ``possible_groups``, whether a cached winner served (``cache_usage``), and the
    launches' number ranges. Only ranges are gathered, never single launches."""
    keys = by_rank(launches, "session_id")
    configs = session_configs(compilations, order)
    own = launches.where("session_id is not null")
    ranges = islands(own, [*keys, "is_benchmark"], number).withColumn("_r", F.struct("start", "end"))
    of = lambda wanted, name: F.array_sort(F.collect_list(F.when(F.col("is_benchmark") == wanted, F.col("_r")))).alias(name)
    ranges = ranges.groupBy(*keys).agg(of(True, "_benchmark"), of(False, "_other"))
    counts = own.groupBy(*keys).agg(F.count_if("is_benchmark").alias("_benchmarks"), F.array_sort(F.collect_set("group_hash")).alias("group_hashes"))
    out = configs.select(keys).union(counts.select(keys)).distinct()
    for part in (configs, counts, ranges, winners(launches, order)):
        out = join_on(out, part, keys)
    out = out.where("coalesce(_benchmarks, 0) >= 2 or coalesce(n_configs, 0) >= 2")
    out = join_on(out, groups_by_hash(configs).withColumnRenamed("hash", "winner_hash"), by_rank(launches, "winner_hash"))
    possible = F.when(F.size("hashes") > 0, F.array("hashes")).otherwise(F.coalesce("groups", F.array().cast("array<array<string>>")))
    empty = F.coalesce("hashes", F.array().cast("array<string>"))
    text = lambda c: F.coalesce(range_text(F.col(c)), F.lit(""))
    return out.select(
        *keys, empty.alias("compilation_hashes"), F.coalesce("group_hashes", F.array().cast("array<string>")).alias("group_hashes"), F.col("group_hash").alias("selected_hash"), "winner_hash",
        possible.alias("possible_groups"), (F.coalesce("_benchmarks", F.lit(0)) == 0).alias("cache_usage"),
        text("_benchmark").alias("benchmark_ranges"), text("_other").alias("winner_ranges"), "configs",
    )


def summary(launches: DataFrame, order: str = "ord") -> DataFrame:
    """How many sessions each winner served."""
    return winners(launches, order).groupBy(*by_rank(launches, "winner_hash")).agg(F.count("*").alias("sessions"))


def representatives(launches: DataFrame, order: str = "ord", number: str = "occurrence_id") -> DataFrame:
    """One launch for each group hash of a session, the rank's last with that hash: ``hash``,
    ``raw`` and ``i``, its place among the session's by number. The places are found on numbers
    alone; events are joined to them afterwards."""
    keys, group = by_rank(launches, "session_id"), by_rank(launches, "group_hash")
    last = launches.groupBy(*group).agg(F.max_by(F.struct(F.col(number).alias("_number"), F.col("hash").alias("hash"), F.col("raw").alias("raw")), order).alias("_l"))
    last = last.select(*group, "_l._number", "_l.hash", "_l.raw")
    pairs = launches.where("session_id is not null").select(*keys, "group_hash").distinct()
    placed = join_on(pairs, last.select(*group, "_number"), group)
    placed = placed.withColumn("i", F.row_number().over(Window.partitionBy(*keys).orderBy("_number", "group_hash")) - 1).drop("_number")
    return join_on(placed, last.drop("_number"), group)


def arguments(reps: DataFrame) -> DataFrame:
    """A row per argument of each representative: ``arg``, ``value`` (canonical JSON), ``i`` and
    ``pos``, the argument's place in its launch."""
    keys = by_rank(reps, "session_id")
    listed = reps.where("coalesce(hash, '') <> ''").select(*keys, "hash", "i", fields_of(F.get_json_object("raw", "$.extracted_args")).alias("_f"))
    return listed.select(*keys, "hash", "i", F.posexplode("_f").alias("pos", "_a")).select(*keys, "hash", "i", "pos", F.col("_a.key").alias("arg"), F.col("_a.value").alias("value"))


def value_distributions(args: DataFrame) -> DataFrame:
    """Values of each argument per session and configuration, from rows (``session_id``, ``hash``,
    ``arg``, ``value``, ``i``): ``count`` and ``place`` (most frequent first, then by first use)."""
    keys = by_rank(args, "session_id", "hash", "arg")
    out = args.groupBy(*keys, "value").agg(F.count("*").alias("count"), F.min("i").alias("first"))
    w = Window.partitionBy(*keys)
    out = out.withColumn("place", F.row_number().over(w.orderBy(F.desc("count"), "first")))
    return out.withColumn("unique_count", F.count("*").over(w))


def shared_and_varied(distributions: DataFrame, configs: DataFrame) -> DataFrame:
    """``kind`` of each argument of a session: ``same`` for one value in all configurations, else
    ``varies``; ``value`` is the one value. Arguments that are a tensor anywhere are left out.
    ``configs`` has a row per session and configuration (``hash``) that was launched."""
    keys = by_rank(distributions, "session_id")
    tensor = F.coalesce(F.get_json_object("value", "$.type") == "tensor", F.lit(False))
    per = distributions.groupBy(*keys, "arg").agg(
        F.max("unique_count").alias("most"), F.min("value").alias("value"), F.max("value").alias("_last"), F.countDistinct("hash").alias("seen"), F.max(tensor).alias("_tensor")
    )
    whole = configs.groupBy(*keys).agg(F.countDistinct("hash").alias("_all"))
    per = join_on(per.where(~F.col("_tensor")), whole, keys)
    one = (F.col("most") == 1) & (F.col("value") == F.col("_last")) & (F.col("seen") == F.col("_all")) & (F.col("value") != "null")
    kind = F.when(one, "same").otherwise("varies")
    return per.select(*keys, "arg", kind.alias("kind"), F.when(one, F.col("value")).alias("value"))


def params_shared(configs: DataFrame, launched: DataFrame) -> DataFrame:
    """As ``shared_and_varied`` for the settings of launched configurations: ``configs`` has a row
    per session with ``configs`` (``hash``, ``params``), ``launched`` one per session and ``hash``."""
    keys = by_rank(launched, "session_id")
    each = configs.select(*keys, F.explode("configs").alias("_c")).select(*keys, "_c.hash", "_c.params")
    each = join_on(launched.select(*keys, "hash").distinct(), each, [*keys, "hash"])
    each = each.select(*keys, "hash", F.explode(F.array(*map(F.lit, CONFIG_FIELDS))).alias("param"), "params").withColumn("value", F.try_element_at("params", "param"))
    per = each.groupBy(*keys, "param").agg(F.count("value").alias("_n"), F.count("*").alias("_all"), F.min("value").alias("value"), F.max("value").alias("_last"))
    one = (F.col("_n") == F.col("_all")) & (F.col("value") == F.col("_last"))
    return per.where("_n > 0").select(*keys, "param", F.when(one, "same").otherwise("varies").alias("kind"), F.when(one, F.col("value")).alias("value"))


def argument_summary(compilations: DataFrame, launches: DataFrame, order: str = "ord", number: str = "occurrence_id") -> DataFrame:
    """What a session's launches were given, a row per session with launches: ``arg_order`` (by
    first appearance), ``per_config`` (``hash``, ``arg``, ``unique_count`` and ``values`` with their
    counts, most frequent first), and ``sames`` and ``varies``, the settings and arguments that all
    configurations share and those that differ.

    Two levels: launches shrink to one per group hash, these to counts per configuration, argument
    and value. What is gathered in one row grows with the session's distinct values only.
    """
    reps = representatives(launches, order, number)
    keys = by_rank(launches, "session_id")
    args = arguments(reps)
    spread = value_distributions(args)
    entry = F.struct("place", F.col("value").alias("value"), F.col("count").alias("count"))
    per = spread.groupBy(*keys, "hash", "arg").agg(F.max("unique_count").alias("unique_count"), F.array_sort(F.collect_list(entry)).alias("_v"))
    per = per.withColumn("values", F.transform("_v", lambda v: F.struct(v["value"].alias("value"), v["count"].alias("count"))))
    per = per.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("hash", "arg", "unique_count", "values"))).alias("per_config"))
    seen = args.groupBy(*keys, "arg").agg(F.min(F.struct("i", "pos")).alias("_first"))
    seen = seen.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_first", "arg"))), lambda x: x["arg"]).alias("arg_order"))
    launched = reps.where("coalesce(hash, '') <> ''").select(*keys, "hash").distinct()
    configs = session_configs(compilations, order)
    kinds = shared_and_varied(spread, launched).unionByName(params_shared(configs, launched).withColumnRenamed("param", "arg"))
    same = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("kind") == "same", F.struct("arg", "value"))))).alias("sames")
    kinds = kinds.groupBy(*keys).agg(same, F.array_sort(F.collect_list(F.when(F.col("kind") == "varies", F.col("arg")))).alias("varies"))
    out = reps.select(keys).distinct()
    for part in (seen, per, kinds):
        out = join_on(out, part, keys)
    return out


def parameter_differences(launches: DataFrame, order: str = "ord", number: str = "occurrence_id") -> DataFrame:
    """Launch differences between a session's representatives, keyed by session."""
    reps = representatives(launches, order, number)
    keys = by_rank(launches, "session_id")
    return launch_diff.launch_diff(flatten_rows(reps.select(*keys, "i", "raw")), keys)


def results(events: DataFrame, order: str = "ord") -> DataFrame:
    """What tuners reported themselves, the last report of each session: ``result``, JSON texts by
    field."""
    own = events.where("event_type = 'autotune' and session_id is not null")
    told: Column = F.map_from_arrays(F.array(*map(F.lit, RESULT_FIELDS)), F.array(*[F.get_json_object("raw", f"$.{f}") for f in RESULT_FIELDS]))
    return own.withColumn("_told", told).groupBy(*by_rank(events, "session_id")).agg(F.max_by("_told", order).alias("result"))
