"""The operators applied to the star-schema tables, each beside SQL for the same rows.

``events`` stands in for launches: ``event_type`` is a kernel's name, ``user_id`` a hash or
session, ``event_id`` the global order and ``props`` the arguments.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracequarry.config import BACKEND_STAGES, OPERATIONS
from tracequarry.functions.text import lines_of, operations, sequence_ratio
from tracequarry.operators import compare, ir_analysis, kernels, launch_diff, matching, ordering
from tracequarry.operators.autotune import launch_types, value_distributions, winners
from tracequarry.operators.matching import samples

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))


EV = "(SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"


@query("SELECT event_type AS name, count(*) AS launches, max_by(user_id, event_id) AS hash FROM events GROUP BY event_type")
def kernel_list(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.col("user_id").alias("hash"), F.lit("f").alias("path"), F.col("event_id").alias("event_idx"))
    return kernels.list_kernels(e)


@query("""WITH r AS (SELECT event_type, user_id, count(*) AS n, min(event_id) AS f FROM events GROUP BY ALL)
SELECT event_type AS name, sum(n)::BIGINT AS launches, min_by(user_id, f) AS hash FROM r GROUP BY event_type""")
def kernel_list_rollup(spark, sf_dir):
    rollup = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"), F.min("event_id").alias("f"))
    return rollup.groupBy(F.col("event_type").alias("name")).agg(F.sum("n").alias("launches"), F.min_by("user_id", "f").alias("hash"))


@query("SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS launch_id FROM events")
def launch_ordinals(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "event_type", ordering.ordinal("event_type", "event_id").alias("launch_id"))


@query("SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) = 11")
def nth_launch(spark, sf_dir):
    return launch_ordinals(spark, sf_dir).where("launch_id = 10").select("event_type", "event_id")


@query(f"SELECT event_id, user_id, value FROM {EV} WHERE k = 69 AND value > 20")
def args_filter(spark, sf_dir):
    return _events(spark, sf_dir).where("k = 69 and value > 20").select("event_id", "user_id", "value")


@query(f"SELECT user_id, k, event_id, event_type FROM {EV} QUALIFY row_number() OVER (PARTITION BY user_id, k ORDER BY event_id) = 1")
def first_wins(spark, sf_dir):
    return ordering.first_wins(_events(spark, sf_dir), ["user_id", "k"], "event_id").select("user_id", "k", "event_id", "event_type")


@query(f"SELECT user_id, k, event_id, event_type FROM {EV} QUALIFY row_number() OVER (PARTITION BY user_id, k ORDER BY event_id DESC) = 1")
def last_wins(spark, sf_dir):
    return ordering.last_wins(_events(spark, sf_dir), ["user_id", "k"], "event_id").select("user_id", "k", "event_id", "event_type")


@query(f"""SELECT user_id, k, min(event_id) AS event_id, min_by(value, event_id) AS value, true AS is_fake FROM {EV} e
WHERE event_type = 'view' AND NOT EXISTS (SELECT 1 FROM {EV} s WHERE s.event_type = 'signup' AND s.user_id = e.user_id AND s.k = e.k) GROUP BY user_id, k""")
def fake_rows(spark, sf_dir):
    e = _events(spark, sf_dir)
    missing = e.where("event_type = 'view'").join(e.where("event_type = 'signup'").select("user_id", "k"), ["user_id", "k"], "left_anti")
    return missing.groupBy("user_id", "k").agg(F.min("event_id").alias("event_id"), F.min_by("value", "event_id").alias("value"), F.lit(True).alias("is_fake"))


@query("""WITH a AS (SELECT user_id, event_id AS view_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k FROM events WHERE event_type = 'view'),
b AS (SELECT user_id, event_id AS purchase_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k FROM events WHERE event_type = 'purchase')
SELECT user_id, k, view_id, purchase_id FROM a JOIN b USING (user_id, k)""")
def ordinal_join(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    side = lambda kind: e.where(F.col("event_type") == kind).select("user_id", F.col("event_id").alias(f"{kind}_id"))
    return ordering.ordinal_join(side("view"), side("purchase"), "user_id", (["view_id"], ["purchase_id"]))


@query("""SELECT event_id, user_id, CASE WHEN event_type = 'error' THEN 'benchmark'
WHEN coalesce(max((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 THEN 'winner'
ELSE 'cached_winner' END AS launch_type FROM events""")
def launch_type(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("session_id"), (F.col("event_type") == "error").alias("is_benchmark"))
    return launch_types(e, "event_id").select("event_id", F.col("session_id").alias("user_id"), "launch_type")


_RANGES = """string_agg(CASE WHEN s = e THEN s::VARCHAR ELSE s::VARCHAR || '-' || e::VARCHAR END, ', ' ORDER BY s)"""


@query(f"""WITH r AS (SELECT event_type, event_id, event_id - row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS g FROM events),
i AS (SELECT event_type, min(event_id) AS s, max(event_id) AS e FROM r GROUP BY event_type, g)
SELECT event_type, count(*) AS islands, max(e - s + 1) AS longest, {_RANGES} AS ranges FROM i GROUP BY event_type""")
def index_ranges(spark, sf_dir):
    runs = ordering.islands(table(spark, sf_dir, "events"), "event_type", "event_id")
    listed = F.array_sort(F.collect_list(F.struct("start", "end")))
    return runs.groupBy("event_type").agg(F.count("*").alias("islands"), F.max(F.col("end") - F.col("start") + 1).alias("longest"), ordering.range_text(listed).alias("ranges"))


def _flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ordering.spread(_events(spark, sf_dir), "user_id").withColumn("i", ordering.ordinal("user_id", "event_id"))
    fields = [("event_type", F.col("event_type")), ("props.k", F.col("k").cast("string")), ("value_bucket", F.floor(F.col("value") / 25).cast("string")), ("timestamp", F.date_format("ts", "yyyy-MM-dd"))]
    each = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in fields])
    return e.select("user_id", "i", F.explode(each).alias("f")).select("user_id", "i", "f.key", "f.value").where("value is not null")


_FLAT_SQL = f"""e AS (SELECT user_id, event_type, k, value, ts, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM {EV}),
flat AS (SELECT user_id, i, 'event_type' AS key, event_type AS value FROM e UNION ALL SELECT user_id, i, 'props.k', k::VARCHAR FROM e
UNION ALL SELECT user_id, i, 'value_bucket', floor(value / 25)::BIGINT::VARCHAR FROM e UNION ALL SELECT user_id, i, 'timestamp', strftime(ts, '%Y-%m-%d') FROM e),
grp AS (SELECT user_id, key, value, count(*) AS count, min(i) AS first FROM flat WHERE value IS NOT NULL GROUP BY ALL),
cls AS (SELECT *, count(*) OVER (PARTITION BY user_id, key) AS n_values FROM grp)"""


@query(f"""WITH {_FLAT_SQL},
run AS (SELECT user_id, key, value, i, i - row_number() OVER (PARTITION BY user_id, key, value ORDER BY i) AS g FROM flat WHERE value IS NOT NULL),
isl AS (SELECT user_id, key, value, min(i) AS s, max(i) AS e FROM run GROUP BY user_id, key, value, g),
txt AS (SELECT user_id, key, value, {_RANGES} AS launches FROM isl GROUP BY ALL)
SELECT user_id, key, value, count, first, n_values, CASE WHEN n_values = 1 THEN 'same' WHEN key = 'timestamp' THEN 'summary' ELSE 'distribution' END AS kind, launches
FROM cls JOIN txt USING (user_id, key, value)""")
def launch_diff_values(spark, sf_dir):
    rows = launch_diff.classify(launch_diff.value_groups(_flat(spark, sf_dir), ["user_id"]), ["user_id"])
    return rows.withColumn("launches", ordering.range_text(F.col("launches")))


@query(f"""WITH {_FLAT_SQL}
SELECT user_id, key, CASE WHEN n_values = 1 THEN 'same' WHEN key = 'timestamp' THEN 'summary' ELSE 'distribution' END AS kind, n_values,
CASE WHEN n_values = 1 THEN min(value) END AS value, CASE WHEN n_values > 1 AND key <> 'timestamp' THEN string_agg(value || ':' || count, ',' ORDER BY first) END AS distribution
FROM cls GROUP BY user_id, key, n_values""")
def launch_diff_keys(spark, sf_dir):
    rows = launch_diff.launch_diff(_flat(spark, sf_dir), ["user_id"])
    shown = F.array_join(F.transform("values", lambda v: F.concat_ws(":", v["value"], v["count"].cast("string"))), ",")
    return rows.select("user_id", "key", "kind", "n_values", "value", shown.alias("distribution"))


QUERIES["launch_diff"] = QUERIES.pop("launch_diff_keys")
SQL["launch_diff"] = SQL.pop("launch_diff_keys")


@query(f"WITH {_FLAT_SQL} SELECT DISTINCT user_id, key, 'Varies across ' || n_values || ' unique values' AS summary FROM cls WHERE key = 'timestamp' AND n_values > 1")
def summary_fields(spark, sf_dir):
    rows = launch_diff.launch_diff(_flat(spark, sf_dir), ["user_id"])
    return rows.where("kind = 'summary'").select("user_id", "key", "summary")


@query("SELECT conv_id, substr(sha256(string_agg(role || ':' || turn, '|' ORDER BY turn)), 1, 16) AS session_id, count(*) AS frames FROM conversations GROUP BY conv_id")
def session_hash(spark, sf_dir):
    frames = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda f: F.concat_ws(":", f["role"], f["turn"].cast("string")))
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(frames.alias("f"))
    return c.select("conv_id", F.substring(F.sha2(F.array_join("f", "|"), 256), 1, 16).alias("session_id"), F.size("f").cast("long").alias("frames"))


_GROUPS = f"""f AS (SELECT user_id, k, min(event_id) AS o FROM {EV} GROUP BY user_id, k),
g AS (SELECT user_id, list(k ORDER BY o) AS ks FROM f GROUP BY user_id HAVING count(*) >= 2)"""


@query(f"WITH {_GROUPS} SELECT user_id, unnest(ks) AS k, len(ks) AS members, unnest(range(len(ks)))::INTEGER AS place FROM g")
def session_groups(spark, sf_dir):
    first = ordering.first_wins(_events(spark, sf_dir), ["user_id", "k"], "event_id")
    g = first.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "k"))).alias("ks")).where(F.size("ks") >= 2)
    return g.select("user_id", F.size("ks").cast("long").alias("members"), F.posexplode("ks").alias("place", "x")).select("user_id", F.col("x.k").alias("k"), "members", "place")


@query("""WITH w AS (SELECT user_id, k FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) WHERE event_type <> 'error'
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) SELECT k AS winner, count(*) AS sessions FROM w GROUP BY k""")
def winner_counts(spark, sf_dir):
    e = _events(spark, sf_dir).select(F.col("user_id").alias("session_id"), (F.col("event_type") == "error").alias("is_benchmark"), F.col("event_id").alias("ord"), F.col("k").cast("string").alias("hash"), F.col("k").alias("group_hash"))
    return winners(e).groupBy(F.col("group_hash").alias("winner")).agg(F.count("*").alias("sessions"))


@query(f"""WITH d AS (SELECT user_id, event_type, k % 10 AS value, count(*) AS count, min(event_id) AS first FROM {EV} GROUP BY ALL)
SELECT user_id, event_type, value, count, row_number() OVER (PARTITION BY user_id, event_type ORDER BY count DESC, first) AS rank,
count(*) OVER (PARTITION BY user_id, event_type) AS unique_count FROM d""")
def value_distribution(spark, sf_dir):
    args = _events(spark, sf_dir).select(F.col("user_id").alias("session_id"), F.col("event_type").alias("hash"), F.lit("k").alias("arg"), (F.col("k") % 10).alias("value"), F.col("event_id").alias("i"))
    return value_distributions(args).select(F.col("session_id").alias("user_id"), F.col("hash").alias("event_type"), "value", "count", F.col("place").cast("long").alias("rank"), "unique_count")


_OPS = "regexp_extract_all(coalesce(text, ''), '" + OPERATIONS["llir"].replace("'", "''") + "')"
def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal rows out where a file gives fewer tasks than there are cores; larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


_LINES = "CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len(string_split(regexp_replace(text, chr(10) || '$', ''), chr(10))) END"


@query(f"SELECT doc_id, ({_LINES})::BIGINT AS lines, len({_OPS})::BIGINT AS ops, len(list_distinct({_OPS}))::BIGINT AS kinds FROM documents")
def ir_stats(spark, sf_dir):
    d = compare.ir_stats(spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"), "llir")
    return d.select("doc_id", "lines", "ops", F.size("op_counts").cast("long").alias("kinds"))


@query(f"""WITH o AS (SELECT lang, list_sort(list_distinct(flatten(list({_OPS})))) AS ops FROM documents WHERE lang IS NOT NULL GROUP BY lang)
SELECT a.lang AS lang_a, b.lang AS lang_b, array_to_string(list_sort(list_filter(b.ops, lambda x: NOT list_contains(a.ops, x))), ',') AS added,
array_to_string(list_sort(list_filter(a.ops, lambda x: NOT list_contains(b.ops, x))), ',') AS removed FROM o a JOIN o b ON a.lang < b.lang""")
def op_diff(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("lang is not null").select("lang", F.explode_outer(F.array_distinct(operations(F.col("text"), "llir"))).alias("op"))
    o = d.distinct().groupBy("lang").agg(F.array_sort(F.collect_list("op")).alias("ops"))
    a, b = o.select(F.col("lang").alias("lang_a"), F.col("ops").alias("oa")), o.select(F.col("lang").alias("lang_b"), F.col("ops").alias("ob"))
    both = a.join(b, F.col("lang_a") < F.col("lang_b")).withColumn("c", compare.op_changes(F.col("oa"), F.col("ob")))
    return both.select("lang_a", "lang_b", F.array_join("c.added", ",").alias("added"), F.array_join("c.removed", ",").alias("removed"))


_LINE_ROWS = "(SELECT doc_id, lang, unnest(l) AS line, generate_subscripts(l, 1) AS line_no FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS l FROM documents))"


def _doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.posexplode(F.split("text", "\n", -1)).alias("p", "line"))
    return d.select("doc_id", "lang", "line", (F.col("p") + 1).cast("long").alias("line_no"))


@query(f"SELECT doc_id, line_no, length(line) AS chars, md5(line) AS digest FROM {_LINE_ROWS}")
def line_table(spark, sf_dir):
    return _doc_lines(spark, sf_dir).select("doc_id", "line_no", F.length("line").cast("long").alias("chars"), F.md5(F.col("line").cast("binary")).alias("digest"))


@query(f"""SELECT doc_id, line_no, last_value(CASE WHEN length(line) < 40 THEN line_no END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS head
FROM {_LINE_ROWS}""")
def carry_forward(spark, sf_dir):
    d = _doc_lines(spark, sf_dir)
    return d.select("doc_id", "line_no", ordering.carry_forward(F.when(F.length("line") < 40, F.col("line_no")), "doc_id", "line_no").alias("head"))


@query(f"""WITH b AS (SELECT item_id, lower(trim(unnest(string_split(text, '.')))) AS s FROM benchmark), d AS (SELECT DISTINCT doc_id, lower(trim(unnest(string_split(text, '.')))) AS s FROM documents)
SELECT d.doc_id, array_to_string(list_sort(list(DISTINCT item_id)), ',') AS items FROM d JOIN b USING (s) WHERE s <> '' GROUP BY d.doc_id""")
def line_join(spark, sf_dir):
    cut = lambda df, key: df.select(key, F.explode(F.split("text", r"\.", -1)).alias("s")).select(key, F.lower(F.trim("s")).alias("s")).where("s <> ''").distinct()
    both = cut(table(spark, sf_dir, "documents"), "doc_id").join(cut(table(spark, sf_dir, "benchmark"), "item_id"), "s")
    return both.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("item_id")), ",").alias("items"))


@query("""WITH t AS (SELECT page_id, unnest(l) AS part, generate_subscripts(l, 1) AS n FROM (SELECT page_id, string_split(html, '<') AS l FROM pages)),
g AS (SELECT page_id, regexp_extract(part, '^[a-zA-Z]+[0-9]?') AS tag, n FROM t)
SELECT page_id, tag, count(*) AS uses, md5(string_agg(n::VARCHAR, ',' ORDER BY n)) AS places FROM g WHERE tag <> '' GROUP BY page_id, tag""")
def python_map(spark, sf_dir):
    t = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.split("html", "<", -1)).alias("p", "part"))
    t = t.select("page_id", F.regexp_extract("part", "^[a-zA-Z]+[0-9]?", 0).alias("tag"), (F.col("p") + 1).alias("n")).where("tag <> ''")
    g = t.groupBy("page_id", "tag").agg(F.count("*").alias("uses"), F.array_sort(F.collect_list("n")).alias("ns"))
    return g.select("page_id", "tag", "uses", F.md5(F.array_join("ns", ",").cast("binary")).alias("places"))


@query(f"""WITH l AS (SELECT user_id, event_id AS s, event_id + k AS e FROM {EV} WHERE event_type = 'view')
SELECT user_id, s AS "start", e AS "end" FROM l a WHERE NOT EXISTS (SELECT 1 FROM l b WHERE b.user_id = a.user_id AND a.s < b.s AND b.e < a.e)""")
def loop_containment(spark, sf_dir):
    bounds = _events(spark, sf_dir).where("event_type = 'view'").select("user_id", F.col("event_id").alias("start"), (F.col("event_id") + F.col("k")).alias("end"))
    return ir_analysis.innermost(bounds, ["user_id"])


@query("""WITH b AS (SELECT user_id, quantile_disc(event_id, 0.5) AS mid, min(event_id) AS lo, max(event_id) AS hi FROM events GROUP BY user_id)
SELECT event_id, CASE WHEN event_id < (lo + mid) // 2 THEN 'prologue' WHEN event_id <= (mid + hi) // 2 THEN 'loop_body' ELSE 'epilogue' END AS region FROM events JOIN b USING (user_id)""")
def range_classify(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    b = e.groupBy("user_id").agg(F.expr("percentile_disc(0.5) within group (order by event_id)").cast("long").alias("mid"), F.min("event_id").alias("lo"), F.max("event_id").alias("hi"))
    return e.join(b, "user_id").select("event_id", ir_analysis.region(F.col("event_id"), F.expr("(lo + mid) div 2"), F.expr("(mid + hi) div 2")).alias("region"))


_ROOF = """r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity::BIGINT AS num_ctas, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size::BIGINT * 64 END AS per,
CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE l_suppkey * l_linenumber * 4 END AS args, p_size % 2 = 0 AS gemm, p_size::BIGINT * 1024 AS fl FROM lineitem JOIN part ON l_partkey = p_partkey),
o AS (SELECT *, CASE WHEN per IS NULL THEN args WHEN args IS NULL THEN per * num_ctas ELSE least(per * num_ctas, args) END AS bytes_moved, CASE WHEN gemm THEN fl * num_ctas END AS flops FROM r)"""


def _roofline(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.when(F.col("p_size") % 7 != 0, F.col("p_size").cast("long") * 64).alias("bytes_per_cta"), (F.col("p_size") % 2 == 0).alias("is_gemm"), (F.col("p_size").cast("long") * 1024).alias("flops_per_cta"))
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("long").alias("num_ctas"), F.when(F.col("l_linenumber") % 5 != 0, F.col("l_suppkey") * F.col("l_linenumber") * 4).alias("bytes_from_args"))
    return ir_analysis.estimate(line.join(part, "l_partkey"))


@query(f"WITH {_ROOF} SELECT l_orderkey, l_linenumber, l_partkey, num_ctas, bytes_moved, flops, round(flops / nullif(bytes_moved, 0), 6) AS arithmetic_intensity FROM o")
def roofline(spark, sf_dir):
    return _roofline(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "num_ctas", "bytes_moved", "flops", F.round("arithmetic_intensity", 6).alias("arithmetic_intensity"))


@query(f"WITH {_ROOF} SELECT num_ctas, bytes_moved, flops, count(*) AS count, min(l_orderkey) AS first FROM o GROUP BY ALL")
def roofline_profiles(spark, sf_dir):
    return _roofline(spark, sf_dir).groupBy("num_ctas", "bytes_moved", "flops").agg(F.count("*").alias("count"), F.min("l_orderkey").alias("first"))


@query(f"WITH {_ROOF} SELECT l_partkey, sum(bytes_moved)::BIGINT AS total, min(bytes_moved) AS least, max(bytes_moved) AS most, count(bytes_moved) AS known FROM o GROUP BY l_partkey")
def roofline_summary(spark, sf_dir):
    return _roofline(spark, sf_dir).groupBy("l_partkey").agg(F.sum("bytes_moved").alias("total"), F.min("bytes_moved").alias("least"), F.max("bytes_moved").alias("most"), F.count("bytes_moved").alias("known"))


_PAIRS = "p AS (SELECT x.vec_id, x.embedding::DOUBLE[] AS a, y.embedding::DOUBLE[] AS b FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1)"
_ZIP = "list_transform(range(1, len(a) + 1), lambda i: {})"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")


@query(f"""WITH {_PAIRS} SELECT vec_id, round(list_max({_ZIP.format("abs(a[i] - b[i])")}), 6) AS max_abs_error, round(list_avg({_ZIP.format("abs(a[i] - b[i])")}), 6) AS mean_abs_error,
round(list_max({_ZIP.format("abs(a[i] - b[i]) / greatest(abs(b[i]), 1e-12)")}), 4) AS max_rel_error, round(sqrt(list_avg({_ZIP.format("(a[i] - b[i]) * (a[i] - b[i])")})), 6) AS rmse,
round(list_cosine_similarity(a, b), 6) AS cosine, len(list_filter({_ZIP.format("abs(a[i] - b[i]) > 1e-5 + 1e-3 * abs(b[i])")}, lambda x: x))::BIGINT AS num_mismatched FROM p""")
def tensor_metrics(spark, sf_dir):
    m = compare.tensor_metrics(_pairs(spark, sf_dir), ["vec_id"])
    return m.select("vec_id", F.round("max_abs_error", 6).alias("max_abs_error"), F.round("mean_abs_error", 6).alias("mean_abs_error"), F.round("max_rel_error", 4).alias("max_rel_error"), F.round("rmse", 6).alias("rmse"), F.round("cosine_similarity", 6).alias("cosine"), "num_mismatched")


@query(f"""WITH {_PAIRS}, s AS (SELECT vec_id, abs(list_min(a) - list_min(b)) AS lo, abs(list_max(a) - list_max(b)) AS hi, abs(list_avg(a) - list_avg(b)) AS mean,
abs(list_stddev_samp(a) - list_stddev_samp(b)) AS std FROM p) SELECT vec_id, round(lo, 6) AS lo, round(hi, 6) AS hi, round(mean, 6) AS mean, round(std, 6) AS std,
CASE WHEN greatest(lo, hi, mean, std) = 0 THEN 'identical' WHEN greatest(lo, hi, mean, std) <= 0.05 THEN 'close' ELSE 'divergent' END AS status FROM s""")
def tensor_stats(spark, sf_dir):
    def mean(c):
        return F.aggregate(c, F.lit(0.0), lambda s, x: s + x) / F.size(c)

    def std(c):
        m = mean(c)
        return F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / (F.size(c) - 1))

    p = _pairs(spark, sf_dir)
    stats = {"lo": F.array_min, "hi": F.array_max, "mean": mean, "std": std}
    p = p.select("vec_id", *(F.abs(f(F.col("a")) - f(F.col("b"))).alias(n) for n, f in stats.items()))
    return p.select("vec_id", *(F.round(n, 6).alias(n) for n in stats), compare.stats_status([F.col(n) for n in stats], 0.05).alias("status"))


@query(f"""WITH {_PAIRS}, m AS (SELECT vec_id // 10 AS grp, list_max({_ZIP.format("abs(a[i] - b[i])")}) AS e FROM p),
s AS (SELECT grp, CASE WHEN e = 0 THEN 'identical' WHEN e < 0.4 THEN 'close' ELSE 'divergent' END AS status FROM m)
SELECT grp, CASE WHEN bool_or(status = 'divergent') THEN 'divergent' WHEN bool_and(status = 'identical') THEN 'identical' ELSE 'close' END AS overall, count(*) AS n FROM s GROUP BY grp""")
def tensor_status(spark, sf_dir):
    m = compare.tensor_metrics(_pairs(spark, sf_dir), ["vec_id"])
    m = m.select(F.expr("vec_id div 10").alias("grp"), F.when(F.col("max_abs_error") == 0, "identical").when(F.col("max_abs_error") < 0.4, "close").otherwise("divergent").alias("status"))
    return m.groupBy("grp").agg(compare.overall_status(F.collect_list("status")).alias("overall"), F.count("*").alias("n"))


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_orderstatus, o_orderpriority, floor(o_totalprice / 50000)::BIGINT::VARCHAR AS band, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
j AS (SELECT x.o_custkey, x.o_orderkey, x.o_orderstatus AS s1, y.o_orderstatus AS s2, x.o_orderpriority AS p1, y.o_orderpriority AS p2, x.band AS b1, y.band AS b2 FROM o x JOIN o y ON x.o_custkey = y.o_custkey AND y.n = x.n + 1),
u AS (SELECT o_custkey, o_orderkey, 'status' AS field, s1 AS a, s2 AS b FROM j UNION ALL SELECT o_custkey, o_orderkey, 'priority', p1, p2 FROM j UNION ALL SELECT o_custkey, o_orderkey, 'band', b1, b2 FROM j)
SELECT *, a IS NOT DISTINCT FROM b AS same FROM u""")
def metadata_diff(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.create_map(F.lit("status"), "o_orderstatus", F.lit("priority"), "o_orderpriority", F.lit("band"), F.floor(F.col("o_totalprice") / 50000).cast("string")).alias("a"))
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    pairs = o.withColumn("b", F.lead("a").over(w)).where("b is not null")
    return compare.compare_fields(pairs, ["o_custkey", "o_orderkey"], ("status", "priority", "band"))


_BEST = """WITH p AS (SELECT p_partkey, p_brand, p_type, p_size % 5 AS stages, p_size % 3 AS warps, p_retailprice AS shared FROM part),
c AS (SELECT x.p_partkey AS a, y.p_partkey AS b, CASE WHEN x.stages = y.stages THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN x.warps = y.warps THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END
+ 0.2::DOUBLE * least(x.shared, y.shared) / greatest(x.shared, y.shared) AS score FROM p x JOIN p y ON x.p_brand = y.p_brand AND x.p_type = y.p_type AND x.p_partkey <> y.p_partkey)
SELECT a, b, round(score, 6) AS score FROM c QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(score, 6) DESC, b) = 1"""


@query(_BEST)
def config_match(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", (F.col("p_size") % 5).alias("num_stages"), (F.col("p_size") % 3).alias("num_warps"), F.col("p_retailprice").alias("shared"))
    return matching.best_configs(p, "p_partkey", ["p_brand", "p_type"]).withColumnRenamed("p_partkey", "a")


@query(f"""WITH h AS (SELECT event_type, k, event_id < (SELECT max(event_id) / 2 FROM events) AS old, count(*) AS n FROM {EV} GROUP BY ALL),
a AS (SELECT event_type, k, n FROM h WHERE old), b AS (SELECT event_type, k, n FROM h WHERE NOT old)
SELECT event_type, k, CASE WHEN a.n IS NULL THEN 'only_in_b' WHEN b.n IS NULL THEN 'only_in_a' WHEN a.n = b.n THEN 'identical' WHEN abs(a.n - b.n) <= 2 THEN 'similar' ELSE 'different' END AS status,
coalesce(b.n, 0) - coalesce(a.n, 0) AS change FROM a FULL JOIN b USING (event_type, k)""")
def trace_diff(spark, sf_dir):
    e = _events(spark, sf_dir)
    last = F.broadcast(e.agg((F.max("event_id") / 2).alias("mid")))  # one row
    h = e.join(last).groupBy("event_type", "k").agg(F.count_if(F.col("event_id") < F.col("mid")).alias("a"), F.count_if(F.col("event_id") >= F.col("mid")).alias("b"))
    status = F.when(F.col("a") == 0, "only_in_b").when(F.col("b") == 0, "only_in_a").when(F.col("a") == F.col("b"), "identical").when(F.abs(F.col("a") - F.col("b")) <= 2, "similar").otherwise("different")
    return h.select("event_type", "k", status.alias("status"), (F.col("b") - F.col("a")).alias("change"))


@query(f"""WITH l AS (SELECT doc_id % 10 AS grp, doc_id % 2 AS side, line_no, count(*) AS n FROM {_LINE_ROWS} GROUP BY ALL),
a AS (SELECT grp // 2 AS pair, line_no, n FROM l WHERE side = 0), b AS (SELECT grp // 2 AS pair, line_no, n FROM l WHERE side = 1)
SELECT pair, line_no, coalesce(a.n, 0) AS a_lines, coalesce(b.n, 0) AS b_lines, coalesce(b.n, 0) - coalesce(a.n, 0) AS expansion FROM a FULL JOIN b USING (pair, line_no)""")
def by_line_full_outer(spark, sf_dir):
    per = _doc_lines(spark, sf_dir).groupBy((F.col("doc_id") % 10).alias("grp"), "line_no").agg(F.count("*").alias("n"))
    side = lambda s, name: per.where(F.col("grp") % 2 == s).select(F.expr("grp div 2").alias("pair"), "line_no", F.col("n").alias(name))
    out = side(0, "a_lines").join(side(1, "b_lines"), ["pair", "line_no"], "full").fillna(0, ["a_lines", "b_lines"])
    return out.withColumn("expansion", F.col("b_lines") - F.col("a_lines"))


@query(f"""SELECT event_type, count(*) AS records, count(*) FILTER (WHERE value < 0 OR value IS NULL) AS bad_value, count(*) FILTER (WHERE k IS NULL OR k < 0) AS bad_k,
count(*) FILTER (WHERE user_id IS NULL) AS no_user FROM {EV} GROUP BY event_type""")
def validate_counts(spark, sf_dir):
    e = _events(spark, sf_dir)
    return e.groupBy("event_type").agg(F.count("*").alias("records"), F.count_if(F.col("value").isNull() | (F.col("value") < 0)).alias("bad_value"), F.count_if(F.col("k").isNull() | (F.col("k") < 0)).alias("bad_k"), F.count_if(F.col("user_id").isNull()).alias("no_user"))


_STAGE_ROWS = ", ".join(f"('{b}', '{s[0]}', '{s[1]}', {s[2]}, {str(s[3]).lower()})" for b, rows in BACKEND_STAGES.items() for s in rows)


@query(f"""WITH s(backend, name, extension, place, viewable) AS (VALUES {_STAGE_ROWS}),
v AS (SELECT *, row_number() OVER (PARTITION BY backend ORDER BY place) AS n, count(*) OVER (PARTITION BY backend) AS c FROM s WHERE viewable)
SELECT backend, name, extension, n::BIGINT AS n, n <= 2 AS default_panel, n = c // 2 + 1 AS anchor FROM v""")
def stage_pick(spark, sf_dir):
    rows = [(b, s[0], s[1], s[2], s[3]) for b, stages in BACKEND_STAGES.items() for s in stages]
    s = spark.createDataFrame(rows, "backend string, name string, extension string, place int, viewable boolean").where("viewable")
    w = Window.partitionBy("backend")
    s = s.withColumn("n", F.row_number().over(w.orderBy("place")).cast("long")).withColumn("c", F.count("*").over(w))
    return s.select("backend", "name", "extension", "n", (F.col("n") <= 2).alias("default_panel"), (F.col("n") == F.expr("c div 2 + 1")).alias("anchor"))


@query("""WITH RECURSIVE r(conv_id, turn, steps) AS (SELECT conv_id, turn, 0 FROM conversations WHERE turn = 0
UNION SELECT c.conv_id, c.turn, r.steps + 1 FROM r JOIN conversations c ON c.conv_id = r.conv_id AND c.turn = r.turn + 1)
SELECT conv_id * 100000 + turn AS node, min(steps)::INTEGER AS steps FROM r GROUP BY ALL""")
def closure(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100000 + F.col("turn")).alias("node"), "turn").distinct()
    edges = c.select(F.col("node").alias("dst"), (F.col("node") - 1).alias("src")).join(c.select(F.col("node").alias("src")), "src")
    return ordering.closure(edges, c.where("turn = 0"))


@query("""WITH b AS (SELECT DISTINCT trim(unnest(string_split(text, '.'))) AS s FROM benchmark), d AS (SELECT DISTINCT doc_id, trim(unnest(string_split(text, '.'))) AS s FROM documents)
SELECT doc_id, count(*) AS kept FROM d WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.s = d.s) GROUP BY doc_id""")
def prune_map(spark, sf_dir):
    cut = lambda name, *keys: table(spark, sf_dir, name).select(*keys, F.explode(F.split("text", r"\.", -1)).alias("s")).select(*keys, F.trim("s").alias("s")).distinct()
    return cut("documents", "doc_id").join(cut("benchmark"), "s", "left_anti").groupBy("doc_id").agg(F.count("*").alias("kept"))


@query("""WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY event_type), o AS (SELECT event_type, sum(n) OVER (ORDER BY event_type) - n AS b FROM c)
SELECT event_id, event_type, (b + row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1)::BIGINT AS occurrence_id FROM events JOIN o USING (event_type)""")
def occurrence_ids(spark, sf_dir):
    return ordering.global_ids(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", "event_id")


@query("""WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, event_id FROM r WHERE n <= 5 OR list_contains(list_transform(range(5), lambda j: round_even(j * (n - 1) / 4.0, 0)::BIGINT), i)""")
def group_samples(spark, sf_dir):
    return samples(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id")


@query("""SELECT event_id, substr(sha256('{"event_type":"' || event_type || '","props":' || replace(props, ' ', '') || ',"user_id":' || user_id || '}'), 1, 16) AS group_hash FROM events""")
def group_hash(spark, sf_dir):
    from tracequarry.functions.canonical import launch_hash

    e = table(spark, sf_dir, "events")
    raw = F.concat(F.lit('{"user_id": '), F.col("user_id").cast("string"), F.lit(', "pid": 1, "event_type": '), F.to_json(F.array("event_type")).substr(F.lit(2), F.length(F.to_json(F.array("event_type"))) - 2), F.lit(', "timestamp": "t", "props": '), F.col("props"), F.lit("}"))
    return e.select("event_id", launch_hash(raw).alias("group_hash"))


@query()
def top_similar(spark, sf_dir):
    """The three part names most like the first part's: a report."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    first = F.broadcast(p.agg(F.min_by("p_name", "p_partkey").alias("wanted")))  # one row
    scored = p.join(first).withColumn("score", sequence_ratio(F.col("p_name"), F.col("wanted"))).where("score >= 0.6")
    return scored.orderBy(F.desc("score"), F.desc("p_name"), "p_partkey").limit(3).select("p_partkey", "p_name", "score")


@query()
def source_ratio(spark, sf_dir):
    """Likeness of consecutive documents."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = d.join(d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other")), "doc_id")
    return both.repartition(spark.sparkContext.defaultParallelism * 4, "doc_id").select("doc_id", sequence_ratio(F.col("text"), F.col("other")).alias("score"))


@query(f"SELECT lang, sum({_LINES})::BIGINT AS lines, count(*) AS texts FROM documents GROUP BY lang")
def line_totals(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(F.size(lines_of(F.col("text")))).alias("lines"), F.count("*").alias("texts"))
