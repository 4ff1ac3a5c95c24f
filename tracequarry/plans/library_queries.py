"""More of the library's functions applied to the star-schema tables, each beside SQL for the same
rows. Where a function reads trace texts, they are written from the columns of a row."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracequarry.config import AUTOTUNER_FILE
from tracequarry.functions import text, values
from tracequarry.operators import autotune, blobs, callgraph, compare, ir_analysis, kernels, matching, ordering, source_map, tensors
from tracequarry.plans import artifacts, traces
from tracequarry.plans.table_queries import EV, _events, _pairs, query, table


def _launch_rows(spark, sf_dir):
    args = F.struct(F.struct(F.lit("int").alias("type"), F.col("k").alias("value")).alias("k"))
    return _events(spark, sf_dir).withColumn("raw", F.to_json(F.struct(args.alias("extracted_args"))))


@query(f"SELECT event_id, user_id FROM {EV} WHERE k = 42")
def launch_filter(spark, sf_dir):
    return kernels.filter_launches(_launch_rows(spark, sf_dir), values.parse_filters("k=42")).select("event_id", "user_id")


@query("SELECT p_partkey, coalesce(p_name GLOB '*ar*' OR p_name GLOB 's*', false) AS traced FROM part")
def name_globs(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", values.glob_condition(F.col("p_name"), "*ar*, s*").alias("traced"))


@query("""SELECT doc_id, md5(trim(array_to_string(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '' AND NOT starts_with(ltrim(x), '#')), chr(10)))) AS digest
FROM documents""")
def source_normalized(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalized_source(F.col("text")).cast("binary")).alias("digest"))


@query("SELECT doc_id, CASE WHEN length(text) > 64 THEN substr(text, 1, 30) || '...' || right(text, 31) ELSE text END AS shown FROM documents")
def text_truncated(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.truncated(F.col("text"), 64, "middle").alias("shown"))


@query("SELECT doc_id, string_split(text, chr(10))[(doc_id % 3 + 1)::INTEGER] AS line FROM documents")
def source_lines(spark, sf_dir):
    line = text.source_line(F.col("text"), F.col("doc_id") % 3 + 10, F.lit(10))
    return table(spark, sf_dir, "documents").select("doc_id", line.alias("line"))


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'cuda:0' WHEN 1 THEN 'cpu' WHEN 2 THEN 'xpu' ELSE 'cpu' END AS device FROM part""")
def device_names(spark, sf_dir):
    named = F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("cuda:"), F.col("p_size").cast("string"))).when(F.col("p_size") % 4 == 1, "  ").when(F.col("p_size") % 4 == 2, " xpu ")
    return table(spark, sf_dir, "part").select("p_partkey", values.device(named).alias("device"))


@query("SELECT l_orderkey, l_linenumber, l_linenumber::BIGINT * (l_suppkey % 7 + 1) * (l_partkey % 3 + 1) AS programs FROM lineitem")
def programs(spark, sf_dir):
    grid = F.array(F.col("l_linenumber").cast("long"), (F.col("l_suppkey") % 7 + 1).cast("long"), (F.col("l_partkey") % 3 + 1).cast("long"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", values.num_ctas(grid).alias("programs"))


@query("""SELECT p_partkey, p_size::BIGINT * 16 * 2 AS load, p_size::BIGINT * 4 AS store, p_size::BIGINT * 36 AS total, p_size % 2 = 0 AS is_gemm,
CASE WHEN p_size % 2 = 0 THEN 2 * 16 * p_size::BIGINT * 32 END AS flops, CASE WHEN p_size % 2 = 0 THEN 16 * p_size::BIGINT * 32 * 16 END AS tile_bits FROM part""")
def tile_traffic(spark, sf_dir):
    n = F.col("p_size").cast("string")
    lines = [
        F.concat(F.lit("%0 = tt.load %a : tensor<"), n, F.lit("x16x!tt.ptr<f16>> loc(#loc1)")),
        F.concat(F.lit("tt.store %b, %0 : tensor<"), n, F.lit("x!tt.ptr<f32>>")),
        F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("%2 = tt.dot %x, %y : tensor<16x32xf16> * tensor<32x"), n, F.lit("xf16> -> tensor<16x"), n, F.lit("xf32>"))),
    ]
    # A file of many short rows is few tasks; their texts are long to read.
    p = table(spark, sf_dir, "part").repartition(spark.sparkContext.defaultParallelism * 4, "p_partkey").select("p_partkey", F.concat_ws("\n", *lines).alias("ir"))
    io, dot = ir_analysis.io_bytes(F.col("ir")), ir_analysis.dot_flops(F.col("ir"))
    p = p.select("p_partkey", io.alias("io"), dot.alias("dot"), ir_analysis.tile_bits(F.col("ir")).alias("tile_bits"))
    return p.select("p_partkey", "io.load", "io.store", "io.total", "dot.is_gemm", "dot.flops", "tile_bits")


@query("SELECT p_partkey, CASE WHEN p_size % 5 > 0 THEN p_size::BIGINT * 4 + p_size::BIGINT * 2 * 2 END AS bytes FROM part")
def arg_bytes(spark, sf_dir):
    one = lambda size: F.when(F.col("p_size") % 5 > 0, F.to_json(F.struct(F.col("p_size").alias("numel"), F.lit(size).alias("element_size")))).otherwise("{}")
    args = F.create_map(F.lit("x"), one(4), F.lit("in_out_ptr0"), one(2), F.lit("n"), F.lit("3"))
    return table(spark, sf_dir, "part").select("p_partkey", ir_analysis.bytes_of_args(args).alias("bytes"))


@query(f"""SELECT event_id, k % 3 = 0 AS is_benchmark, k % 3 = 1 AS is_winner, CASE WHEN k % 3 < 2 THEN substr(sha256('app.py:' || k || ':main'), 1, 16) END AS session_id
FROM {EV}""")
def tuner_sessions(spark, sf_dir):
    frame = lambda line, name, file: F.struct(line.cast("int").alias("line"), F.lit(name).alias("name"), F.lit(file).alias("filename"), F.lit("").alias("loc"))
    tuner = F.when(F.col("k") % 3 == 0, frame(F.lit(1), "_bench", AUTOTUNER_FILE)).when(F.col("k") % 3 == 1, frame(F.lit(2), "run", AUTOTUNER_FILE))
    e = _events(spark, sf_dir).withColumn("stack", F.filter(F.array(frame(F.col("k"), "main", "app.py"), tuner), lambda f: f.isNotNull()))
    stack = F.col("stack")
    return e.select("event_id", text.is_benchmark(stack).alias("is_benchmark"), text.is_winner_run(stack).alias("is_winner"), text.session_id(stack).alias("session_id"))


@query("""SELECT a.l_orderkey AS hash, a.l_linenumber::BIGINT AS ir_line, array_to_string(list_sort(list(DISTINCT b.l_linenumber::BIGINT + 100)), ',') AS lines
FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey % 5 = b.l_suppkey % 5 GROUP BY a.l_orderkey, a.l_linenumber""")
def stage_links(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    side = lambda line, key: rows.select(F.col("l_orderkey").alias("hash"), line.cast("long").alias("ir_line"), F.lit("f").alias("file"), (F.col(key) % 5).alias("line"))
    linked = source_map.link_stages(side(F.col("l_linenumber"), "l_partkey"), side(F.col("l_linenumber") + 100, "l_suppkey"), ["hash"], by_column=False)
    return linked.select("hash", "ir_line", F.array_join("target_lines", ",").alias("lines"))


def _maps(spark, sf_dir, where):
    rows = table(spark, sf_dir, "lineitem").where(where)
    return rows.select((F.col("l_suppkey") % 20).alias("hash"), F.lit("f").alias("file"), (F.col("l_partkey") % 50).alias("line"), F.col("l_returnflag").alias("stage"), F.col("l_linenumber").cast("int").alias("ir_line"))


@query("""SELECT l_suppkey % 20 AS hash, l_partkey % 50 AS line, l_returnflag AS stage, array_to_string(list_sort(list(DISTINCT l_linenumber::INTEGER)), ',') AS lines
FROM lineitem GROUP BY ALL""")
def python_lines(spark, sf_dir):
    rows = source_map.by_python_line(_maps(spark, sf_dir, "true"), ["hash"])
    return rows.select("hash", "line", "stage", F.array_join("ir_lines", ",").alias("lines"))


@query("""WITH l AS (SELECT l_suppkey % 20 AS hash, l_partkey % 50 AS line, l_returnflag AS stage, l_linestatus = 'O' AS old, count(DISTINCT l_linenumber) AS n FROM lineitem WHERE l_linestatus IN ('O', 'F') GROUP BY ALL),
a AS (SELECT * FROM l WHERE old), b AS (SELECT * FROM l WHERE NOT old),
e AS (SELECT hash, line, coalesce(b.n, 0) - coalesce(a.n, 0) AS x FROM a FULL JOIN b USING (hash, line, stage)), p AS (SELECT hash, line, max((x <> 0)::INT) AS d, sum(x) AS x FROM e GROUP BY hash, line)
SELECT hash, count(*) AS lines_compared, sum(d)::BIGINT AS lines_with_diff, sum(x)::BIGINT AS total_expansion FROM p GROUP BY hash""")
def line_changes(spark, sf_dir):
    side = lambda s: source_map.by_python_line(_maps(spark, sf_dir, f"l_linestatus = '{s}'"), ["hash"]).drop("file")
    return compare.line_stats(compare.compare_lines(side("O"), side("F"), ["hash"]), ["hash"])


@query("""WITH r AS (SELECT o_custkey, o_orderstatus AS s, o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS n FROM orders)
SELECT a.o_orderkey AS idx_a, b.o_orderkey AS idx_b FROM r a JOIN r b USING (o_custkey, n) WHERE a.s = 'O' AND b.s = 'F'""")
def hash_matches(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    side = lambda s: orders.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").cast("string").alias("hash"), F.col("o_orderkey").alias("idx"))
    return matching.match_by_hash(side("O"), side("F")).select("idx_a", "idx_b")


@query("""SELECT p_partkey, CASE WHEN p_brand = p_type THEN '' WHEN p_size % 2 = 0 THEN 'b' ELSE 'a' END AS kept FROM part""")
def pruned_entries(spark, sf_dir):
    asm = F.create_map(F.lit("a"), F.col("p_brand"), F.lit("b"), F.col("p_type"))
    held = F.create_map(F.lit("x"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(F.col("p_type")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.map_keys(traces.pruned(asm, held)), ",").alias("kept"))


@query("SELECT o_orderkey, md5(o_orderkey::VARCHAR) || substr(md5(o_orderkey::VARCHAR), 1, 8) AS blamed, substr(md5(o_orderkey::VARCHAR), 1, 12) AS found FROM orders")
def blamed_commits(spark, sf_dir):
    digest = F.md5(F.col("o_orderkey").cast("string").cast("binary"))
    said = F.concat(F.lit("Bisecting\n"), digest, F.substring(digest, 1, 8), F.lit(" is the first bad commit\n"))
    listed = F.concat(F.lit("commits so far\n  "), F.substring(digest, 1, 12), F.lit("\nthat is all"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.culprit(said).alias("blamed"), text.commit_hash(listed).alias("found"))


_ZIPPED = "list_transform(range(1, len(x.embedding) + 1), lambda i: {})"


@query(f"""WITH p AS (SELECT x.vec_id, list_max({_ZIPPED.format("abs(x.embedding[i]::DOUBLE - y.embedding[i]::DOUBLE)")}) AS e,
len(list_filter({_ZIPPED.format("abs(x.embedding[i]::DOUBLE - y.embedding[i]::DOUBLE) > 1e-5 + 1e-3 * abs(y.embedding[i]::DOUBLE)")}, lambda z: z)) AS n
FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1)
SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN 'shape_mismatch' WHEN vec_id % 10 = 1 THEN 'dtype_mismatch' WHEN vec_id % 10 = 2 THEN 'load_error' WHEN e = 0 THEN 'identical' WHEN n = 0 THEN 'close' ELSE 'divergent' END AS status,
CASE WHEN vec_id % 10 > 2 THEN round(e, 6) END AS error FROM p""")
def tensor_args(spark, sf_dir):
    pairs = _pairs(spark, sf_dir).select("vec_id")
    last = F.col("vec_id") % 10

    def arg(place, other: bool):
        shape = F.when(F.lit(other) & (last == 0), F.lit(2)).otherwise(F.lit(1))
        kind = F.when(F.lit(other) & (last == 1), F.lit("f16")).otherwise(F.lit("f32"))
        path = F.when(F.lit(other) & (last == 2), F.lit("lost")).otherwise(place.cast("string"))
        return F.create_map(F.lit("x"), F.to_json(F.struct(F.lit("tensor").alias("type"), F.array(shape).alias("shape"), kind.alias("dtype"), path.alias("blob_path"))))

    pairs = pairs.select("vec_id", arg(F.col("vec_id"), False).alias("args_a"), arg(F.col("vec_id") + 1, True).alias("args_b"))
    blobs = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("blob_path"), F.col("embedding").cast("array<double>").alias("values"))
    return tensors.compare_args(pairs, ["vec_id"], blobs).select("vec_id", "status", F.round("error", 6).alias("error"))


@query("""SELECT event_id, event_id % 2 AS rank, user_id, CASE WHEN event_type = 'error' THEN 'benchmark'
WHEN coalesce(max((event_type = 'error')::INT) OVER (PARTITION BY event_id % 2, user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 THEN 'winner'
ELSE 'cached_winner' END AS launch_type FROM events""")
def launch_type_by_rank(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 2).alias("rank"), F.col("user_id").alias("session_id"), (F.col("event_type") == "error").alias("is_benchmark"))
    return autotune.launch_types(e, "event_id").select("event_id", "rank", F.col("session_id").alias("user_id"), "launch_type")


@query(f"""WITH e AS (SELECT event_id, event_id % 2 AS rank, user_id, event_type AS hash, k, k % 50 AS g, CASE WHEN k % 50 < 40 THEN 7 ELSE k % 3 END AS third FROM {EV}),
last AS (SELECT rank, g, arg_max(hash, event_id) AS hash, arg_max(k, event_id) AS k, arg_max(third, event_id) AS third FROM e GROUP BY rank, g),
rep AS (SELECT * FROM (SELECT DISTINCT rank, user_id, g FROM e) JOIN last USING (rank, g)),
arg AS (SELECT rank, user_id, hash, 'k' AS arg, k AS value FROM rep UNION ALL SELECT rank, user_id, hash, 'third' AS arg, third AS value FROM rep),
config AS (SELECT rank, user_id, count(DISTINCT hash) AS n FROM rep GROUP BY rank, user_id),
per AS (SELECT rank, user_id, arg, count(DISTINCT value) AS n_values, count(DISTINCT hash) AS seen, any_value(value) AS value FROM arg GROUP BY ALL)
SELECT rank, user_id, arg, CASE WHEN n_values = 1 AND seen = n THEN 'same' ELSE 'varies' END AS kind,
CASE WHEN n_values = 1 AND seen = n THEN '{{"type":"int","value":' || value || '}}' END AS value FROM per JOIN config USING (rank, user_id)""")
def session_arguments(spark, sf_dir):
    third = F.when(F.col("k") % 50 < 40, 7).otherwise(F.col("k") % 3)
    arg = lambda c: F.struct(F.lit("int").alias("type"), c.alias("value"))
    args = F.struct(arg(F.col("k")).alias("k"), arg(third).alias("third"))
    e = _events(spark, sf_dir).select((F.col("event_id") % 2).alias("rank"), F.col("user_id").alias("session_id"), F.col("event_type").alias("hash"), (F.col("k") % 50).alias("group_hash"), "event_id", F.to_json(F.struct(args.alias("extracted_args"))).alias("raw"))
    reps = autotune.representatives(e, "event_id", "event_id")
    spread = autotune.value_distributions(autotune.arguments(reps))
    kinds = autotune.shared_and_varied(spread, reps.select("rank", "session_id", "hash"))
    return kinds.select("rank", F.col("session_id").alias("user_id"), "arg", "kind", "value")


@query("""WITH h AS (SELECT doc_id, length(text) AS n, histogram(c) AS m FROM (SELECT doc_id, text, unnest(string_split(text, '')) AS c FROM documents WHERE length(text) > 0) GROUP BY doc_id, text)
SELECT x.doc_id, 2 * coalesce(list_sum(list_transform(map_keys(x.m), lambda c: least(x.m[c], coalesce(y.m[c], 0)))), 0)::DOUBLE / (x.n + y.n) AS bound
FROM h x JOIN h y ON y.doc_id = x.doc_id + 1""")
def letter_bounds(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("length(text) > 0").select("doc_id", F.length("text").alias("n"), matching.letter_counts(F.col("text")).alias("m"))
    both = d.join(d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("n").alias("k"), F.col("m").alias("o")), "doc_id")
    return both.select("doc_id", matching.ratio_bound(F.col("m"), F.col("o"), F.col("n") + F.col("k")).alias("bound"))


@query(f"SELECT event_id, (sum(k) OVER (ORDER BY event_id))::BIGINT AS total FROM {EV}")
def running_totals(spark, sf_dir):
    return ordering.cumulative(_events(spark, sf_dir).select("event_id", "k"), "event_id", "k", "total").select("event_id", "total")


@query("""WITH f AS (SELECT o_custkey AS digest, min(o_orderkey) AS ord, arg_min(o_orderkey % 97, o_orderkey) AS size FROM orders WHERE o_orderkey % 97 <= 90 GROUP BY o_custkey),
u AS (SELECT digest, ord, (sum(size) OVER (ORDER BY ord))::BIGINT AS used, sum(size) OVER () AS everything FROM f)
SELECT digest, used FROM u WHERE used <= 20000""")
def stored_blobs(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("digest"), F.col("o_orderkey").alias("ord"), (F.col("o_orderkey") % 97).alias("size"))
    return blobs.stored(o, 20000, 90).select("digest", "used")


@query("""WITH e AS (SELECT event_id, user_id, coalesce(event_type = 'error', false) AS now, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) = 'error', false) AS had FROM events)
SELECT event_id, user_id, CASE WHEN now THEN 'enable' ELSE 'disable' END AS edge FROM e WHERE now <> had""")
def phase_edges(spark, sf_dir):
    return ordering.phase_edges(_events(spark, sf_dir), "user_id", "event_id", F.col("event_type") == "error").select("event_id", "user_id", "edge")


_IMPORTS = "SELECT DISTINCT o_custkey % 1000 AS file, (o_orderkey * 7 + o_custkey) % 1300 AS module FROM orders"


def _imports(spark, sf_dir):
    """Orders as imports of modules, those from 1000 on outside the catalogue."""
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 1000).alias("f"), ((F.col("o_orderkey") * 7 + F.col("o_custkey")) % 1300).alias("m")).distinct()
    name = lambda c: F.concat(F.lit("pkg.m"), F.col(c).cast("string"))
    rows = o.select(F.col("f").cast("string").alias("file"), F.lit("from").alias("kind"), name("m").alias("module"), F.concat(F.lit("n"), F.col("m").cast("string")).alias("name"))
    modules = o.select(F.col("f").alias("m")).union(o.select("m")).where("m < 1000").distinct().select(name("m").alias("module"), F.col("m").cast("string").alias("path"))
    return rows, modules, o.where("f % 300 = 1").select(F.col("f").cast("string").alias("node")).distinct()


@query(f"""WITH RECURSIVE i AS ({_IMPORTS}), r(node, steps) AS (SELECT DISTINCT file, 0 FROM i WHERE file % 300 = 1
UNION SELECT module, steps + 1 FROM r JOIN i ON file = node WHERE module < 1000 AND steps < 150)
SELECT node::VARCHAR AS node, min(steps)::INTEGER AS steps FROM r GROUP BY node""")
def import_levels(spark, sf_dir):
    return callgraph.import_levels(*_imports(spark, sf_dir))


@query(f"""WITH i AS ({_IMPORTS}) SELECT file::VARCHAR AS file, 'pkg.m' || module AS module, CASE WHEN module < 1000 AND module % 10 <> 3 THEN module::VARCHAR END AS path,
module >= 1000 OR module % 10 = 3 AS external FROM i""")
def import_resolved(spark, sf_dir):
    rows, modules, _ = _imports(spark, sf_dir)
    foreign = F.col("module").rlike("3$")
    rows = rows.withColumn("module", F.when(foreign, F.concat(F.lit("torch."), "module")).otherwise(F.col("module")))
    modules = modules.unionByName(modules.withColumn("module", F.concat(F.lit("torch."), "module")))
    return callgraph.resolve(rows, modules, ("torch",)).select("file", F.regexp_replace("module", "^torch[.]", "").alias("module"), "path", "external")


@query("""WITH d AS (SELECT doc_id, octet_length(encode(text)) AS n FROM documents WHERE text IS NOT NULL)
SELECT doc_id, 'ptx' AS stage, CASE WHEN n % 2 = 0 THEN n::VARCHAR ELSE '<error dumping derived artifact with counter: odd>' END AS content, CASE WHEN n % 2 = 1 THEN 'ValueError' END AS error FROM d
UNION ALL SELECT doc_id, 'sass', length(n::VARCHAR)::VARCHAR, NULL FROM d WHERE n % 2 = 0""")
def derived_artifacts(spark, sf_dir):
    def count(data: bytes) -> str:
        if len(data) % 2:
            raise ValueError("odd")
        return str(len(data))

    known = artifacts.Artifacts()
    known.register("cuda", "sass", "ptx", "again", lambda data: str(len(data)))
    known.register("cuda", "ptx", "ttir", "counter", count)
    key = F.col("doc_id").cast("string")
    files = table(spark, sf_dir, "documents").select(key.alias("hash"), F.concat(key, F.lit(".ttir")).alias("file"), F.lit("cuda").alias("backend"), F.lit("ttir").alias("stage"), F.col("text").cast("binary").alias("content"))
    made = artifacts.derived(files, known, "all")
    return made.select(F.col("hash").cast("long").alias("doc_id"), "stage", F.col("content").cast("string").alias("content"), "error")
