"""The registered queries of this subpackage: thin digests of the operators' results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TOKENIZER_DIR: str | None = None


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies; ``TOKENIZER_DIR`` overrides the installed place."""
    if TOKENIZER_DIR:
        return f"{TOKENIZER_DIR}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracequarry.llm.itq import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"))


def url_rules():
    from tracequarry.llm.url_filter import Rule

    return [
        Rule("allow", "com"),
        Rule("block", "example.com", "/en/"),
        Rule("allow", "www.example.com", "/en/"),
        Rule("block", "net", "/es/"),
        Rule("block", "net", "/fr/"),
    ]


def op2_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracequarry.llm.url_filter import judge_pages

    return judge_pages(_table(spark, sf_dir, "pages"), url_rules()).drop("component")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracequarry.llm.line_dedup import similar_lines

    return similar_lines(_table(spark, sf_dir, "documents")).drop("text_hash")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracequarry.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracequarry.llm.langid import held_out, identify_documents

    found = identify_documents(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracequarry.llm.mixing import mix_sizes

    return mix_sizes(_table(spark, sf_dir, "documents")).drop("source")


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracequarry.llm.token_output import read_tokens, write_tokens

    return read_tokens(write_tokens(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json")))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tracequarry.llm.secret_scan import scan_secrets, span_text

    found = scan_secrets(_table(spark, sf_dir, "documents"))
    def of_kind(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    count = [of_kind(kind) for kind in ("assign", "access", "hex")]
    spans = span_text(F.array_sort(F.concat("base", "added")))
    return found.select("doc_id", *count, F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), spans.alias("spans"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracequarry.llm.minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracequarry.llm.media import media_features

    return media_features(_table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tracequarry.llm.periodic import longest, periodic_runs, with_repeats

    found = periodic_runs(with_repeats(_table(spark, sf_dir, "documents")))
    each = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest(F.col("runs")).alias("r"), F.sha2(F.array_join(each, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    exponent = F.floor(1000 * F.col("r.length") / F.col("r.period")).alias("exponent_milli")
    return found.select("doc_id", "n_runs", "r.start", "r.length", "r.period", exponent, "runs_sha256", "collapsed_sha256")


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tracequarry.llm.pieces import decode_pieces, encode_pieces

    model = tokenizer_path("piece_bpe_32k.model")
    decoded = decode_pieces(encode_pieces(_table(spark, sf_dir, "documents"), model), model)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tracequarry.llm.resampling import resample

    return resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


#: Components of a table link(a, b): least node reached, by transitive closure.
_CLOSURE = """
    reach(a, b) AS (
        SELECT a, b FROM link
        UNION
        SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
    ),
    comp AS (SELECT a, least(a, min(b)) AS c FROM reach GROUP BY a)
"""

OP9_SQL = f"""
WITH RECURSIVE
    words AS (
        SELECT doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\\x20\\x09-\\x0D]+') AS w
        FROM documents
    ),
    shingle AS (
        SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
        FROM words
    ),
    size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
    common AS (
        SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k
        FROM shingle x JOIN shingle y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL
    ),
    link AS (
        SELECT a, b FROM common JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b
        WHERE 100 * k >= 75 * (p.n + q.n - k)
    ),
    {_CLOSURE}
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id,
       d.doc_id = coalesce(c, d.doc_id) AS kept
FROM documents d LEFT JOIN size s ON s.doc_id = d.doc_id LEFT JOIN comp ON comp.a = d.doc_id
"""

OP1_SQL = f"""
WITH RECURSIVE
    v AS (
        SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    ),
    link AS (
        SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
        WHERE list_cosine_similarity(x.e, y.e) >= 0.9
    ),
    {_CLOSURE},
    degree AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(c, vec_id) AS component_id, vec_id = coalesce(c, vec_id) AS kept
FROM embeddings e LEFT JOIN comp ON comp.a = vec_id LEFT JOIN degree d ON d.a = vec_id
"""

#: A URL without scheme and fragment, as the operator's nodes are.
_NODE = """CASE WHEN contains({u}, '://') THEN
    translate(regexp_extract(regexp_extract({u}, '(?s)^.*?://(.*)$', 1), '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
    || coalesce(regexp_extract(regexp_extract({u}, '(?s)^.*?://(.*)$', 1), '^[^/?#]*(/[^?#]*)?', 1), '')
    || coalesce(regexp_extract({u}, '^[^#?]*(\\?[^#]*)', 1), '') END"""

OP2_SQL = f"""
WITH RECURSIVE
    rules(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
        ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
    parts AS (
        SELECT row_number() OVER () AS id, page_id, url, html, {_NODE.format(u="url")} AS node,
            coalesce(translate(regexp_extract(regexp_extract(url, '(?s)^.*?://(.*)$', 1), '^[^/?#]*', 0),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
            coalesce(regexp_extract(regexp_extract(url, '(?s)^.*?://(.*)$', 1), '^[^/?#]*(/[^?#]*)?', 1), '') AS path
        FROM pages
    ),
    target AS (
        SELECT node, unnest(list_concat(
            list_transform(regexp_extract_all(coalesce(html, ''), '(?i)<link\\s[^>]*\\brel\\s*=\\s*["'']?[^"''>]*\\bcanonical\\b[^>]*>'),
                lambda x: regexp_extract(x, '(?i)\\bhref\\s*=\\s*["'']?([^\\s"''>]+)', 1)),
            list_transform(regexp_extract_all(coalesce(html, ''), '(?i)<meta\\s[^>]*\\bhttp-equiv\\s*=\\s*["'']?refresh[^>]*>'),
                lambda x: regexp_extract(x, '(?i)\\burl\\s*=\\s*[''"]?([^''"\\s>]+)', 1)))) AS t
        FROM parts
    ),
    edge AS (SELECT node AS a, {_NODE.format(u="t")} AS b FROM target WHERE contains(t, '://')),
    link AS (SELECT a, b FROM edge WHERE a <> b UNION SELECT b, a FROM edge WHERE a <> b),
    {_CLOSURE},
    best AS (
        SELECT id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
        FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY id
    ),
    bad AS (
        SELECT c FROM comp JOIN rules r ON (regexp_extract(a, '^[^/?]*', 0) = h OR ends_with(regexp_extract(a, '^[^/?]*', 0), '.' || h))
            AND starts_with(regexp_extract(a, '^[^/?]*(/[^?]*)?', 1), p)
        GROUP BY c, a HAVING arg_max(verdict, length(h || p)) = 'block'
    )
SELECT page_id, host, path, rule,
    coalesce(verdict, CASE WHEN (SELECT c FROM comp WHERE a = node) IN (SELECT c FROM bad) THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN best USING (id)
"""

OP6_SQL = """
WITH
    own AS (
        SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
            coalesce(md5(doc_id::VARCHAR), '') AS key
        FROM documents
    ),
    total AS (
        SELECT *, [1, 2, 3][(pos - 1) % 3 + 1]::DOUBLE AS weight, (3 * source_size)::DOUBLE AS cap, (sum(source_size) OVER ())::BIGINT AS everything
        FROM (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS pos FROM own GROUP BY source)
    ),
    level AS (
        SELECT *, (everything - coalesce(sum(cap) OVER (ORDER BY cap / weight, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) * weight > cap AS capped
        FROM total
    ),
    aim AS (
        SELECT *, CASE WHEN capped THEN cap ELSE least(cap, weight * ((everything - coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0))
            / sum(CASE WHEN NOT capped THEN weight END) OVER ())) END AS target,
            greatest(1, least(source_size, greatest(ceil(source_size / greatest(1.0, everything / 262144)), 256)))::BIGINT AS n_blocks
        FROM level
    ),
    slotted AS (SELECT *, CASE WHEN source_size > 0 THEN target * n_blocks / source_size ELSE 0 END AS n_slots FROM aim),
    share AS (
        SELECT pos, n_blocks, CASE WHEN pos = max(pos) OVER () THEN 2.0 ELSE high END AS high, coalesce(lag(high) OVER (ORDER BY pos), 0.0) AS low
        FROM (SELECT *, sum(n_slots) OVER (ORDER BY pos) / sum(n_slots) OVER () AS high FROM slotted WHERE n_slots > 0)
    ),
    slot AS (SELECT range AS slot, ((range + 0.5::DOUBLE) * 0.6180339887498949::DOUBLE) % 1.0::DOUBLE AS u FROM range((SELECT round(sum(n_slots))::BIGINT FROM slotted))),
    ranked AS (
        SELECT pos, n_blocks, row_number() OVER (PARTITION BY pos ORDER BY slot) - 1 AS rank
        FROM slot JOIN share ON u >= low AND u < high
    ),
    uses AS (SELECT pos, rank % n_blocks AS block, count(*) AS uses FROM ranked WHERE rank < 3 * n_blocks GROUP BY ALL),
    placed AS (
        SELECT row_number() OVER () AS id, doc_id, size, source_size, target, pos, n_blocks,
            (sum(size) OVER (PARTITION BY pos ORDER BY key, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING))::BIGINT AS stop
        FROM own JOIN slotted ON own.source IS NOT DISTINCT FROM slotted.source
    ),
    cut AS (
        SELECT id, unnest(range(((stop - size + 1) * n_blocks - 1) // source_size, (stop * n_blocks - 1) // source_size + 1)) AS block FROM placed WHERE size > 0
    ),
    taken AS (
        SELECT id, sum((least(stop, (block + 1) * source_size // n_blocks) - greatest(stop - size, block * source_size // n_blocks)) * uses)::BIGINT AS taken
        FROM cut JOIN placed USING (id) JOIN uses USING (pos, block) GROUP BY id
    )
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM placed LEFT JOIN taken USING (id)
"""

OP3_SQL = """
WITH
    lines AS (
        SELECT doc_id, generate_subscripts(l, 1) - 1 AS line_no, unnest(l) AS line
        FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)
    ),
    words AS (
        SELECT doc_id, line_no, regexp_extract_all(
            lower(line), '[^\\x20\\x09-\\x0D]+') AS w
        FROM lines
    ),
    tokens AS (
        SELECT doc_id, line_no, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS t
        FROM words
    ),
    class AS (
        SELECT row_number() OVER () AS c, t, len(t) AS size, count(*) AS n, arg_min(doc_id, (doc_id, line_no)) AS class_doc_id,
            arg_min(line_no, (doc_id, line_no)) AS class_line_no
        FROM tokens WHERE len(t) > 0 GROUP BY t
    ),
    post AS (SELECT c, size, unnest(t) AS s FROM class),
    common AS (SELECT x.c AS a, y.c AS b, count(*) AS k, any_value(x.size) AS p, any_value(y.size) AS q FROM post x JOIN post y ON x.s = y.s AND x.c <> y.c GROUP BY ALL),
    linked AS (
        SELECT a AS c, sum(y.n)::BIGINT AS more, min((y.class_doc_id, y.class_line_no)) AS other
        FROM common JOIN class y ON y.c = b WHERE 100 * k >= 75 * (p + q - k) GROUP BY a
    )
SELECT doc_id, line_no::INTEGER AS line_no, len(tokens.t)::BIGINT AS n_tokens, class_doc_id, class_line_no::INTEGER AS class_line_no,
    coalesce(n - 1 + coalesce(more, 0), 0)::BIGINT AS n_links,
    coalesce((doc_id, line_no) > least((class_doc_id, class_line_no), coalesce(other, (class_doc_id, class_line_no))), false) AS removed
FROM tokens LEFT JOIN class ON class.t = tokens.t LEFT JOIN linked USING (c)
"""

#: CRC-32 is computed byte by byte, with its table of 256 values made from the polynomial.
OP13_SQL = """
WITH
    own AS (
        SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
        FROM documents
    ),
    aim AS (
        SELECT unnest(regexp_extract_all(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word
        FROM benchmark
    ),
    feature AS (SELECT id, unnest(w) AS word FROM own),
    tab AS (
        SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k:
            CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t
    ),
    word_bucket AS (
        SELECT word, xor(list_reduce(list_transform(range(1, len(hex(word)) + 1, 2), lambda i: ('0x' || substr(hex(word), i, 2))::BIGINT),
            lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket
        FROM (SELECT word FROM feature UNION SELECT word FROM aim), tab
    ),
    s AS (SELECT bucket, count(*) AS s FROM feature JOIN word_bucket USING (word) GROUP BY bucket),
    t AS (SELECT bucket, count(*) AS t FROM aim JOIN word_bucket USING (word) GROUP BY bucket),
    gain AS (
        SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE)
            / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain
        FROM s FULL JOIN t USING (bucket)
    ),
    summed AS (SELECT id, sum(gain)::BIGINT AS weight FROM feature JOIN word_bucket USING (word) JOIN gain USING (bucket) GROUP BY id),
    scored AS (
        SELECT id, doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln(
            (('0x' || left(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
        FROM own LEFT JOIN summed USING (id)
    ),
    ranked AS (SELECT id, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank
FROM scored LEFT JOIN ranked USING (id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_itq": op1_itq,
        "op2_redirect_equivalence": op2_redirect_equivalence,
        "op3_line_dedup": op3_line_dedup,
        "op4_best_fit_packing": op4_best_fit_packing,
        "op5_language_id": op5_language_id,
        "op6_mixing": op6_mixing,
        "op7_token_output": op7_token_output,
        "op8_secret_scan": op8_secret_scan,
        "op9_minhash": op9_minhash,
        "op10_media": op10_media,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_sentencepiece": op12_sentencepiece,
        "op13_resampling": op13_resampling,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_itq": OP1_SQL, "op2_redirect_equivalence": OP2_SQL, "op3_line_dedup": OP3_SQL, "op6_mixing": OP6_SQL, "op9_minhash": OP9_SQL, "op13_resampling": OP13_SQL}
