"""Target-distribution importance resampling over hashed n-grams of words.

Words go to a position table; ``lead`` within a row's words puts the words that follow beside each
one, so every order of n-grams is a column. N-grams are hashed to buckets, buckets counted over all
documents and over the target's texts, and a document weighs the sum of its n-grams' gains: by how
much more often the target has their buckets. Noise of Gumbel's distribution, fixed by the document's
id, turns the highest sums into a sample without replacement.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracequarry.llm.common import materialize

#: Words of a text after A-Z became a-z: digits, letters and all beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Ranges that the drawn order is ranked in, at most.
MOST_RANGES = 4096
#: Equal rows that are written from one list.
COPIES = 1 << 16


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def features(rows: DataFrame, orders: int, buckets: int) -> DataFrame:
    """The n-grams of every row of ``rows`` (``doc_id``, ``text`` and ``_row``, which tells rows
    apart): ``_row``, ``doc_id``, ``pos`` and ``bucket``. Rows that are equal in all three columns
    come one after another at each position. A row without words has one line, with nulls."""
    at = rows.select("_row", "doc_id", F.posexplode_outer(_words(F.col("text"))).alias("pos", "word"))
    bucket = lambda gram: F.crc32(gram.cast("binary")) % buckets
    if orders == 1:
        return at.select("_row", "doc_id", "pos", bucket(F.col("word")).alias("bucket"))
    # Equal rows are numbered apart, or the words of one would follow those of the other.
    copy = Window.partitionBy("_row", "doc_id", "pos").orderBy("word")
    at = at.withColumn("copy", F.row_number().over(copy))
    ahead = Window.partitionBy("_row", "doc_id", "copy").orderBy("pos")
    grams, after = [F.col("word")], [F.col("word")]
    for k in range(1, orders):
        after.append(F.lead("word", k).over(ahead))
        grams.append(F.when(after[-1].isNotNull(), F.concat_ws(" ", *after)))
    at = at.select("_row", "doc_id", "pos", F.array(*grams).alias("grams"))
    # The first order is null only where there is no word at all.
    held = F.when(F.col("pos").isNull(), F.array(F.lit(None).cast("string"))).otherwise(F.filter("grams", lambda g: g.isNotNull()))
    one = at.select("_row", "doc_id", "pos", F.posexplode(held).alias("order", "gram"))
    return one.select("_row", "doc_id", F.when(F.col("order") == 0, F.col("pos")).alias("pos"), bucket(F.col("gram")).alias("bucket"))


def _keyed(table: DataFrame) -> DataFrame:
    doc_id = F.col("doc_id") if "doc_id" in table.columns else F.lit(None)
    rows = table.select(doc_id.cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.withColumn("_row", F.xxhash64("text", F.octet_length("text")))


def bucket_gains(docs: DataFrame, target: DataFrame, orders: int = 1, buckets: int = 10_000) -> DataFrame:
    """``bucket`` and ``gain``, a thousand times the logarithm of the target's share of a bucket's
    n-grams over the documents' share, each count raised by one; ``buckets`` rows."""
    spark = docs.sparkSession

    def counts(table: DataFrame, name: str) -> DataFrame:
        return features(_keyed(table), orders, buckets).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias(name))

    both = spark.range(buckets).withColumnRenamed("id", "bucket")
    both = both.join(counts(docs, "s"), "bucket", "left").join(counts(target, "t"), "bucket", "left").na.fill(0)
    both = materialize(both, "buckets")
    all_s, all_t = both.agg(F.sum("s"), F.sum("t")).first()
    of = lambda n, all_n: (F.col(n) + 1).cast("double") * F.lit(float(all_n + buckets))
    gain = F.floor(1000 * F.log(of("t", all_s) / of("s", all_t)))
    return both.select("bucket", gain.alias("gain"))


def gumbel(doc_id: Column, seed: int) -> Column:
    """A thousand times the Gumbel noise of an id, rounded down, from 32 bits of a hash of both."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weigh(docs: DataFrame, target: DataFrame, orders: int = 1, buckets: int = 10_000, seed: int = 2024) -> DataFrame:
    """Every row's ``doc_id``, ``n_words``, ``n_features``, ``weight`` and ``score``, all long, and
    ``copy``, which numbers equal rows from 0.

    The gains have ``buckets`` rows, so every task has them all; sums are taken before the shuffle,
    and a document gives a row for each task that saw its words. Rows with the same id and text are
    summed together and share the result evenly.
    """
    gains = materialize(bucket_gains(docs, target, orders, buckets), "gains")
    found = features(_keyed(docs), orders, buckets)
    found = found.join(F.broadcast(gains), "bucket", "left")
    first = F.coalesce(F.col("pos"), F.lit(0)) == 0
    if orders > 1:  # lines of higher orders have no place, and a row without words has one line
        first = (F.col("pos") == 0) | F.col("bucket").isNull()
    each = found.groupBy("_row", "doc_id").agg(
        F.count("bucket").alias("n"), F.count("pos").alias("words"), F.coalesce(F.sum("gain"), F.lit(0)).alias("sum"), F.count_if(first).alias("copies")
    )
    share = lambda c: F.expr(f"{c} div copies")
    each = each.select("doc_id", share("words").alias("n_words"), share("n").alias("n_features"), share("sum").alias("weight"), "copies")
    each = each.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    # A row for each copy, in two steps: no list is longer than COPIES or the copies over COPIES.
    each = each.withColumn("block", F.explode(F.expr(f"sequence(0L, (copies - 1) div {COPIES})")))
    within = F.expr(f"sequence(block * {COPIES}, least(copies, (block + 1) * {COPIES}) - 1)")
    return each.select("doc_id", "n_words", "n_features", "weight", "score", F.explode(within).alias("copy"))


def resample(docs: DataFrame, target: DataFrame, orders: int = 1, buckets: int = 10_000, seed: int = 2024, percent: int = 10, least_words: int = 20) -> DataFrame:
    """Draw ``percent`` of the documents with at least ``least_words`` words (rounded down) such
    that the drawn ones resemble ``target``: those with the highest scores, the smaller id first
    among equals and null ids last.

    Returns all rows: ``doc_id``, ``n_features``, ``weight``, ``score`` and ``rank`` from 1 in drawn
    order, null where not drawn. Null texts and texts without words have no features, weight 0 and
    are never drawn; a null id has the noise of an empty one; repeated rows are rows of their own;
    an empty target or no documents are counts of nothing. Only ``doc_id`` and ``text`` of ``docs``
    and ``text`` of ``target`` are read.

    Ranks need no sort in one place: rows lie in ranges of the drawn order, each range is counted,
    and the counts of the ranges before (at most ``MOST_RANGES`` rows) are added to places within.
    """
    spark = docs.sparkSession
    scored = materialize(weigh(docs, target, orders, buckets, seed).withColumn("fit", F.col("n_words") >= least_words), "scored")
    n_fit = scored.where("fit").count()
    most = percent * n_fit // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("copy")]
    ranges = min(MOST_RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_fit // 1_000_000))
    ranged = scored.where("fit").repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id())
    ranged = materialize(ranged, "ranges")
    counted = ranged.groupBy("range").agg(F.count("*").alias("own"))
    before = F.coalesce(F.sum("own").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per range
    placed = ranged.join(F.broadcast(counted.select("range", before.alias("ahead"))), "range")
    place = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    drawn = placed.where(F.col("ahead") < most).withColumn("rank", F.col("ahead") + place)
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    none = F.lit(None).cast("long")
    parts = [drawn, placed.where(F.col("ahead") >= most).withColumn("rank", none), scored.where("not fit").withColumn("rank", none)]
    first, second, third = (p.select("doc_id", "n_features", "weight", "score", "rank") for p in parts)
    return first.union(second).union(third)
