"""Mixing of sources to target weights by a low-discrepancy schedule.

Slot t of the schedule takes the source into whose share of the cumulative weights the
fractional part of t times the golden ratio falls; such points are spread so evenly that every
stretch of the schedule holds each source in about its share. A source's documents, in an
order drawn by hashing, are a row of words cut into equal blocks, and the r-th slot of a
source takes its r-th block, starting over after the last.

Everything here is DataFrame and SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracequarry.llm.common import WORD, materialize

GOLDEN = 0.6180339887498949


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, blocks: int = 1 << 18, least_blocks: int = 256) -> DataFrame:
    """Targets of all sources, from a table with ``source`` and ``size``.

    Returns ``source``, ``pos`` (rank by code point, null last), ``source_size``, ``weight``
    (``weights`` over and over by rank), ``target`` (double; the shares by weight of all words,
    at most ``most`` times the source's size, what is cut off being shared again until none is
    above), ``n_blocks`` and ``n_slots``. All words make about ``blocks`` blocks, a source at
    least ``least_blocks`` (as far as it has words).
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row per source: the only rows that come together here.
    total = total.withColumn("pos", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))))
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("pos") - 1, F.lit(len(weights))) + 1)
    total = total.withColumn("weight", weight.cast("double")).withColumn("cap", (most * F.col("source_size")).cast("double"))
    by = Window.orderBy(F.col("cap") / F.col("weight"), "pos")
    everything = Window.partitionBy()
    total = total.withColumn("all", F.sum("source_size").over(everything)).withColumn("before", F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    total = total.withColumn("after", F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing)))
    total = total.withColumn("level", (F.col("all") - F.col("before")) / F.col("after"))
    total = total.withColumn("capped", F.col("level") * F.col("weight") > F.col("cap"))
    left = F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything)
    share = (F.col("all") - F.coalesce(left, F.lit(0.0))) / F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything)
    total = total.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.least("cap", F.col("weight") * share)))
    width = F.greatest(F.lit(1.0), F.col("all") / blocks)
    n = F.least(F.col("source_size"), F.greatest(F.ceil(F.col("source_size") / width), F.lit(least_blocks)))
    total = total.withColumn("n_blocks", F.greatest(n, F.lit(1)).cast("long"))
    slots = F.when(F.col("source_size") > 0, F.col("target") * F.col("n_blocks") / F.col("source_size")).otherwise(0.0)
    return total.select("source", "pos", "source_size", "weight", "target", "n_blocks", slots.alias("n_slots"))


def schedule(targets: DataFrame, most: int = 3, chunk: int = 4096, bins: int = 4096) -> DataFrame:
    """The order in which the mix takes blocks: ``slot``, ``pos``, ``rank`` (among the slots of
    the source) and ``block``. A source's slots beyond ``most`` rounds of its blocks fall out.
    Slots are ranked within chunks of the schedule after the chunks' counts are summed."""
    spark = targets.sparkSession
    n = targets.agg(F.sum("n_slots")).first()[0] or 0.0
    upto = Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    shares = targets.where("n_slots > 0").select("pos", "n_blocks", "n_slots", (F.sum("n_slots").over(upto) / F.lit(max(n, 1e-300))).alias("high"))
    shares = shares.withColumn("low", F.coalesce(F.lag("high").over(Window.orderBy("pos")), F.lit(0.0)))
    last = F.max("pos").over(Window.partitionBy())
    shares = shares.withColumn("high", F.when(F.col("pos") == last, 2.0).otherwise(F.col("high")))
    in_bins = F.sequence(F.floor(F.col("low") * bins), F.least(F.floor(F.col("high") * bins), F.lit(bins)))
    shares = shares.withColumn("bin", F.explode(in_bins))
    slots = spark.range(round(n)).select(F.col("id").alias("slot"), ((F.col("id") + 0.5) * GOLDEN % 1.0).alias("u"))
    slots = slots.withColumn("bin", F.floor(F.col("u") * bins))
    slots = slots.join(shares, (slots["bin"] == shares["bin"]) & (slots["u"] >= shares["low"]) & (slots["u"] < shares["high"]))
    slots = materialize(slots.select("slot", "pos", "n_blocks", F.expr(f"slot div {chunk}").alias("chunk")), "slots")
    counts = slots.groupBy("pos", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("pos").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("pos", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("pos", "chunk").orderBy("slot"))
    ranked = slots.withColumn("nth", nth).join(counts, ["pos", "chunk"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("nth") - 1).where(F.col("rank") < most * F.col("n_blocks"))
    return ranked.select("slot", "pos", "rank", F.pmod("rank", F.col("n_blocks")).alias("block"))


def mix_sizes(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, carry: str | None = None) -> DataFrame:
    """What the mix takes of every document.

    Returns a row per row of ``docs``: ``doc_id``, ``source``, ``size`` (words), ``source_size``,
    ``target`` (its source's) and ``taken`` (words that the mix takes of it, repeats counted; at
    most ``most`` times its size). Null and empty texts have size 0 and nothing is taken of
    them; a null source is a source, the last. Rows of one ``doc_id`` are documents of their
    own. Other columns aren't read; an empty table gives no rows. The order within a source is
    that of the md5 of ``doc_id``, so runs agree. A column named by ``carry`` is returned with its
    row and orders rows of one ``doc_id`` and size.

    A source may hold a third of all documents: its words are first summed in 4096 parts of
    the order, and only within a part are documents put in order.
    """
    # The hash must not depend on where rows lie; null ids come first.
    more = [carry] if carry else []
    own = docs.select(*more, F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"))
    own = materialize(own.withColumn("key", F.coalesce(F.md5(F.col("doc_id").cast("string").cast("binary")), F.lit(""))).withColumn("part", F.substring("key", 1, 3)), "sizes")
    targets = materialize(source_targets(own, weights, most), "targets")
    uses = schedule(targets, most).groupBy("pos", "block").agg(F.count("*").alias("uses"))
    parts = own.groupBy("source", "part").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("source", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    parts = parts.alias("p").join(targets.alias("t"), F.expr("p.source <=> t.source")).select("p.source", "p.part", "before", "pos", "source_size", "target", "n_blocks")
    placed = own.alias("d").join(parts.alias("p"), F.expr("d.source <=> p.source and d.part = p.part"))
    within = Window.partitionBy("pos", "d.part").orderBy("key", "doc_id", "size", *more).rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("stop", F.col("before") + F.sum("size").over(within)).withColumn("start", F.col("stop") - F.col("size"))
    placed = placed.select(*more, "doc_id", F.col("d.source").alias("source"), "size", "source_size", "target", "pos", "n_blocks", "start", "stop")
    placed = materialize(placed, "placed")
    # Word x of a source of S words in n blocks lies in block ((x + 1) * n - 1) div S.
    first, last = F.expr("((start + 1) * n_blocks - 1) div source_size"), F.expr("(stop * n_blocks - 1) div source_size")
    cut = placed.where("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    low, high = F.expr("block * source_size div n_blocks"), F.expr("(block + 1) * source_size div n_blocks")
    cut = cut.withColumn("words", F.least("stop", high) - F.greatest("start", low)).join(uses, ["pos", "block"])
    # Documents with words have starts of their own within a source.
    taken = cut.groupBy("pos", "start").agg(F.sum(F.col("words") * F.col("uses")).alias("taken"))
    out = placed.alias("d").join(taken.alias("t"), F.expr("d.pos = t.pos and d.start = t.start and d.size > 0"), "left")
    return out.select(*more, "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
