"""Matching the compilations of two traces one to one."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType, MapType, StringType
from pyspark.sql.window import Window

from tracequarry.config import GROUP_SAMPLES, NAME_SIMILARITY, SOURCE_SIMILARITY
from tracequarry.functions.text import normalized_source, sequence_ratio
from tracequarry.operators.ordering import settled


def greedy(candidates: DataFrame, a: str, b: str, score: str, most_rounds: int = 10_000) -> DataFrame:
    """Take candidate pairs best first (then by ``a``, ``b``), each item once.

    In rounds: a pair that is the best for both its ends can't be kept from being taken by any
    other, so all such pairs are taken at once, their ends' other pairs leave, and the rest goes on.
    That gives the pairs of one pass over the sorted list. A round is two aggregations and joins;
    pairs without ties are few rounds, since about half of all ends find each other in each.
    """
    best = F.struct((-F.col(score)).alias("s"), F.col(a).alias("a"), F.col(b).alias("b"))
    left, taken = settled(candidates.withColumn("_best", best)), None
    for _ in range(most_rounds):
        by_a = left.groupBy(a).agg(F.min("_best").alias("_for_a"))
        by_b = left.groupBy(b).agg(F.min("_best").alias("_for_b"))
        ruled = settled(left.join(by_a, a).join(by_b, b).withColumn("_take", (F.col("_best") == F.col("_for_a")) & (F.col("_best") == F.col("_for_b"))))
        now = ruled.where("_take").select(candidates.columns)
        taken = now if taken is None else taken.unionByName(now)
        rest = ruled.where(~F.col("_take")).select(*candidates.columns, "_best")
        left = settled(rest.join(now.select(a), a, "left_anti").join(now.select(b), b, "left_anti"))
        if left.isEmpty():
            return settled(taken)
    raise RuntimeError("greedy: not settled")


def samples(df: DataFrame, group: str, order: str, most: int = GROUP_SAMPLES) -> DataFrame:
    """Up to ``most`` rows of each group: first, last, and evenly between. Halves round to even."""
    w = Window.partitionBy(group)
    df = df.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count("*").over(w))
    places = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / F.lit(most - 1)).cast("long"))
    return df.where((F.col("_n") <= most) | F.array_contains(places, F.col("_i").cast("long"))).drop("_i", "_n")


def match_by_hash(a: DataFrame, b: DataFrame) -> DataFrame:
    """The k-th compilation of a hash on either side: ``idx_a``, ``idx_b``."""
    nth = F.row_number().over(Window.partitionBy("hash").orderBy("idx"))
    side = lambda df, s: df.where("hash not in ('', 'unknown')").select("hash", F.col("idx").alias(f"idx_{s}"), nth.alias("k"))
    return side(a, "a").join(side(b, "b"), ["hash", "k"]).select("idx_a", "idx_b", F.lit("hash").alias("method"), F.lit(1.0).alias("confidence"))


@pandas_udf(MapType(StringType(), IntegerType()))
def letter_counts(text: pd.Series) -> pd.Series:
    """How often each letter occurs, as a map. SQL functions read the text once for each letter."""
    return pd.Series([None if t is None else {c: t.count(c) for c in sorted(set(t))} for t in text], dtype=object)


def ratio_bound(counts_a: Column, counts_b: Column, length: Column) -> Column:
    """No less than the ratio of two texts: matching blocks are letters of both, so they hold at
    most what the counts of letters share. ``length`` is that of both texts together."""
    shared = F.aggregate(F.map_keys(counts_a), F.lit(0), lambda n, c: n + F.least(F.element_at(counts_a, c), F.coalesce(F.try_element_at(counts_b, c), F.lit(0))))
    return 2 * shared / length


def candidate_pairs(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """Pairs of texts (``name``, ``text``) whose ratio can be ``least`` or more, with the ``bound``.

    Two bounds rule pairs out before a text is read: the ratio is at most twice the shorter length
    over the sum, which makes classes of lengths to join on, and at most what the letters' counts
    share. Equal texts of a side are one text. Pairs carry keys and counts only, no texts."""

    def side(df: DataFrame, s: str) -> DataFrame:
        own = df.where("length(text) > 0").select("text").distinct()
        return own.select(F.sha2("text", 256).alias(f"key_{s}"), F.length("text").alias(f"len_{s}"), letter_counts(F.col("text")).alias(f"counts_{s}"))

    # A text's partners have lengths in a fixed range of classes of growing width.
    step = (2 - least) / least
    cls = lambda c: F.floor(F.log(F.col(c)) / F.log(F.lit(step))).cast("int")
    x = settled(side(a, "a")).withColumn("_c", F.explode(F.sequence(cls("len_a") - 1, cls("len_a") + 1)))
    y = settled(side(b, "b")).withColumn("_c", cls("len_b"))
    both = F.col("len_a") + F.col("len_b")
    pairs = x.join(y, "_c").where(2 * F.least("len_a", "len_b") >= least * both)
    pairs = pairs.withColumn("bound", ratio_bound(F.col("counts_a"), F.col("counts_b"), both))
    return pairs.where(F.col("bound") >= least).select("key_a", "key_b", "bound")


def similar_pairs(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """Pairs of names of texts (``name``, ``text``) with a ratio of ``least`` or more, ``score``
    being the best of the names' texts. Only candidates are compared, each pair of texts once."""
    text = lambda df, s: df.where("length(text) > 0").select(F.sha2("text", 256).alias(f"key_{s}"), F.col("text").alias(f"text_{s}")).distinct()
    name = lambda df, s: df.where("length(text) > 0").select(F.sha2("text", 256).alias(f"key_{s}"), F.col("name").alias(f"name_{s}")).distinct()
    pairs = candidate_pairs(a, b, least).join(text(a, "a"), "key_a").join(text(b, "b"), "key_b")
    scored = pairs.select("key_a", "key_b", sequence_ratio(F.col("text_a"), F.col("text_b")).alias("score")).where(F.col("score") >= least)
    scored = scored.join(name(a, "a"), "key_a").join(name(b, "b"), "key_b")
    return scored.groupBy("name_a", "name_b").agg(F.max("score").alias("score"))


def _pair_rest(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """Greedy pairs of compilations of one group by configuration. Equal configurations on a side
    are one class, and a class gives its least number first, so pairs of classes are ranked."""
    sides = [[(c, sorted(g["idx"])) for c, g in side.groupby(["num_stages", "num_warps", "shared"], dropna=False)] for side in (a, b)]

    def alike(x: tuple, y: tuple) -> float:
        sa, sb = x[2], y[2]
        ratio = 0.2 * min(sa, sb) / max(sa, sb) if sa > 0 and sb > 0 else 0.2 * (sa == sb)
        return 0.4 * (x[0] == y[0]) + 0.4 * (x[1] == y[1]) + ratio

    at = [[0] * len(side) for side in sides]
    head = lambda side, i: sides[side][i][1][at[side][i]] if at[side][i] < len(sides[side][i][1]) else None
    scores = [[alike(x, y) for y, _ in sides[1]] for x, _ in sides[0]]
    heap = [(-scores[i][j], head(0, i), head(1, j), i, j) for i in range(len(sides[0])) for j in range(len(sides[1]))]
    heapq.heapify(heap)
    rows = []
    while heap:
        s, x, y, i, j = heapq.heappop(heap)
        now = head(0, i), head(1, j)
        if None in now:
            continue
        if now == (x, y):
            rows.append((*key, x, y, -s))
            at[0][i] += 1
            at[1][j] += 1
            now = head(0, i), head(1, j)
        if None not in now:
            heapq.heappush(heap, (s, *now, i, j))
    return pd.DataFrame(rows, columns=["name_a", "name_b", "idx_a", "idx_b", "config"])


def pair_configs(groups: DataFrame, a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (``idx_a``, ``idx_b``, ``config``) of compilations within matched groups (``name_a``,
    ``name_b``), best configuration first, then by numbers; and how many pairs each group could
    have (``_n``).

    Equal configurations are the best there are, so their k-th members pair by a join on the place;
    that is most of a group. Of what is left, a configuration is on one side only and can use no
    more members than the other side has left: the rest of it is cut off unseen. Pairs of members
    are never listed.
    """
    keys, config = ["name_a", "name_b"], ["num_stages", "num_warps", "shared"]

    def side(df: DataFrame, s: str) -> DataFrame:
        own = groups.select(keys).join(df.withColumnRenamed("name", f"name_{s}"), f"name_{s}")
        code = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(-1)).alias(c)
        own = own.select(*keys, "idx", code("num_stages"), code("num_warps"), F.coalesce(F.col("shared").cast("long"), F.lit(0)).alias("shared"))
        return own.withColumn("_k", F.row_number().over(Window.partitionBy(*keys, *config).orderBy("idx")))

    x, y = settled(side(a, "a")), settled(side(b, "b"))
    n = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    counts = n(x, "_na").join(n(y, "_nb"), keys).select(*keys, (F.col("_na") * F.col("_nb")).alias("_n"))
    equal = x.withColumnRenamed("idx", "idx_a").join(y.withColumnRenamed("idx", "idx_b"), [*keys, *config, "_k"])
    equal = settled(equal.select(*keys, "idx_a", "idx_b", F.lit(1.0).alias("config")))
    rest = [df.join(equal.select(F.col(f"idx_{s}").alias("idx")), "idx", "left_anti") for df, s in ((x, "a"), (y, "b"))]
    cut = []
    for own, other in (rest, rest[::-1]):
        place = F.row_number().over(Window.partitionBy(*keys, *config).orderBy("idx"))
        cut.append(own.withColumn("_k", place).join(n(other, "_most"), keys).where("_k <= _most").select(*[F.col(c).alias(c) for c in (*keys, "idx", *config)]))
    more = cut[0].groupBy(*keys).cogroup(cut[1].groupBy(*keys)).applyInPandas(_pair_rest, equal.schema)
    return equal.unionByName(more), counts


def match_kernels(a: DataFrame, b: DataFrame) -> DataFrame:
    """Match compilations (``idx``, ``name``, ``hash``, ``source``, ``num_stages``, ``num_warps``,
    ``shared``) of two traces.

    First equal hashes, k-th with k-th. Of the rest, groups of one name: equal names, then
    sources alike, then names alike, each group once and best first. Within matched groups
    compilations pair by configuration, best first. Returns ``idx_a``, ``idx_b``, ``method``
    (hash, name, source, fuzzy_name, config) and ``confidence``.
    """
    hashed = settled(match_by_hash(a, b))
    ra = a.join(hashed.select(F.col("idx_a").alias("idx")), "idx", "left_anti")
    rb = b.join(hashed.select(F.col("idx_b").alias("idx")), "idx", "left_anti")
    names = lambda df: df.select("name").distinct()
    known = "name not in ('', 'unknown')"
    same = names(ra).join(names(rb), "name").where(known).select(F.col("name").alias("name_a"), F.col("name").alias("name_b"), F.lit(1.0).alias("score"), F.lit("name").alias("method"))

    def left(df: DataFrame, taken: DataFrame, side: str) -> DataFrame:
        return df.join(taken.select(F.col(f"name_{side}").alias("name")), "name", "left_anti")

    texts = lambda df: samples(df, "name", "idx").select("name", normalized_source(F.coalesce("source", F.lit(""))).alias("text"))
    by_source = similar_pairs(texts(left(ra, same, "a")), texts(left(rb, same, "b")), SOURCE_SIMILARITY)
    by_source = greedy(by_source, "name_a", "name_b", "score").withColumn("method", F.lit("source"))
    taken = settled(same.unionByName(by_source))
    fuzzy = similar_pairs(*(left(names(r).where(known), taken, s).select("name", F.col("name").alias("text")) for r, s in ((ra, "a"), (rb, "b"))), NAME_SIMILARITY)
    fuzzy = greedy(fuzzy, "name_a", "name_b", "score").withColumn("method", F.lit("fuzzy_name"))
    groups = settled(taken.unionByName(fuzzy))

    paired, counts = pair_configs(groups, ra, rb)
    paired = paired.join(groups, ["name_a", "name_b"])
    for r, side in ((ra, "a"), (rb, "b")):
        paired = paired.join(r.select(F.col("idx").alias(f"idx_{side}"), F.col("source").alias(f"source_{side}")), f"idx_{side}")
    own = sequence_ratio(normalized_source(F.coalesce("source_a", F.lit(""))), normalized_source(F.coalesce("source_b", F.lit(""))))
    paired = paired.withColumn("own", F.when(F.col("method").isin("source", "fuzzy_name"), own))
    paired = paired.join(counts, ["name_a", "name_b"])
    by_text = F.col("method").isin("source", "fuzzy_name")
    alone = F.col("_n") == 1
    keep = alone | F.when(by_text, F.col("own") >= SOURCE_SIMILARITY).otherwise(F.col("config") >= 0.99)
    confidence = F.when(alone, F.when(F.col("method") == "source", F.col("own")).otherwise(F.col("score"))).when(keep & by_text, F.col("own")).when(keep, F.col("score")).otherwise(F.col("config"))
    rest = paired.select("idx_a", "idx_b", F.when(keep, F.col("method")).otherwise("config").alias("method"), confidence.alias("confidence"))
    return hashed.unionByName(rest)


def unmatched(side: DataFrame, matches: DataFrame, column: str) -> DataFrame:
    return side.join(matches.select(F.col(column).alias("idx")), "idx", "left_anti")


def trace_status(matches: DataFrame, status: str = "status") -> DataFrame:
    """Counts of match statuses and the whole: identical, minor, or significant."""
    n = lambda s: F.count_if(F.col(status) == s).alias(s)
    out = matches.agg(n("identical"), n("similar"), n("different"), F.count_if(F.col("method") == "only").alias("only"))
    whole = F.when((F.col("different") > 0) | (F.col("only") > 0), "significant").when(F.col("similar") > 0, "minor").otherwise("identical")
    return out.withColumn("overall", whole)


def two_least(df: DataFrame, by: list[str], value: str, first: str, second: str) -> DataFrame:
    """The two least distinct values for each ``by``; ``second`` is null where there is one."""
    nth = F.dense_rank().over(Window.partitionBy(*by).orderBy(value))
    least = df.where(F.col(value).isNotNull()).withColumn("_nth", nth).where("_nth <= 2").groupBy(*by)
    return least.agg(F.min(value).alias(first), F.min(F.when(F.col("_nth") == 2, F.col(value))).alias(second))


def _best_within(rows: DataFrame, by: list[str], base: float) -> DataFrame:
    """For each key of ``rows`` (``k``, ``v``) the ``score`` of the best other key of equal ``by``:
    ``base`` and 0.2 times the ratio of both ``v``, to six places; of equal scores the least key ``b``.

    The best ratio is that of a neighbour in order of ``v``. Rounding makes ties of values close to
    it, which lie in two narrow ranges around the own; these are looked up by bins of logarithms,
    wide enough that a range has at most three. So no pairs of a group are listed."""
    one, at = [*by, "v"], Window.partitionBy(*by)
    members = two_least(rows, by, "k", "m1", "m2").where("m2 is not null")
    classes = settled(two_least(rows, one, "k", "b1", "b2").join(members, by))
    places = classes.where("v > 0").withColumn("_only", F.when(F.col("b2").isNull(), F.col("b1")))
    for name, order in (("_less", F.col("v")), ("_more", F.desc("v"))):  # past neighbours that have no key but the own
        w = at.orderBy(order)
        places = places.withColumn("_fresh", F.coalesce(F.col("_only") != F.lag("_only").over(w), F.lit(True))).withColumn("_before", F.lag("v").over(w))
        places = places.withColumn(name, F.last(F.when(F.col("_fresh"), F.col("_before")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    part = F.greatest(F.when(F.col("b2").isNotNull(), 0.2), 0.2 * F.col("_less") / F.col("v"), 0.2 * F.col("v") / F.col("_more"), F.lit(0.0))
    rest = classes.where("not v > 0").withColumn("_part", F.when(F.col("b2").isNotNull(), 0.2).otherwise(0.0))
    scored = places.withColumn("_part", part).select(rest.columns).unionByName(rest)
    scored = settled(scored.withColumn("score", F.round(base + F.col("_part"), 6)))
    none = F.col("score") == F.round(F.lit(base), 6)  # all others are as good
    tied = scored.where(none).select(*one, "score", F.col("m1").alias("t1"), F.col("m2").alias("t2"))
    same = scored.where(~none & ~(F.col("v") > 0)).select(*one, "score", F.col("b1").alias("t1"), F.col("b2").alias("t2"))

    near = scored.where(~none & (F.col("v") > 0))
    ratio = lambda off: F.least(F.lit(1.0), (F.col("score") - base + off) / 0.2)
    low, high = F.log(ratio(-7e-7)) - 1e-12, F.log(ratio(7e-7)) + 1e-12
    ranges = F.array(F.struct((F.log("v") + low).alias("lo"), (F.log("v") + high).alias("hi")), F.struct((F.log("v") - high).alias("lo"), (F.log("v") - low).alias("hi")))
    near = near.withColumn("_r", F.explode(ranges)).withColumn("_level", F.greatest(F.lit(0), F.ceil(F.log2((F.col("_r.hi") - F.col("_r.lo")) / BIN)).cast("int")))
    bin_of = lambda x: F.floor(x / (BIN * F.pow(F.lit(2.0), F.col("_level"))))
    near = settled(near.withColumn("_bin", F.explode(F.sequence(bin_of(F.col("_r.lo")), bin_of(F.col("_r.hi"))))))
    levels = [r[0] for r in near.select("_level").distinct().collect()]  # at most some twenty
    other = classes.where("v > 0").select(*by, F.col("v").alias("u"), F.explode(F.array("b1", "b2")).alias("k")).where("k is not null")
    other = other.withColumn("_level", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>"))).withColumn("_bin", bin_of(F.log("u")))
    pairs = near.select(*one, "score", "b1", "b2", "_level", "_bin").join(other, [*by, "_level", "_bin"])
    fits = F.round(base + 0.2 * F.least("u", "v") / F.greatest("u", "v"), 6) == F.col("score")
    close = two_least(pairs.where(fits & (F.col("b2").isNotNull() | (F.col("k") != F.col("b1")))), [*one, "score"], "k", "t1", "t2")
    found = tied.unionByName(same).unionByName(close)
    return rows.join(found, one).select("k", "score", F.when(F.col("k") == F.col("t1"), F.col("t2")).otherwise(F.col("t1")).alias("b"))


#: Least width of a bin of logarithms.
BIN = 2e-5


def best_configs(rows: DataFrame, key: str, group: list[str]) -> DataFrame:
    """For each ``key`` the other key of its ``group`` whose configuration (``num_stages``,
    ``num_warps``, ``shared``) is most alike by ``config_similarity`` to six places (``score``), the
    least ``b`` of several. Stages and warps weigh more than any ratio, so those that share both come
    first, then those that share one, then the rest."""
    code = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null")).alias(c)
    rows = rows.where(" and ".join(f"{c} is not null" for c in (key, *group)))
    rows = settled(rows.select(F.col(key).alias("k"), *group, code("num_stages"), code("num_warps"), F.coalesce(F.col("shared"), F.lit(0)).cast("double").alias("v")))
    found = settled(_best_within(rows, [*group, "num_stages", "num_warps"], 0.8))
    for more in ((["num_stages"], ["num_warps"]), ([],)):
        left = settled(rows.select("k").distinct().join(found, "k", "left_anti"))
        if left.isEmpty():
            break
        for by in more:
            own = [*group, *by]
            some = rows.join(rows.join(left, "k", "left_semi").select(*own).distinct(), own)
            found = found.unionByName(_best_within(some, own, 0.4 if by else 0.0).join(left, "k", "left_semi"))
        found = settled(found)
    best = found.groupBy("k").agg(F.max(F.struct("score", (-F.col("b")).alias("nb"))).alias("m"))
    return best.select(F.col("k").alias(key), (-F.col("m.nb")).alias("b"), "m.score")
