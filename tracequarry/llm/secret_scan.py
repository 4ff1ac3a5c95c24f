"""Secret scan: fixed patterns, and strings that look random by a battery of tests.

A run of 20 or more token characters with a digit and a letter is a candidate. Its encoding is
inferred from its characters; then three tests ask whether it may be uniformly random in that
alphabet: chi-squared over the symbols, runs above and below the middle of the alphabet, and
correlation of neighbours. The least p-value, counted three times, is the score.

A discovery is a reported span, so what is tested is that a candidate is an ordinary string. How
random ordinary strings look is measured, by encoding and length, on decoys: words of the corpus
run together and ended by a number, one from every piece of every document, and windows of a plain
text beside them. The root of a decoy's decades of evidence against randomness grows with the root of its
length; a line fits that, and the lower quantiles of what is left of it give the spread below. A
candidate's p-value is the normal tail below its place under that line. So it can be as small as
rare secrets need, where a mere rank among decoys could not. Benjamini and Hochberg's rule over
all candidates of a band of lengths then reports spans at a bounded rate of false ones.

Everything here is DataFrame and SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequarry.llm.common import let as _let
from tracequarry.llm.common import materialize

#: The base patterns, kind by kind in the order of ties; group 0 or the group that must be long.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Runs of 16 or more are the runs of HEX that count; shorter ones needn't be made.
LONG_HEX = r"[0-9a-f]{16,}"
LONG_ACCESS = r"AKIA[A-Z0-9]{14,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Alphabets by encoding, with symbols in order of value.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
#: Bands of lengths: the first length of each.
BANDS = (20, 28, 40, 64, 128)
#: P-values are counted in bins, so many for each power of ten and in all.
PER_DECADE, BINS = 20, 6000
#: Parts of the decoys that the spread below the line is measured at, as normal deviates.
QUANTILES = {0.16: 0.99446, 0.02: 2.05375}
#: The spread is no less than that.
LEAST_SPREAD = 0.05
#: Characters of a text that a decoy is made of, and digits that end a decoy. Every text is cut into
#: such pieces from its start, and each piece gives a decoy.
CHUNK, DIGITS = 1024, 4
#: Decoys of the plain text, for each encoding and band; they keep small tables from having none.
WINDOWS, STRIDE = 300, 5
PLAIN = (
    "A build reads its inputs, compares them with what it kept from the last time and does again only the steps whose inputs changed. "
    "People who work on such systems soon find that most of the waiting comes from a few slow parts, and that these parts are rarely the ones they expected. "
    "Before changing anything it helps to write down what the machine does all day: how many files are opened, how long the longest one is, which answers are thrown away unread. "
    "A table with twenty honest rows is worth more than a long argument. Once the slow part is known, there are usually two ways to deal with it. "
    "Either the same answer can be had with less work, because something was counted twice or sorted without need, or the work can be put off until somebody asks for it. "
    "Both ways have their price. Less work often means more memory, and work that is put off comes back at the worst moment. "
    "It is a good habit to name the price beside the change, so that the next reader does not have to guess why a simple loop became a strange one. "
    "Names matter too. A folder called old or a function called helper tells nothing, while a name that says what is kept and for how long saves a question every week. "
    "Finally, leave the place as you would like to find it: remove the lamp you brought, close the window, and write one line about what is still open."
)


def _running(steps: Column, block: int = 256) -> Column:
    """Running sums of an array of longs, block by block: one growing array would be copied once
    for each of its entries."""
    last = lambda acc: F.try_element_at(acc, F.lit(-1))
    add = lambda acc, x: F.concat(acc, F.array(last(acc) + x))
    within = lambda b, start: F.slice(F.aggregate(b, F.array(start), add), F.lit(2), F.size(b))

    def joined(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda acc, x: acc + x))
        starts = F.aggregate(sums, F.array(F.lit(0).cast("long")), add)
        return F.flatten(F.zip_with(blocks, F.slice(starts, F.lit(1), F.size(blocks)), within))

    numbers = lambda own: F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(own) - 1) / block).cast("int")))
    cut = lambda own: F.transform(numbers(own), lambda i: F.slice(own, i * block + 1, F.lit(block)))
    return _let(steps, lambda own: _let(cut(own), joined))


def _found(text: Column, pattern: str, group: int, least: int, order: int, kind: str, gate: str | None = None) -> Column:
    """Spans of all matches whose ``group`` has ``least`` characters, as an array of structs."""
    empty = F.array().cast("array<struct<start:bigint,stop:bigint,rank:int,kind:string,body:string>>")
    length = lambda c: F.length(c).cast("long")

    def spans(s: Column) -> Column:
        # The last gap has no match behind it.
        steps = F.zip_with(F.slice(s["gaps"], F.lit(1), F.size(s["whole"])), s["whole"], lambda g, m: length(g) + length(m))
        return F.transform(
            F.arrays_zip(_running(steps).alias("e"), s["whole"].alias("w"), s["body"].alias("b")),
            lambda x: F.struct((x["e"] - F.length(x["w"])).alias("start"), x["e"].alias("stop"), F.lit(order).alias("rank"), F.lit(kind).alias("kind"), x["b"].alias("body")),
        )

    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    body = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    found = _let(F.struct(F.split(text, pattern, -1).alias("gaps"), whole.alias("whole"), body.alias("body")), spans)
    return F.when(text.rlike(gate or pattern), F.filter(found, lambda x: F.length(x["body"]) >= least)).otherwise(empty)


def base_spans(text: Column) -> Column:
    """All base spans by start and then kind."""
    each = [_found(text, ASSIGN, 1, 12, 0, "assign"), _found(text, LONG_ACCESS, 0, 18, 1, "access"), _found(text, LONG_HEX, 0, 16, 2, "hex")]
    return F.array_sort(F.concat(*each))


def _tail(z: Column) -> Column:
    """Upper tail of the normal distribution (Abramowitz and Stegun 26.2.17)."""
    return _let(z, _upper_tail)


def _upper_tail(z: Column) -> Column:
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-F.least(a * a / 2, F.lit(700.0))) * 0.3989422804014327 * poly
    return F.when(z >= 0, upper).otherwise(1 - upper)


def encoding(token: Column) -> Column:
    """The encoding that the characters of a token allow, the one of fewest symbols."""
    body = F.regexp_replace(token, "=+$", "")
    return F.when(body.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex").when(body.rlike("^[A-Z2-7]+$"), "base32").otherwise("base64")


def random_score(token: Column) -> Column:
    """The combined p-value of the three tests (double) of a token of two or more symbols."""
    return _let(F.struct(F.regexp_replace(token, "=+$", "").alias("body"), encoding(token).alias("kind")), _score)


def _score(t: Column) -> Column:
    plain = F.when(t["kind"] == "hex", F.lower(t["body"])).otherwise(F.translate(t["body"], "-_=", "+/"))
    alphabet = F.when(t["kind"] == "hex", ALPHABETS["hex"]).when(t["kind"] == "base32", ALPHABETS["base32"]).otherwise(ALPHABETS["base64"])

    def places(u: Column) -> Column:
        chars = F.filter(F.split(u["plain"], ""), lambda c: c != "")
        # instr() takes columns on either side, so the place in the alphabet needs no lambda over it.
        x = F.transform(chars, lambda c: F.call_function("instr", u["alphabet"], c).cast("double") - 1)
        return F.struct(x.alias("x"), F.length(u["alphabet"]).cast("double").alias("k"))

    def sums(v: Column) -> Column:
        high = F.transform(v["x"], lambda e: F.when(e >= v["k"] / 2, 1.0).otherwise(0.0))
        squares = F.aggregate(F.array_distinct(v["x"]), F.lit(0.0), lambda acc, d: acc + F.pow(F.size(F.filter(v["x"], lambda e: e == d)).cast("double"), F.lit(2.0)))
        middle = F.aggregate(v["x"], F.lit(0.0), lambda acc, e: acc + e) / F.size(v["x"])
        return F.struct(v["x"].alias("x"), v["k"].alias("k"), high.alias("high"), squares.alias("squares"), middle.alias("middle"))

    return _let(_let(_let(F.struct(plain.alias("plain"), alphabet.alias("alphabet")), places), sums), _combined)


def _combined(v: Column) -> Column:
    x, k, high, middle = v["x"], v["k"], v["high"], v["middle"]
    n, m = F.size(x).cast("double"), F.size(x) - 1
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, e: acc + e)
    pairs = lambda a, f: F.zip_with(F.slice(a, F.lit(1), m), F.slice(a, F.lit(2), m), f)
    chi = k / n * v["squares"] - n
    free = k - 1
    z_chi = (F.pow(chi / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
    n1 = total(high)
    n0 = n - n1
    changes = total(pairs(high, lambda a, b: F.abs(a - b)))
    mean = 2 * n0 * n1 / n + 1
    spread = F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(1e-9))
    # All symbols on one side have no runs to test: as unlikely as n tosses of a coin.
    p_runs = F.when((n0 == 0) | (n1 == 0), F.pow(F.lit(2.0), 1 - n)).otherwise(2 * _tail(F.abs(changes + 1 - mean) / F.sqrt(spread)))
    power = total(F.transform(x, lambda e: (e - middle) * (e - middle)))
    lagged = total(pairs(x, lambda a, b: (a - middle) * (b - middle)))
    r = F.when(power > 0, lagged / power).otherwise(1.0)
    p_serial = 2 * _tail(F.abs(r + 1 / n) * F.sqrt(n))
    return F.least(F.lit(1.0), 3 * F.least(_tail(z_chi), p_runs, p_serial))


def _band(length: Column) -> Column:
    return sum(((length >= b).cast("int") for b in BANDS), F.lit(0))


def _decoy(chunk: Column, number: Column, choice: Column) -> Column:
    """An ordinary string from ``chunk``, null where it is too short. ``choice`` deals bands and
    encodings. Words of 20 or more characters, which may be secrets, are left out."""
    words = F.regexp_replace(chunk, r"\S{20,}", " ")
    kind = F.pmod(F.floor(choice / len(BANDS)), F.lit(3))
    some = F.when(kind == 0, F.upper(F.regexp_replace(words, "[^0-9A-Fa-f]+", "")))
    some = some.when(kind == 1, F.upper(F.regexp_replace(words, "[^A-Za-z2-7]+", ""))).otherwise(F.regexp_replace(words, "[^A-Za-z0-9+/_=-]+", ""))
    # Candidates have a digit, so decoys have some; base32 has only those from 2 to 7.
    digits = F.right(F.lpad(number.cast("string"), DIGITS, "3"), F.lit(DIGITS))
    digits = F.when(kind == 1, F.translate(digits, "0189", "2345")).otherwise(digits)
    length = F.element_at(F.array(*map(F.lit, BANDS)), (F.pmod(choice, F.lit(len(BANDS))) + 1).cast("int")) - DIGITS
    return F.when(F.length(some) >= length, F.concat(F.left(some, length), digits))


def _decoys(docs: DataFrame) -> DataFrame:
    """A decoy of every ``CHUNK`` characters of every text where they are long enough, and those of
    the plain text, as ``body``. Equal pieces of different texts give equal decoys."""
    pieces = docs.select(F.explode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))).alias("piece"))
    choice = F.pmod(F.shiftright(F.xxhash64("piece"), 20), F.lit(3 * len(BANDS)))
    own = pieces.select(_decoy(F.col("piece"), F.crc32(F.col("piece").cast("binary")), choice).alias("body"))
    n = 3 * len(BANDS)
    place = (F.floor(F.col("id") / n) * STRIDE).cast("int") + 1
    fixed = docs.sparkSession.range(0, WINDOWS * n, 1, 4)
    fixed = fixed.select(_decoy(F.substr(F.repeat(F.lit(PLAIN), 3), place, F.lit(CHUNK)), F.crc32(F.col("id").cast("string").cast("binary")), F.pmod("id", F.lit(n))).alias("body"))
    return own.unionByName(fixed).where("body is not null")


def _evidence(body: Column) -> Column:
    """Root of the decades of evidence that a string is no random one."""
    return F.sqrt(-F.log10(F.greatest(random_score(body), F.lit(1e-300))))


def _root_length(body: Column) -> Column:
    """Root of the number of symbols. Longer strings than decoys show more evidence than the longest
    decoys do, and are compared with those."""
    return F.sqrt(F.least(F.length(F.regexp_replace(body, "=+$", "")), F.lit(BANDS[-1])).cast("double"))


def calibrate(decoys: DataFrame) -> dict[str, tuple[float, float, float]]:
    """For each encoding the line of decoys' evidence over their root length, through the median,
    as intercept and slope, and the spread below it. ``decoys`` has ``encoding``, ``root`` and
    ``u``; the driver gets three rows."""
    lines = {r[0]: (r[1], r[2]) for r in decoys.groupBy("encoding").agg(F.regr_intercept("u", "root"), F.regr_slope("u", "root")).collect() if r[1] is not None}
    off = F.lit(None).cast("double")
    for kind, (start, slope) in lines.items():
        off = F.when(F.col("encoding") == kind, F.col("u") - start - slope * F.col("root")).otherwise(off)
    at = [0.5, *QUANTILES]
    rows = decoys.select("encoding", off.alias("off")).groupBy("encoding").agg(F.percentile_approx("off", at, 10_000)).collect()
    model = {}
    for kind, found in rows:
        if kind in lines and found:
            spread = max(LEAST_SPREAD, *((found[0] - q) / z for q, z in zip(found[1:], QUANTILES.values(), strict=True)))
            model[kind] = (lines[kind][0] + found[0], lines[kind][1], spread)
    return model


def ordinary_p(body: Column, model: dict[str, tuple[float, float, float]]) -> Column:
    """How likely an ordinary string of this encoding and length looks as random; 1 where decoys
    say nothing."""
    return _let(F.struct(encoding(body).alias("kind"), _evidence(body).alias("u"), _root_length(body).alias("root")), lambda t: _below(t, model))


def _below(t: Column, model: dict[str, tuple[float, float, float]]) -> Column:
    z = F.lit(-100.0)
    for kind, (start, slope, spread) in model.items():
        z = F.when(t["kind"] == kind, (start + slope * t["root"] - t["u"]) / spread).otherwise(z)
    return _tail(z)


def _thresholds(counts: list[tuple[int, int, int]], rate: float) -> dict[int, int]:
    """For each band the least bin that is reported, none where nothing is, from ``counts`` (band,
    bin, n). Higher bins hold smaller p-values, and a bin's largest stands for all of it."""
    out = {}
    for band in {c[0] for c in counts}:
        own = sorted(((b, n) for x, b, n in counts if x == band), reverse=True)
        total, so_far = sum(n for _, n in own), 0
        for b, n in own:
            so_far += n
            if 10 ** (-b / PER_DECADE) <= rate * so_far / total:
                out[band] = b
    return out


def scan_secrets(docs: DataFrame, rate: float = 0.05) -> DataFrame:
    """Find secrets in every whole text.

    Returns a row per row of ``docs``: ``doc_id``, ``base`` and ``added``, arrays of spans
    (``start``, ``stop`` in code points, stop exclusive; ``rank``, ``kind``, ``body``). Base
    spans are the fixed patterns' leftmost matches without overlap within a kind. Added ones are
    candidates that don't touch a base span and are found unlike ordinary strings, at a rate of
    ordinary ones among them of at most ``rate`` in each band of lengths. Null and empty texts
    have none. Rows of one ``doc_id`` are scanned each; other columns aren't read; no rows give
    no rows.

    Texts are scanned for spans once and read a second time for their decoys; the driver gets
    three lines and counts of p-values in at most six bands of 6001 bins.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    own = texts.select("doc_id", base_spans(F.col("text")).alias("base"), _found(F.col("text"), CANDIDATE, 0, 20, 3, "random").alias("added"))
    free = F.filter("added", lambda s: s["body"].rlike("[0-9]") & s["body"].rlike("[A-Za-z]") & ~F.exists("base", lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])))
    own = own.withColumn("added", F.when(F.size("added") > 0, free).otherwise(F.col("added")))
    own = materialize(own, "secrets")
    # Decoys are long to make and short to keep: made once, not in each place that reads them.
    decoys = _decoys(texts).select(encoding(F.col("body")).alias("encoding"), _root_length(F.col("body")).alias("root"), _evidence(F.col("body")).alias("u"))
    model = calibrate(materialize(decoys, "decoys"))
    # A bounded table of distinct candidates would not be; equal strings just count again.
    each = own.select(F.explode("added.body").alias("body")).select(_band(F.length("body")).alias("band"), _bin(ordinary_p(F.col("body"), model)).alias("bin"))
    cuts = _thresholds([tuple(r) for r in each.groupBy("band", "bin").count().collect()], rate)
    scored = F.filter("added", lambda s: _bin(ordinary_p(s["body"], model)) >= _cut(s["body"], cuts))
    return own.select("doc_id", "base", F.when(F.size("added") > 0, scored).otherwise(F.col("added")).alias("added"))


def _bin(p: Column) -> Column:
    return F.least(F.lit(BINS), F.floor(-F.log10(F.greatest(p, F.lit(1e-300))) * PER_DECADE)).cast("int")


def _cut(body: Column, cuts: dict[int, int]) -> Column:
    out = F.lit(BINS + 1)
    for band, cut in cuts.items():
        out = F.when(_band(F.length(body)) == band, F.lit(cut)).otherwise(out)
    return out


def span_text(spans: Column) -> Column:
    """``kind:start:stop`` of spans in order, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
