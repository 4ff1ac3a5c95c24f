"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

Iterative quantisation learns a rotation that brings centred vectors close to the corners of a
cube, so that the signs of the coordinates are balanced binary codes. The codes are cut into
substrings, one for each of several hash tables; vectors that share a substring are compared
by cosine in double precision. The substrings grow with the number of vectors, so buckets stay
about as large at every size. The number of tables follows from the recall asked for and from
how often pairs at the cosine asked for share substrings, which is measured on the sample: codes
are those of centred vectors, and where vectors have much in common such a pair agrees less than
its cosine says.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracequarry.llm.common import components, materialize
from tracequarry.llm.links import runs_of, spanning


def learn_rotation(sample: np.ndarray, seed: int, rounds: int = 50) -> np.ndarray:
    """A rotation of centred unit vectors that brings their signs close to them."""
    d = sample.shape[1]
    turn = np.linalg.qr(np.random.Generator(np.random.PCG64(seed)).standard_normal((d, d)))[0]
    if len(sample) <= 1:
        return turn
    axes = np.linalg.eigh(sample.T @ sample)[1]
    flat = sample @ axes
    for _ in range(rounds):
        u, _, v = np.linalg.svd(np.where(flat @ turn >= 0, 1.0, -1.0).T @ flat)
        turn = (u @ v).T
    return axes @ turn


def _signs(centred: np.ndarray, turns: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([centred @ t >= 0 for t in turns], axis=1)


class Codes:
    """Substrings of binary codes. ``parts`` maps a dimension to its mean and rotations."""

    def __init__(self, bits: int, tables: int, parts: dict[int, tuple[np.ndarray, list[np.ndarray]]]):
        self.bits, self.tables, self.parts = bits, tables, parts

    def _part(self, d: int) -> tuple[np.ndarray, list[np.ndarray]]:
        if d not in self.parts:  # of a dimension that the sample doesn't hold
            self.parts[d] = (np.zeros(d), [learn_rotation(np.zeros((0, d)), s) for s in range(max(1, -(-self.bits * self.tables // d)))])
        return self.parts[d]

    def buckets(self, unit: np.ndarray) -> np.ndarray:
        """The substring of every row in each table, as an int64 array."""
        mean, turns = self._part(unit.shape[1])
        signs = _signs(unit - mean, turns)[:, : self.bits * self.tables]
        weights = (1 << np.arange(self.bits, dtype=np.int64))[::-1]
        return signs.reshape(len(unit), self.tables, self.bits).astype(np.int64) @ weights


def tables_for(n: int, cosine: float, miss: float, bucket: int) -> tuple[int, int]:
    """Bits of a substring so that unrelated vectors share a bucket with about ``bucket``
    others, and how many tables leave a pair at ``cosine`` apart with a chance of ``miss``."""
    bits = min(28, max(4, round(math.log2(max(n, 2) / bucket))))
    return bits, _tables(random_agreement(cosine) ** bits, miss)


def random_agreement(cosine: float) -> float:
    """How often signs of a pair at ``cosine`` agree under random rotations without centring."""
    return 1 - math.acos(cosine) / math.pi


def _tables(share: float, miss: float) -> int:
    """Tables that leave a pair apart with a chance of ``miss`` if one brings it together with ``share``."""
    return 1 if share >= 1 else math.ceil(math.log(miss) / math.log1p(-share))


def pairs_at(unit: np.ndarray, mean: np.ndarray, cosine: float, seed: int = 7, least: int = 20_000, groups: int = 4, real: int = 4000) -> list[tuple[np.ndarray, np.ndarray]]:
    """Groups of pairs just at ``cosine``, each as two arrays.

    Every vector gets partners that have as much of the mean as itself (as far as that can be):
    in random directions, and in the directions of other vectors. Pairs of the sample that lie
    there are groups too. Groups part the vectors by their distance from the mean, since those
    close to it agree least.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    many, d = unit.shape
    if d < 3 or many < 2:
        return []
    own = unit[np.tile(np.arange(many), -(-least // many))]
    side = math.sqrt(1 - cosine * cosine)
    across = mean - (own @ mean)[:, None] * own
    long = np.sqrt((across * across).sum(axis=1))
    across /= np.maximum(long, 1e-12)[:, None]
    lean = np.where(long > 1e-9, np.minimum(1.0, (1 - cosine) * (own @ mean) / (side * np.maximum(long, 1e-12))), 0.0).clip(-1, 1)
    kinds = []
    for z in (rng.standard_normal(own.shape), unit[rng.integers(0, many, len(own))]):
        z = z - (z * own).sum(axis=1)[:, None] * own
        z = z - (z * across).sum(axis=1)[:, None] * across
        norm = np.sqrt((z * z).sum(axis=1))
        good = norm > 1e-6  # a vector and itself have no direction
        w = lean[:, None] * across + np.sqrt(1 - lean * lean)[:, None] * z / np.maximum(norm, 1e-12)[:, None]
        kinds.append((own[good], (cosine * own + side * w)[good]))
    some = unit[rng.permutation(many)[:real]]
    i, j = [], []
    for k in range(0, len(some), 500):
        at = some[k : k + 500] @ some.T
        x, y = np.nonzero((at >= cosine) & (at <= cosine + (1 - cosine) / 10))
        x, y = x[x + k < y], y[x + k < y]
        i.append(x[:least] + k)
        j.append(y[:least])
    kinds.append((some[np.concatenate(i)], some[np.concatenate(j)]))
    out = []
    for a, b in kinds:
        far = np.argsort(((a - mean) ** 2).sum(axis=1), kind="stable")
        out += [(a[part], b[part]) for part in np.array_split(far, groups) if len(part) >= 200]
    return out


def _shares(pairs: list[tuple[np.ndarray, np.ndarray]], mean: np.ndarray, turns: list[np.ndarray], bits: int) -> list[float]:
    """For substrings of 0 to ``bits`` bits: how often the pairs of the worst group share one."""
    least = [1.0] * (bits + 1)
    for a, b in pairs:
        same = _signs(a - mean, turns) == _signs(b - mean, turns)
        run = np.ones(same.shape, bool)
        for k in range(1, bits + 1):
            run = run[:, : same.shape[1] - k + 1] & same[:, k - 1 :]
            # The substrings of a code follow each other.
            least[k] = min(least[k], float(run[:, ::k].mean()))
    return least


def _missed(pairs: list[tuple[np.ndarray, np.ndarray]], codes: Codes) -> float:
    """How many pairs of the worst group share no bucket."""
    worst = 0.0
    for a, b in pairs:
        lost = 0
        for k in range(0, len(a), 1000):
            lost += int((~(codes.buckets(a[k : k + 1000]) == codes.buckets(b[k : k + 1000])).any(axis=1)).sum())
        worst = max(worst, lost / len(a))
    return worst


def fit_codes(units: list[np.ndarray], n: int, cosine: float, miss: float, bucket: int) -> Codes:
    """Codes for ``n`` vectors from samples of unit vectors, one for each dimension.

    Never fewer tables than random rotations need. Of all lengths of substrings the one is taken
    with the least work; with none, all vectors meet in one bucket. Tables are then added until
    the pairs of no group are missed more often than ``miss``.
    """
    most, _ = tables_for(n, cosine, miss, bucket)
    parts, pairs, shares = {}, {}, [random_agreement(cosine) ** b for b in range(most + 1)]
    for unit in units:
        d, mean = unit.shape[1], unit.mean(axis=0)
        pairs[d] = pairs_at(unit, mean, cosine)
        first = -(-max(512, most) // d) if pairs[d] else 0
        parts[d] = (mean, [learn_rotation(unit - mean, s) for s in range(first)])
        if first:
            shares = [min(x, y) for x, y in zip(shares, _shares(pairs[d], *parts[d], most), strict=True)]
    work = {b: _tables(x, miss) * (bucket + n / 2**b) for b, x in enumerate(shares) if x > 0}
    bits = min(work, key=lambda b: (work[b], b))
    tables = _tables(shares[bits], miss)
    while True:
        for unit in units:
            mean, turns = parts[unit.shape[1]]
            turns += [learn_rotation(unit - mean, s) for s in range(len(turns), max(1, -(-bits * tables // unit.shape[1])))]
        codes = Codes(bits, tables, parts)
        if all(_missed(pairs[d], codes) <= miss for d in pairs):
            return codes
        tables = math.ceil(1.15 * tables)


def _vector_task(narrow: bool):
    """Bytes of every usable vector; null for those that link with nothing."""
    kind = "<f4" if narrow else "<f8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column("embedding"):
                values = v.values
                x = None if values is None or values.null_count or not len(values) else values.to_numpy(zero_copy_only=False).astype(kind)
                good = x is not None and np.isfinite(x).all() and x.any()
                out.append(x.tobytes() if good else None)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").cast(pa.int64()), pa.array(out, pa.binary())], ["vec_id", "payload"])

    return run


def _unit(payloads: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(payloads), kind).reshape(len(payloads), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _post_task(codes: Codes, kind: str):
    size = np.dtype(kind).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                batch = whole.slice(k, 500)
                payloads, ids, counts = (batch.column(c).to_pylist() for c in ("payload", "id", "n"))
                for d in sorted({len(p) for p in payloads}):
                    own = [i for i, p in enumerate(payloads) if len(p) == d]
                    at = codes.buckets(_unit([payloads[i] for i in own], kind)).astype("<i4")
                    keys = [b"%d:%d:%d" % (d // size, t, x) for row in at.tolist() for t, x in enumerate(row)]
                    again = np.repeat(np.arange(len(own)), codes.tables).tolist()
                    raw = [r.tobytes() for r in at]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys, pa.binary()), pa.array(list(range(codes.tables)) * len(own), pa.int32()), pa.array([ids[own[i]] for i in again], pa.binary()),
                         pa.array([payloads[own[i]] for i in again], pa.binary()), pa.array([counts[own[i]] for i in again], pa.int64()), pa.array([raw[i] for i in again], pa.binary())],
                        ["key", "table", "id", "payload", "n", "buckets"],
                    )

    return run


def _compare_task(kind: str, cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, links = [], [], []
        for cell in runs_of(batches, "cell"):
            if cell.num_rows < 2:
                continue
            ids = cell.column("id").to_pylist()
            unit = _unit(cell.column("payload").to_pylist(), kind)
            counts = np.array(cell.column("n").to_pylist())
            table = cell.column("table")[0].as_py()
            at = np.frombuffer(b"".join(cell.column("buckets").to_pylist()), "<i4").reshape(len(ids), -1)
            side = np.array(cell.column("side").to_pylist())
            near = unit @ unit.T >= cosine
            np.fill_diagonal(near, False)
            if side.any():  # two blocks of a large bucket: pairs within one are compared elsewhere
                near &= side[:, None] != side[None, :]
            i, j = np.nonzero(np.triu(near))
            first = ~(at[i, :table] == at[j, :table]).any(axis=1)  # an earlier table has the others
            i, j = i[first], j[first]
            if not len(i):
                continue
            total = np.bincount(i, counts[j], len(ids)) + np.bincount(j, counts[i], len(ids))
            for k in np.flatnonzero(total).tolist():
                a.append(ids[k])
                b.append(None)
                links.append(int(total[k]))
            own = np.zeros((len(ids), len(ids)), bool)
            own[i, j] = own[j, i] = True
            for x, y in spanning(len(ids), lambda p, o, own=own: own[p, o]):
                a.append(ids[x])
                b.append(ids[y])
                links.append(0)
            if len(a) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(links, pa.int64())], ["a", "b", "links"])
                a, b, links = [], [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(links, pa.int64())], ["a", "b", "links"])

    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.9, miss: float = 0.002, bucket: int = 64, sample: int = 20_000, block: int = 1024) -> DataFrame:
    """Link vectors by cosine.

    Returns a row per row of ``vectors``: ``vec_id``, ``n_links`` (other rows linked directly),
    ``component_id`` (the least ``vec_id`` it reaches, itself included) and ``kept``. Pairs link
    at ``cosine`` or more, in double precision; none below do, and of those just at it about
    ``miss`` are overlooked, of nearer ones far fewer. Vectors that are null, empty or zero, or
    hold null or non-finite components, and vectors of different lengths link with nothing.
    Equal vectors are one class, compared once. Other columns aren't read; an empty table gives
    no rows. The rotations are learned, and the number of tables is measured, on about ``sample``
    distinct vectors, chosen by a hash.

    A bucket of over ``block`` classes is compared block by block in several tasks.
    """
    spark = vectors.sparkSession
    narrow = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    kind = "<f4" if narrow else "<f8"
    element = "float" if narrow else "double"
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{element}>").alias("embedding"))
    rows = vectors.mapInArrow(_vector_task(narrow), "vec_id long, payload binary")
    rows = materialize(rows.withColumn("id", F.expr("unhex(substr(sha2(payload, 256), 1, 32))")), "vectors")
    classes = rows.where("payload is not null").groupBy("id", "payload").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    classes = materialize(classes, "vector-classes")
    n = classes.count()
    share = min(1.0, sample / max(n, 1))
    held = classes.where(F.crc32("id") < F.lit(int(share * (1 << 32)))).select("payload").limit(2 * sample).toPandas()["payload"].tolist()
    codes = fit_codes([_unit([p for p in held if len(p) == size], kind) for size in sorted({len(p) for p in held})], n, cosine, miss, bucket)
    posted = classes.select("id", "payload", "n").mapInArrow(_post_task(codes, kind), "key binary, table int, id binary, payload binary, n long, buckets binary")
    posted = materialize(posted, "vector-posts")
    sizes = posted.groupBy("key").count().where("count > 1").select("key", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    dealt = posted.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    dealt = dealt.withColumn("cell", F.concat("key", F.concat(F.lit("/"), low.cast("string"), F.lit("/"), high.cast("string")).cast("binary")))
    dealt = dealt.withColumn("side", F.when(low == high, 0).when(F.col("own") == low, 1).otherwise(2))
    parts_ = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.select("cell", "id", "table", "payload", "n", "buckets", "side").repartition(parts_, "cell").sortWithinPartitions("cell", "id")
    found = materialize(dealt.mapInArrow(_compare_task(kind, cosine), "a binary, b binary, links long"), "vector-links")
    links = found.where("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    grouped = components(found.where("b is not null").select("a", "b"), "vector-components")
    joined = classes.select("id", "rep", "n").join(grouped.select(F.col("node").alias("id"), "component"), "id", "left")
    joined = joined.join(links.select(F.col("a").alias("id"), "links"), "id", "left")
    joined = materialize(joined.select("id", "rep", "n", F.coalesce("component", "id").alias("component"), F.coalesce("links", F.lit(0)).alias("links")), "vector-joined")
    least = joined.groupBy("component").agg(F.min("rep").alias("component_id"))
    ids = joined.join(least, "component").select("id", "component_id", (F.col("links") + F.col("n") - 1).alias("n_links"))
    out = rows.select("vec_id", "id").join(ids, "id", "left")
    component = F.when(F.col("id").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
