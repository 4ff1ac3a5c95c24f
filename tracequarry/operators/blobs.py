"""Content-addressed tensor blobs, and tensors made from their statistics."""

from __future__ import annotations

import gzip
from hashlib import blake2b

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from tracequarry.operators.ordering import cumulative


@pandas_udf(StructType([StructField("digest", StringType()), StructField("intact", BooleanType())]))
def check_blob(path: pd.Series, content: pd.Series) -> pd.DataFrame:
    """The BLAKE2b digest of a blob's bytes (inflated if they are gzip), and whether the file is
    named by it."""
    rows = []
    for p, c in zip(path, content, strict=True):
        data = gzip.decompress(c) if c[:2] == b"\x1f\x8b" else c
        digest = blake2b(data).hexdigest()
        rows.append((digest, p.rsplit("/", 1)[-1].split(".")[0] == digest))
    return pd.DataFrame(rows, columns=["digest", "intact"])


def read_blobs(spark, path: str) -> DataFrame:
    blobs = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return blobs.withColumn("c", check_blob(F.col("path"), F.col("content"))).select("path", "length", "c.digest", "c.intact")


def stored(blobs: DataFrame, quota: int, largest: int, order: str = "ord") -> DataFrame:
    """Which of a stream of blobs (``digest``, ``size``, ``ord``) a store keeps: each digest once,
    none over ``largest``, and all until the sum of sizes passes ``quota``."""
    own = blobs.where(F.col("size") <= largest).groupBy("digest").agg(F.min(F.struct(order, *[c for c in blobs.columns if c not in (order, "digest")])).alias("_first"))
    own = own.select("digest", "_first.*").select(blobs.columns)
    return cumulative(own, order, "size", "used").where(F.col("used") <= quota)


def latest_file(spark, path: str, glob: str = "*.json") -> DataFrame:
    """The file that was changed last."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select("path", "modificationTime").orderBy(F.desc("modificationTime"), F.desc("path")).limit(1)


def from_statistics(n: Column, mean: Column, std: Column, low: Column, high: Column, whole: bool = False, seed: int = 0) -> Column:
    """An array like a tensor of ``n`` elements: constant without spread, else normal values
    within the bounds; rounded for integer types."""
    constant = (std == 0) | (low == high)
    # rand() in a lambda would be one draw; hashes of the places give one for each.
    uniform = lambda i, k: (F.pmod(F.xxhash64(i, F.lit(seed), F.lit(k)), F.lit(1 << 30)) + 1) / F.lit((1 << 30) + 1)
    normal = lambda i: F.sqrt(-2 * F.log(uniform(i, 1))) * F.cos(2 * 3.141592653589793 * uniform(i, 2))
    value = lambda i: F.least(F.greatest(F.when(constant, mean).otherwise(normal(i) * std + mean), low), high)
    out = F.transform(F.sequence(F.lit(1), n.cast("int")), value)
    return F.transform(out, lambda x: F.bround(x)) if whole else out


def tensor_stats(values: Column) -> Column:
    """Struct ``min``, ``max``, ``mean``, ``std`` (of a sample) of an array."""
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / n
    spread = F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    return F.struct(F.array_min(values).alias("min"), F.array_max(values).alias("max"), mean.alias("mean"), F.when(n > 1, F.sqrt(spread / (n - 1))).alias("std"))
