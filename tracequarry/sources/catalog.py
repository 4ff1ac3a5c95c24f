"""Which trace files to read, and in which order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracequarry.config import LOG_PREFIX
from tracequarry.functions.paths import RankChoice, file_identity


def list_files(spark: SparkSession, folder: str, prefix: str = LOG_PREFIX) -> DataFrame:
    """``path`` and ``name`` of the trace files in a folder."""
    found = spark.read.format("binaryFile").load(folder).select("path")
    return found.withColumn("name", F.element_at(F.split("path", "/"), -1)).where(F.col("name").contains(prefix))


def choose(files: DataFrame, ranks: RankChoice, attribute: bool = True) -> DataFrame:
    """``path``, ``rank`` (null without one), ``pid``, ``host`` and ``file_ord`` of the files of
    the chosen ranks; ``file_ord`` counts by rank, in order of host, pid and path.

    A file without a rank belongs to the rank that the first file (by name) of its host and pid
    has, unless ``attribute`` is off or only files without ranks are asked for. If the chosen
    rank has no files, those without a rank stand in.
    """
    named = files.select("path", "name", file_identity(F.col("name")).alias("i")).select("path", "name", "i.*")
    if attribute and not ranks.none:
        first = Window.partitionBy("host", "pid").orderBy("name")
        owner = named.where("rank is not null and pid is not null").withColumn("_n", F.row_number().over(first)).where("_n = 1")
        owner = owner.select(F.col("host").alias("_host"), F.col("pid").alias("_pid"), F.col("rank").alias("_rank"))
        named = named.join(owner, F.col("host").eqNullSafe(F.col("_host")) & (F.col("pid") == F.col("_pid")), "left")
        named = named.withColumn("rank", F.coalesce("rank", "_rank")).drop("_host", "_pid", "_rank")
    if ranks.everything:
        out = named
    elif ranks.none:
        out = named.where("rank is null")
    else:
        wanted = ranks.rank or 0
        some = F.max(F.coalesce(F.col("rank") == wanted, F.lit(False))).over(Window.partitionBy())
        out = named.withColumn("_some", some).where((F.col("rank") == wanted) | (~F.col("_some") & F.col("rank").isNull())).drop("_some")
    order = Window.partitionBy("rank").orderBy(F.coalesce("host", F.lit("")), F.coalesce("pid", F.lit(-1)), "path")
    return out.select("path", "rank", "pid", "host", (F.row_number().over(order) - 1).alias("file_ord"))
