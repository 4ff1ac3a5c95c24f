"""Result files of pair tests, where the output tells nothing."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracequarry.functions import reports


def test_result_files(spark):
    said = "done\nResult file: /tmp/out dir/r.txt\nend"
    rows = [
        ("nothing", "a,b\nPosition: Pair 1 of 3"), (None, None), (said, None), (said, "  a,b \n "), (said, "a,b\nno place"), (said, ""),
        (said, " t1 , l2 \nx\nPosition: Pair 2 of 3\n"), (said, "t1\nPosition: Pair 1 of 3"), (said, "t1,l9\nPosition: Pair 9 of 3"), (said, "t1,l4\nPosition: Pair 4 of 3"),
    ]
    df = spark.createDataFrame(rows, "o string, c string").withColumn("l", F.array(F.lit("l1"), F.lit("l2"), F.lit("l3")))
    got = [tuple(r["r"]) for r in df.select(reports.file_result(F.col("o"), F.col("c"), F.col("l")).alias("r")).collect()]
    bad = lambda error: (False, None, None, None, None, error)
    assert got == [
        bad("Could not parse test output"), bad("Could not parse test output"), bad("Result file not found: /tmp/out dir/r.txt"), bad("Invalid result file format"), bad("Could not parse result file"), bad("Invalid result file format"),
        (True, 1, "l1", "l2", "t1", None), (True, 0, None, None, "t1", None), (True, 8, None, "l9", "t1", None), (True, 3, "l3", "l4", "t1", None),
    ]
