"""Scratch tables go with their scope; running sums by group in one range pass."""

import os

from pyspark.sql import functions as F

from tessella.sources.scratch import running, scratch, written


def test_scope_removes_what_was_written_inside(spark):
    kept = written(spark.range(3), "kept")
    with scratch(spark):
        inner = written(spark.range(5), "inner")
        assert inner.count() == 5
        files = inner.inputFiles()
    assert kept.count() == 3 and files and not any(os.path.exists(f.removeprefix("file://")) for f in files)


def test_running_sums_of_groups(spark):
    rows = [("a", 3, 10), ("a", 1, 20), ("b", 2, 5), (None, 9, 7), (None, 8, 1), ("a", 2, 30)]
    df = spark.createDataFrame(rows, "g string, x int, y int")
    got = {(r.g, r.x): (r.n, r.s) for r in running(df, ["g"], [F.col("x")], {"n": F.lit(1).cast("long"), "s": F.col("y").cast("long")}).collect()}
    assert got == {("a", 1): (0, 0), ("a", 2): (1, 20), ("a", 3): (2, 50), ("b", 2): (0, 0), (None, 8): (0, 0), (None, 9): (1, 1)}
    assert running(df.limit(0), ["g"], [F.col("x")], {"n": F.lit(1).cast("long")}).count() == 0
