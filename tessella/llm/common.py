"""Helpers that the operators of this package share."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.sources.scratch import new_path

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package where the folder it lies in is not on their path."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost
    executors, and gives later joins the table's real size."""
    spark = df.sparkSession
    importable(spark)
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hash01(*cols: Column | str) -> Column:
    """A number in [0, 1) that depends on the columns' values only."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) * F.lit(2.0**-53)


def numbered(df: DataFrame, by: list[Column], name: str) -> DataFrame:
    """Add ``name``: 0, 1, ... in the order of ``by``, without a one-task window.

    Rows are range-partitioned and written; the counts of the ranges (one number per
    partition) give each range its offset.
    """
    part = "__part"
    ranged = written(df.repartitionByRange(*by).withColumn(part, F.spark_partition_id()), "numbered")
    sizes = sorted((r[0], r[1]) for r in ranged.groupBy(part).count().collect())
    offset, pairs = 0, []
    for p, n in sizes:
        pairs += [F.lit(p), F.lit(offset).cast("long")]
        offset += n
    if not pairs:
        return ranged.drop(part).withColumn(name, F.lit(0).cast("long"))
    here = F.row_number().over(W.partitionBy(part).orderBy(*by)) - 1
    return ranged.withColumn(name, here + F.element_at(F.create_map(*pairs), F.col(part))).drop(part)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges ``(a long, b long)``: ``(id, component)``,
    component the smallest id that can be reached.

    Each round takes the smallest label among the neighbours and then the label of that
    label (pointer jumping), so long chains end in few rounds. Every round is written to
    the shared folder.
    """
    both = written(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(),
        "edges",
    )
    labels = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("c")).select(F.col("a").alias("id"), "c"), "labels")
    while True:
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("c").alias("n"))
        step = labels.join(near, labels.id == near.a).select("id", F.col("c").alias("was"), F.least("c", "n").alias("c"))
        jump = labels.select(F.col("id").alias("c"), F.col("c").alias("up"))
        step = written(step.join(jump, "c", "left").select("id", "was", F.least("c", F.coalesce("up", "c")).alias("c")), "labels")
        labels = step.select("id", "c")
        if step.where("c <> was").isEmpty():
            return labels.withColumnRenamed("c", "component")
