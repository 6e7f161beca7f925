"""Intermediate tables in the folder that all machines of a cluster share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache, reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


@cache
def _temporary(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-")


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package where the folder it lies in is not on their path."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where it is unset, the warehouse, which a
    cluster shares too, or on one machine a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and spark.sparkContext.master.startswith("local"):
        found = _temporary(spark.sparkContext.applicationId)
    return (found or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch").rstrip("/")


_scopes: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is written to the shared folder inside is removed at the end. Results that read it
    must be saved before; without a scope such tables stay, as lazy results may need them."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in map(spark._jvm.org.apache.hadoop.fs.Path, _scopes.pop()):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for scope in _scopes[-1:]:
        scope.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost
    executors, and gives later joins the table's real size."""
    importable(df.sparkSession)
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running(df: DataFrame, groups: list[str], by: list[Column], sizes: dict[str, Column]) -> DataFrame:
    """Add for each of ``sizes`` its sum over the rows that stand before each row in the order of
    ``by`` within its group, without a window over a group or all rows.

    Rows are range-partitioned once and written; the totals of the ranges (one row each) give
    every range its offset. Sums within a group are those among all rows less what stood before
    the group.
    """
    part, names = "__part", list(sizes)
    order = [*map(F.col, groups), *by]
    ranged = df.withColumns({f"__size_{n}": c for n, c in sizes.items()}).repartitionByRange(*order).withColumn(part, F.spark_partition_id())
    ranged = written(ranged, "in-order")
    totals = written(ranged.groupBy(part).agg(*[F.sum(f"__size_{n}").alias(f"__total_{n}") for n in names]), "in-order-totals")
    before = totals.select(part, *[(F.sum(f"__total_{n}").over(W.orderBy(part)) - F.col(f"__total_{n}")).alias(f"__before_{n}") for n in names])
    upto = W.partitionBy(part).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    here = ranged.withColumns({f"__here_{n}": F.sum(f"__size_{n}").over(upto) - F.col(f"__size_{n}") for n in names})
    placed = here.join(F.broadcast(before), part).withColumns({n: F.col(f"__before_{n}") + F.col(f"__here_{n}") for n in names})
    placed = placed.drop(part, *[f"__{x}_{n}" for n in names for x in ("size", "here", "before")])
    if not groups:
        return placed
    first = placed.groupBy(*groups).agg(*[F.min(n).alias(f"__first_{n}") for n in names]).withColumnsRenamed({g: f"__g_{g}" for g in groups})
    same = reduce(lambda a, b: a & b, (F.col(g).eqNullSafe(F.col(f"__g_{g}")) for g in groups))
    return placed.join(first, same).withColumns({n: F.col(n) - F.col(f"__first_{n}") for n in names}).drop(*[f"__first_{n}" for n in names], *[f"__g_{g}" for g in groups])


def in_order(df: DataFrame, by: list[Column], name: str, size: Column | None = None) -> DataFrame:
    """Add ``name``: how many rows (or the sum of ``size`` over the rows) stand before each row."""
    return running(df, [], by, {name: F.lit(1).cast("long") if size is None else size})


def numbered_within(df: DataFrame, groups: list[str], by: list[Column], name: str, size: Column | None = None) -> DataFrame:
    """Add ``name``: 0, 1, ... within each group in the order of ``by`` (or the sum of ``size``
    before)."""
    return running(df, groups, by, {name: F.lit(1).cast("long") if size is None else size})
