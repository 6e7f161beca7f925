"""Permutation tests whose shuffles are drawn as counts, not as copies of the table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.stats import finite, kruskal_h, permutation_test
from tessella.sources.scratch import running, written

#: Children of a node of the tree over the values; rows that the draws of counts can hold.
FAN, MOST_ROWS = 256, 10**9
#: Children whose counts leave a task together, and tasks of a level.
BATCH, TASKS = 64, 4096


def deal(rng: np.random.Generator, counts: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """For each place of ``sizes`` in turn the classes of the rows that a shuffle puts there, for
    every replicate (a row of ``counts``: what is to be dealt of each class): multivariate
    hypergeometric draws, each from what the places before left."""
    left = counts.copy()
    for size in sizes:
        taken, open_, others = np.empty_like(left), np.full(len(left), size), left.sum(1)
        for k in range(left.shape[1]):
            others = others - left[:, k]
            taken[:, k] = rng.hypergeometric(left[:, k], others, open_)
            open_ = open_ - taken[:, k]
        left -= taken
        yield taken


def _tree(values: DataFrame) -> list[tuple[DataFrame, int]]:
    """Levels from the leaves up, ``node, children(id, t, rank)``, with their numbers of nodes,
    the last with one."""
    levels, rows = [], values
    while True:
        children = F.sort_array(F.collect_list(F.struct("id", "t", "rank"))).alias("children")
        level = written(rows.groupBy(F.floor(F.col("id") / FAN).alias("node")).agg(children, F.sum("t").alias("total")), "shuffle-tree")
        nodes = level.count()
        levels.append((level.select("node", "children"), nodes))
        if nodes < 2:
            return levels
        rows = level.select(F.col("node").alias("id"), F.col("total").alias("t"), F.lit(None).cast("double").alias("rank"))


def rank_sums(values: DataFrame, sizes: list[int], n: int, seed: int) -> DataFrame:
    """``replicate, class, r``: sums of the ranks that ``n`` shuffles give each class.
    ``values(id, t, rank)``: distinct values numbered from 0, their rows and rank; ``sizes``: rows
    of each class.

    Counts go down a tree over the values: a node deals its counts of each class to its
    children. A row of the tables between holds a node's counts in all replicates.
    """
    k, levels = len(sizes), _tree(values)
    apart = lambda level, state: levels[level][0].join(state, "node").repartition(min(TASKS, levels[level][1]), "node")

    def dealt(df: pd.DataFrame, level: int) -> Iterator[tuple[list, Iterator[np.ndarray]]]:
        for node, children, counts in zip(df["node"], df["children"], df["counts"], strict=True):
            rng = np.random.default_rng([seed, level, int(node)])
            places = np.array([c["t"] for c in children], np.int64)
            yield children, deal(rng, np.asarray(counts, np.int64).reshape(n, k), places)

    def down(level: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for df in batches:
                for children, draws in dealt(df, level):
                    ids, rows = [], []
                    for child, taken in zip(children, draws, strict=True):
                        ids.append(child["id"])
                        rows.append(taken.ravel())
                        if len(ids) == BATCH:
                            yield pd.DataFrame({"node": ids, "counts": rows})
                            ids, rows = [], []
                    if ids:
                        yield pd.DataFrame({"node": ids, "counts": rows})

        return run

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            total = np.zeros((n, k))
            for children, draws in dealt(df, 0):
                for child, taken in zip(children, draws, strict=True):
                    total += child["rank"] * taken
            yield pd.DataFrame({"r": [total.ravel()]})

    whole = F.flatten(F.array_repeat(F.array(*[F.lit(m).cast("long") for m in sizes]), n))
    state = levels[-1][0].select("node", whole.alias("counts"))
    for level in range(len(levels) - 1, 0, -1):
        state = written(apart(level, state).mapInPandas(down(level), "node long, counts array<long>"), "shuffle-counts")
    parts = apart(0, state).mapInPandas(sums, "r array<double>")
    at = parts.select(F.posexplode("r").alias("at", "r")).groupBy("at").agg(F.sum("r").alias("r"))
    return at.select((F.floor(F.col("at") / k) + 1).alias("replicate"), (F.col("at") % k).alias("class"), "r")


def permutation_by_counts(df: DataFrame, value: str, label: str, key: str, n: int, seed: int = 42, statistic: str = "kruskal") -> DataFrame:
    """``observed`` and ``p`` of ``permutation_test`` (H by label, or |Spearman|), the ``n``
    shuffles drawn as counts of each label at each value; reruns agree.

    Both statistics need only the rank sum of each label, and a shuffle gives the rows of a value
    a multivariate hypergeometric sample of the labels. So the work is ``n`` times the
    distinct values and labels, whatever the rows. Labels are few: their sizes come to the
    driver. Rows without a finite value or a label take no part; no rows, one label or one value
    give 0 and 1. From ``MOST_ROWS`` rows on, the shuffles are laid out row by row, in the
    order of hashes of ``key``.
    """
    known = df.where(finite(value) & F.col(label).isNotNull())
    cells = written(known.groupBy(F.col(value).alias("value"), F.col(label).alias("label")).agg(F.count("*").alias("n")), "shuffle-cells")
    classes = [(r["label"], r["m"]) for r in cells.groupBy("label").agg(F.sum("n").alias("m")).orderBy("label").collect()]
    sizes = [m for _, m in classes]
    rows, spark = sum(sizes), df.sparkSession
    if rows >= MOST_ROWS:
        return permutation_test(known, value, label, key, n, seed, statistic)
    if len(classes) < 2:
        return spark.range(1).select(F.lit(0.0).alias("observed"), F.lit(1.0).alias("p"))
    values = cells.groupBy("value").agg(F.sum("n").alias("t"))
    placed = running(values, [], [F.col("value")], {"id": F.lit(1).cast("long"), "before": F.col("t")})
    placed = written(placed.select("value", "id", "t", (F.col("before") + (F.col("t") + 1) / 2).alias("rank")), "shuffle-values")
    upto = np.cumsum(sizes).tolist()
    named = spark.createDataFrame([(i, c, m, float(u - m + (m + 1) / 2)) for i, ((c, m), u) in enumerate(zip(classes, upto, strict=True))], f"class int, label {dict(cells.dtypes)['label']}, m long, y double")
    own = cells.join(placed, "value").groupBy("label").agg(F.sum(F.col("n") * F.col("rank")).alias("r")).join(named, "label").select(F.lit(0).cast("long").alias("replicate"), "class", "r")
    every = own.unionByName(rank_sums(placed.select("id", "t", "rank"), sizes, n, seed)).join(F.broadcast(named.select("class", "m", "y")), "class")
    t = F.col("t").cast("double")
    ties = placed.agg(F.sum(t * t * t - t).alias("ties"))
    g = every.groupBy("replicate").agg(F.sum(F.col("r") * F.col("r") / F.col("m")).alias("s"), F.sum(F.col("r") * F.col("y")).alias("ry")).crossJoin(F.broadcast(ties))  # one row
    whole = F.lit(float(rows))
    if statistic == "kruskal":
        stat = kruskal_h(whole, F.lit(len(classes)), F.col("s"), F.col("ties"))
    else:
        # Sums of squares about the mean rank: (n^3 - n - ties) / 12, for values and labels alike.
        cube, mean = float(rows) ** 3 - rows, (rows + 1) / 2
        sx, sy = (F.lit(cube) - F.col("ties")) / 12, (cube - sum(float(m) ** 3 - m for m in sizes)) / 12
        stat = F.when((sx > 0) & F.lit(sy > 0), F.abs(F.try_divide(F.col("ry") - whole * mean * mean, F.sqrt(sx * sy)))).otherwise(0.0)
    found = written(g.select("replicate", stat.alias("stat")), "shuffle-statistics")
    seen = found.where("replicate = 0").select(F.col("stat").alias("observed"))
    return found.where("replicate > 0").crossJoin(F.broadcast(seen)).groupBy("observed").agg(((F.count_if(F.col("stat") >= F.col("observed") - 1e-9) + 1) / (F.count("*") + 1)).alias("p"))
