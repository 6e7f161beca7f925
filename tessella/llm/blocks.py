"""Exact searches of vectors in blocks: heads first, then only what a bound lets through.

A table of vectors lies in blocks, and neighbouring blocks in parts. Each block has a head, a
few numbers that bound the score of any query with any vector of the block. Heads meet the
queries first; a query is copied to a part, and a part to a group of queries, only where some
block's bound reaches the score that the query has to beat.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import written

#: Queries that meet in one task, and heads they meet there.
ASKING, HEADS = 4096, 2048


def rows_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of lists of one length, as a matrix."""
    arrays = [a for a in (column.chunks if isinstance(column, pa.ChunkedArray) else [column]) if len(a)]
    return np.concatenate([a.flatten().to_numpy(zero_copy_only=False).reshape(len(a), -1) for a in arrays]) if arrays else np.zeros((0, 0))


def _dealt(asking: DataFrame, chunks: int) -> DataFrame:
    return asking.withColumn("chunk", F.pmod(F.xxhash64("rep"), F.lit(chunks)).cast("int"))


def reached(heads: DataFrame, asking: DataFrame, limit: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """``dim, part, rep``: the parts with a block whose ``limit(queries, heads)`` is at least the
    query's ``least`` (null: all), except the query's part ``home`` (null: none is).

    ``heads(dim, part, block long, head array<double>)``, ``asking(dim, rep, v, least, home)``.
    """
    chunks = max(1, -(-asking.count() // ASKING))
    packs = heads.withColumn("pack", F.floor(F.col("block") / HEADS).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    has = packs.select("dim", "pack").distinct()
    none = F.lit(None)
    left = _dealt(asking, chunks).join(F.broadcast(has) if has.count() < 10_000 else has, "dim").select("dim", "pack", "chunk", "rep", F.col("v").cast("array<double>").alias("v"), "least", "home", none.cast("long").alias("part"))
    right = packs.select("dim", "pack", "chunk", none.cast("long").alias("rep"), F.col("head").alias("v"), none.cast("double").alias("least"), none.cast("long").alias("home"), "part")

    def meet(rows: pa.Table) -> pa.Table:
        asks = rows["part"].is_null()
        q, h = rows.filter(asks), rows.filter(pc.invert(asks))
        parts, dim = h["part"].to_numpy(), rows["dim"][0].as_py()
        names, place = np.unique(parts, return_inverse=True)
        reps, least, home = q["rep"].to_numpy(), q["least"].fill_null(-np.inf).to_numpy(), q["home"].fill_null(-1).to_numpy()
        found = np.zeros((len(reps), len(names)), bool)
        if len(reps) and len(names):
            queries, bounds = rows_of(q["v"]), rows_of(h["v"])
            for at in range(0, len(reps), 512):
                can = limit(queries[at : at + 512], bounds) >= least[at : at + 512, None]
                r, c = np.nonzero(can)
                found[at + r, place[c]] = True
        r, c = np.nonzero(found & (names[None, :] != home[:, None]))
        return pa.table({"dim": pa.array(np.full(len(r), dim), pa.int32()), "part": pa.array(names[c], pa.int64()), "rep": pa.array(reps[r], pa.int64())})

    return left.unionByName(right).groupBy("dim", "pack", "chunk").applyInArrow(meet, "dim int, part long, rep long").distinct()


def searched(placed: DataFrame, asking: DataFrame, pairs: DataFrame, search: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """What ``search(queries, vectors)`` finds, for the pairs ``(dim, part, rep)``: queries with
    ``rep, v, least``, vectors of the part with ``rep, at, v``."""
    chunks = max(1, -(-asking.count() // ASKING))
    visits = written(_dealt(pairs, chunks), "visits")
    ask = visits.join(asking.select("rep", "v", "least"), "rep").select("dim", "part", "chunk", F.lit(True).alias("asks"), "rep", F.lit(0).cast("long").alias("at"), "v", "least")
    hold = placed.join(visits.select("dim", "part", "chunk").distinct(), ["dim", "part"]).select("dim", "part", "chunk", F.lit(False).alias("asks"), "rep", "at", "v", F.lit(None).cast("double").alias("least"))

    def visit(rows: pa.Table) -> pa.Table:
        asks = rows["asks"]
        return search(rows.filter(asks).sort_by("rep"), rows.filter(pc.invert(asks)).sort_by("at"))

    return ask.unionByName(hold).groupBy("dim", "part", "chunk").applyInArrow(visit, schema)
