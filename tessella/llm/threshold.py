"""Exact top-k by inner product: the threshold algorithm over sorted lists of every dimension.

Vectors of whole numbers lie in blocks; a block keeps one list a dimension, its vectors sorted
by their value there. A query reads the lists of its non-zero dimensions from their better
ends, all to the same depth, scores what it meets for the first time in full, and stops when
the sum over the lists of what the next entries could add is below its k-th score. Depths
double, so that each step works on arrays.

Every query searches its own block first; the k-th score found there goes on as the least
that counts. The first entries of a block's lists are its head: they give the threshold at
depth 0, and a block whose threshold is below that score isn't visited. Blocks hold vectors
whose largest components stand in the same dimensions, so that lists begin alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.llm.blocks import reached, rows_of, searched
from tessella.llm.common import numbered, written

BLOCK, FIRST_DEPTH = 8192, 8
#: Whole numbers of more than this are cut to it: doubles hold all smaller ones.
LARGEST = 2**53
LONG = 2**63


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``id, dim, x array<long>``: floor(scale * component) of the vectors that are neither null
    nor empty and hold only finite values; of rows that share an id the least vector (by
    length, then by values). Rows without an id take no part."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("v is not null and size(v) > 0")
    rows = rows.where(F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)))
    cut = lambda x: F.floor(F.least(F.greatest(F.lit(float(scale)) * x, F.lit(-float(LARGEST))), F.lit(float(LARGEST)))).cast("long")
    return rows.select("id", F.size("v").alias("dim"), F.transform("v", cut).alias("x")).groupBy("id").agg(F.min(F.struct("dim", "x")).alias("r")).select("id", "r.dim", "r.x")


def exact(q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as the fastest kind of number in which their inner products are exact."""
    most = int(np.abs(q).max(initial=0)) * int(np.abs(x).max(initial=0)) * max(1, q.shape[-1])
    kind = np.float64 if most < 2**53 else np.int64 if most < LONG else object
    return q.astype(kind), x.astype(kind)


class Lists:
    """The vectors of a block, sorted by their value in every dimension."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.order = np.argsort(x, axis=0, kind="stable")
        self.values = np.take_along_axis(x, self.order, 0)

    def search(self, q: np.ndarray, k: int, least: float | None) -> tuple[np.ndarray, np.ndarray]:
        """``(scores, ids)`` of the k best rows (ties to the smaller id), without those below
        ``least``."""
        n = len(self.ids)
        up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        if not len(up) + len(down):  # every score is 0
            ids = np.sort(self.ids)[:k]
            return np.zeros(len(ids), self.x.dtype), ids
        met = np.zeros(n, bool)
        scores, ids = np.zeros(0, self.x.dtype), self.ids[:0]
        depth, step = 0, FIRST_DEPTH
        while depth < n:
            to = min(n, depth + step)
            now = np.zeros(n, bool)
            now[self.order[n - to : n - depth, up]] = True
            now[self.order[depth:to, down]] = True
            new = np.flatnonzero(now & ~met)
            met[new] = True
            own = self.x[new] @ q
            if least is not None:
                new, own = new[own >= least], own[own >= least]
            scores, ids = np.concatenate([scores, own]), np.concatenate([ids, self.ids[new]])
            if len(ids) > k:
                best = np.lexsort((ids, -scores))[:k]
                scores, ids = scores[best], ids[best]
            bound = q[up] @ self.values[n - to, up] + q[down] @ self.values[to - 1, down]
            if least is not None and bound < least or len(ids) == k and bound < scores.min() or met.all():
                break
            depth, step = to, step * 2
        return scores, ids


def depth_0(queries: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """The threshold of every query at the first entries of every block's lists, a little up for
    round-off."""
    low, high = np.split(heads, 2, axis=1)
    gain = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
    return gain + 1e-9 * (np.abs(queries) @ np.maximum(np.abs(low), np.abs(high)).T)


def _found(reps: list, scores: list, ids: list) -> pa.Table:
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    rep = np.repeat(np.array(reps, np.int64), [len(s) for s in scores]) if reps else np.zeros(0, np.int64)
    score = [min(max(int(s), -LONG), LONG - 1) for s in join(scores)]
    return pa.table({"rep": pa.array(rep, pa.int64()), "near": pa.array(join(ids), pa.int64()), "score": pa.array(score, pa.int64())})


def _search(most: int):
    def search(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        if not queries.num_rows or not vectors.num_rows:
            return _found([], [], [])
        q, x = exact(rows_of(queries["v"]), rows_of(vectors["v"]))
        lists = Lists(vectors["rep"].to_numpy(), x)
        least = queries["least"].to_pylist()
        out = [lists.search(a, most, b) for a, b in zip(q, least)]
        return _found(queries["rep"].to_pylist(), [o[0] for o in out], [o[1] for o in out])

    return search


def _at_home(most: int):
    search = _search(most)

    def home(rows: pa.Table) -> pa.Table:
        """The block's head, as a row with no ``rep``, and what its own queries find in it."""
        asking = rows.filter(rows["asks"])
        found = search(asking.append_column("least", pa.nulls(len(asking), pa.float64())), rows)
        x = rows_of(rows["v"])
        head = np.concatenate([x.min(0), x.max(0)]).astype(float).tolist()
        more = {c: pa.array([None, *found[c].to_pylist()], pa.int64()) for c in ("rep", "near", "score")}
        same = lambda c, t: pa.array([rows[c][0].as_py()] * (1 + len(found)), t)
        return pa.table({"dim": same("dim", pa.int32()), "part": same("part", pa.int64()), **more, "head": pa.array([head] + [None] * len(found), pa.list_(pa.float64()))})

    return home


def first_of(pairs: DataFrame, most: int) -> DataFrame:
    """The ``most`` best pairs of each ``rep``."""
    at = F.row_number().over(W.partitionBy("rep").orderBy(F.col("score").desc(), "near"))
    return pairs.withColumn("at", at).where(F.col("at") <= most).drop("at")


def top_k(vectors: DataFrame, is_query, k: int, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row where ``is_query`` (a condition on ``id``)
    holds, the k other rows of the largest inner product of whole components
    floor(scale * x), ties to the smaller id.

    Null and empty vectors, and those with null or non-finite components, take no part, nor do
    rows without an id; rows that repeat an id are one row, with the least of their vectors.
    Vectors are compared with those of their own length; fewer rows give all there are. Whole
    components beyond 2**53 count as that, scores beyond a long as its limit (their order is
    exact within a block). Equal vectors are searched once and answer with their smallest ids.
    Other columns are ignored; no rows give no rows.
    """
    rows = written(whole_vectors(vectors, id_col, vector_col, scale), "topk-vectors")
    most = k + 1
    first = rows.withColumn("nth", F.row_number().over(W.partitionBy("dim", "x").orderBy("id"))).where(F.col("nth") <= most)
    owners = written(first.groupBy("dim", "x").agg(F.min("id").alias("rep"), F.sort_array(F.collect_list("id")).alias("ids")), "topk-distinct")
    queries = written(rows.where(is_query).join(owners.select("dim", "x", "rep"), ["dim", "x"]).select("id", "rep"), "topk-queries")

    # Like vectors together: by the signed dimensions of the three largest components.
    strongest = F.slice(F.reverse(F.array_sort(F.transform("x", lambda x, i: F.struct(F.abs(x).alias("size"), F.when(x < 0, -i - 1).otherwise(i + 1).alias("axis")))).getField("axis")), 1, 3)
    asks = F.coalesce("asks", F.lit(False))
    own = owners.select("dim", "rep", F.col("x").alias("v"), strongest.alias("axes")).join(queries.select("rep").distinct().withColumn("asks", F.lit(True)), "rep", "left").withColumn("asks", asks)
    placed = numbered(own, [F.col("dim"), F.col("axes"), F.col("rep")], "at").withColumn("part", F.floor(F.col("at") / block)).drop("axes")

    home = written(placed.groupBy("dim", "part").applyInArrow(_at_home(most), "dim int, part long, rep long, near long, score long, head array<double>"), "topk-home")
    found = home.where("rep is not null").select("rep", "near", "score")
    bound = found.groupBy("rep").agg(F.min("score").alias("low"), F.count("*").alias("n")).select("rep", F.when(F.col("n") >= most, F.col("low")).cast("double").alias("least"))
    asking = written(placed.where("asks").join(bound, "rep", "left").select("dim", "rep", "v", "least", F.col("part").alias("home")), "topk-asking")
    heads = home.where("rep is null").select("dim", "part", F.col("part").alias("block"), "head")
    pairs = written(reached(heads, asking, depth_0), "topk-reached")
    pairs = found.unionByName(searched(placed, asking, pairs, _search(most), "rep long, near long, score long"))

    scored = first_of(pairs, most).join(owners.select(F.col("rep").alias("near"), "ids"), "near").select("rep", "ids", "score")
    out = queries.join(scored, "rep").select(F.col("id").alias("query_id"), F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
