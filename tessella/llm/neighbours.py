"""Nearest neighbours by shifted space-filling curves, made whole by an exact check.

Vectors are projected ``CURVES`` times to a few random orthonormal directions, shifted, and
ordered along a Hilbert curve. Spark range-partitions each ordering into blocks of ``BLOCK``
vectors; a query visits its own block and the two beside it on every curve, and the windows'
candidates are merged and reranked by their exact scores.

Windows alone find most neighbours where vectors lie in groups, and few where they are
spread evenly over many dimensions. So the k-th score that the windows found goes on as a
bound: each block of the first curve has a head, its centre and radius, and the heads meet
the queries first. A query is copied only to the parts (eight blocks) where some head's best
possible score reaches its bound, and compared there block by block. In groups few parts are
reached; on evenly spread vectors all are, and the check costs queries times vectors.
``exact=False`` leaves it out. Equal vectors are searched once, and answer with their
smallest ids. See the README for measured recall.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.llm.blocks import reached, rows_of, searched
from tessella.llm.common import numbered, written
from tessella.llm.hilbert import hilbert_keys

CURVES, DIRECTIONS, BITS, BLOCK = 5, 6, 10, 512
SAMPLE_ROWS = 10_000
#: Vectors of a part of the check; scores at once.
ANSWERING, SCORES = 4096, 4_000_000


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, v array<double>`` of the vectors that aren't null or zero and hold only finite
    values."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), v.alias("v")).where("v is not null and size(v) > 0")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.where(F.coalesce(good, F.lit(False)))


def best_of(asking: np.ndarray, a: np.ndarray, ids: np.ndarray, x: np.ndarray, most: int) -> pd.DataFrame:
    """``rep, near, score``: for each row of ``a`` the ``most`` rows of ``x`` of largest inner
    product, ties to the smaller id. Scores are summed from the first value to the last; the
    matrix product only says which rows are worth that."""
    most, found = min(most, len(ids)), []
    longest = np.sqrt((x * x).sum(1).max()) if len(x) else 0
    for at in range(0, len(a) if most else 0, step := max(1, SCORES // max(1, len(ids)))):
        part = a[at : at + step]
        scores = part @ x.T
        least = np.partition(scores, len(ids) - most, axis=1)[:, len(ids) - most] - 1e-9 * longest * np.sqrt((part * part).sum(1))
        r, c = np.nonzero(~(scores < least[:, None]))
        exact = np.zeros(len(r))
        for d in range(x.shape[1]):
            exact += part[r, d] * x[c, d]
        order = np.lexsort((ids[c], -exact, r))
        r, c, exact = r[order], c[order], exact[order]
        keep = np.arange(len(r)) - np.searchsorted(r, r) < most
        found.append(pd.DataFrame({"rep": asking[at + r[keep]], "near": ids[c[keep]], "score": exact[keep]}))
    return pd.concat(found) if found else pd.DataFrame({"rep": asking[:0], "near": ids[:0], "score": np.zeros(0)})


def within_reach(asking: np.ndarray, a: np.ndarray, least: np.ndarray, ids: np.ndarray, x: np.ndarray, most: int, block: int) -> pd.DataFrame:
    """``best_of``, block by block of ``x``, for those rows of ``a`` that may have a score of
    ``least`` or more there: by q.x <= q.centre + |q| radius."""
    found, length = [], np.sqrt((a * a).sum(1))
    for at in range(0, len(ids), block):
        own = x[at : at + block]
        centre = own.mean(0)
        radius = np.sqrt(((own - centre) ** 2).sum(1).max())
        most_here = a @ centre + length * radius
        on = np.flatnonzero(~(most_here + 1e-9 * length * (np.abs(centre).sum() + radius) < least))
        if len(on):
            here = best_of(asking[on], a[on], ids[at : at + block], own, most)
            found.append(here[here["score"].to_numpy() >= least[on][np.searchsorted(asking[on], here["rep"].to_numpy())]])
    return pd.concat(found) if found else best_of(asking[:0], a[:0], ids[:0], x[:0], most)


def first_of(pairs: DataFrame, most: int) -> DataFrame:
    """The ``most`` best pairs of each ``rep``."""
    at = F.row_number().over(W.partitionBy("rep").orderBy(F.col("score").desc(), "near"))
    return pairs.withColumn("at", at).where(F.col("at") <= most).drop("at")


def nearest(vectors: DataFrame, is_query, k: int, id_col: str = "vec_id", vector_col: str = "embedding", curves: int = CURVES, block: int = BLOCK, seed: int = 11, exact: bool = True) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row where ``is_query`` (a condition on
    ``id``) holds, the k rows of largest inner product among the other rows, ties to the
    smaller id. Rows without a usable vector take no part; vectors are compared with those of
    their own length, one search for each length that occurs; fewer rows give all there are.
    Rows that repeat an id are one row, with the least of their vectors (by length, then by
    values). Other columns are ignored; no rows give no rows. ``exact=False`` gives what the
    curves' windows hold."""
    rows = written(usable(vectors, id_col, vector_col).withColumn("dim", F.size("v")), "ann-vectors")
    if not rows.groupBy("id").count().where("count > 1").isEmpty():
        rows = written(rows.groupBy("id").agg(F.min(F.struct("dim", "v")).alias("r")).select("id", "r.v", "r.dim"), "ann-vectors")
    dims = [r.dim for r in rows.select("dim").distinct().orderBy("dim").collect()]
    found = [_nearest_of_one_length(rows.where(F.col("dim") == d).select("id", "v"), is_query, k, curves, block, seed, exact) for d in dims]
    return reduce(DataFrame.unionByName, found) if found else rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)


def _nearest_of_one_length(rows: DataFrame, is_query, k: int, curves: int, block: int, seed: int, exact: bool) -> DataFrame:
    first = rows.withColumn("nth", F.row_number().over(W.partitionBy("v").orderBy("id"))).where(F.col("nth") <= k + 1)
    owners = written(first.groupBy("v").agg(F.min("id").alias("rep"), F.sort_array(F.collect_list("id")).alias("ids")), "ann-distinct")
    queries = written(rows.where(is_query).join(owners.select("v", "rep"), "v").select("id", "rep"), "ann-queries")
    asks = F.coalesce("asks", F.lit(False))
    distinct = owners.select("rep", "v").join(queries.select("rep").distinct().withColumn("asks", F.lit(True)), "rep", "left").withColumn("asks", asks)

    n, most = owners.count(), k + 1
    placed = _placed(owners, distinct, curves, seed)
    pairs = written(_in_windows(placed, n, most, curves, block), "ann-windows")
    if exact:
        pairs = pairs.unionByName(_in_reach(placed, pairs, most, block)).distinct()
    scored = first_of(pairs, most).join(owners.select(F.col("rep").alias("near"), "ids"), "near").select("rep", "ids", "score")
    out = queries.join(scored, "rep").select(F.col("id").alias("query_id"), F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _placed(owners: DataFrame, distinct: DataFrame, curves: int, seed: int) -> DataFrame:
    """``curve, key, rep, v, asks, at``: every vector on every curve; ``at`` counts through the
    curves one after the other."""
    # Fitted on a bounded sample: the spread along the directions. The longest norm is exact.
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    longest = owners.agg(F.max(norm)).first()[0] or 0.0
    sample = np.array([r.v for r in owners.select("rep", "v").orderBy(F.xxhash64("rep")).limit(SAMPLE_ROWS).select("v").collect()])
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    lift = lambda x: np.concatenate([x, np.sqrt(np.maximum(0, longest**2 - (x * x).sum(1)))[:, None]], 1)
    bases = [np.linalg.qr(rng.standard_normal((dim + 1, min(DIRECTIONS, dim + 1))))[0] for _ in range(curves)]
    fits = []
    for base in bases:
        y = lift(sample) @ base
        spread = np.where(y.std(0) > 0, y.std(0), 1)
        fits.append((base, y.mean(0), spread, rng.uniform(-0.05, 0.05, base.shape[1])))

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            x = lift(np.stack(df["v"].to_numpy())) if len(df) else np.zeros((0, dim + 1))
            for c, (base, mean, spread, shift) in enumerate(fits):
                unit = ((x @ base - mean) / spread) / 8 + 0.5 + shift
                cells = np.clip(unit * 2**BITS, 0, 2**BITS - 1).astype(np.int64)
                yield df.assign(curve=np.int32(c), key=hilbert_keys(cells, BITS))[["curve", "key", "rep", "v", "asks"]]

    return numbered(distinct.mapInPandas(keyed, "curve int, key long, rep long, v array<double>, asks boolean"), [F.col("curve"), F.col("key"), F.col("rep")], "at")


def _in_windows(placed: DataFrame, n: int, most: int, curves: int, block: int) -> DataFrame:
    """``rep, near, score``: the best of the windows of each row that asks. Vectors lie in one
    block of a curve; the queries visit it and the blocks beside it."""
    here = F.floor((F.col("at") - F.col("curve").cast("long") * n) / block).cast("int")
    last = max(n - 1, 0) // block
    beside = F.filter(F.array(here - 1, here, here + 1), lambda b: (b >= 0) & (b <= last))
    hold = placed.select("curve", here.alias("block"), F.lit(False).alias("asks"), "rep", "v")
    visit = placed.where("asks").select("curve", F.explode(beside).alias("block"), F.lit(True).alias("asks"), "rep", "v")

    def search(df: pd.DataFrame) -> pd.DataFrame:
        ask, ids, x = df["asks"].to_numpy(), df["rep"].to_numpy(), np.stack(df["v"].to_numpy())
        return best_of(ids[ask], x[ask], ids[~ask], x[~ask], most)

    return hold.unionByName(visit).groupBy("curve", "block").applyInPandas(search, "rep long, near long, score double").distinct()


def farthest(queries: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """The largest score that a query can have in a block of that centre and radius, a little up
    for round-off: q.x <= q.centre + |q| radius."""
    centre, radius = heads[:, :-1], heads[:, -1]
    length = np.sqrt((queries * queries).sum(1))[:, None]
    with np.errstate(over="ignore", invalid="ignore"):
        most = queries @ centre.T + length * (radius + 1e-9 * (np.abs(centre).sum(1) + radius))
    return np.where(np.isnan(most), np.inf, most)  # beyond doubles: visit


def _in_reach(placed: DataFrame, pairs: DataFrame, most: int, block: int) -> DataFrame:
    """``rep, near, score``: for each row that asks, what the blocks of the first curve hold
    with a score of its ``most``-th in ``pairs`` or more (the best of each block)."""
    bound = first_of(pairs, most).groupBy("rep").agg(F.min("score").alias("least"), F.count("*").alias("n")).select("rep", F.when(F.col("n") >= most, F.col("least")).alias("least"))
    blocks = max(1, ANSWERING // block)
    curve = placed.where("curve = 0").select(F.lit(0).alias("dim"), F.floor(F.col("at") / (blocks * block)).alias("part"), "rep", "v", "asks", "at")
    asking = written(curve.where("asks").join(bound, "rep", "left").select("dim", "rep", "v", "least", F.lit(None).cast("long").alias("home")), "ann-asking")

    def head(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("at")
        x, found = rows_of(rows["v"]), []
        for at in range(0, len(x), block):
            centre = x[at : at + block].mean(0)
            found.append([*centre, np.sqrt(((x[at : at + block] - centre) ** 2).sum(1).max())])
        part = rows["part"][0].as_py()
        return pa.table({"dim": pa.array([0] * len(found), pa.int32()), "part": pa.array([part] * len(found), pa.int64()), "block": pa.array([part * blocks + i for i in range(len(found))], pa.int64()), "head": pa.array(found, pa.list_(pa.float64()))})

    def search(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        least = queries["least"].fill_null(-np.inf).to_numpy()
        if not len(queries) or not len(vectors):
            return pa.table({"rep": pa.array([], pa.int64()), "near": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        found = within_reach(queries["rep"].to_numpy(), rows_of(queries["v"]), least, vectors["rep"].to_numpy(), rows_of(vectors["v"]), most, block)
        return pa.table({c: pa.array(found[c].to_numpy(), t) for c, t in (("rep", pa.int64()), ("near", pa.int64()), ("score", pa.float64()))})

    heads = written(curve.groupBy("dim", "part").applyInArrow(head, "dim int, part long, block long, head array<double>"), "ann-heads")
    met = reached(heads, asking, farthest)
    return searched(curve, asking, met, search, "rep long, near long, score double")
