"""Deterministic sampling and splitting (F). Every choice orders by md5 of seed and key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.sources.scratch import in_order, numbered_within, written


def order_key(seed: int, *keys: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def positive_triples(matrix: DataFrame) -> DataFrame:
    """``matrix(row_id, values array)`` -> (row_id, col_id, freq) of the positive cells."""
    return matrix.select("row_id", F.posexplode("values").alias("col_id", "freq")).where("freq > 0")


def stratified_kfold(df: DataFrame, label: str, keys: list[str], k: int, seed: int = 42) -> DataFrame:
    """``fold`` 1..k: classes laid end to end in hash order, every k-th row a fold."""
    out = in_order(df.withColumn("__h", order_key(seed, *keys)), [F.col(label), F.col("__h"), *map(F.col, keys)], "__at")
    return out.withColumn("fold", (F.col("__at") % k + 1).cast("int")).drop("__at", "__h")


def stratified_holdout(df: DataFrame, label: str, keys: list[str], fraction: float, seed: int = 42) -> DataFrame:
    """``held``: max(1, round half to even of n * fraction) rows of each class, by hash."""
    n = df.groupBy(label).agg(F.count("*").alias("__n"))
    out = numbered_within(df.withColumn("__h", order_key(seed, *keys)), [label], [F.col("__h"), *map(F.col, keys)], "__at").join(F.broadcast(n), label)
    return out.withColumn("held", F.col("__at") < F.greatest(F.lit(1), F.bround(F.col("__n") * F.lit(float(fraction))))).drop("__at", "__n", "__h")


def relation_split(edges: DataFrame, fraction: float, seed: int = 42, relation: str = "relation", keys: tuple[str, ...] = ("source", "target")) -> DataFrame:
    """``train``: per relation all but round(n * (1 - (1 - fraction))) rows, half to even in
    doubles (25 at 0.1: 2.4999999999999996, 2), at least one on each side; a single edge trains."""
    n = edges.groupBy(relation).agg(F.count("*").alias("__n"))
    held = F.when(F.col("__n") == 1, 0).otherwise(F.least(F.col("__n") - 1, F.greatest(F.lit(1), F.rint(F.col("__n") * F.lit(1.0 - (1.0 - fraction))).cast("long"))))
    out = numbered_within(edges.withColumn("__h", order_key(seed, *keys)), [relation], [F.col("__h"), *map(F.col, keys)], "__at").join(n, relation)
    return out.withColumn("train", F.col("__at") >= held).drop("__at", "__n", "__h")


def remove_heldout(edges: DataFrame, held: DataFrame, inverse: str = "__INV") -> DataFrame:
    """edges without the held-out ones and their inverses."""
    back = held.select(F.col("target").alias("source"), F.concat("relation", F.lit(inverse)).alias("relation"), F.col("source").alias("target"))
    gone = held.select("source", "relation", "target").unionByName(back)
    return edges.join(gone, ["source", "relation", "target"], "left_anti")


def negative_samples(positives: DataFrame, pools: DataFrame, known: DataFrame, attempts: int = 10, seed: int = 42) -> DataFrame:
    """one corrupted edge per positive: the source or target replaced within its type, the
    first of ``attempts`` draws that isn't a known edge.

    ``positives(source, relation, target, source_type, target_type)``, ``pools(type, at, id)``
    with ``at`` 0.. per type. Draw a: a hash of seed, edge and a picks the side (last bit) and
    the place in the pool. A positive without a free draw takes, of all its free edges, the
    first by hash; where both sides have none, ``neg_source`` and ``neg_target`` are null.
    """
    pools = written(pools.select("type", "at", "id"), "negative-pools")
    sizes = pools.groupBy("type").agg(F.count("*").alias("size"))
    edge = ["source", "relation", "target"]
    new = lambda side, kept: [*edge, *kept, F.when(side == 0, F.col("id")).otherwise(F.col("source")).alias("neg_source"), F.when(side == 1, F.col("id")).otherwise(F.col("target")).alias("neg_target")]
    k = known.select(F.col("source").alias("neg_source"), "relation", F.col("target").alias("neg_target"))
    first = lambda rows, by: rows.join(k, ["neg_source", "relation", "neg_target"], "left_anti").groupBy(*edge).agg(F.min_by(F.struct("neg_source", "neg_target"), by).alias("n"))

    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "source", "relation", "target", "attempt")), 1, 12), 16, 10).cast("long")
    # Only edges whose earlier draws were all taken draw again, so no table has all attempts of all edges.
    taken = known.select(F.col("source").alias("neg_source"), "relation", F.col("target").alias("neg_target")).distinct().withColumn("taken", F.lit(True))
    waiting, drawn = positives.groupBy(*edge).agg(F.min(F.struct("source_type", "target_type")).alias("t")).select(*edge, "t.source_type", "t.target_type"), []
    for attempt in range(1, attempts + 1):
        draws = waiting.withColumn("attempt", F.lit(attempt)).withColumn("h", h)
        draws = draws.withColumn("side", F.col("h") % 2).withColumn("type", F.when(F.col("side") == 0, F.col("source_type")).otherwise(F.col("target_type")))
        draws = draws.join(F.broadcast(sizes), "type", "left").withColumn("at", F.floor(F.col("h") / 2).cast("long") % F.col("size")).join(pools, ["type", "at"], "left")
        tried = draws.select(*new(F.col("side"), ["source_type", "target_type", F.col("id").isNull().alias("none")]))
        tried = written(tried.join(taken, ["neg_source", "relation", "neg_target"], "left").withColumn("taken", F.col("none") | F.coalesce("taken", F.lit(False))), "negatives")
        drawn.append(tried.where("not taken").select(*edge, F.struct("neg_source", "neg_target").alias("n")))
        waiting = tried.where("taken").select(*edge, "source_type", "target_type")
        if waiting.isEmpty():
            break

    # The few without a free draw are held against their entire pools.
    sided = waiting.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("type", F.when(F.col("side") == 0, F.col("source_type")).otherwise(F.col("target_type")))
    every = sided.join(pools, "type").select(*new(F.col("side"), []))
    rest = first(every, F.struct(order_key(seed, *edge, "neg_source", "neg_target"), "neg_source", "neg_target"))
    found = reduce(DataFrame.unionByName, [*drawn, waiting.select(*edge).join(rest, edge, "left")])
    return found.select(*edge, "n.neg_source", "n.neg_target")


def capped_sample(edges: DataFrame, cap: int, seed: int, relation: str = "relation", keys: tuple[str, ...] = ("source", "target")) -> DataFrame:
    """at most ``cap`` rows of each relation, by hash order; the seed varies by epoch."""
    at = F.row_number().over(W.partitionBy(relation).orderBy(order_key(seed, *keys), *keys))
    return edges.withColumn("__at", at).where(F.col("__at") <= cap).drop("__at")


def compact_index(edges: DataFrame) -> DataFrame:
    """F8: the relations in use, numbered from 0 by name (as many rows as relations)."""
    return edges.select("relation").distinct().withColumn("relation_index", F.row_number().over(W.partitionBy().orderBy("relation")) - 1)


def type_pools(nodes: DataFrame) -> DataFrame:
    """F8: the nodes of each type, numbered from 0 by id."""
    return numbered_within(nodes.select(F.col("node_type").alias("type"), F.col("node_id").alias("id")), ["type"], [F.col("id")], "at").select("type", F.col("at").cast("long").alias("at"), "id")


def random_pairs(pairs: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n pairs without replacement, by hash order."""
    return pairs.orderBy(order_key(seed, "src", "dst"), "src", "dst").limit(n)


def head_per_class(df: DataFrame, cls: str, n: int, key: str) -> DataFrame:
    """the first n rows of each class by key."""
    return df.withColumn("__at", F.row_number().over(W.partitionBy(cls).orderBy(key))).where(F.col("__at") <= n).drop("__at")


def rank_bins(df: DataFrame, value: str, key: str, bins: int, by: list[str] | None = None) -> DataFrame:
    """``bin`` 0..bins-1 by rank, ties by key: floor(position * bins / n). Positions come
    from range partitions, so no window sees all rows."""
    by = by or []
    n = df.groupBy(*by).agg(F.count("*").alias("__n"))
    out = numbered_within(df, by, [F.col(value), F.col(key)], "__at")
    out = out.join(n, by) if by else out.crossJoin(F.broadcast(n))
    return out.withColumn("bin", F.floor(F.col("__at") * bins / F.col("__n")).cast("int")).drop("__at", "__n")


def matched_controls(pairs: DataFrame, degrees: DataFrame, known: DataFrame, bins: int = 10, seed: int = 42) -> DataFrame:
    """for each known (drug, side) pair a side of like degree that isn't known with the drug:
    ``drug, side, control, degree, control_degree``. Of the nearest bins with such a side the
    closest degree, and of its sides one by a hash of the pair; a drug that is known with all
    sides gives a null control.

    ``degrees(side, degree, bin)``. The search goes over counts: how many sides of a bin and
    degree a drug isn't known with is the number of such sides less the known ones, so no
    pair meets the sides themselves before its degrees are chosen.
    """
    level = ["bin", "degree"]
    levels = degrees.groupBy(*level).agg(F.count("*").alias("n"))
    seen = known.select("drug", "side").distinct()
    taken = seen.join(degrees, "side").groupBy("drug", *level).agg(F.count("*").alias("t"))
    left = written(pairs.select("drug", "side").distinct().join(degrees, "side").select("drug", *level).distinct(), "control-wanted")
    wanted, found = left, []
    for distance in range(bins):
        near = F.array(F.col("bin")) if distance == 0 else F.array(F.col("bin") - distance, F.col("bin") + distance)
        other = left.select("drug", *level, F.explode(near).alias("other_bin")).join(levels.select(F.col("bin").alias("other_bin"), F.col("degree").alias("other_degree"), "n"), "other_bin")
        free = other.join(taken.select("drug", F.col("bin").alias("other_bin"), F.col("degree").alias("other_degree"), "t"), ["drug", "other_bin", "other_degree"], "left")
        free = free.withColumn("free", F.col("n") - F.coalesce("t", F.lit(0))).where("free > 0").withColumn("gap", F.abs(F.col("degree") - F.col("other_degree")))
        best = free.groupBy("drug", *level).agg(F.min("gap").alias("gap"))
        found.append(written(free.join(best, ["drug", *level, "gap"]).select("drug", *level, "other_bin", "other_degree", "free"), "control-levels"))
        left = written(left.join(found[-1].select("drug", *level).distinct(), ["drug", *level], "left_anti"), "control-wanted")
        if left.isEmpty():
            break
    chosen = reduce(DataFrame.unionByName, found)
    # One of all free sides of a pair's levels, by a hash of the pair; then its place among a drug's free sides of the level.
    per = chosen.groupBy("drug", *level).agg(F.sort_array(F.collect_list(F.struct("other_bin", "other_degree", "free"))).alias("ls"), F.sum("free").alias("all"))
    h = F.conv(F.substring(order_key(seed, "drug", "side"), 1, 12), 16, 10).cast("long")
    picked = pairs.select("drug", "side").distinct().join(degrees, "side").join(per, ["drug", *level], "left").withColumn("r", h % F.col("all"))
    step = lambda acc, x: F.when(acc["at"] >= 0, F.when(acc["at"] < x["free"], F.struct((acc["at"] - x["free"]).alias("at"), x["other_bin"].alias("bin"), x["other_degree"].alias("degree"), acc["at"].alias("place"))).otherwise(F.struct((acc["at"] - x["free"]).alias("at"), acc["bin"], acc["degree"], acc["place"]))).otherwise(acc)
    start = F.struct(F.col("r").alias("at"), F.lit(None).cast("int").alias("bin"), F.lit(None).cast("long").alias("degree"), F.lit(None).cast("long").alias("place"))
    picked = picked.withColumn("c", F.aggregate("ls", start, step)).select("drug", "side", "degree", F.col("c.bin").alias("bin"), F.col("c.degree").alias("control_degree"), F.col("c.place").alias("place"))
    # The place-th side of the level that the drug isn't known with: of the known ones in order,
    # the i-th has its own place less i free sides before it; those with at most ``place`` are skipped.
    at = written(numbered_within(degrees.select("side", *level), level, [F.col("side")], "nth"), "control-places")
    gaps = seen.join(at, "side").groupBy("drug", "bin", F.col("degree").alias("control_degree")).agg(F.transform(F.sort_array(F.collect_list("nth")), lambda p, i: p - i).alias("gaps"))
    chosen = picked.where("place is not null").join(gaps, ["drug", "bin", "control_degree"], "left")
    half = lambda s: F.floor((s["lo"] + s["hi"]) / 2).cast("int")
    low = lambda s: F.get("gaps", half(s)) <= F.col("place")
    cut = lambda s, _: F.when(s["lo"] >= s["hi"], s).otherwise(F.struct(F.when(low(s), half(s) + 1).otherwise(s["lo"]).alias("lo"), F.when(low(s), s["hi"]).otherwise(half(s)).alias("hi")))
    skipped = F.aggregate(F.sequence(F.lit(1), F.lit(32)), F.struct(F.lit(0).alias("lo"), F.coalesce(F.size("gaps"), F.lit(0)).alias("hi")), cut, lambda s: s["lo"])
    chosen = chosen.withColumn("nth", F.col("place") + skipped).join(at.select("bin", F.col("degree").alias("control_degree"), "nth", F.col("side").alias("control")), ["bin", "control_degree", "nth"])
    return picked.select("drug", "side", "degree").join(chosen.select("drug", "side", "control", "control_degree"), ["drug", "side"], "left").select("drug", "side", "control", "degree", "control_degree")
