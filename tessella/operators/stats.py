"""Correlations, distributions, tests and pair evidence (I)."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.operators.blocked import cosine_summary, nearest_by_cosine  # noqa: F401  I8 of cosines, without their pairs
from tessella.operators.meetings import pair_values
from tessella.operators.rewire import neighbor_jaccard
from tessella.operators.sampling import random_pairs
from tessella.operators.similarity import jaccard, set_layer, top_k
from tessella.sources.scratch import numbered_within, written


def finite(*cols: str) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    return out


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row ``n, r`` over the finite pairs; a variance of zero gives null. Merged partial
    deviations of one value only may be above 0 by round-off, so the extremes decide."""
    varies = lambda c: F.coalesce(F.min(c) < F.max(c), F.lit(False))
    ok = df.where(finite(x, y)).agg(F.count("*").alias("n"), F.covar_pop(x, y).alias("c"), F.stddev_pop(x).alias("sx"), F.stddev_pop(y).alias("sy"), (varies(x) & varies(y)).alias("vary"))
    return ok.select("n", F.when(F.col("vary") & (F.col("sx") > 0) & (F.col("sy") > 0), F.col("c") / (F.col("sx") * F.col("sy"))).alias("r"))


def avg_rank(df: DataFrame, x: str, out: str = "rank", by: list[str] | None = None, few: bool = False) -> DataFrame:
    """Average ranks, ties sharing theirs. Ranks come from the counts of the distinct values
    and their running sum over range partitions, joined back, so no window sees all rows. With
    ``few`` distinct values (rounded to six decimals, say) the rows themselves aren't shuffled."""
    by = by or []
    n = numbered_within(df.groupBy(*by, x).agg(F.count("*").alias("__n")), by, [F.col(x)], "__before", F.col("__n"))
    ranks = n.select(*by, x, (F.col("__before") + (F.col("__n") + 1) / 2).alias(out))
    return df.join(F.broadcast(ranks) if few else ranks, [*by, x])


def spearman(df: DataFrame, x: str, y: str, few: bool = False) -> DataFrame:
    """Pearson of the average ranks."""
    ok = df.where(finite(x, y)).select(x, y)
    return pearson(avg_rank(avg_rank(ok, x, "rx", few=few), y, "ry", few=few), "rx", "ry")


def quantiles(df: DataFrame, x: str, ps: tuple[float, ...], by: list[str] | None = None, times: str | None = None) -> DataFrame:
    """I8, I16: ``*by, q`` (an array in the order of ``ps``): exact quantiles of each group,
    interpolated between neighbours. Places come from the counts of the distinct values, summed
    up over range partitions; only the rows at the wanted places go on, so no task holds a
    group. ``x`` is finite; a row counts ``times`` (a column), if given."""
    by = by or []
    counts = written(df.groupBy(*by, x).agg((F.count("*") if times is None else F.sum(times)).alias("__n")), "value-counts")
    at = numbered_within(counts, by, [F.col(x)], "__before", F.col("__n"))
    total = counts.groupBy(*by).agg(F.sum("__n").alias("__all"))
    same = reduce(lambda a, b: a & b, (F.col(g).eqNullSafe(F.col(f"__g_{g}")) for g in by), F.lit(True))
    at = at.join(total.withColumnsRenamed({g: f"__g_{g}" for g in by}), same)
    place = [F.lit(p) * (F.col("__all") - 1) for p in ps]
    holds = lambda q: (F.col("__before") <= q) & (q < F.col("__before") + F.col("__n"))
    ends = [(holds(F.floor(q)), holds(F.ceil(q))) for q in place]
    near = at.where(reduce(lambda a, b: a | b, (h for pair in ends for h in pair)))
    own = lambda h: F.max(F.when(h, F.col(x).cast("double")))
    found = near.groupBy(*by).agg(F.max("__all").alias("__all"), *[own(h).alias(f"__{i}{side}") for i, pair in enumerate(ends) for side, h in zip("lh", pair)])
    value = [F.col(f"__{i}l") + (q - F.floor(q)) * (F.col(f"__{i}h") - F.col(f"__{i}l")) for i, q in enumerate(place)]
    return found.select(*by, F.array(*value).alias("q"))


def distribution(df: DataFrame, x: str, thresholds: tuple[float, ...] = (0.5, 0.8, 0.9, 0.95, 0.99), times: str | None = None) -> DataFrame:
    """I8: mean, population deviation, extremes, exact percentiles, share at each threshold. Only
    distinct values and how often they occur (the sum of ``times``, if given) are kept."""
    ps = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
    ok = written(df.where(finite(x)).groupBy(x).agg((F.count("*") if times is None else F.sum(times)).alias("__times")), "distribution")
    v, m, n = F.col(x).cast("double"), F.col("__times"), F.col("n").cast("double")
    d = ok.agg(F.coalesce(F.sum(m), F.lit(0)).alias("n"), F.sum(v * m).alias("total"), F.min(x).alias("min"), F.max(x).alias("max"), *[F.sum(F.when(F.col(x) >= t, m).otherwise(0)).alias(f"ge_{int(t * 100)}") for t in thresholds])
    mean = written(d.withColumn("mean", F.try_divide("total", n)), "distribution-mean")
    spread = ok.crossJoin(F.broadcast(mean.select("mean"))).agg(F.sum(m * (v - F.col("mean")) * (v - F.col("mean"))).alias("squares"))
    d = mean.crossJoin(spread).crossJoin(quantiles(ok, x, ps, times="__times").agg(F.max("q").alias("p")))  # one row each
    return d.select("n", "mean", F.sqrt(F.try_divide("squares", n)).alias("std"), "min", "max", *[F.get("p", F.lit(i)).alias(f"p{int(p * 100)}") for i, p in enumerate(ps)], *[F.try_divide(F.col(f"ge_{int(t * 100)}").cast("double"), n).alias(f"ge_{int(t * 100)}") for t in thresholds])


def task_alignment(view: DataFrame, task: DataFrame, observed: DataFrame, pairs: int = 10_000, seed: int = 42) -> DataFrame:
    """I4: how a view (mirrored ``src, dst, value``) follows the task similarity, over the nodes
    ``observed(id)`` that have observations: how many they are, the pairs that both hold, their
    correlation, the mean task similarity of the 5 and 10 nearest among them, of ``pairs`` pairs
    drawn from those that both hold (all, if fewer), and the enrichment of 10 over the draw.
    Task values that are missing count for nothing."""
    nodes = observed.select("id").distinct()
    inside = view.join(nodes.withColumnRenamed("id", "src"), "src", "left_semi").join(nodes.withColumnRenamed("id", "dst"), "dst", "left_semi")
    t = task.where(finite("value")).select("src", "dst", F.col("value").alias("t"))
    both = written(inside.where("src < dst").join(t, ["src", "dst"]).select("src", "dst", "value", "t"), "aligned-pairs")
    near = top_k(inside, 10).join(t, ["src", "dst"])
    return nodes.agg(F.count("*").alias("entity_count")).crossJoin(alignment(both, near, pairs, seed))  # one row each


def alignment(both: DataFrame, near: DataFrame, pairs: int = 10_000, seed: int = 42) -> DataFrame:
    """I4: the figures of ``task_alignment`` but the nodes, from the pairs that a view and the task
    both hold, each once (``src, dst, value, t``), and the view's nearest (``rank, t``)."""
    r = pearson(both, "value", "t").select(F.col("n").alias("pair_count"), F.col("r").alias("correlation"))
    n = near.agg(F.avg(F.when(F.col("rank") <= 5, F.col("t"))).alias("top5"), F.avg("t").alias("top10"))
    drawn = random_pairs(both.where(finite("value")), pairs, seed).agg(F.avg("t").alias("random"))
    return r.crossJoin(n).crossJoin(drawn).withColumn("enrichment", F.col("top10") - F.col("random"))  # one row each


def redundancy_class(coverage: Column, pearson: Column, spearman: Column, jaccard_5: Column, jaccard_10: Column) -> Column:
    """How much a view repeats the graph's, by coverage, both correlations and the overlap of
    the nearest 5 and 10; a figure that is missing or not finite is no evidence."""
    known = F.lit(True)
    for c in (pearson, spearman, jaccard_5, jaccard_10):
        known = known & F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    unrelated = (F.abs(pearson) < 0.05) & (F.abs(spearman) < 0.05) & (jaccard_10 < 0.03)
    return (
        F.when((coverage < 0.10) | ~known, "INSUFFICIENT_COVERAGE").when((spearman >= 0.70) & (jaccard_10 >= 0.50), "HIGHLY_REDUNDANT_WITH_KG")
        .when((spearman >= 0.30) & (jaccard_10 >= 0.20), "MODERATELY_RELATED").when(unrelated, "EFFECTIVELY_UNRELATED").otherwise("COMPLEMENTARY")
    )


def kg_diagnostics(view: DataFrame, kg: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: ``coverage, n, pearson, spearman, jaccard_5, jaccard_10, complementarity`` of
    a view against the graph's, over the nodes ``nodes(id)`` that the graph's view holds and the
    pairs that both hold. Both are mirrored (src, dst, value)."""
    held = nodes.join(kg.select(F.col("src").alias("id")).distinct(), "id", "left_semi")
    inside = view.join(held.withColumnRenamed("id", "src"), "src", "left_semi").join(held.withColumnRenamed("id", "dst"), "dst", "left_semi")
    pairs = inside.where("src < dst and value is not null").join(kg.select("src", "dst", F.col("value").alias("other")), ["src", "dst"])
    return redundancy(pairs, top_k(inside, 10), top_k(kg, 10), held, nodes)


def redundancy(pairs: DataFrame, near: DataFrame, kg_near: DataFrame, held: DataFrame, nodes: DataFrame, few: bool = False) -> DataFrame:
    """The figures of ``kg_diagnostics`` from the pairs that a view and the graph's both hold,
    each once (``value, other``), the ten nearest of both, and the nodes that the graph's holds."""
    out = pearson(pairs, "value", "other").select("n", F.col("r").alias("pearson")).crossJoin(spearman(pairs, "value", "other", few).select(F.col("r").alias("spearman")))
    for k in (5, 10):
        out = out.crossJoin(neighbor_jaccard(near.where(F.col("rank") <= k), kg_near.where(F.col("rank") <= k), held).withColumnRenamed("mean_jaccard", f"jaccard_{k}"))
    share = nodes.agg(F.count("*").alias("all")).crossJoin(held.agg(F.count("*").alias("held"))).select((F.col("held") / F.col("all")).alias("coverage"))
    figures = ("pearson", "spearman", "jaccard_5", "jaccard_10")
    return share.crossJoin(out).withColumn("complementarity", redundancy_class(F.col("coverage"), *map(F.col, figures)))


def leakage_fields(provenance: Column) -> Column:
    """How a view of a provenance stands to the labels: external ones hold none, others are
    rebuilt from the training cells."""
    external = provenance == "EXTERNAL_STATIC"
    hidden = F.when(external, "NOT_APPLICABLE").otherwise("True")
    return F.struct(
        F.when(external, "SAFE_EXTERNAL").otherwise("SAFE_TRAIN_ONLY").alias("leakage_status"), hidden.alias("test_edges_hidden"), hidden.alias("validation_edges_hidden"),
        (~external).alias("recomputed_from_training_only"), F.when(external, "EXTERNAL").otherwise("LABEL_DERIVED").alias("external_or_label_derived"),
    )


def rewiring_decision(df: DataFrame) -> DataFrame:
    """``priority, mode`` of a view from ``provenance, leakage_status, correlation,
    enrichment, complementarity``. Views made of labels, or not known to be safe, stay as they
    are; room above the task (|correlation| under 0.35, enrichment under 0.15) and
    complementary evidence make a candidate."""
    ok = lambda c: F.coalesce(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.lit(False))
    r, kind = F.abs(F.col("correlation")), F.col("complementarity")
    room = ok("correlation") & ok("enrichment") & (r < 0.35) & (F.col("enrichment") < 0.15) & (kind == "COMPLEMENTARY")
    priority = (
        F.when(F.col("provenance").isin("LABEL_DERIVED", "HYBRID") | (F.col("leakage_status") != "SAFE_EXTERNAL"), "DO_NOT_REWIRE")
        .when(room, "HIGH_PRIORITY_REWIRING_CANDIDATE").when(kind.isin("COMPLEMENTARY", "MODERATELY_RELATED"), "MEDIUM_PRIORITY")
        .when((kind == "HIGHLY_REDUNDANT_WITH_KG") | (ok("correlation") & (r >= 0.50)), "LOW_PRIORITY").otherwise("NEEDS_MORE_EVIDENCE")
    )
    p = F.col("priority")
    mode = F.when(p == "DO_NOT_REWIRE", "DO_NOT_MODIFY").when(p == "HIGH_PRIORITY_REWIRING_CANDIDATE", "ADD_EDGES_WITH_KG_SUPPORT").when(p == "NEEDS_MORE_EVIDENCE", "NEEDS_REVIEW").otherwise("KEEP_MATRIX_BUILD_TASK_ADJACENCY")
    return df.withColumn("priority", priority).withColumn("mode", mode)


def rank_candidates(audit: DataFrame) -> DataFrame:
    """The safe external views that may be rewired, with ``score`` and ``rank``: points for
    the priority (4 to 1), a quarter of the task's headroom, 0.15 of the enrichment's, 0.1 of
    what the graph doesn't repeat, 0.05 for drug views; ties to drug views, then by
    ``view_index``. The audit has one row per view."""
    ok = lambda c: F.coalesce(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.lit(False))
    left = lambda c, x: F.when(ok(c), 1 - F.least(F.lit(1.0), x)).otherwise(0.0)
    p = F.col("priority")
    points = F.when(p == "HIGH_PRIORITY_REWIRING_CANDIDATE", 4.0).when(p == "MEDIUM_PRIORITY", 3.0).when(p == "LOW_PRIORITY", 2.0).when(p == "NEEDS_MORE_EVIDENCE", 1.0).otherwise(0.0)
    drug = F.col("entity_type") == "DRUG"
    score = (
        points + 0.25 * left("correlation", F.abs(F.col("correlation"))) + 0.15 * left("enrichment", F.greatest(F.lit(0.0), F.col("enrichment")))
        + 0.10 * left("jaccard_10", F.col("jaccard_10")) + F.when(drug, 0.05).otherwise(0.0)
    )
    safe = audit.where((F.col("provenance") == "EXTERNAL_STATIC") & (F.col("leakage_status") == "SAFE_EXTERNAL") & (p != "DO_NOT_REWIRE"))
    return safe.withColumn("score", score).withColumn("rank", F.row_number().over(W.partitionBy().orderBy(F.col("score").desc(), ~drug, "view_index")))


def distinguishability(added: DataFrame, everything: DataFrame, top20: DataFrame) -> DataFrame:
    """One row: whether a cohort's similarities can be told from all pairs' and from those of
    the 20 nearest. Each is one row of ``distribution`` (``mean, std, ge_99`` and ``p50``). Close
    means a mean within 0.10 deviations, a median within 0.01 and a share at 0.99 or more
    within 0.05; without a spread nothing is close."""

    def named(df: DataFrame, name: str) -> DataFrame:
        return df.select(*[F.col(c).alias(f"{name}_{c}") for c in ("mean", "std", "p50", "ge_99")])

    j = named(added, "a").crossJoin(named(everything, "g")).crossJoin(named(top20, "t"))
    gap = lambda n: F.when(F.col(f"{n}_std") > 0, (F.col("a_mean") - F.col(f"{n}_mean")) / F.col(f"{n}_std"))
    near = lambda n: F.coalesce((F.abs(gap(n)) < 0.10) & (F.abs(F.col("a_p50") - F.col(f"{n}_p50")) < 0.01) & (F.abs(F.col("a_ge_99") - F.col(f"{n}_ge_99")) < 0.05), F.lit(False))
    verdict = (
        F.when(near("g"), "NOT_DISTINGUISHABLE_FROM_GLOBAL_COSINE_DISTRIBUTION").when(near("t"), "DISTINGUISHABLE_FROM_GLOBAL_BUT_NOT_FROM_TOP20_NEIGHBORS")
        .when(F.abs(gap("g")) < 0.25, "WEAKLY_DISTINGUISHABLE_FROM_GLOBAL_COSINE_DISTRIBUTION").otherwise("DISTINGUISHABLE_FROM_GLOBAL_COSINE_DISTRIBUTION")
    )
    return j.select(
        (F.col("a_mean") - F.col("g_mean")).alias("mean_delta_all"), (F.col("a_p50") - F.col("g_p50")).alias("median_delta_all"), gap("g").alias("gap_all"),
        (F.col("a_mean") - F.col("t_mean")).alias("mean_delta_top20"), (F.col("a_p50") - F.col("t_p50")).alias("median_delta_top20"), gap("t").alias("gap_top20"), verdict.alias("verdict"),
    )


def _rounded_key(vec: str, decimals: int) -> Column:
    """A digest of the values, rounded half to even."""
    values = F.transform(vec, lambda x: (F.bround(x.cast("double"), decimals) + F.lit(0.0)).cast("string"))
    return F.sha2(F.array_join(values, ",", "null"), 256)


def duplicate_groups(df: DataFrame, decimals: int, id_col: str = "id", vec: str = "vec") -> DataFrame:
    """Vectors equal after rounding half to even: ``id, group, size`` of the members of
    groups of two or more, a group named by its smallest id."""
    keyed = df.select(F.col(id_col).alias("id"), _rounded_key(vec, decimals).alias("key"))
    groups = keyed.groupBy("key").agg(F.min("id").alias("group"), F.count("*").alias("size")).where("size > 1")
    return keyed.join(groups, "key").select("id", "group", "size")


def duplicate_summary(df: DataFrame, decimals: tuple[int, ...] = (6, 4, 3), id_col: str = "id", vec: str = "vec") -> DataFrame:
    """For each precision: groups of equal vectors, their members, the largest, distinct
    vectors and all."""
    rows = []
    for d in decimals:
        g = df.groupBy(_rounded_key(vec, d).alias("key")).agg(F.count("*").alias("n"))
        rows.append(g.agg(F.lit(d).alias("decimals"), F.count_if(F.col("n") > 1).alias("groups"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("members"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"), F.count("*").alias("distinct"), F.coalesce(F.sum("n"), F.lit(0)).alias("all")))
    return reduce(DataFrame.unionByName, rows)


#: The largest dimension whose triangular factor ``spectrum`` brings to the driver; factors that
#: one task merges; the deviation up to which a dimension has hardly any.
MOST_DIMENSIONS, MERGED, NEAR_ZERO = 4096, 8, 1e-6


def _factor(x: np.ndarray) -> np.ndarray:
    return np.linalg.qr(x, mode="r") if len(x) else x


def triangular_factor(df: DataFrame, mean: np.ndarray, vec: str = "vec") -> np.ndarray:
    """The R of a QR decomposition of the vectors less ``mean``: every task reduces its rows
    to a factor of dimension squared at most, and factors merge a few at a time, level by level."""
    d = len(mean)

    def reduce_rows(batches):
        r = np.zeros((0, d))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), d) - mean
            for at in range(0, len(x), 4 * d):
                r = _factor(np.concatenate([r, x[at : at + 4 * d]]))
        yield pa.RecordBatch.from_arrays([pa.array([r.ravel().tolist()], pa.list_(pa.float64()))], ["r"])

    def merge(rows: pa.Table) -> pa.Table:
        r = np.zeros((0, d))
        for x in rows["r"].combine_chunks():
            r = _factor(np.concatenate([r, np.asarray(x.values, float).reshape(-1, d)]))
        return pa.table({"task": pa.array([rows["into"][0].as_py()], pa.int32()), "r": pa.array([r.ravel().tolist()], pa.list_(pa.float64()))})

    rows = df.select(F.transform(vec, lambda x: x.cast("double")).alias("v"))
    parts = written(rows.mapInArrow(reduce_rows, "r array<double>").withColumn("task", F.spark_partition_id()), "qr-factors")
    while (most := parts.agg(F.max("task")).first()[0] or 0) > 0:
        parts = written(parts.withColumn("into", F.floor(F.col("task") / MERGED).cast("int")).groupBy("into").applyInArrow(merge, "task int, r array<double>"), "qr-factors")
        if most < MERGED:
            break
    found = parts.select("r").collect()
    return np.concatenate([np.zeros((0, d)), *[np.array(f.r).reshape(-1, d) for f in found]])


def spectrum(df: DataFrame, vec: str = "vec") -> DataFrame:
    """One row per component: ``component, singular_value, explained`` (share of variance),
    ``cumulative``, ``dimension_std`` (of the dimension of that number), and alike in all rows
    ``numerical_rank`` (singular values of the centred vectors above the largest times
    max(rows, dimensions) times the precision of doubles), ``effective_rank`` (exp of the entropy
    of the shares), ``near_zero_dimensions`` and ``norm_mean, norm_std, norm_min, norm_max``.

    Two passes: the means, then triangular factors of the centred vectors. One factor reaches
    the driver: dimension squared, for ``MOST_DIMENSIONS`` at most.
    """
    d = df.agg(F.max(F.size(vec))).first()[0] or 0
    if d > MOST_DIMENSIONS:
        raise ValueError(f"vectors of more than {MOST_DIMENSIONS} dimensions")
    norm = F.sqrt(F.aggregate(F.transform(vec, lambda x: x.cast("double")), F.lit(0.0), lambda s, x: s + x * x))
    norms = df.agg(F.count("*").alias("n"), F.avg(norm).alias("norm_mean"), F.stddev_pop(norm).alias("norm_std"), F.min(norm).alias("norm_min"), F.max(norm).alias("norm_max"))
    means = {r.pos: r.x for r in df.select(F.posexplode(F.transform(vec, lambda x: x.cast("double"))).alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("x")).collect()}
    n = norms.first().n
    r = triangular_factor(df, np.array([means[i] for i in range(d)]), vec) if d else np.zeros((0, 0))
    single = np.zeros(d)
    own = np.linalg.svd(r, compute_uv=False) if d else single
    single[: len(own)] = own[:d]
    std = np.sqrt((r * r).sum(0) / n) if d else single
    energy = single**2
    share = energy / energy.sum() if energy.sum() > 0 else energy
    numerical = int((single > single[0] * max(n, d) * np.finfo(float).eps).sum()) if d and single[0] > 0 else 0
    rank = float(np.exp(-sum(p * math.log(p) for p in share if p > 0))) if d else 0.0
    near_zero = int((std <= NEAR_ZERO).sum())
    rows = [(i, float(x), float(p), float(c), float(v), numerical, rank, near_zero) for i, (x, p, c, v) in enumerate(zip(single, share, np.cumsum(share), std, strict=True))]
    kind = "component int, singular_value double, explained double, cumulative double, dimension_std double, numerical_rank int, effective_rank double, near_zero_dimensions int"
    return df.sparkSession.createDataFrame(rows, kind).crossJoin(F.broadcast(norms.drop("n")))


def collapse_diagnosis(pairs: DataFrame, effective_rank: Column, dimension: int, duplicates: DataFrame, weak_margin: Column) -> DataFrame:
    """One row: flags and a class from a distribution of pair cosines (``distribution``:
    ``p50, ge_95, ge_99``), the effective rank, the duplicates at three decimals
    (``largest, distinct, all``, one row) and whether nearest neighbours stand out too little.

    Two of four strong signs (most pairs at 0.99 or more, an effective rank under a tenth of the
    dimension, a duplicate group of 10 or under three quarters distinct, weak margins) make a
    collapse; a median over 0.90 or most pairs at 0.95 a compression.
    """
    groups = (F.col("largest") >= 10) | (F.col("distinct") < 0.75 * F.col("all"))
    signs = {"most_at_99": F.col("ge_99") > 0.50, "low_rank": effective_rank < 0.10 * dimension, "large_groups": groups, "weak_margin": weak_margin}
    flagged = pairs.crossJoin(duplicates).withColumns(signs)
    strong = sum((F.col(c).cast("int") for c in signs), F.lit(0))
    compressed = (F.col("p50") > 0.90) | (F.col("ge_95") > 0.50)
    healthy = (F.col("p50") < 0.75) & (F.col("ge_95") < 0.10) & (effective_rank >= 0.25 * dimension) & ~F.col("large_groups")
    verdict = F.when(strong >= 2, "STRONG_REPRESENTATION_COLLAPSE").when(compressed, "HIGH_SIMILARITY_COMPRESSION").when(healthy, "HEALTHY_DISCRIMINATION").otherwise("INCONCLUSIVE")
    return flagged.select(*signs, strong.alias("strong"), compressed.alias("compressed"), verdict.alias("verdict"))


def collapse_advice(verdict: Column, explicit_signal: Column) -> Column:
    """What to do, given whether explicit overlap tells added edges from random pairs."""
    bad = verdict.isin("STRONG_REPRESENTATION_COLLAPSE", "HIGH_SIMILARITY_COMPRESSION")
    return (
        F.when(verdict == "HEALTHY_DISCRIMINATION", "KEEP_KG_EMBEDDING_COSINE_FOR_REWIRING").when(bad & explicit_signal, "REPLACE_EMBEDDING_COSINE_WITH_EXPLICIT_KG_STRUCTURE")
        .when(verdict == "STRONG_REPRESENTATION_COLLAPSE", "RETRAIN_KG_ENCODER_WITH_MORE_DISCRIMINATIVE_NODE_FEATURES").otherwise("NEEDS_MORE_EVIDENCE")
    )


def pair_support(pairs: DataFrame, genes: DataFrame, pathways: DataFrame) -> DataFrame:
    """Of each pair ``(cohort, src, dst)`` (rows that repeat count again) the sizes of both
    sides' sets ``(owner, item)``, what they share, and the Jaccard (0 without any)."""
    out = pairs.select("cohort", "src", "dst")
    layers = {name: set_layer(sets, None) for name, sets in (("gene", genes), ("pathway", pathways))}
    both = pair_values(layers, out.select("src", "dst")).select("src", "dst", *[F.col(f"{name}_shared").alias(f"shared_{name}_count") for name in layers])
    out = out.join(both, ["src", "dst"], "left")
    for name, layer in layers.items():
        n = written(layer.cells.groupBy(F.col("id").alias("owner")).agg(F.count("*").alias("n")), "set-sizes")
        out = out.join(n.toDF("src", f"source_{name}_count"), "src", "left").join(n.toDF("dst", f"target_{name}_count"), "dst", "left").fillna(0)
        out = out.withColumn(f"{name}_jaccard", jaccard(*map(F.col, (f"shared_{name}_count", f"source_{name}_count", f"target_{name}_count")), 0.0))
    return out


def support_summary(support: DataFrame) -> DataFrame:
    """By cohort: pairs, and for genes and pathways the mean shared number, the share of
    pairs with one, and the mean Jaccard."""
    each = [x for n in ("gene", "pathway") for x in (F.avg(f"shared_{n}_count").alias(f"mean_shared_{n}_count"), F.avg((F.col(f"shared_{n}_count") > 0).cast("int")).alias(f"fraction_with_shared_{n}"), F.avg(f"{n}_jaccard").alias(f"mean_{n}_jaccard"))]
    return support.groupBy("cohort").agg(F.count("*").alias("pair_count"), *each)


def explicit_signal(added: DataFrame, random: DataFrame) -> DataFrame:
    """One row: whether added pairs share more than random ones: 0.01 more mean Jaccard, or
    0.05 more pairs with something shared, of genes or pathways. Both are one row of
    ``support_summary``; without one there is no signal."""
    gaps = {"mean_gene_jaccard": 0.01, "mean_pathway_jaccard": 0.01, "fraction_with_shared_gene": 0.05, "fraction_with_shared_pathway": 0.05}
    j = added.agg(*[F.max(c).alias(f"a_{c}") for c in gaps]).crossJoin(random.agg(*[F.max(c).alias(f"r_{c}") for c in gaps]))
    return j.select(reduce(lambda x, y: x | y, (F.coalesce(F.col(f"a_{c}") > F.col(f"r_{c}") + F.lit(gap), F.lit(False)) for c, gap in gaps.items())).alias("explicit_signal"))


# Relations of a typed biomedical graph that are evidence, families and markers.
DRUG_GENE_RELATIONS = (
    "TARGET", "ENZYME", "TRANSPORTER", "INHIBITOR", "CARRIER", "AGONIST", "ANTAGONIST", "BLOCKER", "POSITIVE_ALLOSTERIC_MODULATOR", "NEGATIVE_ALLOSTERIC_MODULATOR",
    "POSITIVE_MODULATOR", "MODULATOR", "PARTIAL_AGONIST", "OPENER", "ACTIVATOR", "INVERSE_AGONIST",
)
FAMILIES = (("Drug-Gene", "DRUG", DRUG_GENE_RELATIONS), ("Gene-Gene", "GENE", ("INTERACTS_WITH",)), ("Pathway-Gene", "PATHWAY", ("INTERACTS_WITH",)), ("Phenotype-Gene", "PHENOTYPE", ("ASSOCIATED_WITH",)))
FORBIDDEN_RELATION_MARKERS = ("ADVERSE_DRUG_REACTION", "DRUG_PHENOTYPE", "SIDE_EFFECT")
IDENTITY = (("MAPS_TO_DRUG", "DRUG_ANCHOR", "DRUG"), ("MAPS_TO_PHENOTYPE", "SIDE_ANCHOR", "PHENOTYPE"))


def typed_kg(edges: DataFrame, identity: tuple[tuple[str, str, str], ...] = IDENTITY) -> tuple[DataFrame, dict[str, int]]:
    """``family, a, b, owner, gene`` of the whitelisted edges, undirected and once each
    (owner is the end that isn't the gene, or a), the identity links (family = their relation,
    owner the anchor, gene the node), and counts: what was seen in each way.

    The table is scanned once: counts are observed beside the rows that go on. A forbidden
    marker in a relation's name excludes an edge whatever its types.
    """
    kinds, rel = F.array_sort(F.array("source_type", "target_type")), F.col("relation")
    forbidden = reduce(lambda x, y: x | y, (F.contains(F.upper(rel), F.lit(m)) for m in FORBIDDEN_RELATION_MARKERS))
    link, family = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r, s, t in identity:
        link = F.coalesce(link, F.when((rel == r) & (F.col("source_type") == s) & (F.col("target_type") == t), r))
    for name, other, relations in FAMILIES:
        family = F.coalesce(family, F.when((kinds == F.array_sort(F.array(F.lit(other), F.lit("GENE")))) & rel.isin(*relations), name))
    e = edges.select("source", "target", "relation", "source_type", "target_type", F.coalesce(forbidden, F.lit(False)).alias("forbidden"))
    e = e.withColumn("link", F.when(~F.col("forbidden"), link)).withColumn("family", F.when(~F.col("forbidden") & F.col("link").isNull(), family))
    seen = Observation()
    e = e.observe(seen, F.count("*").alias("edges"), F.count_if("forbidden").alias("forbidden"), F.count("link").alias("identity"), F.count("family").alias("evidence"))
    anchored, gene_first = F.col("link").isNotNull(), (F.col("source_type") == "GENE") & (F.col("target_type") != "GENE")
    low, high = F.least("source", "target"), F.greatest("source", "target")
    loose = F.coalesce("link", "family").alias("family")
    owner = F.when(anchored, F.col("source")).when(gene_first, F.col("target")).when(F.col("family") == "Gene-Gene", low).otherwise(F.col("source"))
    gene = F.when(anchored, F.col("target")).when(gene_first, F.col("source")).when(F.col("family") == "Gene-Gene", high).otherwise(F.col("target"))
    kept = e.where("link is not null or family is not null").select(loose, F.when(anchored, F.col("source")).otherwise(low).alias("a"), F.when(anchored, F.col("target")).otherwise(high).alias("b"), F.struct(owner.alias("owner"), gene.alias("gene")).alias("ends"))
    kept = written(kept.groupBy("family", "a", "b").agg(F.min("ends").alias("ends")).select("family", "a", "b", "ends.owner", "ends.gene"), "typed-edges")
    counts = {k: int(v) for k, v in seen.get.items()}
    distinct = kept.where(F.col("family").isin(*[f[0] for f in FAMILIES])).count()
    counts |= {"ignored": counts["edges"] - counts["forbidden"] - counts["identity"] - counts["evidence"], "duplicates": counts["evidence"] - distinct}
    return kept, counts


def anchored_sets(kg: DataFrame) -> dict[str, DataFrame]:
    """From ``typed_kg``: ``drug_genes(drug, item)``, ``side_genes(side, item)``,
    ``drug_pathways``, ``side_pathways``, all distinct, and ``gene_gene(a, b)``."""
    family = lambda f: kg.where(F.col("family") == f)
    own = lambda link, f, name: family(link).select(F.col("owner").alias(name), F.col("gene").alias("node")).join(family(f).select(F.col("owner").alias("node"), "gene"), "node").select(name, F.col("gene").alias("item")).distinct()
    way = family("Pathway-Gene").select(F.col("gene").alias("item"), F.col("owner").alias("pathway"))
    out = {"drug_genes": written(own("MAPS_TO_DRUG", "Drug-Gene", "drug"), "drug-genes"), "side_genes": written(own("MAPS_TO_PHENOTYPE", "Phenotype-Gene", "side"), "side-genes"), "gene_gene": family("Gene-Gene").select("a", "b")}
    for side in ("drug", "side"):
        out[f"{side}_pathways"] = written(out[f"{side}_genes"].join(way, "item").select(side, F.col("pathway").alias("item")).distinct(), f"{side}-pathways")
    return out


#: Neighbours up to which a gene is expanded from the drugs that have it, at the least.
LIGHT = 1000

# The columns of pair evidence, in their order.
FEATURE_COLUMNS = (
    "drug_kg_available", "side_kg_available", "both_kg_available", "drug_gene_count", "side_gene_count", "shared_gene_count", "gene_jaccard", "gene_overlap_coeff", "shared_gene_weighted", "ppi_bridge_count",
    "ppi_bridge_norm", "ppi_path_exists", "drug_pathway_count", "side_pathway_count", "shared_pathway_count", "pathway_jaccard", "pathway_overlap_coeff", "pathway_path_exists", "direct_gene_path_exists", "min_bio_hops",
)


def _bridges(p: DataFrame, dg: DataFrame, with_side: DataFrame, both: DataFrame, degree: DataFrame, edges: int) -> DataFrame:
    """``drug, side, x, y``: the edges between a gene of the drug and another of the side.

    Genes of up to max(LIGHT, sqrt(2 edges)) neighbours are expanded from the drug's side. Of
    heavier ones there are few (2 edges / that), so a side's gene has few heavy neighbours:
    those are looked up among the drug's genes, and no hub is ever expanded.
    """
    most = max(LIGHT, math.isqrt(2 * edges))
    heavy = degree.where(F.col("degree") > most).select(F.col("gene").alias("a"))
    ends = [F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")]
    light = dg.withColumnRenamed("item", "a").join(both.join(heavy, "a", "left_anti"), "a").join(with_side.withColumnRenamed("item", "b"), ["drug", "b"]).select("drug", "side", *ends)
    hubs = both.join(heavy, "a", "left_semi").join(with_side.withColumnRenamed("item", "b"), "b").join(dg.withColumnRenamed("item", "a"), ["drug", "a"]).select("drug", "side", *ends)
    return light.unionByName(hubs).distinct()


def pair_evidence(pairs: DataFrame, sets: dict[str, DataFrame]) -> DataFrame:
    """The 20 columns of evidence of given pairs ``(drug, side)``, from ``anchored_sets``:
    availability, gene and pathway counts, shared ones, Jaccard and overlap (0 without any),
    the sum of 1 / ln(2 + degree) over the shared genes, distinct bridges over a gene-gene
    edge (an edge of a gene with itself is none) and their number over the root of the product
    of the set sizes, and the least hops: 2 by a gene, 3 by a bridge, 4 by a pathway, else 0."""
    p, dg, sg = pairs.select("drug", "side").distinct(), sets["drug_genes"], sets["side_genes"]
    canonical = sets["gene_gene"].select("a", "b").distinct()
    both = written(canonical.union(canonical.select("b", "a")).distinct(), "neighbours")
    degree = written(both.groupBy(F.col("a").alias("gene")).agg(F.count("*").alias("degree")), "gene-degrees")
    with_side = written(p.join(sg, "side"), "pairs-genes")
    shared = with_side.join(dg, ["drug", "item"]).join(degree.withColumnRenamed("gene", "item"), "item", "left")
    shared = shared.groupBy("drug", "side").agg(F.count("*").alias("shared_gene_count"), F.sum(1 / F.log(2.0 + F.coalesce("degree", F.lit(0)))).alias("shared_gene_weighted"))
    bridge = _bridges(p, dg, with_side, both.where("a <> b"), degree, canonical.count()).groupBy("drug", "side").agg(F.count("*").alias("ppi_bridge_count"))
    ways = p.join(sets["side_pathways"], "side").join(sets["drug_pathways"], ["drug", "item"]).groupBy("drug", "side").agg(F.count("*").alias("shared_pathway_count"))
    out = p
    for side in ("drug", "side"):
        for what in ("gene", "pathway"):
            out = out.join(sets[f"{side}_{what}s"].groupBy(side).agg(F.count("*").alias(f"{side}_{what}_count")), side, "left")
    for part in (shared, bridge, ways):
        out = out.join(part, ["drug", "side"], "left")
    out = out.fillna(0)
    c, yes = F.col, lambda x: (x > 0).cast("int")
    d, s = c("drug_gene_count"), c("side_gene_count")
    for what in ("gene", "pathway"):
        n, a, b = (c(f"{x}_{what}_count") for x in ("shared", "drug", "side"))
        out = out.withColumns({f"{what}_jaccard": jaccard(n, a, b, 0.0), f"{what}_overlap_coeff": F.when(F.least(a, b) > 0, n / F.least(a, b)).otherwise(0.0)})
    direct, ppi, way = c("shared_gene_count") > 0, c("ppi_bridge_count") > 0, c("shared_pathway_count") > 0
    out = out.withColumns(
        {
            "drug_kg_available": yes(d), "side_kg_available": yes(s), "both_kg_available": ((d > 0) & (s > 0)).cast("int"), "ppi_bridge_norm": F.when((d > 0) & (s > 0), c("ppi_bridge_count") / F.sqrt(d * s)).otherwise(0.0),
            "ppi_path_exists": ppi.cast("int"), "pathway_path_exists": way.cast("int"), "direct_gene_path_exists": direct.cast("int"), "min_bio_hops": F.when(direct, 2).when(ppi, 3).when(way, 4).otherwise(0),
        }
    )
    return out.select("drug", "side", *FEATURE_COLUMNS)


def class_summary(df: DataFrame, features: list[str], cls: str = "class") -> DataFrame:
    """I16: per feature and class: count, mean, median, sample deviation (0 for one row),
    quartiles and their distance, of the finite values."""
    long = df.select(cls, F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features]))).where(finite("x"))
    long = written(long, "class-values")
    s = long.groupBy("feature", cls).agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.coalesce(F.stddev_samp("x"), F.lit(0.0)).alias("std"))
    q = quantiles(long, "x", (0.25, 0.5, 0.75), ["feature", cls]).toDF("__f", "__c", "q")
    j = s.join(q, F.col("feature").eqNullSafe(F.col("__f")) & F.col(cls).eqNullSafe(F.col("__c")))
    at = lambda i: F.get("q", F.lit(i))
    return j.select("feature", cls, "n", "mean", at(1).alias("median"), "std", at(0).alias("q1"), at(2).alias("q3"), (at(2) - at(0)).alias("iqr"))


def erfc(z: Column) -> Column:
    """Complementary error function of z >= 0: a series of positive terms below 2, a continued
    fraction beyond."""
    step = lambda a, n: F.struct((a["t"] * 2 * z * z / (2 * n + 1)).alias("t"), (a["s"] + a["t"] * 2 * z * z / (2 * n + 1)).alias("s"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(z.cast("double").alias("t"), z.cast("double").alias("s")), step, lambda a: a["s"])
    fraction = F.aggregate(F.sequence(F.lit(80), F.lit(1)), F.lit(0.0), lambda acc, k: (k / F.lit(2.0)) / (z + acc))
    scale = F.exp(-z * z) / math.sqrt(math.pi)
    return F.when(z < 2, 1 - 2 * scale * series).otherwise(scale / (z + fraction))


def chi2_sf(x: Column, dof: Column) -> Column:
    """Upper tail of chi-square: a sum of powers of x / 2 over gamma values, whole for even
    degrees of freedom, half for odd ones, which start from erfc. 1 for no degrees."""
    y, even = x.cast("double") / 2, dof % 2 == 0
    half = F.when(even, 0.0).otherwise(0.5)
    n = F.when(even, dof / 2).otherwise((dof - 1) / 2).cast("int")
    first = F.when(even, F.lit(1.0)).otherwise(2 * F.sqrt(y / math.pi))
    step = lambda a, i: F.struct((a["t"] * y / (i + half)).alias("t"), (a["s"] + a["t"] * y / (i + half)).alias("s"))
    more = F.when(n > 1, F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    terms = F.aggregate(more, F.struct(first.alias("t"), first.alias("s")), step, lambda a: a["s"])
    tail = F.exp(-y) * F.when(n > 0, terms).otherwise(0.0) + F.when(even, 0.0).otherwise(erfc(F.sqrt(y)))
    return F.when((dof <= 0) | (x <= 0), 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), tail)))


def kruskal_h(n: Column, k: Column, s: Column, ties: Column) -> Column:
    """Kruskal's H from the number of rows and classes, the sum of r * r / n over the classes
    and of t ** 3 - t over the ties; 0 without a rank or with one class."""
    correction = F.when(n > 1, 1 - ties / (n * n * n - n)).otherwise(1.0)
    h = 12 / (n * (n + 1)) * s - 3 * (n + 1)
    return F.when((n >= 2) & (k >= 2) & (correction > 0), F.greatest(F.lit(0.0), F.try_divide(h, correction))).otherwise(0.0)


def _ties(df: DataFrame, x: str) -> DataFrame:
    return df.groupBy(x).agg(F.count("*").cast("double").alias("t")).agg(F.coalesce(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")), F.lit(0.0)).alias("ties"))


def kruskal(df: DataFrame, x: str, cls: str = "class") -> DataFrame:
    """One row: H with tie correction, degrees of freedom, p, epsilon squared. Fewer than
    two classes or rows, or one value only, give H 0; fewer than two classes 0 degrees and p 1."""
    ok = df.where(finite(x)).select(x, cls)
    g = avg_rank(ok, x).groupBy(cls).agg(F.count("*").alias("n"), F.sum("rank").alias("r"))
    g = g.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s"), F.count("*").alias("k"))
    n, k = F.col("n").cast("double"), F.col("k")
    out = g.crossJoin(_ties(ok, x)).select("n", "k", F.when((k >= 2) & (n >= 2), k - 1).otherwise(0).alias("dof"), kruskal_h(n, k, F.col("s"), F.col("ties")).alias("h"))
    epsilon = F.when((F.col("dof") > 0) & (n > k), F.greatest(F.lit(0.0), F.try_divide(F.col("h") - k + 1, n - k))).otherwise(0.0)
    return out.select("n", "dof", "h", chi2_sf(F.col("h"), F.col("dof")).alias("p"), epsilon.alias("epsilon2"))


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, chi-square, degrees of freedom, Cramer's V, over all cells of a x b.
    Empty cells count through their expectation, which sums to n."""
    cells = df.groupBy(a, b).agg(F.count("*").alias("o"))
    ra, rb = cells.groupBy(a).agg(F.sum("o").alias("na")), cells.groupBy(b).agg(F.sum("o").alias("nb"))
    s = cells.join(ra, a).join(rb, b).agg(F.sum("o").alias("n"), F.sum(F.col("o") * F.col("o") / (F.col("na") * F.col("nb"))).alias("q"), F.count_distinct(a).alias("ka"), F.count_distinct(b).alias("kb"))
    chi = F.col("n") * (F.col("q") - 1)
    least = F.least("ka", "kb") - 1
    return s.select("n", chi.alias("chi2"), ((F.col("ka") - 1) * (F.col("kb") - 1)).alias("dof"), F.when(least > 0, F.sqrt(F.greatest(chi, F.lit(0.0)) / (F.col("n") * least))).otherwise(0.0).alias("cramers_v"))


def coverage_audit(df: DataFrame, cls: str, flag: str) -> DataFrame:
    """Share of rows with a flag, by class."""
    return df.groupBy(cls).agg(F.count("*").alias("n"), F.avg(F.col(flag).cast("int")).alias("coverage"))


def permutation_test(df: DataFrame, value: str, label: str, key: str, n: int, seed: int = 42, statistic: str = "kruskal") -> DataFrame:
    """One row: ``observed`` (H of the values by label, or |Spearman|) and ``p``, the share of
    ``n`` label shuffles at least as extreme, (exceed + 1) / (n + 1).

    A shuffle lays the labels, class after class, on the rows in the order of an md5 of seed,
    replicate and key. The rows of all replicates are put in order together, by ranges, so no
    task holds a replicate. Labels are few; a value or label that never changes gives 0 and 1.
    """
    rows = avg_rank(df.where(finite(value)).select(value, label, key), value, "rank").select("rank", label, key, value)
    classes = rows.groupBy(label).agg(F.count("*").alias("m"), F.sum("rank").alias("r"))
    laid = classes.agg(F.sort_array(F.collect_list(F.struct(F.col(label).alias("label"), "m"))).alias("c"), F.sum("m").alias("all"), F.count("*").alias("k"))
    upto = F.transform("c", lambda c, i: F.struct(c["label"].alias("label"), F.aggregate(F.slice("c", 1, i + 1), F.lit(0).cast("long"), lambda s, x: s + x["m"]).alias("upto"), c["m"].alias("m")))
    laid = written(laid.select(upto.alias("c"), "all", "k").crossJoin(_ties(rows, value)), "shuffle-labels")
    rep = rows.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(n))))
    order = [F.col("replicate"), F.md5(F.concat_ws(":", F.lit(seed), "replicate", key)), F.col(key)]
    at = numbered_within(rep, ["replicate"], order[1:], "at").crossJoin(F.broadcast(laid))
    c = F.filter("c", lambda x: x["upto"] > F.col("at"))[0]
    shuffled = at.select("replicate", "rank", c.alias("c"), "all", "k", "ties")
    actual = rows.crossJoin(F.broadcast(laid)).select(F.lit(0).alias("replicate"), "rank", F.filter("c", lambda x: x["label"] == F.col(label))[0].alias("c"), "all", "k", "ties")
    every = shuffled.unionByName(actual)
    if statistic == "kruskal":
        g = every.groupBy("replicate", F.col("c.label").alias("label")).agg(F.count("*").alias("m"), F.sum("rank").alias("r"), F.first("all").alias("all"), F.first("k").alias("k"), F.first("ties").alias("ties"))
        g = g.groupBy("replicate").agg(F.sum(F.col("r") * F.col("r") / F.col("m")).alias("s"), F.first("all").cast("double").alias("all"), F.first("k").alias("k"), F.first("ties").alias("ties"))
        found = g.select("replicate", kruskal_h(F.col("all"), F.col("k"), F.col("s"), F.col("ties")).alias("stat"))
    else:
        y = F.col("c.upto") - F.col("c.m") + (F.col("c.m") + 1) / 2
        g = every.select("replicate", "rank", y.alias("y")).groupBy("replicate").agg(F.covar_pop("rank", "y").alias("c"), F.stddev_pop("rank").alias("sx"), F.stddev_pop("y").alias("sy"))
        found = g.select("replicate", F.abs(F.when((F.col("sx") > 0) & (F.col("sy") > 0), F.try_divide(F.col("c"), F.col("sx") * F.col("sy"))).otherwise(0.0)).alias("stat"))
    found = written(found, "shuffle-statistics")
    seen = found.where("replicate = 0").select(F.col("stat").alias("observed"))
    return found.where("replicate > 0").crossJoin(F.broadcast(seen)).groupBy("observed").agg(((F.count_if(F.col("stat") >= F.col("observed") - 1e-9) + 1) / (F.count("*") + 1)).alias("p"))


def paired_sign_flip(df: DataFrame, delta: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """One row: mean difference, Cohen's dz (0 without a spread), rank-biserial correlation
    (the mean sign of the differences that aren't 0), and the share of sign flips (a bit of md5
    per replicate and row) at least as extreme."""
    rows = df.where(finite(delta)).select(F.col(delta).alias("d"), F.col(key).alias("k"))
    sign = F.when(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "replicate", "k")), 1, 1) < "8", 1).otherwise(-1)
    m = rows.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(n)))).groupBy("replicate").agg(F.avg(F.col("d") * sign).alias("m"))
    base = rows.agg(F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"), F.coalesce(F.avg(F.when(F.col("d") != 0, F.signum("d"))), F.lit(0.0)).alias("rank_biserial"))
    p = m.crossJoin(base).groupBy("mean", "sd", "rank_biserial").agg(((F.count_if(F.abs(F.round("m", 9)) >= F.abs(F.round("mean", 9))) + 1) / (F.count("*") + 1)).alias("p"))
    return p.select("mean", F.when(F.col("sd") > 0, F.try_divide("mean", "sd")).otherwise(0.0).alias("dz"), "rank_biserial", "p")


def value_counts(df: DataFrame, c: str) -> DataFrame:
    """Rows by value."""
    return df.groupBy(c).agg(F.count("*").alias("n"))
