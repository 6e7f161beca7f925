"""Neighbour graphs: construction, rewiring, diagnostics and comparison (H).

Edges are ``(src, dst, ...)`` with directed meaning; similarity tables are ``(src, dst, value)``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.operators.components import star_components
from tessella.operators.meetings import Layer, summary
from tessella.operators.similarity import top_k

BOTH = ["src", "dst"]
# Where an edge of a rewired graph comes from.
ORIGINAL, KG_ADDED, TASK_ADDED, KG_TASK_ADDED = "ORIGINAL", "KG_ONLY_ADDED", "TASK_ONLY_ADDED", "KG_TASK_ADDED"


def with_evidence(edges: DataFrame, **tables: DataFrame) -> DataFrame:
    """H2: one column per named similarity table, null where it lacks the pair."""
    for name, t in tables.items():
        edges = edges.join(t.select("src", "dst", F.col("value").alias(name)), BOTH, "left")
    return edges


def original_graph(sim: DataFrame, k: int = 10, **tables: DataFrame) -> DataFrame:
    """H2: the top-k graph with evidence columns and its origin."""
    base = top_k(sim, k).select("src", "dst", F.col("value").alias("original"))
    return with_evidence(base, **tables).withColumn("origin", F.lit(ORIGINAL))


def add_edges(original: DataFrame, candidates: DataFrame, n: int, origin: str) -> DataFrame:
    """H3, H4: up to n best candidates per source that the graph doesn't have; candidates
    without a value are out."""
    new = candidates.where("value is not null and src <> dst and not isnan(value)").join(original.select(*BOTH), BOTH, "left_anti")
    return top_k(new, n).select("src", "dst", "value", F.lit(origin).alias("origin"))


def add_kg_edges(original: DataFrame, kg: DataFrame, pool: int = 20, n: int = 3) -> DataFrame:
    """H3: of the KG's top ``pool`` neighbours, the first n that aren't present."""
    return add_edges(original, top_k(kg, pool).select("src", "dst", "value"), n, KG_ADDED)


def add_kg_task_edges(original: DataFrame, kg: DataFrame, task: DataFrame, pool: int = 20, n: int = 3) -> DataFrame:
    """H5: KG candidates of positive value whose task value beats the source's own mean over
    its original edges (0 without any), by 0.5 (k + 1) / 2 + 0.5 (t + 1) / 2."""
    base = original.select(*BOTH).join(task, BOTH).groupBy("src").agg(F.avg("value").alias("baseline"))
    c = top_k(kg, pool).where("value > 0").select("src", "dst", F.col("value").alias("k")).join(original.select(*BOTH), BOTH, "left_anti")
    c = c.join(task.select("src", "dst", F.col("value").alias("t")), BOTH).join(base, "src", "left")
    c = c.where(F.col("t") > F.coalesce("baseline", F.lit(0.0)))
    score = 0.5 * (F.col("k") + 1) / 2 + 0.5 * (F.col("t") + 1) / 2
    return top_k(c.select("src", "dst", F.round(score, 8).alias("value")), n).select("src", "dst", "value", F.lit(KG_TASK_ADDED).alias("origin"))


def combine_edges(original: DataFrame, added: DataFrame) -> DataFrame:
    """H6: union of both; an edge of both is an error."""
    u = original.select("src", "dst", "origin").unionByName(added.select("src", "dst", "origin"))
    twice = F.count("*").over(W.partitionBy(*BOTH)) > 1
    return u.withColumn("origin", F.when(twice, F.raise_error(F.lit("an edge occurs twice"))).otherwise(F.col("origin")))


def build_channels(structure: DataFrame, task: DataFrame, k: int = 10) -> DataFrame:
    """H7: top-k graphs by structure, by task (normalised to 0..1), and by their mean where
    structure is positive and the task value is known: ``channel, src, dst, value, rank``."""
    t = task.where("value is not null").select("src", "dst", ((F.col("value") + 1) / 2).alias("value"))
    s = structure.where("value > 0")
    both = s.join(t.withColumnRenamed("value", "t"), BOTH).select("src", "dst", F.round((F.col("value") + F.col("t")) / 2, 8).alias("value"))
    parts = [top_k(x, k).select(F.lit(name).alias("channel"), "src", "dst", "value", "rank") for name, x in (("structure", s), ("task", t), ("combined", both))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def graph_diagnostics(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """H8: one row of an undirected reading of a top-k graph: mean, least and largest number of
    neighbours (either way) over all nodes, isolated nodes, components and the largest, edges
    without direction, share of directed edges whose reverse exists, mean value."""
    both = edges.select(*BOTH).union(edges.select("dst", "src")).distinct()
    degree = nodes.select(F.col("id").alias("src")).join(both.groupBy("src").agg(F.count("*").alias("d")), "src", "left").withColumn("d", F.coalesce("d", F.lit(0)))
    d = degree.agg(F.avg("d").alias("mean_degree"), F.min("d").alias("min_degree"), F.max("d").alias("max_degree"), F.count_if(F.col("d") == 0).alias("isolated"))
    return _edge_figures(edges).crossJoin(d).crossJoin(_component_figures(edges, nodes)).crossJoin(both.where("src <= dst").agg(F.count("*").alias("edges")))  # one row each


def _edge_figures(edges: DataFrame) -> DataFrame:
    back = edges.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.lit(1).alias("r")).distinct()
    return edges.join(back, BOTH, "left").agg(F.coalesce(100 * F.avg(F.coalesce("r", F.lit(0))), F.lit(0.0)).alias("reciprocal_percentage"), F.avg("value").alias("mean_value"))


def _component_figures(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return connected_components(edges, nodes).groupBy("component").agg(F.count("*").alias("n")).agg(F.count("*").alias("components"), F.coalesce(F.max("n"), F.lit(0)).alias("largest_component"))


def graph_statistics(edges: DataFrame, nodes: DataFrame, random_task: DataFrame) -> DataFrame:
    """H8: one row of a rewired graph ``(src, dst, edge_origin, original_similarity,
    kg_similarity, task_similarity, task_overlap_count)``: kept and added edges, out-degrees over
    all nodes, nodes that give no edge, reciprocal share, components, means of the kept edges'
    own similarity and of the added edges' graph and task similarity and overlap (finite ones
    only), mean and median task similarity, its mean by source, and its enrichment over
    ``random_task(random)`` (one row). Missing values are null."""
    known = lambda c: F.when(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.col(c))
    e = edges.withColumns({c: known(c) for c in ("original_similarity", "kg_similarity", "task_similarity", "task_overlap_count")}).withColumn("added", F.col("edge_origin") != "ORIGINAL")
    of = lambda c, added: F.avg(F.when(F.col("added") == added, F.col(c)))
    one = e.agg(
        F.count_if(~F.col("added")).alias("original_edges"), F.count_if("added").alias("added_edges"), F.count("*").alias("total_directed_edges"), of("original_similarity", False).alias("mean_original_similarity"),
        of("kg_similarity", True).alias("added_mean_kg_similarity"), of("task_similarity", True).alias("added_mean_task_similarity"), of("task_overlap_count", True).alias("added_mean_task_overlap_count"),
        F.count_if(F.col("added") & F.col("task_similarity").isNotNull()).alias("added_evaluable_task_edge_count"), F.avg("task_similarity").alias("mean_task_similarity"), F.median("task_similarity").alias("median_task_similarity"))
    out_degree = nodes.select(F.col("id").alias("src")).join(edges.groupBy("src").agg(F.count("*").alias("d")), "src", "left").withColumn("d", F.coalesce("d", F.lit(0)))
    d = out_degree.agg(F.avg("d").alias("mean_degree"), F.min("d").alias("min_degree"), F.max("d").alias("max_degree"), F.count_if(F.col("d") == 0).alias("isolated_nodes"))
    by_source = e.groupBy("src").agg(F.avg("task_similarity").alias("t")).agg(F.avg("t").alias("top_neighborhood_task_similarity"))
    pairs = edges.select(*BOTH).distinct().withColumn("value", F.lit(0.0))
    j = one.crossJoin(d).crossJoin(_edge_figures(pairs).drop("mean_value")).crossJoin(_component_figures(edges, nodes)).crossJoin(by_source).crossJoin(random_task.select(F.col("random").alias("random_task_baseline")))  # one row each
    return j.withColumn("task_enrichment", F.col("mean_task_similarity") - F.col("random_task_baseline"))


def connected_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """H9: ``id, component`` for every node, component its smallest reachable id (its own,
    without edges)."""
    joined = star_components(edges, "src", "dst").withColumnRenamed("id", "__id")
    return nodes.select("id").distinct().join(joined, F.col("id") == F.col("__id"), "left").select("id", F.coalesce("component", "id").alias("component"))


def compare_edge_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: shared, only_a, only_b, jaccard, share of a, share of b."""
    j = a.select(*BOTH, F.lit(1).alias("a")).join(b.select(*BOTH, F.lit(1).alias("b")), BOTH, "full")
    s = j.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("shared"), F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b"))
    n = F.col("shared")
    safe = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    return s.select("shared", "only_a", "only_b", safe(n, n + F.col("only_a") + F.col("only_b")).alias("jaccard"), safe(n, n + F.col("only_a")).alias("share_a"), safe(n, n + F.col("only_b")).alias("share_b"))


def neighbor_jaccard(a: DataFrame, b: DataFrame, nodes: DataFrame) -> DataFrame:
    """Mean over the nodes of the Jaccard of their neighbours in both graphs; nodes
    without neighbours in either count as 0."""
    j = a.select(*BOTH, F.lit(1).alias("a")).join(b.select(*BOTH, F.lit(1).alias("b")), BOTH, "full")
    per = j.groupBy("src").agg((F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()) / F.count("*")).alias("j"))
    return nodes.select(F.col("id").alias("src")).join(per, "src", "left").agg(F.avg(F.coalesce("j", F.lit(0.0))).alias("mean_jaccard"))


def apply_adjacency(matrix: DataFrame, edges: DataFrame) -> DataFrame:
    """The matrix (src, dst, value) at the chosen edges and on the diagonal; chosen
    edges that the matrix lacks are zeros."""
    chosen = edges.select(*BOTH).distinct().join(matrix, BOTH, "left").select("src", "dst", F.coalesce("value", F.lit(0.0)).alias("value"), F.lit(False).alias("diagonal"))
    diagonal = matrix.where("src = dst").select("src", "dst", "value", F.lit(True).alias("diagonal"))
    return chosen.where("src <> dst").unionByName(diagonal)


def matrix_diff(a: DataFrame, b: DataFrame, n: int) -> DataFrame:
    """One row: differing cells, largest and mean absolute difference (over n * n), L1, L2."""
    j = a.join(b.withColumnRenamed("value", "other"), BOTH, "full")
    d = j.select(F.abs(F.coalesce("value", F.lit(0.0)) - F.coalesce("other", F.lit(0.0))).alias("d"))
    return d.agg(F.count_if(F.col("d") > 0).alias("cells"), F.max("d").alias("max_abs"), (F.sum("d") / (n * n)).alias("mean_abs"), F.sum("d").alias("l1"), F.sqrt(F.sum(F.col("d") * F.col("d"))).alias("l2"))


def layers_diff(a: Layer, b: Layer, n: int) -> DataFrame:
    """H13 of the views of two layers of profiles, both halves, without their pairs."""

    def told(block):
        x, y = block.layers["a"], block.layers["b"]
        d = np.abs(np.nan_to_num(x.value) - np.nan_to_num(y.value))[x.known | y.known]
        return {"cells": 2 * int((d > 0).sum()), "most": float(d.max(initial=0.0)), "l1": 2 * float(d.sum()), "l2": 2 * float((d * d).sum())}

    s = summary({"a": a, "b": b}, told, "cells long, most double, l1 double, l2 double")
    return s.agg(F.coalesce(F.sum("cells"), F.lit(0)).alias("cells"), F.max("most").alias("max_abs"), (F.sum("l1") / (n * n)).alias("mean_abs"), F.sum("l1").alias("l1"), F.sqrt(F.sum("l2")).alias("l2"))


def edge_coverage(added: DataFrame, nodes: DataFrame) -> DataFrame:
    """Sources that receive edges, all nodes, share."""
    a = added.agg(F.count_distinct("src").alias("sources"), F.count("*").alias("edges"))
    return a.crossJoin(nodes.agg(F.count("*").alias("nodes"))).withColumn("share", F.col("sources") / F.col("nodes"))


def neighbor_margins(sim: DataFrame) -> DataFrame:
    """For each source its best value, the means of its best 5 and 10, the tenth, and by how
    much the best stands above the tenth and above the mean of 10."""
    t = top_k(sim, 10)
    at = lambda n: F.max(F.when(F.col("rank") == n, F.col("value")))
    m = t.groupBy("src").agg(at(1).alias("top1"), F.avg(F.when(F.col("rank") <= 5, F.col("value"))).alias("top5_mean"), F.avg("value").alias("top10_mean"), at(10).alias("tenth"))
    return m.withColumns({"margin_tenth": F.col("top1") - F.col("tenth"), "margin_mean": F.col("top1") - F.col("top10_mean")})


def weak_discrimination(margins: DataFrame) -> DataFrame:
    """One row: whether the best neighbours hardly stand above the tenth: a mean margin
    under 0.01 or a median under 0.005."""
    m = margins.agg(F.avg("margin_tenth").alias("mean"), F.median("margin_tenth").alias("median"))
    return m.select(F.coalesce((F.col("mean") < 0.01) | (F.col("median") < 0.005), F.lit(False)).alias("weak"))
