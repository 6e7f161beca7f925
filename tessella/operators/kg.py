"""Typed knowledge graphs as two tables: nodes(node_id, node_type, name) and
edges(source, target, relation, source_type, target_type, original_source) (E)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.sources.scratch import in_order

from tessella.functions import text as X

EDGE = ["source", "target", "relation", "source_type", "target_type"]


def anchor_nodes(anchors: DataFrame, nodes: DataFrame) -> DataFrame:
    """Node ids that the anchors' JSON lists ask for and the graph has."""
    asked = anchors.select(F.explode(X.parse_ids("node_ids")).alias("node_id")).distinct()
    return asked.join(nodes.select("node_id"), "node_id", "left_semi")


def filter_edges(edges: DataFrame, ids: DataFrame, side: str = "source") -> DataFrame:
    """Edges with that endpoint among the ids."""
    return edges.join(ids.select(F.col("node_id").alias(side)), side, "left_semi")


def endpoints(edges: DataFrame) -> DataFrame:
    """All nodes that edges touch."""
    return edges.select(F.col("source").alias("node_id")).union(edges.select("target")).distinct()


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both endpoints among the ids."""
    return filter_edges(filter_edges(edges, ids), ids, "target")


def expand(edges: DataFrame, ids: DataFrame, to_type: str) -> DataFrame:
    """Neighbours of a type, one hop either way."""
    out = filter_edges(edges, ids).where(F.col("target_type") == to_type).select(F.col("target").alias("node_id"))
    back = filter_edges(edges, ids, "target").where(F.col("source_type") == to_type).select(F.col("source").alias("node_id"))
    return out.union(back).distinct()


def project_nodes(df: DataFrame, node_type: str, id_col: str, *names: str) -> DataFrame:
    """E5: node rows of a type, the first non-empty of some columns as the name."""
    return df.select(F.col(id_col).alias("node_id"), F.lit(node_type).alias("node_type"), F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names], F.lit("")).alias("name"))


def provenance(direct: Column, indirect: Column, fallback: str) -> Column:
    """Distinct sources of both lists, sorted and joined by ``;``, else a fallback."""
    empty = F.array().cast("array<string>")
    both = F.array_sort(F.array_distinct(F.filter(F.concat(F.coalesce(direct, empty), F.coalesce(indirect, empty)), lambda x: x.isNotNull() & (x != ""))))
    return F.when(F.size(both) > 0, F.array_join(both, ";")).otherwise(F.lit(fallback))


def normalize_edges(df: DataFrame, source: str, target: str, source_type: str, target_type: str, relation: Column, default: str, origin: Column) -> DataFrame:
    """One family of raw edges in the common form, with a default relation."""
    return df.select(
        F.col(source).alias("source"), F.col(target).alias("target"), F.coalesce(F.nullif(relation, F.lit("")), F.lit(default)).alias("relation"),
        F.lit(source_type).alias("source_type"), F.lit(target_type).alias("target_type"), origin.alias("original_source"),
    )


def dedup_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row for each key, the smallest of the others."""
    rest = [c for c in df.columns if c not in cols]
    if not rest:
        return df.select(*cols).distinct()
    return df.groupBy(*cols).agg(F.min(F.struct(*rest)).alias("r")).select(*cols, "r.*")


def dedup_edges(edges: DataFrame) -> DataFrame:
    """One row per edge with its sources' parts (between bars) merged, sorted, non-empty."""
    parts = F.explode_outer(F.split(F.coalesce("original_source", F.lit("")), r"\|"))
    e = edges.select(*EDGE, parts.alias("part"))
    s = F.array_sort(F.filter(F.collect_set("part"), lambda x: x != ""))
    return e.groupBy(*EDGE).agg(F.array_join(s, "|").alias("original_source"))


def anchor_edges(anchors: DataFrame, nodes: DataFrame, relation: str, anchor_type: str) -> DataFrame:
    """Edges from anchors to the nodes of their lists that the graph has."""
    e = anchors.select(F.col("anchor_id").alias("source"), F.explode(X.parse_ids("node_ids")).alias("node_id")).join(nodes, "node_id")
    return e.select("source", F.col("node_id").alias("target"), F.lit(relation).alias("relation"), F.lit(anchor_type).alias("source_type"), F.col("node_type").alias("target_type"), F.lit("anchor").alias("original_source"))


def graph_stats(nodes: DataFrame, edges: DataFrame, anchor_type: str) -> DataFrame:
    """One row: nodes, edges, relations, node types, isolated anchors."""
    alone = nodes.where(F.col("node_type") == anchor_type).join(endpoints(edges), "node_id", "left_anti").agg(F.count("*").alias("isolated_anchors"))
    n = nodes.agg(F.count("*").alias("nodes"), F.count_distinct("node_type").alias("types"))
    return n.crossJoin(edges.agg(F.count("*").alias("edges"), F.count_distinct("relation").alias("relations"))).crossJoin(alone)


def typed_paths(edges: DataFrame, n: int) -> DataFrame:
    """The first n paths anchor -> drug -> gene <- phenotype <- anchor, in order."""
    def hop(s: str, t: str, a: str, b: str) -> DataFrame:
        return edges.where((F.col("source_type") == s) & (F.col("target_type") == t)).select(F.col("source").alias(a), F.col("target").alias(b)).distinct()

    p = hop("drug_anchor", "drug", "anchor", "drug").join(hop("drug", "gene", "drug", "gene"), "drug")
    q = hop("side_anchor", "phenotype", "side", "phenotype").join(hop("phenotype", "gene", "phenotype", "gene"), "phenotype")
    # Each start of a path leads to one path at least, and of a gene's ends the first n suffice.
    starts = p.join(q.select("gene").distinct(), "gene", "left_semi").orderBy("anchor", "drug", "gene").limit(n)
    ends = q.join(starts.select("gene").distinct(), "gene", "left_semi").withColumn("nth", F.row_number().over(W.partitionBy("gene").orderBy("phenotype", "side"))).where(F.col("nth") <= n)
    order = ["anchor", "drug", "gene", "phenotype", "side"]
    return starts.join(ends, "gene").select(*order).orderBy(*order).limit(n)


def index_nodes(nodes: DataFrame, type_order: tuple[str, ...]) -> DataFrame:
    """A dense index by (type order, id), over range partitions."""
    rank = F.array_position(F.array(*map(F.lit, type_order)), F.col("node_type"))
    return in_order(nodes.select("node_id", "node_type"), [rank, F.col("node_type"), F.col("node_id")], "node_index").select("node_id", "node_type", "node_index")


def index_relations(edges: DataFrame, inverse: str = "__INV") -> DataFrame:
    """Relations by name from 0, then their inverses in the same order."""
    r = edges.select("relation").distinct().withColumn("i", F.row_number().over(W.partitionBy().orderBy("relation")) - 1)
    n = r.agg(F.count("*").alias("n"))
    back = r.crossJoin(n).select(F.concat("relation", F.lit(inverse)).alias("relation"), (F.col("i") + F.col("n")).alias("relation_index"), F.lit(True).alias("is_inverse"))
    return r.select("relation", F.col("i").cast("long").alias("relation_index"), F.lit(False).alias("is_inverse")).unionByName(back)


def index_edges(edges: DataFrame, nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """Edges by index."""
    at = lambda side: nodes.select(F.col("node_id").alias(side), F.col("node_index").alias(f"{side}_index"))
    return edges.join(at("source"), "source").join(at("target"), "target").join(relations.where("not is_inverse").select("relation", "relation_index"), "relation").select("source_index", "target_index", "relation_index", "relation")


def add_inverse(indexed: DataFrame, relations: DataFrame, inverse: str = "__INV") -> DataFrame:
    """Every edge and its inverse."""
    n = relations.where("is_inverse").select("relation", F.col("relation_index").alias("inverse_index"))
    back = indexed.withColumn("relation", F.concat("relation", F.lit(inverse))).join(n, "relation")
    back = back.select(F.col("target_index").alias("source_index"), F.col("source_index").alias("target_index"), F.col("inverse_index").alias("relation_index"), "relation", F.lit(True).alias("is_inverse"))
    return indexed.withColumn("is_inverse", F.lit(False)).unionByName(back)


def anchor_index(nodes: DataFrame, edges: DataFrame, anchor_type: str, relation: str) -> DataFrame:
    """anchors' indices and whether an identity link ``relation`` leads from the anchor."""
    linked = edges.where((F.col("relation") == relation) & (F.col("source_type") == anchor_type)).select(F.col("source").alias("node_id"), F.lit(True).alias("linked")).distinct()
    return nodes.where(F.col("node_type") == anchor_type).join(linked, "node_id", "left").select("node_id", "node_index", F.coalesce("linked", F.lit(False)).alias("connected"))


def node_metadata(nodes: DataFrame, edges: DataFrame, anchors: tuple[str, ...] = ("drug_anchor", "side_anchor")) -> DataFrame:
    """Per node whether it is an anchor and whether it has a neighbour."""
    t = endpoints(edges).withColumn("t", F.lit(True))
    return nodes.join(t, "node_id", "left").select("node_id", "node_type", "node_index", F.col("node_type").isin(*anchors).alias("is_anchor"), F.col("t").isNotNull().alias("has_neighbor"))


def graph_metadata(indexed: DataFrame) -> DataFrame:
    """Per relation: edges, self edges, and edges whose reverse is there under any relation."""
    back = indexed.select(F.col("target_index").alias("source_index"), F.col("source_index").alias("target_index")).distinct().withColumn("b", F.lit(1))
    j = indexed.join(back, ["source_index", "target_index"], "left")
    return j.groupBy("relation").agg(F.count("*").alias("edges"), F.count_if(F.col("source_index") == F.col("target_index")).alias("self_edges"), F.count("b").alias("both_ways"))
