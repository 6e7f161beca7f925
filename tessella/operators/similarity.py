"""Similarity views of rows and columns, vector functions and set overlaps (G).

Vectors are arrays of doubles; a view is a long table ``(src, dst, value)``. Pair
functions compute each unordered pair once (src < dst); ``mirrored`` adds the other half.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.operators.blocked import cosine_pairs, profile_topk  # noqa: F401  G1, and G2, G9 into H1
from tessella.operators.meetings import Layer, all_pairs, half_away  # noqa: F401


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def mirrored(pairs: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    rest = [c for c in pairs.columns if c not in (a, b)]
    way = lambda x, y: F.struct(F.col(x).alias(a), F.col(y).alias(b), *rest)
    return pairs.select(F.inline(F.array(way(a, b), way(b, a)))).select(*pairs.columns)


def profile_layer(cells: DataFrame, digits: int | None = 6, key: str = "row_id", over: str = "col_id", value: str = "freq") -> Layer:
    """Profiles held together by cosine."""
    return Layer(cells.select(F.col(key).alias("id"), F.col(over).alias("k"), F.col(value).cast("double").alias("x")), "cosine", digits)


def profile_cosine(cells: DataFrame, key: str = "row_id", over: str = "col_id", value: str = "freq") -> DataFrame:
    """Cosine of sparse profiles, for pairs that share a cell, each pair once. Pairs are
    summed up in meetings of two parts; no product of single cells is shuffled."""
    return all_pairs({"value": profile_layer(cells, None, key, over, value)})


def mask_cells(cells: DataFrame, held: DataFrame) -> DataFrame:
    """Hide held-out cells before anything is derived."""
    return cells.join(held.select("row_id", "col_id"), ["row_id", "col_id"], "left_anti")


def binarized(cells: DataFrame, value: str = "freq") -> DataFrame:
    """1 for an observed cell."""
    return cells.withColumn(value, (F.col(value) > 0).cast("int"))


def stack_views(views: list[DataFrame], id_col: str = "id", vec: str = "vec") -> DataFrame:
    """One feature row per entity, its views' vectors in the given order; an entity that
    a view lacks is an error."""
    out = views[0].select(id_col, F.col(vec).alias("v0"))
    for i, v in enumerate(views[1:], 1):
        out = out.join(v.select(id_col, F.col(vec).alias(f"v{i}")), id_col, "left")
    cols = [F.when(F.col(f"v{i}").isNull(), F.raise_error(F.lit(f"view {i} lacks an entity"))).otherwise(F.col(f"v{i}")) for i in range(len(views))]
    return out.select(id_col, F.concat(*cols).alias(vec))


def pair_features_lookup(samples: DataFrame, rows: DataFrame, cols: DataFrame, vec: str = "vec") -> DataFrame:
    """Each sample's row and column features, both indices kept."""
    r, c = rows.select(F.col("id").alias("row_id"), F.col(vec).alias("row_vec")), cols.select(F.col("id").alias("col_id"), F.col(vec).alias("col_vec"))
    return samples.join(r, "row_id").join(c, "col_id")


def add_views(vec: Column | str, n: int) -> Column:
    """Element-wise sum of the n equal parts of a stacked vector."""
    v = F.col(vec) if isinstance(vec, str) else vec
    width = (F.size(v) / n).cast("int")
    out = F.slice(v, F.lit(1), width)
    for i in range(1, n):
        out = F.zip_with(out, F.slice(v, width * i + 1, width), lambda x, y: x + y)
    return out


def outer_products(a: Column | str, b: Column | str) -> Column:
    """Products of every element of a with every element of b, a's order first."""
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: x * y)))


def centered(cells: DataFrame, center: float = 3.0) -> DataFrame:
    return cells.withColumn("freq", F.col("freq") - F.lit(center))


def masked_cosine(cells: DataFrame, center: float = 3.0, min_overlap: int = 3) -> DataFrame:
    """Cosine of centred ratings over the shared observed cells only: ``src, dst,
    overlap, degenerate, value``; value is null under ``min_overlap`` or at a zero norm."""
    out = all_pairs({"value": masked_layer(cells, None, center, min_overlap)})
    return out.select("src", "dst", F.col("value_overlap").alias("overlap"), F.col("value_degenerate").alias("degenerate"), "value")


def masked_layer(cells: DataFrame, digits: int | None = 6, center: float = 3.0, min_overlap: int = 3) -> Layer:
    """Profiles held together by the cosine of their centred shared cells."""
    return Layer(cells.select(F.col("row_id").alias("id"), F.col("col_id").alias("k"), (F.col("freq") - F.lit(center)).alias("x")), "masked", digits, min_overlap)


def set_layer(sets: DataFrame, digits: int | None = 6, owner: str = "owner", item: str = "item") -> Layer:
    """Sets held together by Jaccard."""
    return Layer(sets.select(F.col(owner).alias("id"), F.col(item).alias("k"), F.lit(1.0).alias("x")).distinct(), "jaccard", digits)


def set_overlap(sets: DataFrame, owner: str = "owner", item: str = "item", empty: float | None = None) -> DataFrame:
    """``src, dst, shared, jaccard, overlap`` of owners' item sets, for pairs that share
    an item, each once. For pairs that don't, Jaccard is 0 unless both sets are empty, where
    it is ``empty`` (see ``jaccard``)."""
    out = all_pairs({"jaccard": set_layer(sets, None, owner, item)})
    return out.select("src", "dst", F.col("jaccard_shared").alias("shared"), "jaccard", (F.col("jaccard_shared") / F.col("jaccard_least")).alias("overlap"))


def jaccard(shared: Column, na: Column, nb: Column, empty: float | None = None) -> Column:
    """|A and B| / |A or B|; ``empty`` (null or 0, both conventions are in use) where both
    sets are empty."""
    union = na + nb - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(empty).cast("double"))


def reach_sets(first: DataFrame, second: DataFrame) -> DataFrame:
    """``owner, item`` reached over two typed edge sets: first(owner, via), second(via, item)."""
    return first.select("owner", "via").join(second.select("via", "item"), "via").select("owner", "item").distinct()


def structure_similarity(genes: DataFrame, pathways: DataFrame) -> DataFrame:
    """Mean of the gene and pathway Jaccard, of one where the other is missing."""
    g = genes.select("src", "dst", F.col("jaccard").alias("gene_jaccard"))
    p = pathways.select("src", "dst", F.col("jaccard").alias("pathway_jaccard"))
    g_, p_ = F.col("gene_jaccard"), F.col("pathway_jaccard")
    return g.join(p, ["src", "dst"], "full").withColumn("structure", F.coalesce((g_ + p_) / 2, g_, p_))


def clip_unit(c: Column, tolerance: float = 1e-8) -> Column:
    """Round-off outside [0, 1] is clipped; more is an error. A missing value stays missing."""
    out = (c < -tolerance) | (c > 1 + tolerance)
    return F.when(out, F.raise_error(F.lit("value outside [0, 1]"))).when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def embedding_cosine(df: DataFrame, id_col: str = "id", vec: str = "vec", available: str = "available") -> DataFrame:
    """Cosine of the available rows; unavailable ones have no pairs (null on a join back)."""
    return cosine_pairs(df.where(F.col(available)), id_col, vec)


def mean_vectors(df: DataFrame, id_col: str, vec: str) -> DataFrame:
    """The mean vector of each entity."""
    at = df.select(id_col, F.posexplode(vec).alias("pos", "x")).groupBy(id_col, "pos").agg(F.avg("x").alias("x"))
    return at.groupBy(id_col).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias(vec))


def alignment_cosine(df: DataFrame, targets: DataFrame, id_col: str = "id", vec: str = "vec") -> DataFrame:
    """Cosine of each entity's mean vector to its target, and 1 minus it as the loss."""
    m = mean_vectors(df, id_col, vec).join(targets.select(id_col, F.col(vec).alias("target")), id_col)
    c = dot(vec, "target") / (norm(vec) * norm("target"))
    return m.select(id_col, c.alias("cosine"), (1 - c).alias("loss"))


def replace_view(vec: Column, at: int, width: int, new: Column) -> Column:
    """The stacked vector with its view number ``at`` (from 0) replaced."""
    return F.concat(F.slice(vec, 1, at * width), new, F.slice(vec, F.lit((at + 1) * width + 1), F.greatest(F.size(vec) - (at + 1) * width, F.lit(0))))


def append_view(vec: Column, new: Column) -> Column:
    """The stacked vector with one more view."""
    return F.concat(vec, new)


def with_fallback(vec: Column, available: Column, default: list[float]) -> Column:
    """A default vector where the entity has none."""
    return F.when(available, vec.cast("array<double>")).otherwise(F.array(*[F.lit(float(x)) for x in default]))


def distmult_score(triples: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Sum of source, relation and target vectors' products for each triple."""
    e = lambda side: entities.select(F.col("id").alias(side), F.col("vec").alias(f"{side}_vec"))
    j = triples.join(e("source"), "source").join(e("target"), "target").join(relations.select(F.col("id").alias("relation"), F.col("vec").alias("rel_vec")), "relation")
    return j.select("source", "relation", "target", dot(F.zip_with("source_vec", "rel_vec", lambda x, y: x.cast("double") * y), F.col("target_vec")).alias("score"))


def relational_mean(edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """For each (target, relation), the mean of the sources' vectors by position."""
    j = edges.select("source", "relation", "target").join(vectors.select(F.col("id").alias("source"), "vec"), "source")
    at = j.select("target", "relation", F.posexplode("vec").alias("pos", "x"))
    return at.groupBy("target", "relation", "pos").agg(F.avg("x").alias("value"))


def pair_context(samples: DataFrame, a: DataFrame, b: DataFrame, disable: str | None = None) -> DataFrame:
    """Both sides' embeddings and availability flags in one vector; a missing or
    disabled side is zeros with flag 0. Vectors of one side have one length."""
    def side(df: DataFrame, key: str, name: str) -> DataFrame:
        v = F.transform("vec", lambda x: F.when(F.col("available") & F.lit(disable != name), x.cast("double")).otherwise(0.0))
        flag = F.when(F.col("available") & F.lit(disable != name), 1.0).otherwise(0.0)
        return df.select(F.col("id").alias(key), v.alias(f"{name}_vec"), flag.alias(f"{name}_flag"))

    j = samples.join(side(a, "row_id", "row"), "row_id", "left").join(side(b, "col_id", "col"), "col_id", "left")
    return j.withColumn("context", F.concat("row_vec", "col_vec", F.array("row_flag", "col_flag"))).drop("row_vec", "col_vec", "row_flag", "col_flag")


def top_k(sim: DataFrame, k: int, src: str = "src", dst: str = "dst", value: str = "value") -> DataFrame:
    """H1: the k best neighbours of each source: value descending, ids ascending, missing and
    NaN values last, itself excluded. ``rank`` counts from 1."""
    v = F.nanvl(F.col(value), F.lit(None).cast("double"))
    order = W.partitionBy(src).orderBy(v.desc_nulls_last(), F.col(dst))
    return sim.where(F.col(src) != F.col(dst)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
