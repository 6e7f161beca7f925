"""Queries over similarity views, vectors and set overlaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import meetings as M
from tessella.operators import similarity as S
from tessella.plans.analog import load, sql
from tessella.plans.registry import query

COSINE = """pairs AS (SELECT a.row_id AS src, b.row_id AS dst, sum(a.freq * b.freq) AS s FROM {train} a JOIN {train} b ON a.col_id = b.col_id AND a.row_id <> b.row_id GROUP BY 1, 2),
norms AS (SELECT row_id, sqrt(sum(freq * freq)) AS norm FROM {train} GROUP BY 1),
sim AS (SELECT src, dst, round(s / (x.norm * y.norm), 6) AS value FROM pairs JOIN norms x ON src = x.row_id JOIN norms y ON dst = y.row_id)"""
DOT = "list_reduce(list_prepend(CAST(0 AS DOUBLE), [CAST(z[1] AS DOUBLE) * z[2] FOR z IN list_zip({}, {})]), lambda p, q: p + q)"


def supplier_cosine(spark, sf_dir):
    return S.mirrored(M.all_pairs({"value": profile_layer(spark, sf_dir)}))


def profile_layer(spark, sf_dir):
    return S.profile_layer(load(spark, sf_dir, "train"))


@query(sql(f"WITH {COSINE} SELECT src, dst, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY value DESC, dst) AS rank FROM sim) WHERE rank <= 10"))
def profile_cosine_topk(spark, sf_dir):
    """Train cells -> supplier cosine -> top-10 neighbours."""
    return S.profile_topk(load(spark, sf_dir, "train"), 10)


@query(sql("""WITH b AS (SELECT DISTINCT row_id, col_id FROM {train}), n AS (SELECT col_id, count(*) AS n FROM b GROUP BY 1),
h AS (SELECT x.col_id AS src, y.col_id AS dst, count(*) AS both_ FROM b x JOIN b y ON x.row_id = y.row_id AND x.col_id <> y.col_id GROUP BY 1, 2),
v AS (SELECT src, dst, round(both_ / sqrt(p.n * q.n), 6) AS value FROM h JOIN n p ON p.col_id = src JOIN n q ON q.col_id = dst)
SELECT src, dst, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY value DESC, dst) AS rank FROM v) WHERE rank <= 10"""))
def binary_column_cosine(spark, sf_dir):
    """Column view of the binarised cells: the ten columns nearest to each."""
    return S.profile_topk(S.binarized(load(spark, sf_dir, "train")), 10, "col_id", "row_id")


@query(sql("""WITH b AS (SELECT DISTINCT row_id, col_id FROM {train}), n AS (SELECT col_id, count(*) AS n FROM b GROUP BY 1),
h AS (SELECT x.col_id AS src, y.col_id AS dst, count(*) AS both_ FROM b x JOIN b y ON x.row_id = y.row_id AND x.col_id <> y.col_id GROUP BY 1, 2),
v AS (SELECT src, dst, round(both_ / (p.n + q.n - both_), 6) AS value FROM h JOIN n p ON p.col_id = src JOIN n q ON q.col_id = dst)
SELECT src, dst, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY value DESC, dst) AS rank FROM v) WHERE rank <= 10"""))
def set_jaccard_topk(spark, sf_dir):
    """Columns as sets of rows: the ten of largest Jaccard."""
    return S.profile_topk(load(spark, sf_dir, "train"), 10, "col_id", "row_id", measure="jaccard")


@query(sql("""SELECT row_id, col_id, freq, CAST(freq > 0 AS INT) AS seen FROM {triples} t WHERE NOT EXISTS (SELECT 1 FROM {held} h WHERE h.row_id = t.row_id AND h.col_id = t.col_id)"""))
def masked_cells(spark, sf_dir):
    cells = S.mask_cells(load(spark, sf_dir, "triples"), load(spark, sf_dir, "held"))
    return cells.withColumn("seen", (F.col("freq") > 0).cast("int"))


@query(sql(f"""WITH v AS (SELECT id, vec, sqrt({DOT.format('vec', 'vec')}) AS n FROM {{masked}} WHERE available)
SELECT a.id AS src, b.id AS dst, round({DOT.format('a.vec', 'b.vec')} / (a.n * b.n), 5) + 0.0 AS value FROM v a JOIN v b ON a.id < b.id"""))
def embedding_cosine(spark, sf_dir):
    return S.embedding_cosine(load(spark, sf_dir, "masked")).withColumn("value", F.round("value", 5) + 0.0)


@query(sql("""WITH t AS (SELECT row_id, col_id, freq - 3.0 AS x FROM {train}),
s AS (SELECT a.row_id AS src, b.row_id AS dst, count(*) AS overlap, sum(a.x * b.x) AS xy, sum(a.x * a.x) AS xx, sum(b.x * b.x) AS yy FROM t a JOIN t b ON a.col_id = b.col_id AND a.row_id < b.row_id GROUP BY 1, 2)
SELECT src, dst, overlap, overlap >= 3 AND (xx <= 0 OR yy <= 0) AS degenerate, CASE WHEN overlap >= 3 AND xx > 0 AND yy > 0 THEN round(xy / sqrt(xx * yy), 6) END AS value FROM s"""))
def masked_cosine(spark, sf_dir):
    return S.masked_cosine(load(spark, sf_dir, "train")).withColumn("value", S.half_away(F.col("value"), 6))


SETS = """g AS (SELECT DISTINCT l_suppkey AS owner, l_partkey AS item FROM {lineitem}),
p AS (SELECT DISTINCT owner, p_brand AS item FROM g JOIN {part} ON item = p_partkey)"""
OVER = "SELECT src, dst, shared, shared / (na + nb - shared) AS jaccard, shared / least(na, nb) AS overlap FROM (SELECT x.owner AS src, y.owner AS dst, count(*) AS shared FROM {0} x JOIN {0} y ON x.item = y.item AND x.owner < y.owner GROUP BY 1, 2) JOIN (SELECT owner AS o1, count(*) AS na FROM {0} GROUP BY 1) ON o1 = src JOIN (SELECT owner AS o2, count(*) AS nb FROM {0} GROUP BY 1) ON o2 = dst"


def gene_sets(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("owner"), F.col("l_partkey").alias("item")).distinct()


def gene_layer(spark, sf_dir):
    return S.set_layer(gene_sets(spark, sf_dir))


def task_layer(spark, sf_dir):
    return S.masked_layer(load(spark, sf_dir, "train"))


def pathway_sets(spark, sf_dir):
    brand = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("via"), F.col("p_brand").alias("item"))
    return S.reach_sets(gene_sets(spark, sf_dir).withColumnRenamed("item", "via"), brand)


@query(sql(f"WITH {SETS}, s AS ({OVER.format('g')}) SELECT src, dst, shared, round(jaccard, 6) AS jaccard, round(overlap, 6) AS overlap FROM s"))
def set_jaccard(spark, sf_dir):
    out = S.set_overlap(gene_sets(spark, sf_dir))
    return out.withColumns({c: S.half_away(F.col(c), 6) for c in ("jaccard", "overlap")})


@query(sql(f"WITH {SETS} SELECT owner, item FROM p"))
def reach_sets(spark, sf_dir):
    return pathway_sets(spark, sf_dir)


@query(sql(f"""WITH {SETS}, a AS ({OVER.format('g')}), b AS ({OVER.format('p')})
SELECT coalesce(a.src, b.src) AS src, coalesce(a.dst, b.dst) AS dst, round(a.jaccard, 6) AS gene_jaccard, round(b.jaccard, 6) AS pathway_jaccard, round(coalesce((a.jaccard + b.jaccard) / 2, a.jaccard, b.jaccard), 6) AS structure
FROM a FULL JOIN b ON a.src = b.src AND a.dst = b.dst"""))
def structure_similarity(spark, sf_dir):
    out = S.structure_similarity(S.set_overlap(gene_sets(spark, sf_dir)), S.set_overlap(pathway_sets(spark, sf_dir)))
    return out.select("src", "dst", *[S.half_away(S.clip_unit(F.col(c)), 6).alias(c) for c in ("gene_jaccard", "pathway_jaccard", "structure")])


@query(sql(f"""WITH x AS (SELECT label AS id, i AS pos, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM {{embeddings}}, range(1, 65) r(i) GROUP BY 1, 2),
m AS (SELECT id, list(m ORDER BY pos) AS vec FROM x GROUP BY id), t AS (SELECT label AS id, arg_min(embedding, vec_id) AS vec FROM {{embeddings}} GROUP BY 1)
SELECT id, round({DOT.format('m.vec', 't.vec')} / sqrt({DOT.format('m.vec', 'm.vec')} * {DOT.format('t.vec', 't.vec')}), 5) AS cosine FROM m JOIN t USING (id)"""))
def alignment_cosine(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings").withColumnsRenamed({"label": "id", "embedding": "vec"})
    targets = e.groupBy("id").agg(F.min_by("vec", "vec_id").alias("vec"))
    return S.alignment_cosine(e, targets).select("id", F.round("cosine", 5).alias("cosine"))


COUNTS = "[{}]".format(", ".join(f"count(*) FILTER (freq = {i})" for i in range(1, 6)))


@query(sql(f"""WITH r AS (SELECT row_id AS id, {COUNTS} AS v FROM {{train}} GROUP BY 1), c AS (SELECT col_id AS id, {COUNTS} AS v FROM {{train}} GROUP BY 1)
SELECT t.row_id, t.col_id, t.freq, array_to_string(list_concat(r.v, r.v), ',') AS stacked, array_to_string([x + x FOR x IN r.v], ',') AS added,
array_to_string(flatten([[x * y FOR y IN c.v] FOR x IN r.v]), ',') AS outer_, array_to_string(list_concat(r.v, [9, 9, 9, 9, 9]), ',') AS replaced
FROM {{held}} t JOIN r ON r.id = t.row_id JOIN c ON c.id = t.col_id"""))
def pair_feature_rows(spark, sf_dir):
    """Views of rows and columns (how many of their cells hold each value): stacked views, their
    sum, outer products and a replaced view for the held-out pairs."""
    t = load(spark, sf_dir, "train")
    counts = lambda key: t.groupBy(F.col(key).alias("id")).agg(F.array(*[F.count_if(F.col("freq") == i) for i in range(1, 6)]).alias("vec"))
    rows = counts("row_id")
    both = S.pair_features_lookup(load(spark, sf_dir, "held"), S.stack_views([rows, rows]), counts("col_id"))
    text = lambda c: F.array_join(c, ",")
    one = F.slice("row_vec", 1, 5)
    new = F.array(*[F.lit(9).cast("long")] * 5)
    return both.select(
        "row_id", "col_id", "freq", text("row_vec").alias("stacked"), text(S.add_views("row_vec", 2)).alias("added"),
        text(S.outer_products(one, "col_vec")).alias("outer_"), text(S.replace_view(F.col("row_vec"), 1, 5, new)).alias("replaced"),
    )


@query(sql(f"""WITH t AS (SELECT DISTINCT s_nationkey AS source, s_suppkey AS target, s_suppkey % 5 AS relation FROM {{supplier}})
SELECT source, relation, target, round({DOT.format("[CAST(w[1] AS DOUBLE) * w[2] FOR w IN list_zip(a.vec, r.vec)]", "b.vec")}, 5) AS score FROM t
JOIN {{masked}} a ON a.id = source JOIN {{masked}} b ON b.id = target JOIN {{masked}} r ON r.id = relation"""))
def distmult_score(spark, sf_dir):
    t = load(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("source"), F.col("s_suppkey").alias("target"), (F.col("s_suppkey") % 5).alias("relation")).distinct()
    m = load(spark, sf_dir, "masked")
    return S.distmult_score(t, m, m).withColumn("score", F.round("score", 5))


@query(sql("""WITH e AS (SELECT DISTINCT l_suppkey AS source, l_returnflag AS relation, l_partkey AS target FROM {lineitem})
SELECT target, relation, CAST(i - 1 AS INT) AS pos, round(avg(CAST(vec[i] AS DOUBLE)), 5) + 0.0 AS value FROM e JOIN {masked} ON id = source, range(1, 65) r(i) GROUP BY 1, 2, 3"""))
def relational_mean(spark, sf_dir):
    e = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_returnflag").alias("relation"), F.col("l_partkey").alias("target")).distinct()
    return S.relational_mean(e, load(spark, sf_dir, "masked")).withColumn("value", F.round("value", 5) + 0.0)


@query(sql("""SELECT h.row_id, h.col_id, h.freq, CAST(130 AS INT) AS width, round(CASE WHEN a.available THEN CAST(a.vec[1] AS DOUBLE) ELSE 0 END, 5) AS first_, CAST(a.available AS INT) AS row_flag, 0 AS col_flag,
round(CASE WHEN a.available THEN CAST(a.vec[2] AS DOUBLE) ELSE 0.5 END, 5) AS filled
FROM {held} h JOIN {masked} a ON a.id = h.row_id JOIN {part_vectors} b ON b.id = h.col_id"""))
def pair_context(spark, sf_dir):
    m = load(spark, sf_dir, "masked")
    h = load(spark, sf_dir, "held")
    c = S.pair_context(h, m, load(spark, sf_dir, "part_vectors"), disable="col").join(m.select(F.col("id").alias("row_id"), "vec", "available"), "row_id")
    at = lambda i: F.element_at("context", i)
    filled = S.with_fallback(F.col("vec"), F.col("available"), [0.5] * 64)
    return c.select("row_id", "col_id", "freq", F.size("context").alias("width"), F.round(at(1), 5).alias("first_"), at(129).cast("int").alias("row_flag"), at(130).cast("int").alias("col_flag"), F.round(F.element_at(filled, 2), 5).alias("filled"))
