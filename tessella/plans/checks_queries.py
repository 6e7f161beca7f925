"""Queries over contracts, scans and sinks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.operators import contracts as B
from tessella.operators import kg as E
from tessella.operators import meetings as M
from tessella.operators import resolve as D
from tessella.plans.analog import load, sql
from tessella.plans.graphs_queries import nearest
from tessella.plans.knowledge_queries import _edges, _nodes
from tessella.plans.registry import query
from tessella.plans.resolution_queries import KEYS
from tessella.plans.similarity_queries import COSINE, profile_layer, supplier_cosine
from tessella.plans.statistics_queries import rounded
from tessella.sources import tables as A
from tessella.sources.scratch import new_path, written


def C(name, passed, detail):
    return f"SELECT '{name}' AS \"check\", {passed} AS passed, CAST({detail} AS VARCHAR) AS detail"


@query(sql(" UNION ALL ".join([
    C("rows", "count(*) = 25", "count(*)") + " FROM {nation}", C("dense index", "min(n_nationkey) = 0 AND max(n_nationkey) = count(*) - 1 AND count(DISTINCT n_nationkey) = count(*)", "count(DISTINCT n_nationkey)") + " FROM {nation}",
    C("columns", "false", "'missing_one'"), C("unique", "count(*) = 0", "count(*)") + " FROM (SELECT l_orderkey FROM {lineitem} GROUP BY 1 HAVING count(*) > 1)",
    C("sentinel", "min(n_name) = 'ALGERIA'", "min(n_name)") + " FROM {nation} WHERE n_nationkey = 0", C("aligned", "true", "0"), C("subset", "true", "0"),
    C("domain", "count(*) = 0", "count(*)") + " FROM {lineitem} WHERE l_returnflag NOT IN ('A', 'N')", C("implies", "count(*) = 0", "count(*)") + " FROM {lineitem} WHERE l_quantity > 25 AND NOT l_extendedprice > 20000",
    C("finite", "count(*) = 0", "count(*)") + " FROM {lineitem} WHERE l_tax IS NULL OR l_discount IS NULL"])))
def table_contracts(spark, sf_dir):
    n, li = load(spark, sf_dir, "nation"), load(spark, sf_dir, "lineitem")
    return B.report(
        B.expect_rows(n, 25), B.expect_dense_index(n, "n_nationkey"), B.expect_columns(n, ["n_name", "missing_one"]), B.expect_unique(li, "l_orderkey"), B.expect_row(n, "n_nationkey", 0, "n_name", "ALGERIA"),
        B.expect_aligned(n, n, ["n_nationkey", "n_name"]), B.expect_subset(n.where("n_regionkey = 1"), n, "n_regionkey = 1"), B.expect_domain(li, "l_returnflag", ["A", "N"]),
        B.expect_implies(li, F.col("l_quantity") > 25, F.col("l_extendedprice") > 20000), B.finite_check(li, ["l_tax", "l_discount"]))


@query(sql(" UNION ALL ".join([
    C("counts", "true", "0"), C("sets", "true", "0"), C("anchor ids", "true", "0"), C("invariant: score", "bool_and(len(fields) > 0)", "''") + " FROM c1"]).join([f"WITH {KEYS} ", ""])))
def reconciliation(spark, sf_dir):
    a = load(spark, sf_dir, "anchors")
    c = D.match_names(a, load(spark, sf_dir, "name_nodes"))
    s = D.summarize_candidates(a, c)
    ids = a.withColumn("anchor_id", X.anchor_id("DRUG", F.col("matrix_index")))
    return B.report(B.reconcile_counts(s, c, "matrix_index", "candidate_count"), B.reconcile_sets(s, c, "matrix_index", "candidate_ids", "node_id"), B.anchor_order_check(ids, "DRUG"), B.invariant_check(c, {"score": F.length("fields") > 0}))


@query(sql("WITH " + "k AS (SELECT DISTINCT source, target, relation, source_type, target_type FROM {raw_edges}) " + " UNION ALL ".join([
    C("references", "count(*) = 0", "count(*)") + " FROM (SELECT source AS id FROM k UNION SELECT target FROM k) WHERE id NOT IN (SELECT node_id FROM {kg_nodes})", C("one type", "count(*) = 0", "count(*)") + " FROM (SELECT node_id FROM {kg_nodes} GROUP BY 1 HAVING count(DISTINCT node_type) > 1)",
    C("leakage: drug-phenotype", "count(*) = 0", "count(*)") + " FROM k WHERE (source_type = 'drug' AND target_type = 'phenotype') OR (source_type = 'phenotype' AND target_type = 'drug')", C("leakage: drug-gene", "count(*) = 0", "count(*)") + " FROM k WHERE (source_type = 'drug' AND target_type = 'gene') OR (source_type = 'gene' AND target_type = 'drug')",
    C("leakage: side_effect", "count(*) = 0", "count(*)") + " FROM k WHERE upper(relation) LIKE '%SIDE_EFFECT%'", C("leakage: targets", "count(*) = 0", "count(*)") + " FROM k WHERE upper(relation) LIKE '%TARGETS%'"])))
def leakage_scan(spark, sf_dir):
    e, n = _edges(spark, sf_dir), _nodes(spark, sf_dir)
    return B.report(B.missing_refs(e, n), B.conflicting_types(n), B.leakage_scan(e, [("drug", "phenotype"), ("gene", "drug")], ["side_effect", "targets"]))


@query(sql(" UNION ALL ".join([C("hidden cells", "count(*) = 0", "count(*)") + " FROM {held} h JOIN {train} t USING (row_id, col_id)", C("partition", "count(*) = (SELECT count(*) FROM {triples})", "count(*)") + " FROM (SELECT row_id, col_id FROM {train} UNION ALL SELECT row_id, col_id FROM {held})"])))
def partition_check(spark, sf_dir):
    t, h = load(spark, sf_dir, "train"), load(spark, sf_dir, "held")
    return B.report(B.hidden_cells_check(t, h), B.partition_check([t, h], load(spark, sf_dir, "triples"), ["row_id", "col_id"]))


TOLD = ", ".join(f"coalesce(concat(length(CAST({c} AS VARCHAR)), ':', CAST({c} AS VARCHAR)), 'null')" for c in ("l_extendedprice", "l_linenumber", "l_orderkey", "l_partkey", "l_quantity", "l_returnflag", "l_shipdate", "l_suppkey"))


@query(sql(f"""WITH h AS (SELECT md5(concat_ws('|', {TOLD})) AS h FROM {{lineitem}})
SELECT count(*) AS rows, CAST(sum(CAST(concat('0x', substr(h, 1, 8)) AS BIGINT)) AS BIGINT) AS first, CAST(sum(CAST(concat('0x', substr(h, 9, 8)) AS BIGINT)) AS BIGINT) AS second FROM h"""))
def table_fingerprint(spark, sf_dir):
    return B.table_fingerprint(load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate"))


@query(sql("SELECT relation, source_type, target_type, count(*) AS n FROM (SELECT DISTINCT source, target, relation, source_type, target_type FROM {raw_edges}) GROUP BY 1, 2, 3"))
def edge_profile(spark, sf_dir):
    return B.edge_profile(_edges(spark, sf_dir))


@query(sql("""WITH t AS (SELECT DISTINCT p_brand AS term FROM {part} WHERE p_size = 50), l AS (SELECT p_partkey, 'props.brand' AS path, p_brand AS v FROM {part} UNION ALL SELECT p_partkey, 'names[]', p_name FROM {part} UNION ALL SELECT p_partkey, 'names[]', lower(p_brand) FROM {part} WHERE p_size % 2 = 0)
SELECT p_partkey, term, string_agg(DISTINCT path, ';' ORDER BY path) AS paths FROM l JOIN t ON lower(v) = lower(term) GROUP BY 1, 2"""))
def search_leaves(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    nested = p.select("p_partkey", F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size")).alias("props"), F.when(F.col("p_size") % 2 == 0, F.array("p_name", F.lower("p_brand"))).otherwise(F.array("p_name")).alias("names"))
    return B.search_leaves(nested, "p_partkey", p.where("p_size = 50").select(F.col("p_brand").alias("term")).distinct())


@query(sql("SELECT * FROM (VALUES ('names[]', 'name'), ('props.brand', 'other'), ('props.inchi_key', 'structure'), ('trade_names[]', 'synonym'), ('xrefs[].id', 'identifier')) v(path, role), (SELECT count(*) AS parts FROM {part})"))
def field_roles(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    one = F.col("p_name")
    nested = p.select(F.array(one).alias("names"), F.struct(F.col("p_brand").alias("brand"), one.alias("inchi_key"), F.col("p_size").alias("size")).alias("props"), F.array(one).alias("trade_names"), F.array(F.struct(one.alias("id"))).alias("xrefs"))
    paths = spark.range(1).select(F.explode(F.array(*map(F.lit, B.text_leaf_paths(nested.schema)))).alias("path"))
    return B.infer_roles(paths).crossJoin(nested.agg(F.count("*").alias("parts")))


@query(sql(f"""WITH {COSINE}, j AS (SELECT a.*, coalesce(b.value, 0) AS o FROM sim a LEFT JOIN sim b ON a.src = b.dst AND a.dst = b.src)
SELECT count(*) AS stored, count(*) FILTER (src = dst) AS diagonal, min(value) AS min, max(value) AS max, round(sum(value) / 10000, 6) AS mean, round(sqrt(sum(value * value) / 10000 - power(sum(value) / 10000, 2)), 6) AS std, round(count(*) FILTER (value <> 0) / 10000, 6) AS density,
count(*) FILTER (abs(value - o) > 1e-8 + 1e-7 * abs(o)) AS asymmetric, 0 AS not_finite FROM j"""))
def matrix_profile(spark, sf_dir):
    return rounded(B.matrix_profile(supplier_cosine(spark, sf_dir), 100), "mean", "std", "density")


@query(sql(f"WITH {COSINE} SELECT src, dst, value FROM (SELECT src, dst, value * 4 AS value FROM sim UNION ALL SELECT s_suppkey, s_suppkey, 0.5 FROM {{supplier}}) WHERE CASE WHEN src = dst THEN abs(value - 1) > 1e-8 ELSE value < 0 OR value > 1 END ORDER BY src, dst LIMIT 20"))
def matrix_contract(spark, sf_dir):
    ids = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("src"), F.col("s_suppkey").alias("dst"), F.lit(0.5).alias("value"))
    return B.matrix_contract(supplier_cosine(spark, sf_dir).withColumn("value", F.col("value") * 4).unionByName(ids))


@query(sql(f"WITH {COSINE}, o AS (SELECT src, dst, value FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY value DESC, dst) AS r FROM sim) WHERE r <= 10) " + " UNION ALL ".join([C("index range", "count(*) = 0", "count(*)") + " FROM o WHERE src NOT BETWEEN 1 AND 90 OR dst NOT BETWEEN 1 AND 90", C("no self edge", "true", "0"), C("no double edge", "true", "0"), C("edges per source", "count(*) = 0", "count(*)") + " FROM (SELECT src FROM o GROUP BY 1 HAVING count(*) <> 10)", C("values", "true", "0")])))
def adjacency_contract(spark, sf_dir):
    layer = profile_layer(spark, sf_dir)
    top = written(nearest(layer, 10), "top-10")
    return B.report(B.adjacency_contract(top, 90, 10), B.value_match(top, M.pair_values({"value": layer}, top)))


@query(sql("SELECT min(label) AS low, max(label) AS high, true AS whole, '1..5' AS convention FROM {scored}"))
def label_base(spark, sf_dir):
    return B.label_base(load(spark, sf_dir, "scored"))


@query(sql("SELECT count(*) FILTER (p_size % 10 <> 0) AS good, count(*) FILTER (p_size % 10 = 0) AS bad, count(DISTINCT p_brand) FILTER (p_size % 10 <> 0) AS brands FROM {part}"))
def scan_tsv_malformed(spark, sf_dir):
    """A file of parts, some lines a column short, scanned once."""
    p = load(spark, sf_dir, "part")
    path = new_path(spark, "tsv")
    short = F.when(F.col("p_size") % 10 == 0, F.concat_ws("\t", "p_partkey", "p_brand")).otherwise(F.concat_ws("\t", "p_partkey", "p_brand", "p_size"))
    p.select(short.alias("value")).write.text(path)
    good, counts = A.scan_tsv(spark, path, ["id", "brand", "size"])
    return counts.crossJoin(good.agg(F.count_distinct("brand").alias("brands")))


@query(sql("SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, CASE WHEN p_size > 40 THEN NULL ELSE p_size * 1.5 END AS x FROM {part} WHERE p_size % 2 = 0"))
def csv_round_trip(spark, sf_dir):
    """Written as CSV with NaN as empty, and read back by name."""
    p = load(spark, sf_dir, "part").where("p_size % 2 = 0")
    path = new_path(spark, "csv")
    A.write_table(p.select(F.col("p_name").alias("name"), F.when(F.col("p_size") > 40, float("nan")).otherwise(F.col("p_size") * 1.5).alias("x"), F.col("p_partkey").alias("id")), path, ["id", "name", "x"])
    return A.read_csv(spark, path, ["id", "name", "x"]).withColumn("x", F.col("x").cast("double"))


@query(sql("SELECT 'p_brand' AS \"column\", 'brand' AS role, 1.0 AS share UNION ALL SELECT 'p_brand', 'number', 0.0 UNION ALL SELECT 'p_size', 'brand', 0.0 UNION ALL SELECT 'p_size', 'number', 1.0 FROM (SELECT count(*) FROM {part})"))
def detect_columns(spark, sf_dir):
    return A.detect_columns(load(spark, sf_dir, "part").select("p_brand", "p_size"), {"brand": "^Brand#", "number": "^[0-9]+$"})


@query(sql("SELECT row_id, col_id, CASE WHEN substr(ord, 1, 1) IN ('0', '1', '2') THEN 'test' ELSE 'train' END AS split FROM {cells}"))
def split_round_trip(spark, sf_dir):
    """A named split written by folder and read back."""
    c = load(spark, sf_dir, "cells")
    path = new_path(spark, "split")
    A.write_split(c.select("row_id", "col_id", F.when(F.substring("ord", 1, 1).isin("0", "1", "2"), "test").otherwise("train").alias("split")), path)
    return A.read_split(spark, path)


@query(sql("SELECT n_nationkey AS matrix_index, n_nationkey % 20 <> 0 AS available, CASE WHEN n_nationkey % 20 <> 0 THEN round(CAST(vec[1] AS DOUBLE), 5) ELSE 0 END AS first_, 64 AS width FROM {nation} JOIN {masked} ON id = n_nationkey"))
def embedding_export(spark, sf_dir):
    v = load(spark, sf_dir, "masked").where("available").withColumnRenamed("id", "matrix_index")
    out = A.embedding_export(load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("matrix_index")), v, 64)
    return out.select("matrix_index", "available", F.round(F.col("embedding")[0].cast("double"), 5).alias("first_"), F.size("embedding").alias("width"))


@query(sql("SELECT n_nationkey AS matrix_index, n_name AS name, concat('X', n_regionkey) AS external_id FROM {nation}"))
def ordered_table(spark, sf_dir):
    """A headerless table of names and outer ids, whose row order is a column."""
    path = new_path(spark, "ordered")
    load(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string"), "n_name", F.concat(F.lit("X"), "n_regionkey")).write.csv(path)
    return A.read_ordered(spark, path, "matrix_index string, name string, external_id string", "matrix_index")


@query(sql("SELECT concat('N', p_partkey) AS id, p_name AS name, p_brand AS brand, CAST(2 AS INT) AS synonyms FROM {part}"))
def nested_nodes(spark, sf_dir):
    """Nodes with nested properties and lists, written and read back."""
    path = new_path(spark, "nodes")
    p = load(spark, sf_dir, "part")
    p.select(F.concat(F.lit("N"), "p_partkey").alias("id"), F.struct(F.col("p_name").alias("name"), F.struct(F.col("p_brand").alias("brand")).alias("source"), F.array("p_type", "p_brand").alias("synonyms")).alias("properties")).write.parquet(path)
    return A.read_nodes(spark, path).select("id", "properties.name", "properties.source.brand", F.size("properties.synonyms").alias("synonyms"))


@query(sql("SELECT concat('N', p_partkey) AS id FROM {part} WHERE p_size <= 40"))
def pruned_ids(spark, sf_dir):
    """One column of a wider table, nulls dropped."""
    path = new_path(spark, "ids")
    p = load(spark, sf_dir, "part")
    p.select(F.when(F.col("p_size") <= 40, F.concat(F.lit("N"), "p_partkey")).alias("id"), "p_name", "p_type").write.parquet(path)
    return A.read_ids(spark, path)


@query(sql("SELECT CAST(l_orderkey AS VARCHAR) AS id, CAST(l_partkey AS VARCHAR) AS code, l_returnflag AS kind FROM {lineitem} WHERE l_returnflag = 'R'"))
def positional_tsv(spark, sf_dir):
    """A headerless positional file, kept where its type column fits."""
    path = new_path(spark, "positional")
    load(spark, sf_dir, "lineitem").select(F.concat_ws("\t", "l_orderkey", "l_partkey", "l_returnflag").alias("value")).write.text(path)
    return A.read_positional_tsv(spark, path, ["id", "code", "kind"], "kind", "R")


@query(sql("SELECT vec_id AS row_id, CAST(i - 1 AS INT) AS col_id, round(CAST(embedding[i] AS DOUBLE), 6) + 0.0 AS value FROM {embeddings}, range(1, 65) r(i)"))
def matrix_cells(spark, sf_dir):
    """Dense rows as a long table of cells."""
    return A.read_matrix(load(spark, sf_dir, "embeddings"), "vec_id", "embedding").withColumn("value", F.round(F.col("value").cast("double"), 6) + 0.0)


@query(sql("SELECT count(*) AS rows, true AS refused FROM {nation}"))
def write_once(spark, sf_dir):
    """Results are written once; a second write is refused and leaves the first as it was."""
    path, refused = new_path(spark, "once"), False
    n = load(spark, sf_dir, "nation")
    A.write_new(n, path)
    try:
        A.write_new(n.limit(1), path)
    except AnalysisException:
        refused = True
    return spark.read.parquet(path).agg(F.count("*").alias("rows")).withColumn("refused", F.lit(refused))


SPACES = "CASE WHEN p_size % 3 = 0 THEN concat('Hp_', p_partkey) WHEN p_size % 3 = 1 THEN concat('MedDRA:', p_partkey) ELSE concat('Z', p_partkey) END"


@query(sql(f"SELECT {SPACES} AS id, CASE WHEN p_size % 3 = 0 THEN 'HPO' WHEN p_size % 3 = 1 THEN 'MEDDRA' WHEN p_size > 25 THEN p_type ELSE 'OTHER' END AS namespace FROM {{part}}"))
def namespaces(spark, sf_dir):
    p = load(spark, sf_dir, "part").select(F.expr(SPACES).alias("id"), F.when(F.col("p_size") > 25, F.concat(F.lit(" "), "p_type")).otherwise(" ").alias("title"))
    return p.select("id", X.namespace(F.col("id"), F.col("title")).alias("namespace"))


@query(sql("""SELECT concat('S', l_suppkey) AS source, concat('P', l_partkey) AS target, CASE WHEN l_returnflag = 'N' THEN 'LINKED' ELSE l_returnflag END AS relation, 'drug' AS source_type, 'gene' AS target_type, 'lineitem' AS original_source, count(*) AS n FROM {lineitem} GROUP BY ALL
UNION ALL SELECT concat('B', p_brand), concat('P', p_partkey), 'HAS', 'pathway', 'gene', 'part', 1 FROM {part}"""))
def normalized_edges(spark, sf_dir):
    """Two families of raw edges in the common form."""
    li = load(spark, sf_dir, "lineitem").select(F.concat(F.lit("S"), "l_suppkey").alias("s"), F.concat(F.lit("P"), "l_partkey").alias("t"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).otherwise("").alias("r"))
    p = load(spark, sf_dir, "part").select(F.concat(F.lit("B"), "p_brand").alias("s"), F.concat(F.lit("P"), "p_partkey").alias("t"))
    a = E.normalize_edges(li, "s", "t", "drug", "gene", F.col("r"), "LINKED", F.lit("lineitem"))
    b = E.normalize_edges(p, "s", "t", "pathway", "gene", F.lit(None).cast("string"), "HAS", F.lit("part"))
    both = a.unionByName(b)
    return both.groupBy(*both.columns).agg(F.count("*").alias("n"))
