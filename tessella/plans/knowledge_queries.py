"""Queries over the knowledge graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import kg as E
from tessella.operators import stats as I
from tessella.plans.analog import load, sql
from tessella.plans.registry import query

TYPES = ("drug", "gene", "pathway", "phenotype", "drug_anchor", "side_anchor")
DEDUP = """e AS (SELECT source, target, relation, source_type, target_type, string_agg(DISTINCT original_source, '|' ORDER BY original_source) AS original_source FROM {raw_edges} GROUP BY ALL),
ix AS (SELECT node_id, node_type, row_number() OVER (ORDER BY CASE node_type WHEN 'drug' THEN 1 WHEN 'gene' THEN 2 WHEN 'pathway' THEN 3 WHEN 'phenotype' THEN 4 WHEN 'drug_anchor' THEN 5 ELSE 6 END, node_id) - 1 AS node_index FROM {kg_nodes}),
rel AS (SELECT relation, row_number() OVER (ORDER BY relation) - 1 AS i FROM (SELECT DISTINCT relation FROM e)),
ie AS (SELECT s.node_index AS source_index, t.node_index AS target_index, i AS relation_index, relation FROM e JOIN ix s ON s.node_id = source JOIN ix t ON t.node_id = target JOIN rel USING (relation))"""


def _edges(spark, sf_dir):
    return E.dedup_edges(load(spark, sf_dir, "raw_edges"))


def _nodes(spark, sf_dir):
    return load(spark, sf_dir, "kg_nodes")


@query(sql(f"WITH {DEDUP} SELECT * FROM e"))
def dedup_edges(spark, sf_dir):
    return _edges(spark, sf_dir)


@query(sql(f"WITH {DEDUP}, ids AS (SELECT DISTINCT source AS node_id FROM e WHERE source_type = 'drug' AND target LIKE '%7' UNION SELECT DISTINCT target FROM e WHERE target LIKE '%7') SELECT source, target, relation, original_source FROM e WHERE source IN (SELECT node_id FROM ids) AND target IN (SELECT node_id FROM ids)"))
def induced_subgraph(spark, sf_dir):
    e = _edges(spark, sf_dir)
    drugs = e.where("source_type = 'drug' and target like '%7'").select(F.col("source").alias("node_id"))
    ids = drugs.union(e.where("target like '%7'").select("target")).distinct()
    return E.induced(e, ids).select("source", "target", "relation", "original_source")


@query(sql(f"WITH {DEDUP} SELECT DISTINCT b.source AS node_id FROM e a JOIN e b ON b.target = a.target AND b.source_type = 'phenotype' WHERE a.source = 'brand:Brand#11'"))
def expand_neighbors(spark, sf_dir):
    """Pathway -> genes -> phenotypes, one hop each."""
    e = _edges(spark, sf_dir)
    start = e.where("source = 'brand:Brand#11'").select(F.col("source").alias("node_id")).distinct()
    return E.expand(e, E.expand(e, start, "gene"), "phenotype")


ANCH = "an AS (SELECT concat('A_', lpad(CAST(n_nationkey AS VARCHAR), 3, '0')) AS anchor_id, concat('[\"supplier:', n_nationkey + 1, '\",\"supplier:', n_nationkey * 1000, '\"]') AS node_ids FROM {nation})"


@query(sql(f"WITH {ANCH} SELECT anchor_id AS source, node_id AS target, 'ANCHORS' AS relation, 'drug_anchor' AS source_type, node_type AS target_type, 'anchor' AS original_source FROM an, unnest(CAST(from_json(node_ids, '[\"VARCHAR\"]') AS VARCHAR[])) u(nid) JOIN {{kg_nodes}} ON node_id = nid"))
def anchor_edges(spark, sf_dir):
    n = F.col("n_nationkey")
    a = load(spark, sf_dir, "nation").select(F.format_string("A_%03d", n).alias("anchor_id"), F.concat(F.lit('["supplier:'), n + 1, F.lit('","supplier:'), n * 1000, F.lit('"]')).alias("node_ids"))
    nodes = _nodes(spark, sf_dir)
    return E.anchor_edges(a, nodes.join(E.anchor_nodes(a, nodes), "node_id", "left_semi"), "ANCHORS", "drug_anchor")


@query(sql("SELECT DISTINCT concat('part:', p_partkey) AS node_id, 'gene' AS node_type, CASE WHEN p_size % 3 = 0 THEN p_name ELSE p_brand END AS name, CASE WHEN p_size % 2 = 0 THEN 'a;b' ELSE 'none' END AS origin FROM {part}"))
def project_nodes(spark, sf_dir):
    p = load(spark, sf_dir, "part").select(F.concat(F.lit("part:"), "p_partkey").alias("id"), F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_brand")).alias("symbol"), "p_name", "p_size")
    n = E.project_nodes(p, "gene", "id", "symbol", "p_name")
    even = F.col("p_size") % 2 == 0
    origin = E.provenance(F.when(even, F.array(F.lit("b"), F.lit(""))), F.when(even, F.array(F.lit("a"), F.lit("b"))), "none")
    return E.dedup_rows(n.join(p.select(F.col("id").alias("node_id"), origin.alias("origin")), "node_id"), ["node_id", "node_type"])


@query(sql(f"WITH {DEDUP} SELECT (SELECT count(*) FROM {{kg_nodes}}) AS nodes, (SELECT count(DISTINCT node_type) FROM {{kg_nodes}}) AS types, count(*) AS edges, count(DISTINCT relation) AS relations, (SELECT count(*) FROM {{kg_nodes}} WHERE node_type = 'drug_anchor' AND node_id NOT IN (SELECT source FROM e UNION SELECT target FROM e)) AS isolated_anchors FROM e"))
def graph_stats(spark, sf_dir):
    return E.graph_stats(_nodes(spark, sf_dir), _edges(spark, sf_dir), "drug_anchor")


@query(sql(f"WITH {DEDUP}, a AS (SELECT DISTINCT source AS anchor, target AS drug FROM e WHERE source_type = 'drug_anchor'), b AS (SELECT DISTINCT source AS drug, target AS gene FROM e WHERE source_type = 'drug'), c AS (SELECT DISTINCT source AS phenotype, target AS gene FROM e WHERE source_type = 'phenotype'), d AS (SELECT DISTINCT source AS side, target AS phenotype FROM e WHERE source_type = 'side_anchor') SELECT anchor, drug, gene, phenotype, side FROM a JOIN b USING (drug) JOIN c USING (gene) JOIN d USING (phenotype) ORDER BY ALL LIMIT 200"))
def typed_paths(spark, sf_dir):
    return E.typed_paths(_edges(spark, sf_dir), 200)


@query(sql(f"WITH {DEDUP} SELECT node_id, node_type, node_index FROM ix"))
def index_nodes(spark, sf_dir):
    return E.index_nodes(_nodes(spark, sf_dir), TYPES)


@query(sql(f"WITH {DEDUP} SELECT relation, i AS relation_index, false AS is_inverse FROM rel UNION ALL SELECT concat(relation, '__INV'), i + (SELECT count(*) FROM rel), true FROM rel"))
def index_relations(spark, sf_dir):
    return E.index_relations(_edges(spark, sf_dir))


def _indexed(spark, sf_dir):
    e = _edges(spark, sf_dir)
    r = E.index_relations(e)
    return E.index_edges(e, E.index_nodes(_nodes(spark, sf_dir), TYPES), r), r


@query(sql(f"WITH {DEDUP} SELECT source_index, target_index, relation_index, relation, false AS is_inverse FROM ie UNION ALL SELECT target_index, source_index, relation_index + (SELECT count(*) FROM rel), concat(relation, '__INV'), true FROM ie"))
def add_inverse(spark, sf_dir):
    return E.add_inverse(*_indexed(spark, sf_dir))


@query(sql(f"WITH {DEDUP}, t AS (SELECT source AS id FROM e UNION SELECT target FROM e) SELECT node_id, node_type, node_index, node_type IN ('drug_anchor', 'side_anchor') AS is_anchor, node_id IN (SELECT id FROM t) AS has_neighbor FROM ix"))
def node_metadata(spark, sf_dir):
    return E.node_metadata(E.index_nodes(_nodes(spark, sf_dir), TYPES), _edges(spark, sf_dir))


@query(sql(f"WITH {DEDUP} SELECT node_id, node_index, node_id IN (SELECT source FROM e WHERE relation = 'MAPS_TO' AND source_type = 'side_anchor') AS connected FROM ix WHERE node_type = 'side_anchor'"))
def anchor_index(spark, sf_dir):
    return E.anchor_index(E.index_nodes(_nodes(spark, sf_dir), TYPES), _edges(spark, sf_dir), "side_anchor", "MAPS_TO")


@query(sql(f"WITH {DEDUP} SELECT relation, count(*) AS edges, count(*) FILTER (source_index = target_index) AS self_edges, count(*) FILTER (EXISTS (SELECT 1 FROM ie b WHERE b.source_index = ie.target_index AND b.target_index = ie.source_index)) AS both_ways FROM ie GROUP BY 1"))
def graph_metadata(spark, sf_dir):
    return E.graph_metadata(_indexed(spark, sf_dir)[0])


TYPED = """ty AS MATERIALIZED (SELECT *, CASE WHEN contains(upper(relation), 'ADVERSE_DRUG_REACTION') OR contains(upper(relation), 'DRUG_PHENOTYPE') OR contains(upper(relation), 'SIDE_EFFECT') THEN 'forbidden' WHEN relation = 'MAPS_TO_DRUG' AND source_type = 'DRUG_ANCHOR' AND target_type = 'DRUG' THEN 'MAPS_TO_DRUG'
  WHEN relation = 'MAPS_TO_PHENOTYPE' AND source_type = 'SIDE_ANCHOR' AND target_type = 'PHENOTYPE' THEN 'MAPS_TO_PHENOTYPE' WHEN ((source_type = 'DRUG' AND target_type = 'GENE') OR (source_type = 'GENE' AND target_type = 'DRUG')) AND relation IN ('TARGET', 'ENZYME', 'TRANSPORTER', 'INHIBITOR', 'CARRIER', 'AGONIST', 'ANTAGONIST', 'BLOCKER',
  'POSITIVE_ALLOSTERIC_MODULATOR', 'NEGATIVE_ALLOSTERIC_MODULATOR', 'POSITIVE_MODULATOR', 'MODULATOR', 'PARTIAL_AGONIST', 'OPENER', 'ACTIVATOR', 'INVERSE_AGONIST') THEN 'Drug-Gene' WHEN source_type = 'GENE' AND target_type = 'GENE' AND relation = 'INTERACTS_WITH' THEN 'Gene-Gene'
  WHEN ((source_type = 'PATHWAY' AND target_type = 'GENE') OR (source_type = 'GENE' AND target_type = 'PATHWAY')) AND relation = 'INTERACTS_WITH' THEN 'Pathway-Gene' WHEN ((source_type = 'PHENOTYPE' AND target_type = 'GENE') OR (source_type = 'GENE' AND target_type = 'PHENOTYPE')) AND relation = 'ASSOCIATED_WITH' THEN 'Phenotype-Gene' ELSE 'ignored' END AS family FROM {evidence_edges})"""


@query(sql(f"""WITH {TYPED}, k AS (SELECT DISTINCT family, CASE WHEN family LIKE 'MAPS%' THEN source ELSE least(source, target) END AS a, CASE WHEN family LIKE 'MAPS%' THEN target ELSE greatest(source, target) END AS b FROM ty WHERE family NOT IN ('forbidden', 'ignored'))
SELECT family AS what, count(*) AS n FROM k GROUP BY 1 UNION ALL SELECT 'seen: forbidden', count(*) FROM ty WHERE family = 'forbidden' UNION ALL SELECT 'seen: ignored', count(*) FROM ty WHERE family = 'ignored' UNION ALL SELECT 'seen: identity', count(*) FROM ty WHERE family LIKE 'MAPS%'
UNION ALL SELECT 'seen: edges', count(*) FROM ty UNION ALL SELECT 'seen: evidence', count(*) FROM ty WHERE family LIKE '%-Gene' UNION ALL SELECT 'seen: duplicates', (SELECT count(*) FROM ty WHERE family LIKE '%-Gene') - (SELECT count(*) FROM k WHERE family LIKE '%-Gene')"""))
def typed_whitelist(spark, sf_dir):
    """Edges of each family, once each, and what a single scan saw."""
    kg, counts = I.typed_kg(load(spark, sf_dir, "evidence_edges"))
    seen = spark.createDataFrame([(f"seen: {k}", n) for k, n in counts.items()], "what string, n long")
    return kg.groupBy(F.col("family").alias("what")).agg(F.count("*").alias("n")).unionByName(seen)
