"""Named tables derived from the given ones, in SQL that Spark and DuckDB both read.

``load`` gives one as a DataFrame; ``sql`` gives a query text with what it needs before it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tessella.sources.scratch import importable

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

TABLES = {
    # Sparse two-way ratings: suppliers by parts, values 1 to 5; a fifth of the cells held out by hash.
    "triples": "SELECT l_suppkey AS row_id, l_partkey AS col_id, CAST(MAX(l_quantity) AS INT) % 5 + 1 AS freq FROM {lineitem} GROUP BY 1, 2",
    "cells": "SELECT row_id, col_id, freq, md5(concat('42:', row_id, ':', col_id)) AS ord FROM {triples}",
    "held": "SELECT row_id, col_id, freq FROM {cells} WHERE substr(ord, 1, 1) IN ('0', '1', '2')",
    "train": "SELECT row_id, col_id, freq FROM {cells} WHERE substr(ord, 1, 1) NOT IN ('0', '1', '2')",
    # Vectors with an availability mask, and vectors of parts.
    "masked": "SELECT CAST(vec_id AS INT) AS id, embedding AS vec, vec_id % 20 <> 0 AS available FROM {embeddings}",
    "part_vectors": "SELECT CAST(p_partkey AS INT) AS id, embedding AS vec, p_partkey % 20 <> 0 AS available FROM (SELECT p_partkey, p_partkey % n AS place FROM {part} CROSS JOIN (SELECT count(*) AS n FROM {embeddings})) JOIN {embeddings} ON vec_id = place",
    # Ordinal predictions, five classes.
    "scored": """SELECT o_orderkey AS id, CAST(substr(o_orderpriority, 1, 1) AS INT) AS label, o_custkey % 3 AS run, o_orderstatus AS grp,
      [[1, 2, 3, 4, 5]] AS ks FROM {orders}""",
    # A knowledge graph of parts (genes), brands (pathways), customers, suppliers, nations and segments.
    "kg_nodes": """SELECT concat('part:', p_partkey) AS node_id, 'gene' AS node_type, p_name AS name FROM {part}
      UNION ALL SELECT concat('supplier:', s_suppkey), 'drug', s_name FROM {supplier}
      UNION ALL SELECT concat('customer:', c_custkey), 'phenotype', c_name FROM {customer}
      UNION ALL SELECT DISTINCT concat('brand:', p_brand), 'pathway', p_brand FROM {part}
      UNION ALL SELECT concat('nation:', n_nationkey), 'drug_anchor', n_name FROM {nation}
      UNION ALL SELECT DISTINCT concat('segment:', c_mktsegment), 'side_anchor', c_mktsegment FROM {customer}""",
    "raw_edges": """SELECT concat('supplier:', l_suppkey) AS source, concat('part:', l_partkey) AS target, concat('TARGETS_', l_returnflag) AS relation,
        'drug' AS source_type, 'gene' AS target_type, concat('line', l_linenumber % 3) AS original_source FROM {lineitem}
      UNION ALL SELECT concat('brand:', p_brand), concat('part:', p_partkey), 'HAS_GENE', 'pathway', 'gene', 'part' FROM {part}
      UNION ALL SELECT concat('customer:', o_custkey), concat('part:', l_partkey), 'LINKED_GENE', 'phenotype', 'gene', concat('status', o_orderstatus)
        FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey
      UNION ALL SELECT concat('nation:', s_nationkey), concat('supplier:', s_suppkey), 'MAPS_TO', 'drug_anchor', 'drug', 'anchor' FROM {supplier}
      UNION ALL SELECT concat('segment:', c_mktsegment), concat('customer:', c_custkey), 'MAPS_TO', 'side_anchor', 'phenotype', 'anchor' FROM {customer}""",
    "gene_pairs": """SELECT DISTINCT a.l_partkey AS a, b.l_partkey AS b FROM {lineitem} a JOIN {lineitem} b
      ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey AND a.l_returnflag = b.l_returnflag AND a.l_linestatus = b.l_linestatus""",
    # Evidence of drugs (suppliers) and phenotypes (customers) by genes (parts) and pathways, with
    # anchors of some of them, both directions, repeats, loops, and relations that don't count.
    "evidence_edges": """SELECT concat('drug_anchor:', s_suppkey) AS source, concat('supplier:', s_suppkey) AS target, 'MAPS_TO_DRUG' AS relation, 'DRUG_ANCHOR' AS source_type, 'DRUG' AS target_type FROM {supplier} WHERE s_suppkey % 9 <> 4
      UNION ALL SELECT concat('drug_anchor:', s_suppkey), concat('supplier:', s_suppkey - 1), 'MAPS_TO_DRUG', 'DRUG_ANCHOR', 'DRUG' FROM {supplier} WHERE s_suppkey % 10 = 5
      UNION ALL SELECT concat('side_anchor:', c_custkey), concat('customer:', c_custkey), 'MAPS_TO_PHENOTYPE', 'SIDE_ANCHOR', 'PHENOTYPE' FROM {customer} WHERE c_custkey % 11 <> 7
      UNION ALL SELECT CASE WHEN l_orderkey % 2 = 0 THEN concat('supplier:', l_suppkey) ELSE concat('part:', l_partkey) END, CASE WHEN l_orderkey % 2 = 0 THEN concat('part:', l_partkey) ELSE concat('supplier:', l_suppkey) END,
        CASE l_linenumber % 5 WHEN 0 THEN 'ENZYME' WHEN 1 THEN 'TARGET' WHEN 2 THEN 'BINDS' WHEN 3 THEN 'adverse_drug_reaction_of' ELSE 'CARRIER' END, CASE WHEN l_orderkey % 2 = 0 THEN 'DRUG' ELSE 'GENE' END, CASE WHEN l_orderkey % 2 = 0 THEN 'GENE' ELSE 'DRUG' END FROM {lineitem}
      UNION ALL SELECT concat('customer:', o_custkey), concat('part:', l_partkey), CASE WHEN l_linenumber = 6 THEN 'LINKED' ELSE 'ASSOCIATED_WITH' END, 'PHENOTYPE', 'GENE' FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey
      UNION ALL SELECT concat('part:', p_partkey), concat('brand:', p_brand), 'INTERACTS_WITH', 'GENE', 'PATHWAY' FROM {part} WHERE p_size % 3 = 0
      UNION ALL SELECT concat('part:', a), concat('part:', b), 'INTERACTS_WITH', 'GENE', 'GENE' FROM {gene_pairs} UNION ALL SELECT concat('part:', b), concat('part:', a), 'INTERACTS_WITH', 'GENE', 'GENE' FROM {gene_pairs} WHERE (a + b) % 7 = 0
      UNION ALL SELECT concat('part:', p_partkey), concat('part:', p_partkey), 'INTERACTS_WITH', 'GENE', 'GENE' FROM {part} WHERE p_partkey % 50 = 0""",
    # Pairs to judge: suppliers and customers of an order line, and others.
    "evidence_pairs": """SELECT DISTINCT concat('drug_anchor:', l_suppkey) AS drug, concat('side_anchor:', CASE WHEN l_linenumber = 1 THEN o_custkey ELSE (o_custkey * 7 + l_suppkey) % n END) AS side
      FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey CROSS JOIN (SELECT count(*) AS n FROM {customer}) WHERE l_linenumber <= 2""",
    # Names to resolve: all parts. Names, synonyms and trade names come back a few times within
    # blocks of parts, so candidates grow with the parts; some synonyms are names of the next block.
    "named": """SELECT p_partkey, p_size, CASE WHEN p_partkey % 23 = 0 THEN concat(p_type, ' and more ', CAST(floor(p_partkey / 400) AS INT)) ELSE concat(p_name, ' ', CAST(floor(p_partkey / 200) AS INT)) END AS name,
      CASE WHEN p_partkey % 8 = 3 THEN concat(p_name, ' ', CAST(floor(p_partkey / 200) AS INT) + 1) ELSE concat(p_brand, ' ', CAST(floor(p_partkey / 100) AS INT)) END AS synonym, concat(p_type, ' ', CAST(floor(p_partkey / 20) AS INT)) AS trade_name,
      CASE WHEN p_size % 9 <> 0 THEN concat(p_brand, '/', p_size, '/', CAST(floor(p_partkey / 2000) AS INT)) END AS struct_key, concat(p_brand, '/', p_size % 50 + 1, '/', CAST(floor(p_partkey / 2000) AS INT)) AS more_key,
      CASE WHEN p_partkey % 4 <> 0 THEN concat('c', p_size, lower(p_type)) END AS second_key, CASE WHEN p_size % 16 = 0 THEN 'Protein' ELSE 'Small molecule' END AS node_type FROM {part}""",
    # Anchors by name (in capitals, or with dots for spaces), by synonym or trade name, with a
    # word of their own, or with the structure key of others.
    "anchors": """SELECT CAST(p_partkey AS INT) AS matrix_index, CASE WHEN p_partkey % 29 = 0 AND p_partkey % 23 <> 0 THEN concat('insulin ', name) WHEN p_partkey % 11 = 0 THEN synonym WHEN p_partkey % 13 = 0 THEN trade_name
      WHEN p_partkey % 3 = 0 THEN replace(name, ' ', '.') ELSE upper(name) END AS anchor_name, CASE WHEN p_partkey % 17 = 0 THEN more_key ELSE struct_key END AS anchor_key, CASE WHEN p_partkey % 5 = 0 THEN more_key END AS more_key FROM {named}""",
    "name_nodes": "SELECT concat('P', p_partkey) AS node_id, name, synonym, trade_name, struct_key, second_key, node_type FROM {named}",
    # Concepts of all parts, as names to resolve and as nodes of three ontologies; ids come back
    # within every 400 parts.
    "concept_terms": """SELECT CAST(p_partkey AS INT) AS matrix_index, name AS anchor_name, CASE WHEN p_partkey % 19 <> 0 THEN concat('C', lpad(CAST(p_partkey % 300 + 1000 * CAST(floor(p_partkey / 400) AS INT) AS STRING), 7, '0')) END AS concept_id FROM {named}""",
    "concept_nodes": """SELECT concat(CASE WHEN p_size > 30 THEN 'HP_' WHEN p_size > 25 THEN 'X_' ELSE 'meddra:' END, p_partkey) AS node_id, CASE WHEN p_size > 30 THEN 'HPO' WHEN p_size > 25 THEN p_type ELSE 'MEDDRA' END AS namespace,
      concat('UMLS:C', lpad(CAST(p_partkey % 400 + 1000 * CAST(floor(p_partkey / 400) AS INT) AS STRING), 7, '0')) AS c1, concat('c', lpad(CAST(p_partkey % 150 + 1000 * CAST(floor(p_partkey / 400) AS INT) AS STRING), 7, '0')) AS c2,
      CAST(p_partkey AS INT) AS number FROM {part}""",
    "ontology_candidates": "SELECT number - number % (1 + CAST(floor(number / 60) AS INT) % 6) AS matrix_index, node_id, namespace, CASE WHEN number % 2 = 0 THEN 'name;synonym' ELSE 'synonym' END AS fields FROM {concept_nodes}",
    # A dictionary of terms: entries of a concept, some with two concepts or two spellings.
    "dictionary": """SELECT concat('C', lpad(CAST(p_partkey % 250 + 1000 * CAST(floor(p_partkey / 400) AS INT) AS STRING), 7, '0')) AS concept_id, CAST(p_partkey - p_partkey % 3 AS STRING) AS entry_id, name AS term FROM {named} WHERE p_size > 20""",
    "history": """SELECT event_type AS model, CAST(day(ts) AS INT) AS epoch, round(avg(value), 4) AS metric FROM {events} GROUP BY 1, 2""",
    "labelled": "SELECT l.doc_id AS id, l.quality AS label, CAST(d.n_chars % 1000 AS DOUBLE) AS score FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id",
}
TABLES["scored"] = TABLES["scored"].replace("[[1, 2, 3, 4, 5]] AS ks", ", ".join(f"((o_orderkey * 7 + {k} * 13 + CAST(substr(o_orderpriority, 1, 1) AS INT) * 3) % 11 + 1) AS w{k}" for k in range(1, 6)))

_NAME = re.compile(r"\{(\w+)\}")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = TABLES[name]
    return spark.sql(text, **{n: load(spark, sf_dir, n) for n in set(_NAME.findall(text))})


def _needs(text: str, done: list[str]) -> list[str]:
    for n in _NAME.findall(text):
        if n not in BASE and n not in done:
            _needs(TABLES[n], done)
            done.append(n)
    return done


def sql(text: str) -> str:
    """DuckDB text in which {name} stands for a table given or derived."""
    order = _needs(text, [])
    plain = lambda t: _NAME.sub(r"\1", t)
    body = plain(text).strip()
    ctes = ", ".join(f"{n} AS ({plain(TABLES[n])})" for n in order)
    if not ctes:
        return body
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes}, {body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"
