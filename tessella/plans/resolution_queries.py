"""Queries over names and entity resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.operators import resolve as D
from tessella.plans.analog import load, sql
from tessella.plans.registry import query
from tessella.sources.scratch import written

N = "trim(regexp_replace(lower({}), '\\s+', ' ', 'g'))"
KEYS = f"""keys AS (SELECT node_id, 'name' AS field, 3 AS w, {N.format('name')} AS k FROM {{name_nodes}} UNION ALL SELECT node_id, 'synonym', 2, {N.format('synonym')} FROM {{name_nodes}} UNION ALL SELECT node_id, 'trade_name', 1, {N.format('trade_name')} FROM {{name_nodes}}),
m1 AS (SELECT matrix_index, node_id, field, w FROM {{anchors}} JOIN keys ON k = {N.format('anchor_name')}),
c1 AS (SELECT matrix_index, node_id, string_agg(DISTINCT field, ';' ORDER BY field) AS fields, max(w) AS score FROM m1 GROUP BY 1, 2),
m2 AS (SELECT matrix_index, node_id, field, w FROM {{anchors}} a JOIN keys ON k = replace({N.format('anchor_name')}, '.', ' ') WHERE NOT EXISTS (SELECT 1 FROM m1 WHERE m1.matrix_index = a.matrix_index)),
c2 AS (SELECT matrix_index, node_id, string_agg(DISTINCT field, ';' ORDER BY field) AS fields, max(w) AS score FROM m2 GROUP BY 1, 2)"""
C = "c AS (SELECT *, 1 AS pass FROM c1 UNION ALL SELECT *, 2 FROM c2)"
TOP = """tp AS (SELECT matrix_index, pass, count(*) AS n, max(score) AS best FROM c GROUP BY 1, 2),
win AS (SELECT c.matrix_index, count(*) AS winners, min(node_id) AS one FROM c JOIN tp ON tp.matrix_index = c.matrix_index AND c.score = tp.best GROUP BY 1),
r AS (SELECT a.matrix_index, a.anchor_name, coalesce(n, 0) AS candidate_count, CASE WHEN winners = 1 THEN one END AS node_id,
  CASE WHEN winners IS NULL OR winners > 1 THEN NULL WHEN pass = 2 THEN 'dot_normalized_exact' WHEN n = 1 THEN 'unique_exact' WHEN best = 3 THEN 'canonical_name_disambiguation' WHEN best = 2 THEN 'synonym_disambiguation' ELSE 'trade_name_disambiguation' END AS method,
  CASE WHEN winners = 1 THEN 'resolved' WHEN winners > 1 THEN 'ambiguous' ELSE 'unmatched' END AS st FROM {anchors} a LEFT JOIN tp ON tp.matrix_index = a.matrix_index LEFT JOIN win ON win.matrix_index = a.matrix_index)"""
RESOLVED = f"{KEYS}, {C}, {TOP}"


@query(sql("SELECT matrix_index, " + N.format("anchor_name") + " AS plain, replace(" + N.format("anchor_name") + ", '.', ' ') AS dots, trim(regexp_replace(lower(anchor_name), '[^a-z0-9]+', ' ', 'g')) AS alnum, upper(trim(anchor_key)) AS key, CASE WHEN matrix_index % 2 = 0 THEN printf('C%07d', matrix_index) END AS cui, printf('DRUG_%03d', matrix_index) AS anchor_id, matrix_index % 2 = 0 AS even FROM {anchors}"))
def normalize_names(spark, sf_dir):
    a = load(spark, sf_dir, "anchors")
    cui = F.when(F.col("matrix_index") % 2 == 0, F.format_string("umls:c%07d", "matrix_index")).otherwise("none")
    flag = F.when(F.col("matrix_index") % 2 == 0, " Yes").otherwise("false")
    return a.select(
        "matrix_index", X.normalize_text("anchor_name").alias("plain"), X.normalize_dots("anchor_name").alias("dots"), X.normalize_alnum("anchor_name").alias("alnum"), X.normalize_key("anchor_key").alias("key"),
        X.extract_cui(cui).alias("cui"), X.anchor_id("DRUG", F.col("matrix_index")).alias("anchor_id"), X.parse_bool(flag).alias("even"),
    )


@query(sql(f"WITH {KEYS} SELECT matrix_index, node_id, fields FROM c1"))
def match_names(spark, sf_dir):
    return D.match_names(load(spark, sf_dir, "anchors"), load(spark, sf_dir, "name_nodes"))


@query(sql(f"""WITH {KEYS}, g AS (SELECT matrix_index, list(node_id ORDER BY node_id) AS ids FROM c1 GROUP BY 1) SELECT matrix_index, anchor_name, coalesce(len(ids), 0) AS candidate_count, CASE WHEN ids IS NULL THEN '[]' ELSE concat('["', array_to_string(ids, '","'), '"]') END AS candidate_ids,
CASE WHEN ids IS NULL THEN 'unmatched' WHEN len(ids) = 1 THEN 'unique_exact' ELSE 'ambiguous_exact' END AS mapping_status FROM {{anchors}} LEFT JOIN g USING (matrix_index)"""))
def candidate_summary(spark, sf_dir):
    a = load(spark, sf_dir, "anchors")
    return D.summarize_candidates(a, D.match_names(a, load(spark, sf_dir, "name_nodes")))


@query(sql(f"WITH {RESOLVED} SELECT matrix_index, anchor_name, node_id, candidate_count, method, CASE WHEN st = 'resolved' THEN 'high' END AS mapping_confidence, st AS resolution_status FROM r"))
def dot_fallback(spark, sf_dir):
    return D.resolve_with_fallback(load(spark, sf_dir, "anchors"), _candidates(spark, sf_dir))


IDENTITY = f"""{RESOLVED}, ci AS (SELECT c.matrix_index, c.score = tp.best AS top, upper(nullif(trim(struct_key), '')) AS k, nullif(trim(second_key), '') AS s FROM c JOIN tp USING (matrix_index) JOIN r USING (matrix_index) JOIN {{name_nodes}} nn ON nn.node_id = c.node_id WHERE r.st = 'ambiguous'),
same_k AS (SELECT DISTINCT matrix_index FROM ci WHERE top AND k IS NOT NULL GROUP BY matrix_index, k HAVING count(*) >= 2), same_s AS (SELECT DISTINCT matrix_index FROM ci WHERE top AND s IS NOT NULL GROUP BY matrix_index, s HAVING count(*) >= 2),
ig AS (SELECT matrix_index, count(*) AS candidate_count, count(*) FILTER (top) AS top_count, list(DISTINCT k ORDER BY k) FILTER (top AND k IS NOT NULL) AS ks, count(DISTINCT s) FILTER (top) AS second_count FROM ci GROUP BY 1),
idn AS (SELECT ig.*, CASE WHEN EXISTS (FROM same_k WHERE same_k.matrix_index = ig.matrix_index) THEN 'equivalent_by_inchikey' WHEN EXISTS (FROM same_s WHERE same_s.matrix_index = ig.matrix_index) THEN 'equivalent_by_smiles' WHEN len(ks) >= 2 OR second_count >= 2 THEN 'mixed_identity' ELSE 'insufficient_structure' END AS identity_class FROM ig)"""


def _candidates(spark, sf_dir):
    return written(D.match_with_fallback(load(spark, sf_dir, "anchors"), load(spark, sf_dir, "name_nodes")), "candidates")


def _identity(spark, sf_dir, candidates):
    """Candidates of ambiguous anchors with what the nodes hold, and their identity classes."""
    open_ = D.resolve_with_fallback(load(spark, sf_dir, "anchors"), candidates).where("resolution_status = 'ambiguous'").select("matrix_index")
    c = written(candidates.join(open_, "matrix_index").join(load(spark, sf_dir, "name_nodes").select("node_id", "name", "struct_key", "second_key"), "node_id"), "identity-candidates")
    return c, D.classify_identity(c.select("matrix_index").distinct(), c, "struct_key", "second_key")


@query(sql(f"""WITH {IDENTITY} SELECT matrix_index, candidate_count, top_count, identity_class, CASE WHEN ks IS NULL THEN '[]' ELSE concat('["', array_to_string(ks, '","'), '"]') END AS key_values, second_count FROM idn"""))
def classify_identity(spark, sf_dir):
    return _identity(spark, sf_dir, _candidates(spark, sf_dir))[1]


@query(sql("""WITH t AS (SELECT CAST(matrix_index AS BIGINT) AS id FROM {anchors}) SELECT t.id, count(l_partkey) AS rows, coalesce(string_agg(DISTINCT upper(l_returnflag), ',' ORDER BY upper(l_returnflag)), '') AS keys FROM t LEFT JOIN {lineitem} ON l_partkey = t.id GROUP BY 1"""))
def lookup_keys(spark, sf_dir):
    t = load(spark, sf_dir, "anchors").select(F.col("matrix_index").cast("long").alias("id"))
    return D.lookup_keys(load(spark, sf_dir, "lineitem"), t, "l_partkey", "l_returnflag").withColumn("keys", F.array_join("keys", ","))


STRUCT = f"""{IDENTITY}, ak AS (SELECT matrix_index, upper(trim(anchor_key)) AS k FROM {{anchors}} WHERE matrix_index % 7 <> 0 AND anchor_key IS NOT NULL UNION SELECT matrix_index, upper(trim(more_key)) FROM {{anchors}} WHERE matrix_index % 7 <> 0 AND more_key IS NOT NULL),
s AS (SELECT ak.matrix_index, nn.node_id, max(ak.k) AS k, EXISTS (FROM c1 WHERE c1.matrix_index = ak.matrix_index AND c1.node_id = nn.node_id) AS was FROM ak JOIN {{name_nodes}} nn ON upper(trim(nn.struct_key)) = ak.k GROUP BY ak.matrix_index, nn.node_id),
sg AS (SELECT matrix_index, count(*) AS n, count(DISTINCT k) AS d, list(node_id ORDER BY node_id) AS ids FROM s GROUP BY 1),
ss AS (SELECT a.matrix_index, a.matrix_index % 7 <> 0 AS structure_found, (SELECT count(*) FROM ak WHERE ak.matrix_index = a.matrix_index) AS key_count, coalesce(n, 0) AS match_count, coalesce(ids, []) AS ids,
  CASE WHEN a.matrix_index % 7 = 0 THEN 'stitch_not_found' WHEN n IS NULL THEN 'stitch_found_no_optimuskg_match' WHEN n = 1 THEN 'unique_structure_match' WHEN d = 1 THEN 'equivalent_structure_group' ELSE 'multiple_structure_matches' END AS structure_status FROM {{anchors}} a LEFT JOIN sg USING (matrix_index))"""


def _structure(spark, sf_dir, candidates):
    a, nodes = load(spark, sf_dir, "anchors"), load(spark, sf_dir, "name_nodes")
    own = F.array_distinct(F.filter(F.array(X.normalize_key("anchor_key"), X.normalize_key("more_key")), lambda k: k.isNotNull()))
    found = F.col("matrix_index") % 7 != 0
    keys = a.select("matrix_index", found.alias("found"), F.when(found, own).otherwise(F.array().cast("array<string>")).alias("keys"))
    return D.match_structure(keys, nodes, candidates.where("pass = 'exact'"))


@query(sql(f"WITH {STRUCT} SELECT matrix_index, structure_found, key_count, match_count, array_to_string(ids, ',') AS match_ids, structure_status FROM ss"))
def match_structure(spark, sf_dir):
    return _structure(spark, sf_dir, _candidates(spark, sf_dir))[1].withColumn("match_ids", F.array_join("match_ids", ","))


FUSE = f"""{STRUCT}, nm AS (SELECT matrix_index, list(DISTINCT node_id) AS ids FROM c1 GROUP BY 1),
f AS (SELECT r.matrix_index, r.anchor_name, r.st, r.node_id AS selected, r.method, coalesce(nm.ids, []) AS nids, ss.ids AS sids FROM r LEFT JOIN nm USING (matrix_index) JOIN ss USING (matrix_index)),
g AS (SELECT *, list_intersect(nids, sids) AS both_ FROM f),
fc AS (SELECT *, CASE WHEN st = 'resolved' AND list_contains(sids, selected) THEN 'confirmed_name_structure' WHEN st = 'resolved' AND len(sids) > 0 THEN 'conflicting_evidence' WHEN st = 'resolved' AND method = 'canonical_name_disambiguation' THEN 'supported_canonical_name' WHEN st = 'resolved' THEN 'name_only_resolved'
 WHEN st = 'ambiguous' AND len(sids) = 1 AND len(both_) = 1 THEN 'resolved_by_unique_structure_candidate' WHEN st = 'ambiguous' AND len(both_) = 1 THEN 'resolved_by_unique_intersection' WHEN st = 'ambiguous' THEN 'unresolved_ambiguous' WHEN len(sids) = 1 THEN 'structure_only_candidate' WHEN len(sids) > 1 THEN 'unresolved_ambiguous' ELSE 'unresolved_unmatched' END AS cls FROM g),
told AS (SELECT * FROM (VALUES ('confirmed_name_structure', 'very_high', 'resolved'), ('conflicting_evidence', 'review_required', 'review_required'), ('supported_canonical_name', 'high', 'resolved'), ('name_only_resolved', 'high', 'resolved'), ('resolved_by_unique_structure_candidate', 'very_high', 'resolved'),
 ('resolved_by_unique_intersection', 'very_high', 'resolved'), ('unresolved_ambiguous', 'review_required', 'unresolved'), ('structure_only_candidate', 'review_required', 'review_required'), ('unresolved_unmatched', 'unresolved', 'unresolved')) v(cls, confidence, final_status)),
fu AS (SELECT fc.*, confidence, final_status, CASE WHEN cls IN ('confirmed_name_structure', 'supported_canonical_name', 'name_only_resolved') THEN selected WHEN cls LIKE 'resolved_by%' THEN both_[1] WHEN cls = 'structure_only_candidate' THEN sids[1] ELSE '' END AS proposed_id FROM fc JOIN told USING (cls))"""


def _fused(spark, sf_dir, candidates):
    """The fused rows of all anchors, and the structure matches."""
    ids = candidates.where("pass = 'exact'").groupBy("matrix_index").agg(F.collect_set("node_id").alias("name_ids"))
    matches, structure = _structure(spark, sf_dir, candidates)
    matches = written(matches, "structure-matches")
    before = matches.where("was_candidate").groupBy("matrix_index").agg(F.collect_set("node_id").alias("previous_ids"))
    none = F.array().cast("array<string>")
    rows = D.resolve_with_fallback(load(spark, sf_dir, "anchors"), candidates).join(ids, "matrix_index", "left").join(structure.select("matrix_index", "match_ids"), "matrix_index").join(before, "matrix_index", "left")
    rows = rows.select("matrix_index", "anchor_name", F.col("resolution_status").alias("name_status"), F.col("node_id").alias("selected"), "method", F.coalesce("name_ids", none).alias("name_ids"), F.col("match_ids").alias("structure_ids"), F.coalesce("previous_ids", none).alias("previous_ids"))
    return written(D.fuse_evidence(rows), "fused"), matches


@query(sql(f"WITH {FUSE} SELECT matrix_index, cls AS evidence_class, proposed_id, confidence, final_status FROM fu"))
def fuse_evidence(spark, sf_dir):
    return _fused(spark, sf_dir, _candidates(spark, sf_dir))[0].select("matrix_index", "evidence_class", "proposed_id", "confidence", "final_status")


MERGE = f"""{FUSE}, op AS (SELECT * FROM fu WHERE final_status <> 'resolved'),
src AS (SELECT op.matrix_index, c1.node_id, c1.fields, 'name_candidate' AS source FROM op JOIN c1 USING (matrix_index) UNION ALL SELECT op.matrix_index, c.node_id, c.fields, 'identity_analysis' FROM op JOIN c USING (matrix_index) WHERE op.st = 'ambiguous'
 UNION ALL SELECT op.matrix_index, s.node_id, NULL, 'stitch_structure' FROM op JOIN s USING (matrix_index) UNION ALL SELECT matrix_index, selected, NULL, 'selected_name_mapping' FROM op WHERE selected IS NOT NULL),
mg AS (SELECT matrix_index, node_id, coalesce(array_to_string(list_sort(list_distinct(flatten(list(string_split(fields, ';')) FILTER (fields IS NOT NULL)))), ';'), '') AS fields, list_sort(list(DISTINCT source)) AS sources FROM src GROUP BY 1, 2)"""


def _merged(spark, sf_dir):
    """All fused rows, and the candidates from all sources of those that aren't resolved."""
    c = _candidates(spark, sf_dir)
    fused, matches = _fused(spark, sf_dir, c)
    f = fused.where("final_status <> 'resolved'")
    nodes = load(spark, sf_dir, "name_nodes").select("node_id", "name", F.col("struct_key").alias("key"), F.col("second_key").alias("second"), F.col("node_type").alias("type"))
    found, identity = _identity(spark, sf_dir, c)
    only = lambda df: df.join(f.select("matrix_index"), "matrix_index", "left_semi")
    own = found.select("matrix_index", "node_id", "fields", "name", F.col("struct_key").alias("key"), F.col("second_key").alias("second"))
    chosen = f.where("selected is not null").select("matrix_index", F.col("selected").alias("node_id"))
    parts = (only(c.where("pass = 'exact'")), only(own), only(matches.select("matrix_index", "node_id")), chosen)
    ids = f.select("matrix_index", F.explode(F.array_union("name_ids", "structure_ids")).alias("node_id"))
    merged = D.merge_candidates(nodes, ids, dict(zip(D.CANDIDATE_SOURCES, parts)))
    of = found.select("matrix_index", "node_id").join(identity.select("matrix_index", "identity_class"), "matrix_index")
    return fused, written(merged.join(of, ["matrix_index", "node_id"], "left"), "merged")


@query(sql(f"WITH {MERGE} SELECT matrix_index, node_id, nn.name, fields, array_to_string(sources, ',') AS sources FROM mg JOIN {{name_nodes}} nn USING (node_id)"))
def merge_candidates(spark, sf_dir):
    return _merged(spark, sf_dir)[1].select("matrix_index", "node_id", "name", "fields", F.array_join("evidence_sources", ",").alias("sources"))


A = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
TOKENS = "list_filter(string_split({}, ' '), lambda t: length(t) >= 4 AND t NOT IN (" + ", ".join(f"'{w}'" for w in X.FORM_WORDS) + "))"
BIO = " OR ".join(f"contains(an, '{w}')" for w in X.BIOLOGIC_TERMS)
TRIAGE = f"""{MERGE}, ca AS (SELECT mg.matrix_index, mg.node_id, list_contains(op.sids, mg.node_id) AS in_s, {A.format('op.anchor_name')} AS an, {A.format('nn.name')} AS cn, nn.name, nn.node_type, upper(nullif(trim(nn.struct_key), '')) AS k, nullif(trim(nn.second_key), '') AS se,
  CASE WHEN EXISTS (FROM c WHERE c.matrix_index = mg.matrix_index AND c.node_id = mg.node_id) THEN idn.identity_class END AS ic FROM mg JOIN op USING (matrix_index) JOIN {{name_nodes}} nn USING (node_id) LEFT JOIN idn ON idn.matrix_index = mg.matrix_index),
cr AS (SELECT *, cn <> '' AND (contains(cn, an) OR contains(an, cn) OR len(list_intersect({TOKENS.format('an')}, {TOKENS.format('cn')})) > 0) AS rel FROM ca),
cg AS (SELECT matrix_index, count(*) AS n, count(DISTINCT k) AS ks, count(DISTINCT se) AS ses, count(DISTINCT cn) AS names, bool_or(ic LIKE 'equivalent%') AS same, bool_or(ic = 'mixed_identity') AS mixed, bool_or(rel) AS rel, bool_or(rel AND in_s) AS rel_s, bool_or(node_type IN ('Antibody', 'Enzyme', 'Oligosaccharide', 'Protein')) AS bt,
  list_sort(list(node_id)) AS ids, list_sort(list(DISTINCT name)) AS all_names FROM cr GROUP BY 1),
tj AS (SELECT op.*, {A.format('op.anchor_name')} AS an, coalesce(n, 0) AS n, ks, ses, names, coalesce(same, false) AS same, coalesce(mixed, false) AS mixed, coalesce(rel, false) AS rel, coalesce(rel_s, false) AS rel_s, coalesce(bt, false) AS bt, coalesce(ids, []) AS ids, coalesce(all_names, []) AS all_names FROM op LEFT JOIN cg USING (matrix_index)),
tr AS (SELECT *, CASE WHEN contains(concat(' ', an, ' '), ' and ') THEN 'COMBINATION_DRUG' WHEN n = 0 THEN 'NO_OPTIMUSKG_NODE' WHEN cls = 'conflicting_evidence' AND rel_s THEN 'FORM_OR_SALT_AMBIGUITY' WHEN cls = 'conflicting_evidence' THEN 'TRUE_CONFLICT' WHEN n = 1 THEN 'SINGLE_HIGH_CONFIDENCE' WHEN same THEN 'SAFE_MULTI_NODE'
  WHEN ({BIO} OR bt) AND ks <= 1 AND ses <= 1 THEN 'BIOLOGIC_OR_PEPTIDE' WHEN (ks >= 2 OR ses >= 2 OR mixed) AND rel THEN 'FORM_OR_SALT_AMBIGUITY' WHEN ks >= 2 OR ses >= 2 OR mixed THEN 'TRUE_CONFLICT' WHEN names = 1 OR rel THEN 'SAFE_MULTI_NODE' WHEN {BIO} OR bt THEN 'BIOLOGIC_OR_PEPTIDE' ELSE 'TRUE_CONFLICT' END AS triage_class FROM tj)"""


def _triaged(spark, sf_dir):
    fused, candidates = _merged(spark, sf_dir)
    return fused, D.triage(fused.where("final_status <> 'resolved'"), candidates)


JSON = "CASE WHEN len({0}) = 0 THEN '[]' ELSE concat('[\"', array_to_string({0}, '\"{1}\"'), '\"]') END"


@query(sql(f"WITH {TRIAGE} SELECT matrix_index, anchor_name, triage_class, {JSON.format('ids', ',')} AS supported_ids, {JSON.format('all_names', ',')} AS supported_names, n AS candidate_count, triage_class IN ('FORM_OR_SALT_AMBIGUITY', 'TRUE_CONFLICT', 'NO_OPTIMUSKG_NODE') AS requires_review FROM tr"))
def triage(spark, sf_dir):
    return _triaged(spark, sf_dir)[1].drop("recommended_action")


@query(sql(f"""WITH {TRIAGE}, fa AS (SELECT fu.matrix_index, fu.anchor_name, fu.final_status = 'resolved' AS done, fu.cls, fu.confidence, tr.triage_class, CASE WHEN fu.final_status = 'resolved' THEN [fu.proposed_id] WHEN triage_class IN ('SAFE_MULTI_NODE', 'SINGLE_HIGH_CONFIDENCE', 'BIOLOGIC_OR_PEPTIDE', 'COMBINATION_DRUG') THEN tr.ids ELSE [] END AS ids FROM fu LEFT JOIN tr USING (matrix_index))
SELECT matrix_index, printf('ANCHOR_%03d', matrix_index) AS anchor_id, anchor_name, CASE WHEN triage_class = 'COMBINATION_DRUG' THEN 'combination_drug' WHEN triage_class = 'BIOLOGIC_OR_PEPTIDE' THEN 'biologic_or_peptide' ELSE 'drug' END AS entity_type, {JSON.format('ids', ', ')} AS node_ids, len(ids) AS node_count,
CASE WHEN done THEN concat('evidence_fusion:', cls) ELSE concat('triage:', triage_class) END AS mapping_source, CASE WHEN done THEN confidence WHEN len(ids) = 0 THEN 'review_required' WHEN triage_class = 'SINGLE_HIGH_CONFIDENCE' THEN 'very_high' ELSE 'high' END AS mapping_confidence,
CASE WHEN len(ids) = 0 THEN 'review_required' WHEN len(ids) = 1 THEN 'mapped_single' ELSE 'mapped_multi' END AS status, len(ids) = 0 AS requires_review FROM fa"""))
def final_anchors(spark, sf_dir):
    return D.build_anchors(load(spark, sf_dir, "anchors"), *_triaged(spark, sf_dir), "ANCHOR")


@query(sql(f"""WITH {TRIAGE}, l AS (SELECT unnest({list(("SAFE_MULTI_NODE", "SINGLE_HIGH_CONFIDENCE", "FORM_OR_SALT_AMBIGUITY", "BIOLOGIC_OR_PEPTIDE", "COMBINATION_DRUG", "TRUE_CONFLICT", "NO_OPTIMUSKG_NODE"))}) AS status) SELECT status, count(triage_class) AS n, round(100 * count(triage_class) / (SELECT count(*) FROM tr), 2) AS percent FROM l LEFT JOIN tr ON triage_class = status GROUP BY 1"""))
def coverage(spark, sf_dir):
    return D.coverage(_triaged(spark, sf_dir)[1], "triage_class", D.TRIAGE_CLASSES)


def _concepts(spark, sf_dir):
    return load(spark, sf_dir, "concept_terms"), load(spark, sf_dir, "concept_nodes")


MC = f"""t AS (SELECT * FROM {{concept_terms}}), nd AS (SELECT DISTINCT node_id, namespace, upper(replace(replace(cc, 'UMLS:', ''), 'umls:', '')) AS cui FROM (SELECT node_id, namespace, unnest([c1, c2]) AS cc FROM {{concept_nodes}})),
mg AS (SELECT matrix_index, count(*) AS n, count(*) FILTER (namespace = 'MEDDRA') AS p, count(*) FILTER (namespace = 'HPO') AS q, min(node_id) FILTER (namespace = 'MEDDRA') AS one, list(node_id ORDER BY node_id) AS ids FROM t JOIN nd ON concept_id = cui GROUP BY 1),
mc AS (SELECT t.matrix_index, coalesce(concept_id, '') AS concept_id, coalesce(n, 0) AS match_count, coalesce(p, 0) AS preferred_count, coalesce(q, 0) AS second_count, CASE WHEN p = 1 THEN one WHEN n = 1 THEN ids[1] ELSE '' END AS canonical_id,
  CASE WHEN p = 1 THEN list_filter(ids, lambda x: x <> one) WHEN n = 1 THEN [] ELSE coalesce(ids, []) END AS alias, CASE WHEN concept_id IS NULL THEN 'no_sider_umls' WHEN n IS NULL THEN 'umls_no_optimuskg_match' WHEN n = 1 AND p = 1 THEN 'umls_unique_meddra' WHEN p = 1 THEN 'umls_meddra_with_aliases' WHEN n = 1 THEN 'umls_unique_other' ELSE 'umls_multiple_no_unique_meddra' END AS mapping_status FROM t LEFT JOIN mg USING (matrix_index))"""


def _mapped(spark, sf_dir):
    t, n = _concepts(spark, sf_dir)
    return D.match_concepts(t, n, ("c1", "c2"))


@query(sql(f"WITH {MC} SELECT matrix_index, concept_id, match_count, preferred_count, second_count, canonical_id, {JSON.format('alias', ',')} AS alias_ids, mapping_status FROM mc"))
def concept_match(spark, sf_dir):
    return _mapped(spark, sf_dir)


@query(sql(f"""WITH {MC}, x AS (SELECT matrix_index, CASE WHEN matrix_index % 4 > 0 THEN concat('meddra:', matrix_index) END AS name_id, CASE WHEN preferred_count = 1 THEN nullif(canonical_id, '') END AS concept_node FROM mc)
SELECT *, CASE WHEN name_id = concept_node THEN 'name_and_umls_agree' WHEN name_id IS NOT NULL AND concept_node IS NOT NULL THEN 'name_and_umls_conflict' WHEN concept_node IS NOT NULL THEN 'umls_only' WHEN name_id IS NOT NULL THEN 'name_only' ELSE '' END AS outcome FROM x"""))
def crosscheck(spark, sf_dir):
    t, _ = _concepts(spark, sf_dir)
    by_name = t.select("matrix_index", F.when(F.col("matrix_index") % 4 > 0, F.concat(F.lit("meddra:"), "matrix_index")).alias("node_id"))
    return D.crosscheck(by_name, _mapped(spark, sf_dir).select("matrix_index", F.when(F.col("preferred_count") == 1, F.col("canonical_id")).alias("node_id")))


ENTRY = f"""{MC}, dc AS (SELECT concept_id, list(DISTINCT entry_id ORDER BY entry_id) AS es, max(term) AS term FROM {{dictionary}} GROUP BY 1), dn AS (SELECT lower(term) AS k, list(DISTINCT entry_id ORDER BY entry_id) AS es, max(term) AS term FROM {{dictionary}} GROUP BY 1),
e1 AS (SELECT t.matrix_index, coalesce(dc.es, []) AS c, coalesce(dn.es, []) AS n, dc.term AS ct, dn.term AS nt FROM t LEFT JOIN dc ON dc.concept_id = t.concept_id LEFT JOIN dn ON dn.k = lower(t.anchor_name)),
e2 AS (SELECT *, CASE WHEN len(c) = 1 THEN c[1] WHEN len(n) = 1 THEN n[1] ELSE '' END AS entry_id, CASE WHEN len(c) = 1 THEN ct WHEN len(n) = 1 THEN nt ELSE '' END AS entry_name, CASE WHEN len(c) = 1 THEN 'sider_umls_pt' WHEN len(n) = 1 THEN 'exact_meddra_pt_name' ELSE '' END AS mapping_method FROM e1),
e3 AS (SELECT e2.*, entry_id <> '' AND concat('meddra:', entry_id) IN (SELECT node_id FROM {{concept_nodes}}) AS has, list_sort(list_filter(CASE WHEN mc.canonical_id = '' THEN mc.alias ELSE list_append(mc.alias, mc.canonical_id) END, lambda x: NOT starts_with(lower(x), 'meddra:'))) AS alias FROM e2 JOIN mc USING (matrix_index)),
en AS (SELECT matrix_index, entry_id, entry_name, CASE WHEN has THEN concat('meddra:', entry_id) ELSE '' END AS canonical_id, alias, mapping_method, CASE WHEN entry_id <> '' AND NOT has THEN 'meddra_resolved_but_not_in_optimuskg' WHEN entry_id <> '' AND len(alias) > 0 THEN 'meddra_with_hpo_alias'
  WHEN mapping_method = 'sider_umls_pt' THEN 'meddra_by_umls' WHEN mapping_method <> '' THEN 'meddra_by_name' WHEN len(list_distinct(list_concat(c, n))) > 1 THEN 'ambiguous_meddra' ELSE 'unresolved' END AS mapping_status FROM e3)"""


def _entries(spark, sf_dir):
    t, n = _concepts(spark, sf_dir)
    return D.resolve_dictionary(t, load(spark, sf_dir, "dictionary"), n, _mapped(spark, sf_dir))


@query(sql(f"WITH {ENTRY} SELECT matrix_index, entry_id, entry_name, canonical_id, {JSON.format('alias', ',')} AS alias_ids, mapping_method, mapping_status, mapping_status IN ('ambiguous_meddra', 'meddra_resolved_but_not_in_optimuskg', 'unresolved') AS requires_review FROM en"))
def dictionary_resolution(spark, sf_dir):
    return _entries(spark, sf_dir)


@query(sql(f"""WITH t AS (SELECT * FROM {{concept_terms}}), dd AS (SELECT lower(name) AS k, CASE WHEN p_partkey % 2 = 0 THEN upper(name) ELSE name END AS term, printf('C%07d', p_size) AS cid FROM {{named}} WHERE p_size BETWEEN 20 AND 40),
g AS (SELECT matrix_index, count(*) AS n, list(DISTINCT cid ORDER BY cid) AS ids, list(DISTINCT term) AS terms FROM t JOIN dd ON k = lower(anchor_name) GROUP BY 1), h AS (SELECT matrix_index, list(term ORDER BY lower(term), term) AS terms FROM (SELECT matrix_index, unnest(terms) AS term FROM g) GROUP BY 1)
SELECT matrix_index, n IS NOT NULL AS found, coalesce(n, 0) AS row_count, coalesce(len(ids), 0) AS concept_count, CASE WHEN ids IS NULL THEN '[]' ELSE concat('["', array_to_string(ids, '", "'), '"]') END AS concept_ids, CASE WHEN ids IS NULL THEN '[]' ELSE concat('["', array_to_string(h.terms, '", "'), '"]') END AS matched_names,
CASE WHEN ids IS NULL THEN 'unmatched' WHEN len(ids) = 1 THEN 'unique_umls' ELSE 'multiple_umls' END AS mapping_status FROM t LEFT JOIN g USING (matrix_index) LEFT JOIN h USING (matrix_index)"""))
def recover_concepts(spark, sf_dir):
    t, _ = _concepts(spark, sf_dir)
    d = load(spark, sf_dir, "named").where("p_size between 20 and 40").select(F.when(F.col("p_partkey") % 2 == 0, F.upper("name")).otherwise(F.col("name")).alias("term"), F.format_string("C%07d", "p_size").alias("concept_id"))
    return D.recover_concepts(t, d)


SIDE = """tt AS (SELECT * FROM {concept_terms}), oc AS (SELECT * FROM {ontology_candidates}), og AS (SELECT matrix_index, count(*) AS n, count(*) FILTER (namespace = 'MEDDRA' AND fields LIKE 'name%') AS p, count(*) FILTER (namespace <> 'MEDDRA' AND fields LIKE 'name%') AS o, count(*) FILTER (namespace = 'MEDDRA') AS own, count(*) FILTER (namespace = 'HPO') AS hp,
  max(node_id) FILTER (namespace = 'MEDDRA' AND fields LIKE 'name%') AS one, list(node_id ORDER BY node_id) AS ids FROM oc GROUP BY 1),
ol AS (SELECT tt.matrix_index, coalesce(n, 0) AS candidate_count, coalesce(own, 0) AS preferred_count, coalesce(hp, 0) AS second_count, CASE WHEN p = 1 THEN one ELSE '' END AS preferred_id, coalesce(ids, []) AS ids,
  CASE WHEN n IS NULL THEN 'unmatched' WHEN p > 1 THEN 'multiple_meddra_exact_name' WHEN p = 1 AND own < n THEN 'meddra_exact_with_other_ontology_candidates' WHEN p = 1 THEN 'unique_meddra_exact_name' WHEN o = 1 THEN 'unique_other_exact_name' WHEN o = 0 THEN 'exact_synonym_only' ELSE 'ambiguous_exact' END AS mapping_status FROM tt LEFT JOIN og USING (matrix_index))"""


def _ontology(spark, sf_dir):
    return D.classify_ontology(load(spark, sf_dir, "concept_terms"), load(spark, sf_dir, "ontology_candidates"))


@query(sql(f"WITH {SIDE} SELECT matrix_index, candidate_count, preferred_count, second_count, preferred_id, {JSON.format('ids', ',')} AS candidate_ids, mapping_status FROM ol"))
def classify_ontology(spark, sf_dir):
    return _ontology(spark, sf_dir)


def _other_names(spark, sf_dir):
    """Name candidates of anchors that the fallback may take: none of the dictionary's own."""
    own = F.col("candidate_ids").contains("meddra:") & (F.col("candidate_count") == 1)
    return _ontology(spark, sf_dir).where(~own)


@query(sql(f"""WITH {ENTRY}, {SIDE}, k AS (SELECT t.matrix_index, entry_id, canonical_id AS own, alias, mapping_method, CASE WHEN entry_id = '' AND ol.mapping_status IN ('unique_other_exact_name', 'exact_synonym_only') AND len(ol.ids) = 1 AND NOT starts_with(ol.ids[1], 'meddra:') THEN ol.ids[1] END AS other, ol.mapping_status AS ns FROM t JOIN en USING (matrix_index) JOIN ol USING (matrix_index)),
m AS (SELECT *, CASE WHEN entry_id <> '' THEN own ELSE coalesce(other, '') END AS canonical_id, CASE WHEN entry_id <> '' OR other IS NOT NULL THEN alias ELSE [] END AS aliases FROM k),
z AS (SELECT *, len(list_distinct(list_filter(list_append(aliases, canonical_id), lambda x: x <> ''))) AS nodes, CASE WHEN entry_id <> '' THEN CASE WHEN len(alias) > 0 THEN 'meddra_with_alias_kg' WHEN own <> '' THEN 'canonical_meddra_with_kg' ELSE 'external_meddra_only' END WHEN other IS NOT NULL THEN 'exact_other_ontology' ELSE 'no_kg_evidence' END AS status FROM m)
SELECT matrix_index, printf('SIDE_%03d', matrix_index) AS anchor_id, entry_id, canonical_id, {JSON.format('aliases', ',')} AS alias_ids, nodes AS node_count, CASE WHEN entry_id <> '' THEN mapping_method WHEN other IS NULL THEN 'none' WHEN ns = 'unique_other_exact_name' THEN 'step12_unique_exact_name' ELSE 'step12_unique_exact_synonym' END AS identity_source,
CASE WHEN entry_id <> '' OR other IS NOT NULL THEN 'high' ELSE 'none' END AS mapping_confidence, status, nodes > 0 AS has_node, status IN ('external_meddra_only', 'no_kg_evidence') AS requires_review FROM z"""))
def final_side_anchors(spark, sf_dir):
    return D.build_side_anchors(load(spark, sf_dir, "concept_terms"), _other_names(spark, sf_dir), _entries(spark, sf_dir), "SIDE")
