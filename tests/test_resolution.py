"""Resolution rules on literal rows, one for each branch."""

import json

import pytest
from pyspark.sql import functions as F

from tessella.operators import resolve as D


def by_index(df, *columns):
    return {r.matrix_index: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}


def test_strict_top_names_the_evidence(spark):
    rows = [
        (1, "a", "trade_name"), (2, "a", "name;synonym"), (2, "b", "synonym"), (3, "a", "synonym"), (3, "b", "trade_name"), (4, "a", "trade_name"), (4, "b", "other"),
        (5, "a", "name"), (5, "b", "name;synonym"),
    ]
    got = by_index(D.resolve_strict_top(spark.createDataFrame(rows, "matrix_index int, node_id string, fields string")), "node_id", "candidate_count", "method")
    assert got == {1: ("a", 1, "unique_exact"), 2: ("a", 2, "canonical_name_disambiguation"), 3: ("a", 2, "synonym_disambiguation"), 4: ("a", 2, "trade_name_disambiguation"), 5: (None, 2, None)}


def test_second_pass_has_its_own_method(spark):
    anchors = spark.createDataFrame([(1, "a.b"), (2, "x"), (3, "none"), (4, "y.z")], "matrix_index int, anchor_name string")
    nodes = spark.createDataFrame([("n1", "A B", None, None), ("n2", "x", None, None), ("n3", "y z", None, None), ("n4", "Y  Z", None, None)], "node_id string, name string, synonym string, trade_name string")
    got = by_index(D.resolve_with_fallback(anchors, D.match_with_fallback(anchors, nodes)), "node_id", "method", "mapping_confidence", "resolution_status")
    assert got == {1: ("n1", "dot_normalized_exact", "high", "resolved"), 2: ("n2", "unique_exact", "high", "resolved"), 3: (None, None, None, "unmatched"), 4: (None, None, None, "ambiguous")}


def test_identity_of_top_candidates(spark):
    rows = [
        (1, "a", "name", "K", "s"), (1, "b", "name", " k ", "t"), (1, "c", "name", "", None),  # two share a key
        (2, "a", "name", None, "s"), (2, "b", "name", "", "s"),  # second keys
        (3, "a", "name", "K", None), (3, "b", "name", "L", None), (3, "c", "synonym", "K", None),  # the third doesn't count
        (4, "a", "name", "K", "s"),  # one alone
        (5, "a", "name", "", "s"), (5, "b", "name", "", "S"),  # case counts in second keys
    ]
    anchors = spark.createDataFrame([(i,) for i in range(1, 7)], "matrix_index int")
    got = by_index(D.classify_identity(anchors, spark.createDataFrame(rows, "matrix_index int, node_id string, fields string, k string, s string"), "k", "s"), "candidate_count", "top_count", "identity_class")
    assert got == {1: (3, 3, "equivalent_by_inchikey"), 2: (2, 2, "equivalent_by_smiles"), 3: (3, 2, "mixed_identity"), 4: (1, 1, "insufficient_structure"), 5: (2, 2, "mixed_identity"), 6: (0, 0, "insufficient_structure")}


def test_structure_statuses(spark):
    keys = spark.createDataFrame([(1, False, []), (2, True, ["Z"]), (3, True, ["A"]), (4, True, ["B"]), (5, True, ["A", "B"]), (6, True, [])], "matrix_index int, found boolean, keys array<string>")
    nodes = spark.createDataFrame([("n1", "a "), ("n2", "b"), ("n3", "B"), ("n4", None)], "node_id string, struct_key string")
    matches, summary = D.match_structure(keys, nodes, spark.createDataFrame([(3, "n1"), (3, "n1")], "matrix_index int, node_id string"))
    assert by_index(summary, "match_count", "structure_status") == {
        1: (0, "stitch_not_found"), 2: (0, "stitch_found_no_optimuskg_match"), 3: (1, "unique_structure_match"), 4: (2, "equivalent_structure_group"), 5: (3, "multiple_structure_matches"), 6: (0, "stitch_found_no_optimuskg_match"),
    }
    assert {(r.matrix_index, r.node_id) for r in matches.where("was_candidate").collect()} == {(3, "n1")}


def test_unique_structure_candidates_must_have_been_candidates(spark):
    df = spark.createDataFrame([("ambiguous", None, None, ["a", "b"], ["b"], [])], "name_status string, selected string, method string, name_ids array<string>, structure_ids array<string>, previous_ids array<string>")
    with pytest.raises(Exception, match="no name candidate"):
        D.fuse_evidence(df).collect()


def test_merged_candidates_join_fields_and_keep_the_last_value(spark):
    nodes = spark.createDataFrame([("a", "own", "K", ""), ("b", "b", None, "s")], "node_id string, name string, key string, second string")
    first = spark.createDataFrame([(1, "a", "name;synonym", "first", "")], "matrix_index int, node_id string, fields string, name string, key string")
    second = spark.createDataFrame([(1, "a", "trade_name;name", None, "[]")], "matrix_index int, node_id string, fields string, name string, key string")
    out = D.merge_candidates(nodes, spark.createDataFrame([(1, "b"), (2, "c")], "matrix_index int, node_id string"), {"x": first, "y": second})
    got = {(r.matrix_index, r.node_id): (r.name, r.key, r.second, r.fields, r.evidence_sources) for r in out.collect()}
    assert got == {(1, "a"): ("first", "K", None, "name;synonym;trade_name", ["x", "y"]), (1, "b"): ("b", None, "s", "", []), (2, "c"): (None, None, None, "", [])}


C = "matrix_index int, node_id string, name string, type string, key string, second string, identity_class string"
F_ = "matrix_index int, anchor_name string, evidence_class string, structure_ids array<string>, final_status string, proposed_id string, confidence string"
TRIAGED = [
    ("salt and water", "unresolved_ambiguous", [], [("a", "salt", "", "K", "", "")], "COMBINATION_DRUG", "combination"),
    ("nothing", "unresolved_unmatched", [], [], "NO_OPTIMUSKG_NODE", "no node"),
    ("aspirin", "conflicting_evidence", ["b"], [("a", "aspirin", "", "K", "", ""), ("b", "Aspirin calcium", "", "L", "", "")], "FORM_OR_SALT_AMBIGUITY", "related structure"),
    ("aspirin", "conflicting_evidence", ["b"], [("a", "aspirin", "", "K", "", ""), ("b", "ibuprofen", "", "L", "", "")], "TRUE_CONFLICT", "discordant"),
    ("aspirin", "structure_only_candidate", ["a"], [("a", "other", "", "K", "", "")], "SINGLE_HIGH_CONFIDENCE", "single"),
    ("x", "unresolved_ambiguous", [], [("a", "p", "", "K", "s", "equivalent_by_smiles"), ("b", "q", "", "L", "t", "")], "SAFE_MULTI_NODE", "equivalent"),
    ("insulin lispro", "unresolved_ambiguous", [], [("a", "p", "", "", "", ""), ("b", "q", "", "", "", "")], "BIOLOGIC_OR_PEPTIDE", "biologic"),
    ("x", "unresolved_ambiguous", [], [("a", "p", "Enzyme", "", "", ""), ("b", "q", "", "", "", "")], "BIOLOGIC_OR_PEPTIDE", "biologic"),
    ("codeine", "unresolved_ambiguous", [], [("a", "codeine phosphate", "", "K", "", ""), ("b", "q", "", "L", "", "")], "FORM_OR_SALT_AMBIGUITY", "related forms"),
    ("zzz", "unresolved_ambiguous", [], [("a", "p", "", "K", "", ""), ("b", "q", "", "L", "", "")], "TRUE_CONFLICT", "different"),
    ("zzz", "unresolved_ambiguous", [], [("a", "p", "", "", "", "mixed_identity"), ("b", "q", "", "", "", "")], "TRUE_CONFLICT", "different"),
    ("zzz", "unresolved_ambiguous", [], [("a", "Same", "", "", "", ""), ("b", "same", "", "", "", "")], "SAFE_MULTI_NODE", "compatible"),
    ("zzz", "unresolved_ambiguous", [], [("a", "p", "", "", "", ""), ("b", "q", "", "", "", "")], "TRUE_CONFLICT", "insufficient"),
    ("insulin", "unresolved_ambiguous", [], [("a", "p", "", "K", "", "mixed_identity"), ("b", "q", "", "K", "", "")], "BIOLOGIC_OR_PEPTIDE", "biologic"),
]


def triaged(spark):
    fused = [(i, t[0], t[1], t[2], "unresolved", "", "review_required") for i, t in enumerate(TRIAGED)]
    rows = [(i, *c) for i, t in enumerate(TRIAGED) for c in t[3]]
    fused = spark.createDataFrame(fused, F_)
    return fused, D.triage(fused, spark.createDataFrame(rows, C))


def test_triage_branches(spark):
    got = by_index(triaged(spark)[1], "triage_class", "recommended_action", "candidate_count", "requires_review")
    for i, (_, _, _, candidates, cls, rule) in enumerate(TRIAGED):
        assert got[i] == (cls, D.ACTIONS[rule], len(candidates), cls in D.REVIEWED), i


def test_reviewed_anchors_have_no_node(spark):
    fused, t = triaged(spark)
    done = spark.createDataFrame([(90, "x", "confirmed_name_structure", ["n"], "resolved", "n", "very_high"), (91, "y", "name_only_resolved", [], "resolved", "m", "high")], F_)
    anchors = fused.union(done).select("matrix_index", "anchor_name")
    got = by_index(D.build_anchors(anchors, fused.union(done), t, "A"), "anchor_id", "entity_type", "node_ids", "node_count", "mapping_source", "mapping_confidence", "status", "requires_review")
    assert got[90] == ("A_090", "drug", '["n"]', 1, "evidence_fusion:confirmed_name_structure", "very_high", "mapped_single", False)
    assert got[91][4:] == ("evidence_fusion:name_only_resolved", "high", "mapped_single", False)
    for i, (_, _, _, candidates, cls, _) in enumerate(TRIAGED):
        kept = cls in D.RETAINING
        assert json.loads(got[i][2]) == (sorted(c[0] for c in candidates) if kept else []) and got[i][4] == f"triage:{cls}" and got[i][7] is not kept
        assert got[i][6] == ("review_required" if not kept else "mapped_single" if len(candidates) == 1 else "mapped_multi")
        assert got[i][1] == {"COMBINATION_DRUG": "combination_drug", "BIOLOGIC_OR_PEPTIDE": "biologic_or_peptide"}.get(cls, "drug")
        assert got[i][5] == ("review_required" if not kept else "very_high" if cls == "SINGLE_HIGH_CONFIDENCE" else "high")


@pytest.mark.parametrize(("change", "text"), [("unknown", "unknown triage class"), ("empty", "retaining class has no ids"), ("missing", "no triage row"), ("no id", "no id")])
def test_anchor_errors(spark, change, text):
    fused = spark.createDataFrame([(1, "x", "c", [], "resolved" if change == "no id" else "unresolved", "", "high")], F_)
    t = spark.createDataFrame([(2 if change == "missing" else 1, "ELSE" if change == "unknown" else "SAFE_MULTI_NODE", "[]")], "matrix_index int, triage_class string, supported_ids string")
    with pytest.raises(Exception, match=text):
        D.build_anchors(fused.select("matrix_index", "anchor_name"), fused, t, "A").collect()


def test_ontology_classes(spark):
    m, h = "MEDDRA", "HPO"
    rows = [
        (1, "a", m, "name"), (1, "b", m, "name"), (2, "a", m, "name"), (2, "b", h, "synonym"), (3, "a", m, "name"), (3, "b", m, "synonym"), (4, "a", h, "name"), (4, "b", m, "synonym"),
        (5, "a", h, "synonym"), (6, "a", h, "name"), (6, "b", "OTHER", "name"),
    ]
    got = by_index(D.classify_ontology(spark.range(1, 8).select(F.col("id").cast("int").alias("matrix_index")), spark.createDataFrame(rows, "matrix_index int, node_id string, namespace string, fields string")), "preferred_id", "mapping_status", "candidate_ids")
    assert got == {
        1: ("", "multiple_meddra_exact_name", '["a","b"]'), 2: ("a", "meddra_exact_with_other_ontology_candidates", '["a","b"]'), 3: ("a", "unique_meddra_exact_name", '["a","b"]'), 4: ("", "unique_other_exact_name", '["a","b"]'),
        5: ("", "exact_synonym_only", '["a"]'), 6: ("", "ambiguous_exact", '["a","b"]'), 7: ("", "unmatched", "[]"),
    }


def test_concept_statuses(spark):
    anchors = spark.createDataFrame([(1, None), (2, "C0000009"), (3, "c0000001"), (4, "C0000002"), (5, "C0000003"), (6, "C0000004"), (7, "")], "matrix_index int, concept_id string")
    nodes = [
        ("meddra:1", "MEDDRA", "umls:C0000001", ["C0000002"]), ("HP_1", "HPO", "x", ["UMLS:c0000002", "C0000003", None]), ("HP_2", "HPO", "C0000004", []), ("X", "OTHER", "C0000004", None),
    ]
    got = by_index(D.match_concepts(anchors, spark.createDataFrame(nodes, "node_id string, namespace string, c1 string, c2 array<string>"), ("c1", "c2")), "canonical_id", "alias_ids", "mapping_status")
    assert got == {
        1: ("", "[]", "no_sider_umls"), 2: ("", "[]", "umls_no_optimuskg_match"), 3: ("meddra:1", "[]", "umls_unique_meddra"), 4: ("meddra:1", '["HP_1"]', "umls_meddra_with_aliases"),
        5: ("HP_1", "[]", "umls_unique_other"), 6: ("", '["HP_2","X"]', "umls_multiple_no_unique_meddra"), 7: ("", "[]", "no_sider_umls"),
    }


def test_crosscheck_outcomes(spark):
    kind = "matrix_index int, node_id string"
    a, b = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x"), (4, ""), (5, None)], kind), spark.createDataFrame([(1, "x"), (2, "y"), (3, None), (4, "z"), (5, "")], kind)
    assert by_index(D.crosscheck(a, b), "outcome") == {1: "name_and_umls_agree", 2: "name_and_umls_conflict", 3: "name_only", 4: "umls_only", 5: ""}


def test_dictionary_and_side_anchors(spark):
    anchors = spark.createDataFrame([(1, "one", "C1"), (2, "two", "C2"), (3, "three", None), (4, "four", "C4"), (5, "five", "C5"), (6, "six", None), (7, "seven", None), (8, "two names", "C8")], "matrix_index int, anchor_name string, concept_id string")
    entries = [
        ("C1", "10", "One"), ("C2", "20", "a"), ("C2", "21", "b"), ("C9", "22", "Two"), ("C4", "40", "x"), ("C5", "50", "x"), ("C5", "51", "x"), ("C8", "80", "p"), ("C8", "81", "q"), ("C7", "82", "two  names"), ("C7", "83", "two names"),
    ]
    nodes = spark.createDataFrame([("meddra:10",), ("meddra:22",), ("HP_1",)], "node_id string")
    mapped = spark.createDataFrame([(1, "meddra:10", "[]"), (2, "HP_9", '["meddra:5","HP_1"]'), (6, "", '["HP_3"]')], "matrix_index int, canonical_id string, alias_ids string")
    d = D.resolve_dictionary(anchors, spark.createDataFrame(entries, "concept_id string, entry_id string, term string"), nodes, mapped)
    assert by_index(d, "entry_id", "canonical_id", "alias_ids", "mapping_method", "mapping_status") == {
        1: ("10", "meddra:10", "[]", "sider_umls_pt", "meddra_by_umls"), 2: ("22", "meddra:22", '["HP_1","HP_9"]', "exact_meddra_pt_name", "meddra_with_hpo_alias"), 3: ("", "", "[]", "", "unresolved"),
        4: ("40", "", "[]", "sider_umls_pt", "meddra_resolved_but_not_in_optimuskg"), 5: ("", "", "[]", "", "ambiguous_meddra"), 6: ("", "", '["HP_3"]', "", "unresolved"), 7: ("", "", "[]", "", "unresolved"), 8: ("", "", "[]", "", "ambiguous_meddra"),
    }
    names = spark.createDataFrame([(3, '["HP_7"]', "unique_other_exact_name"), (6, '["HP_8"]', "exact_synonym_only"), (7, '["HP_7","HP_8"]', "unique_other_exact_name"), (1, '["HP_7"]', "unique_other_exact_name")], "matrix_index int, candidate_ids string, mapping_status string")
    got = by_index(D.build_side_anchors(anchors, names, d, "S"), "canonical_id", "alias_ids", "node_count", "identity_source", "mapping_confidence", "status", "requires_review")
    assert got == {
        1: ("meddra:10", "[]", 1, "sider_umls_pt", "high", "canonical_meddra_with_kg", False), 2: ("meddra:22", '["HP_1","HP_9"]', 3, "exact_meddra_pt_name", "high", "meddra_with_alias_kg", False),
        3: ("HP_7", "[]", 1, "step12_unique_exact_name", "high", "exact_other_ontology", False), 4: ("", "[]", 0, "sider_umls_pt", "high", "external_meddra_only", True), 5: ("", "[]", 0, "none", "none", "no_kg_evidence", True),
        6: ("HP_8", '["HP_3"]', 2, "step12_unique_exact_synonym", "high", "exact_other_ontology", False), 7: ("", "[]", 0, "none", "none", "no_kg_evidence", True), 8: ("", "[]", 0, "none", "none", "no_kg_evidence", True),
    }
    with pytest.raises(Exception, match="belongs to the dictionary"):
        D.build_side_anchors(anchors, names.withColumn("candidate_ids", F.lit('["meddra:1"]')), d, "S").collect()


def test_recovered_concepts_count_rows_and_spellings(spark):
    terms = spark.createDataFrame([(1, "pain"), (2, "none"), (3, "rash")], "matrix_index int, anchor_name string")
    rows = spark.createDataFrame([("Pain", "C1"), ("pain", "C1"), ("PAIN ", "C2"), ("rash", ""), ("rash", "C3")], "term string, concept_id string")
    got = by_index(D.recover_concepts(terms, rows), "found", "row_count", "concept_ids", "matched_names", "mapping_status")
    assert got == {1: (True, 3, '["C1", "C2"]', '["Pain", "pain", "PAIN "]', "multiple_umls"), 2: (False, 0, "[]", "[]", "unmatched"), 3: (True, 2, '["C3"]', '["rash"]', "unique_umls")}
