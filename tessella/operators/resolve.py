"""Entity resolution by exact, explainable evidence (D).

Anchors are ``(matrix_index, anchor_name, ...)``, nodes ``(node_id, ...)``; every anchor
stays in every summary, matched or not.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.functions import text as X
from tessella.operators.bloom import might_hold

#: Fields by falling weight as evidence.
FIELDS = ("name", "synonym", "trade_name")

# Methods, classes, statuses, actions and sources of published mapping files.
METHODS = {3: "canonical_name_disambiguation", 2: "synonym_disambiguation", 1: "trade_name_disambiguation"}
TRIAGE_CLASSES = ("SAFE_MULTI_NODE", "SINGLE_HIGH_CONFIDENCE", "FORM_OR_SALT_AMBIGUITY", "BIOLOGIC_OR_PEPTIDE", "COMBINATION_DRUG", "TRUE_CONFLICT", "NO_OPTIMUSKG_NODE")
RETAINING = ("SAFE_MULTI_NODE", "SINGLE_HIGH_CONFIDENCE", "BIOLOGIC_OR_PEPTIDE", "COMBINATION_DRUG")
REVIEWED = ("FORM_OR_SALT_AMBIGUITY", "TRUE_CONFLICT", "NO_OPTIMUSKG_NODE")
CANDIDATE_SOURCES = ("name_candidate", "identity_analysis", "stitch_structure", "selected_name_mapping")
ACTIONS = {
    "combination": "Retain supported combination nodes; do not collapse to one ingredient.",
    "no node": "Keep unmapped and perform later curated/manual ontology review.",
    "related structure": "Review parent/form relationship; do not collapse chemical forms.",
    "discordant": "Manually adjudicate discordant name and structure identities.",
    "single": "Retain the single locally supported OptimusKG node.",
    "equivalent": "Retain all equivalent cross-namespace nodes without selecting a namespace.",
    "biologic": "Retain supported biologic nodes; structure absence is not disqualifying.",
    "related forms": "Review salt, form, stereochemistry, isotope, or formulation differences.",
    "different": "Manually adjudicate candidates with different identities.",
    "compatible": "Retain all compatible cross-namespace nodes; no chemical conflict is present.",
    "biologic later": "Retain biologic candidates and review with biologic-specific identifiers later.",
    "insufficient": "Evidence is insufficiently consistent; retain for manual adjudication.",
}
SIDE_REVIEWED = ("ambiguous_meddra", "meddra_resolved_but_not_in_optimuskg", "unresolved")


def _ids(c: str = "node_id") -> Column:
    return F.sort_array(F.collect_set(c))


def _strings(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def _filled(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def match_names(anchors: DataFrame, nodes: DataFrame, fields: tuple[str, ...] = FIELDS, norm: Callable = X.normalize_text) -> DataFrame:
    """``matrix_index, node_id, fields``: anchors and nodes whose normalised names are
    equal in any field. Fields may be strings or arrays; empty names match nothing."""
    def values(f: str) -> Column:
        return F.col(f) if "array" in dict(nodes.dtypes)[f] else F.array(f)

    def tagged(f: str) -> Column:
        return F.transform(values(f), lambda v: F.struct(F.lit(f).alias("field"), v.alias("value")))

    keys = nodes.select("node_id", F.explode(F.flatten(F.array(*map(tagged, fields)))).alias("k"))
    keys = keys.select("node_id", "k.field", norm(F.col("k.value")).alias("key")).where("key <> ''").distinct()
    a = anchors.select("matrix_index", norm(F.col("anchor_name")).alias("key")).where("key <> ''")
    return a.join(keys, "key").groupBy("matrix_index", "node_id").agg(F.collect_set("field").alias("f")).select("matrix_index", "node_id", X.ordered_fields(F.col("f"), fields).alias("fields"))


def summarize_candidates(anchors: DataFrame, candidates: DataFrame) -> DataFrame:
    """Count, ids as JSON, and status for every anchor."""
    c = candidates.groupBy("matrix_index").agg(_ids().alias("ids"))
    out = anchors.join(c, "matrix_index", "left").withColumn("ids", _strings(F.col("ids")))
    n = F.size("ids")
    return out.select("matrix_index", "anchor_name", n.alias("candidate_count"), X.json_ids(F.col("ids")).alias("candidate_ids"), F.when(n == 0, "unmatched").when(n == 1, "unique_exact").otherwise("ambiguous_exact").alias("mapping_status"))


def evidence_score(fields: Column, order: tuple[str, ...] = FIELDS) -> Column:
    """D3: the weight of the best matched field, the first listed weighing most."""
    weight = F.create_map(*[x for i, f in enumerate(reversed(order), 1) for x in (F.lit(f), F.lit(i))])
    return F.coalesce(F.array_max(F.transform(F.split(fields, ";"), lambda f: F.try_element_at(weight, f))), F.lit(0))


def resolve_strict_top(candidates: DataFrame) -> DataFrame:
    """Per anchor the candidate of strictly highest evidence, if there is one, and by what:
    ``matrix_index, node_id, candidate_count, method``. A single candidate needs no evidence."""
    s = candidates.withColumn("score", evidence_score(F.col("fields")))
    top = s.withColumn("top", F.max("score").over(W.partitionBy("matrix_index"))).withColumn("best", F.col("score") == F.col("top"))
    t = top.groupBy("matrix_index").agg(F.count("*").alias("candidate_count"), F.max("top").alias("top"), F.count_if("best").alias("tied"), F.min(F.when(F.col("best"), F.col("node_id"))).alias("one"))
    by = F.create_map(*[F.lit(x) for kv in METHODS.items() for x in kv])
    method = F.when(F.col("candidate_count") == 1, "unique_exact").when(F.col("tied") == 1, F.try_element_at(by, F.col("top")))
    return t.select("matrix_index", F.when(F.col("tied") == 1, F.col("one")).alias("node_id"), "candidate_count", method.alias("method"))


def match_with_fallback(anchors: DataFrame, nodes: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """``matrix_index, node_id, fields, pass``: D1 on plain names (pass ``exact``); anchors
    without candidates again with dots as spaces (pass ``dots``)."""
    first = match_names(anchors, nodes, fields)
    rest = anchors.join(first.select("matrix_index").distinct(), "matrix_index", "left_anti")
    return first.withColumn("pass", F.lit("exact")).unionByName(match_names(rest, nodes, fields, X.normalize_dots).withColumn("pass", F.lit("dots")))


def resolve_with_fallback(anchors: DataFrame, candidates: DataFrame) -> DataFrame:
    """D4 of every anchor from the candidates of both passes; what the second resolves has
    the second pass as its method."""
    dotted = candidates.where("pass = 'dots'").select("matrix_index", F.lit(True).alias("dotted")).distinct()
    out = anchors.select("matrix_index", "anchor_name").join(resolve_strict_top(candidates), "matrix_index", "left").join(dotted, "matrix_index", "left")
    status = F.when(F.col("node_id").isNotNull(), "resolved").when(F.col("candidate_count").isNotNull(), "ambiguous").otherwise("unmatched")
    method = F.when(F.col("node_id").isNotNull() & F.col("dotted"), "dot_normalized_exact").otherwise(F.col("method"))
    return out.withColumns({"method": method, "mapping_confidence": F.when(F.col("node_id").isNotNull(), "high"), "resolution_status": status, "candidate_count": F.coalesce("candidate_count", F.lit(0))}).drop("dotted")


def classify_identity(anchors: DataFrame, candidates: DataFrame, key: str, second: str) -> DataFrame:
    """What the candidates of highest evidence share: two with one key are equivalent, else
    two with one second key; different keys or second keys are mixed; else there is too little.
    ``candidates(matrix_index, node_id, fields, key, second)``; every anchor stays."""
    k, s = F.upper(_filled(F.col(key))), _filled(F.col(second))
    c = candidates.select("matrix_index", evidence_score(F.col("fields")).alias("score"), k.alias("k"), s.alias("s"))
    best = F.col("score") == F.max("score").over(W.partitionBy("matrix_index"))
    c = c.withColumn("best", best)
    on = lambda x: F.when(F.col("best"), F.col(x))
    g = c.groupBy("matrix_index").agg(
        F.count("*").alias("candidate_count"), F.count_if("best").alias("top_count"), F.count(on("k")).alias("n_k"), F.count_distinct(on("k")).alias("d_k"), F.count(on("s")).alias("n_s"), F.count_distinct(on("s")).alias("second_count"),
        F.collect_set(on("k")).alias("keys"))
    j = anchors.select("matrix_index").join(g, "matrix_index", "left").fillna(0)
    cls = (
        F.when(F.col("n_k") > F.col("d_k"), "equivalent_by_inchikey").when(F.col("n_s") > F.col("second_count"), "equivalent_by_smiles")
        .when((F.col("d_k") >= 2) | (F.col("second_count") >= 2), "mixed_identity").otherwise("insufficient_structure")
    )
    return j.select("matrix_index", "candidate_count", "top_count", cls.alias("identity_class"), X.json_ids(_strings(F.col("keys"))).alias("key_values"), "second_count")


def lookup_keys(big: DataFrame, targets: DataFrame, id_col: str, key: str) -> DataFrame:
    """Rows and distinct keys of each target id in a huge table; ids without rows stay. Few
    targets go to the scan as they are; many as a bitmap of bounded size, so that little more
    than the rows of targets is shuffled to the exact semi join."""
    ids = targets.select("id").distinct()
    found = big.select(F.col(id_col).alias("id"), F.nullif(X.normalize_key(F.col(key)), F.lit("")).alias("k"))
    if might := might_hold(ids, "id"):
        found = found.where(might(F.col("id").cast(ids.schema["id"].dataType)))
    g = found.join(ids, "id", "left_semi").groupBy("id").agg(F.count("*").alias("rows"), _ids("k").alias("keys"))
    return ids.join(g, "id", "left").select("id", F.coalesce("rows", F.lit(0)).alias("rows"), _strings(F.col("keys")).alias("keys"))


def match_structure(keys: DataFrame, nodes: DataFrame, previous: DataFrame) -> tuple[DataFrame, DataFrame]:
    """anchors' keys against nodes' keys: (matches, summary). ``keys(matrix_index, found,
    keys)``: whether the huge table has the anchor, and its keys there. Of several keys that
    lead to one node the last in order is kept; a match says whether it was a name candidate
    before. Several matches through one key are one structure."""
    n = nodes.select("node_id", X.normalize_key("struct_key").alias("key")).where("key <> ''")
    m = keys.select("matrix_index", F.explode("keys").alias("key")).join(n, "key").groupBy("matrix_index", "node_id").agg(F.max("key").alias("key"))
    was = previous.select("matrix_index", "node_id", F.lit(True).alias("was")).distinct()
    m = m.join(was, ["matrix_index", "node_id"], "left").select("matrix_index", "node_id", "key", F.coalesce("was", F.lit(False)).alias("was_candidate"))
    g = m.groupBy("matrix_index").agg(F.count("*").alias("n"), F.count_distinct("key").alias("d"), _ids().alias("ids"))
    s = keys.join(g, "matrix_index", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    status = (
        F.when(~F.col("found"), "stitch_not_found").when(F.col("n") == 0, "stitch_found_no_optimuskg_match").when(F.col("n") == 1, "unique_structure_match")
        .when(F.col("d") == 1, "equivalent_structure_group").otherwise("multiple_structure_matches")
    )
    return m, s.select("matrix_index", F.col("found").alias("structure_found"), F.size(F.array_distinct("keys")).alias("key_count"), F.col("n").alias("match_count"), _strings(F.col("ids")).alias("match_ids"), status.alias("structure_status"))


def fuse_evidence(rows: DataFrame) -> DataFrame:
    """Nine classes from ``name_status, selected, method, name_ids, structure_ids``: the
    class with the proposed id, confidence and final status. A unique structure match among
    ambiguous names is judged before a unique intersection; where ``previous_ids`` (structure
    matches that were name candidates) is given, it must hold that match."""
    both = F.array_intersect("name_ids", "structure_ids")
    ns, nb, st = F.size("structure_ids"), F.size(both), F.col("name_status")
    confirmed = F.array_contains("structure_ids", F.col("selected"))
    cls = (
        F.when((st == "resolved") & confirmed, "confirmed_name_structure").when((st == "resolved") & (ns > 0), "conflicting_evidence")
        .when((st == "resolved") & (F.col("method") == METHODS[3]), "supported_canonical_name").when(st == "resolved", "name_only_resolved")
        .when((st == "ambiguous") & (ns == 1) & (nb == 1), "resolved_by_unique_structure_candidate").when((st == "ambiguous") & (nb == 1), "resolved_by_unique_intersection")
        .when(st == "ambiguous", "unresolved_ambiguous").when((st == "unmatched") & (ns == 1), "structure_only_candidate").when((st == "unmatched") & (ns > 1), "unresolved_ambiguous")
        .when(st == "unmatched", "unresolved_unmatched").otherwise(F.raise_error(F.concat(F.lit("unknown status "), st)))
    )
    if "previous_ids" in rows.columns:
        amiss = (cls == "resolved_by_unique_structure_candidate") & ~F.array_contains("previous_ids", F.get(both, F.lit(0)))
        cls = F.when(amiss, F.raise_error(F.lit("a unique structure candidate was no name candidate"))).otherwise(cls)
    out = rows.withColumns({"intersection_ids": both, "evidence_class": cls})
    c = F.col("evidence_class")
    proposed = F.when(c.isin("confirmed_name_structure", "supported_canonical_name", "name_only_resolved"), F.col("selected")).when(c.startswith("resolved_by"), F.get("intersection_ids", F.lit(0))).when(c == "structure_only_candidate", F.get("structure_ids", F.lit(0)))
    confidence = F.when(c.isin("confirmed_name_structure") | c.startswith("resolved_by"), "very_high").when(c.isin("supported_canonical_name", "name_only_resolved"), "high").when(c == "unresolved_unmatched", "unresolved").otherwise("review_required")
    final = F.when(confidence.isin("very_high", "high"), "resolved").when(c.isin("conflicting_evidence", "structure_only_candidate"), "review_required").otherwise("unresolved")
    return out.withColumns({"proposed_id": F.coalesce(proposed, F.lit("")), "confidence": confidence, "final_status": final})


def merge_candidates(nodes: DataFrame, ids: DataFrame, sources: dict[str, DataFrame]) -> DataFrame:
    """The candidates of every anchor, one row each: all of ``ids(matrix_index, node_id)``
    and of the sources. A column is the last source's non-empty value, else the node's own;
    ``fields`` joins those of all sources, ``evidence_sources`` names the sources."""
    cols = [c for c in nodes.columns if c != "node_id"]
    pair, none = ["matrix_index", "node_id"], F.lit(None).cast("string")
    u = None
    for rank, (name, df) in enumerate(sources.items()):
        part = df.select(*pair, *[F.col(c) if c in df.columns else none.alias(c) for c in cols], (F.col("fields") if "fields" in df.columns else none).alias("fields"), F.lit(name).alias("source"), F.lit(rank).alias("rank"))
        u = part if u is None else u.unionByName(part)
    all_ids = u.select(*pair).unionByName(ids.select(*pair)).distinct()
    own = all_ids.join(nodes, "node_id", "left").select(*pair, *cols, none.alias("fields"), none.alias("source"), F.lit(-1).alias("rank"))
    text = lambda c: F.col(c).cast("string")
    last = [F.max_by(c, F.when(text(c).isNotNull() & ~text(c).isin("", "[]"), F.col("rank"))).alias(c) for c in cols]
    fields = F.array_join(F.array_sort(F.array_distinct(F.filter(F.flatten(F.collect_list(F.split("fields", ";"))), lambda x: x != ""))), ";").alias("fields")
    return u.unionByName(own).groupBy(*pair).agg(*last, fields, F.array_sort(F.collect_set("source")).alias("evidence_sources"))


def names_related(candidates: DataFrame) -> DataFrame:
    """Per anchor whether a candidate's normalised name holds or is held by the
    anchor's, or shares a significant token; empty names are skipped."""
    a, b = X.normalize_alnum("anchor_name"), X.normalize_alnum("name")
    hit = F.contains(a, b) | F.contains(b, a) | F.arrays_overlap(X.significant_tokens("anchor_name"), X.significant_tokens("name"))
    return candidates.groupBy("matrix_index").agg(F.coalesce(F.bool_or(F.when(b != "", hit)), F.lit(False)).alias("related"))


def triage(fused: DataFrame, candidates: DataFrame) -> DataFrame:
    """Class, action and review flag of every row of ``fused(matrix_index, anchor_name,
    evidence_class, structure_ids)``, from its ``candidates(matrix_index, node_id, name, type,
    key, second, identity_class)``."""
    c = candidates.join(fused.select("matrix_index", "anchor_name", "structure_ids"), "matrix_index")
    in_structure = c.where(F.array_contains("structure_ids", F.col("node_id")))
    g = c.groupBy("matrix_index").agg(
        F.count("*").alias("n"), F.count_distinct(F.upper(_filled(F.col("key")))).alias("keys"), F.count_distinct(_filled(F.col("second"))).alias("seconds"), F.count_distinct(F.when(F.col("name") != "", X.normalize_alnum("name"))).alias("names"),
        F.coalesce(F.bool_or(F.col("identity_class").startswith("equivalent_by_")), F.lit(False)).alias("same"), F.coalesce(F.bool_or(F.col("identity_class") == "mixed_identity"), F.lit(False)).alias("mixed"),
        F.collect_set("type").alias("types"), X.json_ids(_ids()).alias("supported_ids"), X.json_ids(F.collect_set(F.coalesce("name", F.lit("")))).alias("supported_names"))
    j = fused.select("matrix_index", "anchor_name", "evidence_class").join(g, "matrix_index", "left").join(names_related(c), "matrix_index", "left").join(names_related(in_structure).withColumnRenamed("related", "structure_related"), "matrix_index", "left")
    j = j.fillna(0, ["n", "keys", "seconds", "names"]).fillna(False, ["same", "mixed", "related", "structure_related"])
    at = F.col
    biologic, conflict = X.is_biologic("anchor_name", _strings(at("types"))), at("evidence_class") == "conflicting_evidence"
    several = (at("keys") >= 2) | (at("seconds") >= 2) | at("mixed")
    rule = (
        F.when(X.is_combination("anchor_name"), "combination").when(at("n") == 0, "no node").when(conflict & at("structure_related"), "related structure").when(conflict, "discordant").when(at("n") == 1, "single").when(at("same"), "equivalent")
        .when(biologic & (at("keys") <= 1) & (at("seconds") <= 1), "biologic").when(several & at("related"), "related forms").when(several, "different").when((at("names") == 1) | at("related"), "compatible").when(biologic, "biologic later").otherwise("insufficient")
    )
    safe, single, form, protein, both, differ, none = TRIAGE_CLASSES
    of_rule = {"combination": both, "no node": none, "related structure": form, "discordant": differ, "single": single, "equivalent": safe, "biologic": protein, "related forms": form, "different": differ, "compatible": safe, "biologic later": protein, "insufficient": differ}
    look = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    t = j.withColumn("rule", rule).withColumn("triage_class", look(of_rule)[at("rule")])
    return t.select("matrix_index", "anchor_name", "triage_class", F.coalesce("supported_ids", F.lit("[]")).alias("supported_ids"), F.coalesce("supported_names", F.lit("[]")).alias("supported_names"), at("n").alias("candidate_count"), look(ACTIONS)[at("rule")].alias("recommended_action"), at("triage_class").isin(*REVIEWED).alias("requires_review"))


def build_anchors(anchors: DataFrame, fused: DataFrame, triaged: DataFrame, prefix: str) -> DataFrame:
    """The final mapping. A resolved anchor has its node, one of a retaining class the nodes
    that support it; one under review keeps its row and no node, so that disputed nodes enter
    no graph. Errors: a resolved anchor without an id, an unresolved one without a triage row, a
    retaining class without ids, an unknown class."""
    j = anchors.select("matrix_index", "anchor_name").join(fused.select("matrix_index", "proposed_id", "evidence_class", "confidence", "final_status"), "matrix_index", "left")
    j = j.join(triaged.select("matrix_index", "triage_class", "supported_ids"), "matrix_index", "left")
    done, cls = F.coalesce(F.col("final_status") == "resolved", F.lit(False)), F.col("triage_class")
    kept, found = cls.isin(*RETAINING), F.array_sort(F.array_distinct(X.parse_ids("supported_ids")))
    fail = lambda text: F.raise_error(F.lit(text)).cast("array<string>")
    ids = (
        F.when(done & (F.coalesce("proposed_id", F.lit("")) == ""), fail("a resolved anchor has no id")).when(done, F.array("proposed_id")).when(cls.isNull(), fail("an anchor has no triage row"))
        .when(kept & (F.size(found) == 0), fail("a retaining class has no ids")).when(kept, found).when(cls.isin(*REVIEWED), F.array().cast("array<string>")).otherwise(fail("an unknown triage class"))
    )
    j = j.withColumns({"ids": ids, "done": done, "review": ~done & cls.isin(*REVIEWED)})
    n = F.size("ids")
    return j.select(
        "matrix_index", X.anchor_id(prefix, F.col("matrix_index")).alias("anchor_id"), "anchor_name",
        F.when(F.col("done"), "drug").when(cls == "COMBINATION_DRUG", "combination_drug").when(cls == "BIOLOGIC_OR_PEPTIDE", "biologic_or_peptide").otherwise("drug").alias("entity_type"),
        X.json_ids(F.col("ids"), True).alias("node_ids"), n.alias("node_count"),
        F.when(F.col("done"), F.concat(F.lit("evidence_fusion:"), "evidence_class")).otherwise(F.concat(F.lit("triage:"), cls)).alias("mapping_source"),
        F.when(F.col("done"), F.coalesce(F.nullif("confidence", F.lit("")), F.lit("high"))).when(F.col("review"), "review_required").when(cls == "SINGLE_HIGH_CONFIDENCE", "very_high").otherwise("high").alias("mapping_confidence"),
        F.when(F.col("review"), "review_required").when(n == 1, "mapped_single").when(n > 1, "mapped_multi").otherwise("unmapped").alias("status"), F.col("review").alias("requires_review"))


def classify_ontology(anchors: DataFrame, candidates: DataFrame, preferred: str = "MEDDRA", second: str = "HPO") -> DataFrame:
    """Seven classes of name candidates ``(matrix_index, node_id, namespace, fields)``; a
    single canonical name of the preferred ontology is proposed, whatever stands beside it."""
    by_name, own = F.array_contains(F.split("fields", ";"), "name"), F.col("namespace") == preferred
    g = candidates.groupBy("matrix_index").agg(
        F.count("*").alias("n"), F.count_if(own & by_name).alias("p"), F.count_if(~own & by_name).alias("o"), F.count_if(own).alias("own"), F.count_if(F.col("namespace") == second).alias("second"), F.max(F.when(own & by_name, F.col("node_id"))).alias("one"), _ids().alias("ids"))
    j = anchors.select("matrix_index").join(g, "matrix_index", "left").fillna(0)
    cls = (
        F.when(F.col("p") > 1, "multiple_meddra_exact_name").when((F.col("p") == 1) & (F.col("n") > F.col("own")), "meddra_exact_with_other_ontology_candidates").when(F.col("p") == 1, "unique_meddra_exact_name")
        .when(F.col("o") == 1, "unique_other_exact_name").when((F.col("o") == 0) & (F.col("n") > 0), "exact_synonym_only").when(F.col("n") > 0, "ambiguous_exact").otherwise("unmatched")
    )
    return j.select("matrix_index", F.col("n").alias("candidate_count"), F.col("own").alias("preferred_count"), F.col("second").alias("second_count"), F.when(F.col("p") == 1, F.col("one")).otherwise("").alias("preferred_id"), X.json_ids(_strings(F.col("ids"))).alias("candidate_ids"), cls.alias("mapping_status"))


def recover_concepts(terms: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Concept ids of terms by normalised name, with the dictionary's rows and spellings."""
    d = dictionary.select(X.normalize_text("term").alias("key"), F.col("term").alias("spelling"), "concept_id").where("key <> ''")
    g = terms.select("matrix_index", X.normalize_text("anchor_name").alias("key")).join(d, "key").groupBy("matrix_index").agg(F.count("*").alias("n"), F.collect_set(_filled(F.col("concept_id"))).alias("ids"), F.collect_set(F.nullif("spelling", F.lit(""))).alias("names"))
    out = terms.select("matrix_index").join(g, "matrix_index", "left").withColumns({"ids": _strings(F.col("ids")), "n": F.coalesce("n", F.lit(0))})
    n = F.size("ids")
    return out.select("matrix_index", (F.col("n") > 0).alias("found"), F.col("n").alias("row_count"), n.alias("concept_count"), X.json_ids(F.col("ids"), True).alias("concept_ids"), X.json_list(X.by_casefold(_strings(F.col("names"))), True).alias("matched_names"), F.when(n == 0, "unmatched").when(n == 1, "unique_umls").otherwise("multiple_umls").alias("mapping_status"))


def match_concepts(anchors: DataFrame, nodes: DataFrame, fields: tuple[str, ...], preferred: str = "MEDDRA", second: str = "HPO") -> DataFrame:
    """anchors' one concept id (or null) against any of the nodes' fields, strings or
    arrays: the preferred ontology's only node is canonical, the others aliases; a node that
    stands alone is canonical whatever its ontology."""
    kinds = dict(nodes.dtypes)
    ids = F.flatten(F.array(*[_strings(F.col(f)) if "array" in kinds[f] else F.array(f) for f in fields]))
    n = nodes.select("node_id", "namespace", F.explode(F.array_distinct(F.transform(ids, X.extract_cui))).alias("concept_id")).where("concept_id is not null")
    a = anchors.select("matrix_index", F.upper(F.nullif("concept_id", F.lit(""))).alias("concept_id"))
    own = F.col("namespace") == preferred
    g = a.join(n, "concept_id").groupBy("matrix_index").agg(F.count("*").alias("n"), F.count_if(own).alias("p"), F.count_if(F.col("namespace") == second).alias("q"), F.min(F.when(own, F.col("node_id"))).alias("one"), _ids().alias("ids"))
    j = a.join(g, "matrix_index", "left").fillna(0, ["n", "p", "q"])
    n, p = F.col("n"), F.col("p")
    status = (
        F.when(F.col("concept_id").isNull(), "no_sider_umls").when(n == 0, "umls_no_optimuskg_match").when((n == 1) & (p == 1), "umls_unique_meddra").when(p == 1, "umls_meddra_with_aliases")
        .when(n == 1, "umls_unique_other").otherwise("umls_multiple_no_unique_meddra")
    )
    canonical = F.when(p == 1, F.col("one")).when(n == 1, F.get("ids", F.lit(0))).otherwise("")
    aliases = F.array_except(_strings(F.col("ids")), F.array(canonical))
    return j.select("matrix_index", F.coalesce("concept_id", F.lit("")).alias("concept_id"), n.alias("match_count"), p.alias("preferred_count"), F.col("q").alias("second_count"), canonical.alias("canonical_id"), X.json_ids(aliases).alias("alias_ids"), status.alias("mapping_status"))


def crosscheck(by_name: DataFrame, by_concept: DataFrame) -> DataFrame:
    """Two mappings ``(matrix_index, node_id)`` of the same anchors, null or empty where
    one says nothing; the outcome is empty where neither does."""
    j = by_name.select("matrix_index", _filled(F.col("node_id")).alias("name_id")).join(by_concept.select("matrix_index", _filled(F.col("node_id")).alias("concept_node")), "matrix_index", "full")
    a, b = F.col("name_id"), F.col("concept_node")
    return j.select("matrix_index", "name_id", "concept_node", F.when(a == b, "name_and_umls_agree").when(a.isNotNull() & b.isNotNull(), "name_and_umls_conflict").when(b.isNotNull(), "umls_only").when(a.isNotNull(), "name_only").otherwise("").alias("outcome"))


def resolve_dictionary(anchors: DataFrame, dictionary: DataFrame, nodes: DataFrame, mapped: DataFrame, prefix: str = "meddra:") -> DataFrame:
    """The dictionary entry of each anchor ``(matrix_index, anchor_name, concept_id)``: the
    only one of its concept, else the only one of its name. ``dictionary(concept_id, entry_id,
    term)`` with the last spelling of an entry (in order) standing for it; ``nodes(node_id)``
    says which entries have a node ``prefix`` + id, ``mapped`` (D16) which other nodes stand
    beside it."""
    d = dictionary.select(F.upper(F.trim("concept_id")).alias("concept"), X.normalize_text("term").alias("key"), F.trim("entry_id").alias("entry"), F.trim("term").alias("term"))
    last = lambda by, name: d.groupBy(by).agg(F.array_sort(F.collect_set("entry")).alias(name), F.max(F.struct("entry", "term")).getField("term").alias(f"{name}_term"))
    j = anchors.select("matrix_index", F.upper(F.nullif("concept_id", F.lit(""))).alias("concept"), X.normalize_text("anchor_name").alias("key"))
    j = j.join(last("concept", "c"), "concept", "left").join(last("key", "n"), "key", "left")
    c, n = _strings(F.col("c")), _strings(F.col("n"))
    first = lambda a: F.get(a, F.lit(0))
    one, two = F.size(c) == 1, F.size(n) == 1
    j = j.withColumns({"method": F.when(one, "sider_umls_pt").when(two, "exact_meddra_pt_name").otherwise(""), "entry": F.when(one, first(c)).when(two, first(n)), "term": F.when(one, F.col("c_term")).when(two, F.col("n_term")), "left_over": F.size(F.array_union(c, n))})
    j = j.withColumn("node_id", F.concat(F.lit(prefix), "entry")).join(nodes.select("node_id", F.lit(True).alias("exists")).distinct(), "node_id", "left").join(mapped.select("matrix_index", F.col("canonical_id").alias("was"), F.col("alias_ids").alias("other")), "matrix_index", "left")
    others = F.filter(F.array_union(X.parse_ids("other"), F.array(F.coalesce("was", F.lit("")))), lambda x: (x != "") & ~F.lower(x).startswith(prefix))
    has, alias = F.coalesce("exists", F.lit(False)), F.size("others") > 0
    j = j.withColumn("others", others)
    status = (
        F.when(F.col("entry").isNotNull() & ~has, "meddra_resolved_but_not_in_optimuskg").when(F.col("entry").isNotNull() & alias, "meddra_with_hpo_alias").when(F.col("method") == "sider_umls_pt", "meddra_by_umls").when(F.col("method") != "", "meddra_by_name")
        .when(F.col("left_over") > 1, "ambiguous_meddra").otherwise("unresolved")
    )
    return j.select("matrix_index", F.coalesce("entry", F.lit("")).alias("entry_id"), F.coalesce("term", F.lit("")).alias("entry_name"), F.when(has, F.col("node_id")).otherwise("").alias("canonical_id"), X.json_ids(F.col("others")).alias("alias_ids"), F.col("method").alias("mapping_method"), status.alias("mapping_status"), status.isin(*SIDE_REVIEWED).alias("requires_review"))


def build_side_anchors(anchors: DataFrame, by_name: DataFrame, entries: DataFrame, prefix: str, own: str = "meddra:") -> DataFrame:
    """Final mapping of terms. An anchor with a dictionary entry (``entries`` of D18) has its
    node and aliases, or the entry alone; one without has its only name candidate (``by_name``
    of D14) if that is unique and of another ontology, else nothing."""
    j = anchors.select("matrix_index", "anchor_name").join(by_name.select("matrix_index", F.col("candidate_ids").alias("named"), F.col("mapping_status").alias("name_status")), "matrix_index", "left")
    j = j.join(entries.select("matrix_index", "entry_id", "entry_name", "canonical_id", "alias_ids", "mapping_method"), "matrix_index", "left")
    named, has = X.parse_ids("named"), F.coalesce("entry_id", F.lit("")) != ""
    safe = ~has & F.col("name_status").isin("unique_other_exact_name", "exact_synonym_only") & (F.size(named) == 1)
    one = F.get(named, F.lit(0))
    checked = F.when(F.lower(one).startswith(own), F.raise_error(F.lit("a fallback node belongs to the dictionary")).cast("string")).otherwise(one)
    canonical = F.when(has, F.coalesce("canonical_id", F.lit(""))).when(safe, checked).otherwise("")
    aliases = F.when(has, X.parse_ids("alias_ids")).when(safe, X.parse_ids("alias_ids")).otherwise(F.array().cast("array<string>"))
    j = j.withColumns({"has": has, "safe": F.coalesce(safe, F.lit(False)), "canonical": canonical, "aliases": F.array_distinct(aliases)})
    j = j.withColumn("n", F.size(F.filter(F.array_union("aliases", F.array("canonical")), lambda x: x != "")))
    status = (
        F.when(F.col("has") & (F.size("aliases") > 0), "meddra_with_alias_kg").when(F.col("has") & (F.col("canonical") != ""), "canonical_meddra_with_kg").when(F.col("has"), "external_meddra_only")
        .when(F.col("safe"), "exact_other_ontology").otherwise("no_kg_evidence")
    )
    source = F.when(F.col("has"), F.col("mapping_method")).when(F.col("safe") & (F.col("name_status") == "unique_other_exact_name"), "step12_unique_exact_name").when(F.col("safe"), "step12_unique_exact_synonym").otherwise("none")
    return j.select(
        "matrix_index", X.anchor_id(prefix, F.col("matrix_index")).alias("anchor_id"), F.coalesce("entry_id", F.lit("")).alias("entry_id"), F.col("canonical").alias("canonical_id"), X.json_ids(F.col("aliases")).alias("alias_ids"), F.col("n").alias("node_count"), source.alias("identity_source"),
        F.when(F.col("has") | F.col("safe"), "high").otherwise("none").alias("mapping_confidence"), status.alias("status"), (F.col("n") > 0).alias("has_node"), status.isin("external_meddra_only", "no_kg_evidence").alias("requires_review"))


def coverage(df: DataFrame, status: str, all_statuses: tuple[str, ...]) -> DataFrame:
    """Rows and percentages of each status of a fixed list, zeros kept."""
    n = df.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("n"))
    grid = df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, all_statuses))).alias("status"))
    total = df.agg(F.count("*").alias("total"))
    j = grid.join(n, "status", "left").crossJoin(total).withColumn("n", F.coalesce("n", F.lit(0)))
    return j.select("status", "n", F.when(F.col("total") > 0, F.round(100 * F.col("n") / F.col("total"), 2)).otherwise(0.0).alias("percent"))
