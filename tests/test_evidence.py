"""Evidence of pairs, audits and summaries without pairs, against plain loops and numpy."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import blocked
from tessella.operators import evaluate as J
from tessella.operators import kg as E
from tessella.operators import rewire as H
from tessella.operators import stats as I

KG = "source string, target string, relation string, source_type string, target_type string"


def test_typed_edges_and_what_was_seen(spark):
    rows = [
        ("A", "d", "MAPS_TO_DRUG", "DRUG_ANCHOR", "DRUG"), ("B", "p", "MAPS_TO_PHENOTYPE", "SIDE_ANCHOR", "PHENOTYPE"), ("d", "g", "TARGET", "DRUG", "GENE"), ("g", "d", "ENZYME", "GENE", "DRUG"), ("d", "g", "BINDS", "DRUG", "GENE"),
        ("d", "g", "my_side_effect", "DRUG", "GENE"), ("d", "g2", "Adverse_Drug_Reaction", "DRUG", "GENE"), ("g", "h", "INTERACTS_WITH", "GENE", "GENE"), ("h", "g", "INTERACTS_WITH", "GENE", "GENE"), ("g", "g", "INTERACTS_WITH", "GENE", "GENE"),
        ("g", "w", "INTERACTS_WITH", "GENE", "PATHWAY"), ("p", "h", "ASSOCIATED_WITH", "PHENOTYPE", "GENE"), ("p", "h", "TARGET", "PHENOTYPE", "GENE"), ("A", "d", "MAPS_TO_DRUG", "OTHER", "DRUG"), (None, "x", None, None, None),
    ]
    kg, counts = I.typed_kg(spark.createDataFrame(rows, KG))
    assert {(r.family, r.a, r.b, r.owner, r.gene) for r in kg.collect()} == {
        ("MAPS_TO_DRUG", "A", "d", "A", "d"), ("MAPS_TO_PHENOTYPE", "B", "p", "B", "p"), ("Drug-Gene", "d", "g", "d", "g"), ("Gene-Gene", "g", "h", "g", "h"), ("Gene-Gene", "g", "g", "g", "g"), ("Pathway-Gene", "g", "w", "w", "g"), ("Phenotype-Gene", "h", "p", "p", "h"),
    }
    assert counts == {"edges": 15, "forbidden": 2, "identity": 2, "evidence": 7, "ignored": 4, "duplicates": 2}


def plain_evidence(drug, side, dg, sg, dp, sp, ppi):
    a, b, u, v = dg.get(drug, set()), sg.get(side, set()), dp.get(drug, set()), sp.get(side, set())
    near = {}
    for x, y in ppi:
        near.setdefault(x, set()).add(y)
        near.setdefault(y, set()).add(x)
    bridges = {tuple(sorted((x, y))) for x in a for y in near.get(x, ()) if y in b and x != y}
    part = lambda x, y: (len(x & y), len(x & y) / len(x | y) if x | y else 0.0, len(x & y) / min(len(x), len(y)) if x and y else 0.0)
    n, jac, over = part(a, b)
    m, wjac, wover = part(u, v)
    weighted = sum(1 / math.log(2 + len(near.get(g, ()))) for g in a & b)
    hops = 2 if n else 3 if bridges else 4 if m else 0
    return (int(bool(a)), int(bool(b)), int(bool(a and b)), len(a), len(b), n, jac, over, weighted, len(bridges), len(bridges) / math.sqrt(len(a) * len(b)) if a and b else 0.0, int(bool(bridges)), len(u), len(v), m, wjac, wover, int(m > 0), int(n > 0), hops)


@pytest.mark.parametrize("light", [1000, 2])
def test_pair_evidence_with_and_without_heavy_genes(spark, monkeypatch, light):
    """With a limit of 2 (and few edges) the hub and its neighbours are heavy."""
    monkeypatch.setattr(I, "LIGHT", light)
    if light == 2:
        monkeypatch.setattr(I.math, "isqrt", lambda n: 0)
    rng = np.random.default_rng(4)
    pick = lambda k: {f"g{i}" for i in rng.choice(40, k, replace=False)}
    dg, sg = {f"d{i}": pick(rng.integers(1, 6)) for i in range(6)}, {f"s{i}": pick(rng.integers(1, 6)) for i in range(6)}
    dg["d0"], sg["s0"] = {"g0"}, {"g7", "g0"}
    ppi = {("g0", f"g{i}") for i in range(1, 30)} | {tuple(sorted(rng.choice([f"g{i}" for i in range(40)], 2, replace=False))) for _ in range(30)} | {("g7", "g7")}
    ways = {f"g{i}": {f"w{i % 3}"} for i in range(0, 40, 2)}
    dp, sp = ({k: set().union(*(ways.get(g, set()) for g in v)) for k, v in x.items()} for x in (dg, sg))
    table = lambda x, name: spark.createDataFrame([(k, i) for k, v in x.items() for i in v], f"{name} string, item string")
    sets = {"drug_genes": table(dg, "drug"), "side_genes": table(sg, "side"), "drug_pathways": table(dp, "drug"), "side_pathways": table(sp, "side"), "gene_gene": spark.createDataFrame([tuple(sorted(map(str, e))) for e in ppi], "a string, b string")}
    pairs = [*itertools.product(list(dg) + ["none"], list(sg) + ["none"])]
    got = {(r.drug, r.side): tuple(r[c] for c in I.FEATURE_COLUMNS) for r in I.pair_evidence(spark.createDataFrame(pairs + pairs[:3], "drug string, side string"), sets).collect()}
    assert set(got) == set(pairs)
    for p in pairs:
        assert got[p] == pytest.approx(plain_evidence(*p, dg, sg, dp, sp, ppi)), p
    assert {g[-1] for g in got.values()} >= {0, 2, 3}


def test_hops_by_pathway_only(spark):
    one = lambda rows, kind: spark.createDataFrame(rows, kind)
    sets = {"drug_genes": one([("d", "g")], "drug string, item string"), "side_genes": one([("s", "h")], "side string, item string"), "drug_pathways": one([("d", "w")], "drug string, item string"), "side_pathways": one([("s", "w")], "side string, item string"), "gene_gene": one([], "a string, b string")}
    r = I.pair_evidence(one([("d", "s")], "drug string, side string"), sets).first()
    assert (r.min_bio_hops, r.pathway_path_exists, r.pathway_jaccard, r.ppi_bridge_norm) == (4, 1, 1.0, 0.0)


def test_support_and_its_signal(spark):
    pairs = spark.createDataFrame([("added", 1, 2), ("added", 1, 3), ("random", 2, 3), ("random", 4, 5)], "cohort string, src int, dst int")
    genes = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "c"), (3, "b")], "owner int, item string")
    ways = spark.createDataFrame([(2, "w"), (3, "w")], "owner int, item string")
    s = I.support_summary(I.pair_support(pairs, genes, ways)).cache()
    got = {r.cohort: tuple(r)[1:] for r in s.collect()}
    assert got["added"] == pytest.approx((2, 1.0, 1.0, (1 / 2 + 1 / 3) / 2, 0.0, 0.0, 0.0)) and got["random"] == pytest.approx((2, 0.0, 0.0, 0.0, 0.5, 0.5, 0.5))
    added, random = s.where("cohort = 'added'"), s.where("cohort = 'random'")
    assert I.explicit_signal(added, random).first()[0] is True and I.explicit_signal(added, added).first()[0] is False


def test_prediction_audit_diagnoses(spark):
    kind = "label int, pred int, threshold int, expected int, cumulative array<double>"
    good = [(k, k, k, k, [1 - 0.1 * k, 0.5 + 0.02 * k, 0.3 + 0.01 * k, 0.1 + 0.01 * k]) for k in range(1, 6)] * 4
    up = [-1.0, 0.0, 1.0, 2.0]
    found = lambda rows, thresholds=up, **more: J.prediction_audit(spark.createDataFrame(rows, kind), thresholds, **more).first().diagnoses
    assert found(good) == "NO_IMPLEMENTATION_ERROR_FOUND"
    assert found(good, label_base=0) == "LABEL_INDEX_MISMATCH" and found(good, targets_ok=False) == "TARGET_CONSTRUCTION_ERROR" and found(good, probabilities_ok=False) == "DECODING_ERROR"
    assert found(good, [0.0, 0.0005, 1.0, 2.0]) == "THRESHOLD_DEGENERACY" == found(good, [0.0, 1.0, float("inf"), 9.0])
    shifted = [(k, max(1, k - 1), max(1, k - 1), max(1, k - 1), q) for k, _, _, _, q in good]
    assert found(shifted) == "LABEL_INDEX_MISMATCH"
    assert found([(k, 6 - k, k, 6 - k, q) for k, _, _, _, q in good]) == "DECODING_ERROR"
    flat = [(k, 3, 3, 3, [0.9, 0.5, 0.3, 0.1]) for k in range(1, 6)]
    assert found(flat) == "CLASS_COLLAPSE;THRESHOLD_DEGENERACY"


def test_anchor_is_connected_by_its_identity_link_only(spark):
    nodes = spark.createDataFrame([("A", "anchor", 0), ("B", "anchor", 1), ("C", "anchor", 2), ("d", "drug", 3)], "node_id string, node_type string, node_index int")
    edges = spark.createDataFrame([("A", "d", "MAPS", "anchor", "drug"), ("B", "d", "OTHER", "anchor", "drug"), ("d", "C", "MAPS", "drug", "anchor")], KG)
    assert {r.node_id: r.connected for r in E.anchor_index(nodes, edges, "anchor", "MAPS").collect()} == {"A": True, "B": False, "C": False}


def test_statistics_of_a_rewired_graph(spark):
    nan = float("nan")
    rows = [(1, 2, "ORIGINAL", 0.9, 0.1, 0.5, 3.0), (2, 1, "ORIGINAL", 0.7, 0.1, nan, None), (1, 3, "KG_TASK_ADDED", 0.2, 0.8, 0.7, 4.0), (3, 4, "KG_TASK_ADDED", 0.1, 0.6, None, 2.0)]
    e = spark.createDataFrame(rows, "src int, dst int, edge_origin string, original_similarity double, kg_similarity double, task_similarity double, task_overlap_count double")
    nodes = spark.createDataFrame([(i,) for i in range(1, 7)], "id int")
    r = H.graph_statistics(e, nodes, spark.createDataFrame([(0.25,)], "random double")).first()
    assert (r.original_edges, r.added_edges, r.total_directed_edges, r.min_degree, r.max_degree, r.isolated_nodes, r.components, r.largest_component, r.added_evaluable_task_edge_count) == (2, 2, 4, 0, 2, 3, 3, 4, 1)
    figures = (r.mean_degree, r.reciprocal_percentage, r.mean_original_similarity, r.added_mean_kg_similarity, r.added_mean_task_similarity, r.added_mean_task_overlap_count, r.mean_task_similarity, r.median_task_similarity, r.top_neighborhood_task_similarity, r.task_enrichment)
    assert figures == pytest.approx((4 / 6, 50.0, 0.8, 0.7, 0.7, 3.0, 0.6, 0.6, 0.6, 0.35))
    d = H.graph_diagnostics(e.select("src", "dst", F.col("original_similarity").alias("value")), nodes).first()
    assert (d.edges, d.min_degree, d.max_degree, d.isolated, d.components, d.largest_component, d.reciprocal_percentage) == (3, 0, 2, 2, 3, 4, 50.0)


def plain_nearest(rows, k, jaccard):
    out = []
    for a, x in rows.items():
        found = []
        for b, y in rows.items():
            shared = set(x) & set(y)
            if a != b and shared:
                v = len(shared) / len(set(x) | set(y)) if jaccard else sum(x[f] * y[f] for f in shared) / (math.sqrt(sum(w * w for w in x.values())) * math.sqrt(sum(w * w for w in y.values())))
                found.append((-round(v, 6), b))
        out += [(a, b, -v, at) for at, (v, b) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("measure", ["cosine", "jaccard"])
@pytest.mark.parametrize("part", [4096, 16])
def test_nearest_profiles_against_all_pairs(spark, monkeypatch, measure, part):
    """Whole in one part, and in parts that visit each other; groups, ties, negatives."""
    monkeypatch.setattr(blocked, "PART", part)
    rng = np.random.default_rng(8)
    rows = {i: {int(f): float(rng.integers(1, 6)) * (-1 if measure == "cosine" and rng.random() < 0.2 else 1) for f in rng.choice(np.arange(30) + 100 * (i % 4), rng.integers(1, 9), replace=False)} for i in range(90)}
    rows |= {200 + i: {7: 2.0, 9: 2.0} for i in range(12)}  # equal profiles
    cells = spark.createDataFrame([(i, f, v, "part") for i, x in rows.items() for f, v in x.items()] + [(None, 1, 1.0, "p"), (5, None, 1.0, "p"), (300, 1, 0.0, "p")], "row_id int, col_id int, freq double, part string")
    got = sorted((r.src, r.dst, r.value, r["rank"]) for r in blocked.profile_topk(cells, 4, measure=measure).collect())
    want = plain_nearest(rows, 4, measure == "jaccard")
    assert [(a, b, n) for a, b, _, n in got] == [(a, b, n) for a, b, _, n in want] and [v for *_, v, _ in got] == pytest.approx([v for *_, v, _ in want])
    assert blocked.profile_topk(cells.limit(0), 4, measure=measure).count() == 0


def test_summaries_of_all_cosines(spark, monkeypatch):
    monkeypatch.setattr(blocked, "VECTORS", 16)
    monkeypatch.setattr(blocked, "AGAINST", 2)
    rng = np.random.default_rng(6)
    x = rng.standard_normal((70, 5))
    x[3], x[4] = 0, x[5]
    labels = rng.integers(0, 3, 70)
    df = spark.createDataFrame([(i, v.tolist(), int(c), 0) for i, (v, c) in enumerate(zip(x, labels))], "id int, vec array<double>, label int, block int")
    with np.errstate(invalid="ignore"):
        u = np.nan_to_num(x / np.linalg.norm(x, axis=1)[:, None])
    r, c = np.triu_indices(70, 1)
    cos = np.round((u @ u.T)[r, c], 7)
    got = {d.cohort: d for d in blocked.cosine_summary(df, label="label").collect()}
    for name, values in (("all", cos), ("same", cos[labels[r] == labels[c]])):
        d = got[name]
        assert d.n == len(values) and (d["min"], d["max"]) == pytest.approx((values.min(), values.max()))
        assert (d["mean"], d["std"], d.ge_80, d.ge_99) == pytest.approx((values.mean(), values.std(), (values >= 0.8).mean(), (values >= 0.99).mean()), abs=1e-7)
        assert [d[f"p{p}"] for p in (1, 5, 25, 50, 75, 95, 99)] == pytest.approx(np.percentile(values, (1, 5, 25, 50, 75, 95, 99)).tolist(), abs=1e-7)
    pairs = {(p.src, p.dst): p.value for p in blocked.cosine_pairs(df).collect()}
    assert len(pairs) == len(cos) and all(pairs[a, b] == pytest.approx(v, abs=1e-6) for a, b, v in zip(r.tolist(), c.tolist(), cos))
    full = np.round(u @ u.T, 7)
    near = {(n.src, n["rank"]): n.dst for n in blocked.nearest_by_cosine(df, 3).collect()}
    assert near == {(i, at): j for i in range(70) for at, (_, j) in enumerate(sorted((-full[i, j], j) for j in range(70) if j != i)[:3], 1)}
    assert blocked.cosine_summary(df.limit(0)).count() == 0 == blocked.nearest_by_cosine(df.limit(0), 2).count()


def test_quantiles_of_groups_with_a_frequent_value(spark):
    rng = np.random.default_rng(1)
    values = {"a": rng.standard_normal(101).tolist(), "b": [3.0] * 500 + [1.0, 9.0], None: [2.0, 4.0]}
    df = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs], "g string, x double")
    ps = (0.0, 0.01, 0.25, 0.5, 0.9, 1.0)
    got = {r.g: r.q for r in I.quantiles(df, "x", ps, ["g"]).collect()}
    assert set(got) == set(values) and all(got[g] == pytest.approx(np.quantile(v, ps).tolist()) for g, v in values.items())
    r = I.distribution(df.where("g = 'a'"), "x").first()
    assert (r.n, r.p50, r.ge_50) == (101, pytest.approx(np.median(values["a"])), pytest.approx(np.mean(np.array(values["a"]) >= 0.5)))
