"""Rule tables and formulas on literal rows."""

import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.operators import contracts as B
from tessella.operators import evaluate as J
from tessella.operators import kg as E
from tessella.operators import resolve as D
from tessella.operators import rewire as H
from tessella.operators import sampling as P
from tessella.operators import similarity as S
from tessella.operators import stats as I


def one(df):
    return df.first()[0]


def test_text_functions(spark):
    df = spark.createDataFrame([("  Straße\tA.B  ",), ("ﬁne",), (None,)], "s string")
    assert [r[0] for r in df.select(X.normalize_text("s")).collect()] == ["strasse a.b", "fine", None]
    assert df.select(X.normalize_dots("s")).first()[0] == "strasse a b"
    ids = spark.createDataFrame([("umls:c0000001",), ("C12",), (None,)], "s string")
    assert [r[0] for r in ids.select(X.extract_cui("s")).collect()] == ["C0000001", None, None]
    assert one(spark.range(1).select(X.json_ids(F.array(F.lit("b"), F.lit("a"), F.lit("b"))))) == '["a","b"]'
    assert one(spark.range(1).select(X.parse_ids(F.lit("")))) == []
    with pytest.raises(Exception, match="not a JSON list"):
        spark.range(1).select(X.parse_ids(F.lit("{"))).collect()
    with pytest.raises(Exception, match="not a boolean"):
        spark.range(1).select(X.parse_bool(F.lit("maybe"))).collect()
    assert one(spark.range(1).select(X.namespace(F.lit("HP_1"), F.lit(None).cast("string")))) == "HPO"
    assert one(spark.range(1).select(X.anchor_id("A", F.lit(1234)))) == "A_1234"
    assert one(spark.range(1).select(X.is_combination(F.lit("a.and.b")))) is True


@pytest.mark.parametrize(
    ("status", "selected", "method", "names", "structures", "expected", "proposed", "final"),
    [
        ("resolved", "a", "unique_exact", ["a"], ["a"], "confirmed_name_structure", "a", "resolved"),
        ("resolved", "a", "unique_exact", ["a"], ["b"], "conflicting_evidence", "", "review_required"),
        ("resolved", "a", "canonical_name_disambiguation", ["a", "b"], [], "supported_canonical_name", "a", "resolved"),
        ("resolved", "a", "unique_exact", ["a"], [], "name_only_resolved", "a", "resolved"),
        ("resolved", "a", "synonym_disambiguation", ["a", "b"], [], "name_only_resolved", "a", "resolved"),
        ("ambiguous", None, None, ["a", "b"], ["b"], "resolved_by_unique_structure_candidate", "b", "resolved"),
        ("ambiguous", None, None, ["a", "b"], ["b", "c"], "resolved_by_unique_intersection", "b", "resolved"),
        ("ambiguous", None, None, ["a", "b"], [], "unresolved_ambiguous", "", "unresolved"),
        ("unmatched", None, None, [], ["c"], "structure_only_candidate", "c", "review_required"),
        ("unmatched", None, None, [], ["c", "d"], "unresolved_ambiguous", "", "unresolved"),
        ("unmatched", None, None, [], [], "unresolved_unmatched", "", "unresolved"),
    ],
)
def test_fusion_classes(spark, status, selected, method, names, structures, expected, proposed, final):
    df = spark.createDataFrame([(status, selected, method, names, structures)], "name_status string, selected string, method string, name_ids array<string>, structure_ids array<string>")
    r = D.fuse_evidence(df).first()
    assert (r.evidence_class, r.proposed_id, r.final_status) == (expected, proposed, final)


def test_masked_cosine_needs_overlap_and_norm(spark):
    cells = spark.createDataFrame([(a, c, f) for a in (1, 2) for c, f in ((1, 5), (2, 1))] + [(3, c, 3) for c in (1, 2, 3)] + [(4, c, 5) for c in (1, 2, 3)], "row_id int, col_id int, freq int")
    got = {(r.src, r.dst): (r.overlap, r.degenerate, r.value) for r in S.masked_cosine(cells).collect()}
    assert got[1, 2] == (2, False, None)
    assert got[3, 4] == (3, True, None)


def test_jaccard_conventions(spark):
    z = F.lit(0)
    assert one(spark.range(1).select(S.jaccard(z, z, z))) is None
    assert one(spark.range(1).select(S.jaccard(z, z, z, 0.0))) == 0.0
    with pytest.raises(Exception, match="outside"):
        spark.range(1).select(S.clip_unit(F.lit(1.1))).collect()


def test_top_k_puts_nan_last_and_breaks_ties_by_id(spark):
    df = spark.createDataFrame([(1, 2, float("nan")), (1, 3, 0.5), (1, 4, 0.5), (1, 1, 9.0)], "src int, dst int, value double")
    assert [r.dst for r in S.top_k(df, 3).orderBy("rank").collect()] == [3, 4, 2]


def test_components_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101)], "src long, dst long")
    n = spark.createDataFrame([(i,) for i in range(31)] + [(100,), (101,), (200,)], "id long")
    got = {r.id: r.component for r in H.connected_components(e, n).collect()}
    assert {got[i] for i in range(31)} == {0} and got[101] == 100 and got[200] == 200


def test_confusion_metrics_match_published_figures(spark):
    cm = [(1, 1, 5), (1, 2, 5), (2, 2, 10), (3, 1, 10)]
    df = spark.createDataFrame([(a, b) for a, b, n in cm for _ in range(n)], "label int, pred int")
    m = {r["class"]: r for r in J.class_metrics(J.confusion(df, 5)).collect()}
    assert m[1].precision == pytest.approx(1 / 3) and m[1].recall == 0.5 and m[2].f1 == pytest.approx(0.8) and m[4].f1 == 0 and m[4].support == 0
    assert J.ordinal_metrics(J.confusion(df.where("label = pred and label = 2"), 5)).first().qwk == 0.0


def test_decoders_round_half_to_even(spark):
    q = F.array(F.lit(1.0), F.lit(0.5), F.lit(0.0), F.lit(0.0))
    assert one(spark.range(1).select(J.decode(J.cumulative_to_class(q), q, "expected"))) == 3
    assert one(spark.range(1).select(J.decode(J.cumulative_to_class(q), q, "threshold"))) == 2


def test_splits_are_disjoint_and_stable(spark):
    df = spark.range(1003).select((F.col("id") % 3).alias("label"), "id")
    folds = P.stratified_kfold(df, "label", ["id"], 10)
    sizes = [r["count"] for r in folds.groupBy("fold").count().collect()]
    assert sum(sizes) == 1003 and max(sizes) - min(sizes) <= 1
    a = {r.id: r.fold for r in folds.collect()}
    assert a == {r.id: r.fold for r in P.stratified_kfold(df.repartition(7), "label", ["id"], 10).collect()}
    edges = spark.createDataFrame([("r", i, i) for i in range(25)] + [("s", 1, 1)] + [("t", i, i) for i in range(2)], "relation string, source int, target int")
    got = {(r.relation, r.train): r["count"] for r in P.relation_split(edges, 0.1).groupBy("relation", "train").count().collect()}
    assert got == {("r", True): 23, ("r", False): 2, ("s", True): 1, ("t", True): 1, ("t", False): 1}


def test_negatives_are_unknown(spark):
    from tessella.plans.sampling_queries import edges, negative_samples

    neg = negative_samples(spark, "/root/testdata/sf0.001")
    known = edges(spark, "/root/testdata/sf0.001").select(F.col("source").cast("string").alias("neg_source"), "relation", F.concat(F.lit("g"), "target").alias("neg_target"))
    assert neg.join(known, ["neg_source", "relation", "neg_target"], "left_semi").isEmpty()


def test_every_positive_has_a_negative(spark):
    from tessella.plans.sampling_queries import edges, negative_samples

    neg = negative_samples(spark, "/root/testdata/sf0.001")
    assert neg.count() == edges(spark, "/root/testdata/sf0.001").count()
    assert neg.where("neg_source is null or neg_target is null").isEmpty()


def test_negatives_of_a_dense_relation(spark):
    """All but one cell of r are known, and all of s."""
    cells = [("r", f"a{i}", f"b{j}") for i in range(12) for j in range(12) if (i, j) != (3, 4)] + [("s", f"a{i}", f"b{j}") for i in range(12) for j in range(12)]
    e = spark.createDataFrame([(a, r, b, "x", "y") for r, a, b in cells], "source string, relation string, target string, source_type string, target_type string")
    pools = spark.createDataFrame([(t, i, f"{p}{i}") for t, p in (("x", "a"), ("y", "b")) for i in range(12)], "type string, at long, id string")
    got = {(r.relation, r.source, r.target): (r.neg_source, r.neg_target) for r in P.negative_samples(e, pools, e).collect()}
    assert len(got) == len(cells)
    for (relation, a, b), n in got.items():
        assert n == (("a3", "b4") if relation == "r" and (a == "a3" or b == "b4") else (None, None))


def test_edges_merge_sources_between_bars(spark):
    rows = [("a", "b", "r", "x", "y", "p|q"), ("a", "b", "r", "x", "y", "q||o"), ("a", "c", "r", "x", "y", None)]
    got = {r.target: r.original_source for r in E.dedup_edges(spark.createDataFrame(rows, "source string, target string, relation string, source_type string, target_type string, original_source string")).collect()}
    assert got == {"b": "o|p|q", "c": ""}


def test_ranks(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 2.0, 2.0, 5.0)], "x double")
    assert sorted(r["rank"] for r in I.avg_rank(df, "x").collect()) == [1.0, 2.5, 2.5, 4.0]
    by = spark.createDataFrame([(g, x) for g in "ab" for x in (3.0, 1.0, 3.0)], "g string, x double")
    assert sorted((r.g, r["rank"]) for r in I.avg_rank(by, "x", by=["g"]).collect()) == [("a", 1.0), ("a", 2.5), ("a", 2.5), ("b", 1.0), ("b", 2.5), ("b", 2.5)]
    assert I.pearson(df.withColumn("y", F.lit(1.0)), "x", "y").first().r is None


@pytest.mark.parametrize(("x", "dof"), [(0.0, 3), (0.5, 1), (4.0, 1), (4.0, 2), (4.0, 3), (4.0, 4), (11.07, 5), (30.0, 7), (100.0, 1), (3.3, 25), (60.0, 40)])
def test_chi_square_tail_of_every_degree(spark, x, dof):
    """Against the integral of the density, by Simpson's rule in the square root of x."""
    n = 20_000
    density = lambda u: 2 * u ** (dof - 1) * math.exp(-u * u / 2) / (2 ** (dof / 2) * math.gamma(dof / 2)) if u or dof == 1 else 0.0
    end = math.sqrt(x)
    below = sum((1 if i in (0, n) else 4 if i % 2 else 2) * density(end * i / n) for i in range(n + 1)) * end / n / 3
    assert one(spark.range(1).select(I.chi2_sf(F.lit(x), F.lit(dof)))) == pytest.approx(1 - below, abs=1e-8)


def groups(spark, rows):
    return spark.createDataFrame(rows, "class string, x double")


def test_kruskal_by_hand(spark):
    """Ranks a 1, 2 and b 3, 4: H = 12 / 20 (9 / 2 + 49 / 2) - 15 = 2.4, epsilon squared (2.4 - 1) / 2."""
    r = I.kruskal(groups(spark, [("a", 1.0), ("a", 2.0), ("b", 3.0), ("b", 4.0)]), "x").first()
    assert (r.n, r.dof) == (4, 1) and r.h == pytest.approx(2.4) and r.p == pytest.approx(math.erfc(math.sqrt(1.2))) and r.epsilon2 == pytest.approx(0.7)
    tied = I.kruskal(groups(spark, [("a", 1.0), ("b", 1.0), ("b", 1.0)]), "x").first()
    assert (tied.h, tied.dof, tied.p, tied.epsilon2) == (0.0, 1, 1.0, 0.0)
    single = I.kruskal(groups(spark, [("a", 1.0), ("a", 2.0)]), "x").first()
    assert (single.h, single.dof, single.p, single.epsilon2) == (0.0, 0, 1.0, 0.0)


@pytest.mark.parametrize("statistic", ["kruskal", "spearman"])
def test_permutations_against_a_plain_loop(spark, statistic):
    rows = [(i, i % 3, float((i * 7) % 11 + 4 * (i % 3))) for i in range(30)]
    got = I.permutation_test(spark.createDataFrame(rows, "id int, y int, x double"), "x", "y", "id", 40, statistic=statistic).first()
    ranks = pd.Series([x for *_, x in rows]).rank().to_numpy()
    labels = np.array([y for _, y, _ in rows])

    def stat(y):
        if statistic == "spearman":
            return abs(np.corrcoef(ranks, pd.Series(y).rank())[0, 1])
        n = len(y)
        ties = pd.Series(ranks).value_counts().to_numpy()
        h = 12 / (n * (n + 1)) * sum(ranks[y == c].sum() ** 2 / (y == c).sum() for c in set(y)) - 3 * (n + 1)
        return max(0.0, h / (1 - (ties**3 - ties).sum() / (n**3 - n)))

    hits = 0
    for rep in range(1, 41):
        order = sorted(range(30), key=lambda i: (hashlib.md5(f"42:{rep}:{i}".encode()).hexdigest(), i))
        shuffled = np.empty(30, int)
        shuffled[order] = np.sort(labels)
        hits += stat(shuffled) >= stat(labels) - 1e-9
    assert got.observed == pytest.approx(stat(labels)) and got.p == pytest.approx((hits + 1) / 41)


def test_permutations_of_one_label(spark):
    df = spark.createDataFrame([(i, 1, float(i)) for i in range(5)], "id int, y int, x double")
    for s in ("kruskal", "spearman"):
        r = I.permutation_test(df, "x", "y", "id", 5, statistic=s).first()
        assert (r.observed, r.p) == (0.0, 1.0)


def test_sign_flips(spark):
    r = I.paired_sign_flip(spark.createDataFrame([(1, 2.0), (2, -1.0), (3, 3.0), (4, 0.0)], "k int, d double"), "d", "k", 50).first()
    assert r.rank_biserial == pytest.approx(1 / 3) and r.mean == 1.0 and r.dz == pytest.approx(1 / np.std([2, -1, 3, 0], ddof=1))
    flat = I.paired_sign_flip(spark.createDataFrame([(1, 0.0), (2, 0.0)], "k int, d double"), "d", "k", 10).first()
    assert (flat.mean, flat.dz, flat.rank_biserial, flat.p) == (0.0, 0.0, 0.0, 1.0)


@pytest.mark.parametrize(
    ("coverage", "pearson", "spearman", "j5", "j10", "expected"),
    [
        (0.09, 0.9, 0.9, 0.9, 0.9, "INSUFFICIENT_COVERAGE"), (0.5, None, 0.9, 0.9, 0.9, "INSUFFICIENT_COVERAGE"), (0.5, float("nan"), 0.9, 0.9, 0.9, "INSUFFICIENT_COVERAGE"),
        (0.1, 0.0, 0.70, 0.0, 0.50, "HIGHLY_REDUNDANT_WITH_KG"), (0.5, 0.0, 0.70, 0.0, 0.49, "MODERATELY_RELATED"), (0.5, 0.0, 0.30, 0.0, 0.20, "MODERATELY_RELATED"),
        (0.5, 0.04, -0.04, 0.5, 0.02, "EFFECTIVELY_UNRELATED"), (0.5, 0.05, 0.0, 0.0, 0.0, "COMPLEMENTARY"), (0.5, 0.0, 0.3, 0.0, 0.19, "COMPLEMENTARY"),
    ],
)
def test_redundancy_classes(spark, coverage, pearson, spearman, j5, j10, expected):
    df = spark.createDataFrame([(coverage, pearson, spearman, j5, j10)], "a double, b double, c double, d double, e double")
    assert one(df.select(I.redundancy_class(*map(F.col, "abcde")))) == expected


@pytest.mark.parametrize(
    ("provenance", "status", "r", "gain", "kind", "priority", "mode"),
    [
        ("LABEL_DERIVED", "SAFE_TRAIN_ONLY", 0.1, 0.0, "COMPLEMENTARY", "DO_NOT_REWIRE", "DO_NOT_MODIFY"), ("HYBRID", "SAFE_EXTERNAL", 0.1, 0.0, "COMPLEMENTARY", "DO_NOT_REWIRE", "DO_NOT_MODIFY"),
        ("EXTERNAL_STATIC", "UNKNOWN", 0.1, 0.0, "COMPLEMENTARY", "DO_NOT_REWIRE", "DO_NOT_MODIFY"),
        ("EXTERNAL_STATIC", "SAFE_EXTERNAL", -0.34, 0.14, "COMPLEMENTARY", "HIGH_PRIORITY_REWIRING_CANDIDATE", "ADD_EDGES_WITH_KG_SUPPORT"),
        ("EXTERNAL_STATIC", "SAFE_EXTERNAL", 0.35, 0.0, "COMPLEMENTARY", "MEDIUM_PRIORITY", "KEEP_MATRIX_BUILD_TASK_ADJACENCY"), ("EXTERNAL_STATIC", "SAFE_EXTERNAL", None, 0.0, "COMPLEMENTARY", "MEDIUM_PRIORITY", "KEEP_MATRIX_BUILD_TASK_ADJACENCY"),
        ("EXTERNAL_STATIC", "SAFE_EXTERNAL", 0.1, 0.0, "MODERATELY_RELATED", "MEDIUM_PRIORITY", "KEEP_MATRIX_BUILD_TASK_ADJACENCY"),
        ("EXTERNAL_STATIC", "SAFE_EXTERNAL", 0.1, 0.0, "HIGHLY_REDUNDANT_WITH_KG", "LOW_PRIORITY", "KEEP_MATRIX_BUILD_TASK_ADJACENCY"), ("EXTERNAL_STATIC", "SAFE_EXTERNAL", -0.5, 0.0, "EFFECTIVELY_UNRELATED", "LOW_PRIORITY", "KEEP_MATRIX_BUILD_TASK_ADJACENCY"),
        ("EXTERNAL_STATIC", "SAFE_EXTERNAL", 0.49, 0.0, "INSUFFICIENT_COVERAGE", "NEEDS_MORE_EVIDENCE", "NEEDS_REVIEW"), ("EXTERNAL_STATIC", "SAFE_EXTERNAL", None, None, "EFFECTIVELY_UNRELATED", "NEEDS_MORE_EVIDENCE", "NEEDS_REVIEW"),
    ],
)
def test_rewiring_decisions(spark, provenance, status, r, gain, kind, priority, mode):
    df = spark.createDataFrame([(provenance, status, r, gain, kind)], "provenance string, leakage_status string, correlation double, enrichment double, complementarity string")
    got = I.rewiring_decision(df).first()
    assert (got.priority, got.mode) == (priority, mode)


def test_ranking_of_candidates(spark):
    rows = [("DRUG", 1, 0.2, 0.1, 0.3, "MEDIUM_PRIORITY", "EXTERNAL_STATIC"), ("SIDE", 0, 0.2, 0.1, 0.3, "MEDIUM_PRIORITY", "EXTERNAL_STATIC"), ("SIDE", 2, None, -1.0, None, "HIGH_PRIORITY_REWIRING_CANDIDATE", "EXTERNAL_STATIC"), ("DRUG", 3, 0.0, 0.0, 0.0, "HIGH_PRIORITY_REWIRING_CANDIDATE", "LABEL_DERIVED")]
    df = spark.createDataFrame(rows, "entity_type string, view_index int, correlation double, enrichment double, jaccard_10 double, priority string, provenance string").withColumn("leakage_status", F.lit("SAFE_EXTERNAL"))
    got = [(r.view_index, r["rank"], round(r.score, 9)) for r in I.rank_candidates(df).orderBy("rank").collect()]
    assert got == [(2, 1, 4.15), (1, 2, round(3.05 + 0.25 * 0.8 + 0.15 * 0.9 + 0.1 * 0.7, 9)), (0, 3, round(3.0 + 0.25 * 0.8 + 0.15 * 0.9 + 0.1 * 0.7, 9))]


@pytest.mark.parametrize(
    ("everything", "top20", "expected"),
    [
        ((0.505, 0.1, 0.505, 0.0), (0.9, 0.1, 0.9, 0.9), "NOT_DISTINGUISHABLE_FROM_GLOBAL_COSINE_DISTRIBUTION"), ((0.4, 0.1, 0.4, 0.0), (0.5, 0.1, 0.5, 0.04), "DISTINGUISHABLE_FROM_GLOBAL_BUT_NOT_FROM_TOP20_NEIGHBORS"),
        ((0.48, 0.1, 0.4, 0.0), (0.9, 0.1, 0.9, 0.0), "WEAKLY_DISTINGUISHABLE_FROM_GLOBAL_COSINE_DISTRIBUTION"), ((0.4, 0.1, 0.4, 0.0), (0.9, 0.1, 0.9, 0.0), "DISTINGUISHABLE_FROM_GLOBAL_COSINE_DISTRIBUTION"),
        ((0.5, 0.0, 0.5, 0.0), (0.9, 0.1, 0.9, 0.0), "DISTINGUISHABLE_FROM_GLOBAL_COSINE_DISTRIBUTION"),
    ],
)
def test_cohort_verdicts(spark, everything, top20, expected):
    row = lambda *x: spark.createDataFrame([x], "mean double, std double, p50 double, ge_99 double")
    assert I.distinguishability(row(0.5, 0.1, 0.5, 0.0), row(*everything), row(*top20)).first().verdict == expected


@pytest.mark.parametrize(
    ("p50", "ge_95", "ge_99", "rank", "largest", "distinct", "weak", "expected"),
    [
        (0.99, 0.9, 0.6, 12.0, 1, 100, False, "STRONG_REPRESENTATION_COLLAPSE"), (0.5, 0.0, 0.0, 60.0, 10, 100, True, "STRONG_REPRESENTATION_COLLAPSE"), (0.91, 0.0, 0.0, 60.0, 1, 100, True, "HIGH_SIMILARITY_COMPRESSION"),
        (0.5, 0.51, 0.0, 60.0, 1, 100, False, "HIGH_SIMILARITY_COMPRESSION"), (0.5, 0.0, 0.0, 32.0, 1, 100, False, "HEALTHY_DISCRIMINATION"), (0.5, 0.0, 0.0, 31.9, 1, 100, False, "INCONCLUSIVE"),
        (0.5, 0.0, 0.0, 60.0, 1, 74, False, "INCONCLUSIVE"), (0.5, 0.0, 0.0, 60.0, 1, 75, True, "HEALTHY_DISCRIMINATION"),
    ],
)
def test_collapse_verdicts(spark, p50, ge_95, ge_99, rank, largest, distinct, weak, expected):
    pairs = spark.createDataFrame([(p50, ge_95, ge_99)], "p50 double, ge_95 double, ge_99 double")
    dup = spark.createDataFrame([(largest, distinct, 100)], "largest long, distinct long, all long")
    assert I.collapse_diagnosis(pairs, F.lit(rank), 128, dup, F.lit(weak)).first().verdict == expected


def test_collapse_advice(spark):
    cases = [("HEALTHY_DISCRIMINATION", True, "KEEP"), ("STRONG_REPRESENTATION_COLLAPSE", True, "REPLACE"), ("HIGH_SIMILARITY_COMPRESSION", True, "REPLACE"), ("STRONG_REPRESENTATION_COLLAPSE", False, "RETRAIN"), ("HIGH_SIMILARITY_COMPRESSION", False, "NEEDS"), ("INCONCLUSIVE", True, "NEEDS")]
    for verdict, signal, start in cases:
        assert one(spark.range(1).select(I.collapse_advice(F.lit(verdict), F.lit(signal)))).startswith(start)


def test_spectrum_of_known_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((50, 6)) * [5, 4, 3, 2, 1, 0]
    got = I.spectrum(spark.createDataFrame([(v.tolist(),) for v in x], "vec array<double>")).orderBy("component").collect()
    s = np.linalg.svd(x - x.mean(0), compute_uv=False)
    p = s**2 / (s**2).sum()
    assert [r.singular_value for r in got] == pytest.approx(s.tolist(), abs=1e-6) and [r.cumulative for r in got] == pytest.approx(np.cumsum(p).tolist())
    assert [r.dimension_std for r in got] == pytest.approx(x.std(0).tolist()) and got[0].norm_max == pytest.approx(np.linalg.norm(x, axis=1).max())
    assert got[0].numerical_rank == 5 and got[0].near_zero_dimensions == 1
    y = rng.standard_normal((1000, 8))
    y[:, 7] = y[:, 0] + y[:, 3]
    assert {(r.numerical_rank, r.near_zero_dimensions) for r in I.spectrum(spark.createDataFrame([(v.tolist(),) for v in y], "vec array<double>").repartition(20)).collect()} == {(7, 0)}
    assert {r.numerical_rank for r in I.spectrum(spark.createDataFrame([([1.0, 2.0],), ([3.0, 2.0],)], "vec array<double>")).collect()} == {1}
    assert got[0].effective_rank == pytest.approx(math.exp(-sum(q * math.log(q) for q in p if q > 1e-30)))


def test_matched_controls_against_all_candidates(spark):
    rng = np.random.default_rng(2)
    degree = {f"s{i:02}": int(rng.integers(0, 12)) for i in range(40)}
    known = {(f"d{d}", s) for d in range(6) for s in degree if rng.random() < (0.2, 0.5, 0.9, 0.97, 1.0, 0.1)[d]}
    deg = P.rank_bins(spark.createDataFrame(list(degree.items()), "side string, degree long"), "degree", "side", 10)
    bins = {r.side: r.bin for r in deg.collect()}
    assert bins == {s: i * 10 // 40 for i, s in enumerate(sorted(degree, key=lambda s: (degree[s], s)))}
    pairs = spark.createDataFrame(sorted(known), "drug string, side string")
    got = {(r.drug, r.side): (r.control, r.control_degree) for r in P.matched_controls(pairs, deg, pairs).collect()}
    assert set(got) == known
    used = set()
    for (drug, side), (control, control_degree) in got.items():
        free = [s for s in degree if (drug, s) not in known]
        if not free:
            assert control is None
            continue
        near = min(abs(bins[s] - bins[side]) for s in free)
        free = [s for s in free if abs(bins[s] - bins[side]) == near]
        gap = min(abs(degree[s] - degree[side]) for s in free)
        assert control in [s for s in free if abs(degree[s] - degree[side]) == gap] and control_degree == degree[control]
        used.add(control)
    assert len(used) > 10


def test_experiment_signals(spark):
    df = spark.createDataFrame([("clean", 0.6), ("zero", 0.55), ("kg", 0.58), ("task", 0.61)], "model string, metric double")
    got = {r.model: (r.signal, r.improves, r.strength_rank) for r in J.compare_experiments(df, "clean", "zero").collect()}
    assert got == {"zero": ("NEGATIVE", "NO", 3), "kg": ("POSITIVE", "NO", 2), "task": ("POSITIVE", "YES", 1)}


def test_word_lists(spark):
    assert set(one(spark.range(1).select(X.significant_tokens(F.lit("Potassium chloride ion human maleate"))))) == {"potassium", "human"}
    yes = lambda name, *types: one(spark.range(1).select(X.is_biologic(F.lit(name), F.array(*map(F.lit, types)).cast("array<string>"))))
    assert yes("Insulin.lispro") and yes("x", "Protein") and not yes("vaccine", "Small molecule") and not yes("x")


def test_contracts_fail_where_they_should(spark):
    df = spark.createDataFrame([(0, "a"), (2, "b"), (None, "b")], "i int, s string")
    assert not B.expect_dense_index(df, "i").first().passed
    assert not B.expect_unique(df, "s").first().passed
    assert not B.finite_check(df, ["i"]).first().passed
    assert B.expect_domain(df, "s", ["a", "b"]).first().passed
    a, b = B.table_fingerprint(df).first(), B.table_fingerprint(df.repartition(3)).first()
    assert a == b and a != B.table_fingerprint(df.where("i = 0")).first()
