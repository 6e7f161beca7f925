"""Pairs of sparse profiles by meetings of parts: against plain loops, and what they shuffle."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.operators import blocked
from tessella.operators import meetings as M
from tessella.operators import rewire as H
from tessella.operators import sampling as P
from tessella.operators import similarity as S
from tessella.operators import stats as I


def shuffled(spark):
    """Records that all stages so far have written for a shuffle."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def profiles(n=90, seed=5):
    rng = np.random.default_rng(seed)
    rows = {i: {int(k): int(rng.integers(1, 6)) for k in rng.choice(np.arange(25) + 100 * (i % 3), rng.integers(1, 14), replace=False)} for i in range(n)}
    return rows | {300 + i: {3: 3, 103: 5, 5: 3, 7: 3} for i in range(4)}


def plain(rows):
    out = {}
    for a in rows:
        for b in rows:
            both = set(rows[a]) & set(rows[b])
            if a < b and both:
                x, y = [rows[a][k] - 3.0 for k in sorted(both)], [rows[b][k] - 3.0 for k in sorted(both)]
                xx, yy, n = sum(v * v for v in x), sum(v * v for v in y), len(both)
                cosine = sum(rows[a][k] * rows[b][k] for k in both) / math.sqrt(sum(v * v for v in rows[a].values()) * sum(v * v for v in rows[b].values()))
                masked = sum(v * w for v, w in zip(x, y)) / math.sqrt(xx * yy) if n >= 3 and xx > 0 and yy > 0 else None
                out[a, b] = (n, cosine, masked, n >= 3 and not (xx > 0 and yy > 0), n / len(set(rows[a]) | set(rows[b])), n / min(len(rows[a]), len(rows[b])))
    return out


def cells_of(spark, rows, ids=lambda i: i, kind="int"):
    return spark.createDataFrame([(ids(i), k, v) for i, x in rows.items() for k, v in x.items()], f"row_id {kind}, col_id int, freq int")


@pytest.mark.parametrize("part", [8192, 7])
def test_pairs_against_plain_loops(spark, monkeypatch, part):
    monkeypatch.setattr(M, "PART", part)
    rows = profiles()
    want, cells = plain(rows), cells_of(spark, rows)
    cosine = {(r.src, r.dst): r.value for r in S.profile_cosine(cells).collect()}
    assert set(cosine) == set(want) and all(v == pytest.approx(want[p][1]) for p, v in cosine.items())
    masked = {(r.src, r.dst): r for r in S.masked_cosine(cells).collect()}
    assert set(masked) == set(want) and all((r.overlap, r.degenerate) == (want[p][0], want[p][3]) and r.value == (None if want[p][2] is None else pytest.approx(want[p][2])) for p, r in masked.items())
    sets = {(r.src, r.dst): r for r in S.set_overlap(cells, "row_id", "col_id").collect()}
    assert set(sets) == set(want) and all((r.shared, r.jaccard, r.overlap) == (want[p][0], pytest.approx(want[p][4]), pytest.approx(want[p][5])) for p, r in sets.items())


def test_names_as_ids_and_columns(spark):
    rows = profiles(30)
    sets = cells_of(spark, rows, lambda i: f"s{i}", "string").select(F.col("row_id").alias("owner"), F.concat(F.lit("k"), "col_id").alias("item"))
    got = {(r.src, r.dst): r.shared for r in S.set_overlap(sets).collect()}
    assert got == {tuple(sorted((f"s{a}", f"s{b}"))): x[0] for (a, b), x in plain(rows).items()}


@pytest.mark.parametrize("cells, products, dense", [(1_000_000, 1_000_000, 64), (200, 30, 0), (500, 7, 10**9), (130, 1000, 3)])
def test_blocks_are_added_up_in_pieces(monkeypatch, cells, products, dense):
    """Sparse and wide columns, few products and rows at a time."""
    for name, value in (("CELLS", cells), ("PRODUCTS", products), ("DENSE", dense)):
        monkeypatch.setattr(M, name, value)
    rows = profiles(60)
    side = lambda ids: M._Side(pa.table({"id": pa.array(ids, pa.int64()), "layer": pa.array([0] * len(ids), pa.int32()), "ks": pa.array([sorted(rows[i]) for i in ids], pa.list_(pa.int64())), "xs": pa.array([[rows[i][k] - 3.0 for k in sorted(rows[i])] for i in ids], pa.list_(pa.float64())), "size": pa.array([1.0] * len(ids))}), 1)
    want, ids = plain(rows), list(rows)
    for a, b in ((ids[:31], ids[31:]), (ids, ids)):
        found = {}
        for block in M._blocks(side(a), side(b), a is b, [("x", "masked", None, 3)], False):
            held = block.layers["x"]
            for r, c in zip(*np.nonzero(held.known)):
                found[block.ids[r], block.others[c]] = (held.overlap[r, c], held.degenerate[r, c], held.value[r, c])
        expected = {p: x for p, x in want.items() if a is b or (p[0] in a and p[1] in b)}
        assert set(found) == set(expected)
        assert all(found[p][0] == x[0] and bool(found[p][1]) == x[3] and (math.isnan(found[p][2]) if x[2] is None else found[p][2] == pytest.approx(x[2])) for p, x in expected.items())


def test_products_of_cells_are_not_shuffled(spark):
    """300 profiles of 40 cells in 60 columns make 1.2 million products and 44,850 pairs."""
    cells = spark.range(300 * 40).select((F.col("id") % 300).alias("row_id"), ((F.col("id") % 300 * 7 + F.floor(F.col("id") / 300) * F.lit(1)) % 60).alias("col_id"), (F.col("id") % 5 + 1).cast("int").alias("freq"))
    for of in (S.profile_cosine, S.masked_cosine, lambda c: S.set_overlap(c, "row_id", "col_id"), lambda c: S.profile_topk(c, 5), lambda c: S.profile_topk(c, 5, measure="jaccard")):
        before = shuffled(spark)
        assert of(cells).count() >= 1500
        assert shuffled(spark) - before < 4 * cells.count()


def test_wanted_nearest_counts_and_differences_without_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(M, "PART", 9)
    rows = profiles()
    want, cells = plain(rows), cells_of(spark, rows)
    layers = {"s": S.profile_layer(cells), "t": S.masked_layer(cells), "g": S.set_layer(cells, 6, "row_id", "col_id")}
    asked = [(a, b) for a in list(rows)[:20] for b in list(rows)[::7] if a != b] + [(1, 999)]
    got = {(r.src, r.dst): r for r in M.pair_values(layers, spark.createDataFrame(asked, "src int, dst int")).collect()}
    known = {p: want[min(p), max(p)] for p in asked if (min(p), max(p)) in want}
    assert set(got) == set(known)
    assert all(got[p].s == pytest.approx(x[1], abs=6e-7) and got[p].g_shared == x[0] and got[p].t == (None if x[2] is None else pytest.approx(x[2], abs=6e-7)) for p, x in known.items())

    near = M.nearest({"t": layers["t"]}, 3, lambda block: block.layers["t"].value, 6)
    both = {p: x[2] for (a, b), x in want.items() if x[2] is not None for p in ((a, b), (b, a))}
    best = {(a, at): b for a in rows for at, (_, b) in enumerate(sorted((-math.copysign(math.floor(abs(v) * 1e6 + 0.5), v), b) for (c, b), v in both.items() if c == a)[:3], 1)}
    assert {(r.src, r["rank"]): r.dst for r in near.collect()} == best

    counts = {round(r.value, 6): r.n for r in M.value_counts({"s": layers["s"]}, lambda block: block.layers["s"].value, 6).collect()}
    values = [math.floor(x[1] * 1e6 + 0.5) / 1e6 for x in want.values()]
    assert counts == {v: values.count(v) for v in set(values)}

    view = lambda name: S.mirrored(M.all_pairs({"value": layers[name]}).select("src", "dst", "value"))
    one, other = H.layers_diff(layers["s"], layers["g"], 10).first(), H.matrix_diff(view("s"), view("g"), 10).first()
    assert one.cells == other.cells and list(one) == pytest.approx(list(other))


def test_support_of_pairs_does_not_shuffle_their_items(spark):
    sets = spark.range(100 * 60).select((F.col("id") % 100).alias("owner"), (F.floor(F.col("id") / 100) + F.col("id") % 100 % 7).alias("item"))
    pairs = spark.range(100 * 100).select(F.lit("x").alias("cohort"), F.floor(F.col("id") / 100).alias("src"), (F.col("id") % 100).alias("dst")).where("src < dst")
    before = shuffled(spark)
    rows = I.pair_support(pairs, sets, sets.where("item < 9")).collect()
    assert shuffled(spark) - before < 120_000
    own = {o: {i + o % 7 for i in range(60)} for o in range(100)}
    assert len(rows) == 4950 and all(r.shared_gene_count == len(own[r.src] & own[r.dst]) and r.source_pathway_count == sum(i < 9 for i in own[r.src]) for r in rows)


def test_a_distribution_keeps_distinct_values_only(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(I, "written", lambda df, name, real=I.written: kept.append(real(df, name)) or kept[-1])
    r = I.distribution(spark.range(5000).select((F.col("id") % 10 / 10.0).alias("x")), "x").first()
    assert (r.n, r.mean, r.std, r.p50, r.ge_80) == (5000, pytest.approx(0.45), pytest.approx(np.std(np.arange(10) / 10)), pytest.approx(0.45), pytest.approx(0.2))
    assert max(k.count() for k in kept) == 10


def test_one_value_has_no_correlation_whatever_its_partitions(spark):
    """49 times a 49th isn't 1."""
    df = spark.range(0, 98, 1, 2).select(F.lit(1.0).alias("x"), F.col("id").cast("double").alias("y"))
    assert I.pearson(df, "x", "y").first().r is None and I.spearman(df, "x", "y").first().r is None


def test_only_edges_without_a_free_draw_draw_again(spark):
    e = spark.range(3000).select((F.col("id") % 300).cast("string").alias("source"), F.lit("r").alias("relation"), F.concat(F.lit("g"), (F.col("id") * 7 % 997).cast("string")).alias("target"), F.lit("drug").alias("source_type"), F.lit("gene").alias("target_type")).distinct()
    pools = P.type_pools(e.select(F.col("source_type").alias("node_type"), F.col("source").alias("node_id")).union(e.select("target_type", "target")).distinct())
    before = shuffled(spark)
    got = P.negative_samples(e, pools, e, attempts=40).collect()
    assert shuffled(spark) - before < 60_000
    own = {(r.source, r.target) for r in e.collect()}
    assert len(got) == len(own) and all((r.neg_source, r.neg_target) not in own and (r.neg_source == r.source) != (r.neg_target == r.target) for r in got)


def test_vectors_are_sent_once_for_each_large_block(spark, monkeypatch):
    monkeypatch.setattr(blocked, "VECTORS", 16)
    monkeypatch.setattr(blocked, "AGAINST", 2)
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(64)], "id int, vec array<double>")
    assert blocked._faced(blocked._unit(df, "id", "vec")).count() == 2 * 64 * 2
    assert blocked.cosine_pairs(df).count() == 64 * 63 // 2
