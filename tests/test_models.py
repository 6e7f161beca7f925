import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.operators import evaluate as J
from tessella.operators import permutation as R
from tessella.operators import sampling as P
from tessella.operators import stats as I


def statistic(ranks, y, kind):
    if kind == "spearman":
        return abs(np.corrcoef(ranks, pd.Series(y).rank())[0, 1])
    n, ties = len(y), pd.Series(ranks).value_counts().to_numpy().astype(float)
    h = 12 / (n * (n + 1)) * sum(ranks[y == c].sum() ** 2 / (y == c).sum() for c in set(y)) - 3 * (n + 1)
    return max(0.0, h / (1 - (ties**3 - ties).sum() / (n**3 - n)))


@pytest.mark.parametrize("kind", ["kruskal", "spearman"])
def test_shuffles_by_counts_agree_with_a_plain_loop(spark, kind, monkeypatch):
    monkeypatch.setattr(R, "FAN", 4)  # a tree of three levels
    r = np.random.default_rng(5)
    y = r.integers(0, 3, 120)
    x = r.integers(0, 40, 120) + 2 * y
    df = spark.createDataFrame([(i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, x))], "id int, y int, x double")
    more = spark.createDataFrame([(900, None, 1.0), (901, 1, float("nan")), (902, 1, None)], df.schema)
    got = R.permutation_by_counts(df.unionByName(more), "x", "y", "id", 1000, statistic=kind).first()
    ranks = pd.Series(x).rank().to_numpy()
    seen = statistic(ranks, y, kind)
    assert got.observed == pytest.approx(seen)
    assert got.observed == pytest.approx(I.permutation_test(df, "x", "y", "id", 2, statistic=kind).first().observed)
    p = np.mean([statistic(ranks, r.permutation(y), kind) >= seen - 1e-9 for _ in range(4000)])
    assert abs(got.p - p) < 4 * np.sqrt(p * (1 - p) * (1 / 1000 + 1 / 4000)) + 0.002
    assert R.permutation_by_counts(df, "x", "y", "id", 1000, statistic=kind).first() == got


def test_dealt_counts_keep_sizes_and_expectations():
    counts = np.tile(np.array([30, 50, 20]), (4000, 1))
    sizes = np.array([10, 60, 25, 5])
    draws = list(R.deal(np.random.default_rng(1), counts, sizes))
    assert (sum(draws) == counts).all()
    for size, d in zip(sizes, draws):
        assert (d.sum(1) == size).all()
        assert d.mean(0) == pytest.approx(size * np.array([0.3, 0.5, 0.2]), abs=0.25)
        wanted = size * 0.3 * 0.7 * (100 - size) / 99  # variance of a hypergeometric count
        assert d[:, 0].var() == pytest.approx(wanted, rel=0.15)


def test_no_rows_one_label_and_one_value(spark):
    none = spark.createDataFrame([], "id int, y int, x double")
    label = spark.createDataFrame([(i, 1, float(i)) for i in range(5)], none.schema)
    value = spark.createDataFrame([(i, i % 2, 3.0) for i in range(6)], none.schema)
    for df in (none, label, value):
        for kind in ("kruskal", "spearman"):
            r = R.permutation_by_counts(df, "x", "y", "id", 20, statistic=kind).first()
            assert (r.observed, r.p) == (0.0, 1.0)


def test_cross_validation_folds_and_scores(spark):
    df = spark.range(600).select("id", (F.col("id") % 3 + 1).cast("int").alias("label"))
    clear = df.withColumn("x", F.array(*[(F.col("label") == i).cast("double") for i in (1, 2, 3)]))
    folds = P.stratified_kfold(clear, "label", ["id"], 4).cache()
    bad = spark.createDataFrame([(700, 1, [None, 1.0, 0.0], 1), (701, None, [1.0, 0.0, 0.0], 1), (702, 1, [float("nan"), 0.0, 0.0], 2)], "id long, label int, x array<double>, fold int")
    got = J.cross_validate(folds.unionByName(bad), "x", classes=3).orderBy("fold").collect()
    assert [r.fold for r in got] == [1, 2, 3, 4] and all(r.accuracy == 1.0 and r.running_mean == 1.0 for r in got)
    assert [r.rows for r in got] == [r["count"] for r in folds.groupBy("fold").count().orderBy("fold").collect()]


def test_cross_validation_never_fits_on_the_scored_fold(spark):
    """In fold 2 the feature means the opposite: scored by the others it is all wrong."""
    df = spark.range(400).select("id", (F.col("id") % 2 + 1).cast("int").alias("label"), (F.floor(F.col("id") / 2) % 4 + 1).cast("int").alias("fold"))
    df = df.withColumn("x", F.array(F.when((F.col("fold") == 2) == (F.col("label") == 1), 1.0).otherwise(0.0)))
    got = J.cross_validate(df, "x", classes=2, regs=(0.01,), by="accuracy").orderBy("fold").collect()
    assert [r.accuracy for r in got] == [1.0, 0.0, 1.0, 1.0]
    assert [r.running_mean for r in got] == pytest.approx([1.0, 0.5, 2 / 3, 0.75])


def test_one_fold_is_refused(spark):
    with pytest.raises(ValueError, match="two folds"):
        J.cross_validate(spark.createDataFrame([(1, [1.0], 1)], "label int, x array<double>, fold int"), "x")
