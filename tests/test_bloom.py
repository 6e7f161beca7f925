"""Bitmaps of keys lose none of them, and the lookup on a huge table stays exact."""

from pyspark.sql import functions as F

from tessella.operators import bloom, resolve


def test_bitmap_holds_every_key(spark, monkeypatch):
    keys = spark.range(0, 3000, 3).withColumnRenamed("id", "k")
    assert bloom.might_hold(keys, "k") is None
    monkeypatch.setattr(bloom, "FEW", 10)
    for most in (1 << 27, 1 << 10):
        monkeypatch.setattr(bloom, "MOST_BITS", most)
        might = bloom.might_hold(keys, "k")
        passed = {r.id for r in spark.range(3000).where(might(F.col("id"))).collect()}
        assert set(range(0, 3000, 3)) <= passed and (most < 1 << 20 or len(passed) < 1200)


def test_lookup_of_many_targets(spark, monkeypatch):
    monkeypatch.setattr(bloom, "FEW", 2)
    big = spark.createDataFrame([(i % 50, f" k{i % 3} ") for i in range(500)] + [(1, ""), (None, "x")], "cid int, key string")
    targets = spark.createDataFrame([(1,), (2,), (99,), (1,)], "id long")
    got = {r.id: (r.rows, r["keys"]) for r in resolve.lookup_keys(big, targets, "cid", "key").collect()}
    assert got == {1: (11, ["K0", "K1", "K2"]), 2: (10, ["K0", "K1", "K2"]), 99: (0, [])}
