"""Rounded doubles are those of the SQL."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tessella.operators import meetings as M
from tessella.operators import similarity as S


def test_rounding_is_that_of_sql(spark):
    values = [(3 / 320 + 1) / 2, 0.0078125, 3 / 640, -0.0000005, 0.1234565, 2.5e-7, None]
    got = [r.v for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(S.half_away(F.col("v"), 6).alias("v")).collect()]
    want = [duckdb.execute("select round(?::double, 6)", [v]).fetchone()[0] for v in values]
    assert got == want and got[0] == 0.504687
    assert [None if v is None else M.to_units(np.array([v]), 6)[0] / 1e6 for v in values] == want


def test_a_missing_value_is_not_clipped_to_one(spark):
    df = spark.createDataFrame([(0, None), (1, 1.0 + 1e-9), (2, -1e-9), (3, 0.5)], "i int, v double")
    assert [r.v for r in df.orderBy("i").select(S.clip_unit(F.col("v")).alias("v")).collect()] == [None, 1.0, 0.0, 0.5]
