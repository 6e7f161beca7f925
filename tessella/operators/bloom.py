"""A bitmap of keys of bounded size, to thin a huge table before it is shuffled."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits for each key, and at most (16 MB); hash functions; keys below which a join broadcasts them anyway.
BITS, MOST_BITS, HASHES, FEW = 16, 1 << 27, 2, 20_000


def might_hold(keys: DataFrame, key: str) -> Callable[[Column], Column] | None:
    """A condition that holds for every key of the table, and for few others: two bits a key in
    a bitmap of ``BITS`` bits for each, ``MOST_BITS`` at most, which goes to every task. Beyond
    that size more other keys pass; none of the table's is ever lost. None for few keys."""
    n = keys.count()
    if n < FEW:
        return None
    bits = min(MOST_BITS, 1 << (BITS * n - 1).bit_length())
    at = lambda c, i: F.pmod(F.xxhash64(c, F.lit(i)), F.lit(bits))
    places = keys.select(F.explode(F.array(*[at(F.col(key), i) for i in range(HASHES)])).alias("at"))
    words = places.groupBy(F.floor(F.col("at") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits")).toArrow()
    bitmap = np.zeros(max(1, bits // 64), np.uint64)
    bitmap[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    shared = keys.sparkSession.sparkContext.broadcast(bitmap)

    @F.pandas_udf("boolean")
    def held(first: pd.Series, second: pd.Series) -> pd.Series:
        yes = np.ones(len(first), bool)
        for places in (first, second):
            p = places.to_numpy(np.int64)
            yes &= ((shared.value[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
        return pd.Series(yes)

    return lambda c: held(at(c, 0), at(c, 1))
