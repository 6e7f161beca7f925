"""Mixing sources to target weights by capped water-filling.

Targets: every source's share of the budget is proportional to its weight, held at
``max_epochs`` times its size; what a held source can't take is shared out again by
weight until no source is above its cap. Documents: all take the whole repetitions of
their source's rate; in a seeded order, further documents are repeated once more until
the target is met, the last of them by a fraction, its first words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.llm.common import WORD, numbered, written


def word_count(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, budget: float | None = None, max_epochs: float = 3.0) -> DataFrame:
    """``sources(source, size, weight)`` -> with ``target double``.

    The budget (all sizes, if not given) is spread by weight under ``max_epochs * size``.
    Each round is one aggregate of the source table: the level rises until no further
    source meets its cap. A null or non-positive weight, or an empty source, gets 0. If the caps
    can't hold the budget, every source with a weight stands at its cap.
    """
    cap = F.col("size") * F.lit(float(max_epochs))
    weight = F.when(F.col("weight") > 0, F.col("weight")).otherwise(0.0).cast("double")
    s = sources.withColumns({"__cap": F.when(weight > 0, cap).otherwise(0.0), "__w": weight})
    if budget is None:
        budget = float(s.agg(F.sum("size")).first()[0] or 0)
    level, held = 0.0, -1
    while True:
        full = F.col("__cap") <= F.col("__w") * F.lit(level)
        n, taken, left = s.agg(F.count_if(full), F.sum(F.when(full, F.col("__cap")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("__w")))).first()
        if not left or n == held:
            break
        held, level = n, max(level, (budget - taken) / left)
    return s.withColumn("target", F.least("__cap", F.col("__w") * F.lit(level))).drop("__cap", "__w")


def plan_mix(docs: DataFrame, weights: DataFrame | None = None, budget: float | None = None, max_epochs: float = 3.0, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Decide how often each document is taken.

    ``docs(doc_id, source, text)``; ``weights(source, weight)``, or None for the cycle
    5, 2, 1 over the sources by code point, null last. Returns
    ``(rows(doc_id, source, size, __h), rates(source, source_size, target, whole, edge, part))``:
    a row is taken ``whole`` times, once more where its place in the order of hashes is
    before ``edge``, and by the fraction ``part`` where it is on it.

    Null text has size 0 and is never taken; null sources are one source, last in order;
    repeated rows share one hash and are taken alike. No rows give no rows.
    """
    spread = F.xxhash64(F.lit(seed), F.col("doc_id"))
    rows = written(docs.select("doc_id", "source", word_count("text").alias("size"), spread.alias("__h")), "mix-sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("size"))
    if weights is None:
        ranked = numbered(sizes, [F.col("source").isNull(), F.col("source")], "__n")
        sizes = ranked.withColumn("weight", F.element_at(F.array(F.lit(5.0), F.lit(2.0), F.lit(1.0)), (F.col("__n") % 3 + 1).cast("int"))).drop("__n")
    else:
        w = weights.groupBy(F.col("source").alias("__s")).agg(F.sum("weight").alias("weight"))
        sizes = sizes.join(w, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")
    targets = water_fill(written(sizes, "mix-sources"), budget, max_epochs)
    rate = F.when(F.col("size") > 0, F.col("target") / F.col("size")).otherwise(0.0)
    targets = targets.select("source", F.col("size").alias("source_size"), "target", F.floor(rate).alias("whole"), (F.col("target") - F.floor(rate) * F.col("size")).alias("need"))
    targets = written(targets, "mix-targets")

    # Where in the order of hashes the extra copies of a source end: first the bucket, then the document.
    bucket = F.shiftrightunsigned(F.col("__h"), 52)
    order = F.shiftrightunsigned(F.col("__h"), 1)
    same = F.col("source").eqNullSafe(F.col("__s"))
    by_bucket = rows.where("size > 0").groupBy("source", bucket.alias("__b")).agg(F.sum("size").alias("n"))
    run = W.partitionBy("source").orderBy("__b").rowsBetween(W.unboundedPreceding, W.currentRow)
    reach = by_bucket.withColumn("upto", F.sum("n").over(run)).join(targets.select(F.col("source").alias("__s"), "need"), same).drop("__s")
    last = written(reach.where("upto - n < need and upto >= need").select(F.col("source").alias("__s"), "__b", F.col("need"), (F.col("upto") - F.col("n")).alias("base")), "mix-buckets")
    near = rows.where("size > 0").withColumn("__rb", bucket).join(last, same & (F.col("__rb") == F.col("__b")))
    near = near.groupBy("source", "need", "base", order.alias("__o")).agg(F.sum("size").alias("n"))
    run = W.partitionBy("source").orderBy("__o").rowsBetween(W.unboundedPreceding, W.currentRow)
    upto = F.col("base") + F.sum("n").over(run)
    edge = near.withColumn("upto", upto).where("upto - n < need and upto >= need")
    edge = edge.select(F.col("source").alias("__s"), F.col("__o").alias("edge"), ((F.col("need") - F.col("upto") + F.col("n")) / F.col("n")).alias("part"))
    rates = targets.join(edge, same, "left").select("source", "source_size", "target", "whole", F.coalesce("edge", F.lit(-1)).alias("edge"), F.coalesce("part", F.lit(0.0)).alias("part"))
    return rows, written(rates, "mix-rates")


def _taken(docs: DataFrame, rates: DataFrame) -> DataFrame:
    """``docs`` with __size and __h -> with __whole (copies) and __part (words of one more)."""
    joined = docs.join(rates.withColumnsRenamed({c: f"__r_{c}" for c in rates.columns}), F.col("source").eqNullSafe(F.col("__r_source")), "left")
    order = F.shiftrightunsigned(F.col("__h"), 1)
    more = order < F.col("__r_edge")
    some = F.col("__size") > 0
    return joined.withColumns(
        {
            "__whole": F.when(some, F.col("__r_whole") + more.cast("int")).otherwise(0).cast("int"),
            "__part": F.when(some & (order == F.col("__r_edge")), F.floor(F.col("__size") * F.col("__r_part"))).otherwise(0).cast("long"),
        }
    )


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, taken``."""
    rows, rates = plan_mix(docs, **options)
    out = _taken(rows.withColumnRenamed("size", "__size"), rates)
    taken = F.col("__size") * F.col("__whole") + F.col("__part")
    return out.select("doc_id", "source", F.col("__size").alias("size"), F.col("__r_source_size").alias("source_size"), F.col("__r_target").alias("target"), taken.alias("taken"))


def mix_documents(docs: DataFrame, seed: int = 42, **options) -> DataFrame:
    """The mixed corpus: every column of ``docs``, each row as often as it is taken; the
    row on a source's edge adds a copy that ends after its share of words."""
    _, rates = plan_mix(docs, seed=seed, **options)
    marked = docs.withColumns({"__size": word_count("text"), "__h": F.xxhash64(F.lit(seed), F.col("doc_id"))})
    taken = _taken(marked, rates).where("__whole > 0 or __part > 0")
    copies = F.concat(F.array_repeat(F.lit(0).cast("long"), F.col("__whole")), F.when(F.col("__part") > 0, F.array(F.col("__part"))).otherwise(F.array().cast("array<bigint>")))
    first = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), F.col("__words").cast("int")), "")
    out = taken.withColumn("__words", F.explode(copies))
    return out.withColumn("text", F.when(F.col("__words") > 0, first).otherwise(F.col("text"))).select(docs.columns)
