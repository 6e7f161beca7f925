"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but
the last return the columns of ``documents``. Toxic documents go; of each group of near
duplicates (five words, similarity 0.8) the smallest doc_id stays; secrets are masked;
sources are mixed to target weights, which repeats and drops rows; texts are encoded
with the scores and edits of the N best paths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import mixing, neardup, pieces, secrets, toxicity
from tessella.llm.common import table, written


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.drop_near_duplicates(docs)


def secrets_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_secrets(docs)


def sources_mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs, pieces.default_model(), columns=["doc_id", "lang", "source"]).select("doc_id", "lang", "source", "ids", "scores", "edits")


STAGES = [
    ("toxicity", toxic_out),
    ("near_duplicates", near_duplicates_out),
    ("secrets", secrets_masked),
    ("mixing", sources_mixed),
    ("sentencepiece", encoded),
]

#: SQL can't express the network, the join's trees or the piece lattice.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
