"""Scans and sinks (A)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_ordered(spark: SparkSession, path: str, schema: str, order: str) -> DataFrame:
    """A1: headerless all-string table; ``order`` is the column that carries the row order."""
    return spark.read.schema(schema).csv(path, header=False).withColumn(order, F.col(order).cast("long"))


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A2: header CSV, everything a string, a byte order mark before the header dropped."""
    df = spark.read.option("header", True).csv(path)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns]).select(*columns)


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """A3: nodes with nested properties."""
    return spark.read.parquet(path)


def read_ids(spark: SparkSession, path: str, id_col: str = "id") -> DataFrame:
    """A4: one column, nulls dropped; the scan reads only it."""
    return spark.read.parquet(path).select(id_col).dropna()


def scan_tsv(spark: SparkSession, path: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """A5: (rows of the right number of columns, one row of counts good and bad)."""
    parts = spark.read.text(path).select(F.split("value", "\t", -1).alias("p"))
    fits = F.size("p") == len(columns)
    good = parts.where(fits).select(*[F.col("p")[i].alias(c) for i, c in enumerate(columns)])
    return good, parts.agg(F.count_if(fits).alias("good"), F.count_if(~fits).alias("bad"))


def read_positional_tsv(spark: SparkSession, path: str, columns: list[str], type_col: str, keep: str) -> DataFrame:
    """Headerless TSV that fails on malformed rows, kept where a type column fits."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).option("sep", "\t").option("mode", "FAILFAST").csv(path).where(F.col(type_col) == keep)


def detect_columns(sample: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """Per column and role the share of a sample's values that fit the role's pattern."""
    shares = [F.struct(F.lit(c).alias("column"), F.lit(r).alias("role"), F.avg(F.coalesce(F.col(c).cast("string").rlike(p), F.lit(False)).cast("int")).alias("share")) for c in sample.columns for r, p in patterns.items()]
    return sample.agg(F.array(*shares).alias("s")).select(F.inline("s"))


def read_matrix(df: DataFrame, key: str, values: str) -> DataFrame:
    """Rows of arrays as a long table (row_id, col_id, value)."""
    return df.select(F.col(key).alias("row_id"), F.posexplode(values).alias("col_id", "value"))


def write_split(df: DataFrame, path: str) -> None:
    """A named split, one folder each."""
    df.write.partitionBy("split").parquet(path)


def read_split(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def null_if_not_finite(c: Column) -> Column:
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def finite_only(df: DataFrame) -> DataFrame:
    """NaN and infinities as null, which sinks write as empty or null."""
    return df.withColumns({f.name: null_if_not_finite(F.col(f.name)) for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))})


def write_table(df: DataFrame, path: str, columns: list[str], mode: str = "overwrite") -> None:
    """A10: CSV with a column order; Spark's commit protocol makes it all or nothing."""
    finite_only(df).select(*columns).write.mode(mode).option("header", True).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines, values that aren't finite as null."""
    finite_only(df).write.mode(mode).option("ignoreNullFields", False).json(path)


def embedding_export(anchors: DataFrame, vectors: DataFrame, dimension: int) -> DataFrame:
    """Every anchor in order with its vector or zeros and an availability mask."""
    j = anchors.select("matrix_index").join(vectors.select("matrix_index", "vec"), "matrix_index", "left")
    zeros = F.array_repeat(F.lit(0.0).cast("float"), dimension)
    return j.select("matrix_index", F.coalesce(F.col("vec").cast("array<float>"), zeros).alias("embedding"), F.col("vec").isNotNull().alias("available"))


def write_new(df: DataFrame, path: str) -> None:
    """Write once; existing results are an error."""
    df.write.mode("errorifexists").parquet(path)
