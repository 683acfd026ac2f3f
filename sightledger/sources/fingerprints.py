"""Fingerprint store: float16 quantised vectors with a content hash."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from sightledger.functions.vectors import l2_normalize

_VECTOR = T.ArrayType(T.FloatType())
_MATRIX = T.ArrayType(_VECTOR)
FINGERPRINT = T.StructType([
    T.StructField("proposal_id", T.StringType()), T.StructField("source_id", T.StringType()),
    T.StructField("vector", _VECTOR), T.StructField("local", _MATRIX),
    T.StructField("patch_rc", T.ArrayType(T.StructType([
        T.StructField("r", T.IntegerType()), T.StructField("c", T.IntegerType())]))),
    T.StructField("sha256", T.StringType()), T.StructField("model_id", T.StringType()),
    T.StructField("revision", T.StringType()), T.StructField("feature_layer", T.StringType()),
    T.StructField("input_size", T.IntegerType()), T.StructField("storage_dtype", T.StringType()),
    T.StructField("global_dimension", T.IntegerType()), T.StructField("local_count", T.IntegerType()),
    T.StructField("l2_normalized", T.BooleanType()),
])


@F.pandas_udf(_VECTOR)
def to_float16(v: pd.Series) -> pd.Series:
    """Round every component to the nearest half-precision value."""
    return v.map(lambda x: None if x is None else np.asarray(x, dtype=np.float16).astype(np.float32))


@F.pandas_udf(_MATRIX)
def to_float16_rows(m: pd.Series) -> pd.Series:
    half = lambda r: np.asarray(r, dtype=np.float16).astype(np.float32)
    return m.map(lambda rows: None if rows is None else [half(r) for r in rows])


def payload_hash() -> Column:
    return F.sha2(F.to_json(F.struct("vector", "local", "patch_rc")), 256)


def quantise(fingerprints: DataFrame, model_id: str, revision: str, feature_layer: str, input_size: int) -> DataFrame:
    df = (
        fingerprints.withColumn("vector", to_float16("vector"))
        .withColumn("local", to_float16_rows("local"))
    )
    return df.select(
        "proposal_id", "source_id", "vector", "local", "patch_rc", payload_hash().alias("sha256"),
        F.lit(model_id).alias("model_id"), F.lit(revision).alias("revision"),
        F.lit(feature_layer).alias("feature_layer"), F.lit(input_size).alias("input_size"),
        F.lit("float16").alias("storage_dtype"), F.size("vector").alias("global_dimension"),
        F.size("local").alias("local_count"), F.lit(True).alias("l2_normalized"),
    )


def write_fingerprints(quantised: DataFrame, path: str) -> None:
    quantised.write.mode("append").parquet(path)


def read_fingerprints(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(valid rows with re-normalised vectors, rejected rows with a reason)."""
    df = spark.read.schema(FINGERPRINT).parquet(path)
    reason = (
        F.when(F.col("vector").isNull() | F.col("local").isNull() | F.col("patch_rc").isNull(), "missing_arrays")
        .when(payload_hash() != F.col("sha256"), "hash_mismatch")
    )
    checked = df.withColumn("reject_reason", reason)
    good = checked.filter(F.col("reject_reason").isNull()).drop("reject_reason")
    good = good.withColumn("vector", l2_normalize("vector")).withColumn(
        "local", F.transform("local", l2_normalize))
    return good, checked.filter(F.col("reject_reason").isNotNull())
