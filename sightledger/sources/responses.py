"""Stored reviewer responses, current and legacy layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sightledger.schema import REVIEW

_S, _L, _D = T.StringType(), T.LongType(), T.DoubleType()
_PREDICTION = T.StructType([
    T.StructField("raw_text", _S), T.StructField("input_tokens", _L),
    T.StructField("generated_tokens", _L), T.StructField("inference_seconds", _D),
])
RESPONSE = T.StructType([
    T.StructField("stage", _S), T.StructField("prompt_version", _S),
    T.StructField("batch_id", _S), T.StructField("scope_id", _S), T.StructField("error", _S),
    T.StructField("cluster_ids", T.ArrayType(_S)),
    T.StructField("expected_proposal_ids", T.ArrayType(_S)),
    T.StructField("expected_source_ids", T.ArrayType(_S)),
    T.StructField("response", T.StructType([T.StructField("reviews", T.ArrayType(REVIEW))])),
    T.StructField("predictions", T.ArrayType(_PREDICTION)),
])


def write_responses(responses: DataFrame, path: str) -> None:
    """Responses (``run``, columns of RESPONSE) as lines, in a folder per run: files follow the tasks, not the responses."""
    responses.write.partitionBy("run").json(path)


def read_responses(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row per response file, with the run taken from its directory; with ``lines`` per line of `write_responses`."""
    df = (
        spark.read.schema(RESPONSE).option("multiLine", str(not lines).lower())
        .option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(path)
        .withColumn("file", F.input_file_name())
    )
    parts = F.split("file", "/")
    scope = ["batch_id", "scope_id"] + ([] if lines else [F.element_at(parts, -2)])
    return df.withColumn("run_id", F.element_at(parts, -2 if lines else -3)).withColumn("scope", F.coalesce(*scope))


def response_predictions(responses: DataFrame) -> DataFrame:
    p = responses.select("run_id", "scope", "stage", F.posexplode_outer("predictions").alias("position", "p"))
    return p.select("run_id", "scope", "stage", "position", "p.*")


def response_reviews(responses: DataFrame) -> DataFrame:
    r = responses.select("run_id", "scope", F.explode("response.reviews").alias("r"))
    return r.select("run_id", "scope", "r.*")
