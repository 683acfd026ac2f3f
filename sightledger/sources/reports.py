"""Run reports as JSON sections, partitioned by run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sightledger.session import union_all

REPORT_SCHEMA_VERSION = 8
SECTIONS = ("run", "image", "cluster")


def report_sections(runs: DataFrame, images: DataFrame, clusters: DataFrame) -> DataFrame:
    """(run_id, section, body JSON): one header row, one row per image and cluster.

    A report of a huge run is then many rows, never one giant document in one task.
    """
    def section(name, df):
        body = F.to_json(F.struct(*[c for c in df.columns if c != "run_id"]))
        return df.select("run_id", F.lit(name).alias("section"), body.alias("body"))

    head = runs.withColumn("schema_version", F.lit(REPORT_SCHEMA_VERSION))
    return union_all([section("run", head), section("image", images), section("cluster", clusters)])


def write_report(sections: DataFrame, path: str) -> None:
    sections.write.mode("append").partitionBy("run_id").json(path)


def replace_report(sections: DataFrame, path: str, run_id: str) -> None:
    """The report of one run, in its own directory: written again it replaces itself."""
    sections.drop("run_id").write.mode("overwrite").json(f"{path}/run_id={run_id}")


def read_report(spark: SparkSession, path: str, section: str, schema: T.StructType, run_id: str | None = None) -> DataFrame:
    """Typed rows of one section; a run id prunes to its directory."""
    stored = T.StructType([
        T.StructField("section", T.StringType()), T.StructField("body", T.StringType()),
        T.StructField("run_id", T.StringType()),
    ])
    df = spark.read.schema(stored).json(path).filter(F.col("section") == section)
    if run_id is not None:
        df = df.filter(F.col("run_id") == run_id)
    return df.select("run_id", F.from_json("body", schema).alias("b")).select("run_id", "b.*")
