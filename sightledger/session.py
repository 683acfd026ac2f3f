"""Session set-up, lineage cutting and skew-safe ranking helpers."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package (code only) to the Python workers once per application."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        here = os.path.dirname(os.path.abspath(__file__))
        base = os.path.join(tempfile.mkdtemp(prefix="spark-"), "sightledger")
        spark.sparkContext.addPyFile(shutil.make_archive(
            base, "zip", root_dir=os.path.dirname(here), base_dir="sightledger"))
        _SHIPPED.add(app)
    return spark


def build_session(app: str = "sightledger", master: str | None = None, **conf) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return ship(builder.getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage, named by the session.

    A machine-local folder is only ever used on a local master, where driver and
    executors are one process; on a cluster the setting is required.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    path = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def materialize(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write to the shared folder and read back: the lineage ends here.

    Survives executor loss, and the file sizes give later joins true statistics.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/t_{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parallelism(spark: SparkSession) -> int:
    return max(
        int(spark.conf.get("spark.sql.shuffle.partitions")),
        spark.sparkContext.defaultParallelism,
    )


def max_group_rows(df: DataFrame, *keys: str) -> int:
    """Size of the largest group: one partial aggregate, one row back."""
    row = df.groupBy(*keys).count().agg(F.max("count").alias("n")).first()
    return int(row["n"] or 0)


def distributed_row_number(
    df: DataFrame, keys: list[str], order: list, name: str, bound: int = 1_000_000
) -> DataFrame:
    """``row_number() over (partition by keys order by order)`` for any group size.

    Groups up to ``bound`` rows use the plain window. If a larger one exists, or if
    there is no key at all, rows are range-partitioned by (keys, order), numbered
    inside each partition, and shifted by the counts of the earlier partitions, so no
    task ever holds a group.
    """
    if keys and max_group_rows(df, *keys) <= bound:
        return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("long"))
    sort = [F.col(k).asc() for k in keys] + list(order)
    placed = materialize(
        df.repartitionByRange(parallelism(df.sparkSession), *sort)
        .sortWithinPartitions(*sort)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id())
    )
    sizes = placed.groupBy(*keys, "_part").agg(
        F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    # At most one row per (key, partition): a key spans n partitions at the most.
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.withColumn(
        "_base", F.coalesce(F.sum("_n").over(before), F.lit(0))
    ).select(*keys, "_part", "_first", "_base")
    joined = placed.join(offsets, keys + ["_part"])
    number = F.col("_pos") - F.col("_first") + F.col("_base") + 1
    return joined.withColumn(name, number).drop("_part", "_pos", "_first", "_base")


def spread(df: DataFrame) -> DataFrame:
    """Rebalance a scan with fewer splits than cores, before rows are widened."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def fresh(df: DataFrame) -> DataFrame:
    """Same rows under new column identities, for pairing a frame with itself."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
