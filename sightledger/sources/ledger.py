"""The six ledger tables as append-only Parquet with commit markers."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sightledger.schema import LEDGER, SCHEMA_VERSION

_META = T.StructType([T.StructField("version", T.IntegerType())])
_COMMIT = T.StructType([T.StructField("commit_id", T.StringType()), T.StructField("write_attempt", T.StringType())])


class LedgerError(RuntimeError):
    pass


def init_ledger(spark: SparkSession, root: str) -> None:
    spark.createDataFrame([(SCHEMA_VERSION,)], _META).coalesce(1).write.mode("error").parquet(f"{root}/_meta")
    for name, schema in LEDGER.items():
        stored = T.StructType([*schema, T.StructField("commit_id", T.StringType()), T.StructField("write_attempt", T.StringType())])
        spark.createDataFrame([], stored).write.mode("error").partitionBy("write_attempt").parquet(f"{root}/{name}")
    spark.createDataFrame([], _COMMIT).write.mode("error").parquet(f"{root}/_commits")


def _check(spark: SparkSession, root: str) -> None:
    try:
        version = spark.read.schema(_META).parquet(f"{root}/_meta").first()
    except Exception as exc:
        raise LedgerError(f"no ledger at {root}") from exc
    if version is None or version["version"] != SCHEMA_VERSION:
        raise LedgerError(f"unsupported ledger version {version and version['version']}")


def _published(spark: SparkSession, root: str) -> DataFrame:
    """(commit_id, attempt) of every published commit; a second marker of one commit changes nothing."""
    commits = spark.read.schema(_COMMIT).parquet(f"{root}/_commits")
    return commits.groupBy("commit_id").agg(F.min("write_attempt").alias("write_attempt"))


def write_commit(spark: SparkSession, root: str, commit_id: str, tables: dict[str, DataFrame]) -> None:
    """Write rows of all tables, then publish them together with one marker.

    Every attempt writes below its own partition and the marker names the attempt, so rows
    of a job that died half way stay invisible, also when the commit is tried again.
    A commit that is already published is left alone.
    """
    unknown = sorted(set(tables) - set(LEDGER))
    if unknown:
        raise LedgerError(f"unknown tables {unknown}")
    if not _published(spark, root).filter(F.col("commit_id") == commit_id).isEmpty():
        return
    attempt = uuid.uuid4().hex

    def store(item) -> None:
        name, df = item
        rows = df.select(*[F.col(f.name).cast(f.dataType) if f.name in df.columns
                           else F.lit(None).cast(f.dataType).alias(f.name) for f in LEDGER[name]])
        rows = rows.withColumn("commit_id", F.lit(commit_id)).withColumn("write_attempt", F.lit(attempt))
        rows.write.mode("append").partitionBy("write_attempt").parquet(f"{root}/{name}")

    # The tables are independent, so their jobs run side by side; the marker comes after all of them.
    with ThreadPoolExecutor(max(1, len(tables))) as pool:
        list(pool.map(store, tables.items()))
    spark.createDataFrame([(commit_id, attempt)], _COMMIT).coalesce(1).write.mode("append").parquet(f"{root}/_commits")


def published(spark: SparkSession, root: str, prefix: str) -> list[str]:
    """Ids of the published commits that begin with ``prefix``, in order."""
    rows = _published(spark, root).filter(F.col("commit_id").startswith(prefix)).select("commit_id").collect()
    return sorted(r.commit_id for r in rows)


def has_ledger(spark: SparkSession, root: str) -> bool:
    try:
        _check(spark, root)
    except LedgerError:
        return False
    return True


def read_ledger(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Published rows of all six tables; a missing table or other version is an error.

    Attempts are partitions, so the join with the markers prunes what was never published.
    """
    _check(spark, root)
    commits = _published(spark, root)
    out = {}
    for name, schema in LEDGER.items():
        stored = T.StructType([*schema, T.StructField("commit_id", T.StringType()), T.StructField("write_attempt", T.StringType())])
        try:
            df = spark.read.schema(stored).parquet(f"{root}/{name}")
        except Exception as exc:
            raise LedgerError(f"ledger table missing: {name}") from exc
        out[name] = df.join(commits, ["commit_id", "write_attempt"], "left_semi").drop("commit_id", "write_attempt")
    return out
