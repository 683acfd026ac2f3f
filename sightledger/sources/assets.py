"""Image file scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sightledger.functions.validators import path_suffix
from sightledger.schema import IMAGE_SUFFIXES


def image_rows(files: DataFrame) -> DataFrame:
    """Rows whose lower-cased path suffix is an image suffix."""
    return files.filter(path_suffix(F.col("path")).isin(*IMAGE_SUFFIXES))


def scan_assets(spark: SparkSession, directory: str, content: bool = True) -> DataFrame:
    """Image files below a directory: path (relative), name, size, modified, content.

    Without ``content`` only file metadata is read. An empty result is an error, raised
    after looking at the first file only.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(directory)
    root = directory.rstrip("/") + "/"
    relative = F.regexp_replace(F.substring_index("path", root, -1), r"^file:/+", "")
    df = image_rows(files.select(
        relative.alias("path"), F.substring_index("path", "/", -1).alias("name"),
        F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"),
        *(["content"] if content else []),
    ))
    if df.select("path").isEmpty():
        raise ValueError(f"no supported images under {directory}")
    return df
