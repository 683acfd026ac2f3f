"""Vectorised text kernels and table helpers shared by the training-data operators.

Texts stay in Arrow buffers: a block of rows is one byte array plus row offsets, words are found
and hashed with array operations, and no Python object is made per word.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from sightledger.session import parallelism, shared_dir, ship

BLOCK_BYTES = 1 << 20

# White space of a word boundary: 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True


BATCH_ROWS = 512
_BATCHES = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ready(spark: SparkSession) -> SparkSession:
    """Code on the workers, and Arrow batches that hold long texts without filling a worker.

    The batch size changes no result; a session that has set its own keeps it.
    """
    if spark.conf.get(_BATCHES) == "10000":
        spark.conf.set(_BATCHES, BATCH_ROWS)
    return ship(spark)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/documents.parquet")


def table(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back; the lineage ends here and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/llm_{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions_for(spark: SparkSession) -> int:
    return parallelism(spark)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows and the offset of each row (one more than rows); null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def give_back() -> None:
    """Return freed memory to the system: an idle worker must not sit on what its last task needed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES):
    """Slices of rows holding about ``limit`` bytes of text (one row at least), with bytes and offsets."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = utf8(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at), data[offsets[at]:offsets[end]], offsets[at:end + 1] - offsets[at]
            at = end
    give_back()


def spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the first word of every row (one more than rows)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~space[data]
    before = np.ones(n, bool)
    before[1:] = ~solid[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = True
    after = np.ones(n, bool)
    after[:-1] = ~solid[1:]
    after[offsets[1:] - 1] = True
    starts = np.flatnonzero(solid & before)
    ends = np.flatnonzero(solid & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def byte_values(seed: int, lower: bool = False) -> np.ndarray:
    """A random 64-bit value per byte; ``lower`` gives A-Z the values of a-z."""
    values = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    if lower:
        values[65:91] = values[97:123]
    return values


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def powers(base: int, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), np.uint64)
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


def piece_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray, base: int) -> np.ndarray:
    """64-bit hash of each disjoint ascending byte range."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    place = np.arange(int(sizes.sum()), dtype=np.int64)
    first = np.cumsum(sizes) - sizes
    shift = np.repeat(starts - first, sizes)
    inner = place - np.repeat(first, sizes)
    terms = values[data[place + shift]] * powers(base, int(sizes.max()))[inner]
    return mix(np.add.reduceat(terms, first) + sizes.astype(np.uint64))


WORD_BASE = 0x9E3779B97F4A7C13
GRAM_BASE = 0xD1342543DE82EF95


def grams(h: np.ndarray, k: int, base: int = GRAM_BASE) -> np.ndarray:
    """Hash of every run of k consecutive values, by doubling; len(h) - k + 1 values."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total, width, level, size = None, 0, h, 1
    bit = k
    parts = []
    while bit:
        if bit & 1:
            parts.append((size, level))
        bit >>= 1
        if bit:
            level = level[:len(level) - size] * np.uint64(pow(base, size, 1 << 64)) + level[size:]
            size *= 2
    for size, level in reversed(parts):
        piece = level[width:width + n]
        total = piece.copy() if total is None else total * np.uint64(pow(base, size, 1 << 64)) + piece
        width += size
    return mix(total)


def rows_of_grams(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the k-runs that stay inside one row, and how many each row has."""
    counts = np.maximum(np.diff(first) - k + 1, 0)
    base = np.cumsum(counts) - counts
    return np.arange(int(counts.sum())) + np.repeat(first[:-1] - base, counts), counts


def binary(chunks: list[bytes]) -> pa.Array:
    return pa.array(chunks, pa.binary())


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
