"""Token ids as wavelet matrices, one per shard.

Shard file (one Parquet row, ``payload``): ``WMX1``, then little-endian: ids u64, documents u32, planes u32,
where each document starts (u64, one more than documents), zeros of each plane (u64), and per plane its bits
(most significant first, padded to 64) followed by the ones before every 512th bit (u32). Each plane holds one
bit of the ids, highest first, in the order that all higher planes have sorted them into; rank and select on
the planes give any id, the count of an id in a range, and the places where it occurs.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from sightledger.llm import base as B, tokens as T
from sightledger.session import shared_dir

MAGIC = b"WMX1"
SHARD_IDS = 1 << 22     # ids of a shard, about; a longer document has a shard of its own
MAX_RANGES = 4096       # ranges of doc_id that are sorted apart
RANGE_BYTES = 16 << 20  # text of a range, about
STEP = 512
PLANES = 16


def build(ids: np.ndarray, starts: np.ndarray, planes: int = PLANES) -> bytes:
    """The payload of a shard; ``starts`` has one entry more than documents."""
    parts = [MAGIC, struct.pack("<QII", len(ids), len(starts) - 1, planes), starts.astype("<u8").tobytes()]
    zeros, body, order = [], [], ids.astype(np.uint16)
    padded = -(-len(ids) // 64) * 64
    for plane in range(planes - 1, -1, -1):
        bits = (order >> np.uint16(plane)).astype(np.uint8) & np.uint8(1)
        ones = bits.view(bool)
        packed = np.packbits(bits)
        body += [packed.tobytes().ljust(padded // 8, b"\0"), _ranks(packed, len(ids)).tobytes()]
        low = order[~ones]
        zeros.append(len(low))
        order = np.concatenate([low, order[ones]])
    return b"".join(parts + [np.array(zeros, "<u8").tobytes()] + body)


def _ranks(packed: np.ndarray, n: int) -> np.ndarray:
    count = np.bitwise_count(packed).astype(np.uint32)
    steps = -(-n // STEP)
    count = np.append(count, np.zeros(steps * (STEP // 8) - len(count), np.uint32)).reshape(steps, STEP // 8).sum(1)
    return np.append(0, np.cumsum(count))[:steps].astype("<u4")


class Wavelet:
    """A shard in memory: access, count and occurrences from the planes, without decoding the rest."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a token shard")
        self.n, self.documents, self.planes = struct.unpack_from("<QII", payload, 4)
        at = 20
        self.starts = np.frombuffer(payload, "<u8", self.documents + 1, at)
        at += 8 * (self.documents + 1)
        self.zeros = np.frombuffer(payload, "<u8", self.planes, at).astype(np.int64)
        at += 8 * self.planes
        size, steps = -(-self.n // 64) * 8, -(-self.n // STEP)
        self.bits, self.before = [], []
        for _ in range(self.planes):
            self.bits.append(np.frombuffer(payload, np.uint8, size, at))
            self.before.append(np.frombuffer(payload, "<u4", steps, at + size))
            at += size + 4 * steps

    def ones(self, plane: int, i: int) -> int:
        """Ones of a plane before place i."""
        if i >= self.n:
            return self.n - int(self.zeros[plane])
        step = i // STEP
        body = self.bits[plane][step * (STEP // 8):i // 8 + 1].copy()
        body[-1] &= (0xFF00 >> (i % 8)) & 0xFF
        return int(self.before[plane][step]) + int(np.bitwise_count(body).sum())

    def select(self, plane: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) such bit of a plane."""
        low, high = 0, self.n
        while low < high:
            mid = (low + high) // 2
            ones = self.ones(plane, mid + 1)
            if (ones if bit else mid + 1 - ones) > k:
                high = mid
            else:
                low = mid + 1
        return low

    def access(self, i: int) -> int:
        value = 0
        for p in range(self.planes):
            bit = int(self.bits[p][i // 8]) >> (7 - i % 8) & 1
            ones = self.ones(p, i)
            i = int(self.zeros[p]) + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, token: int, low: int, high: int) -> tuple[int, int]:
        for p in range(self.planes):
            a, b = self.ones(p, low), self.ones(p, high)
            if token >> (self.planes - 1 - p) & 1:
                low, high = int(self.zeros[p]) + a, int(self.zeros[p]) + b
            else:
                low, high = low - a, high - b
        return low, high

    def count(self, token: int, low: int = 0, high: int | None = None) -> int:
        a, b = self._range(token, low, self.n if high is None else high)
        return b - a

    def occurrence(self, token: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of an id."""
        a, b = self._range(token, 0, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i = a + k
        for p in range(self.planes - 1, -1, -1):
            bit = token >> (self.planes - 1 - p) & 1
            i = self.select(p, bit, i - int(self.zeros[p]) if bit else i)
        return i

    def decode(self) -> np.ndarray:
        """All ids: the planes undone from the last to the first."""
        order = np.zeros(self.n, np.uint16)
        for p in range(self.planes - 1, -1, -1):
            ones = np.unpackbits(self.bits[p], count=self.n).view(bool)
            back = np.empty(self.n, np.uint16)
            back[~ones] = order[:self.zeros[p]]
            back[ones] = order[self.zeros[p]:] | np.uint16(1 << (self.planes - 1 - p))
            order = back
        return order


_CODED = pa.schema([("range", pa.int32()), ("doc_id", pa.int64()), ("ids", pa.binary())])


def _code(path, bounds):
    def run(batches):
        encoder = T.encoder(path)
        for part, data, offsets in B.blocks(batches):
            flat, rows = encoder.encode(data, offsets)
            docs = part.column("doc_id").cast(pa.int64())
            place = np.searchsorted(bounds, docs.fill_null(0).to_numpy(), "left").astype(np.int32)
            place[docs.is_null().to_numpy(zero_copy_only=False)] = -1
            flat = flat.astype("<u2")
            yield B.record(_CODED, place, docs, [flat[a:b].tobytes() + b"\0\0" for a, b in zip(rows[:-1], rows[1:])])

    return run


_SHARD = pa.schema([("range", pa.int32()), ("number", pa.int32()), ("n_ids", pa.int64()),
                    ("doc_ids", pa.list_(pa.int64())), ("payload", pa.binary())])
_SHARD_SQL = "range int, number int, n_ids long, doc_ids array<long>, payload binary"


def _shards(limit):
    def run(batches):
        def close():
            body = np.frombuffer(b"".join(held), "<u2")
            starts = np.append(0, np.cumsum([len(x) // 2 for x in held]))
            return B.record(_SHARD, [now], [number], [len(body)], [docs], [build(body, starts)])

        now, number, held, docs, size = None, 0, [], [], 0
        for batch in batches:
            for range_, doc, ids in zip(*(batch.column(n).to_pylist() for n in ("range", "doc_id", "ids"))):
                if held and (range_ != now or size + len(ids) // 2 > limit):
                    yield close()
                    number = number + 1 if range_ == now else 0
                    held, docs, size = [], [], 0
                elif range_ != now:
                    number = 0
                now = range_
                held.append(ids)
                docs.append(doc)
                size += len(ids) // 2
        if held:
            yield close()

    return run


def write(docs: DataFrame, path: str, vocabulary: str | None = None, shard_ids: int = SHARD_IDS) -> None:
    """Encode every text, end it with id 0, and write shards in ascending doc_id order below ``path``.

    Columns doc_id and text; others are ignored. Null and empty texts are the single id 0. Null doc_ids come first,
    rows of one doc_id follow in the order of their ids. An empty table writes no shard.
    """
    vocabulary = vocabulary or T.vocabulary_path()
    docs = docs.select("doc_id", "text")
    octets = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = min(MAX_RANGES, max(B.partitions_for(docs.sparkSession), octets // RANGE_BYTES))
    # At most MAX_RANGES bounds.
    bounds = docs.filter("doc_id is not null").approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.2 / ranges)
    bounds = np.unique(np.array(bounds, np.int64))
    coded = docs.mapInArrow(_code(vocabulary, bounds), "range int, doc_id long, ids binary")
    placed = coded.repartition(ranges, "range").sortWithinPartitions("range", "doc_id", "ids")
    shards = placed.mapInArrow(_shards(shard_ids), _SHARD_SQL)
    shards.write.option("maxRecordsPerFile", 1).option("compression", "zstd").parquet(path)


def _read():
    schema = pa.schema([("range", pa.int32()), ("number", pa.int32()), ("doc_id", pa.int64()), ("inner", pa.int64()),
                        ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        for batch in batches:
            for range_, number, docs, payload in zip(*(batch.column(n) for n in ("range", "number", "doc_ids", "payload"))):
                shard = Wavelet(payload.as_buffer().to_pybytes())
                body, edge = shard.decode().astype("<u4"), shard.starts.astype(np.int64)
                k = shard.documents
                yield B.record(schema, [range_.as_py()] * k, [number.as_py()] * k, docs.values, edge[:-1],
                               np.diff(edge), [zlib.crc32(body[a:b]) for a, b in zip(edge[:-1], edge[1:])])

    return run


def read(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the shard files alone."""
    shards = spark.read.schema(_SHARD_SQL).parquet(path)
    rows = shards.select("range", "number", "doc_ids", "payload").mapInArrow(
        _read(), "range int, number int, doc_id long, inner long, n_tokens long, ids_crc32 long")
    sizes = shards.select("range", "number", "n_ids")
    # One total per range: at most MAX_RANGES + 1 numbers.
    totals, base = {r["range"]: r.n for r in sizes.groupBy("range").agg(F.sum("n_ids").alias("n")).collect()}, []
    at = 0
    for r in sorted(totals):
        base.append((r, at))
        at += totals[r]
    base = spark.createDataFrame(base, "range int, base long")
    w = W.partitionBy("range").orderBy("number").rowsBetween(W.unboundedPreceding, -1)
    first = sizes.withColumn("before", F.coalesce(F.sum("n_ids").over(w), F.lit(0))).join(F.broadcast(base), "range")
    first = first.select("range", "number", (F.col("before") + F.col("base")).alias("first"))
    return rows.join(first, ["range", "number"]).select(
        "doc_id", (F.col("inner") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame) -> DataFrame:
    """Write to a new folder of the shared place and read that back."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tokens_{uuid.uuid4().hex}"
    write(docs, path)
    return read(spark, path)
