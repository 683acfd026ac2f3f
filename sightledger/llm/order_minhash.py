"""Order MinHash fingerprints: signatures that follow edit distance, not only shared content.

Units are words (a run of more than ``LONG_WORD`` bytes counts character by character, as in texts without
blanks). Equal k-mers are told apart by their occurrence number. Each hash function takes the ``PICK`` least
k-mers, puts them back in text order and hashes that tuple; likeness is the share of equal tuples.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sightledger.llm import base as B

KMER = 2
PICK = 2
FUNCTIONS = 48
LONG_WORD = 64
MAX_RANGES = 4096
RANGE_BYTES = 16 << 20
CELLS = 1 << 17  # k-mers times functions looked at together

_VALUES = B.byte_values(808)
_A = np.random.default_rng(909).integers(1, 1 << 63, FUNCTIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = np.random.default_rng(910).integers(1, 1 << 63, FUNCTIONS, dtype=np.uint64)
_EMPTY = np.zeros(FUNCTIONS, np.uint32)


def _units(data, offsets):
    starts, ends, first = B.spans(data, offsets)
    long_ = np.flatnonzero(ends - starts > LONG_WORD)
    if len(long_):
        flag = np.zeros(len(data), bool)
        flag[starts] = True
        for i in long_:
            body = data[starts[i]:ends[i]]
            flag[starts[i]:ends[i]] |= (body & 0xC0) != 0x80
        split = np.flatnonzero(flag)
        ends = np.minimum(np.append(split[1:], len(data)), ends[np.searchsorted(starts, split, "right") - 1])
        starts = split
        first = np.searchsorted(starts, offsets)
    return B.piece_hashes(data, starts, ends, _VALUES, B.WORD_BASE), first


def _numbered(h: np.ndarray) -> np.ndarray:
    """Hash of each k-mer with the number of its occurrence."""
    order = np.argsort(h, kind="stable")
    sorted_ = h[order]
    new = np.ones(len(h), bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    if new.all():
        return h
    start = np.flatnonzero(new)
    number = np.arange(len(h)) - start[np.cumsum(new) - 1]
    out = h.copy()
    out[order] += number.astype(np.uint64) * np.uint64(B.GRAM_BASE)
    again = out != h
    out[again] = B.mix(out[again])
    return out


def _signature(h: np.ndarray) -> np.ndarray:
    if not len(h):
        return _EMPTY
    h = _numbered(h)
    out = np.empty(FUNCTIONS, np.uint32)
    step = max(1, CELLS // len(h))
    for a in range(0, FUNCTIONS, step):
        v = h[None, :] * _A[a:a + step, None] + _B[a:a + step, None]
        rows = np.arange(len(v))
        picked = []
        for n in range(min(PICK, len(h))):
            at = v.argmin(1)
            picked.append(at)
            v[rows, at] = np.uint64(0xFFFFFFFFFFFFFFFF)
        places = np.sort(np.stack(picked), 0)
        total = np.full(len(v), np.uint64(len(picked)))
        for p in places:
            total = B.mix(total * np.uint64(B.WORD_BASE) + h[p])
        out[a:a + step] = (total >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    return out


def signatures(data: np.ndarray, offsets: np.ndarray, k: int = KMER) -> list[np.ndarray]:
    """One array of FUNCTIONS numbers per row; all zero for a row without words."""
    h, first = _units(data, offsets)
    out = []
    g = B.grams(h, k)
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= k:
            out.append(_signature(g[a:b - k + 1]))
        else:
            out.append(_signature(B.grams(h[a:b], int(b - a)) if b > a else h[:0]))
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def _texts(texts):
    data, offsets = B.utf8(pa.array(texts, pa.large_string()))
    return data, offsets


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                  ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _with_next(batches):
    """Rows of a range in order, its last one the head of the next range: each is edited with the one after it."""
    held = None

    def finish(pairs):
        edited = [t[:len(t) - len(t) // 2] + u[:len(t) // 2] for (_, t, _), (_, u, _) in pairs]
        marks = []
        for at in range(0, len(edited), 64):
            marks += signatures(*_texts(edited[at:at + 64]))
        cols = [[d for (d, _, _), _ in pairs], [len(t) for (_, t, _), _ in pairs],
                [hashlib.sha256(e.encode("utf-8")).hexdigest() for e in edited],
                [s.astype(">u4").tobytes().hex() for (_, _, s), _ in pairs], [s.astype(">u4").tobytes().hex() for s in marks],
                [likeness(s, e) for ((_, _, s), _), e in zip(pairs, marks)], [likeness(s, n) for (_, _, s), (_, _, n) in pairs]]
        return B.record(_OUT, *cols)

    for part, data, offsets in B.blocks(batches):
        marks = signatures(data, offsets)
        texts = part.column(part.schema.get_field_index("text")).to_pylist()
        pairs = []
        for doc, alone, end, text, mark in zip(
                part.column("doc_id").to_pylist(), part.column("alone").to_pylist(), part.column("end").to_pylist(), texts, marks):
            row = (doc, text or "", mark)
            if alone:
                pairs.append((row, row))
                continue
            if held is not None:
                pairs.append((held, row))
            held = None if end else row
        if pairs:
            yield finish(pairs)


def _place(bounds: list[int]):
    """Number of bounds below doc_id, by two short searches."""
    step = max(1, int(len(bounds) ** 0.5))
    coarse, fine = bounds[step - 1::step], [bounds[i:i + step] for i in range(0, len(bounds), step)] + [[]]
    numbers = lambda xs: "array(" + ", ".join(f"{x}L" for x in xs) + ")" if xs else "cast(array() as array<bigint>)"
    hop = f"size(filter({numbers(coarse)}, x -> x < doc_id))"
    inner = f"element_at(array({', '.join(numbers(f) for f in fine)}), least({hop}, {len(fine) - 1}) + 1)"
    return F.expr(f"cast({hop} * {step} + size(filter({inner}, x -> x < doc_id)) as int)") if bounds else F.lit(0)


def with_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last half is the head of the next document's.

    The next document is the one below in doc_id, the highest after the lowest; rows of one doc_id follow each
    other by text; a row without doc_id is its own next one. Null texts count as empty, an empty text has an
    all-zero fingerprint, alike only to another one. Other columns are ignored; an empty table gives none.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    known = docs.filter("doc_id is not null")
    octets = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = min(MAX_RANGES, max(B.partitions_for(docs.sparkSession), octets // RANGE_BYTES))
    bounds = sorted({int(x) for x in known.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.2 / ranges)})
    place = _place(bounds)
    # One head per range: at most MAX_RANGES numbers.
    heads = {r.at: r.head for r in known.groupBy(place.alias("at")).agg(F.max("doc_id").alias("head")).collect()}
    order = sorted(heads)
    after = {at: heads[order[i - 1]] for i, at in enumerate(order)}
    rows = docs.select("doc_id", "text", F.coalesce(F.when(F.col("doc_id").isNotNull(), place), F.lit(-1)).alias("at"),
                       F.col("doc_id").isNull().alias("alone"), F.lit(False).alias("end"))
    if after:
        # The heads once more, each as the end of the range above it.
        ends = docs.sparkSession.createDataFrame(sorted(after.items()), "at int, doc_id long")
        again = known.filter(F.col("doc_id").isin(sorted(set(after.values())))).join(F.broadcast(ends), "doc_id")
        rows = rows.unionByName(again.select("doc_id", "text", "at", F.lit(False).alias("alone"), F.lit(True).alias("end")))
    placed = rows.repartition(ranges, "at").sortWithinPartitions("at", F.col("end").asc(), F.col("doc_id").desc(), "text")
    return placed.select("doc_id", "alone", "end", "text").mapInArrow(
        _with_next, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                    "near_edited double, near_next double")
