"""Substring dedup: a count-min prefilter and an exact second pass over word windows.

Pass 1. Every scan task hashes its windows into the cells of a count-min sketch (``DEPTH`` rows). A
partition sketch travels as sorted cells per slice, gap-coded, each cell at most twice; slices merge
in two levels and become one bit per cell: "at least two starts". Counts only ever overestimate.

Pass 2. Windows whose cells are set in every row are grouped exactly by a 96-bit hash. A block (some
thousand neighbouring rows) sends each distinct window once, with its own count, so a passage shared
by all documents costs one entry per block. Repeated windows go back to their blocks, which meet
their texts again and drop the covered words. Nothing is capped: if the sketch is too small for the
corpus, more windows reach pass 2 and the result stays the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F

from sightledger.llm import base as B

WINDOW = 35
DEPTH = 2
SLICE_BITS = 22          # cells of a slice
MAX_CELL_BITS = 29       # cells of a row: the broadcast is at most DEPTH * 2^29 bits = 128 MiB
FLUSH_WINDOWS = 4 << 20  # windows a task holds before it sends cells
FLUSH_ENTRIES = 1 << 20  # candidate windows a task holds before it sends entries
MERGED_TASKS = 256       # partition sketches that one merge takes; beyond, merges are in two levels
ENTRY_BITS = 20          # windows of a slice in pass 2, about
ROWS_PER_BLOCK = 4096

_V1, _V2 = B.byte_values(101), B.byte_values(202)
_BASE2 = 0xA0761D6478BD642F | 1


def _windows(data, offsets, window):
    """Two hashes per window start, the word index of each start, and the words of the rows."""
    starts, ends, first = B.spans(data, offsets)
    rows, counts = B.rows_of_grams(first, window)
    h1 = B.grams(B.piece_hashes(data, starts, ends, _V1, B.WORD_BASE), window)[rows]
    h2 = B.grams(B.piece_hashes(data, starts, ends, _V2, _BASE2), window, _BASE2)[rows]
    return h1, h2, rows, counts, (starts, ends, first)


def _cells(h1, h2, bits):
    """The cell of each window in each row of the sketch."""
    return [B.mix(h1 + np.uint64(2 * d + 1) * h2) >> np.uint64(64 - bits) for d in range(DEPTH)]


def _encode(cells: np.ndarray) -> bytes:
    """Sorted cells as gaps; the largest value of the unit means "add it and go on"."""
    gaps = np.diff(cells, prepend=0).astype(np.int64)
    unit = 1 if len(cells) and gaps.mean() < 200 else 2
    top = (1 << 8 * unit) - 1
    extra = gaps // top
    out = np.full(int(extra.sum()) + len(gaps), top, np.uint8 if unit == 1 else np.dtype("<u2"))
    out[np.cumsum(extra + 1) - 1] = gaps - extra * top
    return bytes([unit]) + out.tobytes()


def _decode(blob: bytes) -> np.ndarray:
    unit = blob[0]
    values = np.frombuffer(blob, np.uint8 if unit == 1 else np.dtype("<u2"), offset=1)
    return np.cumsum(values, dtype=np.int64)[values != (1 << 8 * unit) - 1]


def _twice(sorted_cells: np.ndarray) -> np.ndarray:
    """Each value at most two times."""
    if len(sorted_cells) < 3:
        return sorted_cells
    keep = np.ones(len(sorted_cells), bool)
    keep[2:] = sorted_cells[2:] != sorted_cells[:-2]
    return sorted_cells[keep]


_SKETCH = pa.schema([("slice", pa.int32()), ("part", pa.int32()), ("cells", pa.binary())])
_SKETCH_SQL = "slice int, part int, cells binary"


def _sketch(window, bits, groups):
    slice_bits = min(bits, SLICE_BITS)
    per_row = 1 << (bits - slice_bits)

    def flush(held, part):
        slices, blobs = [], []
        for d in range(DEPTH):
            cells = np.concatenate([h[d] for h in held])
            cells.sort()
            cuts = np.searchsorted(cells >> np.uint32(slice_bits), np.arange(per_row + 1))
            for s in range(per_row):
                if cuts[s + 1] > cuts[s]:
                    slices.append(d * per_row + s)
                    blobs.append(_encode(_twice(cells[cuts[s]:cuts[s + 1]].astype(np.int64) - (s << slice_bits))))
        return B.record(_SKETCH, slices, [part] * len(slices), blobs)

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() % groups
        held, size = [], 0
        for _, data, offsets in B.blocks(batches):
            h1, h2, *_ = _windows(data, offsets, window)
            if len(h1):
                held.append([c.astype(np.uint32) for c in _cells(h1, h2, bits)])
                size += len(h1)
            if size >= FLUSH_WINDOWS:
                yield flush(held, part)
                held, size = [], 0
        if size:
            yield flush(held, part)

    return run


def _merge(final, slice_bits):
    """Counts of a slice, from its blobs one after another; dense, one byte a cell."""
    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, key = np.zeros(1 << slice_bits, np.uint8), None
        for batch in tables:
            for key, blob in zip(batch.column("slice").to_pylist(), batch.column("cells").to_pylist()):
                cells = _decode(blob)
                again = cells[1:][cells[1:] == cells[:-1]]
                counts[cells] = np.minimum(counts[cells] + 1, 2)
                counts[again] = 2
        if final:
            body = np.packbits(counts >= 2).tobytes()
        else:
            body = _encode(np.repeat(np.arange(len(counts)), counts))
        yield B.record(_SKETCH, [key], [0], [body])

    return run


def repeated_cells(texts: DataFrame, window: int, bits: int) -> bytes:
    """One bit per cell of every sketch row: set where two windows or more may start."""
    slice_bits = min(bits, SLICE_BITS)
    source = texts.select("text")
    groups = -(-source.rdd.getNumPartitions() // MERGED_TASKS)
    merged = source.mapInArrow(_sketch(window, bits, groups), _SKETCH_SQL)
    if groups > 1:
        merged = merged.groupBy("slice", "part").applyInArrow(_merge(False, slice_bits), _SKETCH_SQL)
    merged = merged.groupBy("slice").applyInArrow(_merge(True, slice_bits), _SKETCH_SQL)
    size = (1 << slice_bits) // 8
    out = bytearray(DEPTH * (1 << bits) // 8)
    # At most DEPTH * 2^MAX_CELL_BITS bits in all, whatever the corpus.
    for row in merged.toLocalIterator():
        out[row.slice * size:(row.slice + 1) * size] = row.cells
    return bytes(out)


_ENTRY = pa.schema([("slice", pa.int64()), ("block", pa.int64()), ("entries", pa.binary())])
_ENTRY_SQL = "slice long, block long, entries binary"


def _maybe_repeated(h1, h2, bitmap, bits):
    hit = np.ones(len(h1), bool)
    for d, cells in enumerate(_cells(h1, h2, bits)):
        cells = cells.astype(np.int64) + (d << bits)
        hit &= (bitmap[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1 == 1
    return hit


def _entries(window, bits, slice_bits, sent):
    """Distinct candidate windows of every block: h1, h2 and whether it starts twice in the block."""
    def run(batches):
        bitmap = np.frombuffer(sent.value, np.uint8)

        def close(block, held):
            h1, h2 = (np.concatenate(x) for x in zip(*held))
            h2 = (h2 >> np.uint64(32)).astype(np.uint32)
            order = np.lexsort((h2, h1))
            h1, h2 = h1[order], h2[order]
            new = np.ones(len(h1), bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            first = np.flatnonzero(new)
            count = np.minimum(np.diff(np.append(first, len(h1))), 2).astype(np.uint8)
            h1, h2 = h1[first], h2[first]
            slices = (h1 >> np.uint64(64 - slice_bits)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(slices, prepend=-1))
            ends = np.append(cuts[1:], len(slices))
            blobs = [h1[a:b].tobytes() + h2[a:b].tobytes() + count[a:b].tobytes() for a, b in zip(cuts, ends)]
            return B.record(_ENTRY, slices[cuts], np.full(len(cuts), block), blobs)

        now, held, size = None, [], 0
        for part, data, offsets in B.blocks(batches):
            h1, h2, rows, counts, _ = _windows(data, offsets, window)
            hit = _maybe_repeated(h1, h2, bitmap, bits)
            of = np.asarray(part.column("__block").to_numpy(zero_copy_only=False))
            changes = np.append(np.flatnonzero(np.diff(of, prepend=of[0])), len(of))
            upto = np.append(0, np.cumsum(counts))
            a = 0
            for b in changes:
                if now is not None and of[a] != now and held:
                    yield close(now, held)
                    held, size = [], 0
                now = of[a]
                lo, hi = upto[a], upto[b]
                if hit[lo:hi].any():
                    held.append((h1[lo:hi][hit[lo:hi]], h2[lo:hi][hit[lo:hi]]))
                    size += int(hit[lo:hi].sum())
                if size >= FLUSH_ENTRIES:
                    yield close(now, held)
                    held, size = [], 0
                a = b
        if held:
            yield close(now, held)

    return run


_BACK = pa.schema([("block", pa.int64()), ("repeated", pa.binary())])


def _exact(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of a slice that start at least twice in all, sent back to every block that has one."""
    parts, blocks = [[], [], []], []
    for batch in tables:
        for block, blob in zip(batch.column("block").to_pylist(), batch.column("entries").to_pylist()):
            n = len(blob) // 13
            parts[0].append(np.frombuffer(blob, np.uint64, n))
            parts[1].append(np.frombuffer(blob, np.uint32, n, offset=8 * n))
            parts[2].append(np.frombuffer(blob, np.uint8, n, offset=12 * n))
            blocks.append(np.full(n, block))
    h1, h2, count = (np.concatenate(p) for p in parts)
    blocks = np.concatenate(blocks)
    order = np.lexsort((h2, h1))
    h1, h2, count, blocks = h1[order], h2[order], count[order], blocks[order]
    new = np.ones(len(h1), bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    total = np.add.reduceat(count.astype(np.int64), np.flatnonzero(new))
    keep = (total >= 2)[np.cumsum(new) - 1]
    h1, blocks = h1[keep], blocks[keep]
    if len(h1):
        order = np.argsort(blocks, kind="stable")
        h1, blocks = h1[order], blocks[order]
        cuts = np.append(np.flatnonzero(np.diff(blocks, prepend=blocks[0] - 1)), len(blocks))
        yield B.record(_BACK, blocks[cuts[:-1]], [h1[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])])


def _kept(window, names):
    """Texts of a block and its repeated windows: what remains of every text."""
    def run(texts, lists):
        known = [np.frombuffer(x, np.uint64) for x in lists.column("repeated").to_pylist()]
        known = np.sort(np.concatenate(known)) if known else np.zeros(0, np.uint64)
        for part, data, offsets in B.blocks(texts.to_batches()):
            h1, _, rows, _, (starts, ends, first) = _windows(data, offsets, window)
            if len(known):
                at = np.minimum(np.searchsorted(known, h1), len(known) - 1)
                rows = rows[known[at] == h1]
            else:
                rows = rows[:0]
            edge = np.zeros(len(starts) + 1, np.int64)
            np.add.at(edge, rows, 1)
            np.add.at(edge, rows + window, -1)
            kept = np.cumsum(edge[:-1]) == 0
            n_words = np.diff(first)
            n_kept = np.diff(np.append(0, np.cumsum(kept))[first])
            plain = B.SPACE[data]
            flat = np.where(plain, np.uint8(32), data).tobytes()
            out = []
            for i in range(part.num_rows):
                a, b = first[i], first[i + 1]
                if n_kept[i] == 0:
                    out.append(b"")
                elif n_kept[i] == n_words[i] and ends[b - 1] - starts[a] == (ends[a:b] - starts[a:b]).sum() + b - a - 1:
                    out.append(flat[starts[a]:ends[b - 1]])
                else:
                    words = flat[offsets[i]:offsets[i + 1]].split()
                    out.append(b" ".join(compress(words, kept[a:b])))
            columns = [part.column(part.schema.get_field_index(n)) for n in names]
            extra = [pa.array(n_words, pa.int64()), pa.array(n_words - n_kept, pa.int64()),
                     pa.array(out, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns + extra, names=names + ["n_words", "n_removed", "kept_text"])

    return lambda key, texts, lists: _joined(run(texts, lists))


def _joined(parts):
    return pa.Table.from_batches(list(parts))


def _addressed(docs: DataFrame) -> DataFrame:
    """Rows with the block they lie in: neighbours in a file. Other inputs are written first."""
    block = F.xxhash64(F.col("_metadata.file_path"), F.floor(F.col("_metadata.row_index") / ROWS_PER_BLOCK))
    try:
        return docs.select(*[F.col(f"`{c}`") for c in docs.columns], block.alias("__block"))
    except AnalysisException:
        return B.table(docs).select(*[F.col(f"`{c}`") for c in docs.columns], block.alias("__block"))


def shape_for(octets: int) -> tuple[int, int]:
    """Bits of the sketch's cells, at most MAX_CELL_BITS, and bits of the exact pass's slices, which grow with the texts."""
    bits = max((octets // 2).bit_length(), 12)
    return min(bits, MAX_CELL_BITS), _slice_bits(bits)


def _slice_bits(bits):
    return max(6, bits - ENTRY_BITS - 2)


def remove_repeats(docs: DataFrame, window: int = WINDOW, cell_bits: int | None = None) -> DataFrame:
    """Drop every word that lies in a window of ``window`` words which also starts anywhere else.

    Returns all columns of ``docs`` with ``n_words``, ``n_removed`` and ``kept_text`` (kept words, one
    space between them); input columns of these names are replaced. A null or empty text has no words
    and an empty ``kept_text``; repeated rows count as further places; an empty table gives none.
    """
    spark = docs.sparkSession
    names = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept_text", "__block")]
    docs = docs.select(*[F.col(f"`{c}`") for c in names])
    if cell_bits is None:
        octets = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        cell_bits, slice_bits = shape_for(octets)
    else:
        slice_bits = _slice_bits(cell_bits)
    source = _addressed(docs)
    bitmap = repeated_cells(source, window, cell_bits)
    sent = spark.sparkContext.broadcast(bitmap)
    entries = source.select("__block", "text").mapInArrow(
        _entries(window, cell_bits, slice_bits, sent), _ENTRY_SQL)
    back = entries.groupBy("slice").applyInArrow(_exact, "block long, repeated binary")
    schema = source.select(*[F.col(f"`{c}`") for c in names]).schema
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return source.groupBy("__block").cogroup(back.withColumnRenamed("block", "__block").groupBy("__block")).applyInArrow(
        _kept(window, names), f"{out}, n_words long, n_removed long, kept_text string")
