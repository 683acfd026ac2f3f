"""Bounded-space online packing of token ids into fixed windows.

Every scan task keeps ``OPEN`` windows. Full windows are cut off a document first; its remainder goes where it
fits best. When it fits nowhere, the fullest window is emitted, topped up from the remainder if the gap is
worth a cut. Windows still open at the end of a task are packed again, some thousand tasks' leftovers per
task and round, until one task holds the rest.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sightledger.llm import base as B, tokens as T

LENGTH = 1024
OPEN = 64
LEAST_CUT = 16     # gaps below this are padded, not filled by a cut
MERGED = 4096      # leftover windows packed by one task in a round


class Windows:
    """Open windows ordered by the room that is left; at most ``limit`` of them."""

    def __init__(self, length: int, limit: int):
        self.length, self.limit = length, limit
        self.rooms: list[tuple[int, int]] = []   # (room, window), ascending
        self.held: dict[int, list] = {}
        self.made = 0

    def new(self) -> int:
        self.made += 1
        return self.made - 1

    def place(self, size: int, item) -> bool:
        """Best fit: the window with the least room that is enough, or a new one while there may be more."""
        at = bisect_left(self.rooms, (size, -1))
        if at < len(self.rooms):
            room, window = self.rooms.pop(at)
        elif len(self.rooms) < self.limit:
            room, window = self.length, self.new()
            self.held[window] = []
        else:
            return False
        self.held[window].append(item)
        insort(self.rooms, (room - size, window))
        return True

    def full(self):
        """Windows without room leave at once."""
        while self.rooms and self.rooms[0][0] == 0:
            _, window = self.rooms.pop(0)
            yield window, self.held.pop(window)

    def fullest(self):
        room, window = self.rooms.pop(0)
        return room, window, self.held.pop(window)


_PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("round", pa.int32())])
_PIECE_SQL = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
              "round int")


def _pack(path, length, limit, with_ids):
    schema = _PIECE.append(pa.field("ids", pa.binary())) if with_ids else _PIECE

    def run(batches):
        from pyspark import TaskContext

        encoder, windows = T.encoder(path), Windows(length, limit)
        base = TaskContext.get().partitionId() << 36
        out = []

        def emit(window, pieces, round_=0):
            at = 0
            for doc, start, ids, total in pieces:
                row = (doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, base + window, at, round_)
                out.append(row + (ids.astype("<u4").tobytes(),) if with_ids else row)
                at += len(ids)

        for part, data, offsets in B.blocks(batches):
            flat, rows = encoder.encode(data, offsets)
            for i, doc in enumerate(part.column("doc_id").to_pylist()):
                ids = np.append(flat[rows[i]:rows[i + 1]], np.uint16(0))
                total, start = len(ids), 0
                while total - start >= length:
                    emit(windows.new(), [(doc, start, ids[start:start + length], total)])
                    start += length
                while start < total:
                    if windows.place(total - start, (doc, start, ids[start:], total)):
                        for window, pieces in windows.full():
                            emit(window, pieces)
                        break
                    room, window, pieces = windows.fullest()
                    if room >= LEAST_CUT:
                        pieces.append((doc, start, ids[start:start + room], total))
                        start += room
                    emit(window, pieces)
            yield B.record(schema, *zip(*out)) if out else B.record(schema, *[[]] * len(schema))
            out = []
        for window, pieces in windows.held.items():
            emit(window, pieces, 1)
        yield B.record(schema, *zip(*out)) if out else B.record(schema, *[[]] * len(schema))

    return run


def _merge(length, limit, number):
    """Leftover windows of a group, best fit again, largest first; the last ones stay open for the next round."""
    def run(rows):
        table = rows.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        old, size = table.column("sequence_id").to_numpy(), table.column("length").to_numpy()
        cuts = np.flatnonzero(np.diff(old, prepend=-1))
        ends = np.append(cuts[1:], len(old))
        sizes = np.add.reduceat(size, cuts)
        group = table.column("group")[0].as_py()
        base = (number << 56) + (group << 24)
        sequence, offset = np.zeros(len(old), np.int64), np.zeros(len(old), np.int64)
        still = np.full(len(old), 0, np.int32)
        windows = Windows(length, limit)

        def emit(window, items, open_):
            at = 0
            for i in items:
                a, b = cuts[i], ends[i]
                sequence[a:b] = base + window
                offset[a:b] = at + np.cumsum(size[a:b]) - size[a:b]
                still[a:b] = number + 1 if open_ else 0
                at += int(sizes[i])

        for i in np.argsort(-sizes, kind="stable"):
            while not windows.place(int(sizes[i]), i):
                _, window, items = windows.fullest()
                emit(window, items, False)
            for window, items in windows.full():
                emit(window, items, False)
        for window, items in windows.held.items():
            emit(window, items, True)
        for name, values in (("sequence_id", sequence), ("offset", offset), ("round", still)):
            table = table.set_column(table.schema.get_field_index(name), name, pa.array(values))
        return table.drop_columns(["group"])

    return run


def pack(docs: DataFrame, length: int = LENGTH, open_windows: int = OPEN, path: str | None = None,
         with_ids: bool = False) -> DataFrame:
    """Pieces of documents in sequences of at most ``length`` ids; an id 0 ends every document.

    Columns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, on request, ids (little-endian
    unsigned 32-bit). Pieces of a sequence lie without gaps from offset 0. A null or empty text is the single id 0;
    other columns of ``docs`` are ignored; repeated rows are packed each; null ids are kept; an empty table gives none.
    """
    path = path or T.vocabulary_path()
    sql = _PIECE_SQL + (", ids binary" if with_ids else "")
    pieces = B.table(docs.select("doc_id", "text").mapInArrow(_pack(path, length, open_windows, with_ids), sql))
    done, left, number = [pieces.filter("round = 0")], pieces.filter("round = 1"), 1
    while True:
        n = left.select("sequence_id").distinct().count()
        groups = -(-n // MERGED)
        if not groups:
            break
        # In the last round one group of at most MERGED windows closes all of them.
        limit = open_windows if groups > 1 else MERGED
        keyed = left.withColumn("group", F.pmod(F.xxhash64("sequence_id"), F.lit(groups)))
        packed = B.table(keyed.groupBy("group").applyInArrow(_merge(length, limit, number), sql))
        done.append(packed.filter("round = 0") if groups > 1 else packed)
        if groups == 1:
            break
        left, number = packed.filter(F.col("round") > 0), number + 1
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    return result.drop("round")
