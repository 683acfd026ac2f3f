"""Collocations from a weighted de Bruijn graph of words.

An edge is a run of three words, a node a run of two; an edge leads from the node of its first two words to that of
its last two. Only edges are counted. The count of a shorter run is the flow out of it: a node's is the sum of its
edges, a word's the sum of the nodes that begin with it. A piece ends in edges to an end mark, which carry what its
last words would lack.

An edge matters on its own only if both its nodes reach the least count. A first scan counts node hashes in a bounded
array (one byte a cell, merged per slice); counts can only be too high. The second scan lets light nodes flow together
in one "other" edge, so what is shuffled follows the frequent part of the text, and every count is still exact. If the
array is too small for the corpus, more edges are kept apart and the result stays the same.

Runs of edges between nodes that nothing else enters or leaves are unary paths: all their edges and inner nodes have
one count. They are compacted by pointer doubling into one row each. Inner nodes need no score, since the longer
phrase around them is as frequent as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from sightledger.llm import base as B

LEAST = 10               # occurrences of a phrase, at least
MOST = 2000              # phrases of a language, at most
SHARE = 50               # percent of its count from which a longer phrase stands for a shorter one
CELL_BITS = (16, 29)     # cells of the first scan: two to the power of this, at least and at most
SLICE_BITS = 20          # cells of a slice
FLUSH = 2 << 20          # words a task holds before it sends
MERGED_TASKS = 256       # parts that one merge takes; beyond, merges are in two levels
END, OTHER = 0, 1        # marks in place of a word: the piece ends; the node is light

_GAP = np.zeros(256, bool)      # between words
_GAP[[0x20, 9]] = True
_STOP = np.zeros(256, bool)     # between pieces
_STOP[[*b".,;:!?", 10, 11, 12, 13]] = True
_VALUES = B.byte_values(911, lower=True)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _lang_hash(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def words_of(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray):
    """Hash (of language and word), language number, start, end of every word; whether it ends its piece; languages."""
    starts, ends, first = B.spans(data, offsets, _GAP | _STOP)
    langs = part.column(part.schema.get_field_index("lang"))
    coded = pc.fill_null(langs, "und").dictionary_encode()
    names = coded.dictionary.to_pylist()
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    lang = np.asarray(coded.indices)[row]
    h = B.piece_hashes(data, starts, ends, _VALUES, B.WORD_BASE)
    if len(h):
        h = B.mix(h ^ np.array([_lang_hash(n) for n in names], np.uint64)[lang])
        h[h <= OTHER] += np.uint64(2)
    last = np.ones(len(h), bool)
    if len(h) > 1:
        stops = np.append(0, np.cumsum(_STOP[data], dtype=np.int64))
        last[:-1] = (row[1:] != row[:-1]) | (stops[starts[1:]] != stops[ends[:-1]])
    return h, lang, starts, ends, last, names


def _node(h: np.ndarray) -> np.ndarray:
    """Hash of each word with the next one."""
    return B.mix(h[:-1] * np.uint64(B.GRAM_BASE) + h[1:])


_CELLS = pa.schema([("slice", pa.int32()), ("part", pa.int32()), ("cells", pa.binary()), ("counts", pa.binary())])
_CELLS_SQL = "slice int, part int, cells binary, counts binary"


def _counted(cells: np.ndarray, counts: np.ndarray, least: int):
    """Distinct cells with their counts, up to ``least``."""
    order = np.argsort(cells, kind="stable")
    cells, counts = cells[order], counts[order]
    at = np.flatnonzero(np.diff(cells, prepend=-1))
    return cells[at], np.minimum(np.add.reduceat(counts, at), least) if len(at) else counts


def _scan_cells(bits: int, least: int, groups: int):
    slice_bits = min(bits, SLICE_BITS)

    def flush(held, part):
        cells = np.concatenate(held).astype(np.int64)
        cells, counts = _counted(cells, np.ones(len(cells), np.int64), least)
        slices = cells >> slice_bits
        cuts = np.append(np.flatnonzero(np.diff(slices, prepend=-1)), len(cells))
        inner = (cells & ((1 << slice_bits) - 1)).astype(np.uint32)
        counts = counts.astype(np.uint8)
        pairs = list(zip(cuts[:-1], cuts[1:]))
        return B.record(_CELLS, slices[cuts[:-1]].astype(np.int32), [part] * len(pairs),
                        [np.diff(inner[a:b], prepend=np.uint32(0)).tobytes() for a, b in pairs], [counts[a:b].tobytes() for a, b in pairs])

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() % groups
        held, size = [], 0
        for rows, data, offsets in B.blocks(batches):
            h, _, _, _, last, _ = words_of(rows, data, offsets)
            if len(h) > 1:
                cells = _node(h)[~last[:-1]] >> np.uint64(64 - bits)
                held.append(cells.astype(np.uint32))
                size += len(cells)
            if size >= FLUSH:
                yield flush(held, part)
                held, size = [], 0
        if size:
            yield flush(held, part)

    return run


def _merge_cells(bits: int, least: int, final: bool):
    """Counts of a slice, one byte a cell, from its blobs one after another; at last a bit per cell."""
    slice_bits = min(bits, SLICE_BITS)

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, key, part = np.zeros(1 << slice_bits, np.uint8), 0, 0
        for batch in tables:
            for key, part, cells, counts in zip(*(c.to_pylist() for c in batch.columns)):
                at = np.cumsum(np.frombuffer(cells, np.uint32), dtype=np.int64)
                total[at] = np.minimum(total[at].astype(np.int64) + np.frombuffer(counts, np.uint8), least)
        if final:
            yield B.record(_CELLS, [key], [0], [np.packbits(total >= least).tobytes()], [b""])
        else:
            at = np.flatnonzero(total)
            yield B.record(_CELLS, [key], [part], [np.diff(at.astype(np.uint32), prepend=np.uint32(0)).tobytes()], [total[at].tobytes()])

    return run


def heavy_cells(docs: DataFrame, least: int, bits: int) -> bytes:
    """One bit per cell: set where the nodes hashed to it may occur ``least`` times in all."""
    slice_bits = min(bits, SLICE_BITS)
    parts = docs.select(F.spark_partition_id().alias("p")).agg(F.max("p")).first()[0] or 0
    groups = -(-(parts + 1) // MERGED_TASKS)
    cells = docs.select("lang", "text").mapInArrow(_scan_cells(bits, min(least, 255), groups), _CELLS_SQL)
    if groups > 1:
        cells = cells.groupBy("slice", "part").applyInArrow(_merge_cells(bits, min(least, 255), False), _CELLS_SQL)
    merged = cells.groupBy("slice").applyInArrow(_merge_cells(bits, min(least, 255), True), _CELLS_SQL)
    size = (1 << slice_bits) // 8 or 1
    out = bytearray(size << (bits - slice_bits))
    # 2^29 bits at most in all, whatever the corpus.
    for row in merged.select("slice", "cells").toLocalIterator():
        out[row.slice * size:(row.slice + 1) * size] = row.cells
    return bytes(out)


_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("c", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])
_EDGE_SQL = "a long, b long, c long, lang string, word string, n long"


def _distinct(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """First row of each distinct tuple, and how often it occurs."""
    if not len(columns[0]):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[order[1:]] != c[order[:-1]]
    at = np.flatnonzero(new)
    return order[at], np.diff(np.append(at, len(order)))


def _scan_edges(bits: int, sent):
    """Edges of a block with their counts; for every word a row (a, OTHER, OTHER) that also names it."""
    def run(batches):
        heavy = np.frombuffer(sent.value, np.uint8)

        def flush(held):
            a, b, c = (np.concatenate(x) for x in zip(*held))
            at, n = _distinct([a, b, c])
            none = pa.nulls(len(at), pa.string())
            yield B.record(_EDGE, *(x[at].view(np.int64) for x in (a, b, c)), none, none, n)

        def names(h, lang, starts, ends, data, langs, light):
            """Distinct words of a block: their hash, spelling, and how often their node is light or missing."""
            at, _ = _distinct([h])
            value, first = h[at], at
            n = np.bincount(np.searchsorted(value, h[light]), minlength=len(value))
            sizes = (ends - starts)[first]
            offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
            place = np.arange(offsets[-1]) + np.repeat(starts[first] - offsets[:-1], sizes)
            spelled = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets.tobytes()), pa.py_buffer(_LOWER[data[place]].tobytes()))
            other = np.full(len(value), OTHER)
            return B.record(_EDGE, value.view(np.int64), other, other, pa.array(langs).take(pa.array(lang[first])), spelled, n)

        held, size = [], 0
        for rows, data, offsets in B.blocks(batches, limit=4 * B.BLOCK_BYTES):
            h, lang, starts, ends, last, langs = words_of(rows, data, offsets)
            if not len(h):
                continue
            strong = np.zeros(len(h), bool)   # the node that begins here may be heavy
            cells = (_node(h) >> np.uint64(64 - bits)).astype(np.int64)
            strong[:-1] = ~last[:-1] & ((heavy[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1 == 1)
            yield names(h, lang, starts, ends, data, langs, ~strong)
            at = np.flatnonzero(strong)
            c = np.full(len(at), OTHER, np.uint64)
            c[last[at + 1]] = END
            whole = strong[at + 1]
            c[whole] = h[at[whole] + 2]
            held.append((h[at], h[at + 1], c))
            size += len(at)
            if size >= FLUSH:
                yield from flush(held)
                held, size = [], 0
        if size:
            yield from flush(held)

    return run


class Graph:
    """Edges (a, b, c, n), nodes (a, b, f), words (a, lang, word, f) and languages (lang, n)."""

    def __init__(self, docs: DataFrame, least: int = LEAST, bits: int | None = None):
        spark = docs.sparkSession
        docs = docs.select(F.col("lang").cast("string").alias("lang"), "text")
        if bits is None:
            octets = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
            bits = min(max((octets // 4).bit_length(), CELL_BITS[0]), CELL_BITS[1])
        sent = spark.sparkContext.broadcast(heavy_cells(docs, least, bits))
        rows = docs.mapInArrow(_scan_edges(bits, sent), _EDGE_SQL)
        rows = B.table(rows.groupBy("a", "b", "c", "lang", "word").agg(F.sum("n").alias("n")))
        named = F.col("word").isNotNull()
        self.edges = rows.filter(~named).select("a", "b", "c", "n")
        self.nodes = B.table(self.edges.groupBy("a", "b").agg(F.sum("n").alias("f")).filter(F.col("f") > 0))
        flow = self.nodes.groupBy("a").agg(F.sum("f").alias("flow"))
        words = rows.filter(named).select("a", "lang", "word", "n").join(flow, "a", "left")
        self.words = B.table(words.select("a", "lang", "word", (F.col("n") + F.coalesce("flow", F.lit(0))).alias("f")))
        # A hash that stands for two words would mix their counts.
        if not self.words.groupBy("a").count().filter("count > 1").isEmpty():
            raise ValueError("two words share a hash; take other byte values")
        self.languages = self.words.groupBy("lang").agg(F.sum("f").alias("n"))


def heavy_edges(graph: Graph, least: int) -> DataFrame:
    """Edges of three words that occur ``least`` times: id, a, b, c, n and the flow of their nodes, fa and fb."""
    nodes = graph.nodes.filter(F.col("f") >= least)
    rows = graph.edges.filter((F.col("n") >= least) & (F.col("c") != END) & (F.col("c") != OTHER))
    rows = rows.join(nodes.withColumnRenamed("f", "fa"), ["a", "b"])
    rows = rows.join(nodes.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("f").alias("fb")), ["b", "c"])
    return B.table(rows.select("a", "b", "c", "n", "fa", "fb", F.monotonically_increasing_id().alias("id")))


def unary_paths(edges: DataFrame) -> DataFrame:
    """The edges with the unary path they lie on: path (the id of its last edge), step (0 at the last, less before
    it) and head (whether it is the first).

    Edges join where all that enters their common node comes from the one and goes on to the other. No path is
    longer than a piece, as every occurrence of its first edge runs through to its last.
    """
    goes = edges.filter(F.col("n") == F.col("fb")).select("id", F.col("b").alias("x"), F.col("c").alias("y"))
    comes = edges.filter(F.col("n") == F.col("fa")).select(F.col("id").alias("next"), F.col("a").alias("x"), F.col("b").alias("y"))
    links = B.table(goes.join(comes, ["x", "y"]).select("id", "next"))
    state = edges.select("id").join(links, "id", "left")
    state = B.table(state.select("id", "next", F.col("next").isNotNull().cast("long").alias("steps"), F.coalesce("next", "id").alias("end")))
    while not state.filter("next is not null").isEmpty():
        far = state.select(F.col("id").alias("next"), F.col("next").alias("_next"), F.col("steps").alias("_steps"), F.col("end").alias("_end"))
        moving = state.filter("next is not null").join(far, "next")
        moved = moving.select("id", F.col("_next").alias("next"), (F.col("steps") + F.col("_steps")).alias("steps"), F.col("_end").alias("end"))
        state = B.table(state.filter("next is null").select(*moved.columns).unionByName(moved))
    placed = state.select("id", F.col("end").alias("path"), (-F.col("steps")).alias("step"))
    after = links.select(F.col("next").alias("id"), F.lit(False).alias("head"))
    return B.table(edges.join(placed, "id").join(after, "id", "left").withColumn("head", F.coalesce("head", F.lit(True))))


def compacted(graph: Graph, paths: DataFrame) -> DataFrame:
    """(lang, phrase, n_words, n): the text of every unary path and its count."""
    spelled = graph.words.select(F.col("a").alias("_w"), "lang", "word")
    last = paths.join(spelled, paths.c == F.col("_w")).select("path", F.col("step").alias("at"), "word")
    heads = paths.filter("head").select("path", "n", "a", "b", F.col("step").alias("at"))
    first = heads.join(spelled, heads.a == F.col("_w")).select("path", "lang", "n", (F.col("at") - 2).alias("at"), "word")
    second = heads.join(spelled, heads.b == F.col("_w")).select("path", (F.col("at") - 1).alias("at"), "word")
    words = last.unionByName(second).unionByName(first.select("path", "at", "word")).groupBy("path").agg(
        F.array_sort(F.collect_list(F.struct("at", "word"))).alias("ws"))
    return words.join(first.select("path", "lang", "n"), "path").select(
        "lang", F.array_join("ws.word", " ").alias("phrase"), F.size("ws").cast("long").alias("n_words"), "n")


def collocations(docs: DataFrame, least: int = LEAST, most: int = MOST, share: int = SHARE, bits: int | None = None) -> DataFrame:
    """The best ``most`` phrases of two and three words of every language.

    docs has lang and text; other columns are ignored. Returns lang, rank, phrase, a, l, r, n, score. A null lang is
    ``und``; null and empty texts have no words; repeated rows count again; an empty table gives no rows. Ties in score
    and count go to the smaller phrase in byte order. Counts up to 10^15 are exact.
    """
    graph = Graph(docs, least, bits)
    edges = unary_paths(heavy_edges(graph, least))
    words = graph.words.select("a", "lang", "word", "f")
    # Nodes inside a unary path are as frequent as the phrase around them; only its ends can have a score.
    inner = edges.filter("not head").select("a", "b")
    ends = edges.filter("head").select("a", "b", "n").unionByName(
        edges.filter("step = 0").select(F.col("b").alias("a"), F.col("c").alias("b"), "n"))
    longer = ends.groupBy("a", "b").agg(F.max("n").alias("longer"))
    pairs = graph.nodes.filter(F.col("f") >= least).join(inner, ["a", "b"], "left_anti").join(longer, ["a", "b"], "left")
    pairs = pairs.filter(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("f")))
    w = lambda key, tag: words.select(F.col("a").alias(key), F.col("f").alias(f"f_{tag}"))
    two = pairs.join(w("a", "a"), "a").join(w("b", "b"), "b").select(
        "a", "b", F.lit(None).cast("long").alias("c"), F.col("f").alias("n"), _cuts("f", ("f_a", "f_b")).alias("cut"))
    three = edges.join(w("a", "a"), "a").join(w("c", "c"), "c").select(
        "a", "b", "c", "n", _cuts("n", ("f_a", "fb"), ("fa", "f_c")).alias("cut"))
    found = two.unionByName(three).select("a", "b", "c", "n", "cut.*")
    named = words.select("a", "lang", F.col("word").alias("w1"))
    found = found.join(named, "a")
    # Strings only for what can still be among the best of its language, ties included.
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("n"))
    found = found.withColumn("_r", F.rank().over(order)).filter(F.col("_r") <= most)
    found = found.join(words.select(F.col("a").alias("b"), F.col("word").alias("w2")), "b")
    found = found.join(words.select(F.col("a").alias("c"), F.col("word").alias("w3")), "c", "left")
    found = found.withColumn("phrase", F.concat_ws(" ", "w1", "w2", "w3"))
    best = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("n"), "phrase")
    found = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= most)
    found = found.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("n").alias("a"), "l", "r", "score")
    return found.join(graph.languages, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _cuts(count: str, *sides: tuple[str, str]):
    """(score, l, r) of the cut with the lowest score, the first one on ties."""
    wide = lambda c: f"cast({c} as decimal(15,0))"
    cuts = [F.struct(F.expr(f"({wide(count)} * {wide(count)} * cast(1000000 as decimal(7,0))) div ({wide(left)} * {wide(right)})").alias("score"),
                     F.lit(i).alias("k"), F.col(left).alias("l"), F.col(right).alias("r")) for i, (left, right) in enumerate(sides)]
    best = F.least(*cuts) if len(cuts) > 1 else cuts[0]
    return F.struct(best["score"].alias("score"), best["l"].alias("l"), best["r"].alias("r"))
