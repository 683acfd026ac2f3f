"""Exact top-k inner products by a dual-tree search over cover trees.

Vectors are filed under the nearest of a bounded set of centers, the top of a cover tree fitted on a sample. A cell is
cut into chunks of bounded size; each chunk becomes one row that holds its vectors and the cover tree over them.
Queries become such rows too. A query block first meets a few chunks that look best, which gives every query a kth
score to beat. Then it meets every chunk of every cell that its bounds leave open, and the two trees are walked
together: a pair of nodes with centers p and q and covering radii P and Q scores at most
``p.q + |p| Q + |q| P + P Q``, and is dropped when that is below the worst kth score of the queries in the node.

Nothing is approximate: bounds carry a margin for rounding, and scores are exact integers.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from sightledger.llm import base as B

CHUNK = 1024         # vectors of a chunk, about
BLOCK = 512          # queries of a block, about
CENTERS = 4096       # cells, at most
SAMPLE = 8192        # vectors that centers are chosen from, at most
LEAF = 64            # vectors of a leaf in a chunk's tree
QUERY_LEAF = 8       # queries of a leaf in a block's tree
GRAIN = 1 << 16      # pairs of vectors that are compared at once rather than by smaller nodes
SHRINK = 0.5         # radius of the next level of a cover tree
FANOUT = 8           # children of a node, at most
PAIRS = 64           # blocks that one copy of a chunk meets, about
FIRST_CHUNKS = 2     # chunks of each of the first cells that a block meets
FIRST_ROWS = 4096    # vectors of the first cells, at least
SCALE = 1024
LONG = (-(1 << 63), (1 << 63) - 1)


def clean(vectors: DataFrame, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(row, vec_id, v): floor(1024 * x) of every component, as doubles that hold whole numbers.

    Rows with a null id or vector, or with a component that is null or not finite (also after the factor), take no
    part. An empty vector scores 0 with any other. Rows are told apart by ``row``, so repeated ids stay apart.
    """
    v = F.transform(F.col(vector), lambda x: x.cast("double") * SCALE)
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_).cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null").filter(ok)
    return B.table(rows.withColumn("row", F.monotonically_increasing_id())).mapInArrow(_floored, "row long, vec_id long, v array<double>")


def _floored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("row", pa.int64()), ("vec_id", pa.int64()), ("v", pa.list_(pa.float64()))])
    for batch in batches:
        v = batch.column("v")
        whole = pa.ListArray.from_arrays(v.offsets, pa.array(np.floor(np.asarray(v.values)) + 0.0))
        yield B.record(schema, batch.column("row"), batch.column("vec_id"), whole)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column; a vector with fewer than ``width`` components goes on with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(column.value_lengths(), np.int64)
    out = np.zeros((len(sizes), width))
    flat = np.asarray(column.flatten(), np.float64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def norms(x: np.ndarray) -> np.ndarray:
    """Euclidean lengths, without overflow."""
    top = np.abs(x).max(axis=-1, initial=0.0)
    unit = np.where(top > 0, top, 1.0)
    return top * np.sqrt(((x / unit[..., None]) ** 2).sum(-1))


@dataclass
class CoverTree:
    """Nodes in pre-order over vectors in tree order: a node owns a run of them."""
    x: np.ndarray
    ids: np.ndarray
    rows: np.ndarray
    first: np.ndarray
    end: np.ndarray
    center: np.ndarray    # index of the vector that is the node's center
    radius: np.ndarray
    norm: np.ndarray      # length of the center
    kids: list            # node numbers, [] for a leaf


def spread_out(x: np.ndarray, most: int, reach: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Centers chosen one by one, each the furthest from those before, until all lie within ``reach``; owner of each row."""
    chosen, own = [0], np.zeros(len(x), np.int64)
    far = norms(x - x[0])
    while len(chosen) < most and far.max() > reach:
        at = int(far.argmax())
        dist = norms(x - x[at])
        own[dist < far] = len(chosen)
        far = np.minimum(far, dist)
        chosen.append(at)
    return np.array(chosen), own


def cover_tree(x: np.ndarray, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF, shrink: float = SHRINK) -> CoverTree:
    """Children of a node halve its radius, or are FANOUT at most; they lie further apart than what they cover."""
    order, first, end, center, radius, kids = [], [], [], [], [], []
    work = [(np.arange(len(x)), -1)] if len(x) else []
    while work:
        members, parent = work.pop()
        me = len(first)
        if parent >= 0:
            kids[parent].append(me)
        first.append(len(order))
        center.append(int(members[0]))
        far = norms(x[members] - x[members[0]])
        radius.append(float(far.max()))
        kids.append([])
        end.append(len(order) + len(members))
        if len(members) <= leaf or radius[me] == 0:
            order.extend(members.tolist())
            continue
        chosen, own = spread_out(x[members], FANOUT, radius[me] * shrink)
        for c in range(len(chosen) - 1, -1, -1):
            part = members[own == c]
            work.append((np.concatenate([members[chosen[c:c + 1]], part[part != members[chosen[c]]]]), me))
    order = np.array(order, np.int64)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    at = place[np.array(center, np.int64)] if len(x) else np.zeros(0, np.int64)
    x = x[order]
    return CoverTree(x, ids[order], rows[order], np.array(first, np.int64), np.array(end, np.int64), at, np.array(radius), norms(x[at]), kids)


def pack(tree: CoverTree) -> bytes:
    """Vectors in the smallest type that holds them; the tree as it is."""
    top = np.abs(tree.x).max(initial=0.0)
    kind = np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.float64
    return pickle.dumps((tree.x.astype(kind), *[getattr(tree, f.name) for f in fields(tree)[1:]]))


def unpack(blob: bytes) -> CoverTree:
    x, *rest = pickle.loads(blob)
    return CoverTree(x.astype(np.float64), *rest)


def dot(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: in doubles while all partial sums fit, else in Python integers."""
    a, b = np.abs(q).max(initial=0.0), np.abs(x).max(initial=0.0)
    if a * b * max(q.shape[1], 1) < 2.0 ** 53:
        return q @ x.T
    whole = np.frompyfunc(int, 1, 1)
    return np.array(whole(q) @ whole(x).T, object)


def search(query: CoverTree, base: CoverTree, k: int, floor: np.ndarray) -> list[tuple[int, int, int]]:
    """(query index, score, vec_id) of the k best vectors of ``base`` that reach the floor, per query; own row excluded."""
    n = len(query.x)
    best: list[list] = [[] for _ in range(n)]      # heaps of (score, -vec_id, place)
    bar = floor.astype(np.float64).copy()           # score that a vector needs to matter
    slack = 1e-9

    def bound(a, b):
        p, q, big, small = query.center[a], base.center[b], query.radius[a], base.radius[b]
        with np.errstate(over="ignore", invalid="ignore"):
            rest = query.norm[a] * small + base.norm[b] * big + big * small
            value = float(query.x[p] @ base.x[q]) + rest
            value += slack * (abs(value) + rest + query.norm[a] * base.norm[b]) + 1e-6
        return value if value == value else np.inf

    def worst(a):
        return bar[query.first[a]:query.end[a]].min()

    def leaves(a, b):
        rows = np.arange(query.first[a], query.end[a])
        some = np.arange(base.first[b], base.end[b])
        scores = dot(query.x[rows], base.x[some])
        whole = scores.dtype != object
        hit = scores >= bar[rows][:, None]
        for r in np.flatnonzero(hit.any(1)):
            i, s = int(rows[r]), scores[r]
            keep = np.flatnonzero(hit[r])
            heap = best[i]
            if whole and len(keep) > 4 * k:
                keep = keep[s[keep] >= np.partition(s[keep], len(keep) - k - 1)[len(keep) - k - 1]]
            for j in keep:
                at = some[j]
                if base.rows[at] == query.rows[i]:
                    continue
                item = (int(s[j]), -int(base.ids[at]), int(at))
                if len(heap) < k:
                    heapq.heappush(heap, item)
                elif item > heap[0]:
                    heapq.heapreplace(heap, item)
            if len(heap) == k:
                bar[i] = max(bar[i], _below(heap[0][0]))

    queue = [(-bound(0, 0), 0, 0)] if n and len(base.x) else []
    while queue:
        upper, a, b = heapq.heappop(queue)
        if -upper < worst(a):
            continue
        up, down = query.kids[a], base.kids[b]
        pairs = (query.end[a] - query.first[a]) * (base.end[b] - base.first[b])
        if not up and not down or pairs <= GRAIN:
            leaves(a, b)
            continue
        # The wider of the two is opened, so bounds shrink as fast as they can.
        if down and (not up or base.radius[b] >= query.radius[a]):
            closer = [(a, c) for c in down]
        else:
            closer = [(c, b) for c in up]
        for c, d in closer:
            value = bound(c, d)
            if value >= worst(c):
                heapq.heappush(queue, (-value, c, d))
    return [(i, item[0], -item[1]) for i, heap in enumerate(best) for item in heap]


def _below(score: int) -> float:
    """A double that is not above a whole number."""
    return float(score) if abs(score) < 1 << 53 else float(score) - abs(float(score)) * 1e-12


def _ordered(score: int) -> str:
    """A text that sorts as the number does: sign and number of digits, then digits (their complements below zero)."""
    digits = str(abs(score))
    if score >= 0:
        return f"1{len(digits):05d}{digits}"
    return f"0{99999 - len(digits):05d}" + "".join(str(9 - int(d)) for d in digits)


class Index:
    """Chunks of vectors with their trees, one row each, in a table of the shared folder."""

    def __init__(self, vectors: DataFrame, k: int):
        self.spark = vectors.sparkSession
        row = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")).first()
        self.total, self.width = row["n"], row["width"] or 0
        if not self.total:
            return
        # Of equal vectors only the k + 1 smallest ids can be among any query's k best, its own row excluded.
        same = W.partitionBy("v").orderBy("vec_id", "row")
        known = B.table(vectors.withColumn("_n", F.row_number().over(same)).filter(F.col("_n") <= k + 1).drop("_n"))
        sample = known.orderBy(F.xxhash64("row", F.lit(7)), "row").limit(SAMPLE).select("v").toArrow()
        x = matrix(sample.column("v"), self.width)
        self.centers = x[spread_out(x, min(CENTERS, -(-self.total // CHUNK)))[0]]
        filed = B.table(self._file(known, self.centers))
        sizes = filed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).collect()  # a row per cell
        self.radius = np.zeros(len(self.centers))
        self.size = np.zeros(len(self.centers), np.int64)
        for r in sizes:
            self.radius[r.cell], self.size[r.cell] = r.radius, r.n
        self.chunks = -(-self.size // CHUNK)
        self.rows = B.table(self._packed(filed, self.chunks, "chunk", LEAF).withColumnRenamed("pack", "base"))

    def _file(self, vectors: DataFrame, cells: np.ndarray) -> DataFrame:
        width = self.width
        schema = pa.schema([("row", pa.int64()), ("vec_id", pa.int64()), ("v", pa.list_(pa.float64())), ("cell", pa.int32()), ("far", pa.float64())])

        def file(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = matrix(batch.column("v"), width)
                own = nearest(x, cells)
                yield B.record(schema, batch.column("row"), batch.column("vec_id"), batch.column("v"), own.astype(np.int32),
                               norms(x - cells[own]))

        return vectors.mapInArrow(file, "row long, vec_id long, v array<double>, cell int, far double")

    def _packed(self, filed: DataFrame, counts: np.ndarray, name: str, leaf: int) -> DataFrame:
        """One row per cell and chunk: its vectors as a pickled cover tree."""
        width = self.width
        schema = pa.schema([("cell", pa.int32()), (name, pa.int32()), ("pack", pa.binary())])

        def packed(table):
            x = matrix(table.column("v"), width)
            tree = cover_tree(x, table.column("vec_id").to_numpy(), table.column("row").to_numpy(), leaf)
            return pa.Table.from_batches([B.record(schema, [table.column("cell")[0]], [table.column(name)[0]], [pack(tree)])])

        of = self.spark.createDataFrame([(int(c), int(n)) for c, n in enumerate(counts)], "cell int, n int")
        placed = filed.join(F.broadcast(of), "cell").withColumn(name, F.pmod(F.xxhash64("row"), F.greatest("n", F.lit(1))).cast("int"))
        return placed.select("cell", name, "row", "vec_id", "v").groupBy("cell", name).applyInArrow(packed, f"cell int, {name} int, pack binary")

    def blocks(self, queries: DataFrame) -> DataFrame:
        """Queries as rows (block, query): blocks of neighbours with their cover trees."""
        few = self.centers[:max(1, -(-queries.count() // BLOCK))]  # the first centers are a coarser cover
        filed = B.table(self._file(queries, few))
        counts = np.zeros(len(few), np.int64)
        for r in filed.groupBy("cell").count().collect():
            counts[r.cell] = -(-r["count"] // BLOCK)
        self.copies = max(1, -(-int(counts.sum()) // PAIRS))
        packed = self._packed(filed, counts, "part", QUERY_LEAF)
        return packed.select((F.col("cell").cast("long") * (1 << 32) + F.col("part")).alias("block"), F.col("pack").alias("query"))

    def _meet(self, blocks: DataFrame, k: int, first: bool) -> DataFrame:
        """Hits (block, place, row, query_id, score, low, order, vec_id) of every block with the chunks it has to look at."""
        cells, radius, size, chunks = self.centers, self.radius, self.size, self.chunks
        pair = pa.schema([("block", pa.int64()), ("cell", pa.int32()), ("chunk", pa.int32())])
        reach = norms(cells)

        def route(batches):
            for batch in batches:
                for block, blob, floor in zip(batch.column("block").to_pylist(), batch.column("query").to_pylist(), batch.column("floor").to_pylist()):
                    tree = unpack(blob)
                    middle, wide, long = tree.x[tree.center[0]], tree.radius[0], tree.norm[0]
                    with np.errstate(over="ignore", invalid="ignore"):
                        rest = long * radius + reach * wide + wide * radius
                        upper = cells @ middle + rest
                        upper = np.nan_to_num(upper + 1e-9 * (np.abs(upper) + rest + long * reach) + 1e-6, nan=np.inf)
                    if first:
                        order = np.argsort(-(cells @ middle), kind="stable")
                        enough = int(np.searchsorted(np.cumsum(size[order]), FIRST_ROWS)) + 1
                        open_, most = order[:enough], FIRST_CHUNKS
                    else:
                        open_, most = np.flatnonzero(upper >= min(floor)), None
                    out = [(int(c), i) for c in open_ for i in range(int(chunks[c] if most is None else min(chunks[c], most)))]
                    yield B.record(pair, [block] * len(out), [c for c, _ in out], [i for _, i in out])

        hit = pa.schema([("block", pa.int64()), ("place", pa.int32()), ("row", pa.int64()), ("query_id", pa.int64()),
                         ("score", pa.int64()), ("low", pa.float64()), ("order", pa.string()), ("vec_id", pa.int64())])

        def look(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    query, base = (unpack(batch.column(c)[i].as_py()) for c in ("query", "base"))
                    found = search(query, base, k, np.array(batch.column("floor")[i].as_py(), np.float64))
                    at = np.array([f[0] for f in found], np.int64)
                    yield B.record(hit, [batch.column("block")[i].as_py()] * len(found), at.astype(np.int32), query.rows[at], query.ids[at],
                                   [max(min(f[1], LONG[1]), LONG[0]) for f in found], [_below(f[1]) for f in found],
                                   [_ordered(f[1]) for f in found], [f[2] for f in found])

        pairs = blocks.mapInArrow(route, "block long, cell int, chunk int")
        # A chunk that all blocks look at goes in several copies, each to its share of the blocks.
        base = self.rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(self.copies - 1))))
        pairs = pairs.withColumn("copy", F.pmod(F.xxhash64("block"), F.lit(self.copies)).cast("int"))
        met = pairs.join(blocks, "block").join(base, ["cell", "chunk", "copy"]).select("block", "query", "floor", "base")
        return met.mapInArrow(look, "block long, place int, row long, query_id long, score long, low double, order string, vec_id long")

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        blocks = B.table(self.blocks(queries).withColumn("floor", F.lit(None).cast("array<double>")))
        spark = self.spark
        schema = pa.schema([("block", pa.int64()), ("query", pa.binary()), ("floor", pa.list_(pa.float64()))])

        def opened(batches):
            for batch in batches:
                for block, blob in zip(batch.column("block").to_pylist(), batch.column("query").to_pylist()):
                    yield B.record(schema, [block], [blob], [[-np.inf] * len(unpack(blob).x)])

        blocks = B.table(blocks.mapInArrow(opened, "block long, query binary, floor array<double>"))
        some = self._meet(blocks, k, True)
        best = W.partitionBy("row").orderBy(F.desc("order"), "vec_id")
        kth = some.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        kth = kth.groupBy("block", "place").agg(F.count(F.lit(1)).alias("n"), F.min("low").alias("kth")).filter(F.col("n") == k)
        bars = kth.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("place", "kth"))).alias("bars"))
        known = blocks.join(bars, "block", "left").withColumn(
            "floor", F.when(F.col("bars").isNull(), F.col("floor")).otherwise(
                F.transform("floor", lambda v, i: F.coalesce(F.try_element_at("bars", i), v))))
        found = self._meet(B.table(known.drop("bars")), k, False)
        return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def nearest(x: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Cell of each row; any cell is right, near ones prune better."""
    unit = max(np.abs(x).max(initial=0.0), np.abs(cells).max(initial=0.0)) or 1.0
    a, c = x / unit, cells / unit
    return ((c ** 2).sum(1)[None] - 2 * a @ c.T).argmin(1)


def top_products(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of every query with all rows but its own.

    Both inputs come from one call of ``clean``. Ties go to the smaller vec_id. A repeated id is a query, and a
    candidate, for each of its rows. Vectors of other lengths meet as if the shorter went on with zeros. Scores are
    ordered by their exact value; one outside 64 bits is returned as the nearest long. No vectors or no queries give
    an empty result.
    """
    index = Index(vectors, k)
    if not index.total or queries.isEmpty():
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return index.search(queries, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
