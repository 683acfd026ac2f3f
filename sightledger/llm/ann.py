"""Nearest neighbours by a hierarchical k-means tree with best-bin-first search.

The tree is fitted on a bounded sample; every vector is then filed under its leaf. A query walks the tree with
a priority queue of branches ordered by a lower bound of their distance and visits leaves in that order. How
many leaves are visited is calibrated: on a bounded set of queries with exact answers the count doubles until
the wanted recall is met. Visits and leaves meet in chunks of bounded size; no group of copies is ever whole
in one task.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sightledger.llm import base as B

SAMPLE = 20_000       # vectors the tree is fitted on, at most
FANOUT = 8
LEAF = 64             # sample vectors of a leaf, about
ROUNDS = 12
CALIBRATION = 200     # queries with exact answers, at most
RECALL = 0.97         # wanted on those
CHUNK = 1024
CLIP = 1e100          # larger parts count as this much where the tree is built and walked, so that no square overflows


@dataclass
class Tree:
    centers: np.ndarray   # (nodes, dims)
    radius: np.ndarray    # largest distance of a sample vector from the node's center
    children: list        # node numbers, [] for a leaf
    leaf_of: np.ndarray   # leaf number of a node, -1 inside
    leaves: int


def clean(vectors: DataFrame, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v as doubles) of the rows that take part: vector not null, not zero, all parts finite; id not null."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.select(F.col(id_).cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null").filter(ok)


def _kmeans(x: np.ndarray, k: int, rng) -> np.ndarray:
    centers = x[rng.choice(len(x), k, replace=False)]
    for _ in range(ROUNDS):
        own = (((centers ** 2).sum(1)[None] - 2 * x @ centers.T)).argmin(1)
        total = np.zeros_like(centers)
        np.add.at(total, own, x)
        count = np.bincount(own, minlength=k)
        centers = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centers)
    return own


def fit(sample: np.ndarray, seed: int = 1) -> Tree:
    """A tree whose nodes split in at most FANOUT parts until LEAF sample vectors are left."""
    rng = np.random.default_rng(seed)
    sample = np.clip(sample, -CLIP, CLIP)
    centers, radius, children, leaf_of, leaves = [], [], [], [], 0
    work = [(sample, -1)]
    while work:
        x, parent = work.pop()
        node = len(centers)
        centers.append(x.mean(0))
        radius.append(float(np.sqrt(((x - centers[-1]) ** 2).sum(1).max())))
        children.append([])
        if parent >= 0:
            children[parent].append(node)
        distinct = len(np.unique(x, axis=0)) if len(x) > LEAF else 1
        if distinct < 2:
            leaf_of.append(leaves)
            leaves += 1
            continue
        leaf_of.append(-1)
        own = _kmeans(np.unique(x, axis=0), min(FANOUT, distinct), rng)
        values, back = np.unique(x, axis=0, return_inverse=True)
        parts = [p for k in range(int(own.max()) + 1) if len(p := x[own[back.ravel()] == k])]
        if len(parts) < 2:
            leaf_of[-1] = leaves
            leaves += 1
            continue
        work += [(p, node) for p in parts]
    return Tree(np.array(centers), np.array(radius), children, np.array(leaf_of), leaves)


def descend(tree: Tree, x: np.ndarray) -> np.ndarray:
    """Leaf of each row: the nearest child at every node."""
    x = np.clip(x, -CLIP, CLIP)
    node = np.zeros(len(x), np.int64)
    open_ = np.arange(len(x))
    while len(open_):
        for n in np.unique(node[open_]):
            kids = tree.children[n]
            if kids:
                rows = open_[node[open_] == n]
                c = tree.centers[kids]
                node[rows] = np.array(kids)[((c ** 2).sum(1)[None] - 2 * x[rows] @ c.T).argmin(1)]
        open_ = open_[tree.leaf_of[node[open_]] < 0]
    return tree.leaf_of[node]


def visits(tree: Tree, q: np.ndarray, count: int) -> list[int]:
    """The first ``count`` leaves in best-bin-first order."""
    distance = np.sqrt(((tree.centers - np.clip(q, -CLIP, CLIP)) ** 2).sum(1))
    queue, out = [(0.0, 0)], []
    while queue and len(out) < count:
        _, node = heapq.heappop(queue)
        if tree.leaf_of[node] >= 0:
            out.append(int(tree.leaf_of[node]))
        for kid in tree.children[node]:
            heapq.heappush(queue, (float(distance[kid] - 0.5 * tree.radius[kid]), kid))
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    width = len(column[0])
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


# A query is its id and a hash of its vector, so rows that share an id keep their own neighbours.
_HIT = pa.schema([("query_id", pa.int64()), ("query_key", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
_HIT_SQL = "query_id long, query_key long, vec_id long, score double"


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distance of each row to q. Where squares leave the range of doubles they are taken of scaled parts."""
    with np.errstate(over="ignore", invalid="ignore"):
        out = np.sqrt(((x - q) ** 2).sum(1))
        odd = np.flatnonzero(~((out > 1e-140) & (out < np.inf)))
        if len(odd):
            half = x[odd] / 2 - q / 2     # cannot overflow; the parts differ by at most twice the largest double
            scale = np.abs(half).max(1)
            tiny = scale < 1e-140
            half[tiny] = (x[odd[tiny]] - q) / 2
            scale[tiny] = np.abs(half[tiny]).max(1)
            part = half / np.where(scale > 0, scale, 1)[:, None]
            out[odd] = np.sqrt((part ** 2).sum(1)) * scale * 2
    return out


def nearest(ids: np.ndarray, x: np.ndarray, query: int, q: np.ndarray, k: int):
    """(ids, distances) of the k nearest rows of other ids, nearest first, ties to smaller ids."""
    others = ids != query
    if not others.all():
        ids, x = ids[others], x[others]
    distance = distances(x, q)
    if len(ids) > 4 * k:
        keep = np.flatnonzero(distance <= np.partition(distance, k - 1)[k - 1])
    else:
        keep = np.arange(len(ids))
    keep = keep[np.lexsort((ids[keep], distance[keep]))][:k]
    return ids[keep], distance[keep]


def _hits(queries, ids, x, k):
    """Columns of _HIT for (id, key, vector) of each query against some rows."""
    out = [[], [], [], []]
    for query, key, q in queries:
        near, far = nearest(ids, x, query, q, k)
        out[0] += [query] * len(near)
        out[1] += [key] * len(near)
        out[2] += near.tolist()
        out[3] += far.tolist()
    return B.record(_HIT, *out)


def _search(k):
    def run(left, right):
        """One chunk of a leaf and the queries that visit it."""
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_batches([], schema=_HIT)
        asked = zip(right.column("query_id").to_pylist(), right.column("query_key").to_pylist(), _matrix(right.column("q")))
        return pa.Table.from_batches([_hits(asked, left.column("vec_id").to_numpy(), _matrix(left.column("v")), k)])

    return run


def _top(hits: DataFrame, k: int) -> DataFrame:
    """The k best of each query. A query has at most k hits per chunk, merged in two steps."""
    def best(rows):
        order = np.lexsort((rows.column("vec_id").to_numpy(), rows.column("score").to_numpy()))[:k]
        return rows.take(pa.array(order)).select(_HIT.names)

    some = hits.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(16)))
    some = some.groupBy("query_id", "query_key", "part").applyInArrow(best, _HIT_SQL)
    return some.groupBy("query_id", "query_key").applyInArrow(best, _HIT_SQL)


def _exact(index: DataFrame, queries: list, k: int) -> dict:
    """Exact answers of a bounded list of queries: every task compares its vectors with all of them."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield _hits(queries, batch.column("vec_id").to_numpy(), _matrix(batch.column("v")), k)

    found: dict = {}
    for r in _top(index.select("vec_id", "v").mapInArrow(run, _HIT_SQL), k).collect():
        found.setdefault((r.query_id, r.query_key), []).append(r.score)
    return found


class Index:
    """Vectors (a table, at least one row, all of one length) filed under the leaves of a tree."""

    def __init__(self, vectors: DataFrame, sample: int = SAMPLE):
        self.spark = vectors.sparkSession
        known = vectors
        # The tree sees at most ``sample`` vectors, chosen by hash; every vector is filed.
        rows = known.orderBy(F.xxhash64("vec_id", F.lit(5)), "vec_id").limit(sample).select("v").collect()
        self.tree = tree = fit(np.array([r.v for r in rows], np.float64))
        schema = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.float64())), ("leaf", pa.int32())])

        def file(batches):
            for batch in batches:
                if batch.num_rows:
                    yield B.record(schema, batch.column("vec_id"), batch.column("v"),
                                   descend(tree, _matrix(batch.column("v"))).astype(np.int32))

        filed = B.table(known.mapInArrow(file, "vec_id long, v array<double>, leaf int"))
        sizes = filed.groupBy("leaf").count().withColumn("chunks", F.ceil(F.col("count") / CHUNK).cast("int"))
        # One row per leaf: the tree's size is bounded by the sample.
        self.chunks = {r.leaf: r.chunks for r in sizes.collect()}
        spread = self.spark.createDataFrame(sorted(self.chunks.items()), "leaf int, chunks int")
        self.rows = filed.join(F.broadcast(spread), "leaf").withColumn("chunk", F.pmod(F.xxhash64("vec_id"), "chunks").cast("int"))

    def search(self, queries: DataFrame, k: int, leaves: int) -> DataFrame:
        tree, chunks = self.tree, self.chunks
        schema = pa.schema([("query_id", pa.int64()), ("query_key", pa.int64()), ("q", pa.list_(pa.float64())), ("leaf", pa.int32()), ("chunk", pa.int32())])

        def route(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                rows, leaf, chunk = [], [], []
                for i, q in enumerate(_matrix(batch.column("v"))):
                    for at in visits(tree, q, leaves):
                        n = chunks.get(at, 0)
                        rows += [i] * n
                        leaf += [at] * n
                        chunk += range(n)
                    if len(rows) > 5_000:
                        take = pa.array(rows)
                        yield B.record(schema, *(batch.column(n).take(take) for n in ("vec_id", "query_key", "v")), leaf, chunk)
                        rows, leaf, chunk = [], [], []
                take = pa.array(rows, pa.int64())
                yield B.record(schema, *(batch.column(n).take(take) for n in ("vec_id", "query_key", "v")), leaf, chunk)

        asked = queries.select("vec_id", "query_key", "v").mapInArrow(route, "query_id long, query_key long, q array<double>, leaf int, chunk int")
        hits = self.rows.select("leaf", "chunk", "vec_id", "v").groupBy("leaf", "chunk").cogroup(
            asked.groupBy("leaf", "chunk")).applyInArrow(_search(k), _HIT_SQL)
        return _top(hits, k)

    def calibrate(self, queries: DataFrame, k: int, recall: float = RECALL, most: int = CALIBRATION) -> int:
        """Leaves to visit so that a bounded set of queries finds ``recall`` of its exact neighbours."""
        rows = queries.orderBy(F.xxhash64("vec_id", F.lit(6)), "vec_id", "query_key").limit(most).select("vec_id", "query_key", "v").collect()
        asked = [(r.vec_id, r.query_key, np.array(r.v)) for r in rows]
        truth = _exact(self.rows, asked, k)
        some = self.spark.createDataFrame([(q, key, v.tolist()) for q, key, v in asked], "vec_id long, query_key long, v array<double>")
        leaves = 1 if not asked else max(1, self.tree.leaves // 64)
        while asked and leaves < self.tree.leaves:
            # A neighbour counts if it is as near as the k-th exact one, so copies are interchangeable.
            found = [r for r in self.search(some, k, leaves).collect() if r.score <= max(truth[r.query_id, r.query_key])]
            if len(found) >= recall * sum(len(scores) for scores in truth.values()):
                break
            leaves = min(2 * leaves, self.tree.leaves)
        return leaves


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest vectors found for every query, its own row excluded.

    Both inputs have vec_id and v (see ``clean``). Score is the Euclidean distance in double precision; ties go
    to the smaller vec_id. Copies of a vector are neighbours at distance 0; rows that repeat a vec_id count as
    one vector each but never answer a query of that id. Queries that share an id and differ in their vector are
    answered each on its own (ranks from 1 for each); equal ones are one query. A distance beyond the largest
    double is infinite and still counts. Vectors of another length than the most frequent one (the smaller, if two
    are) have no distance and take no part. No vectors or no queries give an empty result.
    """
    spark = vectors.sparkSession
    vectors = B.table(vectors.select("vec_id", "v"))
    width = vectors.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    queries = queries if width is None else queries.filter(F.size("v") == width.n)
    if width is None or queries.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = Index(vectors.filter(F.size("v") == width.n))
    queries = B.table(queries.select("vec_id", F.xxhash64("v").alias("query_key"), "v").dropDuplicates(["vec_id", "query_key"]))
    found = index.search(queries, k, index.calibrate(queries, k, recall))

    def number(rows):
        order = np.lexsort((rows.column("vec_id").to_numpy(), rows.column("score").to_numpy()))
        rows = rows.take(pa.array(order))
        return pa.table({"query_id": rows.column("query_id"), "rank": pa.array(np.arange(1, rows.num_rows + 1), pa.int32()),
                         "vec_id": rows.column("vec_id"), "score": rows.column("score")})

    return found.groupBy("query_id", "query_key").applyInArrow(number, "query_id long, rank int, vec_id long, score double")
