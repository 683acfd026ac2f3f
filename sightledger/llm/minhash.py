"""MinHash near-dedup: universal hash minima, banding, exact confirmation, connected components.

1. Every text becomes its set of word shingles, ``BANDS * ROWS`` minima and one key per band. Texts with
   the same set form one class; only class representatives go on.
2. A band key held by several representatives is a bucket. Every member meets the smallest one (a star,
   so a bucket costs as many pairs as it has members), and the full sets decide.
3. Buckets that still hold several components bring their full sets together in chunk pairs of bounded
   size. All links between components are found by counting there, but only a spanning forest leaves.
4. Components come from alternating large-star and small-star rounds.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sightledger.llm import base as B

SHINGLE = 5
SIMILARITY = 85   # percent
BANDS, ROWS = 40, 8  # a pair at 0.85 shares no band with probability 3e-6
MISS, MOST_BANDS = 3.1e-6, 64
CHUNK = 256
ID_BITS = 25      # bits of the filter on document ids

_VALUES = B.byte_values(303, lower=True)
_FN = np.random.default_rng(404).integers(1, 1 << 31, (BANDS * ROWS, 2), dtype=np.uint32)


def bands_for(percent: int) -> tuple[int, int]:
    """Bands and rows that miss a pair exactly at the threshold with probability MISS at most: 40 of 8 at 85, 54 of 7 at 80.

    Of the shapes with at most MOST_BANDS bands, the one with the longest bands, so few other pairs meet.
    """
    for rows in range(ROWS, 0, -1):
        hit = min((percent / 100) ** rows, 1 - 1e-9)
        bands = max(1, math.ceil(math.log(MISS) / math.log1p(-hit))) if hit > 0 else MOST_BANDS
        if bands <= MOST_BANDS or rows == 1:
            return max(bands, BANDS), rows


def _functions(n):
    return _FN if n == len(_FN) else np.random.default_rng(404).integers(1, 1 << 31, (n, 2), dtype=np.uint32)


def shingle_sets(data, offsets, k=SHINGLE):
    """Sorted distinct shingle hashes of all rows, one after another, and the start of each row's."""
    starts, ends, first = B.spans(data, offsets)
    h = B.piece_hashes(data, starts, ends, _VALUES, B.WORD_BASE)
    n_words = np.diff(first)
    rows, counts = B.rows_of_grams(first, k)
    parts, owner = [B.grams(h, k)[rows]], [np.repeat(np.arange(len(counts)), counts)]
    for short in range(1, k):
        at = np.flatnonzero(n_words == short)
        if len(at):
            parts.append(B.grams(h, short)[first[:-1][at]] ^ np.uint64(short))
            owner.append(at)
            counts[at] = 1
    h, owner = np.concatenate(parts), np.concatenate(owner)
    if len(parts) > 1:
        order = np.argsort(owner, kind="stable")
        h, owner = h[order], owner[order]
    edge = np.append(0, np.cumsum(counts))
    for a, b in zip(edge[:-1], edge[1:]):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[edge[:-1][counts > 0]] = True
    sizes = np.bincount(owner[new], minlength=len(counts))
    return h[new], np.append(0, np.cumsum(sizes))


def minima(sets, edge, functions=_FN):
    """One minimum per row and universal hash function; rows without shingles are left at the top value."""
    x = (sets >> np.uint64(32)).astype(np.uint32)
    out = np.full((len(functions), len(edge) - 1), np.uint32(0xFFFFFFFF))
    full = np.flatnonzero(np.diff(edge))
    if len(full):
        at = edge[:-1][full]
        for j, (a, b) in enumerate(functions):
            out[j, full] = np.minimum.reduceat(x * np.uint32(a * 2 + 1) + np.uint32(b), at)
    return out


_SIG = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()),
                  ("keys", pa.list_(pa.int64()))])
_SIG_SQL = "doc_id long, n_shingles long, s1 long, s2 long, keys array<long>"


def _signatures(k, percent):
    bands, width = bands_for(percent)
    functions = _functions(bands * width)

    def run(batches):
        weights = B.byte_values(505)[:width]
        for part, data, offsets in B.blocks(batches):
            sets, edge = shingle_sets(data, offsets, k)
            sizes = np.diff(edge)
            full = np.flatnonzero(sizes)
            sums = np.zeros((2, len(sizes)), np.uint64)
            if len(full):
                sums[0, full] = np.add.reduceat(B.mix(sets), edge[:-1][full])
                sums[1, full] = np.bitwise_xor.reduceat(B.mix(sets + np.uint64(77)), edge[:-1][full])
            low = minima(sets, edge, functions).astype(np.uint64).reshape(bands, width, -1)
            keys = B.mix((low * weights[None, :, None]).sum(1, dtype=np.uint64)
                         + np.arange(1, bands + 1, dtype=np.uint64)[:, None] * np.uint64(B.GRAM_BASE))
            held = np.append(0, np.cumsum(np.where(sizes > 0, bands, 0))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(held), pa.array(keys[:, full].T.ravel().view(np.int64)))
            yield B.record(_SIG, part.column(part.schema.get_field_index("doc_id")).cast(pa.int64()),
                           sizes, sums[0].view(np.int64), sums[1].view(np.int64), lists)

    return run


def id_filter(ids: DataFrame) -> bytes:
    """Bitmap of the ids' hashes: 2^ID_BITS bits whatever their number; false hits only cost work."""
    schema = pa.schema([("part", pa.int64()), ("bits", pa.binary())])

    def pack(rows):
        flags = np.zeros(1 << 15, bool)
        flags[rows.column("pos").to_numpy() & 0x7FFF] = True
        return pa.Table.from_batches([B.record(schema, [rows.column("part")[0].as_py()], [np.packbits(flags).tobytes()])])

    pos = ids.select(_place("id").alias("pos")).distinct()
    parts = pos.withColumn("part", F.shiftright("pos", 15)).groupBy("part").applyInArrow(pack, "part long, bits binary")
    out = bytearray((1 << ID_BITS) // 8)
    for row in parts.toLocalIterator():
        out[row.part * 4096:(row.part + 1) * 4096] = row.bits
    return bytes(out)


def _place(column):
    return F.pmod(F.xxhash64(column), F.lit(1 << ID_BITS))


def sets_of(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(id, shingles) of the documents in ``ids``, computed again from their texts."""
    sent = docs.sparkSession.sparkContext.broadcast(id_filter(ids))
    schema = pa.schema([("id", pa.int64()), ("shingles", pa.binary())])

    def run(batches):
        bitmap = np.frombuffer(sent.value, np.uint8)
        for batch in batches:
            pos = batch.column("pos").to_numpy(zero_copy_only=False)
            hit = (bitmap[pos >> 3] >> (7 - (pos & 7)).astype(np.uint8)) & 1
            for part, data, offsets in B.blocks([batch.filter(pa.array(hit.astype(bool)))]):
                sets, edge = shingle_sets(data, offsets, k)
                yield B.record(schema, part.column("doc_id").cast(pa.int64()),
                               [sets[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:])])

    known = docs.filter("doc_id is not null").select("doc_id", "text", _place("doc_id").alias("pos"))
    return known.mapInArrow(run, "id long, shingles binary").join(ids, "id", "left_semi")


def _confirm(percent):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]))
                same = int((both[1:] == both[:-1]).sum())
                keep.append(100 * same >= percent * (len(x) + len(y) - same))
            keep = pa.array(keep, pa.bool_())
            yield B.record(schema, batch.column("a").filter(keep), batch.column("b").filter(keep))

    return run


def _meet(percent):
    """Members of one chunk pair: links between components, reduced to a spanning forest."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(rows):
        ids, comp = rows.column("id").to_numpy(), rows.column("component").to_numpy().copy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("shingles")]
        sizes = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets)), sizes)
        _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = count[column] > 1
        owner, column = owner[shared], column[shared]
        rank = np.cumsum(count > 1) - 1
        column = rank[column]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        same = np.zeros((len(sets), len(sets)), np.float32)
        for low in range(0, int(rank[-1]) + 1, 2048):
            a, b = np.searchsorted(column, [low, low + 2048])
            grid = np.zeros((len(sets), 2048), np.float32)
            grid[owner[a:b], column[a:b] - low] = 1
            same += grid @ grid.T
        same = same.astype(np.int64)
        linked = 100 * same >= percent * (sizes[:, None] + sizes[None, :] - same)
        out = []
        for i in range(len(ids)):
            for j in np.flatnonzero(linked[i] & (comp != comp[i])):
                if comp[j] != comp[i]:
                    out.append((ids[i], ids[j]))
                    comp[comp == comp[j]] = comp[i]
        return pa.Table.from_batches([B.record(schema, [x for x, _ in out], [y for _, y in out])])

    return run


def components(edges: DataFrame) -> DataFrame:
    """(id, component): smallest id reachable, by alternating large-star and small-star until nothing moves."""
    e = B.table(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        e = B.table(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return e.select(F.col("u").alias("id"), F.col("v").alias("component"))
        state = now


def near_duplicates(docs: DataFrame, percent: int = SIMILARITY, k: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (columns doc_id, text; others are ignored).

    Words are lower-cased (A-Z); fewer than ``k`` words make one shingle; null and empty texts have an empty
    set and are linked with nothing. Rows that share a doc_id count as one document. A row without doc_id
    takes no part: its component_id is null and it is kept. An empty table gives none.
    """
    docs = docs.select("doc_id", "text")
    signed = B.table(docs.mapInArrow(_signatures(k, percent), _SIG_SQL))
    shape = ["n_shingles", "s1", "s2"]
    linked = signed.filter("n_shingles > 0 and doc_id is not null")
    classes = B.table(linked.groupBy(*shape).agg(F.min("doc_id").alias("class_id")))
    heads = linked.join(classes.select(F.col("class_id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    bands = B.table(heads.select(F.col("doc_id").alias("id"), F.explode("keys").alias("key")))
    buckets = bands.groupBy("key").agg(F.min("id").alias("center"), F.count("*").alias("members")).filter("members > 1")
    held = B.table(bands.join(buckets, "key").filter("center <> id or members > 2"))

    pairs = held.filter("center <> id").select("center", "id").distinct()
    ids = pairs.select("id").unionByName(pairs.select(F.col("center").alias("id"))).distinct()
    ids = B.table(ids)
    sets = B.table(sets_of(docs, ids, k))
    star = pairs.join(sets.select("id", F.col("shingles").alias("y")), "id").join(
        sets.select(F.col("id").alias("center"), F.col("shingles").alias("x")), "center")
    star = star.select(F.col("center").alias("a"), F.col("id").alias("b"), "x", "y")
    links = B.table(star.mapInArrow(_confirm(percent), "a long, b long"))
    found = components(links)

    crowd = held.filter("members > 2").select("key", "id").distinct().join(found, "id", "left").withColumn(
        "component", F.coalesce("component", "id"))
    open_ = crowd.groupBy("key").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size"),
        F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("who")).filter("low <> high")
    open_ = open_.groupBy("who", "size").agg(F.min("key").alias("key")).withColumn("chunks", F.ceil(F.col("size") / CHUNK))
    place = crowd.join(open_.select("key", "chunks"), "key").withColumn("own", F.pmod(F.xxhash64("id"), "chunks"))
    place = place.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    place = place.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "component")
    more = place.join(sets, "id").groupBy("key", "i", "j").applyInArrow(_meet(percent), "a long, b long")
    more = B.table(more)
    # A document given twice with different texts links its classes.
    member = linked.join(classes, shape).select("doc_id", "class_id")
    twice = member.groupBy("doc_id").agg(F.min("class_id").alias("a"), F.max("class_id").alias("b")).filter("a <> b")
    twice = member.join(twice.select("doc_id", "a"), "doc_id").select("a", F.col("class_id").alias("b"))
    final = components(links.unionByName(more).unionByName(twice))

    out = signed.join(classes, shape, "left").join(final.withColumnRenamed("id", "class_id"), "class_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "class_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, percent: int = SIMILARITY, k: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group the row with the smallest doc_id, all columns.

    Rows that share a doc_id are one document and one of them stays; rows without doc_id stay.
    """
    near = near_duplicates(docs, percent, k).filter("doc_id is not null")
    twice = near.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("kept").alias("kept"))
    # Only rows that a bitmap of fixed size marks are joined; most texts never move.
    changed = B.table(twice.filter("n > 1 or not kept").select(F.col("doc_id").alias("id"), "kept"))
    sent = docs.sparkSession.sparkContext.broadcast(id_filter(changed))
    names, schema = docs.columns, docs.schema

    def marked(wanted):
        def run(batches):
            bitmap = np.frombuffer(sent.value, np.uint8)
            for batch in batches:
                pos = batch.column("__pos").fill_null(-1).to_numpy()
                hit = ((bitmap[pos >> 3] >> (7 - (pos & 7)).astype(np.uint8)) & 1 == 1) & (pos >= 0)
                yield batch.filter(pa.array(hit == wanted)).select(names)

        return placed.mapInArrow(run, schema)

    where = F.when(F.col("doc_id").isNotNull(), _place("doc_id"))
    placed = docs.select(*[F.col(f"`{c}`") for c in names], where.alias("__pos"))
    maybe = marked(True).join(changed.select(F.col("id").alias("doc_id"), F.col("kept").alias("__kept")), "doc_id", "left")
    maybe = maybe.filter("__kept is null or __kept").select(*[F.col(f"`{c}`") for c in names]).dropDuplicates(["doc_id"])
    return marked(False).unionByName(maybe)
