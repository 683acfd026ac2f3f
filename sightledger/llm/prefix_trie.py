"""Z-fast trie of conversations: compacted nodes hashed at their two-fattest depth.

A conversation is the list of digests of its prefixes, so equal prefixes are equal digests. The trie is a table of
compacted nodes: the extent (digest and depth), the parent, and the prefix digests along the edge between them. The
handle of a node is the prefix at the two-fattest depth of its edge, the depth that more factors of two divide than
any other.

A batch of conversations is inserted at once. Each finds its exit node by a fat binary search: one look-up of a
handle halves the depths that are left, so ``log2(turns)`` joins settle any conversation. Edges that it leaves half-way
are split; what is new below one exit and one next turn becomes a small sub-trie in one group. Batches are taken by
hash and grow by a factor, from a first one of bounded size; a prefix that many conversations share is thus in the
trie before most of them come, and the groups stay small.

Sums over subtrees are taken on compacted nodes by doubling: after k rounds a node holds its descendants nearer than
2^k, and adds those that its 2^k-th descendants hold. At the end edges are expanded to one row per turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sightledger.llm import base as B

FIRST_BATCH = 4096   # distinct conversations of the first batch, about
GROWTH = 16          # each batch may be so many times the one before
JOINED_IDS = 4096    # ids of one row on the way to the digest of a node's ends
ROOT = bytes(16)
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()

_NODE_SQL = "digest binary, depth int, parent binary, parent_depth int, edge array<binary>, chars array<long>"
_NODE = pa.schema([("digest", pa.binary()), ("depth", pa.int32()), ("parent", pa.binary()), ("parent_depth", pa.int32()),
                   ("edge", pa.list_(pa.binary())), ("chars", pa.list_(pa.int64()))])


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): one row per conversation; a turn is (turn, digest of role and text, code points of the text).

    Turns are ordered by number, null first; equal numbers by digest. Rows without conv_id take no part.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").isNotNull().alias("numbered"), F.col("turn").alias("turn"), F.unhex(digest).alias("digest"),
                 F.char_length(text).cast("long").alias("chars")).alias("t"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))


def rebuilt(conversations: DataFrame, block: int = 100, most: int = 6) -> DataFrame:
    """(conv_id, turns) of every conversation c after its first h turns were replaced by those of c - c % block.

    h is crc32 of the decimal id, modulo ``most``. A conversation shorter than h, or whose leader is absent or short,
    gets what there is.
    """
    turns = B.table(turns_of(conversations))
    leader = F.col("conv_id") - F.col("conv_id") % block
    heads = turns.filter(F.col("conv_id") == leader).select(
        F.col("conv_id").alias("leader"), F.slice("turns", 1, most - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    head = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), F.col("h"))
    mixed = F.concat(head, F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1))))
    return (turns.withColumn("h", h).withColumn("leader", leader).join(heads, "leader", "left")
            .select("conv_id", mixed.alias("turns")))


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of every prefix of a conversation: each one hashes the one before and the next turn."""
    schema = pa.schema([("conv_id", pa.int64()), ("digest", pa.binary()), ("path", pa.list_(pa.binary())),
                        ("chars", pa.list_(pa.int64()))])
    for batch in batches:
        paths = []
        for turns in batch.column("digests").to_pylist():
            now, path = ROOT, []
            for d in turns:
                now = hashlib.md5(now + d).digest()
                path.append(now)
            paths.append(path)
        yield B.record(schema, batch.column("conv_id"), [p[-1] if p else ROOT for p in paths], paths, batch.column("chars"))


def paths_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, digest, path, chars): the digest of every prefix, the last one again, the turns' code points.

    A conversation's row holds 24 bytes a turn; texts are not in it.
    """
    rows = conversations.select("conv_id", F.col("turns.digest").alias("digests"), F.col("turns.chars").alias("chars"))
    return rows.mapInArrow(_paths, "conv_id long, digest binary, path array<binary>, chars array<long>")


def two_fattest(a: Column, b: Column) -> Column:
    """The number in (a, b] that the largest power of two divides: b without its bits below the first one not in a."""
    a, b = a.cast("long"), b.cast("long")
    unit = F.pow(F.lit(2.0), F.length(F.bin(a.bitwiseXOR(b))) - 1).cast("long")
    return (b - b % unit).cast("int")


def _handle() -> Column:
    return F.element_at("edge", two_fattest(F.col("parent_depth"), F.col("depth")) - F.col("parent_depth"))


def locate(conversations: DataFrame, trie: DataFrame, longest: int) -> DataFrame:
    """The exit of every conversation, by fat binary search over the handles.

    Adds ``at`` (depth of the longest prefix that the trie has) and ``exit`` (the node whose edge it leaves half-way
    or ends on; null if it leaves at a node).
    """
    handles = trie.filter("depth > 0").select(
        _handle().alias("_probe"), F.col("digest").alias("_node"), F.col("depth").alias("_depth"),
        F.col("parent_depth").alias("_above"))
    q = conversations.withColumns({"_l": F.lit(0), "_r": F.size("path")})
    for _ in range(max(longest, 1).bit_length() + 1):
        # Conversations that are settled look for themselves: nothing there, no common key.
        live = F.col("_l") < F.col("_r")
        f = two_fattest(F.col("_l"), F.col("_r"))
        q = q.withColumn("_f", F.when(live, f)).withColumn(
            "_probe", F.when(live, F.element_at("path", F.greatest(F.col("_f"), F.lit(1)))).otherwise(
                F.concat(F.col("digest"), F.lit(b"."))))
        q = q.join(handles, "_probe", "left")
        hit = F.col("_node").isNotNull()
        whole = hit & (F.col("_depth") <= F.size("path")) & (
            F.element_at("path", F.least(F.col("_depth"), F.greatest(F.size("path"), F.lit(1)))) == F.col("_node"))
        whole = F.coalesce(whole, F.lit(False))
        q = q.withColumns({
            # A node hit but not whole is the exit: its parent is the last whole one.
            "_l": F.when(whole, F.col("_depth")).when(hit, F.col("_above")).otherwise(F.col("_l")),
            "_r": F.when(hit & ~whole, F.col("_above")).when(~hit & live, F.col("_f") - 1).otherwise(F.col("_r")),
        }).drop("_node", "_depth", "_above", "_f", "_probe")
        q = q.withColumn("_r", F.greatest("_l", "_r"))
    # The child below the last whole node whose edge begins with the next turn.
    edges = trie.filter("depth > 0")
    begins = edges.select(F.element_at("edge", 1).alias("_next"), F.col("parent_depth").alias("_p"),
                          F.col("digest").alias("_node"), F.col("depth").alias("_e"), F.col("edge").alias("_edge"))
    more = F.size("path") > F.col("_l")
    q = q.withColumn("_next", F.when(more, F.element_at("path", F.least(F.col("_l") + 1, F.size("path")))).otherwise(
        F.concat(F.col("digest"), F.lit(b"."))))
    q = q.join(begins, "_next", "left")
    # A prefix has one digest, so the turns in common are those digests that both lists hold.
    common = F.size(F.array_intersect(F.slice("path", F.col("_p") + 1, F.size("_edge")), F.col("_edge")))
    at = F.when(F.col("_node").isNotNull(), F.col("_p") + common).otherwise(F.col("_l"))
    return q.withColumn("at", at.cast("int")).withColumn(
        "exit", F.when(F.col("at") < F.col("_e"), F.col("_node"))).drop("_l", "_r", "_next", "_p", "_node", "_e", "_edge")


def _sub_trie(table: pa.Table) -> pa.Table:
    """Compacted nodes of conversations that leave the trie at one depth with one next turn."""
    at = table.column("at")[0].as_py()
    rows = sorted(zip(table.column("path").to_pylist(), table.column("chars").to_pylist()), key=lambda r: r[0])
    paths = [p for p, _ in rows]

    def common(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    nodes = {}  # digest -> (row, depth): explicit are the ends, and where neighbours in order part
    for i, p in enumerate(paths):
        nodes[p[-1]] = (i, len(p))
        if i and (n := common(paths[i - 1], p)) > at:
            nodes.setdefault(p[n - 1], (i, n))
    out = [[], [], [], [], [], []]
    for digest, (i, depth) in nodes.items():
        path, chars = rows[i]
        up = next((d for d in range(depth - 1, at, -1) if path[d - 1] in nodes), at)
        for column, value in zip(out, (digest, depth, path[up - 1] if up else ROOT, up, path[up:depth], chars[up:depth])):
            column.append(value)
    return pa.Table.from_batches([B.record(_NODE, *out)])


def _split(trie: DataFrame, cuts: DataFrame) -> DataFrame:
    """The trie with a node at each cut (exit, at). A node's cuts are at most the turns of its edge."""
    by_node = cuts.groupBy(F.col("exit").alias("digest")).agg(F.collect_set("at").alias("_cuts"))
    ends = F.array_sort(F.concat(F.coalesce("_cuts", F.array().cast("array<int>")), F.array("depth")))
    rows = trie.join(by_node, "digest", "left").withColumn("_ends", ends)
    pieces = rows.select("*", F.posexplode("_ends").alias("_i", "_end"))
    start = F.when(F.col("_i") > 0, F.element_at("_ends", F.greatest(F.col("_i"), F.lit(1)))).otherwise(F.col("parent_depth"))
    pieces = pieces.withColumn("_start", start)
    first, n = F.col("_start") - F.col("parent_depth") + 1, F.col("_end") - F.col("_start")
    return pieces.select(
        F.when(F.col("_end") == F.col("depth"), F.col("digest")).otherwise(
            F.element_at("edge", F.greatest(F.col("_end") - F.col("parent_depth"), F.lit(1)))).alias("digest"),
        F.col("_end").alias("depth"),
        F.when(F.col("_i") == 0, F.col("parent")).otherwise(F.element_at("edge", F.greatest(first - 1, F.lit(1)))).alias("parent"),
        F.col("_start").alias("parent_depth"),
        F.slice("edge", first, n).alias("edge"), F.slice("chars", first, n).alias("chars"))


def insert(trie: DataFrame, batch: DataFrame, longest: int) -> DataFrame:
    """The trie after a batch of distinct conversations (digest, path, chars)."""
    found = B.table(locate(batch, trie, longest))
    cuts = found.filter("exit is not null").select("exit", "at").distinct()
    fresh = found.filter(F.size("path") > F.col("at")).withColumn("_next", F.element_at("path", F.col("at") + 1))
    grown = fresh.groupBy("_next").applyInArrow(_sub_trie, _NODE_SQL)
    return B.table(_split(trie, cuts).unionByName(grown))


def build(distinct: DataFrame, first: int = FIRST_BATCH, growth: int = GROWTH) -> DataFrame:
    """Compacted trie of distinct conversations (digest, path, chars); the root is a row of depth 0 without an edge."""
    spark = distinct.sparkSession
    row = distinct.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("path")).alias("longest")).first()
    total, longest = row["n"], row["longest"] or 0
    root = spark.createDataFrame([(bytearray(ROOT), 0, None, -1, [], [])], _NODE_SQL)
    trie = B.table(root)
    place = F.pmod(F.xxhash64("digest"), F.lit(1 << 32)) / float(1 << 32)
    done, size = 0.0, float(first)
    while done < 1 and total:
        upto = min(1.0, done + size / total)
        trie = insert(trie, distinct.filter((place >= done) & (place < upto)), longest)
        done, size = upto, size * growth
    return trie


def _ends(members: DataFrame) -> DataFrame:
    """(digest, n_ends, conv_id, ends_sha256): conversations that end at a node.

    Ids are sorted by Spark over all tasks and joined to texts of some thousand ids each; those of one node pass one
    task in order, in constant memory, as the digest of a list demands.
    """
    def join(batches):
        schema = pa.schema([("digest", pa.binary()), ("first", pa.int64()), ("n", pa.int64()), ("ids", pa.string())])
        now, ids = None, []
        for batch in batches:
            for digest, conv in zip(batch.column("digest").to_pylist(), batch.column("conv_id").to_pylist()):
                if ids and (digest != now or len(ids) >= JOINED_IDS):
                    yield B.record(schema, [now], [ids[0]], [len(ids)], [",".join(map(str, ids))])
                    ids = []
                now = digest
                ids.append(conv)
        if ids:
            yield B.record(schema, [now], [ids[0]], [len(ids)], [",".join(map(str, ids))])

    def digest(batches):
        schema = pa.schema([("digest", pa.binary()), ("n_ends", pa.int64()), ("conv_id", pa.int64()), ("ends_sha256", pa.string())])
        now, sha, n, least = None, None, 0, None
        for batch in batches:
            out = [[], [], [], []]
            for key, first, count, ids in zip(*(batch.column(c).to_pylist() for c in ("digest", "first", "n", "ids"))):
                if key != now:
                    if now is not None:
                        for column, value in zip(out, (now, n, least, sha.hexdigest())):
                            column.append(value)
                    now, sha, n, least = key, hashlib.sha256(), 0, first
                else:
                    sha.update(b",")
                sha.update(ids.encode())
                n += count
            yield B.record(schema, *out)
        if now is not None:
            yield B.record(schema, [now], [n], [least], [sha.hexdigest()])

    parts = B.partitions_for(members.sparkSession)
    joined = (members.select("digest", "conv_id").repartitionByRange(parts, "digest", "conv_id")
              .sortWithinPartitions("digest", "conv_id")
              .mapInArrow(join, "digest binary, first long, n long, ids string"))
    return (joined.repartition(parts, "digest").sortWithinPartitions("digest", "first")
            .mapInArrow(digest, "digest binary, n_ends long, conv_id long, ends_sha256 string"))


def _pointers(trie: DataFrame) -> tuple[DataFrame, int]:
    """Every node with its ancestors at distances 1, 2, 4, ...: columns up0, up1, ... (null above the root)."""
    nodes, k = B.table(trie.withColumn("up0", F.col("parent"))), 0
    while True:
        here = f"up{k}"
        # Ancestors of the root are null, so its children, which may be most nodes, need no look-up.
        inner = (F.col(here) != F.lit(ROOT))
        more = nodes.filter(inner)
        if more.isEmpty():
            return nodes, k + 1
        far = nodes.filter(F.col("digest") != F.lit(ROOT)).select(F.col("digest").alias(here), F.col(here).alias(f"up{k + 1}"))
        rest = nodes.filter(~F.coalesce(inner, F.lit(False))).withColumn(f"up{k + 1}", F.lit(None).cast("binary"))
        nodes = B.table(more.join(far, here, "left").select(*rest.columns).unionByName(rest))
        k += 1


def _accumulate(nodes: DataFrame, rounds: int, sums: dict[str, str]) -> DataFrame:
    """Each named column folded over the node and all its descendants ("sum" or "min")."""
    fold = {"sum": F.sum, "min": F.min}
    for k in range(rounds):
        below = nodes.filter(F.col(f"up{k}").isNotNull()).groupBy(F.col(f"up{k}").alias("digest")).agg(
            *[fold[how](c).alias(f"_{c}") for c, how in sums.items()])
        both = nodes.join(below, "digest", "left")
        for c, how in sums.items():
            both = both.withColumn(c, F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0)) if how == "sum" else F.least(c, f"_{c}")).drop(f"_{c}")
        nodes = B.table(both)
    return nodes


_ROW_SQL = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
            "saved_tokens long, ends_sha256 string")
_ROW = pa.schema([(c, pa.string() if c == "ends_sha256" else pa.int64()) for c in (
    "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")])


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per turn of every edge. Members are the same along it; what a turn saves adds up from the edge's end."""
    for batch in batches:
        if not batch.num_rows:
            continue
        edges = batch.column("chars")
        sizes = np.asarray(edges.value_lengths())
        chars = np.asarray(edges.flatten(), np.int64)
        row = np.repeat(np.arange(len(sizes)), sizes)
        ends = np.cumsum(sizes)
        step = np.arange(len(chars)) - (ends - sizes)[row]
        upto = np.append(0, np.cumsum(chars))
        rest = upto[ends[row]] - upto[:-1]
        last = step == sizes[row] - 1
        of = {c: np.asarray(batch.column(c).to_numpy(zero_copy_only=False))[row]
              for c in ("conv_id", "parent_depth", "_up", "n_convs", "n_children", "n_leaves", "_below")}
        sha = batch.column("ends_sha256").take(pa.array(row))
        yield B.record(
            _ROW, of["conv_id"], of["parent_depth"] + step + 1, np.where(step == 0, of["_up"], of["conv_id"]), of["n_convs"],
            np.where(last, of["n_children"], 1), of["n_leaves"], of["_below"] + (of["n_convs"] - 1) * rest,
            pc.if_else(pa.array(last), sha, EMPTY_SHA256))


def nodes_of(conversations: DataFrame, first: int = FIRST_BATCH, growth: int = GROWTH) -> DataFrame:
    """One row per distinct prefix of the conversations (conv_id, turns), the root included.

    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    Conversations without turns are members of the root; repeated conversations are members of the same nodes. No
    conversation gives no row. Other columns of the input are ignored.
    """
    members = B.table(paths_of(conversations))
    spark: SparkSession = members.sparkSession
    if members.isEmpty():
        return spark.createDataFrame([], _ROW_SQL)
    distinct = B.table(members.groupBy("digest").agg(F.first("path").alias("path"), F.first("chars").alias("chars")))
    trie = build(distinct, first, growth)
    children = trie.filter("parent is not null").groupBy(F.col("parent").alias("digest")).agg(F.count(F.lit(1)).alias("n_children"))
    known = trie.join(_ends(members), "digest", "left").join(children, "digest", "left").fillna(0, ["n_children", "n_ends"])
    known = known.withColumns({"n_convs": F.col("n_ends"), "n_leaves": (F.col("n_children") == 0).cast("long")})
    nodes, rounds = _pointers(known)
    nodes = _accumulate(nodes, rounds, {"n_convs": "sum", "n_leaves": "sum", "conv_id": "min"})
    size = F.aggregate("chars", F.lit(0).cast("long"), lambda a, x: a + x)
    nodes = nodes.withColumn("_edge_saved", (F.col("n_convs") - 1) * size).withColumn("_saved", F.col("_edge_saved"))
    nodes = _accumulate(nodes, rounds, {"_saved": "sum"}).withColumn("_below", F.col("_saved") - F.col("_edge_saved"))
    top = nodes.filter(F.col("digest") == F.lit(ROOT)).select("conv_id").first()[0]
    ids = nodes.select(F.col("digest").alias("parent"), F.col("conv_id").alias("_up"))
    at_top = F.col("parent") == F.lit(ROOT)
    placed = nodes.filter(at_top).withColumn("_up", F.lit(top)).unionByName(
        nodes.filter(F.col("parent").isNotNull() & ~at_top).join(ids, "parent"))
    inner = placed.select("conv_id", "parent_depth", "_up", "n_convs", "n_children", "n_leaves", "_below",
                          F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"), "chars").mapInArrow(_expand, _ROW_SQL)
    root = nodes.filter(F.col("digest") == F.lit(ROOT)).select(
        "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children",
        "n_leaves", F.col("_below").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"))
    return inner.unionByName(root)
