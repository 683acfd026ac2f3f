"""Sharding by extendible hashing, in DataFrame functions only.

Rows hash on their key to 60 bits. A directory over the first bits of the hash names the bucket of every
prefix; a bucket that is over the byte limit splits on its next bit, all others stay. The directory is
found from byte sums per prefix, ``STRIDE`` bits first and then ``STEP`` bits at a time: one small aggregate
gives all the splits of a step, and only prefixes that are still too large are looked at in the next one.
Beyond the first step a directory has at most 2^``STEP`` rows per prefix that was too large, so it grows with
the buckets and not with the rows; one of more than ``SENT_ROWS`` rows is never sent to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sightledger.llm import base as B
from sightledger.session import distributed_row_number

BITS = 60
STRIDE = 12
STEP = 4
SENT_ROWS = 1 << 17  # rows of a directory that may be broadcast, a few MB
ROW_BYTES = 16  # what a row costs besides its text


def _hash(key: str):
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long")


def _directory(open_rows: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """(cell, depth) for prefixes of ``high`` bits; depth is null where even those are too large."""
    cells = open_rows.groupBy(F.shiftright("__h", BITS - high).alias("cell")).agg(
        F.sum("__bytes").alias("bytes"), F.count("*").alias("n"))
    cells = B.table(cells)
    paths = cells.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(high)))).withColumn(
        "prefix", F.expr(f"shiftright(cell, {high} - depth)"))
    buckets = paths.groupBy("depth", "prefix").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
    # A single row over the limit cannot be split further.
    fits = buckets.filter((F.col("bytes") <= limit) | (F.col("n") == 1)).select("depth", "prefix")
    # The first step has 2^(STRIDE + 1) buckets at most.
    fit = paths.join(_met(fits, low == 0), ["depth", "prefix"]).groupBy("cell").agg(F.min("depth").alias("depth"))
    return B.table(cells.select("cell").join(_met(fit, low == 0), "cell", "left"))


def _met(right: DataFrame, small: bool) -> DataFrame:
    """The right side of a join, sent to all tasks or shuffled: file sizes say little about rows, so no plan chooses."""
    return F.broadcast(right) if small else right.hint("merge")


def assign(docs: DataFrame, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``n_bytes``, ``local_depth``, ``shard`` (the bucket's hash bits) and ``page``.

    Every (shard, page) holds at most ``limit`` bytes, unless it is a single row. Rows with one key have one
    hash: if together they are over the limit at full depth, they continue on overflow pages, by size class,
    so a page still fits. Null keys hash as the empty string, null texts have no bytes; input columns of the
    result names are replaced; an empty table gives none.
    """
    names = [c for c in docs.columns if c not in ("n_bytes", "local_depth", "shard", "page")]
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + ROW_BYTES
    rows = docs.select(*[F.col(f"`{c}`") for c in names], _hash(key).alias("__h"), size.alias("__bytes"))
    small = B.table(rows.select("__h", "__bytes"))

    low, depth = 0, F.lit(None).cast("int")
    while low < BITS and not small.isEmpty():
        high = STRIDE if low == 0 else low + STEP
        directory = _directory(small, low, high, limit)
        few = directory.count() <= SENT_ROWS
        cell = F.shiftright("__h", BITS - high)
        # Cells of later directories begin with an open one, so a row has a depth in one of them at most.
        known = directory.select(F.col("cell").alias("__cell"), F.col("depth").alias(f"__depth{high}"))
        rows = rows.withColumn("__cell", cell).join(_met(known, few), "__cell", "left").drop("__cell")
        depth = F.coalesce(depth, F.col(f"__depth{high}"))
        open_cells = directory.filter("depth is null").select(F.col("cell").alias("__cell"))
        if open_cells.isEmpty():
            small = small.limit(0)
            break
        small = B.table(small.withColumn("__cell", cell).join(_met(open_cells, few), "__cell", "left_semi").drop("__cell"))
        low = high
    rows = rows.withColumn("__depth", depth)
    if small.isEmpty():
        result = rows.withColumn("__depth", F.coalesce("__depth", F.lit(0))).withColumn("page", F.lit(0).cast("long"))
    else:
        done = rows.filter("__depth is not null").withColumn("page", F.lit(0).cast("long"))
        pages = _pages(rows.filter("__depth is null").drop("__depth"), limit, text).withColumn("__depth", F.lit(BITS))
        result = done.unionByName(pages)
    return result.select(
        *[F.col(f"`{c}`") for c in names], F.col("__bytes").alias("n_bytes"), F.col("__depth").cast("int").alias("local_depth"),
        F.concat(F.lit("b"), F.expr(f"substring(lpad(bin(__h), {BITS}, '0'), 1, __depth)")).alias("shard"), "page")


def _pages(rows: DataFrame, limit: int, text: str) -> DataFrame:
    """Overflow pages of buckets that cannot split: rows of one size class share a page as long as they surely fit."""
    size = F.expr("cast(floor(log2(__bytes)) as int)")
    rows = rows.withColumn("__class", size).withColumn(
        "__fit", F.greatest(F.lit(1).cast("long"), F.floor(F.lit(limit) / F.pow(F.lit(2.0), F.col("__class") + 1)).cast("long")))
    ranked = distributed_row_number(rows, ["__h", "__class"], [F.col(text)], "__rank")
    page = F.floor((F.col("__rank") - 1) / F.col("__fit")).cast("long") * 64 + F.col("__class") + 1
    return ranked.withColumn("page", page).drop("__class", "__fit", "__rank")


def write_shards(assigned: DataFrame, path: str) -> None:
    """One folder per shard and page, each written by the task that holds its rows."""
    assigned.repartition("shard", "page").write.partitionBy("shard", "page").parquet(path)
