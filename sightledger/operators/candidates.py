"""Candidate generation records, overlap suppression, caps and counts."""

from __future__ import annotations

import math
from bisect import bisect_left

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from sightledger.functions import masks
from sightledger.functions.identity import proposal_id
from sightledger.params import Params
from sightledger.schema import CANDIDATE_SOURCE
from sightledger.session import fresh, materialize, parallelism, union_all

# Below this k the window filter is turned into a map-side group limit.
_TOP_K_LIMIT = 1000


def best_mask_per_point(point_masks: DataFrame) -> DataFrame:
    """One candidate per point: highest score, lowest mask index on ties."""
    best = point_masks.groupBy("source_id", "point_index").agg(
        F.min_by(
            F.struct("mask_index", "score", "runs"),
            F.struct((-F.col("score")).alias("s"), F.col("mask_index").alias("m")),
        ).alias("b")
    )
    return best.select(
        "source_id", "point_index",
        masks.grid_point_id(F.col("point_index")).alias("raw_candidate_id"),
        F.lit(CANDIDATE_SOURCE).alias("prompt"),
        F.col("b.mask_index").alias("mask_index"),
        F.least(F.greatest(F.col("b.score"), F.lit(0.0)), F.lit(1.0)).alias("score"),
        F.col("b.runs").alias("runs"),
    )


def prepare(candidates: DataFrame, p: Params) -> DataFrame:
    """Ids, areas, clamped boxes and the first failing filter rule. No shuffle."""
    df = candidates
    if "prompt" not in df.columns:
        df = df.withColumn("prompt", F.lit(CANDIDATE_SOURCE))
    if "mask_w" not in df.columns:
        df = df.withColumn("mask_w", F.col("image_w")).withColumn("mask_h", F.col("image_h"))
    image_area = F.col("image_w").cast("long") * F.col("image_h")
    shape_ok = (F.col("mask_w") == F.col("image_w")) & (F.col("mask_h") == F.col("image_h"))
    df = (
        df.withColumn("id", proposal_id(F.col("source_id"), F.col("raw_candidate_id")))
        .withColumn("mask_area_pixels", masks.mask_area("runs"))
        .withColumn("mask_area_ratio", F.col("mask_area_pixels") / image_area)
        .withColumn("_box", masks.clamp_bbox("bbox", "image_w", "image_h"))
    )
    return (
        df.withColumn("early_reason", masks.filter_reason(
            F.col("score"), shape_ok, F.col("mask_area_pixels"), image_area, F.col("_box"), p,
        ))
        .withColumn("bbox", masks.stored_bbox(F.col("_box"), "image_w", "image_h"))
        .withColumn("shape_ok", shape_ok).withColumn("has_box", F.col("_box").isNotNull())
        .drop("_box")
    )


def mask_classes(candidates: DataFrame) -> DataFrame:
    """Distinct masks per image; the best candidate (score desc, raw id) stands for copies."""
    first = F.struct((-F.col("score")).alias("s"), F.col("raw_candidate_id").alias("r"))
    keep = F.struct("id", "score", "raw_candidate_id", "image_w", "mask_area_pixels")
    return candidates.groupBy("source_id", "runs").agg(
        F.min_by(keep, first).alias("b"), F.count(F.lit(1)).alias("copies")
    ).select("source_id", "runs", "b.*", "copies")


def mask_overlaps(candidates: DataFrame, tile: int = 64, min_shared: int = 1) -> DataFrame:
    """Overlapping pairs inside one image: intersection, IoU, directional containment.

    Input may be `mask_classes`, so that a pile of equal masks never makes pairs among
    itself and a pair stands for all copies on both sides. Every row run is cut at tile borders and pairs meet on (image, row, tile), so
    disjoint masks never meet. The shared pixels of the pieces add up to the exact
    intersection in one aggregate, all of it in generated code.
    """
    runs = candidates.select(
        "source_id", "id", "score", "raw_candidate_id", "image_w",
        F.col("mask_area_pixels").alias("area"), F.explode("runs").alias("r"),
    )
    x0 = F.col("r.start") % F.col("image_w")
    cut = runs.withColumn("y", F.expr("r.start div image_w")).withColumn("x0", x0).withColumn(
        "x1", F.col("x0") + F.col("r.len")
    ).withColumn("t", F.explode(F.expr(f"sequence(x0 div {tile}, (x1 - 1) div {tile})")))
    cut = cut.select(
        "source_id", "id", "score", "raw_candidate_id", "area", "y", "t",
        F.greatest("x0", F.col("t") * tile).alias("x0"),
        F.least("x1", (F.col("t") + 1) * tile).alias("x1"),
    )
    a, b = cut.alias("a"), cut.alias("b")
    before = (F.col("a.score") > F.col("b.score")) | (
        (F.col("a.score") == F.col("b.score")) & (F.col("a.raw_candidate_id") < F.col("b.raw_candidate_id"))
    )
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in ("source_id", "y", "t")]
    touch = (F.col("a.x0") < F.col("b.x1")) & (F.col("b.x0") < F.col("a.x1"))
    shared = F.least("a.x1", "b.x1") - F.greatest("a.x0", "b.x0")
    return _with_ratios(
        a.join(b, same[0] & same[1] & same[2] & touch & before)
        .groupBy(F.col("a.source_id").alias("source_id"), F.col("a.id").alias("first_id"),
                 F.col("b.id").alias("second_id"), F.col("a.area").alias("first_area"),
                 F.col("b.area").alias("second_area"))
        .agg(F.sum(shared).alias("intersection"))
        .filter(F.col("intersection") >= min_shared)
    )


def _with_ratios(pairs: DataFrame) -> DataFrame:
    return (
        pairs.withColumn("iou", masks.iou(F.col("intersection"), F.col("first_area"), F.col("second_area")))
        .withColumn("second_in_first", masks.containment(F.col("intersection"), F.col("second_area")))
        .withColumn("first_in_second", masks.containment(F.col("intersection"), F.col("first_area")))
    )


# Images with more rows than this make their pairs in a join, and pieces looked at together while counting pixels.
_PAIR_ROWS, _PAIR_PIECES = 1024, 4_000_000
_RELATED = "source_id string, first_id string, second_id string, first_area long, second_area long, intersection long"


def _packed_runs():
    """Runs as steps from start to start, and lengths: mostly equal numbers, which shuffle files compress well."""
    before = lambda i: F.coalesce(F.get("runs", i - 1)["start"], F.lit(0).cast("long"))
    return (F.transform("runs", lambda r, i: r["start"] - before(i)).alias("steps"),
            F.transform("runs", lambda r: r["len"]).alias("lens"))


def _flat(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False)


def _relate_images(rows: pa.Table) -> pa.Table:
    """Overlapping pairs of distinct masks, for all images of a bounded batch at once."""
    rows = rows.take(pc.sort_indices(rows, sort_keys=[
        ("source_id", "ascending"), ("score", "descending"), ("raw_candidate_id", "ascending")]))
    size = pc.list_value_length(rows["lens"]).to_numpy()
    at = np.concatenate(([0], np.cumsum(size)))
    steps, lens = _flat(rows["steps"]).astype(np.int64), _flat(rows["lens"]).astype(np.int64)
    image = pc.rank(rows["source_id"], tiebreaker="dense").to_numpy().astype(np.int64)
    # The first of equal masks stands for them.
    seen, best = set(), np.zeros(len(size), dtype=bool)
    for i, (k, lo, hi) in enumerate(zip(image.tolist(), at[:-1].tolist(), at[1:].tolist())):
        key = (k, steps[lo:hi].tobytes(), lens[lo:hi].tobytes())
        if hi > lo and key not in seen:
            seen.add(key)
            best[i] = True
    total = np.concatenate(([0], np.cumsum(steps)))
    start = total[1:] - np.repeat(total[at[:-1]], size)
    owner = np.repeat(np.arange(len(size)), size)
    use = np.repeat(best, size) & (lens > 0)
    start, lens, owner = start[use], lens[use], owner[use]
    # One number line for all images; pieces that begin inside a piece overlap it.
    start = start + image[owner] * (int((start + lens).max(initial=0)) + 1)
    order = np.argsort(start, kind="stable")
    start, owner = start[order], owner[order]
    end = start + lens[order]
    first = np.arange(1, len(start) + 1)
    count = np.searchsorted(start, end) - first
    done = np.concatenate(([0], np.cumsum(count)))
    keys, pixels, lo = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(done, done[lo] + _PAIR_PIECES, side="right")) - 1)
        left = np.repeat(np.arange(lo, hi), count[lo:hi])
        right = np.arange(len(left)) - np.repeat(done[lo:hi] - done[lo], count[lo:hi]) + np.repeat(first[lo:hi], count[lo:hi])
        a, b = owner[left], owner[right]
        shared = np.minimum(end[left], end[right]) - start[right]
        key = np.minimum(a, b) * len(size) + np.maximum(a, b)
        keys, where = np.unique(np.concatenate([keys, key[a != b]]), return_inverse=True)
        pixels = np.bincount(where, weights=np.concatenate([pixels, shared[a != b]]), minlength=len(keys)).astype(np.int64)
        lo = hi
    a, b = np.divmod(keys, len(size))
    x, y = rows.take(pa.array(a)), rows.take(pa.array(b))
    pairs = pa.table({
        "source_id": x["source_id"], "first_id": x["id"], "second_id": y["id"],
        "first_area": x["area"], "second_area": y["area"], "intersection": pixels})
    # Rows of equal score and id have no order, and so no pair.
    return pairs.filter(pc.invert(pc.and_(pc.equal(x["score"], y["score"]), pc.equal(x["raw_candidate_id"], y["raw_candidate_id"]))))


def class_overlaps(candidates: DataFrame, p: Params, rows_of: DataFrame | None = None) -> DataFrame:
    """`mask_overlaps` between the `mask_classes` of each image, after one shuffle of the candidates.

    Images up to a bound of rows are packed into hash batches, where equal masks are found and
    pairs are counted side by side; a larger image makes its pairs in the join of `mask_overlaps`,
    over many tasks. ``rows_of`` is any cheaper frame with at least these rows.
    """
    candidates = candidates.filter(F.col("score").isNotNull())
    bound = min(p.greedy_rows, _PAIR_ROWS)
    counts = (candidates if rows_of is None else rows_of).groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
    stats = counts.agg(F.max("n").alias("largest"), F.sum("n").alias("rows")).first()
    small, large = candidates, None
    if int(stats["largest"] or 0) > bound:
        hot = materialize(counts.filter(F.col("n") > bound).select("source_id"))
        small = candidates.join(hot, "source_id", "left_anti")
        large = mask_overlaps(mask_classes(candidates.join(hot, "source_id", "left_semi")))
    pairs = _batches(small.select(
        "source_id", "id", "raw_candidate_id", "score", F.col("mask_area_pixels").alias("area"), *_packed_runs(),
    ), int(stats["rows"] or 0), p).applyInArrow(_relate_images, _RELATED)
    pairs = _with_ratios(pairs)
    return pairs if large is None else pairs.unionByName(large)


# --- greedy suppression ----------------------------------------------------

class _KeptMasks:
    """Row runs of the kept masks of one image, concatenated in kept order."""

    def __init__(self):
        self.ids, self.areas, self.keys = [], [], []
        self._s, self._e, self._o, self._flat = [], [], [], None

    def add(self, cid, area, key, starts, ends):
        self._s.append(starts)
        self._e.append(ends)
        self._o.append(np.full(len(starts), len(self.ids)))
        self._flat = None
        self.ids.append(cid)
        self.areas.append(area)
        self.keys.append(key)

    def relation(self, area, starts, ends, p, limit=None):
        """(first duplicate index, first containing index) among the kept masks."""
        if not self.ids or area == 0:
            return None, None
        if self._flat is None:
            self._flat = (np.concatenate(self._s), np.concatenate(self._e), np.concatenate(self._o))
        ks, ke, owner = self._flat
        filled = np.concatenate(([0], np.cumsum(ends - starts)))

        def covered(x):
            j = np.searchsorted(starts, x, side="right") - 1
            inside = np.minimum(x - starts[j], ends[j] - starts[j])
            return np.where(j < 0, 0, filled[j] + inside)

        shared = np.bincount(owner, weights=covered(ke) - covered(ks), minlength=len(self.ids))
        kept_area = np.asarray(self.areas)
        dup = shared / (area + kept_area - shared) >= p.duplicate_iou
        cont = (area < kept_area) & (shared / area >= p.containment)
        if limit is not None:
            dup, cont = dup[:limit], cont[:limit]
        first = lambda hit: int(np.argmax(hit)) if hit.any() else None
        return first(dup), first(cont)


_OUTCOME = "kept_rank int, filter_reason string"
_SOLVED = "source_id string, id string, " + _OUTCOME


# Cells of the dense coverage matrix one block may use (float64: 80 MB).
_BLOCK_CELLS = 10_000_000


def _shared_pixels(starts: list, ends: list) -> np.ndarray:
    """Pairwise intersections of masks, by one product over elementary intervals."""
    n = len(starts)
    s, e = np.concatenate(starts), np.concatenate(ends)
    owner = np.repeat(np.arange(n), [len(x) for x in starts])
    cuts = np.unique(np.concatenate([s, e]))
    width = len(cuts)
    opened = np.bincount(owner * width + np.searchsorted(cuts, s), minlength=n * width)
    closed = np.bincount(owner * width + np.searchsorted(cuts, e), minlength=n * width)
    cover = np.cumsum((opened - closed).reshape(n, width), axis=1)[:, :-1].astype(np.float64)
    return (cover * np.diff(cuts)) @ cover.T


def _solve_image(ids, areas, starts, ends, base, p: Params):
    """Ranks and reasons of one image's candidates, given in score order.

    Blocks of candidates are related by one matrix product; only the kept masks of
    earlier blocks are looked at again.
    """
    n = len(ids)
    ranks, reasons = [None] * n, [None] * n
    kept = _KeptMasks()
    runs = max(1.0, sum(len(x) for x in starts) / n)
    size = int(min(256, max(16, math.sqrt(_BLOCK_CELLS / runs))))
    for lo in range(0, n, size):
        hi = min(n, lo + size)
        area = areas[lo:hi].astype(np.float64)
        shared = _shared_pixels(starts[lo:hi], ends[lo:hi])
        lower = np.tri(hi - lo, k=-1, dtype=bool)
        union = area[:, None] + area[None, :] - shared
        dup = lower & (shared / union >= p.duplicate_iou)
        cont = lower & (area[:, None] < area[None, :]) & (shared / area[:, None] >= p.containment)
        near = np.flatnonzero((dup | cont).any(axis=1))
        touched = set(near.tolist())
        kept_here = np.zeros(hi - lo, dtype=bool)
        earlier = len(kept.ids)
        block_kept = []
        for i in range(hi - lo):
            d = c = None
            if earlier:
                d, c = kept.relation(area[i], starts[lo + i], ends[lo + i], p, earlier)
                d = None if d is None else kept.ids[d]
                c = None if c is None else kept.ids[c]
            if d is None and i in touched:
                hit = np.flatnonzero(dup[i] & kept_here)
                if len(hit):
                    d = ids[lo + hit[0]]
                elif c is None:
                    inside = np.flatnonzero(cont[i] & kept_here)
                    c = ids[lo + inside[0]] if len(inside) else None
            if d is not None:
                reasons[lo + i] = f"duplicate_mask:{d}"
            elif c is not None:
                reasons[lo + i] = f"contained_mask:{c}"
            else:
                kept_here[i] = True
                block_kept.append(lo + i)
                ranks[lo + i] = base + earlier + len(block_kept)
        if hi < n:
            for i in block_kept:
                kept.add(ids[i], areas[i], None, starts[i], ends[i])
    return ranks, reasons


def _solve_images(pdf: pd.DataFrame, p: Params, carry: list[str]) -> pd.DataFrame:
    """Greedy pass over every image of a bounded batch of rows."""
    if not len(pdf):
        return pdf[carry].assign(kept_rank=pd.array([], dtype="Int32"), filter_reason=[])
    pdf = pdf.assign(_neg=-pdf["score"]).sort_values(["source_id", "_neg", "raw_candidate_id"])
    sources = pdf["source_id"].to_numpy()
    first = np.flatnonzero(np.concatenate(([True], sources[1:] != sources[:-1])))
    ids, areas = pdf["id"].to_numpy(), pdf["area"].to_numpy()
    starts, ends = list(pdf["starts"]), list(pdf["ends"])
    base = pdf["base"].to_numpy()
    ranks, reasons = [], []
    for lo, hi in zip(first, [*first[1:], len(pdf)]):
        r, why = _solve_image(ids[lo:hi], areas[lo:hi], starts[lo:hi], ends[lo:hi], int(base[lo]), p)
        ranks += r
        reasons += why
    out = pdf[carry].copy()
    out["kept_rank"] = pd.array(ranks, dtype="Int32")
    out["filter_reason"] = reasons
    return out


# Images up to this many rows are related all at once, pair by pair, in slices of so many pairs or pieces.
_TOGETHER_ROWS, _SLICE = 256, 1 << 17


def _slices(count: np.ndarray):
    """Ranges of items whose counts add up to at most some ``_SLICE``; an item above that goes alone."""
    done = np.concatenate(([0], np.cumsum(count)))
    lo = 0
    while lo < len(count):
        hi = max(lo + 1, int(np.searchsorted(done, done[lo] + _SLICE, side="right")) - 1)
        yield lo, hi
        lo = hi


def _spans(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of every item, as many as it counts, one after the other."""
    before = np.cumsum(count) - count
    return np.arange(int(count.sum())) + np.repeat(first - before, count)


class _Masks:
    """Pieces of all masks of a batch in flat arrays, each mask's pieces in ascending order."""

    def __init__(self, rows: pa.Table):
        size = pc.fill_null(pc.list_value_length(rows["lens"]), 0).to_numpy().astype(np.int64)
        start, lens = _flat(rows["starts"]).astype(np.int64), _flat(rows["lens"]).astype(np.int64)
        owner = np.repeat(np.arange(len(size)), size)
        use = lens > 0
        if not use.all():
            start, lens, owner = start[use], lens[use], owner[use]
        self.reach = int((start + lens).max(initial=0)) + 1
        line = owner * self.reach + start
        if (line[1:] < line[:-1]).any():
            order = np.argsort(line, kind="stable")
            start, lens, line = start[order], lens[order], line[order]
        self.size = np.bincount(owner, minlength=len(size))
        self.at = np.concatenate(([0], np.cumsum(self.size)))
        self.start, self.end, self.line = start, start + lens, line
        self.filled = np.concatenate(([0], np.cumsum(lens)))
        self.area = rows["area"].to_numpy().astype(np.int64)

    def boxes(self, width: np.ndarray):
        """x0, y0, x1, y1 of each mask on lines of a width given for every piece; pieces that cross a line's end take the whole line."""
        n = len(self.size)
        out = [np.zeros(n, np.int64) for _ in range(4)]
        some = np.flatnonzero(self.size)
        if len(some):
            y0, x0 = np.divmod(self.start, width)
            y1 = (self.end - 1) // width
            cross = y1 > y0
            x1 = np.where(cross, width, x0 + self.end - self.start)
            first = self.at[some]
            for o, v, least in zip(out, (np.where(cross, 0, x0), y0, x1, y1 + 1), (True, True, False, False)):
                o[some] = (np.minimum if least else np.maximum).reduceat(v, first)
        return out

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common pixels of the masks a and b, pair by pair."""
        out = np.zeros(len(a), dtype=np.int64)
        for lo, hi in _slices(self.size[a]):
            count = self.size[a[lo:hi]]
            pieces, other = _spans(self.at[a[lo:hi]], count), np.repeat(b[lo:hi], count)
            both = self._covered(other, self.end[pieces]) - self._covered(other, self.start[pieces])
            out[lo:hi] = np.bincount(np.repeat(np.arange(hi - lo), count), weights=both, minlength=hi - lo)
        return out

    def _covered(self, mask: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Pixels of each mask before x."""
        first = self.at[mask]
        j = np.searchsorted(self.line, mask * self.reach + x, side="right") - 1
        inside = j >= first
        j = np.where(inside, j, 0)
        return np.where(inside, self.filled[j] - self.filled[first] + np.minimum(x, self.end[j]) - self.start[j], 0)


def _related(masks_: _Masks, first: np.ndarray, last: np.ndarray, width: np.ndarray, p: Params):
    """Pairs (earlier, later, duplicate?) of one image in which the later one is a copy or part of the earlier one.

    ``first`` and ``last`` bound each image's rows. What two boxes share bounds what their masks share, in the same
    formulas, so only pairs whose boxes would do are counted pixel by pixel.
    """
    x0, y0, x1, y1 = masks_.boxes(width)
    area = masks_.area
    row = _spans(first, last - first)
    count = np.repeat(last, last - first) - row - 1
    found = []

    def tests(shared, a, b):
        big, small = area[a], area[b]
        dup = shared / np.maximum(big + small - shared, 1) >= p.duplicate_iou
        return dup, (small < big) & (shared / np.maximum(small, 1) >= p.containment)

    for lo, hi in _slices(count):
        a, b = np.repeat(row[lo:hi], count[lo:hi]), _spans(row[lo:hi] + 1, count[lo:hi])
        wide = np.minimum(x1[a], x1[b]) - np.maximum(x0[a], x0[b])
        high = np.minimum(y1[a], y1[b]) - np.maximum(y0[a], y0[b])
        most = np.minimum(np.maximum(wide, 0) * np.maximum(high, 0), np.minimum(area[a], area[b]))
        dup, part = tests(most, a, b)
        near = np.flatnonzero(dup | part)
        if len(near):
            a, b = a[near], b[near]
            dup, part = tests(masks_.shared(a, b), a, b)
            hit = (dup | part) & (area[a] > 0) & (area[b] > 0)
            found.append((a[hit], b[hit], dup[hit], part[hit]))
    if not found:
        return []
    a, b, dup, part = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((a, b))
    return zip(a[order].tolist(), b[order].tolist(), dup[order].tolist(), part[order].tolist())


def _solve_batch(rows: pa.Table, p: Params, carry: list[str]) -> pa.Table:
    """Greedy pass over every image of a bounded batch of rows, for all usual images at once.

    Rows that have an ``early_reason`` keep it and take no part.
    """
    if "early_reason" in rows.column_names:
        out = rows.filter(pc.is_valid(rows["early_reason"]))
        none = pa.nulls(len(out), pa.int32())
        out = out.select(carry).append_column("kept_rank", none).append_column("filter_reason", out["early_reason"])
        rows = rows.filter(pc.is_null(rows["early_reason"])).drop_columns("early_reason")
        return pa.concat_tables([out, _solve_batch(rows, p, carry)]) if len(rows) else out
    image = pc.dictionary_encode(rows["source_id"].combine_chunks()).indices
    rows = rows.append_column("_image", image)
    rows = rows.take(pc.sort_indices(rows, sort_keys=[
        ("_image", "ascending"), ("score", "descending"), ("raw_candidate_id", "ascending")])).combine_chunks()
    n = len(rows)
    image = rows["_image"].to_numpy()
    first = np.flatnonzero(np.concatenate(([True], image[1:] != image[:-1])))
    last = np.concatenate((first[1:], [n]))
    all_masks = _Masks(rows)
    # One width for an image, whatever it is, makes its boxes comparable.
    width = np.maximum(pc.fill_null(rows["width"], 1).to_numpy(), 1)
    width = np.repeat(np.repeat(width[first], last - first), all_masks.size)
    by, copy = [-1] * n, [False] * n
    usual = last - first <= _TOGETHER_ROWS
    # Pairs come by the later row, then by the earlier one, whose fate is settled: the first copy counts, else the first whole.
    for a, b, dup, part in _related(all_masks, first[usual], last[usual], width, p):
        if by[a] < 0 and not copy[b]:
            if dup:
                by[b], copy[b] = a, True
            elif by[b] < 0:
                by[b] = a
    for lo, hi in zip(first[~usual].tolist(), last[~usual].tolist()):
        cut = [slice(*all_masks.at[i:i + 2]) for i in range(lo, hi)]
        _, reasons = _solve_image(list(range(lo, hi)), all_masks.area[lo:hi], [all_masks.start[c] for c in cut],
                                  [all_masks.end[c] for c in cut], 0, p)
        for i, why in enumerate(reasons, lo):
            if why is not None:
                kind, _, k = why.partition(":")
                by[i], copy[i] = int(k), kind == "duplicate_mask"
    by = np.array(by)
    kept = by < 0
    rank = np.cumsum(kept)
    rank -= np.repeat(rank[first] - kept[first], last - first)
    kind = pa.array(np.where(copy, "duplicate_mask:", "contained_mask:"))
    other = rows["id"].take(pa.array(np.where(kept, 0, by)))
    reason = pc.if_else(pa.array(kept), pa.scalar(None, pa.string()), pc.binary_join_element_wise(kind, other, ""))
    return rows.select(carry).append_column("kept_rank", pa.array(rank.astype(np.int32), mask=kept == 0)).append_column("filter_reason", reason)


def _schema_of(df: DataFrame, carry: list[str]) -> str:
    fields = {f.name: f.dataType.simpleString() for f in df.schema}
    return ", ".join(f"`{c}` {fields[c]}" for c in carry) + ", " + _OUTCOME


def _batches(df: DataFrame, rows: int, p: Params):
    """Whole images in hash batches of some ``greedy_rows`` rows; a task takes several batches, one after the other."""
    tasks = parallelism(df.sparkSession)
    batches = max(4 * tasks, math.ceil(rows / p.greedy_rows))
    keyed = df.withColumn("_batch", F.pmod(F.xxhash64("source_id"), F.lit(batches)))
    return keyed.repartition(max(tasks, math.ceil(batches / 16)), "_batch").groupBy("_batch")


def _batched(df: DataFrame, rows: int, p: Params, carry: list[str]) -> DataFrame:
    """Pack whole images into hash batches of bounded size and solve each batch."""
    return _batches(df, rows, p).applyInArrow(lambda table: _solve_batch(table, p, carry), _schema_of(df, carry))


def _image_rows(candidates: DataFrame) -> tuple[DataFrame, int, int]:
    """Rows of each image, of the largest one and of all."""
    counts = candidates.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
    stats = counts.agg(F.max("n").alias("largest"), F.sum("n").alias("rows")).first()
    return counts, int(stats["largest"] or 0), int(stats["rows"] or 0)


def _needed(carry: list[str]) -> list[str]:
    return list(dict.fromkeys([*carry, "source_id", "id", "raw_candidate_id", "score"]))


def _flat_runs(candidates: DataFrame, columns: list[str]) -> DataFrame:
    """What `_solve_batch` reads; runs as two flat arrays, for rows that are still in the race."""
    width = F.col("image_w") if "image_w" in candidates.columns else F.lit(1)
    flat = [F.col("runs.start"), F.col("runs.len")]
    if "early_reason" in columns:
        flat = [F.when(F.col("early_reason").isNull(), c) for c in flat]
    return candidates.select(*columns, F.col("mask_area_pixels").alias("area"), width.cast("long").alias("width"), flat[0].alias("starts"), flat[1].alias("lens"))


def suppress_overlaps(
    candidates: DataFrame, p: Params, carry: list[str] | None = None, rows_of: DataFrame | None = None
) -> DataFrame:
    """Greedy duplicate and containment suppression per image.

    Input: source_id, id, raw_candidate_id, score, mask_area_pixels, runs, and any flat
    ``carry`` columns. Output: the carried columns (source_id and id by default) with
    kept_rank (null when removed) and filter_reason. ``rows_of`` is any cheaper frame
    with at least these rows: if even its images are small, nothing else is counted.

    Images up to ``greedy_rows`` candidates are solved whole inside hash batches: in those of usual
    size all pairs whose boxes may relate are counted at once, for all images of a batch. A
    larger image is solved in blocks of its best live candidates: each block is
    solved by one task, then all its remaining candidates are compared with the few
    newly kept masks in salted chunks, so the image is spread over many tasks and
    only candidate x kept pairs are ever looked at.
    """
    carry = carry or ["source_id", "id"]
    columns = _needed(carry)
    df = _flat_runs(candidates, columns)
    for frame in ([rows_of] if rows_of is not None else []) + [candidates]:
        counts, largest, rows = _image_rows(frame)
        if largest <= p.greedy_rows:
            return _batched(df, rows, p, carry)
    hot = materialize(counts.filter(F.col("n") > p.greedy_rows))
    cold = df.join(hot, "source_id", "left_anti")
    hot_rows = candidates.select(*columns, F.col("mask_area_pixels").alias("area"), *_run_arrays()).join(hot, "source_id")
    solved = _solve_hot(hot_rows.drop(*[c for c in carry if c not in (
        "source_id", "id", "raw_candidate_id", "score")]), p)
    outcome = hot_rows.select(*dict.fromkeys([*carry, "source_id", "id"])).join(solved, ["source_id", "id"])
    return _batched(cold, rows, p, carry).unionByName(
        outcome.select(*carry, "kept_rank", "filter_reason"))


_CHUNK_OUT = _SOLVED + ", container string, status string"


def _compare_chunk(left: pd.DataFrame, right: pd.DataFrame, p: Params) -> pd.DataFrame:
    """Candidates of one salted chunk against the newly kept masks of their image."""
    kept = _KeptMasks()
    right = right.sort_values("kept_rank")
    for cid, area, score, raw, s, e in zip(
        right["id"], right["area"], right["score"], right["raw_candidate_id"],
        right["starts"], right["ends"],
    ):
        kept.add(cid, area, (-score, raw), s, e)
    last = None
    if len(right):
        last = (-right["last_score"].iloc[0], right["last_raw"].iloc[0])
    out = []
    for source, cid, raw, score, area, s, e, container in zip(
        left["source_id"], left["id"], left["raw_candidate_id"], left["score"],
        left["area"], left["starts"], left["ends"], left["container"],
    ):
        key = (-score, raw)
        # Kept masks come in rank order, so their keys ascend.
        limit = bisect_left(kept.keys, key) if last is not None and key <= last else None
        dup, cont = kept.relation(area, s, e, p, limit)
        container = container if isinstance(container, str) else None
        if container is None and cont is not None:
            container = kept.ids[cont]
        if dup is not None:
            out.append((source, cid, None, f"duplicate_mask:{kept.ids[dup]}", container, "done"))
        elif container is not None and last is not None and key <= last:
            out.append((source, cid, None, f"contained_mask:{container}", container, "done"))
        else:
            out.append((source, cid, None, None, container, "open"))
    res = pd.DataFrame(out, columns=["source_id", "id", "kept_rank", "filter_reason", "container", "status"])
    res["kept_rank"] = res["kept_rank"].astype("Int32")
    return res


def _solve_hot(hot: DataFrame, p: Params) -> DataFrame:
    """Blocks of best live candidates; a contained one waits for a later duplicate."""
    block_rows = min(p.greedy_rows, _TOP_K_LIMIT)
    open_rows = materialize(
        hot.withColumn("salts", F.ceil(F.col("n") / p.greedy_rows).cast("int"))
        .drop("n").withColumn("container", F.lit(None).cast("string"))
    )
    results = []
    best_first = W.partitionBy("source_id").orderBy(F.desc("score"), "raw_candidate_id")
    while not open_rows.isEmpty():
        live = open_rows.filter(F.col("container").isNull())
        block = live.withColumn("_rn", F.row_number().over(best_first)).filter(
            F.col("_rn") <= block_rows
        )
        solved = materialize(block.groupBy("source_id").applyInPandas(
            lambda pdf: _solve_images(pdf, p, ["source_id", "id"]), _SOLVED
        ))
        # A block of kept and block-removed rows is decided, except that a contained
        # one already is final here: every kept mask above it has been compared.
        results.append(solved)
        bounds = open_rows.join(solved.select("source_id", "id"), ["source_id", "id"]).groupBy(
            "source_id"
        ).agg(F.max_by(
            F.struct(F.col("score").alias("last_score"), F.col("raw_candidate_id").alias("last_raw")),
            F.struct((-F.col("score")).alias("s"), F.col("raw_candidate_id").alias("r")),
        ).alias("b"), F.lit(1).alias("_one")).select("source_id", "b.*")
        kept = (
            open_rows.drop("container", "base")
            .join(solved.filter(F.col("kept_rank").isNotNull()).select("source_id", "id", "kept_rank"),
                  ["source_id", "id"])
            .join(bounds, "source_id")
        )
        rest = open_rows.join(solved.select("source_id", "id"), ["source_id", "id"], "left_anti")
        salted = rest.withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"))
        spread = kept.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        compared = materialize(
            salted.groupBy("source_id", "salt").cogroup(fresh(spread).groupBy("source_id", "salt"))
            .applyInPandas(lambda a, b: _compare_chunk(a, b, p), _CHUNK_OUT)
        )
        results.append(
            compared.filter(F.col("status") == "done")
            .select("source_id", "id", "kept_rank", "filter_reason")
        )
        kept_now = solved.groupBy("source_id").agg(F.count("kept_rank").cast("int").alias("_more"))
        open_rows = materialize(
            rest.drop("container")
            .join(compared.filter(F.col("status") == "open").select("source_id", "id", "container"),
                  ["source_id", "id"])
            .join(kept_now, "source_id", "left")
            .withColumn("base", F.col("base") + F.coalesce("_more", F.lit(0))).drop("_more")
        )
        leftover = open_rows.filter(F.col("container").isNull())
        if leftover.isEmpty():
            results.append(open_rows.select(
                "source_id", "id", F.lit(None).cast("int").alias("kept_rank"),
                F.concat(F.lit("contained_mask:"), "container").alias("filter_reason"),
            ))
            break
    return union_all(results)


def candidate_cap(candidates: DataFrame, limit: int) -> DataFrame:
    """First ``limit`` per image by (score desc, raw id); the rest `candidate_limit`.

    The top rows come from a filtered window (map-side group limit), and the mark is
    joined back, so a huge image is never sorted in one task.
    """
    best_first = W.partitionBy("source_id").orderBy(F.desc("score"), "raw_candidate_id")
    top = (
        candidates.select("source_id", "raw_candidate_id", "score")
        .withColumn("kept_rank", F.row_number().over(best_first))
        .filter(F.col("kept_rank") <= limit)
        .select("source_id", "raw_candidate_id", "kept_rank")
    )
    return candidates.join(top, ["source_id", "raw_candidate_id"], "left").withColumn(
        "filter_reason", F.when(F.col("kept_rank").isNull(), "candidate_limit")
    )


_CORNERS = ("x_min", "y_min", "x_max", "y_max")


def _run_arrays():
    """Runs as two flat arrays, the form the Arrow tasks read without copying."""
    return (
        F.transform("runs", lambda r: r["start"]).alias("starts"),
        F.transform("runs", lambda r: r["start"] + r["len"]).alias("ends"),
        F.lit(0).alias("base"),
    )


def outcomes(candidates: DataFrame, p: Params, flat: list[str]) -> DataFrame:
    """Filter ladder, suppression and cap: the ``flat`` columns of every candidate with kept_rank and filter_reason.

    The ladder is one set of column rules. Rows travel once, to the suppression, which splits
    by image: small ones in hash batches, each large one block by block.
    """
    ready = prepare(candidates, p)
    ready = ready.select("*", *[F.col(f"bbox.{c}").alias(c) for c in _CORNERS])
    _, largest, rows = _image_rows(candidates)
    if largest <= p.greedy_rows:
        # Masks and ladder are worked out once: lost rows travel along without their runs.
        return _capped(_batched(_flat_runs(ready, [*_needed(flat), "early_reason"]), rows, p, flat), p)
    early = ready.filter("early_reason is not null").select(
        *flat, F.lit(None).cast("int").alias("kept_rank"), F.col("early_reason").alias("filter_reason"))
    needed = dict.fromkeys([*flat, "source_id", "id", "raw_candidate_id", "score", "mask_area_pixels", "image_w", "runs"])
    rest = ready.filter("early_reason is null").select(*needed)
    return early.unionByName(_capped(suppress_overlaps(rest, p, flat), p))


def _capped(solved: DataFrame, p: Params) -> DataFrame:
    over = F.col("kept_rank") > p.max_candidates_per_image
    return solved.withColumn(
        "filter_reason", F.when(over, "candidate_limit").otherwise(F.col("filter_reason"))
    ).withColumn("kept_rank", F.when(~over, F.col("kept_rank")))


def process_candidates(candidates: DataFrame, p: Params) -> DataFrame:
    """`outcomes` with box and status: one row per candidate."""
    flat = ["source_id", "id", "raw_candidate_id", "prompt", "score", "mask_area_pixels",
            "mask_area_ratio", *_CORNERS]
    return outcomes(candidates, p, flat).select(
        *flat[:7], F.struct(*_CORNERS).alias("bbox"), "kept_rank",
        F.when(F.col("filter_reason").isNull(), "pending").otherwise("filtered").alias("status"),
        "filter_reason",
    )


def filter_counts(processed: DataFrame) -> DataFrame:
    """Removed candidates per source and reason kind."""
    return (
        processed.filter(F.col("filter_reason").isNotNull())
        .groupBy("source_id", masks.reason_kind(F.col("filter_reason")).alias("reason"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
