"""Mask operators that work on whole Arrow batches: against brute force over pixels, on every path."""

import random

import pytest
from pyspark.sql import functions as F

from sightledger.functions.vectors import select_patches
from sightledger.operators import candidates as C
from sightledger.params import Params

SIDE = 12
RUNS = "array<struct<start:bigint,len:int>>"


def _mask(rnd):
    """Random row runs, several in a row and with holes."""
    out = []
    for y in range(SIDE):
        x = rnd.randrange(4)
        while x < SIDE and rnd.random() < 0.6:
            n = rnd.randint(1, min(4, SIDE - x))
            out.append((y * SIDE + x, n))
            x += n + rnd.randint(1, 3)
    return out


def _pixels(runs):
    return {p for s, n in runs for p in range(s, s + n)}


def _candidates(seed):
    rnd = random.Random(seed)
    rows = []
    for image in range(5):
        pool = [_mask(rnd) for _ in range(6)] + [[]]
        rows += [(f"img_{image}", f"id_{image}_{i}", f"r{i:02d}", rnd.choice([0.5, 0.9, 0.95]), rnd.choice(pool)) for i in range(4 * image)]
    return rows


@pytest.mark.parametrize("bound,pieces", [(4096, 4_000_000), (4096, 3), (5, 4_000_000)])
def test_class_overlaps_equal_pixels(spark, monkeypatch, bound, pieces):
    monkeypatch.setattr(C, "_PAIR_PIECES", pieces)
    rows = _candidates(7)
    df = spark.createDataFrame(rows, f"source_id string, id string, raw_candidate_id string, score double, runs {RUNS}")
    df = df.withColumn("image_w", F.lit(SIDE)).withColumn("mask_area_pixels", C.masks.mask_area(F.col("runs")))
    got = {(r.source_id, r.first_id, r.second_id, r.first_area, r.second_area, r.intersection)
           for r in C.class_overlaps(df, Params(greedy_rows=bound)).collect()}
    classes = {}
    for row in sorted(rows, key=lambda r: (-r[3], r[2])):
        classes.setdefault((row[0], tuple(row[4])), row)
    best = list(classes.values())
    want = set()
    for i, a in enumerate(best):
        for b in best[i + 1:]:
            shared = len(_pixels(a[4]) & _pixels(b[4]))
            if a[0] == b[0] and shared:
                want.add((a[0], a[1], b[1], len(_pixels(a[4])), len(_pixels(b[4])), shared))
    assert want and got == want


def test_mask_overlaps_query_does_not_explode_runs(spark):
    """One row per candidate is shuffled; before, one per row run and tile, joined with itself."""
    from __spark_entry__ import queries
    plan = queries()["mask_overlaps"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan


def test_select_patches_equals_pixels(spark):
    rnd = random.Random(3)
    rows = [(i, _mask(rnd), h) for i, h in enumerate([12, 12, 11, 7, 2, 12] * 5)]
    rows += [(98, [], 12), (99, None, 12), (100, [(0, 12)], None)]
    df = spark.createDataFrame(rows, f"k int, runs {RUNS}, h int")
    picked = df.select("k", select_patches(F.col("runs"), SIDE, F.col("h"), 3, 0.4).alias("p"))
    got = {r.k: {(c.r, c.c) for c in r.p} for r in picked.collect()}
    for k, runs, h in rows:
        cw, ch, want = SIDE // 3, (h or 0) // 3, set()
        for r in range(3):
            for c in range(3):
                cell = {y * SIDE + x for y in range(r * ch, (r + 1) * ch) for x in range(c * cw, (c + 1) * cw)}
                if cell and len(cell & _pixels(runs or [])) / len(cell) >= 0.4:
                    want.add((r, c))
        assert got[k] == want, k
    # The cells are counted in Arrow batches, not run by run in interpreted expressions for each cell.
    assert "ArrowEvalPython" in picked._jdf.queryExecution().executedPlan().toString()
