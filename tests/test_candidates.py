"""Filtering, suppression and caps: fixture values and a brute-force twin."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sightledger.functions import masks
from sightledger.operators import candidates as C
from sightledger.params import Params

SCHEMA = ("source_id string, raw_candidate_id string, score double, image_w int, image_h int, "
          "bbox struct<x_min:double,y_min:double,x_max:double,y_max:double>, "
          "runs array<struct<start:bigint,len:int>>")


def rect(x0, y0, x1, y1, w):
    return [(y * w + x0, x1 - x0) for y in range(y0, y1) if x1 > x0]


def frame(spark, rows, w, h, source="img"):
    data = [(source, i, s, w, h, tuple(float(c) for c in b), rect(*b, w)) for i, s, b in rows]
    return spark.createDataFrame(data, SCHEMA)


def outcome(df):
    return {r.raw_candidate_id: (r.status, r.filter_reason) for r in df.collect()}


CASES = {
    "mixed": (100, [("main", .9, (20, 20, 50, 50)), ("duplicate", .8, (20, 20, 50, 50)),
                    ("tiny", .95, (5, 5, 7, 7)), ("weak", .4, (60, 60, 80, 80))],
              dict(confidence_threshold=.5, min_mask_area_ratio=.01),
              {"main": None, "duplicate": "duplicate_mask", "tiny": "mask_too_small", "weak": "low_confidence"}),
    "contained": (40, [("complete", .98, (5, 5, 25, 25)), ("part", .95, (10, 10, 15, 15)),
                       ("separate", .94, (30, 30, 35, 35))],
                  dict(confidence_threshold=.5, min_mask_area_ratio=.001),
                  {"complete": None, "part": "contained_mask", "separate": None}),
    "cap": (60, [("cup_one", .99, (2, 2, 12, 12)), ("cup_two", .98, (22, 2, 32, 12)),
                 ("mouse", .6, (42, 42, 52, 52))], dict(confidence_threshold=.5, max_candidates_per_image=2),
            {"cup_one": None, "cup_two": None, "mouse": "candidate_limit"}),
    "inner": (40, [("outer", .98, (5, 5, 30, 30)), ("inner", .95, (12, 12, 20, 20))], {},
              {"outer": None, "inner": "contained_mask"}),
    "identical": (40, [("cup", .98, (5, 5, 25, 25)), ("container", .95, (5, 5, 25, 25))], {},
                  {"cup": None, "container": "duplicate_mask"}),
    "large": (20, [("large", .99, (0, 0, 20, 20)), ("first", .95, (1, 1, 6, 6)), ("second", .9, (12, 12, 18, 18))],
              dict(confidence_threshold=.5, max_mask_area_ratio=.8, max_candidates_per_image=1),
              {"large": "mask_too_large", "first": None, "second": "candidate_limit"}),
    # The duplicate met later in the scan beats the containment met first.
    "late_duplicate": (60, [("big", .99, (0, 0, 30, 30)), ("half", .98, (18, 10, 36, 20)), ("a", .97, (18, 10, 30, 20))],
                       dict(duplicate_iou=.5), {"big": None, "half": None, "a": "duplicate_mask"}),
    # Overlap with a removed candidate only does not remove.
    "only_kept_count": (60, [("x", .99, (0, 0, 20, 20)), ("y", .98, (0, 4, 20, 24)), ("z", .97, (0, 8, 20, 28))],
                        dict(duplicate_iou=.6), {"x": None, "y": "duplicate_mask", "z": None}),
    "ties": (40, [("b", .95, (5, 5, 25, 25)), ("a", .95, (5, 5, 25, 25))], {},
             {"a": None, "b": "duplicate_mask"}),
}


@pytest.mark.parametrize("name", CASES)
def test_fixture(spark, name):
    size, rows, settings, expect = CASES[name]
    got = outcome(C.process_candidates(frame(spark, rows, size, size), Params(**settings)))
    kinds = {k: (None if v[1] is None else v[1].split(":")[0]) for k, v in got.items()}
    assert kinds == expect


def test_reason_order_and_empty(spark):
    rows = [("low_empty", .1, (0, 0, 0, 0)), ("empty", .95, (0, 0, 0, 0))]
    got = outcome(C.process_candidates(frame(spark, rows, 50, 50), Params()))
    assert got["low_empty"][1] == "low_confidence" and got["empty"][1] == "empty_mask"
    shifted = frame(spark, [("m", .95, (0, 0, 20, 20))], 50, 50).withColumn("mask_w", F.lit(49)).withColumn("mask_h", F.lit(50))
    assert outcome(C.process_candidates(shifted, Params()))["m"][1] == "mask_shape_mismatch"


@pytest.mark.parametrize("greedy_rows", [4096, 1])
def test_no_candidate_is_lost_without_a_score(spark, greedy_rows):
    rows = [("none", None, (0, 0, 20, 20)), ("good", .95, (30, 30, 60, 60))]
    got = outcome(C.process_candidates(frame(spark, rows, 100, 100), Params(greedy_rows=greedy_rows)))
    assert got == {"none": ("filtered", "missing_score"), "good": ("pending", None)}


def test_iou_and_containment(spark):
    df = frame(spark, [("a", .9, (0, 0, 2, 1)), ("b", .8, (0, 0, 1, 2))], 2, 2)
    r = C.mask_overlaps(C.prepare(df, Params())).first()
    assert r.intersection == 1 and abs(r.iou - 1 / 3) < 1e-12
    df = frame(spark, [("full", .9, (0, 0, 4, 4)), ("inner", .8, (1, 1, 3, 3))], 4, 4)
    r = C.mask_overlaps(C.prepare(df, Params())).first()
    assert (r.second_in_first, r.first_in_second) == (1.0, 0.25)


def brute(rows, p, w):
    """Sequential greedy written from the rule text, on pixel sets."""
    pix = {i: {y * w + x for y in range(b[1], b[3]) for x in range(b[0], b[2])} for i, _, b in rows}
    kept, reasons = [], {}
    for i, s, b in sorted(rows, key=lambda r: (-r[1], r[0])):
        dup = cont = None
        for k in kept:
            inter = len(pix[i] & pix[k])
            union = len(pix[i]) + len(pix[k]) - inter
            if union and inter / union >= p.duplicate_iou:
                dup = k
                break
            if cont is None and len(pix[i]) < len(pix[k]) and inter / len(pix[i]) >= p.containment:
                cont = k
        if dup is not None:
            reasons[i] = ("duplicate_mask", dup)
        elif cont is not None:
            reasons[i] = ("contained_mask", cont)
        else:
            kept.append(i)
            reasons[i] = (None, len(kept))
    return reasons


@pytest.mark.parametrize("greedy_rows", [4096, 12])
def test_suppression_against_brute_force(spark, greedy_rows):
    """With a tiny bound the hot path (blocks, salted chunks) must give the same result."""
    p = Params(duplicate_iou=.6, containment=.7, greedy_rows=greedy_rows)
    rng = random.Random(7)
    frames, expect = [], {}
    for img, n in (("hot", 150), ("warm", 40), ("cold", 6)):
        rows = []
        for k in range(n):
            x, y = rng.randrange(20), rng.randrange(20)
            rows.append((f"c{k:03d}", round(rng.random() * 5) / 5, (x, y, x + rng.randrange(3, 16), y + rng.randrange(3, 16))))
        frames.append(frame(spark, rows, 40, 40, img))
        for k, v in brute(rows, p, 40).items():
            expect[(img, k)] = v
    df = C.prepare(frames[0].unionByName(frames[1]).unionByName(frames[2]), p)
    names = {r.id: r.raw_candidate_id for r in df.select("id", "raw_candidate_id").collect()}
    got = {}
    for r in C.suppress_overlaps(df, p).collect():
        kind, _, ref = (r.filter_reason or "").partition(":")
        got[(r.source_id, names[r.id])] = (kind, names[ref]) if kind else (None, r.kept_rank)
    assert got == expect


@pytest.mark.parametrize("width", [30, 7, None])
def test_usual_images_are_solved_together(monkeypatch, width):
    """All images of a batch go at once, also if masks cross the line ends of the stated width; no pass per image."""
    def never(*args):
        raise AssertionError("a pass for one image")

    monkeypatch.setattr(C, "_solve_image", never)
    p, rng, table, expect = Params(duplicate_iou=.6, containment=.7), random.Random(3), [], {}
    for img in range(12):
        rows = []
        for k in range(rng.randrange(1, 40)):
            x, y = rng.randrange(15), rng.randrange(15)
            rows.append((f"c{k:02d}", round(rng.random() * 4) / 4, (x, y, x + rng.randrange(2, 14), y + rng.randrange(2, 14))))
            runs = rect(*rows[-1][2], 30)
            table.append({"source_id": f"i{img}", "id": f"i{img}-c{k:02d}", "raw_candidate_id": f"c{k:02d}", "score": rows[-1][1],
                          "area": sum(n for _, n in runs), "width": width, "starts": [s for s, _ in runs], "lens": [n for _, n in runs],
                          "early_reason": None})
        for k, v in brute(rows, p, 30).items():
            expect[f"i{img}-{k}"] = v
        table.append({**table[-1], "id": f"lost{img}", "score": 2.0, "starts": None, "lens": None, "early_reason": "invalid_bbox"})
        expect[f"lost{img}"] = ("invalid_bbox", "")
    rng.shuffle(table)
    schema = pa.schema({"source_id": "string", "id": "string", "raw_candidate_id": "string", "score": "double", "area": "int64",
                        "width": "int64", "starts": pa.list_(pa.int64()), "lens": pa.list_(pa.int32()), "early_reason": "string"})
    got = {}
    for r in C._solve_batch(pa.Table.from_pylist(table, schema), p, ["id"]).to_pylist():
        kind, _, ref = (r["filter_reason"] or "").partition(":")
        got[r["id"]] = (kind, ref.partition("-")[2]) if kind else (None, r["kept_rank"])
    assert got == expect


def test_point_grid_and_best_mask(spark):
    images = spark.createDataFrame([("s", 8, 6)], "source_id string, image_w int, image_h int")
    pts = [(r.raw_candidate_id, r.x, r.y) for r in masks.point_grid(images, 2).orderBy("point_index").collect()]
    assert pts == [("grid_point_000000", 2.0, 1.5), ("grid_point_000001", 6.0, 1.5),
                   ("grid_point_000002", 2.0, 4.5), ("grid_point_000003", 6.0, 4.5)]
    runs = rect(2, 2, 6, 5, 8)
    rows = [("s", 7, 0, .2, []), ("s", 7, 1, .9, runs), ("s", 7, 2, .4, []), ("s", 8, 0, 1.5, []), ("s", 8, 1, 1.5, runs)]
    df = spark.createDataFrame(rows, "source_id string, point_index int, mask_index int, score double, runs array<struct<start:bigint,len:int>>")
    best = {r.point_index: r for r in C.best_mask_per_point(df).withColumn("b", masks.mask_bbox("runs", 8)).collect()}
    assert best[7].raw_candidate_id == "grid_point_000007" and best[7].score == .9
    assert tuple(best[7].b) == (2.0, 2.0, 6.0, 5.0)
    assert best[8].mask_index == 0 and best[8].score == 1.0 and best[8].b is None
