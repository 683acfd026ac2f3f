"""Whole runs: the review loop against a sequential twin, restarts, plug-in failures, ingestion."""

import hashlib
import json
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightledger.operators import review as R
from sightledger.params import Params
from sightledger.plans import resolve as RS, run as RUN
from sightledger.sources import ledger as L
from test_resolution import inputs

AT = datetime(2024, 5, 1)


def sequential(rows, clusters, p, size):
    """Every batch against all views before it, one member after the other."""
    unit = {i: (lambda a: a / np.linalg.norm(a))(np.asarray(v, np.float32).astype(float)) for i, _, v in rows}
    order = sorted(clusters, key=lambda c: (-len(clusters[c]), c))
    views, out = {}, {}
    for lo in range(0, len(order), size):
        snapshot = {o: list(v) for o, v in views.items()}
        for c in order[lo:lo + size]:
            evidence = []
            for q in clusters[c]:
                near = sorted((-max(round(float(unit[q] @ unit[m]), 9) for m in ms), o) for o, ms in snapshot.items())[:p.local_top_k]
                scores = []
                for _, o in near:
                    def score(m):
                        g = round(float(unit[q] @ unit[m]), 9)
                        return round(p.global_weight * g + p.local_weight * (float(unit[q] @ unit[m]) >= p.local_patch_similarity), 12)
                    scores.append((-max(map(score, snapshot[o])), o))
                scores.sort()
                if not scores or -scores[0][0] < p.match_threshold:
                    kind = 2
                elif len(scores) > 1 and round(scores[1][0] - scores[0][0], 12) < p.ambiguity_margin:
                    kind = 1
                else:
                    kind = 0
                evidence.append((kind, scores[0][0] if scores else 1.0, q, scores[0][1] if scores else None))
            kind, _, _, o = min(evidence)
            if len({e[3] for e in evidence if e[0] == 0}) > 1:
                kind = 1
            out[c] = ("existing", "uncertain", "new")[kind]
            if kind == 2:
                o = "obj_" + hashlib.sha256(f"run_1\n{c}".encode()).hexdigest()[:32]
            if kind != 1:
                views.setdefault(o, []).extend(clusters[c])
    return out


def scattered(seed=3, n=60, sources=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(7, 6))
    return [(f"p{i:02d}", f"s{i % sources}", centres[rng.integers(7)] + .35 * rng.normal(size=6)) for i in range(n)]


def test_loop_equals_the_sequential_twin_with_larger_clusters(spark):
    rows, p = scattered(), Params(max_clusters_per_batch=8, cluster_similarity=.93, match_threshold=.85, local_patch_similarity=.9)
    res = RS.resolve_entities(*inputs(spark, rows), p, "run_1")
    clusters = {}
    for r in res.members.select("cluster_id", "id").collect():
        clusters.setdefault(r.cluster_id, []).append(r.id)
    assert len(clusters) > 16 and max(map(len, clusters.values())) > 1
    got = {r.cluster_id: r.final_decision for r in res.clusters.collect()}
    assert got == sequential(rows, clusters, p, 8) and len(set(got.values())) == 3


def test_new_views_in_tiles_and_merged_pieces_change_nothing(spark, monkeypatch):
    from sightledger.plans import maxima

    rows, p = scattered(5, 18), Params(max_clusters_per_batch=4, cluster_similarity=.93, match_threshold=.85)
    plain = RS.resolve_entities(*inputs(spark, rows), p, "run_1")
    want = sorted((r.proposal_id, r.decision, r.evidence) for r in plain.decisions.collect())
    for name, value in (("SENT_VIEWS", 0), ("NAMED_IDS", 0), ("MERGE_AFTER", 1)):
        monkeypatch.setattr(maxima, name, value)
    other = RS.resolve_entities(*inputs(spark, rows), p, "run_1")
    assert sorted((r.proposal_id, r.decision, r.evidence) for r in other.decisions.collect()) == want


def test_batches_of_more_members_than_one_task_takes_go_at_once():
    from sightledger.plans import maxima

    sizes = {b: 3000 for b in range(1, 101)}
    assert RS._window(sizes, 1, 30, maxima.WINDOW_ROWS) == 30
    assert RS._window(sizes, 1, 100, maxima.WINDOW_ROWS) == maxima.WINDOW_ROWS // 3000
    assert RS._window(sizes, 5, 100, maxima.SENT_VIEWS) == 5


# --- whole runs over files -------------------------------------------------

def image(folder, name, boxes):
    (folder / name).write_text(boxes if isinstance(boxes, str) else json.dumps(boxes))


def segmenter():
    def load():
        import pandas as pd

        def run(pdf):
            out = []
            for source, content in zip(pdf["source_id"], pdf["content"]):
                for raw, score, (x0, y0, x1, y1) in json.loads(bytes(content)):
                    spans = [{"start": y * 40 + x0, "len": x1 - x0} for y in range(y0, y1)]
                    box = {"x_min": float(x0), "y_min": float(y0), "x_max": float(x1), "y_max": float(y1)}
                    out.append((source, raw, score, 40, 40, box, spans))
            return pd.DataFrame(out, columns=["source_id", "raw_candidate_id", "score", "image_w", "image_h", "bbox", "runs"])

        return run
    return load


def embedder(bad_width=None):
    def load():
        def run(pdf):
            width, height = pdf["x_max"] - pdf["x_min"], pdf["y_max"] - pdf["y_min"]
            if (width == bad_width).any():
                raise ValueError("no features")
            pdf["vector"] = [[float(a), float(b)] for a, b in zip(width, height)]
            pdf["local"] = [[v] for v in pdf["vector"]]
            return pdf[["id", "source_id", "score", "vector", "local"]]
        return run
    return load


def folder_of(tmp_path, name="images"):
    folder = tmp_path / name
    folder.mkdir()
    for i, (w, h) in enumerate([(4, 30), (30, 4), (14, 14), (4, 29), (29, 4), (9, 25)]):
        image(folder, f"{i}.png", [[f"a{i}", .95, (1, 1, 1 + w, 1 + h)], [f"weak{i}", .2, (31, 31, 39, 39)]])
    image(folder, "copy.png", json.loads((folder / "0.png").read_text()))
    return folder


P = Params(max_clusters_per_batch=2, cluster_similarity=.9995, match_threshold=.95)
TABLES = ("runs", "source_images", "proposals", "objects", "observations", "decisions")


def six(spark, root):
    return {n: sorted(map(str, L.read_ledger(spark, root)[n].collect())) for n in TABLES}


class Stopped(Exception):
    pass


def test_killed_after_a_batch_and_started_again(spark, tmp_path, monkeypatch):
    folder, plug = folder_of(tmp_path), RUN.Plugins(segmenter(), embedder())
    RUN.run_directory(spark, str(tmp_path / "whole"), str(folder), plug, P, "run_1", AT)
    want = six(spark, str(tmp_path / "whole"))
    assert all(want.values()) and len(want["source_images"]) == 6
    write = RUN.BatchCommits.write
    root = str(tmp_path / "broken")

    def dies(self, batch_id, tables):
        if batch_id == 2:
            raise Stopped
        write(self, batch_id, tables)

    monkeypatch.setattr(RUN.BatchCommits, "write", dies)
    with pytest.raises(Stopped):
        RUN.run_directory(spark, root, str(folder), plug, P, "run_1", AT)
    assert not six(spark, root)["runs"] and six(spark, root)["decisions"]
    monkeypatch.setattr(RUN.BatchCommits, "write", write)

    def never():
        raise AssertionError("a recorded stage runs again")

    out = RUN.run_directory(spark, root, str(folder), RUN.Plugins(never, never), P, "run_1", AT)
    assert six(spark, root) == want and {r.status for r in out.collect()} == {"completed"}
    assert spark.read.json(f"{root}/reports").groupBy("section").count().count() == 3
    # A later run meets the objects of the first; content that is known is a duplicate.
    second = tmp_path / "more"
    second.mkdir()
    image(second, "same.png", json.loads((folder / "1.png").read_text()))
    image(second, "near.png", [["n", .97, (2, 2, 32, 6)]])
    objects = L.read_ledger(spark, root)["objects"].select("id").distinct().count()
    out = RUN.run_directory(spark, root, str(second), plug, P, "run_2", AT)
    assert [r.status for r in out.collect()] == ["completed"]
    t = L.read_ledger(spark, root)
    assert t["objects"].select("id").distinct().count() == objects and t["runs"].count() == 2
    assert t["decisions"].filter(F.col("decision") == "existing").count() >= 1


def test_failures_of_the_plug_ins(spark, tmp_path):
    folder = folder_of(tmp_path)
    image(folder, "bad.png", "no image")
    root = str(tmp_path / "ledger")
    RUN.run_directory(spark, root, str(folder), RUN.Plugins(segmenter(), embedder(bad_width=14.0)), P, "run_1", AT)
    t = L.read_ledger(spark, root)
    errors = {r.relative_path.rsplit("/", 1)[-1]: r.error_message for r in t["source_images"].filter("status = 'failed'").collect()}
    assert set(errors) == {"bad.png", "2.png"} and errors["2.png"] == "ValueError: no features" and errors["bad.png"].startswith("JSONDecodeError")
    assert [r.status for r in t["runs"].collect()] == ["completed_with_errors"]
    lost = t["proposals"].filter("status = 'failed'").collect()
    assert len(lost) == 1 and lost[0].error_message == "ValueError: no features"
    assert t["decisions"].count() == 5


def test_few_bad_rows_leave_the_others_in_large_batches(spark):
    def load():
        def model(pdf):
            if (pdf["score"] % 100 == 7).any():
                raise ValueError(f"no features of {pdf['id'].iloc[0]}" if len(pdf) == 1 else "batch")
            pdf["vector"], pdf["local"] = [[float(len(pdf))]] * len(pdf), [[[1.0]]] * len(pdf)
            return pdf
        return model

    rows = spark.range(2000).select(F.col("id").cast("string").alias("id"), F.lit("s").alias("source_id"), F.col("id").cast("double").alias("score"))
    out = R.guarded(rows.coalesce(1), load, RUN.FINGERPRINT_SQL, ("id", "source_id")).collect()
    bad = {r.id: r.error for r in out if r.error is not None}
    assert sorted(r.id for r in out) == sorted(map(str, range(2000)))
    assert bad == {str(i): f"ValueError: no features of {i}" for i in range(7, 2000, 100)}
    assert all(r.error_kind == "row" and r.vector is None for r in out if r.id in bad)
    assert sum(r.vector[0] > 10 for r in out if r.id not in bad) > 1500


def test_unloadable_function_fails_all_that_were_at_work(spark):
    def unloadable():
        raise RuntimeError("no weights")

    rows = spark.createDataFrame([("p1", "s1", .9), ("p2", "s2", .9)], "id string, source_id string, score double")
    prints = R.guarded(rows, unloadable, RUN.FINGERPRINT_SQL, ("id", "source_id"))
    assert {(r.id, r.error, r.error_kind) for r in prints.collect()} == {(i, "RuntimeError: no weights", "load") for i in ("p1", "p2")}
    kinds = "source_id string, error string, error_kind string"
    working = spark.createDataFrame([("s1",), ("s2",), ("s3",)], "source_id string")
    image = spark.createDataFrame([("s1", "ValueError: dark", "row"), ("s2", None, None)], kinds)
    found = RUN._source_errors(image, prints, working)
    assert {tuple(r) for r in found.collect()} == {("s1", "ValueError: dark"), ("s2", "RuntimeError: no weights")}
    found = RUN._source_errors(spark.createDataFrame([("s1", "RuntimeError: x", "load")], kinds), prints.limit(0), working)
    assert {tuple(r) for r in found.collect()} == {(s, "RuntimeError: x") for s in ("s1", "s2", "s3")}
