"""Parameters, text extraction, validators, ranking, event states, gates."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sightledger.functions import jsontext, timing, validators as V
from sightledger.operators import events as E, summaries as SM
from sightledger.params import Params
from sightledger.session import distributed_row_number


def test_defaults_and_rules():
    p = Params()
    assert (p.confidence_threshold, p.min_mask_area_ratio, p.max_mask_area_ratio) == (.88, .0005, .5)
    assert (p.local_top_k, p.max_clusters_per_batch, p.max_representatives) == (3, 8, 4)
    for bad in (dict(global_weight=.6), dict(min_mask_area_ratio=.6), dict(points_per_side=1), dict(containment=0.0)):
        with pytest.raises(ValueError):
            Params(**bad)
    with pytest.raises(ValueError):
        Params.from_mapping({"unknown": 1})
    assert Params.from_mapping({"local_top_k": 5}).local_top_k == 5


@pytest.mark.parametrize("text,payload,error", [
    ('```json\n{"a": 1}\n```', {"a": 1}, None), ("[]", None, "not_an_object"), ('result: {"reviews": []} tail', {"reviews": []}, None),
    ("none", None, "no_json_object"), ("x {bad", None, "invalid_json"), ('  {"b": {"c": [1]}}  ', {"b": {"c": [1]}}, None),
    (None, None, "no_json_object"), ("", None, "no_json_object"), ('see {"a": "}{", "b": "\\\\\\""} and {"c": 1}', {"a": "}{", "b": '\\"'}, None),
    ("{'a': 1}", None, "invalid_json"), ('```\n[{"a": 1}]\n```', None, "not_an_object"), ('{"a": 1, "a": 2}', {"a": 2}, None), ("3", None, "not_an_object"),
])
def test_json_extraction(spark, text, payload, error):
    row = spark.createDataFrame([(text,)], "t string").select(jsontext.extract_json_object("t").alias("x")).first().x
    assert (row.payload and json.loads(row.payload), row.error) == (payload, error)


def test_paths(spark):
    cases = {"sources/a.png": (True, True), "/sources/a.png": (False, False), "a/../b.png": (False, False), "a\\b.png": (False, False),
             "": (False, False), "other/a.png": (True, False), "sources/a.txt": (True, False), "objects/x/y.JPG": (True, True), "..": (False, False)}
    df = spark.createDataFrame([(k,) for k in cases], "p string").select(
        "p", V.valid_asset_path(F.col("p")).alias("v"), V.allowed_image(F.col("p")).alias("i"))
    assert {r.p: (r.v, r.i) for r in df.collect()} == cases


def test_elapsed(spark):
    rows = [("2024-01-01T01:00:00+00:00", "2024-01-01T01:00:12.5+00:00"), ("2024-01-01 01:00:00", "2024-01-01 00:00:00"), ("bad", "2024-01-01"), (None, None)]
    df = spark.createDataFrame(rows, "a string, b string").select(timing.elapsed_seconds(F.col("a"), F.col("b")).alias("e"))
    assert [r.e for r in df.collect()] == [12.5, 0.0, None, None]


def test_stage_percent(spark):
    rows = [("clustering", "running", 0, 2, 70.0), ("sam3", "running", 0, 0, 10.0), ("sam3", "skipped", 0, 0, 40.0), ("other", "x", 1, 1, 0.0), ("report", "running", 1, 2, 97.5)]
    df = spark.createDataFrame(rows, "stage string, status string, current int, total int, want double")
    out = df.withColumn("p", timing.stage_percent(F.col("stage"), F.col("status"), F.col("current"), F.col("total")))
    assert all(r.p == r.want for r in out.collect())


@pytest.mark.parametrize("keys", [["k"], []])
def test_distributed_row_number(spark, keys):
    rng = random.Random(3)
    rows = [("hot" if i % 3 else f"k{i % 7}", rng.randrange(50), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, v int, id int")
    got = {r.id: r.n for r in distributed_row_number(df, keys, [F.desc("v"), F.asc("id")], "n", bound=100).collect()}
    want, seen = {}, {}
    for k, v, i in sorted(rows, key=lambda r: (-r[1], r[2])):
        g = k if keys else ""
        seen[g] = seen.get(g, 0) + 1
        want[i] = seen[g]
    assert got == want


def test_monotonic_percent_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(E, "SEQUENCE_BLOCK", 7)
    rng = random.Random(4)
    pct = [rng.random() * 100 for _ in range(60)]
    df = spark.createDataFrame([("r", i + 1, p) for i, p in enumerate(pct)], "run_id string, sequence long, overall_percent double").select(
        "*", F.lit("sam3").alias("stage"), F.lit("running").alias("status"), F.lit(0).alias("current"), F.lit(0).alias("total"))
    got = [r.percent for r in E.monotonic_percent(df).orderBy("sequence").collect()]
    assert got == [round(max(pct[:i + 1]), 3) for i in range(60)]


def test_terminal_states(spark):
    states = spark.createDataFrame([("ok", "cli_completed", "passed"), ("bad", "cli_completed", "failed"), ("gone", "progress", "running"),
                                    ("formal", "progress", "running"), ("fake", "progress", "passed")],
                                   "run_id string, last_event string, stage_status string").withColumn("last_event_at", F.current_timestamp())
    reports = spark.createDataFrame([("formal", "completed_with_errors"), ("bad", "failed"), ("fake", "passed")], "run_id string, status string")
    got = {r.run_id: (r.status, r.result_status, r.unexpected_exit) for r in E.terminal_state(states, reports).collect()}
    assert got == {"ok": ("completed", "passed", False), "bad": ("failed", "failed", False), "gone": ("failed", None, True),
                   "formal": ("failed", "completed_with_errors", False), "fake": ("failed", None, True)}


def test_image_merge_bridges_aliases(spark):
    rows = [("r", 1, "a.png", None, "seen", None), ("r", 2, None, "src_1", None, 3), ("r", 3, "a.png", "src_1", None, None),
            ("r", 4, "b.png", None, "other", 1), ("r", 5, None, "src_1", "done", None)]
    df = spark.createDataFrame(rows, "run_id string, sequence long, input_path string, source_id string, status string, kept int")
    got = sorted((r.input_path, r.source_id, r.status, r.kept) for r in E.image_state_merge(df, ["status", "kept"]).collect())
    assert got == sorted([("a.png", "src_1", "done", 3), ("b.png", None, "other", 1)], key=str)


def test_coverage_gates(spark):
    base = dict(run_id="r", status="passed", decisions_new=2, active_objects_total=2, decisions_existing=1, duplicate_sources_skipped=1,
                proposals_pending=0, proposals_failed=0, proposals_filtered=0)
    changes = [{}, dict(decisions_new=1), dict(decisions_existing=0), dict(active_objects_total=1), dict(duplicate_sources_skipped=0),
               dict(proposals_pending=1), dict(proposals_failed=1), dict(status="completed_with_errors")]
    rows = [{**base, **c, "run_id": f"r{i}"} for i, c in enumerate(changes)]
    got = {r.run_id: (r.status, r.pipeline_status) for r in SM.coverage_gates(spark.createDataFrame(rows)).collect()}
    assert got["r0"] == ("passed", None) and all(got[f"r{i}"][0] == "failed" for i in range(1, 8))
    assert got["r1"][1] == "passed" and got["r7"][1] == "completed_with_errors"


def test_raw_counts_differ_on_zero(spark):
    images = spark.createDataFrame([("r", 0, 5, 9, 1, 1, False)], "run_id string, raw_candidates int, grid_points int, "
                                   "above_confidence_threshold_candidates int, kept int, filtered int, duplicate boolean")
    rep = spark.createDataFrame([("r", "passed", None, 1, 1)], "run_id string, status string, duplicate_sources_skipped long, observations_added long, active_objects_total long")
    clu = spark.createDataFrame([], "run_id string, reviewed boolean, final_decision string")
    counts = spark.createDataFrame([(r, k, s, n) for r in [rep.first().run_id] for k, s, n in (
        ("source", "completed", 3), ("source", "failed", 1), ("proposal", "filtered", 7), ("decision", "new", 2))],
        "run_id string, kind string, status string, n long")
    errors = spark.createDataFrame([], "run_id string, section int, item long, field int, position long, source string, type string, message string")
    out = SM.result_summary(rep, images, clu, counts, errors).first()
    assert out.raw_candidates == 5 and out.unique_sources == 4 and out.source_counts == {"completed": 3, "failed": 1} and out.error_count == 0
    out = SM.report_metrics(rep, images, clu, counts).first()
    assert (out.raw_candidates, out.filtered, out.new_count, out.failed_proposals) == (0, 7, 2, 0)


def test_upload_name_rules(spark):
    df = spark.createDataFrame([("ok-1.PNG",), ("a b.png",), ("../x.png",), ("x.gif",), ("x",), (".png",)], "name string")
    bad = V.upload_codes(F.col("name"), F.lit(1), F.lit(1), F.lit(False), F.lit(False))
    got = {r.name: r.v for r in df.select("name", bad.alias("v")).collect()}
    assert got["ok-1.PNG"] == [] and got["x.gif"] == ["suffix_not_allowed"] and "name_invalid" in got["a b.png"]
    assert "name_invalid" in got["../x.png"] and "suffix_not_allowed" in got["x"]
