"""Sources, sinks and streaming."""

import json
import os

import pytest
from pyspark.sql import functions as F, types as T

from sightledger.operators import registration as G
from sightledger.sources import assets, events, fingerprints, ledger, legacy, reports, responses
from sightledger.streaming import live


def test_scan_and_inventory(spark, tmp_path):
    for name, body in (("first.png", b"x"), ("second.PNG", b"x"), ("sub/third.webp", b"y"), ("note.txt", b"z")):
        f = tmp_path / name
        f.parent.mkdir(exist_ok=True)
        f.write_bytes(body)
    files = assets.scan_assets(spark, str(tmp_path))
    assert sorted(r.path for r in files.collect()) == ["first.png", "second.PNG", "sub/third.webp"]
    inv = {r.path: r for r in G.asset_inventory(files).collect()}
    assert inv["second.PNG"].duplicate_of == "first.png" and not inv["first.png"].is_duplicate
    c = G.inventory_counts(G.asset_inventory(files)).first()
    assert (c.total, c.unique, c.duplicates) == (3, 2, 1)
    empty = tmp_path / "none"
    empty.mkdir()
    (empty / "a.txt").write_text("a")
    with pytest.raises(ValueError):
        assets.scan_assets(spark, str(empty))


def test_registration_ladder(spark):
    old = spark.createDataFrame([("a", "r0", "completed"), ("b", "r0", "failed"), ("c", "r1", "failed"), ("d", "r1", "processing")],
                                "sha256 string, run_id string, status string")
    inc = spark.createDataFrame([(i, h, "r1") for i, h in enumerate("abcdec" + "e")], "ordinal int, sha256 string, run_id string")
    got = {r.ordinal: r.outcome for r in G.register_sources(inc, old).collect()}
    assert got == {0: "duplicate", 1: "conflict", 2: "resumed", 3: "duplicate", 4: "new", 5: "duplicate", 6: "duplicate"}


LINES = ['{"sequence": 1, "event": "a", "stage": "sam3", "run_id": "r"}', "", "   ", "{broken", "[1]", '"text"',
         '{"sequence": "7", "event": "x", "run_id": "r"}', '{"sequence": 2, "event": "b", "stage": "", "run_id": "r"}', '{"event": "none"}']


def test_events_read_write_and_cursor(spark, tmp_path):
    log = tmp_path / "log.jsonl"
    log.write_text("\n".join(LINES))
    assert [r.sequence for r in events.read_events(spark, str(log)).collect()] == [1, 2]
    assert [r.sequence for r in events.read_events(spark, str(log), 1).collect()] == [2]
    out = str(tmp_path / "out")
    events.write_events(events.read_events(spark, str(log)), out)
    assert [r.event for r in events.read_events(spark, out).collect()] == ["a", "b"]
    with pytest.raises(Exception):
        events.write_events(events.read_events(spark, str(log)), out)


def test_event_stream_keeps_state_over_restarts(spark, tmp_path):
    src, state, ck = tmp_path / "in", str(tmp_path / "state"), str(tmp_path / "ck")
    src.mkdir()
    (src / "1.jsonl").write_text("\n".join(LINES))
    run = lambda: live.start_live_state(events.stream_events(spark, str(src)), state, ck, True).awaitTermination()
    run()
    (src / "2.jsonl").write_text('{"sequence": 3, "event": "cli_completed", "stage": "cli", "status": "passed", "run_id": "r"}')
    run()
    last = spark.read.parquet(state).orderBy(F.desc("batch_id")).first()
    assert (last.last_sequence, last.last_event, last.stage) == (3, "cli_completed", "cli")


def test_incremental_ingestion(spark, tmp_path):
    known, src = str(tmp_path / "known"), tmp_path / "in"
    spark.createDataFrame([("a", "r0", "completed")], "sha256 string, run_id string, status string").write.parquet(f"{known}/batch_id=-1")
    schema = T.StructType([T.StructField("ordinal", T.LongType()), T.StructField("sha256", T.StringType())])
    incoming = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src))
    src.mkdir()
    (src / "1.json").write_text("\n".join(json.dumps({"ordinal": i, "sha256": h}) for i, h in enumerate("aabb")))
    go = lambda: live.start_ingestion(incoming(), known, str(tmp_path / "ck"), "r1", True).awaitTermination()
    go()
    (src / "2.json").write_text("\n".join(json.dumps({"ordinal": i, "sha256": h}) for i, h in enumerate("abc")))
    go()
    assert sorted(r.sha256 for r in spark.read.parquet(known).collect()) == ["a", "b", "c"]


def test_ingestion_resolves_and_resumes(spark, tmp_path):
    known, src = str(tmp_path / "known"), tmp_path / "in"
    spark.createDataFrame([("z", "r0", "completed")], "sha256 string, run_id string, status string").write.parquet(f"{known}/batch_id=-1")
    schema = T.StructType([T.StructField("ordinal", T.LongType()), T.StructField("sha256", T.StringType())])
    src.mkdir()
    seen, state = [], {"status": "failed"}

    def process(rows, batch_id):
        seen.append(sorted((r.sha256, r.outcome) for r in rows.collect()))
        return rows.select("sha256", F.lit(state["status"]).alias("status"))

    for i, status in enumerate(("failed", "completed", "completed")):
        (src / f"{i}.json").write_text(json.dumps({"ordinal": i, "sha256": "a"}))
        state["status"] = status
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src))
        live.start_ingestion(stream, known, str(tmp_path / "ck"), "r1", True, process).awaitTermination()
    # New, then taken up again once, then known: never twice although two rows are stored.
    assert seen == [[("a", "new")], [("a", "resumed")], []]


def test_responses_current_and_legacy(spark, tmp_path):
    new = {"stage": "cluster_semantic_review", "batch_id": "cluster_batch_0001", "cluster_ids": ["c"], "error": None,
           "response": {"reviews": [{"cluster_id": "c", "verdict": "ignore", "identity_hypothesis": "uncertain", "short_reason": "r"}]},
           "predictions": [{"raw_text": "{}", "input_tokens": 3, "generated_tokens": 2, "inference_seconds": 1.5}]}
    old = {"stage": "candidate_reasoning", "expected_proposal_ids": ["p"], "predictions": [
        {"raw_text": "{}", "input_tokens": 5, "generated_tokens": 1, "inference_seconds": 0.5}] * 2}
    for scope, doc in (("cluster_batch_0001", new), ("src_1", old)):
        d = tmp_path / "run_1" / scope
        d.mkdir(parents=True)
        (d / "response.json").write_text(json.dumps(doc, indent=2))
    df = responses.read_responses(spark, str(tmp_path))
    assert {(r.run_id, r.scope) for r in df.collect()} == {("run_1", "cluster_batch_0001"), ("run_1", "src_1")}
    assert responses.response_predictions(df).agg(F.sum("input_tokens")).first()[0] == 13
    assert [r.verdict for r in responses.response_reviews(df).collect()] == ["ignore"]


def test_fingerprint_round_trip_and_reject(spark, tmp_path):
    df = spark.createDataFrame([("p1", "s", [3.0, 4.0], [[1.0, 0.0]], [(0, 1)]), ("p2", "s", [0.1, 0.2], [], [])],
                               "proposal_id string, source_id string, vector array<float>, local array<array<float>>, patch_rc array<struct<r:int,c:int>>")
    q = fingerprints.quantise(df, "m", "0" * 40, "last", 512)
    path = str(tmp_path / "fp")
    fingerprints.write_fingerprints(q, path)
    good, bad = fingerprints.read_fingerprints(spark, path)
    rows = {r.proposal_id: r for r in good.collect()}
    assert bad.count() == 0 and [round(x, 6) for x in rows["p1"].vector] == [.6, .8] and rows["p1"].local_count == 1
    fingerprints.write_fingerprints(q.withColumn("sha256", F.lit("f" * 64)), str(tmp_path / "broken"))
    good, bad = fingerprints.read_fingerprints(spark, str(tmp_path / "broken"))
    assert good.count() == 0 and {r.reject_reason for r in bad.collect()} == {"hash_mismatch"}


def test_ledger_commits_are_all_or_nothing(spark, tmp_path):
    root = str(tmp_path / "ledger")
    with pytest.raises(ledger.LedgerError):
        ledger.read_ledger(spark, root)
    ledger.init_ledger(spark, root)
    runs = spark.createDataFrame([("run_1", "running")], "id string, status string")
    ledger.write_commit(spark, root, "k1", {"runs": runs})
    # A half-written commit: rows without marker.
    runs.select("id", "status", F.lit("k2").alias("commit_id"), F.lit("lost").alias("write_attempt")).write.mode("append").partitionBy(
        "write_attempt").parquet(f"{root}/runs")
    tables = ledger.read_ledger(spark, root)
    assert [r.id for r in tables["runs"].collect()] == ["run_1"] and tables["decisions"].count() == 0
    # Trying the commit again publishes only its own rows, and a published one is left alone.
    more = spark.createDataFrame([("run_2", "running")], "id string, status string")
    for _ in range(2):
        ledger.write_commit(spark, root, "k2", {"runs": more})
    assert sorted(r.id for r in ledger.read_ledger(spark, root)["runs"].collect()) == ["run_1", "run_2"]
    with pytest.raises(ledger.LedgerError):
        ledger.write_commit(spark, root, "k3", {"other": runs})
    spark.createDataFrame([(9,)], "version int").write.mode("overwrite").parquet(f"{root}/_meta")
    with pytest.raises(ledger.LedgerError):
        ledger.read_ledger(spark, root)


def test_report_sections_round_trip(spark, tmp_path):
    runs = spark.createDataFrame([("r1", "passed"), ("r2", "failed")], "run_id string, status string")
    images = spark.createDataFrame([("r1", "a", 3), ("r1", "b", 4)], "run_id string, source_id string, kept int")
    clusters = spark.createDataFrame([("r2", "c")], "run_id string, cluster_id string")
    path = str(tmp_path / "rep")
    reports.write_report(reports.report_sections(runs, images, clusters), path)
    img = reports.read_report(spark, path, "image", T.StructType([T.StructField("kept", T.IntegerType())]), "r1")
    assert sorted(r.kept for r in img.collect()) == [3, 4]
    assert os.path.isdir(os.path.join(path, "run_id=r1"))


def test_legacy_objects(spark):
    rows = spark.createDataFrame([("o1", "active", '["steel"]', "[]", "d", .5), ("o2", "active", "bad", None, "d", .5)],
                                 "id string, status string, material_json string, color_json string, description string, annotation_confidence double")
    got = {r.id: r for r in legacy.read_legacy_objects(rows).collect()}
    assert got["o1"].part_appearance[0].part == "整体（旧版）" and got["o2"].part_appearance == [] and got["o2"].material == []
