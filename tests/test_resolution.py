"""Review loop, commits and end to end, with a brute-force twin of the snapshot rule."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightledger.operators import commit as CM
from sightledger.operators import review as R
from sightledger.params import Params
from sightledger.plans import resolve as RS

SUMMARY = ("struct<object_name_zh:string,coarse_category:string,fine_category:string,stable_description:string,"
           "stable_identity_features:array<string>,brand_or_markings:array<string>,"
           "part_appearance:array<struct<part:string,color:array<string>,material:array<string>>>,summary_confidence:double>")


def inputs(spark, rows):
    fp = spark.createDataFrame(
        [(i, s, .9, [float(x) for x in v], [[float(x) for x in v]]) for i, s, v in rows],
        "id string, source_id string, score double, vector array<float>, local array<array<float>>")
    history = spark.createDataFrame([], "object_id string, observation_id string, vector array<float>, local array<array<float>>")
    objects = spark.createDataFrame([], f"id string, summary {SUMMARY}, status string")
    return fp, history, objects


def test_two_views_make_one_object(spark):
    res = RS.resolve_entities(*inputs(spark, [("p1", "s1", (1, 0)), ("p2", "s2", (1, .01))]), Params(), "run_1")
    assert [r.decision for r in res.decisions.orderBy("proposal_id").collect()] == ["new", "existing"]
    assert res.observations.count() == 2 and res.objects.count() == 1
    d = res.decisions.orderBy("proposal_id").collect()
    assert d[0].matched_object_id is None and d[1].matched_object_id == d[1].object_id and d[1].reason_code == "cluster_member"


def test_same_source_makes_two_objects(spark):
    res = RS.resolve_entities(*inputs(spark, [("p1", "s1", (1, 0)), ("p2", "s1", (1, 0))]), Params(), "run_1")
    assert res.objects.count() == 2  # one batch: both see the same snapshot


def test_later_batches_see_earlier_objects(spark):
    rows = [("p1", "s1", (1, 0)), ("p2", "s1", (1, 0)), ("p3", "s1", (0, 1))]
    res = RS.resolve_entities(*inputs(spark, rows), Params(max_clusters_per_batch=1), "run_1")
    out = {r.proposal_id: r.decision for r in res.outcomes.collect()}
    assert sorted(out.values()) == ["existing", "new", "new"] and res.objects.filter("version > 0").select("id").distinct().count() == 2


def test_empty_run(spark):
    res = RS.resolve_entities(*inputs(spark, []), Params(), "run_1")
    assert all(df.count() == 0 for df in (res.clusters, res.decisions, res.observations, res.filtered, res.outcomes))


def test_reviewer_error_fails_its_batch_and_later_ones(spark):
    rows = [("p1", "s1", (1, 0)), ("p2", "s1", (0, 1)), ("p3", "s1", (-1, 0))]
    calls = []

    def shaky(clusters, objects):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("no answer")
        return RS.rule_reviewer(clusters, objects)

    res = RS.resolve_entities(*inputs(spark, rows), Params(max_clusters_per_batch=1), "run_1", shaky)
    assert sorted(r.status for r in res.outcomes.collect()) == ["decided", "failed", "failed"] and len(calls) == 2
    assert {r.error for r in res.outcomes.collect()} == {None, "reviewer_error:RuntimeError"}

    def broken(clusters, objects):
        raise ValueError("down")

    res = RS.resolve_entities(*inputs(spark, rows), Params(), "run_1", broken)
    full = RS.resolve_entities(*inputs(spark, rows), Params(), "run_1")
    for name in ("decisions", "observations", "filtered"):
        assert getattr(res, name).count() == 0
        assert getattr(res, name).dtypes == getattr(full, name).dtypes


def test_versions_go_on_from_the_stored_ones(spark):
    fp, history, _ = inputs(spark, [("p1", "s1", (1, 0))])
    objects = spark.createDataFrame([("o", 7, None, "active")], f"id string, version long, summary {SUMMARY}, status string")
    history = spark.createDataFrame([("o", "v", [1.0, 0.0], [[1.0, 0.0]])], history.schema)
    res = RS.resolve_entities(fp, history, objects, Params(), "run_2")
    assert {r.version for r in res.objects.collect()} == {7, 8}


def test_ignore_and_rejected_batch(spark):
    rows = [("p1", "s1", (1, 0)), ("p2", "s2", (0, 1))]

    def ignore(clusters, objects):
        return RS.rule_reviewer(clusters, objects).withColumn("verdict", F.lit("ignore")).withColumn(
            "identity_hypothesis", F.lit("uncertain")).withColumn("matched_object_id", F.lit(None).cast("string")).withColumn(
            "object_summary", F.when(F.lit(False), F.col("object_summary"))).withColumn("short_reason", F.lit(" wall "))

    res = RS.resolve_entities(*inputs(spark, rows), Params(), "run_1", ignore)
    assert {r.filter_reason for r in res.filtered.collect()} == {"qwen_cluster_ignore:wall"}
    assert {r.status for r in res.outcomes.collect()} == {"filtered"}

    seen = []

    def partial(clusters, objects):
        seen.append(1)
        good = RS.rule_reviewer(clusters, objects)
        return good if len(seen) == 1 else good.limit(0)

    res = RS.resolve_entities(*inputs(spark, rows + [("p3", "s3", (1, 1))]), Params(max_clusters_per_batch=1, cluster_similarity=.99), "run_1", partial)
    out = [r.final_decision for r in res.clusters.orderBy("batch_id").collect()]
    assert out == ["new", "failed", "failed"]  # the bad batch and all later ones


def brute(rows, size, p):
    """Sequential review with the rule reviewer; clusters are singletons (one source)."""
    import hashlib
    cid = lambda i: "clu_" + hashlib.sha256(i.encode()).hexdigest()[:24]
    unit = {i: np.asarray(v, dtype=np.float32).astype(float) / np.linalg.norm(np.asarray(v, dtype=np.float32).astype(float)) for i, _, v in rows}
    order = sorted(unit, key=cid)
    views, out = {}, {}
    for lo in range(0, len(order), size):
        snapshot = {o: list(v) for o, v in views.items()}
        for i in order[lo:lo + size]:
            best = sorted((-max(round(float(unit[i] @ w), 9) for w in v), o) for o, v in snapshot.items())[: p.local_top_k]
            scores = sorted((-(0.5 * -g + 0.5 * float(-g >= p.local_patch_similarity)), o) for g, o in best)
            if not scores or -scores[0][0] < p.match_threshold:
                out[i] = "new"
                views["new_" + i] = [unit[i]]
            elif len(scores) > 1 and scores[1][0] - scores[0][0] < p.ambiguity_margin:
                out[i] = "uncertain"
            else:
                out[i] = "existing"
                views[scores[0][1]].append(unit[i])
    return out


@pytest.mark.parametrize("size", [4])
def test_review_loop_against_brute_force(spark, size):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(4, 5))
    rows = [(f"p{i:02d}", "s1", centres[i % 4] + .25 * rng.normal(size=5)) for i in range(14)]
    p = Params(max_clusters_per_batch=size, match_threshold=.8)
    res = RS.resolve_entities(*inputs(spark, rows), p, "run_1")
    assert {r.proposal_id: r.decision for r in res.outcomes.collect()} == brute(rows, size, p)


def test_from_raw_candidates(spark):
    from test_candidates import frame

    rows = [("a", .95, (5, 5, 25, 25)), ("dup", .9, (5, 5, 25, 25)), ("b", .94, (30, 30, 38, 38))]
    cand = frame(spark, rows, 40, 40, "s1").unionByName(frame(spark, rows[:1], 40, 40, "s2"))

    def load():
        def run(pdf):
            w = pdf["x_max"] - pdf["x_min"]
            pdf["vector"] = [[float(a), 8.0] for a in w]
            pdf["local"] = [[[float(a), 8.0]] for a in w]
            return pdf[["id", "source_id", "score", "vector", "local"]]
        return run

    _, history, objects = inputs(spark, [])
    processed, res = RS.resolve_candidates(cand, load, history, objects, Params(cluster_similarity=.95), "run_1")
    assert processed.filter("status = 'filtered'").count() == 1
    assert sorted(r.decision for r in res.decisions.collect()) == ["existing", "new", "new"]


def test_close_run(spark):
    sources = spark.createDataFrame([("s1", "r", "processing"), ("s2", "r", "processing"), ("s3", "r", "failed")],
                                    "id string, run_id string, status string")
    outcomes = spark.createDataFrame([("p1", "s1", "decided"), ("p2", "s2", "failed")], "id string, source_id string, status string")
    runs = spark.createDataFrame([("r", "running")], "id string, status string")
    src, run = RS.close_run(sources, outcomes, runs)
    assert {r.id: r.final_status for r in src.collect()} == {"s1": "completed", "s2": "failed", "s3": "failed"}
    assert run.first().final_status == "completed_with_errors"


def test_commit_violations(spark):
    members = spark.createDataFrame([("c", "p1", "s1"), ("c", "p2", "s2"), ("d", "p3", "s1")], "cluster_id string, id string, source_id string")
    resolved = spark.createDataFrame([("c", "new", "o1"), ("d", "existing", "gone")], "cluster_id string, decision string, object_id string")
    good = [("p1", "new", None), ("p2", "existing", "o1"), ("p3", "existing", "gone")]
    obs = [("p1", "s1", "o1"), ("p2", "s2", "o1"), ("p3", "s9", "gone")]
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    sources = df([("s1", "processing"), ("s2", "completed")], "id string, status string")
    objects = df([("o0", "active")], "id string, status string")
    stored = df([("p3",)], "id string")
    out = {r.cluster_id: r.violations for r in CM.commit_violations(
        members, df(good, "proposal_id string, decision string, matched_object_id string"),
        df(obs, "proposal_id string, source_id string, object_id string"), resolved, objects, sources, stored).collect()}
    assert out["c"] == ["source_not_processing"]
    assert out["d"] == ["object_not_active", "observation_wrong_source", "proposal_already_stored"]


def test_review_acceptance(spark):
    def verdicts(text, expected=("clu_a",), objects=()):
        responses = spark.createDataFrame([(1, text)], "batch_id int, raw_text string")
        parsed = R.parse_responses(responses)
        reviews = parsed.select("batch_id", F.explode("reviews").alias("r")).select("batch_id", "r.*")
        cards = spark.createDataFrame([(o,) for o in objects], "object_id string")
        exp = spark.createDataFrame([(1, c) for c in expected], "batch_id int, cluster_id string")
        row = R.review_coverage(reviews, exp, cards, exp.select("batch_id").distinct()).first()
        return parsed.first().parse_error, row and row.violations

    item = '{"cluster_id": "clu_a", "verdict": "%s", "identity_hypothesis": "%s", "matched_object_id": %s, "short_reason": "r", "object_summary": %s}'
    summary = ('{"object_name_zh": "x", "coarse_category": "x", "fine_category": "x", "stable_description": "x", '
               '"stable_identity_features": [], "brand_or_markings": [], "part_appearance": [], "summary_confidence": 0.5}')
    doc = lambda *a: '{"reviews": [%s]}' % (item % a)
    assert verdicts(doc("ignore", "uncertain", "null", "null")) == (None, [])
    assert verdicts(doc("ignore", "uncertain", "null", "null"), ("clu_a", "clu_b"))[1] == ["missing_cluster"]
    assert verdicts(doc("object", "existing", '"obj_x"', summary), objects=("obj_a",))[1] == ["unknown_object"]
    assert verdicts(doc("object", "existing", '"obj_x"', summary))[1] == ["unknown_object", "must_be_new"]
    assert verdicts("[]")[0] == "not_an_object" and verdicts('result: {"reviews": []}', ())[0] is None


def test_user_reviewer_is_called_once_per_batch(spark):
    c = spark.createDataFrame([(f"c{i}", i + 1, i // 2 + 1, 1, 1) for i in range(5)],
                              "cluster_id string, position long, batch_id int, member_count int, source_count int")
    ev = c.select("cluster_id", F.lit("no_match").alias("result"))
    out = R.review(R.cluster_payload(c, ev), lambda prompt, ids: f"{prompt.count('CLUSTER')}:{','.join(ids)}")
    assert sorted(r.raw_text for r in out.collect()) == ["1:c4", "2:c0,c1", "2:c2,c3"]
    assert R.score_batches(c, lambda it: it, c.schema).count() == 5
