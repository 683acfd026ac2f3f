"""commit_violations counts distinct proposals without carrying every column to a second shuffle."""

from sightledger.operators import commit as CM


def test_repeated_proposals_and_closed_sources(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    members = frame([("c1", "p1", "s1"), ("c1", "p1", "s2"), ("c2", "p1", "s1"), ("c2", "p2", "s3"), ("c3", "p4", "s1")],
                    "cluster_id string, id string, source_id string")
    decisions = frame([(p, "uncertain", None) for p in ("p1", "p2", "p4")], "proposal_id string, decision string, matched_object_id string")
    none = frame([], "proposal_id string, source_id string, object_id string")
    resolved = frame([(c, "uncertain", None) for c in ("c1", "c2", "c3")], "cluster_id string, decision string, object_id string")
    objects = frame([("o1", "active")], "id string, status string")
    sources = frame([("s1", "processing"), ("s2", "processing"), ("s3", "completed")], "id string, status string")
    bad = CM.commit_violations(members, decisions, none, resolved, objects, sources, frame([("p2",)], "id string"))
    assert {r.cluster_id: list(r.violations) for r in bad.collect()} == {
        "c1": ["proposals_not_unique"], "c2": ["source_not_processing", "proposal_already_stored"]}
    assert "distinct " not in bad._jdf.queryExecution().optimizedPlan().toString()
