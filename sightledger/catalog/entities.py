"""Clustering, review, decisions and the end-to-end resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightledger.catalog.matching import EDGE_THRESHOLD, UNIT
from sightledger.catalog.registry import query
from sightledger.functions.vectors import slices
from sightledger.operators import clustering as K, commit as CM, review as R
from sightledger.operators.candidates import prepare
from sightledger.params import Params
from sightledger.plans import resolve as RS
from sightledger.session import materialize

P = Params(cluster_similarity=EDGE_THRESHOLD)

CLUSTERS = UNIT + f""",
n AS (SELECT id, source_id, u, row_number() OVER (ORDER BY id) AS pos, 0.5::DOUBLE + (vec_id % 50) / 100.0::DOUBLE AS score FROM unit),
edges AS (
  SELECT row_number() OVER (ORDER BY s DESC, i, j) AS e, i, j FROM (
    SELECT a.pos AS i, b.pos AS j, round(list_dot_product(a.u, b.u), 9) AS s FROM n a JOIN n b
    ON a.pos < b.pos AND a.source_id <> b.source_id WHERE list_dot_product(a.u, b.u) >= {EDGE_THRESHOLD})),
src AS (SELECT list(source_id ORDER BY pos) AS srcs, list(pos ORDER BY pos) AS lab0 FROM n),
walk AS (
  SELECT 0::BIGINT AS e, lab0 AS lab FROM src
  UNION ALL
  SELECT x.e, CASE WHEN lab[x.i] <> lab[x.j] AND NOT list_has_any(
      list_filter(srcs, lambda s, k: lab[k] = lab[x.i]), list_filter(srcs, lambda s, k: lab[k] = lab[x.j]))
    THEN list_transform(lab, lambda l: CASE WHEN l = lab[x.j] THEN lab[x.i] ELSE l END) ELSE lab END
  FROM walk w JOIN edges x ON x.e = w.e + 1, src),
fin AS (SELECT unnest(lab) AS label, generate_subscripts(lab, 1) AS pos FROM walk WHERE e = (SELECT count(*) FROM edges)),
mem AS (SELECT n.*, label FROM n JOIN fin USING (pos)),
named AS (SELECT label, 'clu_' || substr(sha256(string_agg(id, chr(10) ORDER BY id)), 1, 24) AS cluster_id,
            count(*) AS member_count, count(DISTINCT source_id) AS source_count FROM mem GROUP BY 1),
m AS (SELECT mem.*, cluster_id, member_count, source_count FROM mem JOIN named USING (label)),
pr AS (SELECT a.cluster_id, a.id AS ai, b.id AS bi, list_dot_product(a.u, b.u) AS s FROM m a JOIN m b ON a.cluster_id = b.cluster_id AND a.id < b.id),
cen AS (SELECT id, avg(s) AS c FROM (SELECT ai AS id, s FROM pr UNION ALL SELECT bi, s FROM pr) GROUP BY 1)
"""


def _members(v):
    labelled = materialize(K.constrained_clusters(v.fingerprints(), EDGE_THRESHOLD, P))
    return labelled.join(v.fingerprints().select("id", "score", "vector"), "id")


@query("constrained_clusters", f"WITH RECURSIVE {CLUSTERS} SELECT id, source_id, cluster_id FROM m")
def constrained_clusters(v):
    return K.constrained_clusters(v.fingerprints(), EDGE_THRESHOLD, P)


@query("cluster_stats", f"""
WITH RECURSIVE {CLUSTERS}
SELECT named.cluster_id, member_count, source_count, round(coalesce(min(s), 1.0), 6) AS sim_min,
  round(coalesce(avg(s), 1.0), 6) AS sim_mean, round(coalesce(max(s), 1.0), 6) AS sim_max
FROM named LEFT JOIN pr USING (cluster_id) GROUP BY ALL""")
def cluster_stats(v):
    s = K.cluster_stats(K.cluster_profile(_members(v), P))
    return s.select("cluster_id", "member_count", "source_count",
                    *[F.round(c, 6).alias(c) for c in ("sim_min", "sim_mean", "sim_max")])


@query("representatives", f"""
WITH RECURSIVE {CLUSTERS}
SELECT cluster_id, id, rank FROM (
  SELECT cluster_id, m.id, row_number() OVER (PARTITION BY cluster_id ORDER BY round(coalesce(c, 1.0), 9) DESC, score DESC, m.id) AS rank
  FROM m LEFT JOIN cen ON cen.id = m.id) WHERE rank <= 4""")
def representatives(v):
    return K.representatives(K.cluster_profile(_members(v), P), P.max_representatives).select("cluster_id", "id", "rank")


@query("assign_review_batches", """
WITH c AS (SELECT 'clu_' || l_orderkey AS cluster_id, count(*) AS member_count FROM lineitem GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY member_count DESC, cluster_id) AS position FROM c)
SELECT cluster_id, member_count, position, ((position - 1) // 8 + 1)::INT AS batch_id FROM r""")
def assign_review_batches(v):
    c = v.table("lineitem").groupBy(F.concat(F.lit("clu_"), F.col("l_orderkey").cast("string")).alias("cluster_id")).agg(
        F.count(F.lit(1)).alias("member_count"))
    return K.assign_review_batches(c, P.max_clusters_per_batch)


COMMIT = """
mem AS (SELECT 'clu_' || l_partkey AS cluster_id, l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey AS id,
          'src_' || l_orderkey AS source_id FROM lineitem),
res AS (SELECT 'clu_' || p_partkey AS cluster_id, (['new', 'existing', 'uncertain', 'ignored'])[(p_partkey % 4 + 1)::INT] AS decision,
          CASE WHEN p_partkey % 4 < 2 THEN 'obj_' || (p_partkey % 100) END AS object_id, p_size / 50.0::DOUBLE AS conf, p_name AS why FROM part),
f AS (SELECT cluster_id, min(id) AS first FROM mem GROUP BY 1),
dec AS (SELECT m.*, object_id, decision AS want, decision = 'new' AND id <> first AS joins,
          CASE WHEN decision = 'new' AND id <> first THEN 'existing' ELSE decision END AS decision,
          CASE WHEN decision = 'uncertain' THEN 0.0 ELSE conf END AS confidence
        FROM mem m JOIN f USING (cluster_id) JOIN res USING (cluster_id) WHERE decision <> 'ignored')
"""


def _commit(v):
    from pyspark.sql import Column
    k = F.col("p_partkey")
    decision: Column = F.element_at(F.array(*map(F.lit, ("new", "existing", "uncertain", "ignored"))), (k % 4 + 1).cast("int"))
    obj = F.when(k % 4 < 2, F.concat(F.lit("obj_"), (k % 100).cast("string")))
    resolved = v.table("part").select(
        F.concat(F.lit("clu_"), k.cast("string")).alias("cluster_id"), decision.alias("decision"), obj.alias("object_id"),
        F.struct((F.col("p_size") / 50.0).alias("summary_confidence"), F.col("p_name").alias("object_name_zh")).alias("object_summary"),
        F.lit("code").alias("reason_code"), F.lit("why").alias("decision_reason"), F.col("p_name").alias("short_reason"),
        F.lit("new").alias("identity_hypothesis"), obj.alias("matched_object_id"), F.lit("{}").alias("evidence"),
        F.lit("object").alias("verdict"), k.alias("position"))
    members = v.table("lineitem").select(
        F.concat(F.lit("clu_"), F.col("l_partkey").cast("string")).alias("cluster_id"),
        F.concat_ws("_", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).alias("id"),
        F.concat(F.lit("src_"), F.col("l_orderkey").cast("string")).alias("source_id"))
    return members, resolved


@query("cluster_member_decisions", f"""
WITH {COMMIT}
SELECT id AS proposal_id, cluster_id, source_id, decision, CASE WHEN decision = 'existing' THEN object_id END AS matched_object_id,
  confidence, CASE WHEN joins THEN 'cluster_member' ELSE 'code' END AS reason_code FROM dec""")
def cluster_member_decisions(v):
    return CM.cluster_member_decisions(*_commit(v)).select(
        "proposal_id", "cluster_id", "source_id", "decision", "matched_object_id", "confidence", "reason_code")


@query("observations_added", f"""
WITH {COMMIT}
SELECT 'obs_' || substr(sha256(id), 1, 32) AS id, object_id, id AS proposal_id, source_id FROM dec WHERE object_id IS NOT NULL""")
def observations_added(v):
    return CM.observations_of(CM.cluster_member_decisions(*_commit(v))).drop("cluster_id")


@query("object_changes", f"""
WITH {COMMIT}
SELECT object_id AS id, arg_max(why, replace(cluster_id, 'clu_', '')::INT) AS name, bool_or(decision = 'new') AS created
FROM res WHERE decision IN ('new', 'existing') GROUP BY 1""")
def object_changes(v):
    return CM.object_changes(_commit(v)[1]).select("id", F.col("summary.object_name_zh").alias("name"), "created")


@query("filter_cluster", f"""
WITH {COMMIT}
SELECT m.id AS proposal_id, m.source_id, cluster_id AS target_id, 'filtered' AS status, 'qwen_cluster_ignore:' || trim(why) AS filter_reason
FROM mem m JOIN res USING (cluster_id) WHERE decision = 'ignored'""")
def filter_cluster(v):
    return CM.filter_cluster(*_commit(v))


@query("cluster_source_results", f"""
WITH {COMMIT}
SELECT m.source_id, m.id AS proposal_id, m.cluster_id, CASE WHEN r.decision = 'ignored' THEN 'filtered' ELSE 'decided' END AS status,
  coalesce(d.decision, r.decision) AS decision, d.object_id, 'object' AS cluster_verdict
FROM mem m JOIN res r USING (cluster_id) LEFT JOIN dec d ON d.id = m.id""")
def cluster_source_results(v):
    members, resolved = _commit(v)
    d = CM.cluster_member_decisions(members, resolved)
    return CM.cluster_source_results(members, resolved, d, CM.observations_of(d)).select(
        "source_id", "proposal_id", "cluster_id", "status", "decision", "object_id", "cluster_verdict")


@query("commit_violations", f"""
WITH {COMMIT},
obj AS (SELECT 'obj_' || p_partkey AS id FROM part WHERE p_size % 5 <> 0),
ord AS (SELECT 'src_' || o_orderkey AS source_id FROM orders WHERE o_orderstatus = 'O'),
sto AS (SELECT l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey AS id FROM lineitem WHERE l_returnflag = 'A' AND l_orderkey % 40 = 0),
d2 AS (SELECT *, CASE WHEN replace(source_id, 'src_', '')::INT % 50 = 0 THEN 'new' ELSE decision END AS got FROM dec),
st AS (
  SELECT cluster_id, want, object_id, count(*) AS n, count(*) FILTER (WHERE got = 'new') AS nn, count(*) FILTER (WHERE got = 'existing') AS ne,
    count(*) FILTER (WHERE got = 'uncertain') AS nu, bool_or(source_id NOT IN (SELECT source_id FROM ord)) AS closed,
    bool_or(id IN (SELECT id FROM sto)) AS repeated FROM d2 GROUP BY ALL),
v AS (SELECT cluster_id, array_to_string(list_filter([
  CASE WHEN want = 'new' AND (nn <> 1 OR ne <> n - 1) THEN 'new_count' END,
  CASE WHEN want = 'existing' AND ne <> n THEN 'existing_count' END,
  CASE WHEN want = 'uncertain' AND nu <> n THEN 'uncertain_count' END,
  CASE WHEN want = 'existing' AND object_id NOT IN (SELECT id FROM obj) THEN 'object_not_active' END,
  CASE WHEN closed THEN 'source_not_processing' END, CASE WHEN repeated THEN 'proposal_already_stored' END], lambda c: c IS NOT NULL), ',') AS violations FROM st)
SELECT * FROM v WHERE violations <> ''""")
def commit_violations(v):
    members, resolved = _commit(v)
    d = CM.cluster_member_decisions(members, resolved)
    obs = CM.observations_of(d)
    odd = F.regexp_extract("source_id", r"(\d+)", 1).cast("int") % 50 == 0
    d = d.withColumn("decision", F.when(odd, "new").otherwise(F.col("decision")))
    # Decided proposals of some sources were written by an earlier commit.
    stored = v.proposals().filter((F.col("status") == "decided") & (F.regexp_extract("source_id", r"(\d+)", 1).cast("long") % 40 == 0)).select(
        F.substring_index("id", "prop_", -1).alias("id"))
    bad = CM.commit_violations(members, d, obs, resolved, v.objects(), v.source_images(), stored)
    return bad.select("cluster_id", F.array_join("violations", ",").alias("violations"))


@query("fail_propagation", """
WITH c AS (SELECT 'run_' || c_nationkey AS run_id, 'clu_' || c_custkey AS cluster_id, c_custkey // 50 AS batch_id, c_custkey AS k FROM customer),
e AS (SELECT run_id, min(batch_id) AS fb FROM c WHERE k % 97 = 0 GROUP BY 1)
SELECT c.run_id, cluster_id, batch_id, CASE WHEN batch_id >= fb THEN 'batch ' || fb WHEN k % 31 = 0 THEN 'apply ' || k END AS error
FROM c LEFT JOIN e ON e.run_id = c.run_id""")
def fail_propagation(v):
    k = F.col("c_custkey")
    c = v.table("customer").select(
        F.concat(F.lit("run_"), F.col("c_nationkey").cast("string")).alias("run_id"),
        F.concat(F.lit("clu_"), k.cast("string")).alias("cluster_id"), F.expr("c_custkey div 50").alias("batch_id"), k.alias("k"))
    batch_errors = c.filter(F.col("k") % 97 == 0).select(
        "run_id", "batch_id", F.concat(F.lit("batch "), F.col("batch_id").cast("string")).alias("error"))
    own = c.filter(F.col("k") % 31 == 0).select(
        "run_id", "cluster_id", F.concat(F.lit("apply "), F.col("k").cast("string")).alias("error"))
    return CM.fail_propagation(c.drop("k"), batch_errors, own)


@query("fail_fingerprints", """
WITH p AS (SELECT 'src_' || l_orderkey AS source_id, l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey AS id,
    CASE WHEN l_returnflag = 'N' THEN 'pending' ELSE 'decided' END AS status, l_quantity FROM lineitem),
e AS (SELECT source_id, arg_min('bad ' || id, id) AS err FROM p WHERE l_quantity > 45 GROUP BY 1)
SELECT p.source_id, id, CASE WHEN status = 'pending' AND err IS NOT NULL THEN 'failed' ELSE status END AS status,
  CASE WHEN status = 'pending' THEN err END AS error_message FROM p LEFT JOIN e ON e.source_id = p.source_id""")
def fail_fingerprints(v):
    p = v.table("lineitem").select(
        F.concat(F.lit("src_"), F.col("l_orderkey").cast("string")).alias("source_id"),
        F.concat_ws("_", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).alias("id"),
        F.when(F.col("l_returnflag") == "N", "pending").otherwise("decided").alias("status"), "l_quantity")
    errors = p.filter(F.col("l_quantity") > 45).select("source_id", "id", F.concat(F.lit("bad "), "id").alias("error"))
    return CM.fail_fingerprints(p.drop("l_quantity"), errors)


@query("fail_members", """
WITH m AS (SELECT 'run_' || (l_suppkey % 5) AS run_id, 'clu_' || l_partkey AS cluster_id,
    l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey AS id,
    CASE WHEN l_returnflag = 'N' THEN 'pending' WHEN l_returnflag = 'R' THEN 'filtered' ELSE 'decided' END AS status FROM lineitem),
f AS (SELECT 'clu_' || p_partkey AS cluster_id, 'run_' || (p_partkey % 5) AS run_id, CASE WHEN p_size < 20 THEN 'broken ' || p_size END AS error FROM part)
SELECT m.run_id, m.cluster_id, id, CASE WHEN status = 'pending' AND error IS NOT NULL THEN 'failed' ELSE status END AS status,
  CASE WHEN status = 'pending' THEN error END AS error_message
FROM m LEFT JOIN f ON f.run_id = m.run_id AND f.cluster_id = m.cluster_id""")
def fail_members(v):
    text = lambda c: F.col(c).cast("string")
    r = F.col("l_returnflag")
    m = v.table("lineitem").select(
        F.concat(F.lit("run_"), (F.col("l_suppkey") % 5).cast("string")).alias("run_id"),
        F.concat(F.lit("clu_"), text("l_partkey")).alias("cluster_id"),
        F.concat_ws("_", *map(text, ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))).alias("id"),
        F.when(r == "N", "pending").when(r == "R", "filtered").otherwise("decided").alias("status"))
    failed = v.table("part").select(
        F.concat(F.lit("run_"), (F.col("p_partkey") % 5).cast("string")).alias("run_id"),
        F.concat(F.lit("clu_"), text("p_partkey")).alias("cluster_id"),
        F.when(F.col("p_size") < 20, F.concat(F.lit("broken "), text("p_size"))).alias("error"))
    return CM.fail_members(m, failed)


@query("review_coverage", """
WITH c AS (SELECT c_custkey AS k, c_custkey // 8 AS batch_id, 'clu_' || c_custkey AS cluster_id FROM customer),
r AS (SELECT batch_id, cluster_id, k, CASE WHEN k % 5 = 0 THEN 'ignore' ELSE 'object' END AS verdict,
        CASE WHEN k % 5 = 0 THEN 'uncertain' WHEN k % 3 = 0 THEN 'existing' ELSE 'new' END AS hyp,
        CASE WHEN k % 5 <> 0 AND k % 3 = 0 THEN 'obj_' || (k % 60) END AS matched, k % 41 = 0 AND k % 5 <> 0 AS faulty
      FROM c WHERE k % 37 <> 0
      UNION ALL SELECT batch_id, cluster_id || CASE WHEN k % 2 = 0 THEN '' ELSE 'x' END, k, 'ignore', 'uncertain', NULL, false FROM c WHERE k % 53 = 0),
o AS (SELECT 'obj_' || n_nationkey * 2 AS oid FROM nation),
f AS (
  SELECT batch_id, bool_or(m) AS missing, bool_or(u) AS unexpected, bool_or(n > 1) AS rep FROM (
    SELECT coalesce(c.batch_id, s.batch_id) AS batch_id, s.cluster_id IS NULL AS m, c.cluster_id IS NULL AS u, coalesce(n, 0) AS n
    FROM c FULL JOIN (SELECT batch_id, cluster_id, count(*) AS n FROM r GROUP BY ALL) s USING (batch_id, cluster_id)) GROUP BY 1),
g AS (SELECT batch_id, bool_or(faulty) AS invalid, bool_or(matched IS NOT NULL AND matched NOT IN (SELECT oid FROM o)) AS unknown FROM r GROUP BY 1),
x AS (SELECT f.batch_id, array_to_string(list_filter([CASE WHEN missing THEN 'missing_cluster' END, CASE WHEN unexpected THEN 'unexpected_cluster' END,
  CASE WHEN rep THEN 'repeated_cluster' END, CASE WHEN invalid THEN 'invalid_review' END, CASE WHEN unknown THEN 'unknown_object' END],
  lambda z: z IS NOT NULL), ',') AS violations FROM f LEFT JOIN g USING (batch_id))
SELECT batch_id, violations, violations = '' AS accepted FROM x""")
def review_coverage(v):
    k = F.col("k")
    c = v.table("customer").select(F.col("c_custkey").alias("k"), F.expr("c_custkey div 8").alias("batch_id"),
                                   F.concat(F.lit("clu_"), F.col("c_custkey").cast("string")).alias("cluster_id"))
    empty = F.array().cast("array<string>")
    summary = F.struct(
        F.when(k % 41 == 0, "").otherwise("thing").alias("object_name_zh"), F.lit("a").alias("coarse_category"),
        F.lit("b").alias("fine_category"), F.lit("c").alias("stable_description"), empty.alias("stable_identity_features"),
        empty.alias("brand_or_markings"),
        F.from_json(F.lit("[]"), "array<struct<part:string,color:array<string>,material:array<string>>>").alias("part_appearance"),
        F.lit(0.5).alias("summary_confidence"))
    ignored = k % 5 == 0
    main = c.filter(k % 37 != 0).select(
        "batch_id", "cluster_id", F.when(ignored, "ignore").otherwise("object").alias("verdict"),
        F.when(ignored, "uncertain").when(k % 3 == 0, "existing").otherwise("new").alias("identity_hypothesis"),
        F.when(~ignored & (k % 3 == 0), F.concat(F.lit("obj_"), (k % 60).cast("string"))).alias("matched_object_id"),
        F.when(~ignored, summary).alias("object_summary"))
    extra = c.filter(k % 53 == 0).select(
        "batch_id", F.concat("cluster_id", F.when(k % 2 == 0, "").otherwise("x")).alias("cluster_id"),
        F.lit("ignore").alias("verdict"), F.lit("uncertain").alias("identity_hypothesis"),
        F.lit(None).cast("string").alias("matched_object_id"), F.when(F.lit(False), summary).alias("object_summary"))
    objects = v.table("nation").select(F.concat(F.lit("obj_"), (F.col("n_nationkey") * 2).cast("string")).alias("object_id"))
    out = R.review_coverage(main.unionByName(extra), c, objects, c.select("batch_id").distinct())
    return out.select("batch_id", F.array_join("violations", ",").alias("violations"), "accepted")


@query("parse_responses", """
WITH c AS (SELECT c_custkey AS k FROM customer)
SELECT k AS batch_id, CASE k % 4 WHEN 1 THEN 'schema_mismatch' WHEN 2 THEN 'no_json_object' WHEN 3 THEN 'schema_mismatch' END AS parse_error,
  CASE WHEN k % 4 = 0 THEN 1 END AS n, CASE WHEN k % 4 = 0 THEN 'clu_' || k END AS cluster_id FROM c""")
def parse_responses(v):
    k = F.col("c_custkey")
    good = F.concat(F.lit('{"reviews": [{"cluster_id": "clu_'), k.cast("string"),
                    F.lit('", "verdict": "ignore", "identity_hypothesis": "uncertain", "short_reason": "r"}]'))
    text = (F.when(k % 4 == 0, F.concat(F.lit("```json\n"), good, F.lit("}\n```")))
            .when(k % 4 == 1, '{"other": 1}').when(k % 4 == 2, "nothing")
            .otherwise(F.concat(good, F.lit(', "extra": 1}'))))
    out = R.parse_responses(v.table("customer").select(k.alias("batch_id"), text.alias("raw_text")))
    n = F.when(F.col("reviews").isNotNull(), F.size("reviews"))
    return out.select("batch_id", "parse_error", n.alias("n"), F.get("reviews", F.lit(0))["cluster_id"].alias("cluster_id"))


@query("review_prompts", """
WITH c AS (SELECT 'clu_' || c_custkey AS cluster_id, c_custkey + 1 AS position, (c_custkey // 8 + 1)::INT AS batch_id, c_custkey % 7 + 1 AS mc FROM customer)
SELECT batch_id, count(*) AS n, length(string_agg('CLUSTER ' || cluster_id || ':' || chr(10) ||
  to_json({'cluster_id': cluster_id, 'historical_visual_evidence': {'result': 'no_match'}, 'member_count': mc, 'source_count': 1})::VARCHAR,
  chr(10) ORDER BY position)) AS prompt_length FROM c GROUP BY 1""")
def review_prompts(v):
    k = F.col("c_custkey")
    c = v.table("customer").select(
        F.concat(F.lit("clu_"), k.cast("string")).alias("cluster_id"), (k + 1).alias("position"),
        (F.expr("c_custkey div 8") + 1).cast("int").alias("batch_id"), (k % 7 + 1).alias("member_count"), F.lit(1).alias("source_count"))
    ev = c.select("cluster_id", F.lit("no_match").alias("result"))
    out = R.review_prompt(R.cluster_payload(c, ev))
    return out.select("batch_id", F.size("cluster_ids").cast("long").alias("n"), F.length("prompt").cast("long").alias("prompt_length"))


@query("embed_candidates", """
SELECT count(*) AS n, round(sum((l_partkey % 90) * 1.0 + (l_suppkey % 80)), 3) AS total FROM lineitem""")
def embed_candidates(v):
    """The embedder plug-in with a stand-in model: box corner as a two-wide vector."""
    boxes = prepare(v.candidates(), P).select("id", F.col("bbox.x_min").alias("x"), F.col("bbox.y_min").alias("y"))

    def load():
        def run(pdf):
            pdf["vector"] = [[float(a), float(b)] for a, b in zip(pdf["x"], pdf["y"])]
            return pdf[["id", "vector"]]
        return run

    e = R.embed(boxes, load, "id string, vector array<float>")
    total = F.sum(F.get("vector", F.lit(0)) + F.get("vector", F.lit(1)))
    return e.agg(F.count(F.lit(1)).alias("n"), F.round(total.cast("double"), 3).alias("total"))


def _resolution(v):
    p = Params(cluster_similarity=EDGE_THRESHOLD, match_threshold=0.25, ambiguity_margin=0.02,
               local_patch_similarity=0.4)
    f = v.fingerprints().filter(F.col("vec_id") % 5 != 0).select(
        "id", "source_id", "score", "vector", slices("vector", 4, 16).alias("local"))
    history = v.history()
    empty = F.array().cast("array<string>")
    summary = F.struct(
        F.col("object_id").alias("object_name_zh"), F.lit("object").alias("coarse_category"), F.lit("object").alias("fine_category"),
        F.lit("stored").alias("stable_description"), empty.alias("stable_identity_features"), empty.alias("brand_or_markings"),
        F.from_json(F.lit("[]"), "array<struct<part:string,color:array<string>,material:array<string>>>").alias("part_appearance"),
        F.lit(0.8).alias("summary_confidence"))
    objects = history.select("object_id").distinct().select(
        F.col("object_id").alias("id"), summary.alias("summary"), F.lit("active").alias("status"))
    return RS.resolve_entities(f, history, objects, p, "run_1")


@query("resolve_entities")
def resolve_entities(v):
    """Flagship: fingerprints to clusters, reviews, decisions and objects."""
    return _resolution(v).outcomes
