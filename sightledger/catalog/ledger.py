"""Ledger joins, counts, health and report roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightledger.catalog.registry import query
from sightledger.operators import commit as CM, lineage as L, summaries as SM
from sightledger.schema import CHECKS
from sightledger.session import union_all

LEDGER = """
li AS (SELECT *, l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey AS k FROM lineitem),
runs AS (
  SELECT 'run_' || c_custkey AS id,
    (['completed', 'running', 'completed_with_errors', 'failed', 'completed'])[(c_custkey % 5 + 1)::INT] AS status,
    make_timestamp((1704067200 + (c_custkey % 997) * 60) * 1000000) AS started_at,
    CASE WHEN c_custkey % 5 <> 1 THEN
      make_timestamp((1704067200 + (c_custkey % 997) * 60) * 1000000 + (c_custkey % 13) * 1250000) END AS completed_at
  FROM customer),
source_images AS (
  SELECT 'src_' || o_orderkey AS id, 'run_' || o_custkey AS run_id, 'sources/' || o_orderkey || '.png' AS relative_path,
    CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'processing' ELSE 'failed' END AS status,
    o_orderdate AS created_at FROM orders),
proposals AS (
  SELECT 'prop_' || k AS id, 'src_' || l_orderkey AS source_id, 0.8::DOUBLE + l_discount * 2 AS score,
    CASE WHEN l_returnflag = 'A' THEN 'decided' WHEN l_returnflag = 'R' THEN 'filtered'
         WHEN l_linestatus = 'O' THEN 'pending' ELSE 'failed' END AS status,
    CASE WHEN l_linenumber <> 7 THEN 'automatic_point_grid' ELSE 'manual' END AS prompt,
    'clu_' || l_partkey AS target_id, l_shipdate AS created_at FROM li),
objects AS (
  SELECT 'obj_' || p_partkey AS id, p_name, p_type, p_brand, p_size / 50.0::DOUBLE AS conf,
    CASE WHEN p_size % 5 = 0 THEN 'archived' ELSE 'active' END AS status,
    make_timestamp((1704067200 + p_size * 86400)::BIGINT * 1000000) AS created_at FROM part),
decisions AS (
  SELECT 'dec_' || k AS id, 'prop_' || k AS proposal_id, d AS decision,
    CASE WHEN d = 'existing' THEN 'obj_' || l_partkey END AS matched_object_id,
    CASE WHEN d = 'uncertain' THEN 0.0 ELSE l_quantity / 50 END AS confidence,
    CASE d WHEN 'new' THEN 'new_object' WHEN 'existing' THEN 'visual_instance_match' ELSE 'insufficient_evidence' END AS reason_code,
    d AS hypothesis, l_linenumber AS attempt
  FROM (SELECT *, (['new', 'existing', 'uncertain'])[(l_suppkey % 3 + 1)::INT] AS d FROM li WHERE l_returnflag = 'A')),
observations AS (
  SELECT 'obs_' || k AS id, 'obj_' || l_partkey AS object_id, 'prop_' || k AS proposal_id,
    'src_' || l_orderkey AS source_id, l_shipdate AS created_at
  FROM li WHERE l_returnflag = 'A' AND l_suppkey % 3 <> 2)
"""


@query("object_timeline", f"""
WITH {LEDGER}
SELECT o.object_id, o.created_at AS observed_at, o.id AS observation_id, o.proposal_id, o.source_id,
  s.relative_path AS source_path, p.score AS candidate_score, d.decision, d.matched_object_id,
  d.confidence AS decision_confidence, d.reason_code, d.hypothesis
FROM observations o JOIN source_images s ON s.id = o.source_id JOIN proposals p ON p.id = o.proposal_id
LEFT JOIN decisions d ON d.proposal_id = p.id""")
def object_timeline(v):
    return L.object_timeline(v.observations(), v.source_images(), v.proposals(), v.decisions())


@query("candidate_lineage", f"""
WITH {LEDGER}
SELECT p.id, p.source_id, p.status, s.run_id, s.relative_path AS source_path, s.status AS source_status,
  d.decision, d.matched_object_id, d.confidence AS decision_confidence, d.reason_code,
  o.id AS observation_id, o.object_id AS observation_object_id,
  coalesce(nullif(o.object_id, ''), d.matched_object_id) AS object_id
FROM proposals p JOIN source_images s ON s.id = p.source_id LEFT JOIN decisions d ON d.proposal_id = p.id
LEFT JOIN observations o ON o.proposal_id = p.id""")
def candidate_lineage(v):
    p = v.proposals().select("id", "source_id", "status")
    return L.candidate_lineage(p, v.source_images(), v.decisions(), v.observations())


@query("object_catalog", f"""
WITH {LEDGER}
SELECT b.id, b.status, b.created_at, p_name AS object_name_zh, p_type AS coarse_category, p_brand AS fine_category,
  p_brand || ' ' || p_name AS description, conf AS annotation_confidence, count(o.id) AS observation_count,
  max(o.created_at) AS last_observed_at
FROM objects b LEFT JOIN observations o ON o.object_id = b.id GROUP BY ALL""")
def object_catalog(v):
    return L.object_catalog(v.objects(), v.observations())


@query("latest_objects", """
SELECT 'obj_' || l_partkey AS id, max(l_quantity) AS version,
  arg_max(l_returnflag, {'q': l_quantity, 'o': l_orderkey, 'n': l_linenumber, 's': l_suppkey, 'f': l_returnflag}) AS status
FROM lineitem GROUP BY 1""")
def latest_objects(v):
    """The highest version is the highest quantity; order, line, supplier and flag decide between equal ones."""
    version = F.struct("l_quantity", "l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag")
    rows = v.table("lineitem").select(
        F.concat(F.lit("obj_"), F.col("l_partkey").cast("string")).alias("id"), version.alias("version"),
        F.col("l_quantity").alias("summary"), F.col("l_returnflag").alias("status"), F.col("l_shipdate").alias("created_at"))
    return L.latest_objects(rows).select("id", F.col("summary").alias("version"), "status")


@query("latest_attempt", f"""
WITH {LEDGER},
d AS (SELECT 'prop_' || l_partkey AS proposal_id, l_linenumber AS attempt, k AS id FROM li)
SELECT d.* FROM d WHERE attempt = (SELECT max(d2.attempt) FROM d d2 WHERE d2.proposal_id = d.proposal_id)""")
def latest_attempt(v):
    d = v.table("lineitem").select(
        F.concat(F.lit("prop_"), F.col("l_partkey").cast("string")).alias("proposal_id"),
        F.col("l_linenumber").alias("attempt"),
        F.concat_ws("_", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).alias("id"))
    return L.latest_attempt(d)


@query("run_summary", f"""
WITH {LEDGER},
s AS (SELECT run_id, {", ".join(f"count(*) FILTER (WHERE status = '{x}') AS sources_{x}" for x in ("pending", "processing", "completed", "failed"))}
      FROM source_images GROUP BY 1),
p AS (SELECT run_id, {", ".join(f"count(*) FILTER (WHERE p.status = '{x}') AS proposals_{x}" for x in ("pending", "filtered", "decided", "failed"))}
      FROM proposals p JOIN source_images i ON i.id = p.source_id GROUP BY 1),
d AS (SELECT run_id, {", ".join(f"count(*) FILTER (WHERE decision = '{x}') AS decisions_{x}" for x in ("new", "existing", "uncertain"))}
      FROM decisions d JOIN proposals p ON p.id = d.proposal_id JOIN source_images i ON i.id = p.source_id GROUP BY 1),
o AS (SELECT run_id, count(*) AS observations_added FROM observations o JOIN source_images i ON i.id = o.source_id GROUP BY 1)
SELECT r.id AS run_id, r.status,
  {", ".join(f"coalesce({c}, 0) AS {c}" for c in (
    "sources_pending", "sources_processing", "sources_completed", "sources_failed", "proposals_pending",
    "proposals_filtered", "proposals_decided", "proposals_failed", "decisions_new", "decisions_existing",
    "decisions_uncertain", "observations_added"))},
  (SELECT count(*) FROM objects WHERE status = 'active') AS active_objects_total
FROM runs r LEFT JOIN s ON s.run_id = r.id LEFT JOIN p ON p.run_id = r.id LEFT JOIN d ON d.run_id = r.id
LEFT JOIN o ON o.run_id = r.id""")
def run_summary(v):
    return SM.run_summary(v.runs(), v.source_images(), v.proposals(), v.decisions(), v.observations(), v.objects())


@query("coverage_gates", f"""
WITH {LEDGER},
p AS (SELECT run_id, count(*) FILTER (WHERE p.status = 'pending') AS pend, count(*) FILTER (WHERE p.status = 'failed') AS fail,
        count(*) FILTER (WHERE p.status = 'filtered') AS filt FROM proposals p JOIN source_images i ON i.id = p.source_id GROUP BY 1),
d AS (SELECT run_id, count(*) FILTER (WHERE decision = 'new') AS dn, count(*) FILTER (WHERE decision = 'existing') AS de
      FROM decisions d JOIN proposals p ON p.id = d.proposal_id JOIN source_images i ON i.id = p.source_id GROUP BY 1),
g AS (SELECT r.id AS run_id, CASE WHEN r.status = 'completed' THEN 'passed' ELSE r.status END AS st,
        coalesce(filt, 0) >= 1 AS filtered_candidate_observed,
        coalesce(dn, 0) >= 2 AS at_least_two_new_object_archives, coalesce(de, 0) >= 1 AS same_object_observation_was_merged,
        replace(r.id, 'run_', '')::INT % 2 = 0 AS exact_duplicate_image_was_skipped,
        coalesce(pend, 0) = 0 AND coalesce(fail, 0) = 0 AS no_pending_or_failed_proposals
      FROM runs r LEFT JOIN p ON p.run_id = r.id LEFT JOIN d ON d.run_id = r.id),
h AS (SELECT *, st = 'passed' AND at_least_two_new_object_archives AND same_object_observation_was_merged
        AND exact_duplicate_image_was_skipped AND no_pending_or_failed_proposals AS good FROM g)
SELECT run_id, CASE WHEN good THEN 'passed' ELSE 'failed' END AS status, filtered_candidate_observed,
  at_least_two_new_object_archives, same_object_observation_was_merged, exact_duplicate_image_was_skipped,
  no_pending_or_failed_proposals, CASE WHEN NOT good THEN st END AS pipeline_status FROM h""")
def coverage_gates(v):
    s = run_summary(v)
    dup = (F.regexp_extract("run_id", r"(\d+)", 1).cast("int") % 2 == 0).cast("int")
    status = F.when(F.col("status") == "completed", "passed").otherwise(F.col("status"))
    return SM.coverage_gates(s.withColumn("duplicate_sources_skipped", dup).withColumn("status", status))


@query("store_counts", f"""
WITH {LEDGER}
SELECT 'runs' AS "table", count(*) AS "rows" FROM runs UNION ALL SELECT 'source_images', count(*) FROM source_images
UNION ALL SELECT 'proposals', count(*) FROM proposals UNION ALL SELECT 'objects', count(*) FROM objects
UNION ALL SELECT 'observations', count(*) FROM observations UNION ALL SELECT 'decisions', count(*) FROM decisions
UNION ALL SELECT 'active_objects', count(*) FROM objects WHERE status = 'active'""")
def store_counts(v):
    return SM.store_counts({
        "runs": v.runs(), "source_images": v.source_images(), "proposals": v.proposals(),
        "objects": v.objects(), "observations": v.observations(), "decisions": v.decisions()})


@query("runs_with_counts", f"""
WITH {LEDGER},
s AS (SELECT run_id, count(*) AS n FROM source_images GROUP BY 1),
p AS (SELECT run_id, count(*) AS n FROM proposals p JOIN source_images i ON i.id = p.source_id GROUP BY 1),
o AS (SELECT run_id, count(*) AS n FROM observations o JOIN source_images i ON i.id = o.source_id GROUP BY 1)
SELECT r.id AS run_id, r.status, r.started_at, r.completed_at, coalesce(s.n, 0) AS source_count,
  coalesce(p.n, 0) AS proposal_count, coalesce(o.n, 0) AS observation_count
FROM runs r LEFT JOIN s ON s.run_id = r.id LEFT JOIN p ON p.run_id = r.id LEFT JOIN o ON o.run_id = r.id""")
def runs_with_counts(v):
    return SM.runs_with_counts(v.runs(), v.source_images(), v.proposals(), v.observations())


@query("referential_checks", f"""
WITH {LEDGER},
bad AS (
  SELECT 'proposal_without_source' AS rule, id FROM proposals WHERE source_id NOT IN (SELECT id FROM source_images)
  UNION ALL SELECT 'observation_without_proposal', id FROM observations WHERE proposal_id NOT IN (SELECT id FROM proposals)
  UNION ALL SELECT 'observation_without_active_object', id FROM observations
    WHERE object_id NOT IN (SELECT id FROM objects WHERE status = 'active')
  UNION ALL SELECT 'decision_without_proposal', id FROM decisions WHERE proposal_id NOT IN (SELECT id FROM proposals)
  UNION ALL SELECT 'decision_without_active_object', id FROM decisions
    WHERE matched_object_id IS NOT NULL AND matched_object_id NOT IN (SELECT id FROM objects WHERE status = 'active')
  UNION ALL SELECT 'pending_on_closed_source', id FROM proposals WHERE status = 'pending'
    AND source_id NOT IN (SELECT id FROM source_images WHERE status = 'processing')
  UNION ALL SELECT 'proposal_decided_twice', proposal_id FROM decisions GROUP BY proposal_id HAVING count(*) > 1)
SELECT rule, id FROM bad""")
def referential_checks(v):
    return CM.referential_checks(v.proposals(), v.source_images(), v.objects(), v.observations(), v.decisions())


@query("finalize_sources", f"""
WITH {LEDGER},
st AS (SELECT source_id, bool_or(status = 'pending') AS p, bool_or(status = 'failed') AS f FROM proposals GROUP BY 1)
SELECT i.id, CASE WHEN i.status <> 'processing' THEN i.status WHEN coalesce(p, false) OR coalesce(f, false) THEN 'failed'
  ELSE 'completed' END AS final_status,
  CASE WHEN i.status = 'processing' AND p THEN 'Source contains proposals without a terminal cluster result'
       WHEN i.status = 'processing' AND f THEN 'Source contains failed cluster proposals' END AS final_error
FROM source_images i LEFT JOIN st ON st.source_id = i.id""")
def finalize_sources(v):
    return CM.finalize_sources(v.source_images(), v.proposals()).select("id", "final_status", "final_error")


@query("complete_runs", f"""
WITH {LEDGER},
s AS (SELECT run_id, count(*) FILTER (WHERE status <> 'completed') AS n FROM source_images GROUP BY 1),
p AS (SELECT run_id, count(*) FILTER (WHERE p.status IN ('pending', 'failed')) AS n
      FROM proposals p JOIN source_images i ON i.id = p.source_id GROUP BY 1),
e AS (SELECT 'run_' || c_custkey AS run_id, c_custkey % 2 AS n FROM customer)
SELECT r.id AS run_id, coalesce(s.n, 0) AS incomplete_sources, coalesce(p.n, 0) AS incomplete_proposals,
  e.n AS external_errors, CASE WHEN coalesce(s.n, 0) + coalesce(p.n, 0) + e.n > 0 THEN 'completed_with_errors' ELSE 'completed' END AS final_status
FROM runs r JOIN e ON e.run_id = r.id LEFT JOIN s ON s.run_id = r.id LEFT JOIN p ON p.run_id = r.id WHERE r.status = 'running'""")
def complete_runs(v):
    external = v.table("customer").select(
        F.concat(F.lit("run_"), F.col("c_custkey").cast("string")).alias("run_id"), (F.col("c_custkey") % 2).alias("errors"))
    return CM.complete_runs(v.runs(), v.source_images(), v.proposals(), external)


CHECK_INPUTS = f"""
{LEDGER},
img AS (SELECT run_id, replace(id, 'src_', '')::INT % 11 = 0 AS duplicate, status FROM source_images),
pr AS (SELECT i.run_id, p.prompt, p.status <> 'filtered' AS kept, p.status = 'decided' AS fp, p.status
       FROM proposals p JOIN source_images i ON i.id = p.source_id),
cl AS (SELECT run_id, CASE WHEN status <> 'pending' THEN status END AS fd FROM pr),
i AS (SELECT run_id, count(*) AS n, bool_and(duplicate OR status IN ('completed', 'failed')) AS c2,
        bool_and(duplicate OR status <> 'processing') AS c7 FROM img GROUP BY 1),
p AS (SELECT run_id, bool_and(prompt = 'automatic_point_grid') AS c3, bool_and(NOT kept OR fp OR status = 'failed') AS c4,
        bool_and(NOT kept OR status IN ('decided', 'filtered', 'failed')) AS c5, bool_and(status <> 'pending') AS c8 FROM pr GROUP BY 1),
c AS (SELECT run_id, bool_and(fd IS NOT NULL) AS c6 FROM cl GROUP BY 1),
wide AS (SELECT r.id AS run_id, r.status, coalesce(n, 0) > 0 AS c1, coalesce(c2, true) AS c2, coalesce(c3, true) AS c3, coalesce(c4, true) AS c4,
        coalesce(c5, true) AS c5, coalesce(c6, true) AS c6, coalesce(c7, true) AS c7, coalesce(c8, true) AS c8
      FROM runs r LEFT JOIN i ON i.run_id = r.id LEFT JOIN p ON p.run_id = r.id LEFT JOIN c ON c.run_id = r.id)
"""


def _checks(v):
    src = v.source_images()
    images = src.select("run_id", (F.regexp_extract("id", r"(\d+)", 1).cast("long") % 11 == 0).alias("duplicate"), "status")
    props = v.proposals().join(src.select(F.col("id").alias("source_id"), "run_id"), "source_id").select(
        "run_id", "prompt", (F.col("status") != "filtered").alias("kept"),
        (F.col("status") == "decided").alias("has_fingerprint"), "status")
    clusters = props.select("run_id", F.when(F.col("status") != "pending", F.col("status")).alias("final_decision"))
    return SM.structural_checks(v.runs(), images, props, clusters)


@query("structural_checks", f"""
WITH {CHECK_INPUTS}
SELECT run_id, unnest({list(CHECKS)}) AS "check", unnest([c1, c2, c3, c4, c5, c6, c7, c8]) AS ok FROM wide""")
def structural_checks(v):
    return _checks(v)


@query("pipeline_status", f"""
WITH {CHECK_INPUTS}
SELECT run_id, CASE WHEN status = 'completed' AND c1 AND c2 AND c3 AND c4 AND c5 AND c6 AND c7 AND c8 THEN 'passed'
  WHEN status = 'completed' THEN 'failed' ELSE status END AS pipeline_status FROM wide""")
def pipeline_status(v):
    return SM.pipeline_status(v.runs(), _checks(v))


@query("latest_run", f"""
WITH {LEDGER}, r AS (SELECT *, replace(id, 'run_', '')::INT % 10 AS library_id FROM runs)
SELECT library_id, id, started_at, status FROM (
  SELECT *, row_number() OVER (PARTITION BY library_id ORDER BY started_at DESC, id DESC) AS rn FROM r) WHERE rn = 1""")
def latest_run(v):
    from sightledger.operators.events import latest_run as newest
    runs = v.runs().withColumn("library_id", F.regexp_extract("id", r"(\d+)", 1).cast("int") % 10)
    return newest(runs, "library_id")


@query("library_health", f"""
WITH {LEDGER},
man AS (SELECT o_orderkey AS lib, o_orderkey % 25 = 3 AS active, o_orderkey % 25 = 4 AS is_file, o_orderkey % 25 = 5 AS link,
   o_orderkey % 6 <> 0 AS has_db, o_orderkey % 25 <> 7 AS readable,
   CASE WHEN o_orderkey % 25 = 8 THEN 9 WHEN o_orderkey % 4 = 1 THEN 2 ELSE 3 END AS ver,
   o_orderkey % 5 = 2 AS no_dirs, o_orderkey % 12 = 0 AS content FROM orders),
rk AS (SELECT s.id AS sid, r.id, r.status, r.started_at FROM source_images s JOIN runs r ON r.id = s.run_id
   UNION ALL SELECT 'src_' || replace(id, 'run_', ''), id, status, started_at FROM runs),
rl AS (SELECT replace(sid, 'src_', '')::BIGINT AS lib, count(*) AS n, max(started_at) AS latest, bool_or(status <> 'completed') AS bad FROM rk GROUP BY 1),
sl AS (SELECT replace(id, 'src_', '')::BIGINT AS lib, bool_or(status <> 'completed') AS bad FROM source_images GROUP BY 1),
pl AS (SELECT replace(source_id, 'src_', '')::BIGINT AS lib, bool_or(status IN ('pending', 'failed')) AS bad FROM proposals GROUP BY 1),
ol AS (SELECT replace(id, 'obj_', '')::BIGINT AS lib, count(*) FILTER (WHERE status = 'active') AS n FROM objects GROUP BY 1),
bl AS (SELECT replace(source_id, 'src_', '')::BIGINT AS lib, count(*) AS n FROM observations GROUP BY 1),
j AS (SELECT man.*, rl.n AS runs, rl.latest, coalesce(rl.bad, false) OR coalesce(sl.bad, false) OR coalesce(pl.bad, false) AS bad, ol.n AS objs, bl.n AS obs
   FROM man LEFT JOIN rl USING (lib) LEFT JOIN sl USING (lib) LEFT JOIN pl USING (lib) LEFT JOIN ol USING (lib) LEFT JOIN bl USING (lib)),
x AS (SELECT *, CASE WHEN active THEN NULL WHEN is_file THEN 'invalid_library_root' WHEN link THEN 'database_symlink'
   WHEN has_db AND (NOT readable OR ver NOT IN (2, 3)) THEN 'database_unreadable' WHEN has_db AND bad THEN 'incomplete_run'
   WHEN has_db AND no_dirs THEN 'missing_asset_directories' WHEN has_db AND ver < 3 THEN 'legacy_read_only'
   WHEN NOT has_db AND content THEN 'partial_without_database' END AS issue_code FROM j),
y AS (SELECT *, coalesce(issue_code, '') IN ('invalid_library_root', 'database_symlink', 'database_unreadable') AS broken FROM x),
z AS (SELECT *, CASE WHEN active THEN 'running' WHEN broken THEN 'unreadable' WHEN issue_code IS NOT NULL THEN 'review_only'
   WHEN has_db THEN 'ready' ELSE 'empty' END AS status, has_db AND NOT broken AS shown FROM y)
SELECT lib AS library_id, status, status IN ('ready', 'empty') AS continuable, issue_code,
  CASE WHEN shown THEN coalesce(objs, 0) ELSE 0 END AS active_objects, CASE WHEN shown THEN coalesce(obs, 0) ELSE 0 END AS observations,
  CASE WHEN shown THEN coalesce(runs, 0) ELSE 0 END AS runs, CASE WHEN shown THEN latest END AS latest_run_at FROM z""")
def library_health(v):
    """A library per order: its source and proposals, the run of its customer and the run of its own number."""
    n = F.col("o_orderkey")
    dirs = F.array(*map(F.lit, ("sources", "proposals", "objects", "raw_responses", "run_reports")))
    manifest = v.table("orders").select(
        n.alias("library_id"), (n % 25 == 4).alias("root_is_file"), (n % 25 == 5).alias("database_is_link"),
        (n % 6 != 0).alias("has_database"), (n % 25 != 7).alias("readable"),
        F.when(n % 25 == 8, 9).when(n % 4 == 1, 2).otherwise(3).alias("schema_version"),
        F.when(n % 5 == 2, F.slice(dirs, 1, 3)).otherwise(dirs).alias("directories"),
        (n % 12 == 0).alias("has_content"), (n % 25 == 3).alias("active"))
    lib = lambda c: F.regexp_extract(c, r"(\d+)", 1).cast("long").alias("library_id")
    sources = v.source_images()
    runs = v.runs().select("id", "status", "started_at")
    of_sources = sources.select(lib("id"), "run_id").join(runs, F.col("run_id") == runs["id"]).drop("run_id")
    return SM.library_health(
        manifest, of_sources.unionByName(runs.withColumn("library_id", lib("id"))), sources.select(lib("id"), "status"),
        v.proposals().select(lib("source_id"), "status"), v.objects().select(lib("id"), "status"),
        v.observations().select(lib("source_id")))


REPORT = """
clu AS (SELECT 'run_' || c_nationkey AS run_id, 'clu_' || c_custkey AS cluster_id, (c_custkey % 7 + 1) AS member_count,
    c_custkey % 3 + 1 AS source_count, c_custkey % 4 <> 0 AS reviewed,
    nullif((['new', 'existing', 'ignored', 'uncertain', 'failed', ''])[(c_custkey % 6 + 1)::INT], '') AS final_decision,
    CASE WHEN c_custkey % 6 = 4 THEN 'batch failed ' || (c_custkey % 10) END AS error, c_custkey AS item FROM customer),
img AS (SELECT 'run_' || c_nationkey AS run_id, 'src_' || o_orderkey AS source_id, o_orderkey AS item, o_orderkey % 11 = 0 AS duplicate,
    CASE WHEN o_orderkey % 3 = 0 THEN 0 WHEN o_orderkey % 3 = 1 THEN o_orderkey % 256 END AS raw,
    CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 100 END AS grid, o_orderkey % 50 AS above,
    CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 24 END AS kept, o_orderkey % 17 AS filtered,
    CASE WHEN o_orderkey % 13 = 0 THEN 'image broken ' || (o_orderkey % 4) END AS error
  FROM orders JOIN customer ON c_custkey = o_custkey),
rep AS (SELECT 'run_' || n_nationkey AS run_id, (['passed', 'failed', 'completed_with_errors'])[(n_nationkey % 3 + 1)] AS status,
    CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey END AS dups, n_nationkey * 3 AS obs, n_nationkey + 1 AS objs,
    CASE WHEN n_nationkey % 4 = 0 THEN 'report broken' END AS error FROM nation)
"""


COUNTS = """
sp AS (SELECT p.id, s.run_id, p.status FROM proposals p JOIN source_images s ON s.id = p.source_id),
st AS (SELECT run_id, 'source' AS kind, status, count(*) AS n FROM source_images GROUP BY ALL
  UNION ALL SELECT run_id, 'proposal', status, count(*) FROM sp GROUP BY ALL
  UNION ALL SELECT run_id, 'decision', decision, count(*) FROM decisions d JOIN sp ON sp.id = d.proposal_id GROUP BY ALL),
k AS (SELECT run_id, sum(n) FILTER (WHERE kind = 'source') AS us,
    string_agg(status || '=' || n, ',' ORDER BY status) FILTER (WHERE kind = 'source') AS sc,
    string_agg(status || '=' || n, ',' ORDER BY status) FILTER (WHERE kind = 'proposal') AS pc,
    string_agg(status || '=' || n, ',' ORDER BY status) FILTER (WHERE kind = 'decision') AS dc,
    sum(n) FILTER (WHERE kind = 'proposal' AND status = 'filtered') AS nf, sum(n) FILTER (WHERE kind = 'proposal' AND status = 'failed') AS pf,
    sum(n) FILTER (WHERE kind = 'decision' AND status = 'new') AS d1, sum(n) FILTER (WHERE kind = 'decision' AND status = 'existing') AS d2,
    sum(n) FILTER (WHERE kind = 'decision' AND status = 'ignored') AS d3, sum(n) FILTER (WHERE kind = 'decision' AND status = 'uncertain') AS d4
  FROM st GROUP BY 1)
"""


def _report_counts(v):
    return SM.report_counts(v.source_images(), v.proposals(), v.decisions())


@query("result_summary", f"""
WITH {LEDGER}, {REPORT}, {COUNTS},
cd AS (SELECT run_id, string_agg(final_decision || '=' || n, ',' ORDER BY final_decision) AS cc
       FROM (SELECT run_id, final_decision, count(*) AS n FROM clu WHERE final_decision IS NOT NULL GROUP BY ALL) GROUP BY 1),
ed AS (SELECT run_id, count(DISTINCT message) AS ec FROM (
         SELECT run_id, error AS message FROM rep UNION ALL SELECT run_id, error FROM img UNION ALL SELECT run_id, error FROM clu)
       WHERE message IS NOT NULL GROUP BY 1),
i AS (SELECT run_id, count(*) AS n, sum(coalesce(nullif(raw, 0), nullif(grid, 0), nullif(above, 0), 0))::BIGINT AS raw,
        sum(coalesce(kept, 0))::BIGINT AS kept, sum(filtered)::BIGINT AS filtered FROM img GROUP BY 1),
c AS (SELECT run_id, count(*) AS n, count(*) FILTER (WHERE reviewed) AS r FROM clu GROUP BY 1)
SELECT rep.run_id, status, coalesce(i.n, 0) AS input_files, coalesce(raw, 0) AS raw_candidates, coalesce(kept, 0) AS kept,
  coalesce(filtered, 0) AS filtered, coalesce(c.n, 0) AS clusters, coalesce(r, 0) AS reviewed_clusters,
  coalesce(dups, 0)::BIGINT AS duplicate_sources_skipped, obs::BIGINT AS observations_added, objs::BIGINT AS active_objects_total,
  coalesce(us, 0)::BIGINT AS unique_sources, sc AS source_counts, pc AS proposal_counts, dc AS decision_counts, cc AS cluster_counts,
  coalesce(ec, 0) AS error_count, true AS manual_review_required
FROM rep LEFT JOIN i ON i.run_id = rep.run_id LEFT JOIN c ON c.run_id = rep.run_id LEFT JOIN k ON k.run_id = rep.run_id
LEFT JOIN cd ON cd.run_id = rep.run_id LEFT JOIN ed ON ed.run_id = rep.run_id""")
def result_summary(v):
    out = SM.result_summary(v.reports(), v.report_images(), v.clusters(), _report_counts(v), _errors(v))
    text = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    maps = ("source_counts", "proposal_counts", "decision_counts", "cluster_counts")
    return out.withColumns({c: F.nullif(text(c), F.lit("")) for c in maps}).drop("review_notice")


@query("report_metrics", f"""
WITH {LEDGER}, {REPORT}, {COUNTS},
i AS (SELECT run_id, count(*) AS n, sum(coalesce(raw, grid, above, 0))::BIGINT AS raw, sum(coalesce(kept, 0))::BIGINT AS kept,
        sum(filtered)::BIGINT AS filtered, count(*) FILTER (WHERE duplicate) AS dup FROM img GROUP BY 1),
c AS (SELECT run_id, count(*) AS n, count(*) FILTER (WHERE reviewed) AS r,
        {", ".join(f"count(*) FILTER (WHERE final_decision = '{o}') AS {o}_clusters" for o in ("new", "existing", "ignored", "uncertain", "failed"))}
      FROM clu GROUP BY 1)
SELECT rep.run_id, coalesce(i.n, 0) AS inputs, coalesce(us, 0)::BIGINT AS unique_sources, coalesce(nf, 0)::BIGINT AS filtered,
  coalesce(d1, 0)::BIGINT AS new_count, coalesce(d2, 0)::BIGINT AS existing_count, coalesce(d3, 0)::BIGINT AS ignored_count,
  coalesce(d4, 0)::BIGINT AS uncertain_count, coalesce(pf, 0)::BIGINT AS failed_proposals, coalesce(dups, dup, 0)::BIGINT AS duplicates, coalesce(raw, 0) AS raw_candidates,
  coalesce(kept, 0) AS kept, coalesce(filtered, 0) AS script_filtered, coalesce(c.n, 0) AS clusters, coalesce(r, 0) AS reviewed_clusters,
  {", ".join(f"coalesce({o}_clusters, 0) AS {o}_clusters" for o in ("new", "existing", "ignored", "uncertain", "failed"))},
  obs::BIGINT AS observations, objs::BIGINT AS objects
FROM rep LEFT JOIN i ON i.run_id = rep.run_id LEFT JOIN c ON c.run_id = rep.run_id LEFT JOIN k ON k.run_id = rep.run_id""")
def report_metrics(v):
    return SM.report_metrics(v.reports(), v.report_images(), v.clusters(), _report_counts(v))


def _errors(v):
    none = F.lit(None).cast("string")
    zero = F.lit(0).cast("long")
    rep = v.reports().select("run_id", F.lit(0).alias("section"), zero.alias("item"), F.lit(0).alias("field"),
                             zero.alias("position"), F.lit("report.error").alias("source"), F.lit("RuntimeError").alias("type"),
                             F.col("error").alias("message"))
    img = v.report_images().select("run_id", F.lit(3).alias("section"), "item", F.lit(0).alias("field"), zero.alias("position"),
                                   F.concat(F.lit("images["), F.col("item").cast("string"), F.lit("].error")).alias("source"),
                                   none.alias("type"), F.col("error").alias("message"))
    item = F.substring_index("cluster_id", "_", -1)
    clu = v.clusters().select("run_id", F.lit(4).alias("section"), item.cast("long").alias("item"), F.lit(0).alias("field"),
                              zero.alias("position"), F.concat(F.lit("clusters["), item, F.lit("].error")).alias("source"),
                              none.alias("type"), F.col("error").alias("message"))
    return union_all([rep, img, clu])


ERRORS = f"""
{REPORT},
errs AS (
  SELECT run_id, 0 AS section, 0 AS item, 'report.error' AS source, 'RuntimeError' AS type, error AS message FROM rep
  UNION ALL SELECT run_id, 3, item, 'images[' || item || '].error', NULL, error FROM img
  UNION ALL SELECT run_id, 4, item, 'clusters[' || item || '].error', NULL, error FROM clu)
"""


@query("error_digest", f"""
WITH {ERRORS}
SELECT run_id, message, source, type, section, item, 0 AS field, 0 AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id, message ORDER BY section, item) AS rn FROM errs WHERE message IS NOT NULL)
WHERE rn = 1""")
def error_digest(v):
    return SM.error_digest(_errors(v))


@query("dashboard_errors", f"""
WITH {ERRORS}
SELECT DISTINCT run_id, CASE WHEN type IS NOT NULL THEN type || ': ' || message ELSE message END AS text
FROM errs WHERE message IS NOT NULL""")
def dashboard_errors(v):
    return SM.dashboard_errors(_errors(v))


@query("cluster_decision_counts", f"""
WITH {REPORT} SELECT run_id, coalesce(final_decision, 'pending') AS decision, count(*) AS n FROM clu GROUP BY ALL""")
def cluster_decision_counts(v):
    return SM.cluster_decision_counts(v.clusters())


@query("stage_metrics", f"""
WITH {REPORT},
i AS (SELECT run_id, count(*) FILTER (WHERE NOT duplicate) AS u, sum(coalesce(kept, 0))::BIGINT AS k FROM img GROUP BY 1),
c AS (SELECT run_id, count(*) AS n, sum(member_count)::BIGINT AS m, count(*) FILTER (WHERE source_count > 1) AS mv,
   count(*) FILTER (WHERE reviewed OR final_decision IS NOT NULL) AS r,
   count(*) FILTER (WHERE final_decision IN ('new', 'existing')) AS f,
   count(*) FILTER (WHERE final_decision IN ('ignored', 'uncertain')) AS o FROM clu GROUP BY 1)
SELECT coalesce(i.run_id, c.run_id) AS run_id, coalesce(u, 0) AS unique_images, coalesce(k, 0) AS kept, coalesce(n, 0) AS clusters,
  coalesce(m, 0) AS members, coalesce(mv, 0) AS multi_view, coalesce(r, 0) AS reviewed, coalesce(f, 0) AS formed,
  coalesce(o, 0) AS filtered_or_open FROM i FULL JOIN c ON c.run_id = i.run_id""")
def stage_metrics(v):
    return SM.stage_metrics(v.report_images(), v.clusters())


@query("model_usage", """
SELECT 'run_' || l_suppkey AS run_id, l_shipmode AS stage, count(*) AS calls, sum(l_partkey)::BIGINT AS input_tokens,
  sum(l_linenumber)::BIGINT AS generated_tokens, round(sum(l_quantity), 3) AS inference_seconds,
  round(max(l_extendedprice), 2) AS peak_memory_mib
FROM (SELECT *, l_returnflag || l_linestatus AS l_shipmode FROM lineitem) GROUP BY ALL""")
def model_usage(v):
    p = v.table("lineitem").select(
        F.concat(F.lit("run_"), F.col("l_suppkey").cast("string")).alias("run_id"),
        F.concat("l_returnflag", "l_linestatus").alias("stage"), F.col("l_partkey").alias("input_tokens"),
        F.col("l_linenumber").alias("generated_tokens"), F.col("l_quantity").alias("inference_seconds"),
        F.col("l_extendedprice").alias("peak_memory_mib"))
    return SM.model_usage(p)


@query("report_sections", f"""
WITH {REPORT}
SELECT run_id, 'run' AS section, 1 AS n FROM rep UNION ALL SELECT run_id, 'image', count(*) FROM img GROUP BY 1
UNION ALL SELECT run_id, 'cluster', count(*) FROM clu GROUP BY 1""")
def report_sections(v):
    from sightledger.sources.reports import report_sections as sections
    s = sections(v.reports(), v.report_images(), v.clusters())
    return s.filter(F.length("body") > 2).groupBy("run_id", "section").agg(F.count(F.lit(1)).alias("n"))
