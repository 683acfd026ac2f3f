"""Validators, ids, scores, times and text operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightledger.catalog.registry import query
from sightledger.functions import identity, jsontext, timing, validators as V, vectors
from sightledger.operators import registration
from sightledger.params import Params
from sightledger.schema import IDENTITY_REASONS
from sightledger.sources import fingerprints as fp
from sightledger.sources.assets import image_rows
from sightledger.sources.legacy import read_legacy_objects
from sightledger.operators.lineage import object_cards

P = Params()

PATHS = """
paths AS (
  SELECT doc_id, source || '/' || doc_id ||
    (['.jpg', '.JPEG', '.png', '.webp', '.txt', ''])[(doc_id % 6 + 1)::INT] AS path, n_chars FROM documents)
"""


def _paths(v):
    suffix = F.element_at(F.array(*map(F.lit, (".jpg", ".JPEG", ".png", ".webp", ".txt", ""))),
                          (F.col("doc_id") % 6 + 1).cast("int"))
    return v.table("documents").select(
        "doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), suffix).alias("path"),
        F.col("n_chars").alias("size_bytes"))


@query("scan_assets", f"""
WITH {PATHS}
SELECT path, n_chars AS size_bytes FROM paths WHERE regexp_matches(lower(path), '\\.(jpg|jpeg|png|webp)$')""")
def scan_assets(v):
    return image_rows(_paths(v)).select("path", "size_bytes")


@query("asset_inventory", """
WITH a AS (SELECT source || '/' || doc_id AS path, sha256(text) AS sha256, n_chars AS size_bytes FROM documents),
f AS (SELECT sha256, arg_min(path, lower(path)) AS owner FROM a GROUP BY 1)
SELECT path, sha256, size_bytes, path <> owner AS is_duplicate,
       CASE WHEN path <> owner THEN owner END AS duplicate_of FROM a JOIN f USING (sha256)""")
def asset_inventory(v):
    return registration.asset_inventory(v.assets().select("path", "content", "size_bytes"))


@query("inventory_counts", """
WITH a AS (SELECT count(*) AS total, count(DISTINCT sha256(text)) AS uniq FROM documents)
SELECT total, uniq AS "unique", total - uniq AS duplicates FROM a""")
def inventory_counts(v):
    return registration.inventory_counts(registration.asset_inventory(v.assets().select("path", "content")))


@query("register_sources", """
WITH inc AS (SELECT doc_id AS ordinal, sha256(text) AS sha256, 'run_' || (doc_id % 2) AS run_id FROM documents),
old AS (
  SELECT sha256(text) AS sha256, 'run_' || min(doc_id % 3) AS run_id,
         (['completed', 'failed', 'processing'])[(min(doc_id) % 3 + 1)::INT] AS status
  FROM documents WHERE doc_id % 4 = 0 GROUP BY 1),
j AS (SELECT i.*, o.run_id AS orun, o.status AS ostat FROM inc i LEFT JOIN old o USING (sha256)),
lead_row AS (
  SELECT sha256, min(ordinal) AS lord, arg_min(run_id, ordinal) AS lrun FROM j
  WHERE ostat IS NULL OR (ostat = 'failed' AND orun = run_id) GROUP BY 1),
k AS (
  SELECT j.*, lord, lrun, coalesce(ordinal > lord, false) AS later FROM j LEFT JOIN lead_row USING (sha256)),
m AS (
  SELECT *, CASE WHEN later THEN lrun ELSE orun END AS mrun, CASE WHEN later THEN 'processing' ELSE ostat END AS mstat
  FROM k)
SELECT ordinal, run_id, 'src_' || substr(sha256, 1, 32) AS source_id,
  CASE WHEN ordinal = lord THEN CASE WHEN ostat IS NULL THEN 'new' ELSE 'resumed' END
       WHEN mstat = 'completed' THEN 'duplicate'
       WHEN mrun = run_id AND mstat IN ('pending', 'processing') THEN 'duplicate'
       WHEN mrun <> run_id THEN 'conflict' ELSE 'resumed' END AS outcome
FROM m""")
def register_sources(v):
    docs = registration.digests(v.table("documents").select("doc_id", F.col("text").alias("content")))
    incoming = docs.select(F.col("doc_id").alias("ordinal"), "sha256",
                           F.concat(F.lit("run_"), (F.col("doc_id") % 2).cast("string")).alias("run_id"))
    status = F.element_at(F.array(*map(F.lit, ("completed", "failed", "processing"))),
                          (F.min("doc_id") % 3 + 1).cast("int"))
    stored = docs.filter(F.col("doc_id") % 4 == 0).groupBy("sha256").agg(
        F.concat(F.lit("run_"), F.min(F.col("doc_id") % 3).cast("string")).alias("run_id"), status.alias("status"))
    return registration.register_sources(incoming, stored).select("ordinal", "run_id", "source_id", "outcome")


@query("upload_checks", """
WITH b AS (
  SELECT doc_id, 'batch_' || (doc_id % 20) AS batch_id,
         CASE WHEN doc_id % 7 = 0 THEN 'bad name.png' WHEN doc_id % 5 = 0 THEN 'Doc' || (doc_id % 50) || '.PNG'
              WHEN doc_id % 11 = 0 THEN 'doc' || doc_id || '.gif' ELSE 'doc' || doc_id || '.png' END AS name,
         CASE WHEN doc_id % 13 = 0 THEN 0 ELSE n_chars * 20000 END AS size_bytes, n_chars * 9000 AS pixels
  FROM documents),
n AS (SELECT batch_id, lower(name) AS f, count(*) AS c FROM b GROUP BY ALL),
t AS (SELECT DISTINCT 'doc' || page_id || '.png' AS f FROM pages)
SELECT doc_id, array_to_string(list_filter([
    CASE WHEN NOT regexp_full_match(name, '[A-Za-z0-9][A-Za-z0-9._-]{0,127}') THEN 'name_invalid' END,
    CASE WHEN NOT regexp_matches(lower(name), '\\.(jpg|jpeg|png|webp)$') THEN 'suffix_not_allowed' END,
    CASE WHEN size_bytes <= 0 THEN 'empty_file' END,
    CASE WHEN size_bytes > 20971520 THEN 'too_large' END,
    CASE WHEN pixels <= 0 OR pixels > 40000000 THEN 'too_many_pixels' END,
    CASE WHEN c > 1 THEN 'repeated_in_batch' END,
    CASE WHEN t.f IS NOT NULL THEN 'name_taken' END], lambda x: x IS NOT NULL), ',') AS violations
FROM b JOIN n ON n.batch_id = b.batch_id AND n.f = lower(name) LEFT JOIN t ON t.f = lower(name)""")
def upload_checks(v):
    d, k = v.table("documents"), F.col("doc_id")
    s = k.cast("string")
    name = (
        F.when(k % 7 == 0, "bad name.png")
        .when(k % 5 == 0, F.concat(F.lit("Doc"), (k % 50).cast("string"), F.lit(".PNG")))
        .when(k % 11 == 0, F.concat(F.lit("doc"), s, F.lit(".gif")))
        .otherwise(F.concat(F.lit("doc"), s, F.lit(".png")))
    )
    batch = d.select(
        "doc_id", F.concat(F.lit("batch_"), (k % 20).cast("string")).alias("batch_id"), name.alias("name"),
        F.when(k % 13 == 0, 0).otherwise(F.col("n_chars") * 20000).alias("size_bytes"),
        (F.col("n_chars") * 9000).alias("pixels"))
    existing = v.table("pages").select(
        F.concat(F.lit("doc"), F.col("page_id").cast("string"), F.lit(".png")).alias("name"))
    out = registration.upload_checks(batch, existing)
    return out.select("doc_id", F.array_join("violations", ",").alias("violations"))


@query("l2_normalize", """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 3) AS v FROM embeddings)
SELECT vec_id, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS first, round(v[64] / sqrt(list_dot_product(v, v)), 6) AS last
FROM e""")
def l2_normalize(v):
    e = v.table("embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 3).alias("v"))
    unit = e.select("vec_id", vectors.l2_normalize("v").alias("u"))
    return unit.select("vec_id", F.round(F.get("u", F.lit(0)), 6).alias("first"),
                       F.round(F.get("u", F.lit(63)), 6).alias("last"))


@query("cosine_scores", """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
u AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM e),
s AS (SELECT a.vec_id, list_dot_product(a.u, b.u) AS g FROM u a JOIN u b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(g, 6) AS cosine, round(0.5 * g + 0.5 * ((vec_id % 5) / 4.0::DOUBLE), 6) AS weighted FROM s""")
def cosine_scores(v):
    u = v.table("embeddings").select("vec_id", vectors.l2_normalize("embedding").alias("u"))
    nxt = u.select((F.col("vec_id") - 1).alias("vec_id"), F.col("u").alias("w"))
    g = vectors.cosine(F.col("u"), F.col("w"))
    return u.join(nxt, "vec_id").select(
        "vec_id", F.round(g, 6).alias("cosine"),
        F.round(vectors.weighted_score(g, (F.col("vec_id") % 5) / 4), 6).alias("weighted"))


@query("fingerprint_quantise", """
WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
s AS (SELECT *, CASE WHEN x = 0 THEN 1 ELSE pow(2.0, greatest(floor(log2(abs(x))), -14) - 10) END AS step FROM x),
q AS (SELECT vec_id, pos, x, round_even(x / step, 0) * step AS h FROM s)
SELECT vec_id, round(sum(h * pos), 6) AS weighted_sum, round(max(abs(h - x)), 9) AS worst FROM q GROUP BY 1""")
def fingerprint_quantise(v):
    e = v.table("embeddings").select("vec_id", "embedding", fp.to_float16("embedding").alias("h"))
    x = e.select("vec_id", F.posexplode(F.arrays_zip("embedding", "h")).alias("pos", "z"))
    h, raw = F.col("z.h").cast("double"), F.col("z.embedding").cast("double")
    return x.groupBy("vec_id").agg(
        F.round(F.sum(h * (F.col("pos") + 1)), 6).alias("weighted_sum"),
        F.round(F.max(F.abs(h - raw)), 9).alias("worst"))


@query("cluster_id", """
SELECT l_orderkey // 64 AS k, count(*) AS n,
  'clu_' || substr(sha256(string_agg(m, chr(10) ORDER BY m)), 1, 24) AS cluster_id
FROM (SELECT l_orderkey, 'prop_' || l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey AS m FROM lineitem)
GROUP BY 1""")
def cluster_id(v):
    df = v.table("lineitem").select(
        F.expr("l_orderkey div 64").alias("k"),
        F.concat_ws("_", F.lit("prop"), *[F.col(c).cast("string") for c in (
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).alias("m"))
    return df.groupBy("k").agg(F.count(F.lit(1)).alias("n"),
                               identity.cluster_id(F.collect_list("m")).alias("cluster_id"))


REVIEW_ROWS = """
rv AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
    (['object', 'ignore', 'uncertain', 'object'])[(l_partkey % 4 + 1)::INT] AS verdict,
    (['new', 'existing', 'uncertain'])[(l_suppkey % 3 + 1)::INT] AS hypothesis,
    CASE WHEN l_suppkey % 3 = 1 OR l_linenumber = 7 THEN 'obj_' || (l_partkey % 5) END AS matched,
    (['match', 'no_match', 'ambiguous'])[(l_linenumber % 3 + 1)::INT] AS result,
    CASE WHEN l_linenumber % 3 = 0 THEN 'obj_' || (l_orderkey % 5) END AS evidence_object,
    l_partkey % 2 = 0 AS has_summary FROM lineitem)
"""


def _review_rows(v):
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))
    pk, sk, ln = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    obj = lambda c: F.concat(F.lit("obj_"), c.cast("string"))
    return v.table("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        pick(("object", "ignore", "uncertain", "object"), pk % 4).alias("verdict"),
        pick(("new", "existing", "uncertain"), sk % 3).alias("hypothesis"),
        F.when((sk % 3 == 1) | (ln == 7), obj(pk % 5)).alias("matched"),
        pick(("match", "no_match", "ambiguous"), ln % 3).alias("result"),
        F.when(ln % 3 == 0, obj(F.col("l_orderkey") % 5)).alias("evidence_object"),
        (pk % 2 == 0).alias("has_summary"))


_R = IDENTITY_REASONS


@query("resolve_identity", f"""
WITH {REVIEW_ROWS},
d AS (
  SELECT *, CASE WHEN verdict = 'ignore' THEN 'ignored' WHEN verdict = 'uncertain' OR result = 'ambiguous' THEN 'uncertain'
    WHEN hypothesis = 'new' AND result = 'no_match' THEN 'new'
    WHEN hypothesis = 'existing' AND result = 'match' AND matched = evidence_object THEN 'existing'
    ELSE 'uncertain' END AS decision FROM rv)
SELECT decision, CASE decision WHEN 'new' THEN 'new_object' WHEN 'existing' THEN 'visual_instance_match'
    WHEN 'uncertain' THEN CASE WHEN verdict <> 'uncertain' AND result = 'ambiguous' THEN 'ambiguous_match'
                               ELSE 'insufficient_evidence' END END AS reason_code,
  CASE decision WHEN 'new' THEN '{_R["new"]}' WHEN 'existing' THEN '{_R["existing"]}'
    WHEN 'uncertain' THEN CASE WHEN verdict = 'uncertain' THEN '{_R["reviewer_uncertain"]}'
      WHEN result = 'ambiguous' THEN '{_R["ambiguous"]}' WHEN hypothesis = 'new' THEN '{_R["new_but_matched"]}'
      ELSE '{_R["existing_unsupported"]}' END END AS reason, count(*) AS n
FROM d GROUP BY ALL""")
def resolve_identity(v):
    df = _review_rows(v).select(identity.resolve_identity(
        F.col("verdict"), F.col("hypothesis"), F.col("matched"), F.col("result"), F.col("evidence_object")).alias("o"))
    return df.groupBy("o.decision", "o.reason_code", "o.reason").agg(F.count(F.lit(1)).alias("n"))


@query("validate_review", f"""
WITH {REVIEW_ROWS},
x AS (SELECT array_to_string(list_filter([
  CASE WHEN verdict = 'object' AND hypothesis = 'uncertain' THEN 'object_without_hypothesis' END,
  CASE WHEN verdict = 'object' AND NOT has_summary THEN 'object_without_summary' END,
  CASE WHEN verdict = 'object' AND hypothesis = 'existing' AND matched IS NULL THEN 'existing_without_object_id' END,
  CASE WHEN verdict = 'object' AND hypothesis = 'new' AND matched IS NOT NULL THEN 'new_with_object_id' END,
  CASE WHEN verdict <> 'object' AND hypothesis <> 'uncertain' THEN 'refused_with_hypothesis' END,
  CASE WHEN verdict <> 'object' AND matched IS NOT NULL THEN 'refused_with_object_id' END,
  CASE WHEN verdict <> 'object' AND has_summary THEN 'refused_with_summary' END],
  lambda c: c IS NOT NULL), ',') AS violations FROM rv)
SELECT violations, count(*) AS n FROM x GROUP BY 1""")
def validate_review(v):
    bad = V.validate_review(F.col("verdict"), F.col("hypothesis"), F.col("matched"), F.col("has_summary"))
    return _review_rows(v).groupBy(F.array_join(bad, ",").alias("violations")).agg(F.count(F.lit(1)).alias("n"))


@query("validate_decision", """
WITH d AS (
  SELECT (['new', 'existing', 'uncertain', 'maybe'])[(l_suppkey % 4 + 1)::INT] AS decision,
    CASE WHEN l_partkey % 3 = 0 THEN 'obj_1' WHEN l_partkey % 3 = 1 THEN '' END AS matched,
    l_quantity / 45 AS confidence, l_linenumber AS attempt FROM lineitem),
x AS (SELECT array_to_string(list_filter([
  CASE WHEN decision = 'maybe' THEN 'decision_unknown' END,
  CASE WHEN decision = 'existing' AND matched IS NULL THEN 'existing_without_object_id' END,
  CASE WHEN decision <> 'existing' AND coalesce(matched, '') <> '' THEN 'object_id_not_allowed' END,
  CASE WHEN confidence < 0 OR confidence > 1 THEN 'confidence_out_of_range' END,
  CASE WHEN attempt <> 1 THEN 'attempt_not_one' END], lambda c: c IS NOT NULL), ',') AS violations FROM d)
SELECT violations, count(*) AS n FROM x GROUP BY 1""")
def validate_decision(v):
    d = v.table("lineitem").select(
        F.element_at(F.array(*map(F.lit, ("new", "existing", "uncertain", "maybe"))),
                     (F.col("l_suppkey") % 4 + 1).cast("int")).alias("decision"),
        F.when(F.col("l_partkey") % 3 == 0, "obj_1").when(F.col("l_partkey") % 3 == 1, "").alias("matched"),
        (F.col("l_quantity") / 45).alias("confidence"), F.col("l_linenumber").alias("attempt"))
    bad = V.validate_decision(F.col("decision"), F.col("matched"), F.col("confidence"), F.col("attempt"))
    return d.groupBy(F.array_join(bad, ",").alias("violations")).agg(F.count(F.lit(1)).alias("n"))


@query("validate_records", """
WITH r AS (
  SELECT CASE WHEN l_partkey % 9 = 0 THEN '' ELSE 'c' || l_partkey END AS raw_id, l_discount * 11 AS score,
    l_suppkey % 10 - 1.0::DOUBLE AS x_min, 0.0::DOUBLE AS y_min, l_suppkey % 7 * 1.0::DOUBLE AS x_max, 5.0::DOUBLE AS y_max,
    (['match', 'no_match', 'ambiguous'])[(l_linenumber % 3 + 1)::INT] AS result,
    CASE WHEN l_partkey % 2 = 0 THEN 'obj_1' END AS oid, l_tax * 30 - 1 AS vs FROM lineitem),
x AS (SELECT array_to_string(list_filter([
  CASE WHEN raw_id = '' THEN 'raw_id_empty' END, CASE WHEN score < 0 OR score > 1 THEN 'score_out_of_range' END,
  CASE WHEN x_min < 0 OR y_min < 0 THEN 'negative_corner' END,
  CASE WHEN x_max <= x_min OR y_max <= y_min THEN 'empty_box' END,
  CASE WHEN result = 'match' AND oid IS NULL THEN 'match_without_ids' END,
  CASE WHEN result <> 'match' AND oid IS NOT NULL THEN 'ids_without_match' END,
  CASE WHEN vs < -1 OR vs > 1 THEN 'score_out_of_range' END], lambda c: c IS NOT NULL), ',') AS violations FROM r)
SELECT violations, count(*) AS n FROM x GROUP BY 1""")
def validate_records(v):
    d = lambda c: c.cast("double")
    r = v.table("lineitem").select(
        F.when(F.col("l_partkey") % 9 == 0, "").otherwise(F.concat(F.lit("c"), F.col("l_partkey").cast("string"))).alias("raw_id"),
        (F.col("l_discount") * 11).alias("score"),
        F.struct(d(F.col("l_suppkey") % 10 - 1).alias("x_min"), F.lit(0.0).alias("y_min"),
                 d(F.col("l_suppkey") % 7).alias("x_max"), F.lit(5.0).alias("y_max")).alias("bbox"),
        F.element_at(F.array(*map(F.lit, ("match", "no_match", "ambiguous"))),
                     (F.col("l_linenumber") % 3 + 1).cast("int")).alias("result"),
        F.when(F.col("l_partkey") % 2 == 0, "obj_1").alias("oid"), (F.col("l_tax") * 30 - 1).alias("vs"))
    bad = F.concat(
        V.validate_candidate(F.col("raw_id"), F.lit("p"), F.col("score"), F.col("bbox")),
        V.validate_bbox(F.col("bbox")),
        V.validate_evidence(F.col("result"), F.col("oid"), F.col("oid"), F.col("vs"), F.lit(0.5)))
    return r.groupBy(F.array_join(bad, ",").alias("violations")).agg(F.count(F.lit(1)).alias("n"))


@query("validate_fingerprint", """
SELECT vec_id, array_to_string(list_filter([
  CASE WHEN vec_id % 7 = 0 THEN 'local_width_differs' END,
  CASE WHEN vec_id % 4 <> 0 THEN 'patch_count_differs' END], lambda c: c IS NOT NULL), ',') AS violations
FROM embeddings""")
def validate_fingerprint(v):
    k = F.col("vec_id")
    e = v.table("embeddings").select(
        "vec_id", "embedding",
        F.array("embedding", F.when(k % 7 == 0, F.slice("embedding", 1, 16)).otherwise(F.col("embedding"))).alias("local"),
        F.slice(F.array(F.lit(1), F.lit(2), F.lit(3)), F.lit(1), F.when(k % 4 == 0, 2).otherwise(3)).alias("rc"))
    bad = V.validate_fingerprint(F.col("embedding"), F.col("local"), F.col("rc"))
    return e.select("vec_id", F.array_join(bad, ",").alias("violations"))


@query("validate_summary", """
WITH s AS (SELECT p_partkey, p_name, p_brand, p_type, p_size / 45.0::DOUBLE AS conf,
                  string_split(p_name || CASE WHEN p_size % 3 = 0 THEN ' red' ELSE '' END, ' ') AS feats FROM part)
SELECT p_partkey, array_to_string(list_filter([
  CASE WHEN p_size_empty THEN 'fine_category_empty' END,
  CASE WHEN len(list_distinct(feats)) < len(feats) THEN 'features_not_unique' END,
  CASE WHEN conf < 0 OR conf > 1 THEN 'confidence_out_of_range' END], lambda c: c IS NOT NULL), ',') AS violations
FROM (SELECT *, p_brand = 'Brand#1' AS p_size_empty FROM s)""")
def validate_summary(v):
    feats = F.split(F.concat("p_name", F.when(F.col("p_size") % 3 == 0, " red").otherwise("")), " ")
    obj = v.objects().join(v.table("part").select(
        F.concat(F.lit("obj_"), F.col("p_partkey").cast("string")).alias("id"), "p_partkey", "p_size", "p_name", "p_brand"), "id")
    s = F.col("summary").withField("stable_identity_features", feats).withField(
        "summary_confidence", F.col("p_size") / 45.0).withField(
        "fine_category", F.when(F.col("p_brand") == "Brand#1", "").otherwise(F.col("p_brand")))
    return obj.select("p_partkey", s.alias("s")).select(
        "p_partkey", F.array_join(V.validate_summary(F.col("s")), ",").alias("violations"))


@query("path_rules", """
WITH u AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'sources/' || page_id || '.PNG' WHEN 1 THEN '/abs/' || page_id || '.jpg'
    WHEN 2 THEN 'a/../' || page_id || '.jpg' WHEN 3 THEN 'raw_responses/run/' || page_id || '.json'
    WHEN 4 THEN 'objects\\' || page_id ELSE url END AS path FROM pages)
SELECT page_id, NOT starts_with(path, '/') AND NOT contains(path, '\\') AND NOT list_contains(string_split(path, '/'), '..') AS valid,
  page_id % 6 = 0 AS image_ok, page_id % 6 = 3 AS audit_ok,
  regexp_full_match(path, '[A-Za-z0-9][A-Za-z0-9_-]{0,127}') AS identifier_ok
FROM u""")
def path_rules(v):
    k, s = F.col("page_id"), F.col("page_id").cast("string")
    path = (
        F.when(k % 6 == 0, F.concat(F.lit("sources/"), s, F.lit(".PNG")))
        .when(k % 6 == 1, F.concat(F.lit("/abs/"), s, F.lit(".jpg")))
        .when(k % 6 == 2, F.concat(F.lit("a/../"), s, F.lit(".jpg")))
        .when(k % 6 == 3, F.concat(F.lit("raw_responses/run/"), s, F.lit(".json")))
        .when(k % 6 == 4, F.concat(F.lit("objects\\"), s)).otherwise(F.col("url"))
    )
    return v.table("pages").select("page_id", path.alias("path")).select(
        "page_id", V.valid_asset_path(F.col("path")).alias("valid"), V.allowed_image(F.col("path")).alias("image_ok"),
        V.allowed_audit_json(F.col("path")).alias("audit_ok"), V.valid_identifier(F.col("path")).alias("identifier_ok"))


@query("extract_json_object", """
WITH t AS (
  SELECT conv_id, turn, to_json({'role': role, 'n': length(text)})::VARCHAR AS j, length(text) AS n, role FROM conversations)
SELECT conv_id, turn, 'made' AS kind,
  CASE WHEN (conv_id + turn) % 5 IN (3, 4) THEN NULL ELSE role END AS role,
  CASE WHEN (conv_id + turn) % 5 IN (3, 4) THEN NULL ELSE n END AS n,
  CASE (conv_id + turn) % 5 WHEN 3 THEN 'no_json_object' WHEN 4 THEN 'not_an_object' END AS error
FROM t
UNION ALL
SELECT conv_id, turn, 'text', NULL, NULL,
  CASE WHEN json_valid(text) THEN 'not_an_object' WHEN contains(coalesce(text, ''), '{') THEN 'invalid_json' ELSE 'no_json_object' END
FROM conversations""")
def extract_json_object(v):
    body = F.to_json(F.struct("role", F.length("text").alias("n")))
    n = (F.col("conv_id") + F.col("turn")) % 5
    fence = "```"
    raw = (
        F.when(n == 0, body)
        .when(n == 1, F.concat(F.lit(f"{fence}json\n"), body, F.lit(f"\n{fence}")))
        .when(n == 2, F.concat(F.lit("result: "), body, F.lit(" trailing } text")))
        .when(n == 3, F.lit("no object here")).otherwise(F.concat(F.lit("["), body, F.lit("]")))
    )
    talk = v.table("conversations")
    made = talk.select("conv_id", "turn", F.lit("made").alias("kind"), raw.alias("raw"))
    both = made.unionByName(talk.select("conv_id", "turn", F.lit("text").alias("kind"), F.col("text").alias("raw")))
    x = both.select("conv_id", "turn", "kind", jsontext.extract_json_object("raw").alias("x"))
    parsed = F.from_json("x.payload", "role string, n bigint")
    return x.select("conv_id", "turn", "kind", parsed["role"].alias("role"), parsed["n"].alias("n"), "x.error")


@query("stage_percent", """
WITH e AS (
  SELECT event_id, event_type, (json_extract(props, '$.k'))::INT AS k,
    CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 10 WHEN 'signup' THEN 40 WHEN 'purchase' THEN 75 END AS s,
    CASE event_type WHEN 'view' THEN 10 WHEN 'click' THEN 40 WHEN 'signup' THEN 70 WHEN 'purchase' THEN 95 END AS t
  FROM events)
SELECT event_id, round(CASE WHEN s IS NULL THEN 0.0 WHEN event_type = 'signup' THEN s
    ELSE s + (t - s) * least(greatest(k / 100.0::DOUBLE, 0), 1) END::DOUBLE, 6) AS percent FROM e""")
def stage_percent(v):
    pct = timing.stage_percent(F.col("stage"), F.col("status"), F.col("current"), F.col("total"))
    return v.events().select("event_id", F.round(pct, 6).alias("percent"))


@query("elapsed_seconds", """
SELECT 'run_' || c_custkey AS id, CASE WHEN c_custkey % 5 <> 1 THEN round((c_custkey % 13) * 1.25::DOUBLE, 3) END AS elapsed_seconds
FROM customer""")
def elapsed_seconds(v):
    r = v.runs().select("id", F.col("started_at").cast("string").alias("a"), F.col("completed_at").cast("string").alias("b"))
    return r.select("id", timing.elapsed_seconds(F.col("a"), F.col("b")).alias("elapsed_seconds"))


@query("legacy_objects", """
WITH o AS (
  SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN ['steel', p_type] ELSE [] END AS material,
         CASE p_size % 4 WHEN 0 THEN [string_split(p_name, ' ')[1]] ELSE [] END AS color, p_name, p_size FROM part)
SELECT 'obj_' || p_partkey AS id, array_to_string(material, ',') AS material, array_to_string(color, ',') AS color,
  p_name AS stable_description, (len(material) + len(color) > 0)::INT AS parts,
  CASE WHEN len(material) + len(color) > 0 THEN '整体（旧版）' END AS part, p_size / 50.0::DOUBLE AS summary_confidence FROM o""")
def legacy_objects(v):
    size = F.col("p_size")
    rows = v.table("part").select(
        F.concat(F.lit("obj_"), F.col("p_partkey").cast("string")).alias("id"), F.lit("active").alias("status"),
        F.when(size % 3 == 0, F.to_json(F.array(F.lit("steel"), "p_type"))).when(size % 3 == 1, "{not json")
        .alias("material_json"),
        F.when(size % 4 == 0, F.to_json(F.array(F.split_part("p_name", F.lit(" "), F.lit(1))))).otherwise("[]").alias("color_json"),
        F.col("p_name").alias("description"), (size / 50.0).alias("annotation_confidence"))
    o = read_legacy_objects(rows)
    return o.select("id", F.array_join("material", ",").alias("material"), F.array_join("color", ",").alias("color"),
                    "stable_description", F.size("part_appearance").alias("parts"),
                    F.get("part_appearance", F.lit(0))["part"].alias("part"), "summary_confidence")


@query("object_cards", """
SELECT 'obj_' || p_partkey AS object_id, p_name AS name, to_json({'object_id': 'obj_' || p_partkey, 'summary': {
   'object_name_zh': p_name, 'coarse_category': p_type, 'fine_category': p_brand,
   'stable_description': p_brand || ' ' || p_name, 'stable_identity_features': string_split(p_name, ' '),
   'brand_or_markings': [p_brand],
   'part_appearance': [{'part': 'body', 'color': [string_split(p_name, ' ')[1]], 'material': [p_type]}]}})::VARCHAR AS card
FROM part WHERE p_size % 5 <> 0""")
def cards(v):
    from sightledger.operators.review import card_payload
    slim = v.objects().withColumn("summary", F.col("summary").dropFields("summary_confidence"))
    payload = card_payload(slim).select(F.col("id").alias("object_id"), "card")
    return object_cards(slim).select("object_id", F.col("summary.object_name_zh").alias("name")).join(payload, "object_id")
