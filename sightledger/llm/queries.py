"""Registered queries of the training-data operators, with SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from sightledger.llm import (
    ann, base as B, bpe, dual_tree, minhash, order_minhash, packing, phrases, prefix_trie, secrets, sharding, substring, toxicity, wavelet)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


WORDS = r"[^\x20\x09-\x0D]+"



@query("op1_wavelet_tokens")
def op1_wavelet_tokens(spark, sf_dir):
    return wavelet.round_trip(B.documents(spark, sf_dir))


@query("op2_secret_forest")
def op2_secret_forest(spark, sf_dir):
    docs = B.documents(spark, sf_dir)
    language = secrets.learn_language(docs)
    # A third of the documents never trains: it is there to measure on.
    learn = docs.filter(~toxicity.held_out())
    forest = secrets.train(secrets.findings(learn, language).unionByName(secrets.made(learn, language)))
    return secrets.scan(docs, language, forest).withColumn("held_out", toxicity.held_out())


@query("op3_kmeans_tree")
def op3_kmeans_tree(spark, sf_dir):
    B.ready(spark)
    vectors = ann.clean(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return ann.neighbours(vectors, vectors.filter("vec_id % 100 = 0"))


@query("op4_minhash_dedup", rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT c.a, c.b FROM c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents LEFT JOIN n USING (doc_id) JOIN m USING (doc_id)""")
def op4_minhash_dedup(spark, sf_dir):
    return minhash.near_duplicates(B.documents(spark, sf_dir))


@query("op5_transducer_bpe")
def op5_transducer_bpe(spark, sf_dir):
    return bpe.digests(B.documents(spark, sf_dir))


@query("op6_order_minhash")
def op6_order_minhash(spark, sf_dir):
    return order_minhash.with_edited(B.documents(spark, sf_dir))


@query("op7_online_packing")
def op7_online_packing(spark, sf_dir):
    return packing.pack(B.documents(spark, sf_dir))


@query("op8_toxic_segments")
def op8_toxic_segments(spark, sf_dir):
    docs = B.documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = toxicity.score(docs, model)
    return out.select("doc_id", toxicity.held_out().alias("held_out"), F.col("toxicity").alias("score"),
                      (F.col("toxicity") >= toxicity.REJECT).cast("int").alias("predicted"),
                      F.size("toxic_passages").alias("n_passages"))


SHARD_BYTES = 1 << 20


@query("op9_extendible_sharding", f"""
WITH h AS (SELECT doc_id, strlen(coalesce(text, '')) + {sharding.ROW_BYTES} AS bytes,
                  ('0x' || left(md5(doc_id::VARCHAR), {sharding.BITS // 4}))::BIGINT AS h FROM documents),
p AS (SELECT doc_id, bytes, h, d, h >> ({sharding.BITS} - d) AS prefix
      FROM (SELECT *, unnest(range(0, {sharding.BITS + 1})) AS d FROM h)),
fits AS (SELECT d, prefix FROM p GROUP BY ALL HAVING sum(bytes) <= {SHARD_BYTES} OR count(*) = 1),
leaf AS (SELECT doc_id, min(d) AS depth FROM p JOIN fits USING (d, prefix) GROUP BY doc_id)
SELECT doc_id, bytes::BIGINT AS n_bytes, depth::INT AS local_depth,
       'b' || left(lpad(bin(h), {sharding.BITS}, '0'), depth) AS shard, 0::BIGINT AS page
FROM h JOIN leaf USING (doc_id)""")
def op9_extendible_sharding(spark, sf_dir):
    docs = B.documents(spark, sf_dir).select("doc_id", "text")
    return sharding.assign(docs, SHARD_BYTES).drop("text")


@query("op10_substring_dedup", rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS ws FROM documents),
p AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 34), ' ') AS k
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)),
rep AS (SELECT k FROM p GROUP BY k HAVING count(*) > 1),
cov AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM p WHERE k IN (SELECT k FROM rep)),
word AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS t, count(*) AS n
         FROM word ANTI JOIN cov USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)""")
def op10_substring_dedup(spark, sf_dir):
    out = substring.remove_repeats(B.documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op11_debruijn_phrases", r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                  'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM p),
i AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
t AS (SELECT lang, ws[i] AS x, ws[i + 1] AS y, ws[i + 2] AS z FROM i),
f1 AS (SELECT lang, x, count(*) AS f FROM t GROUP BY ALL),
f2 AS (SELECT lang, x, y, count(*) AS f FROM t WHERE y IS NOT NULL GROUP BY ALL),
f3 AS (SELECT lang, x, y, z, count(*) AS f FROM t WHERE z IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang),
m AS (SELECT lang, x, y, max(f) AS f FROM (SELECT lang, x, y, f FROM f3 UNION ALL SELECT lang, y, z, f FROM f3) GROUP BY ALL),
c AS (SELECT lang, x || ' ' || y AS phrase, f2.f AS a, 1 AS k, p.f AS l, q.f AS r FROM f2
        JOIN f1 p USING (lang, x) JOIN (SELECT lang, x AS y, f FROM f1) q USING (lang, y) LEFT JOIN m USING (lang, x, y)
      WHERE f2.f >= 10 AND (m.f IS NULL OR 100 * m.f < 50 * f2.f)
      UNION ALL SELECT lang, x || ' ' || y || ' ' || z, f3.f, 1, p.f, q.f FROM f3
        JOIN f1 p USING (lang, x) JOIN (SELECT lang, x AS y, y AS z, f FROM f2) q USING (lang, y, z)
      UNION ALL SELECT lang, x || ' ' || y || ' ' || z, f3.f, 2, p.f, q.f FROM f3
        JOIN f2 p USING (lang, x, y) JOIN (SELECT lang, x AS z, f FROM f1) q USING (lang, z)),
s AS (SELECT *, a::HUGEINT * a * 1000000 // (l::HUGEINT * r) AS score FROM c),
u AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM u)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM o JOIN n USING (lang) WHERE rank <= 2000""")
def op11_debruijn_phrases(spark, sf_dir):
    return phrases.collocations(B.documents(spark, sf_dir))


@query("op12_zfast_trie", """
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
               md5(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
           FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS leader, crc.h FROM (SELECT DISTINCT conv_id FROM t)
      JOIN (WITH RECURSIVE d AS (SELECT DISTINCT conv_id AS k, encode(conv_id::VARCHAR) AS b, 1 AS i, 4294967295::BIGINT AS x FROM t
              UNION ALL
              SELECT k, b, i + 1, e.x FROM d, LATERAL (SELECT xor(d.x, ('0x' || substr(hex(d.b), 2 * d.i - 1, 2))::BIGINT) AS x0),
                LATERAL (SELECT CASE WHEN x0 & 1 = 1 THEN xor(x0 >> 1, 3988292384) ELSE x0 >> 1 END AS x1),
                LATERAL (SELECT CASE WHEN x1 & 1 = 1 THEN xor(x1 >> 1, 3988292384) ELSE x1 >> 1 END AS x2),
                LATERAL (SELECT CASE WHEN x2 & 1 = 1 THEN xor(x2 >> 1, 3988292384) ELSE x2 >> 1 END AS x3),
                LATERAL (SELECT CASE WHEN x3 & 1 = 1 THEN xor(x3 >> 1, 3988292384) ELSE x3 >> 1 END AS x4),
                LATERAL (SELECT CASE WHEN x4 & 1 = 1 THEN xor(x4 >> 1, 3988292384) ELSE x4 >> 1 END AS x5),
                LATERAL (SELECT CASE WHEN x5 & 1 = 1 THEN xor(x5 >> 1, 3988292384) ELSE x5 >> 1 END AS x6),
                LATERAL (SELECT CASE WHEN x6 & 1 = 1 THEN xor(x6 >> 1, 3988292384) ELSE x6 >> 1 END AS x7),
                LATERAL (SELECT CASE WHEN x7 & 1 = 1 THEN xor(x7 >> 1, 3988292384) ELSE x7 >> 1 END AS x) e
              WHERE i <= octet_length(b))
            SELECT k, xor(x, 4294967295) % 6 AS h FROM d WHERE i = octet_length(b) + 1) crc ON crc.k = conv_id),
r AS (SELECT c.conv_id, t.i, t.role, t.text FROM c JOIN t ON t.conv_id = c.leader AND t.i <= c.h
      UNION ALL SELECT c.conv_id, t.i, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.i > c.h),
s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS d, text,
        string_agg(strlen(role)::VARCHAR || ':' || strlen(text)::VARCHAR || ':' || role || text, '' ORDER BY i)
          OVER (PARTITION BY conv_id ORDER BY i) AS key FROM r),
p AS (SELECT conv_id, d, sha256(key) AS node, lag(sha256(key), 1, 'root') OVER (PARTITION BY conv_id ORDER BY d) AS up, length(text) AS chars FROM s
      UNION ALL SELECT conv_id, 0, 'root', NULL, 0 FROM c),
n AS (SELECT node, any_value(d) AS depth, any_value(up) AS up, any_value(chars) AS chars, min(conv_id) AS conv_id, count(*) AS n FROM p GROUP BY node),
k AS (SELECT up AS node, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY up),
a AS (SELECT DISTINCT x.node AS top, y.node FROM p x JOIN p y ON x.conv_id = y.conv_id AND x.d <= y.d),
b AS (SELECT top AS node, count(*) FILTER (k.node IS NULL) AS n_leaves, sum((n.n - 1) * n.chars) AS saved
      FROM a JOIN n USING (node) LEFT JOIN k USING (node) GROUP BY top),
e AS (SELECT node, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
      FROM (SELECT conv_id, arg_max(node, d) AS node FROM p GROUP BY conv_id) GROUP BY node)
SELECT n.conv_id, n.depth::BIGINT AS depth, m.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(n_children, 0)::BIGINT AS n_children,
       n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM n JOIN b USING (node) LEFT JOIN k USING (node) LEFT JOIN e USING (node) LEFT JOIN n m ON m.node = n.up""")
def op12_zfast_trie(spark, sf_dir):
    turns = B.ready(spark).read.parquet(f"{sf_dir}/conversations.parquet")
    return prefix_trie.nodes_of(prefix_trie.rebuilt(turns))


@query("op13_dual_cover_tree", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""")
def op13_dual_cover_tree(spark, sf_dir):
    vectors = B.table(dual_tree.clean(B.ready(spark).read.parquet(f"{sf_dir}/embeddings.parquet")))
    return dual_tree.top_products(vectors, vectors.filter("vec_id % 100 = 0"))
