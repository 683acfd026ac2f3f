"""Near-duplicates, repeated passages, fingerprints and shards against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sightledger.llm import base as B, minhash, order_minhash, sharding, substring

SCHEMA = "doc_id long, text string, key long, component string, n_words long, __block string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, 5, "c", 7, "x") for i, t in rows], SCHEMA).repartition(parts)


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def brute_components(rows, percent, k):
    sets = {}
    for i, t in rows:
        w = words(lower(t))
        grams = {tuple(w[j:j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
        sets.setdefault(i, []).append(grams)
    ids = sorted(sets)
    comp = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if comp[a] > comp[b] and any(
                        x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                    comp[a] = comp[b]
                    changed = True
    return sets, comp


@pytest.fixture(scope="module")
def near_rows():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)] + ["É", "ß.", "日本"]
    rows = [(0, None), (1, ""), (2, " \n "), (3, "one two"), (4, "ONE two"), (5, "one two three"), (6, "x " * 4000), (7, "x " * 4000)]
    at = 10
    for _ in range(4):
        origin = [rng.choice(vocabulary) for _ in range(120)]
        for _ in range(14):
            copy = list(origin)
            for _ in range(rng.randrange(0, 9)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((at, " ".join(copy)))
            at += 1
        rows += [(at + 1000, rows[-1][1]), (at + 2000, rows[-1][1].upper())]
    rows += [(900 + i, " ".join(rng.choice(vocabulary) for _ in range(60))) for i in range(30)]
    return rows


@pytest.mark.parametrize("chunk", [512, 4])
def test_near_duplicates(spark, near_rows, chunk, monkeypatch):
    monkeypatch.setattr(minhash, "CHUNK", chunk)
    sets, comp = brute_components(near_rows, 85, 5)
    got = minhash.near_duplicates(frame(spark, near_rows)).collect()
    assert len(got) == len(near_rows)
    for r in got:
        assert r.n_shingles in {len(s) for s in sets[r.doc_id]}
        assert (r.component_id, r.kept) == (comp[r.doc_id], comp[r.doc_id] == r.doc_id)


def test_pipeline_drops_near_copies_from_80_percent(spark):
    import corpus_pipeline

    rng = random.Random(12)
    rows = []
    for n in range(300):
        origin = [f"v{rng.randrange(10 ** 6)}" for _ in range(120)]
        copy = list(origin)
        for at in (20, 60)[:1 + n % 2]:  # five or ten of 116 shingles change: similarity 0.917 or 0.841
            copy[at] = "other"
        if n % 3 == 0:
            copy[100:101] = ["x", "y"]   # 0.84 and 0.78: some pairs below
        rows += [(2 * n, " ".join(origin)), (2 * n + 1, " ".join(copy))]
    sets, comp = brute_pairs(rows, 80)
    assert sum(0.80 <= s < 0.85 for s in sets) >= 100 and sum(s < 0.80 for s in sets) >= 30
    docs = frame(spark, rows)
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()} == comp
    assert minhash.bands_for(85) == (minhash.BANDS, minhash.ROWS)
    for percent in (30, 50, 80, 85, 95):
        bands, width = minhash.bands_for(percent)
        assert (1 - (percent / 100) ** width) ** bands <= 4e-6


def test_slices_of_the_exact_pass_grow_with_the_texts():
    for octets in (10 ** 9, 30 * 10 ** 9, 10 ** 12):
        cells, slices = substring.shape_for(octets)
        assert cells <= substring.MAX_CELL_BITS and octets / 6.9 / 2 ** slices <= 2 ** (substring.ENTRY_BITS + 1)
    assert substring.shape_for(5 * 10 ** 8) == (28, 6)


def brute_pairs(rows, percent):
    """Similarity of every pair (2n, 2n + 1), and the documents that stay."""
    out, kept = [], set()
    for (i, a), (j, b) in zip(rows[::2], rows[1::2]):
        a, b = ({tuple(w[n:n + 5]) for n in range(len(w) - 4)} for w in (words(a), words(b)))
        out.append(len(a & b) / len(a | b))
        kept |= {i} if 100 * len(a & b) >= percent * len(a | b) else {i, j}
    return out, kept


def test_near_duplicates_null_ids_repeats_and_empty(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "p q r s t u"), (2, "p q r s t u"), (2, "p q r s t u"), (3, "other")]
    got = Counter(tuple(r) for r in minhash.near_duplicates(frame(spark, rows)).collect())
    assert got == Counter([(None, 2, None, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), (3, 1, 3, True)])
    kept = minhash.keep_one(frame(spark, rows))
    assert kept.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3]
    assert minhash.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_many_minima_are_right():
    sets = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 50, dtype=np.uint64))
    low = minhash.minima(sets, np.array([0, 20, 20, 50]))
    x = (sets >> np.uint64(32)).astype(object)
    a, b = (int(v) for v in minhash._FN[3])
    f = lambda v: (v * (2 * a + 1) + b) % (1 << 32)
    assert low[3].tolist() == [min(map(f, x[:20])), 0xFFFFFFFF, min(map(f, x[20:]))]


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 202), (202, 200)]
    random.Random(2).shuffle(edges)
    got = dict(minhash.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 30)}, 201: 200, 202: 200}
    assert minhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_repeats(rows, window):
    count = Counter()
    for _, t in rows:
        w = words(t)
        count.update(tuple(w[i:i + window]) for i in range(len(w) - window + 1))
    for i, t in rows:
        w = words(t)
        kept = [True] * len(w)
        for j in range(len(w) - window + 1):
            if count[tuple(w[j:j + window])] > 1:
                kept[j:j + window] = [False] * window
        yield i, len(w), len(w) - sum(kept), " ".join(x for x, y in zip(w, kept) if y)


@pytest.mark.parametrize("bits, parts, merged", [(None, 3, 256), (4, 1, 256), (12, 6, 2)])
def test_repeated_windows(spark, bits, parts, merged, monkeypatch):
    monkeypatch.setattr(substring, "MERGED_TASKS", merged)
    monkeypatch.setattr(substring, "FLUSH_WINDOWS", 50)
    monkeypatch.setattr(substring, "FLUSH_ENTRIES", 20)
    rng = random.Random(7)
    passage = [f"p{i}" for i in range(12)]
    rows = [(0, None), (1, ""), (2, "  a  b \n\n c  "), (3, "z " * 300), (4, " ".join(passage)), (5, "\t" + " ".join(passage) + " ")]
    for i in range(6, 40):
        w = [rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(rng.randrange(0, 90))]
        if i % 3 == 0:
            at = rng.randrange(len(w) + 1)
            w[at:at] = passage[rng.randrange(3):]
        rows.append((i, "  ".join(w) if i % 4 else " ".join(w)))
    rows.append((39, rows[-1][1]))
    out = substring.remove_repeats(frame(spark, rows, parts), window=7, cell_bits=bits)
    assert out.columns == ["doc_id", "text", "key", "component", "n_words", "n_removed", "kept_text"]
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in out.collect())
    assert got == Counter(brute_repeats(rows, 7))
    assert substring.remove_repeats(frame(spark, rows).limit(0)).count() == 0


def test_gap_coding():
    rng = np.random.default_rng(4)
    for top in (3, 1000, 1 << 22, 1 << 29):
        cells = np.sort(rng.integers(0, top, 500))
        assert substring._decode(substring._encode(cells)).tolist() == cells.tolist()
    assert substring._twice(np.array([1, 1, 1, 2, 3, 3])).tolist() == [1, 1, 2, 3, 3]


def test_grams_follow_their_formula():
    h = np.random.default_rng(6).integers(0, 1 << 63, 50, dtype=np.uint64)
    for k in (1, 2, 5, 7, 35):
        want = []
        for i in range(len(h) - k + 1):
            total = 0
            for x in h[i:i + k]:
                total = (total * B.GRAM_BASE + int(x)) % (1 << 64)
            want.append(total)
        assert B.grams(h, k).tolist() == B.mix(np.array(want, np.uint64)).tolist()
    assert len(B.grams(h[:3], 5)) == 0


def test_fingerprints_and_edits(spark):
    rng = random.Random(3)
    vocabulary = [f"v{i}" for i in range(500)]
    rows = [(i * 2, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60, 400)))) for i in range(60)]
    rows += [(500, None), (501, ""), (502, "one"), (503, "日本語" * 400), (504, rows[3][1]), (700, "tie"), (700, "tie too")]
    got = order_minhash.with_edited(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: (-r[0], r[1] or ""))
    want = Counter()
    for (i, t), (_, u) in zip(order, order[1:] + order[:1]):
        t, u = t or "", u or ""
        e = t[:len(t) - len(t) // 2] + u[:len(t) // 2]
        want[(i, len(t), hashlib.sha256(e.encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    by = {r.doc_id: r for r in got}
    assert by[504].fingerprint == by[6].fingerprint and by[500].fingerprint == by[501].fingerprint == "0" * 384
    long_ = [r for r in got if r.doc_id < 120]
    assert np.mean([r.near_edited for r in long_]) > 0.08 > np.mean([r.near_next for r in long_])
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    lonely = order_minhash.with_edited(frame(spark, [(None, "a b c d"), (9, "e f g h")])).collect()
    assert {(r.doc_id, r.near_next) for r in lonely} == {(None, 1.0), (9, 1.0)}
    assert order_minhash.with_edited(frame(spark, rows).limit(0)).count() == 0


def test_order_counts():
    def one(text):
        return order_minhash.signatures(*B.utf8(pa.array([text])))[0]

    w = [f"t{i}" for i in range(200)]
    a, b, c = one(" ".join(w)), one(" ".join(w[100:] + w[:100])), one(" ".join(w[:190] + ["x"] * 10))
    assert order_minhash.likeness(a, c) > order_minhash.likeness(a, b) > 0
    assert order_minhash.likeness(one("a b a b a b"), one("a b a b")) < 1


def test_sharding(spark):
    rows = [(i, "y" * (i * 37 % 900)) for i in range(400)] + [(None, "n"), (None, None), (7, "z" * 5000), (8, "")]
    rows += [(77, "same")] * 300 + [(78, "s" * (i % 50)) for i in range(100)]
    clash = frame(spark, rows).withColumn("cell", F.lit("user's")).withColumn("depth", F.lit(1.5)).withColumn("page", F.lit("old"))
    out = sharding.assign(clash, 2000)
    assert out.select("cell", "depth").distinct().collect() == [("user's", 1.5)]
    got = out.collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows)
    size, n, leaves = Counter(), Counter(), {}
    for r in got:
        h = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:15], 16)
        assert r.shard == "b" + format(h, "060b")[:r.local_depth] and r.n_bytes == len(r.text or "") + sharding.ROW_BYTES
        size[r.shard, r.page] += r.n_bytes
        n[r.shard, r.page] += 1
        leaves[r.shard] = r.local_depth
    assert all(s <= 2000 or n[k] == 1 for k, s in size.items())
    total = Counter()
    for r in got:
        for d in range(r.local_depth):
            total[r.shard[:d + 1]] += r.n_bytes
    assert all(total[k[:d + 1]] > 2000 for k, depth in leaves.items() for d in range(depth))  # only oversized buckets split
    assert len([k for k in size if k[0] == got[0].shard or True]) > 50
    assert sharding.assign(frame(spark, rows).limit(0), 2000).count() == 0


def test_sharding_directories_follow_buckets_and_are_not_all_sent(spark, monkeypatch):
    """Directories beyond the first grow with the buckets, not the rows, and large ones are joined by shuffling."""
    made, directory = [], sharding._directory
    monkeypatch.setattr(sharding, "_directory", lambda *a: made.append(directory(*a)) or made[-1])
    monkeypatch.setattr(sharding, "SENT_ROWS", 1000, raising=False)
    n, limit = 300_000, 80 * sharding.ROW_BYTES
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    out = sharding.assign(docs, limit)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    rows = out.select("shard", "n_bytes", "local_depth").toPandas()
    assert len(rows) == n
    size = rows.groupby("shard")["n_bytes"].agg(["sum", "size"])
    assert ((size["sum"] <= limit) | (size["size"] == 1)).all()
    below = Counter()
    for shard, n_bytes in size["sum"].items():
        for d in range(1, len(shard)):
            below[shard[:d]] += n_bytes
    assert all(n_bytes > limit for n_bytes in below.values())
    open_prefixes = made[0].filter("depth is null").count()
    assert open_prefixes > 100 and made[1].count() <= 16 * open_prefixes < n / 4


def test_sharding_files(spark, tmp_path):
    docs = frame(spark, [(i, "y" * 100) for i in range(100)])
    assigned = sharding.assign(docs, 1000).select("doc_id", "text", "shard", "page")
    sharding.write_shards(assigned, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 100 and back.groupBy("shard", "page").count().agg(F.max("count")).first()[0] <= 8
