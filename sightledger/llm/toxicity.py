"""Toxic passages by maximum-scoring segments over token log-odds.

Training. The numbers of labelled texts that hold a word give log-odds with an informative Dirichlet prior, whose weights
are the words' counts over all documents; words without significant odds cost a small drift, so chance
segments die out. Scoring. One linear scan (all maximal segments, as Ruzzo and Tompa define them) finds
every passage; its score turns into an expected number of chance passages by the extreme-value law of
maximal segments, calibrated on clean texts, and a logistic curve on those statistics gives the score.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sightledger.llm import base as B

MAX_LABELLED = 20_000  # labelled texts a model is fitted on, at most
STEMS = (4, 5, 6, 8)    # bytes of a word's beginnings that are features of their own
MAX_WORDS = 8_192      # words with log-odds, at most
PRIOR = 500.0          # total weight of the Dirichlet prior
LEAST_ROOT = 4.5       # signed root of the likelihood ratio a word's counts must reach
DRIFT = 0.4
TOP_SCORE = 6.0
REJECT = 0.7           # texts that score this or more are predicted toxic
EXPECTED = 0.05        # a passage is significant below this many chance passages

_VALUES = B.byte_values(606, lower=True)
# Letters make words: A-Z, a-z and every byte of a longer UTF-8 character.
_OTHER = np.ones(256, bool)
_OTHER[65:91] = _OTHER[97:123] = False
_OTHER[128:] = False


@dataclass
class Model:
    words: np.ndarray                 # sorted word hashes
    scores: np.ndarray                # score of each
    decay: float = 1.0                # lambda of the extreme-value law
    location: float = 0.0             # mean and width of decay * best - log(n) over clean texts
    width: float = 1.0
    weights: np.ndarray = field(default_factory=lambda: np.zeros(4))


def held_out() -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))



def _word_hashes(data, offsets):
    """One row of hashes per word: the word, and its beginnings (again the word where it is not longer)."""
    starts, ends, first = B.spans(data, offsets, _OTHER)
    h = [B.piece_hashes(data, starts, np.minimum(ends, starts + k), _VALUES, B.WORD_BASE) for k in (1 << 30, *STEMS)]
    return np.stack(h, 1), first, starts, ends


def _counts():
    schema = pa.schema([("h", pa.int64()), ("half", pa.int64()), ("toxic", pa.int64()), ("clean", pa.int64())])

    def run(batches):
        for part, data, offsets in B.blocks(batches):
            h, first, *_ = _word_hashes(data, offsets)
            row = np.repeat(np.arange(part.num_rows), np.diff(first) * h.shape[1])
            h = h.ravel()
            # A word or stem counts once in a text, so one text's refrain says no more than a mention.
            once = np.unique(h + B.mix(row.astype(np.uint64) + np.uint64(1)), return_index=True)[1]
            h, row = h[once], row[once]
            label, half = (part.column(c).to_numpy()[row] for c in ("toxic", "half"))
            for side in (0, 1):
                mine = half == side
                words, at = np.unique(h[mine], return_inverse=True)
                bad = np.bincount(at, weights=label[mine], minlength=len(words)).astype(np.int64)
                total = np.bincount(at, minlength=len(words))
                yield B.record(schema, words.view(np.int64), np.full(len(words), side), bad, total - bad)

    return run


def _lookup(words, h):
    """Position of each hash in the sorted words, or -1."""
    if not len(words):
        return np.full(len(h), -1)
    # A short direct table on the top bits leaves the full search to the few that may be known.
    flags = np.zeros(1 << 16, bool)
    flags[(words >> np.uint64(48)).astype(np.int64)] = True
    out = np.full(len(h), -1)
    maybe = np.flatnonzero(flags[(h >> np.uint64(48)).astype(np.int64)])
    at = np.minimum(np.searchsorted(words, h[maybe]), len(words) - 1)
    out[maybe] = np.where(words[at] == h[maybe], at, -1)
    return out


def _background(words):
    schema = pa.schema([("word", pa.int32()), ("n", pa.int64())])

    def run(batches):
        total, every = np.zeros(len(words), np.int64), 0
        for _, data, offsets in B.blocks(batches):
            h, *_ = _word_hashes(data, offsets)
            for k in range(h.shape[1]):
                # A word that is not longer than a stem is that stem: it counts once.
                mine = h[:, k] if k == 0 else h[(h[:, k] != h[:, :k].T).all(0), k]
                at = _lookup(words, mine)
                total += np.bincount(at[at >= 0], minlength=len(words))
            every += len(h)
        seen = np.flatnonzero(total)
        yield B.record(schema, np.append(seen, -1), np.append(total[seen], every))

    return run


def _scan(model, data, offsets):
    """Per row: words, and the maximal segments as (score, first word, last word)."""
    h, first, starts, ends = _word_hashes(data, offsets)
    high, low = np.zeros(len(h)), np.zeros(len(h))
    for k in range(h.shape[1]):
        at = _lookup(model.words, h[:, k])
        hit = np.flatnonzero(at >= 0)
        high[hit] = np.maximum(high[hit], model.scores[at[hit]])
        low[hit] = np.minimum(low[hit], model.scores[at[hit]])
    # The most toxic reading of a word counts; without one, the cleanest.
    value = np.where(high > 0, high, low)
    known = np.flatnonzero(value != 0)
    rows = np.searchsorted(first, known, "right") - 1
    values = value[known]
    cuts = np.searchsorted(rows, np.arange(len(first)))
    found = [maximal(values[a:b].tolist(), (known[a:b] - first[i]).tolist(), DRIFT) if b > a else []
             for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))]
    return np.diff(first), found, first, starts, ends


def maximal(scores: list[float], places: list[int], drift: float) -> list[tuple[float, int, int]]:
    """All maximal scoring segments, in order: (score, first place, last place).

    Places that are not listed cost ``drift`` each. A new positive item joins the nearest earlier segment that
    starts lower, unless that one ends at least as high; each item is stacked once, so the scan is linear apart
    from the search for that segment, which runs over segments that stay apart.
    """
    held: list[tuple[float, float, int, int]] = []  # total before, total after, first place, last place
    total, before = 0.0, -1
    for score, place in zip(scores, places):
        total -= drift * (place - before - 1)
        before = place
        if score <= 0:
            total += score
            continue
        new = (total, total + score, place, place)
        total += score
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][0] >= new[0]:
                j -= 1
            if j < 0 or held[j][1] >= new[1]:
                held.append(new)
                break
            new = (held[j][0], new[1], held[j][2], new[3])
            del held[j:]
    return [(right - left, first, last) for left, right, first, last in held]


def _statistics(model, n, scores):
    """Features of a text: extreme-value deviate of its best passage, weight of its significant ones, their number."""
    if not scores or not n:
        return 0.0, 0.0, 0.0
    deviate = (model.decay * max(scores) - math.log(n) - model.location) / model.width
    chosen = [s for s in scores if expected(model, n, s) <= EXPECTED]
    return min(max(deviate, 0.0), 20.0), math.log1p(sum(chosen)), math.log1p(len(chosen))


def expected(model: Model, n: int, score: float) -> float:
    """Chance passages of at least this score in n words of clean text."""
    deviate = (model.decay * score - math.log(max(n, 1)) - model.location) / model.width
    return math.exp(-max(min(deviate * math.pi / math.sqrt(6) + 0.5772, 500.0), -500.0))


def _passages(model):
    schema = pa.schema([("toxic", pa.int32()), ("n", pa.int64()), ("scores", pa.list_(pa.float64()))])

    def run(batches):
        for part, data, offsets in B.blocks(batches):
            n, found, *_ = _scan(model, data, offsets)
            yield B.record(schema, part.column("toxic").cast(pa.int32()), n, [[s for s, _, _ in f] for f in found])

    return run


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights by Newton steps with a weak ridge; more toxic evidence never lowers a score, so none is negative."""
    use = list(range(x.shape[1]))
    while True:
        z = np.column_stack([np.ones(len(x)), x[:, use]])
        w = np.zeros(z.shape[1])
        ridge = np.diag([1e-3] + [0.05] * len(use))
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge, z.T @ (y - p) - ridge @ w)
            w += step
            if np.abs(step).max() < 1e-8:
                break
        if not use or w[1:].min() >= 0:
            out = np.zeros(x.shape[1] + 1)
            out[[0] + [i + 1 for i in use]] = w
            return out
        del use[int(w[1:].argmin())]


def _decay(scores, share):
    """The positive root of sum(share * exp(root * score)) = 1, for scores with a negative mean."""
    low, high = 0.0, 1e-3
    gain = lambda r: float((share * np.exp(np.minimum(r * scores, 700))).sum()) - 1
    while gain(high) < 0 and high < 50:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if gain(mid) < 0 else (low, mid)
    return high


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Fit on at most ``max_labelled`` labelled rows outside the held-out third, chosen by hash of doc_id.

    Half of them give the log-odds, the other half the calibration. Without labelled texts of both classes
    every text scores 0.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    chosen = labels.filter("doc_id is not null and toxic in (0, 1)").filter(~held_out())
    chosen = chosen.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(max_labelled)
    chosen = chosen.withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(2)))
    # At most max_labelled small rows.
    picked = spark.createDataFrame([tuple(r) for r in chosen.select("doc_id", "toxic", "half").collect()],
                                   "doc_id long, toxic int, half long")
    # Copies of one text are one witness.
    labelled = docs.join(F.broadcast(picked), "doc_id").withColumn("text", F.coalesce("text", F.lit("")))
    labelled = B.table(labelled.groupBy("text").agg(F.max("toxic").alias("toxic"), F.min("half").alias("half")))
    counts = labelled.select("text", "toxic", "half").mapInArrow(_counts(), "h long, half long, toxic long, clean long")
    side = lambda c, k: F.sum(F.when(F.col("half") == k, F.col(c)).otherwise(0)).alias(f"{c}{k}")
    counts = counts.groupBy("h").agg(side("toxic", 0), side("clean", 0), side("toxic", 1), side("clean", 1))
    counts = B.table(counts.withColumn("toxic", F.expr("toxic0 + toxic1")).withColumn("clean", F.expr("clean0 + clean1")))
    sums = counts.agg(*[F.sum(c).alias(c) for c in ("toxic0", "clean0", "toxic1", "clean1", "toxic", "clean")]).first()
    if not sums.toxic or not sums.clean:
        return Model(np.zeros(0, np.uint64), np.zeros(0), weights=np.array([-30.0, 0, 0, 0]))
    share = sums.toxic / (sums.toxic + sums.clean)
    part = lambda c, p: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / ((F.col("toxic") + F.col("clean")) * p))).otherwise(0.0)
    # At most MAX_WORDS rows reach the driver: those whose counts differ most between the classes.
    top = counts.filter("toxic + clean >= 3").orderBy((part("toxic", share) + part("clean", 1 - share)).desc(), "h").limit(MAX_WORDS).collect()
    words = np.array([r.h for r in top], np.int64).view(np.uint64)
    order = np.argsort(words)
    words = words[order]
    got = {c: np.array([r[c] for r in top], float)[order] for c in ("toxic0", "clean0", "toxic1", "clean1", "toxic", "clean")}
    ground, every = np.zeros(len(words)), 1
    seen = docs.select("text").mapInArrow(_background(words), "word int, n long").groupBy("word").agg(F.sum("n").alias("n"))
    for row in seen.toLocalIterator():
        if row.word < 0:
            every = max(row.n, 1)
        else:
            ground[row.word] = row.n
    prior = PRIOR * np.maximum(ground, 1) / every + 0.25

    def fitted(side):
        return _odds(words, got["toxic" + side], got["clean" + side], sums["toxic" + side], sums["clean" + side], prior)

    # Each half is scored by the odds of the other one, so the calibration never sees a text twice.
    x, y, laws = [], [], []
    for mine, other in (("0", 1), ("1", 0)):
        model = fitted(mine)
        rows = labelled.filter(F.col("half") == other).select("text", "toxic").mapInArrow(
            _passages(model), "toxic int, n long, scores array<double>").collect()
        base = [model.decay * max(r.scores, default=0.0) - math.log(r.n) for r in rows if not r.toxic and r.n]
        if len(base) > 1:
            model.location, model.width = float(np.mean(base)), max(float(np.std(base)), 0.5)
        laws.append((model.location, model.width))
        x += [_statistics(model, r.n, r.scores) for r in rows]
        y += [r.toxic for r in rows]
    model = fitted("")
    model.location, model.width = (float(v) for v in np.mean(laws, 0))
    model.weights = _logistic(np.array(x), np.array(y, float)) if len(set(y)) == 2 else np.array([-30.0, 0, 0, 0])
    return model


def _odds(words, toxic, clean, all_toxic, all_clean, prior) -> Model:
    """Log-odds with the prior's pseudo-counts; words whose counts could be chance are left to the drift."""
    weight = prior.sum()
    odds = np.log((toxic + prior) / (all_toxic + weight - toxic - prior)) - np.log((clean + prior) / (all_clean + weight - clean - prior))
    share = all_toxic / max(all_toxic + all_clean, 1)
    part = lambda c, p: np.where(c > 0, c * np.log(np.maximum(c, 1) / np.maximum((toxic + clean) * p, 1e-9)), 0)
    root = np.sqrt(np.maximum(2 * (part(toxic, share) + part(clean, 1 - share)), 0))
    strong = root >= LEAST_ROOT
    model = Model(words[strong], np.clip(odds[strong], -TOP_SCORE, TOP_SCORE) - DRIFT)
    usual = np.append((clean[strong] + prior[strong]) / (all_clean + weight), 0)
    usual[-1] = max(1 - usual.sum(), 1e-9)
    model.decay = _decay(np.append(model.scores, -DRIFT), usual)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` with ``toxicity`` (0 to 1) and ``toxic_passages``: code point spans of significant passages.

    Input columns of these names are replaced. Null and empty texts have no passage and get the score of a
    text without one. Rows are scored alone, so repeated rows score alike; an empty table gives none.
    """
    names = [c for c in docs.columns if c not in ("toxicity", "toxic_passages")]
    docs = docs.select(*[F.col(f"`{c}`") for c in names])
    passage = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())])

    def run(batches):
        w = model.weights
        for part, data, offsets in B.blocks(batches):
            n, found, first, starts, ends = _scan(model, data, offsets)
            out, spans = np.empty(len(n)), []
            for i, f in enumerate(found):
                x = _statistics(model, int(n[i]), [s for s, _, _ in f])
                out[i] = 1 / (1 + math.exp(-max(min(w[0] + sum(a * b for a, b in zip(w[1:], x)), 30.0), -30.0)))
                mine = []
                for s, p, q in f:
                    e = expected(model, int(n[i]), s)
                    if e <= EXPECTED:
                        text = data[offsets[i]:offsets[i + 1]]
                        lead = (text & 0xC0) != 0x80
                        a, b = int(starts[first[i] + p] - offsets[i]), int(ends[first[i] + q] - offsets[i])
                        mine.append({"start": int(lead[:a].sum()), "end": int(lead[:b].sum()), "score": s, "expected": e})
                spans.append(mine)
            yield pa.RecordBatch.from_arrays(
                [part.column(part.schema.get_field_index(c)) for c in names]
                + [pa.array(out), pa.array(spans, pa.list_(passage))], names=names + ["toxicity", "toxic_passages"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, toxicity double, toxic_passages "
                                "array<struct<start:long,end:long,score:double,expected:double>>")
