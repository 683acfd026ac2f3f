"""Collocations against brute force on a small corpus."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sightledger.llm import phrases

KIND = "doc_id long, lang string, text string, a long, n long, word string"
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least, most, share=50):
    counts = {k: Counter() for k in (1, 2, 3)}
    for lang, text in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            ws = re.findall("[^\x20\x09]+", piece)
            for k in counts:
                counts[k].update((lang or "und", *ws[i:i + k]) for i in range(len(ws) - k + 1))
    f = {**counts[1], **counts[2], **counts[3]}
    n = Counter()
    for (lang, _), c in counts[1].items():
        n[lang] += c
    gone = set()
    for key, c in counts[3].items():
        for part in ((key[0], *key[1:3]), (key[0], *key[2:4])):
            if c >= least and 100 * c >= share * f[part]:
                gone.add(part)
    out = {}
    for key, a in [*counts[2].items(), *counts[3].items()]:
        lang, ws = key[0], key[1:]
        if a >= least and key not in gone:
            cuts = [(1_000_000 * a * a // (f[(lang, *ws[:k])] * f[(lang, *ws[k:])]), k) for k in range(1, len(ws))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(ws).encode(), f[(lang, *ws[:k])], f[(lang, *ws[k:])]))
    return sorted((lang, r + 1, p.decode(), -a, left, right, n[lang], -s)
                  for lang, found in out.items() for r, (s, a, p, left, right) in enumerate(sorted(found)[:most]))


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)] + ["É", "ß", "日本", "A\xa0b", "x" * 3000]
    fixed = ["alpha Beta gamma DELTA", "one two", "New york city", "a b a b a b"]
    rows = [(None, None), ("en", ""), (None, " \t "), ("en", ".,;"), ("und", "lost words")]
    for i in range(60):
        parts = [" ".join(rng.choice(vocabulary[:8] if i % 2 else vocabulary) for _ in range(rng.randint(1, 12))) for _ in range(4)]
        rows.append((rng.choice(["en", "fr", None, "EN"]), rng.choice([" ", ". ", "\n", "\t"]).join([*parts, rng.choice(fixed), rng.choice(fixed)])))
    rows += [("fr", "the same line again and again")] * 14
    rows.append(("en", "long text " * 4000))
    return rows


@pytest.mark.parametrize("least,most,bits", [(4, 7, 16), (3, 500, 6)])
def test_phrases_equal_brute_force(spark, monkeypatch, least, most, bits):
    """With 6 bits nearly every cell is full: more edges are kept, the result stays."""
    monkeypatch.setattr(phrases, "FLUSH", 50)
    rows = corpus(2)
    docs = spark.createDataFrame([(i, lang, text, 1, 2, "w") for i, (lang, text) in enumerate(rows)], KIND).repartition(3)
    got = phrases.collocations(docs, least, most, bits=bits)
    assert sorted(map(tuple, got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())) == brute(rows, least, most)


def test_no_phrases_in_an_empty_table(spark):
    assert phrases.collocations(spark.createDataFrame([], KIND)).isEmpty()


def test_unary_paths_are_whole_passages(spark):
    rows = [("fr", "the same line again and again")] * 5 + [("fr", "other same line; again and never")] * 2
    docs = spark.createDataFrame(rows, "lang string, text string")
    graph = phrases.Graph(docs, 2, 16)
    paths = phrases.compacted(graph, phrases.unary_paths(phrases.heavy_edges(graph, 2)))
    assert {(r.phrase, r.n_words, r.n) for r in paths.collect()} == {
        ("the same line", 3, 5), ("same line again and", 4, 5), ("again and again", 3, 5), ("other same line", 3, 2), ("again and never", 3, 2)}
    f = {(r.lang, r.word): r.f for r in graph.words.collect()}
    assert f == {("fr", "the"): 5, ("fr", "same"): 7, ("fr", "line"): 7, ("fr", "again"): 12, ("fr", "and"): 7, ("fr", "other"): 2, ("fr", "never"): 2}
    assert graph.languages.first().n == sum(f.values()) and graph.nodes.agg(F.sum("f")).first()[0] <= 42
