"""Secret scans: broad candidates, then a random forest that removes the false positives.

Candidates are runs that look machine-made. The forest sees their length, kinds of characters, transitions
(how usual the byte pairs are in the corpus), dictionary coverage (how much of them is frequent words), the
path of the document and the neighbouring words, and is trained on labelled findings. Trees come from Spark's
forest; they are scored inside the scan, so texts are never joined or shuffled.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from sightledger.llm import base as B

SLOT_BITS = 18            # cells of the word counts
LEAST = 8                 # bytes of a candidate
MAX_FINDINGS = 20_000     # labelled findings a forest is fitted on, at most
TREES, DEPTH = 40, 8
THRESHOLD = 0.5

_VALUES = B.byte_values(111, lower=True)
_DIGIT = np.zeros(256, np.int64)
_DIGIT[48:58] = 1
_OTHER = np.ones(256, bool)
_OTHER[65:91] = _OTHER[97:123] = False
_OTHER[128:] = False

# Letters (either case) and digits as bits; what else a word holds does not count.
_BIT = np.zeros(256, np.uint64)
for _i, _c in enumerate(b"abcdefghijklmnopqrstuvwxyz0123456789"):
    _BIT[[_c, ord(chr(_c).upper())]] = np.uint64(1 << _i)
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_SIGN = np.zeros(256, bool)
_SIGN[[ord("="), ord(":")]] = True
# The last three letters of the words of _KEY.
_KEY_ENDS = np.array([int.from_bytes(w.encode()) for w in ("ass", "ord", "swd", "ase", "pwd", "ret", "ken", "key", "ial", "uth")])

_VALUE = re.compile(r"[A-Za-z0-9+/_=.~@-]{8,}")
_KEY = re.compile(r"(?i)(pass(word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth)\W{0,3}$")
_ASSIGN = re.compile(r"[=:]\s*[\"']?$")
_FORMATS = re.compile(
    r"(AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_-]{20,}|[sr]k_live_[A-Za-z0-9]{16,}|"
    r"xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|npm_[A-Za-z0-9]{36}|SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}|"
    r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
_PLACEHOLDER = re.compile(r"(?i)change.?me|place.?holder|example|dummy|sample|redacted|replace|your[_-]|my[_-]?(pass|secret|token|key)|"
                          r"insert|foobar|todo|^x{4}|^(?:pass(?:word)?|secret|token)?0?1234567?8?9?0?$")
_OPAQUE = re.compile(r"[A-Za-z0-9+/_-]{16,}=*")
_TEST_PATH = re.compile(r"(?i)test|example|sample|fixture|mock|doc")
_WORD = re.compile(r"[A-Za-z]{3,}")
# What is written before a digest, an id or a block of encoded data; and values of such a form.
_HARMLESS = re.compile(r"(?i)(?<![a-z])(commit|revision|rev|sha-?\d*|md5|crc\d*|digest|checksum|hash|etag|integrity|fingerprint|uuid|guid|"
                       r"(?:run|trace|request|build|job|object)(?:[_-]?id)?|base64)[\W_]{0,3}$")
_UUID = re.compile(r"(?i)[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}")
_ENCODED = re.compile(r"(?i)data:[a-z]+/[a-z0-9.+-]+;base64,$")
_NAME_LIKE = re.compile(r"[A-Za-z][a-z]+([A-Z][a-z]+)+|[A-Za-z]+([_.-][A-Za-z]+)+")
_NEAR = re.compile(r"[A-Za-z0-9]+")
NEAR_CELLS = 16           # cells of the neighbouring words

FEATURES = ("length", "lower", "upper", "digits", "other", "hex", "entropy", "runs", "transitions", "coverage", "longest_word",
            "dots", "at", "assigned", "key_before", "quoted", "words_before", "words_after", "path_test", "path_length", "digest_before", "uuid", "encoded_before", "name_like",
            *(f"near_{i}" for i in range(NEAR_CELLS)))


@dataclass
class Language:
    """What ordinary text looks like: log frequency of byte pairs, and which word cells are frequent."""
    pairs: np.ndarray
    frequent: np.ndarray


def _cell(h):
    return (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def learn_language(docs: DataFrame) -> Language:
    """Byte pairs and word counts of all texts; tables of fixed size, summed over tasks."""
    schema = pa.schema([("slice", pa.int32()), ("counts", pa.binary())])
    width = 1 << 16

    def count(batches):
        pairs, words = np.zeros(width, np.int64), np.zeros(1 << SLOT_BITS, np.int64)
        for _, data, offsets in B.blocks(batches):
            if len(data) > 1:
                pairs += np.bincount(data[:-1].astype(np.int64) << 8 | data[1:], minlength=width)
            starts, ends, _ = B.spans(data, offsets, _OTHER)
            long_ = ends - starts >= 3
            words += np.bincount(_cell(B.piece_hashes(data, starts[long_], ends[long_], _VALUES, B.WORD_BASE)), minlength=len(words))
        for i, part in enumerate([pairs, *words.reshape(-1, width)]):
            yield B.record(schema, [i], [part.tobytes()])

    def add(rows):
        total = sum(np.frombuffer(x.as_buffer(), np.int64) for x in rows.column("counts"))
        return pa.Table.from_batches([B.record(schema, [rows.column("slice")[0].as_py()], [total.tobytes()])])

    found = docs.select("text").mapInArrow(count, "slice int, counts binary").groupBy("slice").applyInArrow(add, "slice int, counts binary")
    tables = {r.slice: np.frombuffer(bytes(r.counts), np.int64) for r in found.toLocalIterator()}
    pairs = tables.get(0, np.zeros(width)).reshape(256, 256) + 0.5
    words = np.concatenate([tables.get(i + 1, np.zeros(width, np.int64)) for i in range((1 << SLOT_BITS) // width)])
    return Language(np.log(pairs / pairs.sum(1, keepdims=True)).astype(np.float32), words >= max(8.0, 16 * words.mean()))


def features(value: str, before: str, after: str, path: str, language: Language) -> list[float]:
    raw = value.encode("utf-8")
    codes = np.frombuffer(raw, np.uint8)
    n = len(value)
    counts = np.bincount(codes, minlength=256)
    share = counts[counts > 0] / len(raw)
    lower, upper, digits = int(counts[97:123].sum()), int(counts[65:91].sum()), int(counts[48:58].sum())
    hexes = digits + int(counts[97:103].sum() + counts[65:71].sum())
    kind = np.where(_DIGIT[codes] == 1, 1, np.where((codes | 32) - 97 < 26, 2, 3))
    covered, longest = 0, 0
    for m in _WORD.finditer(value):
        word = np.frombuffer(m.group().encode(), np.uint8)
        longest = max(longest, len(word))
        h = B.piece_hashes(word, np.array([0]), np.array([len(word)]), _VALUES, B.WORD_BASE)
        covered += len(word) if language.frequent[_cell(h)[0]] else 0
    return [n, lower / n, upper / n, digits / n, 1 - (lower + upper + digits) / n, hexes / n, float(-(share * np.log2(share)).sum()),
            float((kind[1:] != kind[:-1]).sum()) / n, float(language.pairs[codes[:-1], codes[1:]].mean()) if n > 1 else 0.0,
            covered / n, longest, value.count("."), value.count("@"), float(bool(_ASSIGN.search(before))),
            float(bool(_KEY.search(_ASSIGN.sub("", before).rstrip()))), float(before[-1:] in "\"'" and before != ""),
            len(before.split()), len(after.split()), float(bool(_TEST_PATH.search(path))), len(path),
            float(bool(_HARMLESS.search(before))), float(bool(_UUID.fullmatch(value))), float(bool(_ENCODED.search(before))),
            float(bool(_NAME_LIKE.fullmatch(value))), *_neighbours(before, after)]


def _neighbours(before: str, after: str) -> list[float]:
    """The three words before and the one after a value, hashed to cells; nearer ones weigh more."""
    cells = [0.0] * NEAR_CELLS
    words = [(d, w) for d, w in enumerate(reversed(_NEAR.findall(before)[-3:]))] + [(1, w) for w in _NEAR.findall(after)[:1]]
    for distance, word in words:
        cells[zlib.crc32(word.lower().encode()) % NEAR_CELLS] += 1 / (1 + distance)
    return cells


def weak_label(value: str, before: str, path: str = "") -> int | None:
    """A finding's label where nobody labelled it; None if there is no evidence.

    Secrets are fixed formats and values with digits assigned to a telling name, unless the path is a test's.
    Placeholders are none, nor are hexadecimal digests and ids after their own names and encoded images. Opaque values
    without a name, and named words, can be either and train nothing.
    """
    if _FORMATS.fullmatch(value):
        return 1
    if _PLACEHOLDER.search(value) or len(set(value)) < 5:
        return 0
    if _ASSIGN.search(before) and _KEY.search(_ASSIGN.sub("", before).rstrip()):
        return 1 if any(c.isdigit() for c in value) and not _TEST_PATH.search(path) else None
    if _ENCODED.search(before) or _HARMLESS.search(before) and not set(value.lower()) - set("0123456789abcdef-"):
        return 0
    letters = any(c.isalpha() for c in value)
    return None if letters and _OPAQUE.fullmatch(value) and len(set(value)) >= 10 else 0


def _pieces(word: str) -> list[tuple[int, int]]:
    """(start, end) of every value in a word, in order, each once.

    Values end at '=', ':', '&' and '@'. One with '@' is taken whole too, as is what follows the last '=' or ':'; one
    behind such a sign that is too short goes on to the next, and a fixed format counts wherever it stands.
    """
    out = {m.span() for m in _FORMATS.finditer(word) if not (word[max(m.start() - 1, 0):m.start()] + word[m.end():m.end() + 1]).isalnum()}
    cut = max(word.rfind("=", 0, -8), word.rfind(":", 0, -8)) + 1
    found = [m.span() for m in _VALUE.finditer(word, cut)]
    for m in _VALUE.finditer(word):
        for signs in ("=", "=@"):
            ends = [i for i in range(*m.span()) if word[i] in signs] + [m.end()]
            for k, (a, b) in enumerate(zip([m.start(), *(e + 1 for e in ends)], ends)):
                if b - a < LEAST and a and word[a - 1] in "=:@":
                    b = next((e for e in ends[k:] if e - a >= LEAST), b)
                found.append((a, b))
    for a, b in found:
        b = a + len(word[a:b].rstrip(".-=~"))
        if b - a >= LEAST:
            out.add((a, b))
    return sorted(out)


def _count(flags):
    return np.append(0, np.cumsum(flags))


def _named(data, starts, ends, first):
    """Which words follow a word of the same row that ends in '=' or ':' (maybe with a quote) or looks like a telling name."""
    out = np.zeros(len(starts), bool)
    padded = np.append(np.zeros(6, np.uint8), data)   # byte i is at i + 6
    end = ends[:-1] + 6
    last, next_ = padded[end - 1], padded[end - 2]
    named = _SIGN[last] | (np.isin(last, [34, 39]) & _SIGN[next_])
    for trailing in range(3):
        # Up to two signs after the name.
        at = end - trailing
        low = [padded[at - k].astype(np.int64) | 32 for k in (3, 2, 1)]
        tail = np.isin(low[0] << 16 | low[1] << 8 | low[2], _KEY_ENDS)
        named |= tail & (ends[:-1] - starts[:-1] >= 3 + trailing)
    out[1:] = named
    heads = first[:-1]
    out[heads[heads < len(out)]] = False
    return out


def _worth(data, starts, ends, first):
    """Words that the forest must see: with digits and letters or many digits, of mixed case, named or assigned, or with
    many different letters. Shorter words cannot hold a candidate."""
    size = ends - starts
    digits, upper, lower, signs = (_count(x) for x in (_DIGIT[data], _UPPER[data], _LOWER[data], _SIGN[data]))
    turns = _count(np.append(_LOWER[data[:-1]] & _UPPER[data[1:]], False))
    n_digits, n_upper, n_lower = (x[ends] - x[starts] for x in (digits, upper, lower))
    bits = np.bitwise_or.reduceat(np.append(_BIT[data], np.uint64(0)), np.column_stack([starts, ends]).ravel())[::2]
    kinds = np.bitwise_count(bits).astype(np.int64)
    keep = (n_digits > 0) & (n_upper + n_lower > 0) | (n_digits > 1) & (size >= 12)
    keep |= (n_lower > 0) & ((n_upper > 1) | (turns[ends - 1] > turns[starts]))
    keep |= (kinds >= 10) | (size >= 15) & (kinds >= 6)
    keep |= signs[np.maximum(ends - LEAST, starts)] > signs[starts]
    keep |= _named(data, starts, ends, first)
    return np.flatnonzero(keep & (size >= LEAST))


def _candidates(data, offsets):
    """(row, start, end) in bytes of runs inside words worth a look; the words are found on the byte array.

    Runs can overlap: a value and a part of it.
    """
    starts, ends, first = B.spans(data, offsets)
    if not len(starts):
        return
    hit = _worth(data, starts, ends, first)
    rows = np.searchsorted(first, hit, "right") - 1
    for i, row in zip(hit.tolist(), rows.tolist()):
        at = int(starts[i])
        for a, b in _pieces(data[at:ends[i]].tobytes().decode("latin-1")):
            yield row, at + a, at + b


_CONTEXT = 48


def _around(data, offsets, row, a, b):
    low, high = int(offsets[row]), int(offsets[row + 1])
    text = lambda x, y: data[x:y].tobytes().decode("utf-8", "ignore")
    return text(a, b), text(max(low, a - _CONTEXT), a), text(b, min(high, b + _CONTEXT))


def findings(docs: DataFrame, language: Language, path: str = "source") -> DataFrame:
    """Candidates with evidence for training: doc_id, value, features and a weak label.

    A secret is given twice, the second time without its neighbours: the name that labels it is also a feature,
    and the forest must know such a value without it.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("value", pa.string()), ("features", pa.list_(pa.float64())), ("label", pa.int32())])

    def run(batches):
        for part, data, offsets in B.blocks(batches):
            docs_, paths = part.column("doc_id").to_pylist(), part.column("path").to_pylist()
            out = []
            for row, a, b in _candidates(data, offsets):
                value, before, after = _around(data, offsets, row, a, b)
                label = weak_label(value, before, paths[row])
                if label is None:
                    continue
                out.append((docs_[row], value, features(value, before, after, paths[row], language), label))
                if label:
                    out.append((docs_[row], value, features(value, "", "", paths[row], language), label))
            if out:
                yield B.record(schema, *zip(*out))

    return docs.select("doc_id", "text", _path(docs, path)).mapInArrow(
        run, "doc_id long, value string, features array<double>, label int")


MADE_DOCS = 600           # documents that lend their words to made findings, about
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_POOLS = ("0123456789abcdef", _LETTERS + _LETTERS.upper() + "0123456789", _LETTERS + _LETTERS.upper() + "0123456789-_", _LETTERS + "0123456789",
          _LETTERS.upper() + "0123456789", _LETTERS + _LETTERS.upper(), _LETTERS)
_NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey", "access_key", "private_key", "auth")
_PLAIN_NAMES = ("page", "lang", "user", "host", "ref", "title", "path", "version")
_FRAMES = (('{} = "', '"'), ("{}=", ""), ("{}: ", ""), ('{{"{}":"', '","id":"a"}}'), ("https://a.io/b?{}=", "&next=c"), ("{} ", ""))
_DIGEST_FRAMES = (("commit ", ""), ("rev ", ""), ("revision=", ""), ("sha1: ", ""), ("sha256:", ""), ("sha-512 ", ""), ("md5: ", ""), ('md5="', '"'),
                  ('checksum="', '"'), ("digest: ", ""), ('etag: "', '"'), ("hash=", ""), ("fingerprint ", ""), ("@sha256:", ""))
_ID_FRAMES = (("", ""), ("id=", ""), ("run ", ""), ("request_id: ", ""), ('{"uuid":"', '","page":1}'), ("trace-id ", ""), ("/objects/", "/view"))
_BLOCK_FRAMES = (("data:image/png;base64,", ""), ('src="data:image/jpeg;base64,', '"'), ("url(data:font/woff2;base64,", ")"), ("data:image/gif;base64,", ""))
_OPAQUE_MADE = 12         # opaque harmless values of a document


def _harmless(rng, plain):
    """(before, value, after) of a value that looks random or machine-made and is no secret: a digest behind its name, an id,
    an encoded image, an identifier or a file path built from real words."""
    some = lambda signs, n: "".join(rng.choice(signs) for _ in range(n))
    kind = rng.randrange(5 if plain else 3)
    if kind == 0:
        before, after = rng.choice(_DIGEST_FRAMES)
        return before, some(_POOLS[0], rng.choice((8, 10, 12, 32, 40, 40, 56, 64, 64, 96, 128))), after
    if kind == 1:
        before, after = rng.choice(_ID_FRAMES)
        value = "-".join(some(_POOLS[0], n) for n in (8, 4, 4, 4, 12))
        return before, value.upper() if rng.random() < 0.2 else value, after
    if kind == 2:
        before, after = rng.choice(_BLOCK_FRAMES)
        return before, some(_POOLS[1] + "+/", rng.randrange(12, 400)), after
    words = [rng.choice(plain)[:rng.randrange(2, 10)].lower() for _ in range(rng.randrange(2, 5))]
    if kind == 3:
        form = rng.randrange(5)
        value = ("_".join(words), words[0] + "".join(w.title() for w in words[1:]), ".".join(words), "_".join(words).upper(),
                 "".join(w.title() for w in words))[form]
        return rng.choice((("", ""), ("", ""), ("call ", ""), ("def ", "(self)"), ("name=", ""), ("`", "`")))[0], value.ljust(LEAST, "s"), ""
    return rng.choice(("", "/", "path=", "file: ")), "/".join(words) + rng.choice((".py", ".txt", "/index.html", "", "_v2.csv")) + "s" * 4, ""


def made(docs: DataFrame, language: Language, path: str = "source") -> DataFrame:
    """Findings whose label is known because they are made: random keys of many shapes between real words, with and
    without a name, as secrets; real words behind any name, some with a number, as harmless. Columns as in ``findings``.

    Digests behind their names, ids, encoded images, identifiers and paths are made as harmless opaque values.
    Rows without an id are left out, null and empty texts give nothing, repeated rows give equal findings.
    A corpus shows the forest only the shapes that it holds. About MADE_DOCS documents are used, whatever their number.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("value", pa.string()), ("features", pa.list_(pa.float64())), ("label", pa.int32())])

    def run(batches):
        for batch in batches:
            out = []
            for doc_id, text, where in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "text", "path"))):
                words = (text or "").split()
                rng = random.Random(doc_id)
                plain = [w for w in words if len(w) >= LEAST and w.isalpha()]
                for n in range(16 if words else 0):
                    at = rng.randrange(len(words))
                    before, after = " ".join([*words[max(0, at - 12):at], ""]), " ".join(["", *words[at:at + 12]])
                    label = int(n < 8)
                    named = n > 1
                    pool = rng.choice(_POOLS if named else _POOLS[:5])
                    if label:
                        value = "".join(rng.choice(pool) for _ in range(rng.randrange(LEAST if named else 20, 49)))
                        if n > 4:
                            value = value[:rng.randrange(LEAST, 17)]
                    elif plain:
                        value = rng.choice(plain) + rng.choice(("", "", "1", "-2", "27") if n > 11 else ("",))
                        if n == 14:
                            value = "-".join([rng.choice(plain)[:rng.randrange(2, 9)], rng.choice(plain)[:rng.randrange(3, 9)], str(rng.randrange(30))])
                        if n == 15:
                            value = f"//{rng.choice(plain)[:rng.randrange(1, 9)]}.{rng.choice(('io', 'com', 'org'))}/{rng.choice(plain)}"
                    else:
                        continue
                    if n == 15:
                        before += "https:"
                    elif named:
                        head, tail = rng.choice(_FRAMES)
                        before, after = before + head.format(rng.choice(_PLAIN_NAMES if n > 11 else _NAMES)), tail + after
                    out.append((doc_id, value, features(value, before[-_CONTEXT:], after[:_CONTEXT], where, language), label))
                for _ in range(_OPAQUE_MADE if words else 0):
                    at = rng.randrange(len(words))
                    before, after = " ".join([*words[max(0, at - 12):at], ""]), " ".join(["", *words[at:at + 12]])
                    head, value, tail = _harmless(rng, plain)
                    out.append((doc_id, value, features(value, (before + head)[-_CONTEXT:], (tail + after)[:_CONTEXT], where, language), 0))
            if out:
                yield B.record(schema, *zip(*out))

    share = min(1.0, MADE_DOCS / max(docs.count(), 1))
    some = docs.filter(F.col("doc_id").isNotNull() & (F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) <= int(share * (1 << 30))))
    return some.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _path(docs, path)).mapInArrow(
        run, "doc_id long, value string, features array<double>, label int")


def _path(docs, path):
    return F.coalesce(F.col(f"`{path}`").cast("string"), F.lit("")).alias("path") if path in docs.columns else F.lit("").alias("path")


# ---- the forest ----

_RULE = re.compile(r"(If|Else) \(feature (\d+) (<=|>) ([-+.\deE]+)\)|Predict: ([-+.\deE]+)|Tree \d+")


class Forest:
    """Trees as arrays: feature, threshold, left, right, vote."""

    def __init__(self, text: str):
        self.trees = []
        stack: list = []
        for m in _RULE.finditer(text):
            if m.group(0).startswith("Tree"):
                tree: list = []
                self.trees.append(tree)
                stack = []
                continue
            if m.group(1) == "Else":
                # The right side of the innermost test that still lacks one.
                while tree[stack[-1]][3] != -2:
                    stack.pop()
                tree[stack[-1]][3] = len(tree)
                continue
            node = len(tree)
            if stack and tree[stack[-1]][2] == -2:
                tree[stack[-1]][2] = node
            if m.group(1) == "If":
                tree.append([int(m.group(2)), float(m.group(4)), -2, -2, 0.0])
                stack.append(node)
            else:
                tree.append([-1, 0.0, -1, -1, float(m.group(5))])
        self.trees = [[np.array(c) for c in zip(*t)] for t in self.trees]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Share of the trees that vote for a secret."""
        total = np.zeros(len(x))
        for feature, threshold, left, right, vote in self.trees:
            node = np.zeros(len(x), np.int64)
            while True:
                open_ = np.flatnonzero(feature[node] >= 0)
                if not len(open_):
                    break
                at = node[open_]
                node[open_] = np.where(x[open_, feature[at]] <= threshold[at], left[at], right[at])
            total += vote[node]
        return total / max(len(self.trees), 1)


def train(labelled: DataFrame, most: int = MAX_FINDINGS) -> Forest:
    """Fit on at most ``most`` labelled findings (features, label), half of each class, chosen by hash; one class alone
    votes for itself. Null labels are left out."""
    labelled = B.table(labelled.filter("label is not null").select(
        F.xxhash64("value", "doc_id").alias("place"), array_to_vector("features").alias("features"), F.col("label").cast("double").alias("label")))
    rows = None
    for r in labelled.groupBy("label").count().collect():
        # The lowest hashes, a little more than are needed: what is sorted does not grow with the table.
        share = min(1.0, (most // 2 * 1.05 + 500) / r["count"])
        some = labelled.filter((F.col("label") == r.label) & (F.pmod("place", F.lit(1 << 30)) <= int(share * (1 << 30))))
        some = some.orderBy(F.pmod("place", F.lit(1 << 30)), "place").limit(most // 2)
        rows = some if rows is None else rows.unionByName(some)
    if rows is None:
        return Forest("Tree 0\nPredict: 0.0")
    # Rare secrets count as much as the rest.
    rows = B.table(rows.select("features", "label"))
    seen = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(seen) < 2:
        return Forest(f"Tree 0\nPredict: {max(seen)}")
    weight = F.when(F.col("label") == 1, seen[0.0] / seen[1.0]).otherwise(1.0)
    model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=7, weightCol="weight", featureSubsetStrategy="sqrt").fit(
        rows.withColumn("weight", weight))
    return Forest(model.toDebugString)


def _scored(data, offsets, paths, language, forest):
    """Per block: candidates (row, start, end, value), their scores, and which are secrets.

    A value in a provider's fixed format is a secret by itself; on all others the forest decides.
    """
    found, x = [], []
    for row, a, b in _candidates(data, offsets):
        value, before, after = _around(data, offsets, row, a, b)
        found.append((row, a, b, value))
        x.append(features(value, before, after, paths[row], language))
    score = forest.score(np.array(x)) if x else np.zeros(0)
    fixed = np.array([bool(_FORMATS.fullmatch(v)) for *_, v in found], bool)
    return found, score, (score >= THRESHOLD) | fixed


def _chars(data, a, b):
    return int(((data[a:b] & 0xC0) != 0x80).sum())


def scan(docs: DataFrame, language: Language, forest: Forest, path: str = "source") -> DataFrame:
    """One row per candidate: doc_id, start and end (code points), value, score, is_secret.

    Columns doc_id, text and, if there is one, the path column; others are ignored. Null and empty texts have no
    candidate; repeated rows give their findings each; an empty table gives none. Candidates of a row can overlap.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()),
                        ("score", pa.float64()), ("is_secret", pa.bool_())])

    def run(batches):
        for part, data, offsets in B.blocks(batches):
            found, score, secret = _scored(data, offsets, part.column("path").to_pylist(), language, forest)
            if found:
                ids = part.column("doc_id").to_pylist()
                start = [_chars(data, int(offsets[r]), a) for r, a, _, _ in found]
                yield B.record(schema, [ids[r] for r, *_ in found], start, [s + len(v) for s, (*_, v) in zip(start, found)],
                               [v for *_, v in found], score, secret)

    return docs.select("doc_id", "text", _path(docs, path)).mapInArrow(
        run, "doc_id long, start long, end long, value string, score double, is_secret boolean")


def redact(docs: DataFrame, language: Language, forest: Forest, path: str = "source", mark: str = "[SECRET]") -> DataFrame:
    """All columns of ``docs``; each secret in the text is replaced by ``mark``, everything else stays as it is.

    Null and empty texts stay so, repeated rows change alike, an empty table stays empty; other columns, whatever their
    names, are passed through. Of overlapping secrets the one that starts first gives the mark, up to the end of the last.
    """
    names = docs.columns

    def run(batches):
        for part, data, offsets in B.blocks(batches):
            found, _, secret = _scored(data, offsets, part.column("__path").to_pylist(), language, forest)
            cuts: dict[int, list] = {}
            for (row, a, b, _), yes in zip(found, secret):
                if yes:
                    cuts.setdefault(row, []).append((a, b))
            column = part.column(part.schema.get_field_index("text"))
            if cuts:
                texts = column.to_pylist()
                for row, spans in cuts.items():
                    at, out = int(offsets[row]), []
                    for a, b in spans:
                        # A value and a part of it give one mark.
                        if a >= at and (a > at or not out):
                            out += [data[at:a].tobytes().decode(), mark]
                        at = max(at, b)
                    texts[row] = "".join(out) + data[at:offsets[row + 1]].tobytes().decode()
                column = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(
                [column if n == "text" else part.column(part.schema.get_field_index(n)) for n in names], names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.select(*[F.col(f"`{c}`") for c in names], _path(docs, path).alias("__path")).mapInArrow(run, schema)


def fit(docs: DataFrame, labelled: DataFrame | None = None, path: str = "source") -> tuple[Language, Forest]:
    """Language of all texts, and a forest from labelled findings (weak labels of these documents and made findings if
    none are given). A table without texts gives a forest that calls nothing a secret but the fixed formats."""
    language = learn_language(docs)
    if labelled is None:
        labelled = findings(docs, language, path).unionByName(made(docs, language, path))
    return language, train(labelled)
