"""Byte-level BPE with a minimal acyclic transducer as lexicon.

The frequent words of the corpus are compiled once into an automaton that shares prefixes and suffixes; each
arc carries how many words it skips, so a path adds up to the number of its word, and that number leads to
its ids. The file goes to every executor, which maps it into memory. Words of a block walk the automaton side
by side, one byte per step; words that it does not hold are merged exactly by the ranks of the vocabulary.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F

from sightledger.llm import base as B, tokens as T
from sightledger.session import shared_dir

LEXICON_WORDS = 65_536   # words compiled, at most
LONG_WORD = 48           # longer words are merged with a heap, one by one
KEPT_MERGES = 200_000    # merged words a worker remembers
BLOCK = 2 << 20


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b] = chr(spare)
            spare += 1
    return out


class Vocabulary:
    """Merge ranks and bytes of the ids of a vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        symbols = byte_symbols()
        back = {c: b for b, c in enumerate(symbols)}
        ids = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.byte_ids = np.array([ids[c] for c in symbols], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([ids[a] << 20 | ids[b] for a, b in pairs], np.int64)
        made = np.array([ids[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made
        self.rank_of = {int(k): r for r, k in enumerate(keys)}
        top = max(max(ids.values()), max(self.special.values(), default=0)) + 1
        self.bytes = [b""] * top
        for token, i in ids.items():
            if token not in self.special:
                self.bytes[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode("utf-8")
        self.kept: dict[bytes, tuple] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (right >= 0), self.ranks[at], 1 << 40)

    def merge(self, words: list[bytes]) -> list[tuple]:
        """ids of words: the pair of least rank joins first, the leftmost of equals, until none is left."""
        if len(self.kept) > KEPT_MERGES:
            self.kept.clear()
        open_ = [w for w in dict.fromkeys(words) if w not in self.kept]
        by_size: dict[int, list[bytes]] = {}
        for w in open_:
            if len(w) > LONG_WORD:
                self.kept[w] = self._merge_long(w)
            else:
                by_size.setdefault(-(-len(w) // 4) * 4, []).append(w)
        for size, group in by_size.items():
            for at in range(0, len(group), 20_000):
                some = group[at:at + 20_000]
                for w, ids in zip(some, self._merge_group(some, size)):
                    self.kept[w] = ids
        return [self.kept[w] for w in words]

    def _merge_group(self, words: list[bytes], size: int) -> list[tuple]:
        raw = np.frombuffer(b"".join(w.ljust(size, b"\0") for w in words), np.uint8).reshape(-1, size)
        lengths = np.array([len(w) for w in words])
        ids = self.byte_ids[raw]
        ids[np.arange(size) >= lengths[:, None]] = -1
        rank = np.full((len(words), size), 1 << 40)
        rank[:, :-1] = self.rank(ids[:, :-1], ids[:, 1:])
        live, out = np.arange(len(words)), np.full((len(words), size), -1)
        place = np.arange(size)
        while True:
            at = rank.argmin(1)
            rows = np.arange(len(live))
            best = rank[rows, at]
            over = best >= 1 << 40
            if over.any():
                out[live[over]] = ids[over]
                keep = ~over
                live, ids, rank, at, best = live[keep], ids[keep], rank[keep], at[keep], best[keep]
                rows = np.arange(len(live))
            if not len(live):
                break
            ids[rows, at] = self.made[best]
            gone = at + 1
            take = np.minimum(place + (place >= gone[:, None]), size - 1)
            ids, rank = np.take_along_axis(ids, take, 1), np.take_along_axis(rank, take, 1)
            ids[:, -1], rank[:, -1] = -1, 1 << 40
            right = np.where(at + 1 < size, ids[rows, np.minimum(at + 1, size - 1)], -1)
            rank[rows, at] = self.rank(ids[rows, at], right)
            left = np.maximum(at - 1, 0)
            rank[rows, left] = np.where(at > 0, self.rank(ids[rows, left], ids[rows, at]), rank[rows, left])
        counts = (out >= 0).sum(1)
        flat, edge = out[out >= 0].tolist(), np.append(0, np.cumsum(counts)).tolist()
        return [tuple(flat[a:b]) for a, b in zip(edge[:-1], edge[1:])]

    def _merge_long(self, word: bytes) -> tuple:
        ids = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        before, after = list(range(-1, len(ids) - 1)), list(range(1, len(ids) + 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(len(ids) - 1)
                if (r := self.rank_of.get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else len(ids)
            if j >= len(ids) or ids[j] != b:
                continue
            ids[i], ids[j] = int(self.made[r]), -1
            after[i] = after[j]
            if after[i] < len(ids):
                before[after[i]] = i
            for x in (before[i], i):
                y = after[x] if x >= 0 else len(ids)
                if y < len(ids) and (r := self.rank_of.get(ids[x] << 20 | ids[y])) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return tuple(i for i in ids if i >= 0)


# ---- the automaton ----

def compile_lexicon(words: list[bytes], outputs: list[tuple]) -> bytes:
    """The file of the minimal automaton of sorted distinct words, with the ids of each.

    States are registered by their arcs, so equal right languages are one state. States are numbered children
    first; arcs of a state are sorted by label and carry the number of words on earlier arcs.
    """
    register: dict[tuple, int] = {}
    arcs: list[list[tuple[int, int]]] = []
    finals: list[bool] = []
    size: list[int] = []

    def settle(final, children) -> int:
        key = (final, *children)
        if key not in register:
            register[key] = len(arcs)
            arcs.append(children)
            finals.append(final)
            size.append(final + sum(size[t] for _, t in children))
        return register[key]

    path: list[list] = [[False, []]]  # open states along the latest word: final, settled arcs
    last = b""
    for word in words:
        common = 0
        while common < min(len(last), len(word)) and last[common] == word[common]:
            common += 1
        for depth in range(len(last), common, -1):
            final, children = path.pop()
            path[-1][1].append((last[depth - 1], settle(final, children)))
        path += [[False, []] for _ in word[common:]]
        path[-1][0] = True
        last = word
    for depth in range(len(last), 0, -1):
        final, children = path.pop()
        path[-1][1].append((last[depth - 1], settle(final, children)))
    root = settle(*path[0])

    keys, targets, skipped = [], [], []
    for state, children in enumerate(arcs):
        before = int(finals[state])
        for label, target in children:
            keys.append(state << 8 | label)
            targets.append(target)
            skipped.append(before)
            before += size[target]
    starts = np.append(0, np.cumsum([len(o) for o in outputs]))
    flat = np.array([i for o in outputs for i in o], "<i4")
    sections = [np.array(keys, "<i8"), np.array(targets, "<i4"), np.array(skipped, "<i4"),
                np.array(finals, np.uint8), starts.astype("<i4"), flat]
    head = b"MAT1" + struct.pack("<i6q", root, *[len(s) for s in sections])
    return head + b"".join(s.tobytes() for s in sections)


class Lexicon:
    """The automaton, mapped from its file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            head = f.read(56)
        if head[:4] != b"MAT1":
            raise ValueError("not a lexicon")
        self.root, *sizes = struct.unpack("<i6q", head[4:])
        at, self.sections = 56, []
        for n, kind in zip(sizes, ("<i8", "<i4", "<i4", "u1", "<i4", "<i4")):
            self.sections.append(np.memmap(path, kind, "r", at, (n,)) if n else np.zeros(0, kind))
            at += n * np.dtype(kind).itemsize
        self.keys, self.targets, self.skipped, self.finals, self.starts, self.ids = self.sections

    def number(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Number of each word (a byte range), or -1 if the automaton does not hold it."""
        out = np.full(len(starts), -1)
        if not len(self.keys):
            return out
        live, state, total = np.arange(len(starts)), np.full(len(starts), self.root), np.zeros(len(starts), np.int64)
        at = starts.copy()
        while len(live):
            over = at >= ends[live]
            if over.any():
                hit = over & (self.finals[state] == 1)
                out[live[hit]] = total[hit]
                live, state, total, at = live[~over], state[~over], total[~over], at[~over]
            key = state << 8 | data[at]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[arc] == key
            live, arc, at = live[ok], arc[ok], at[ok] + 1
            state, total = self.targets[arc].astype(np.int64), total[ok] + self.skipped[arc]
        return out


# ---- the operator ----

def _pattern():
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN)


_WORKER: dict = {}


def _state(path: str, lexicon: str | None = None):
    if path not in _WORKER:
        _WORKER[path] = (Vocabulary(path), _pattern())
    if lexicon and lexicon not in _WORKER:
        _WORKER[lexicon] = Lexicon(SparkFiles.get(lexicon))
    return (*_WORKER[path], _WORKER.get(lexicon))


def _word_counts(path):
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def run(batches):
        _, pattern, _ = _state(path)
        for _, data, offsets in B.blocks(batches, limit=BLOCK):
            if not len(data):
                continue
            starts = T.piece_starts(data, offsets)
            h = B.piece_hashes(data, starts, np.append(starts[1:], len(data)), T._VALUES, B.WORD_BASE)
            _, first, counts = np.unique(h, return_index=True, return_counts=True)
            # A word seen once in a block is not frequent here; it is merged when it comes.
            often = counts > 1
            tally: dict[bytes, int] = {}
            for piece, one, n in zip(*_pieces(data, starts, first[often]), counts[often].tolist()):
                for word in (piece,) if one else [w.encode("utf-8") for w in pattern.findall(piece.decode("utf-8", "replace"))]:
                    tally[word] = tally.get(word, 0) + n
            kept = [(w, n) for w, n in tally.items() if len(w) <= LONG_WORD]
            yield B.record(schema, [w for w, _ in kept], [n for _, n in kept])

    return run


def build_lexicon(docs: DataFrame, path: str, words: int = LEXICON_WORDS) -> str:
    """Compile the most frequent words of all texts and send the file to the executors; returns its name."""
    spark = docs.sparkSession
    counts = docs.select("text").mapInArrow(_word_counts(path), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    # At most ``words`` short words reach the driver.
    top = sorted(bytes(r.word) for r in counts.orderBy(F.desc("n"), "word").limit(words).collect())
    body = compile_lexicon(top, Vocabulary(path).merge(top))
    name = f"lexicon_{hashlib.sha256(body).hexdigest()[:16]}_{uuid.uuid4().hex[:8]}.mat"
    target = f"{shared_dir(spark).rstrip('/')}/{name}"
    where = spark._jvm.org.apache.hadoop.fs.Path(target)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where)
    out.write(bytearray(body))
    out.close()
    spark.sparkContext.addFile(where.toString() if "://" in target or target.startswith("file:") else f"file://{target}")
    return name


class Coder:
    """Encodes blocks of texts: distinct words walk the automaton, the rest is merged."""

    def __init__(self, vocabulary: Vocabulary, pattern, lexicon: Lexicon):
        self.vocabulary, self.pattern, self.lexicon = vocabulary, pattern, lexicon

    def words(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """ids of distinct words, one after another, and where each word's start."""
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        ends = np.cumsum(sizes)
        number = self.lexicon.number(np.frombuffer(b"".join(raw), np.uint8), ends - sizes, ends)
        known = number >= 0
        other = np.flatnonzero(~known)
        merged = self.vocabulary.merge([raw[i] for i in other.tolist()])
        edge = self.lexicon.starts
        counts = np.zeros(len(raw), np.int64)
        counts[known] = edge[number[known] + 1] - edge[number[known]]
        counts[other] = np.fromiter(map(len, merged), np.int64, len(merged))
        starts = np.append(0, np.cumsum(counts))
        flat = np.empty(starts[-1], np.int64)
        at = np.arange(starts[-1])
        of_known = np.repeat(known, counts)
        flat[of_known] = self.lexicon.ids[at[of_known] + np.repeat(
            edge[number[known]] - starts[:-1][known], counts[known])]
        flat[~of_known] = np.fromiter((i for ids in merged for i in ids), np.int64, int(counts[other].sum()))
        return flat, starts

    def text(self, text: str) -> list[int]:
        """A whole text with special tokens in it."""
        out, parts = [], [text]
        for token in self.vocabulary.special:
            parts = [x for p in parts for x in _split(p, token)]
        for part in parts:
            if part in self.vocabulary.special:
                out.append(self.vocabulary.special[part])
            else:
                order, at = _numbered(w.encode("utf-8") for w in self.pattern.findall(part))
                flat, starts = self.words(order)
                out += _gather(flat, starts, np.array(at, np.int64))[0].tolist()
        return out

    def block(self, data, offsets):
        """ids of all rows, one after another, and where each row's start."""
        n = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
        starts = T.piece_starts(data, offsets)
        h = B.piece_hashes(data, starts, np.append(starts[1:], len(data)), T._VALUES, B.WORD_BASE)
        _, first, piece = np.unique(h, return_index=True, return_inverse=True)
        pieces, simple = _pieces(data, starts, first)
        # Most pieces are one word; the pattern cuts the others.
        held = [(p,) if one else [w.encode("utf-8") for w in self.pattern.findall(p.decode("utf-8", "replace"))]
                for p, one in zip(pieces, simple)]
        order, at = _numbered(w for words in held for w in words)
        flat, edge = _gather(*self.words(order), np.array(at, np.int64))
        per_piece = edge[np.append(0, np.cumsum(np.fromiter(map(len, held), np.int64, len(held))))]
        out, edge = _gather(flat, per_piece, piece)
        rows = edge[np.searchsorted(starts, offsets)]
        odd = T.odd_rows(data, offsets)
        if len(odd):
            body = data.tobytes()
            parts = [out[a:b] for a, b in zip(rows[:-1], rows[1:])]
            for i in odd:
                parts[i] = np.array(self.text(body[offsets[i]:offsets[i + 1]].decode("utf-8", "replace")), np.int64)
            out, rows = np.concatenate(parts), np.append(0, np.cumsum([len(p) for p in parts]))
        return out, rows


def _numbered(words) -> tuple[list[bytes], list[int]]:
    """Distinct words in order of appearance, and the number of each given word."""
    order: dict[bytes, int] = {}
    at = [order.setdefault(w, len(order)) for w in words]
    return list(order), at


def _gather(flat, starts, at):
    """Runs of ``flat`` (run i goes from starts[i] to starts[i + 1]) in the order of ``at``, and where each starts."""
    counts = (starts[1:] - starts[:-1])[at]
    edge = np.append(0, np.cumsum(counts))
    return flat[np.arange(edge[-1]) + np.repeat(starts[:-1][at] - edge[:-1], counts)], edge


_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def _pieces(data, starts, chosen) -> tuple[list[bytes], list[bool]]:
    """Bytes of the chosen pieces, and whether each is surely one word: a single byte, or a blank or none before
    ASCII or Latin-1 letters only."""
    letter = _LETTER[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    letter[lead] = letter[lead + 1] = True
    ends = np.append(starts[1:], len(data))
    other = np.append(0, np.cumsum(~letter))
    begin = starts + (data[starts] == 0x20)
    simple = (other[ends] == other[begin]) & (begin < ends) | (ends - starts == 1)
    body = data.tobytes()
    return [body[a:b] for a, b in zip(starts[chosen].tolist(), ends[chosen].tolist())], simple[chosen].tolist()


def _split(text: str, token: str) -> list[str]:
    if token not in text:
        return [text] if text else []
    out = []
    for i, part in enumerate(text.split(token)):
        out += [token] * (i > 0) + [part] * bool(part)
    return out


def decoder(vocabulary: Vocabulary):
    """Function from ids to text, special tokens included; bytes that are no UTF-8 become U+FFFD."""
    table = vocabulary.bytes
    return lambda ids: b"".join(map(table.__getitem__, ids)).decode("utf-8", "replace")


def encode_decode(docs: DataFrame, path: str | None = None, words: int = LEXICON_WORDS) -> DataFrame:
    """(doc_id, ids, decoded): the ids of every whole text, and the text that these ids decode to.

    Null and empty texts have no ids and decode to the empty text; columns besides doc_id and text are ignored;
    repeated rows give repeated rows; an empty table gives none and an empty lexicon.
    """
    return _coded(docs, path, words, "ids array<int>, decoded string", pa.schema([
        ("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())]),
        lambda ids, text: (ids, text))


def digests(docs: DataFrame, path: str | None = None, words: int = LEXICON_WORDS) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of the same ids and texts, without sending them on."""
    def digest(ids, text):
        # numbers of a text, joined by commas, are built from one string per id
        return (len(ids), hashlib.sha256(",".join(map(_DECIMAL.__getitem__, ids)).encode()).hexdigest(),
                hashlib.sha256(text.encode("utf-8")).hexdigest())

    return _coded(docs, path, words, "n_tokens long, ids_sha256 string, decoded_sha256 string", pa.schema([
        ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]),
        digest)


class _Decimals(dict):
    def __missing__(self, number):
        self[number] = text = str(number)
        return text


_DECIMAL = _Decimals()


def _coded(docs, path, words, sql, schema, row):
    path = path or T.vocabulary_path()
    docs = docs.select("doc_id", "text")
    name = build_lexicon(docs, path, words)

    def run(batches):
        coder = Coder(*_state(path, name))
        text_of = decoder(coder.vocabulary)
        for part, data, offsets in B.blocks(batches, limit=BLOCK):
            ids, rows = coder.block(data, offsets)
            ids = ids.tolist()
            out = [row(x, text_of(x)) for a, b in zip(rows[:-1], rows[1:]) for x in (ids[a:b],)]
            yield B.record(schema, part.column(part.schema.get_field_index("doc_id")).cast(pa.int64()), *zip(*out))

    return docs.mapInArrow(run, f"doc_id long, {sql}")
