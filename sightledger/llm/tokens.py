"""Token ids of whole texts, piece by piece.

A text splits into pieces at places where the byte-level pre-tokenizer always splits (before the last white
space of a run, before a word without a leading blank, before closing punctuation), so the ids of a text are
those of its pieces. Pieces are hashed in bulk and looked up in a bounded table that a worker keeps; only
pieces it has not seen go to the tokenizers library. Texts with other Unicode white space or with a special
token's string go to the library whole.
"""

from __future__ import annotations

import os

import numpy as np

from sightledger.llm import base as B

MAX_ENTRIES = 1_200_000  # pieces a worker keeps
SLOT_BITS = 22

_VALUES = B.byte_values(707)
_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = True
_CLOSING = np.zeros(256, bool)
_CLOSING[[0x2E, 0x2C, 0x3B, 0x3A, 0x21, 0x3F]] = True
# Lead bytes of white space outside ASCII: U+0085, U+00A0, U+1680, U+2000-200A, U+2028-2029, U+202F, U+205F, U+3000.
_WIDE = np.zeros(256, bool)
_WIDE[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte where each piece starts; pieces cover all bytes and no piece leaves its row."""
    n = len(data)
    space = B.SPACE[data]
    first = np.zeros(n, bool)
    first[offsets[:-1][offsets[:-1] < n]] = True
    last = np.zeros(n, bool)
    last[offsets[1:][offsets[1:] > 0] - 1] = True
    before = np.empty(n, bool)      # the byte before is white space
    before[0], before[1:] = False, space[:-1]
    after = np.empty(n, bool)       # the byte after is white space
    after[-1], after[:-1] = False, space[1:]
    blank_before = np.zeros(n, bool)
    blank_before[1:] = data[:-1] == 0x20
    start = space & ~before
    start |= space & before & ~after & ~last
    start |= ~space & before & ~blank_before
    close = np.flatnonzero(_CLOSING[data] & (after | last))
    close = close[close > 0]
    start[close[_ALNUM[data[close - 1]]]] = True
    start |= first
    return np.flatnonzero(start)


def odd_rows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows that hold white space outside ASCII or the start of a special token."""
    at = np.flatnonzero(_WIDE[data])
    at = at[at + 1 < len(data)]
    a, b = data[at], data[at + 1]
    c = data[np.minimum(at + 2, len(data) - 1)]
    wide = (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (b == 0x9A) | (a == 0xE2) & (b == 0x80) & (
        (c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (a == 0xE2) & (b == 0x81) & (c == 0x9F) | (
        a == 0xE3) & (b == 0x80) & (c == 0x80)
    mark = np.flatnonzero(data[:-1] == 0x3C)
    mark = mark[data[mark + 1] == 0x7C]
    return np.unique(np.searchsorted(offsets, np.concatenate([at[wide], mark]), "right") - 1)


class Encoder:
    """ids of texts; ``misses`` turns new pieces into ids (the tokenizers library unless given)."""

    def __init__(self, path: str, misses=None):
        self.path = path
        self.tokenizer = load_tokenizer(path)
        self.misses = misses or self._library
        self.clear()

    def _library(self, pieces: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def clear(self) -> None:
        self.keys = np.zeros(1 << SLOT_BITS, np.uint64)
        self.slots = np.full(1 << SLOT_BITS, -1, np.int32)
        self.first = np.zeros(1 << 16, np.int64)
        self.count = np.zeros(1 << 16, np.int32)
        self.ids = np.zeros(1 << 18, np.uint16)
        self.entries = self.used = 0

    def _find(self, h: np.ndarray) -> np.ndarray:
        mask = np.uint64((1 << SLOT_BITS) - 1)
        at = (h & mask).astype(np.int64)
        out = np.where(self.keys[at] == h, self.slots[at], -1)
        open_ = np.flatnonzero(out < 0)
        if len(open_):
            at = (h[open_] >> np.uint64(32) & mask).astype(np.int64)
            out[open_] = np.where(self.keys[at] == h[open_], self.slots[at], -1)
        return out

    def _add(self, h: np.ndarray, lists: list) -> np.ndarray:
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter((x for ids in lists for x in ids), np.uint16, int(counts.sum()))
        entry = np.arange(self.entries, self.entries + len(h))
        while self.entries + len(h) > len(self.first):
            self.first, self.count = (np.append(x, np.zeros_like(x)) for x in (self.first, self.count))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.append(self.ids, np.zeros_like(self.ids))
        self.first[entry] = self.used + np.cumsum(counts) - counts
        self.count[entry] = counts
        self.ids[self.used:self.used + len(flat)] = flat
        self.used += len(flat)
        self.entries += len(h)
        mask = np.uint64((1 << SLOT_BITS) - 1)
        at = (h & mask).astype(np.int64)
        free = self.slots[at] < 0
        at = np.where(free, at, (h >> np.uint64(32) & mask).astype(np.int64))
        # Two new pieces of one slot: the later one stays, the other is asked for again when it comes.
        self.keys[at], self.slots[at] = h, entry
        return entry

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of all rows, one after another, and where each row's start (one more than rows)."""
        if not len(data):
            return np.zeros(0, np.uint16), np.zeros(len(offsets), np.int64)
        if self.entries > MAX_ENTRIES:
            self.clear()
        starts = piece_starts(data, offsets)
        ends = np.append(starts[1:], len(data))
        h = B.piece_hashes(data, starts, ends, _VALUES, B.WORD_BASE)
        entry = self._find(h)
        new = np.flatnonzero(entry < 0)
        if len(new):
            distinct, at, back = np.unique(h[new], return_index=True, return_inverse=True)
            body = data.tobytes()
            pieces = [body[a:b].decode("utf-8", "replace") for a, b in zip(starts[new[at]], ends[new[at]])]
            entry[new] = self._add(distinct, self.misses(pieces))[back]
        counts = self.count[entry].astype(np.int64)
        edge = np.append(0, np.cumsum(counts))
        flat = self.ids[np.arange(edge[-1]) + np.repeat(self.first[entry] - edge[:-1], counts)]
        rows = edge[np.searchsorted(starts, offsets)]
        odd = odd_rows(data, offsets)
        if len(odd):
            body = data.tobytes()
            parts = [flat[a:b] for a, b in zip(rows[:-1], rows[1:])]
            for i in odd:
                text = body[offsets[i]:offsets[i + 1]].decode("utf-8", "replace")
                parts[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint16)
            flat = np.concatenate(parts)
            rows = np.append(0, np.cumsum([len(p) for p in parts]))
        return flat, rows


_KEPT: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary file, kept between tasks."""
    if path not in _KEPT:
        _KEPT[path] = Encoder(path)
    return _KEPT[path]
