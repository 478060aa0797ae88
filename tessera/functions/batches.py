"""Arrow batches on executors: tokens of whole buffers of text, and the best rows a query seen so far.

``tokens_of`` gives what ``text.tokenize`` gives, without a string for each token."""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tessera import fixed

MOST_BYTES = 1 << 21  # text looked at together, unless one text is longer
MOST_CELLS = 1 << 21  # numbers computed together
SKIPPED = 1
KELVIN = (0xE2, 0x84, 0xAA)  # the one other sign whose lower case is a letter of a to z

_BYTE = np.zeros(256, np.uint8)
for _c in "abcdefghijklmnopqrstuvwxyz0123456789":
    _BYTE[[ord(_c), ord(_c.upper())]] = ord(_c)
_PAIR = np.zeros(1 << 16, np.uint8)
for _c, _to in zip(fixed.FOLD_FROM, fixed.FOLD_TO, strict=True):
    _PAIR[int.from_bytes(_c.encode(), "big")] = ord(_to.lower())
_STOP = pa.array(sorted(fixed.STOP_WORDS))
_SPACE = np.zeros(256, bool)
_SPACE[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
_WIDE_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def pieces(column: pa.Array, rows: int = 1 << 30) -> Iterator[tuple[int, pa.Array]]:
    """(first row, part): parts of at most ``rows`` rows and MOST_BYTES, or of one longer text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(column):
        stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + MOST_BYTES, "right"))
        stop = min(max(stop, at + 1), at + rows, len(column))
        yield at, column.slice(at, stop - at)
        at = stop


def tokens_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All tokens of the texts in order, and the row of each.  Null text has none."""
    filled = pc.fill_null(texts, "").cast(pa.string())
    n, (_, ends, data) = len(filled), filled.buffers()
    if not n or data is None:
        return pa.array([], pa.string()), np.zeros(0, np.int64)
    at = np.frombuffer(ends, np.int32)[filled.offset : filled.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    at -= at[0]
    low = _BYTE[raw]
    wide = np.flatnonzero(raw >= 0xC3)
    wide = wide[wide + 1 < len(raw)]
    if len(wide):
        letter = _PAIR[(raw[wide].astype(np.uint16) << 8) | raw[wide + 1]]
        pair, letter = wide[letter > 0], letter[letter > 0]
        low[pair + 1], low[pair] = letter, SKIPPED
        kelvin = wide[(raw[wide] == KELVIN[0]) & (raw[wide + 1] == KELVIN[1])]
        kelvin = kelvin[kelvin + 2 < len(raw)]
        kelvin = kelvin[raw[kelvin + 2] == KELVIN[2]]
        low[kelvin], low[kelvin + 1], low[kelvin + 2] = SKIPPED, SKIPPED, ord("k")
        dropped = low == SKIPPED
        if dropped.any():
            at -= np.concatenate([[0], np.cumsum(dropped)])[at]
            low = low[~dropped]
    word = low > 0
    first = word.copy()
    first[1:] &= ~word[:-1]
    heads = at[:-1][at[:-1] < len(low)]
    first[heads] = word[heads]
    starts = np.flatnonzero(first)
    rows = np.repeat(np.arange(n), np.diff(np.searchsorted(starts, at)))
    letters = low[word]
    ends = np.append(np.flatnonzero(first[word]), len(letters)).astype(np.int32)
    tokens = pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(letters))
    good = (np.diff(ends) > 1) & ~pc.is_in(tokens, value_set=_STOP).to_numpy(zero_copy_only=False)
    return tokens.filter(pa.array(good)), rows[good]


class Places:
    """The place of each token in a list of terms; -1 for others.  With ``normal``, a token stands for normal(token)."""

    def __init__(self, terms: list[str], normal: Callable[[str], str] | None = None):
        self.terms, self.normal, self.known = pa.array(terms, pa.string()), normal, {}

    def __call__(self, tokens: pa.Array) -> np.ndarray:
        if self.normal is None:
            return self._of(tokens)
        coded = tokens.dictionary_encode()
        if len(self.known) > 1 << 18:
            self.known.clear()
        names = coded.dictionary.to_pylist()
        for t in names:
            if t not in self.known:
                self.known[t] = self.normal(t)
        places = self._of(pa.array([self.known[t] for t in names], pa.string()))
        return places[coded.indices.to_numpy()] if len(names) else np.zeros(0, np.int64)

    def _of(self, tokens: pa.Array) -> np.ndarray:
        return pc.fill_null(pc.index_in(tokens, value_set=self.terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def words_of(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """What ``str.split`` gives, without a string for each word: UTF-8 with 16 bytes or more behind the last word, where each word begins and ends, its text."""
    coded = [(t if t.isascii() or not _WIDE_SPACE.search(t) else " ".join(t.split())).encode() for t in texts]
    data = b" ".join(coded) + b" " * 17
    edges = np.flatnonzero(np.diff(_SPACE[np.frombuffer(data, np.uint8)], prepend=True))
    starts, ends = edges[::2], edges[1::2]
    at = np.cumsum([0, *(len(t) + 1 for t in coded)])
    return data, starts, ends, np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, at)))


class WordHashes:
    """blake2b of words, 64 bits each.  A word of at most 15 bytes is remembered at one of ``1 << bits`` places, until another takes it."""

    def __init__(self, bits: int = 18):
        # A key is a word's bytes and its length, so that no two words share one; 0 is none.
        self.bits, (self.low, self.high, self.hash) = bits, np.zeros((3, 1 << bits), np.uint64)

    def __call__(self, data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        sizes = ends - starts
        eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        low, high = eight[starts] & _FIRST[np.minimum(sizes, 8)], eight[starts + 8] & _FIRST[np.clip(sizes - 8, 0, 7)]
        high |= np.minimum(sizes, 16).astype(np.uint64) << np.uint64(56)
        mixed = ((low * np.uint64(0x9E3779B97F4A7C15)) ^ (high * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0xFF51AFD7ED558CCD)
        place = (mixed >> np.uint64(64 - self.bits)).astype(np.int64)
        out = self.hash[place]
        new = np.flatnonzero((self.low[place] != low) | (self.high[place] != high) | (sizes > 15))
        if len(new):
            out[new] = np.frombuffer(b"".join(hashlib.blake2b(data[a:b], digest_size=8).digest() for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)), "<u8")
            short = new[sizes[new] <= 15]
            taken, first = np.unique(place[short], return_index=True)
            self.low[taken], self.high[taken], self.hash[taken] = low[short[first]], high[short[first]], out[short[first]]
        return out


_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # of eight bytes


@functools.cache
def word_hashes() -> WordHashes:
    """One a process, for all that it embeds."""
    return WordHashes()


def sortable(ids: np.ndarray) -> np.ndarray:
    return np.unique(ids, return_inverse=True)[1] if ids.dtype == object else ids


class Best:
    """The k best ids of each of n queries among all rows seen; ties go to the lower id.  Holds a few times n * k rows."""

    def __init__(self, n: int, k: int):
        self.k, self.floor, self.parts, self.held, self.most = k, np.full(n, -np.inf), [], 0, max(4 * n * k, MOST_CELLS)

    def add(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        if len(query):
            self.parts.append((query, ids, scores))
            self.held += len(query)
            if self.held > self.most:
                self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        query, ids, scores = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((sortable(ids), -scores, query))
        query, ids, scores = query[order], ids[order], scores[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        last = place == self.k - 1
        self.floor[query[last]] = scores[last]
        kept = place < self.k
        self.parts, self.held = [(query[kept], ids[kept], scores[kept])], int(kept.sum())
        return self.parts[0]

    def batches(self, names: list, query_type: pa.DataType, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        query, ids, scores = self.settle()
        names = pa.array(names, query_type)
        for at in range(0, len(query), 1 << 16):
            part = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays([names.take(pa.array(query[part])), pa.array(ids[part], id_type), pa.array(scores[part])], names=["query_id", "id", "score"])
