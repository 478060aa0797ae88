"""Words and word windows of whole texts as 64-bit hashes, in numpy.

Words are runs of bytes other than space and U+0009 to U+000D.  A word's hash
is a polynomial over its bytes, taken from prefix sums, and a bit mix; a
window's is a mixed linear form of its words' hashes.  Texts are worked on in
groups of about ``GROUP`` bytes and long texts in cuts of that size, so that
memory doesn't grow with a text beyond its own bytes and eight more a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

GROUP = 1 << 20
_U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    if len(_powers.get(base, ())) < n:
        steps = np.full(max(n, GROUP + 4096), base, _U)
        steps[0] = 1
        _powers[base] = np.cumprod(steps, dtype=_U)
    return _powers[base][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective bit mix of unsigned 64-bit values."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


def _hash_cut(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of one cut."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~SPACE[data]
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * _power(_BASE, len(data)), out=sums[1:])
    own = (sums[ends] - sums[starts]) * _power(_INVERSE, len(data) + 1)[starts]
    return mix(own + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93)), starts


def hash_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and byte starts of all words of ``data``."""
    whole, at, hashes, starts = np.frombuffer(data, np.uint8), 0, [], []
    while at < len(whole):
        end = min(len(whole), at + GROUP)
        if end < len(whole) and not SPACE[whole[end]] and not SPACE[whole[end - 1]]:
            back = SPACE[whole[at:end]].nonzero()[0]
            if len(back):
                end = at + int(back[-1]) + 1
            else:  # one word beyond a cut: take it whole
                while end < len(whole) and not SPACE[whole[end]]:
                    end += int(SPACE[whole[end : end + GROUP]].argmax()) or GROUP
                end = min(end, len(whole))
        h, s = _hash_cut(whole[at:end])
        hashes.append(h)
        starts.append(s + at)
        at = end
    return (np.concatenate(hashes), np.concatenate(starts)) if hashes else (np.zeros(0, _U), np.zeros(0, np.int64))


def groups(parts: list[bytes]) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """Runs of texts of about GROUP bytes: first, end, texts joined by a space, byte starts."""
    at = 0
    while at < len(parts):
        end, size = at, 0
        while end < len(parts) and (end == at or size + len(parts[end]) < GROUP):
            size += len(parts[end]) + 1
            end += 1
        starts = np.zeros(end - at, np.int64)
        np.cumsum([len(p) + 1 for p in parts[at : end - 1]], out=starts[1:])
        yield at, end, b" ".join(parts[at:end]), starts
        at = end


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; empty if there are fewer."""
    if len(words) < size:
        return np.zeros(0, _U)
    n = len(words) - size + 1
    total = np.zeros(n, _U)
    for k in range(size):
        total += words[k : k + n] * _U((_BASE * (2 * k + 3) + (k << 17)) % (1 << 64) | 1)
    return mix(total)


def shingles(words: np.ndarray, size: int = 5) -> np.ndarray:
    """The sorted distinct window hashes; with fewer words, the whole sequence as one."""
    if not len(words):
        return np.zeros(0, _U)
    if len(words) < size:
        return mix(window_hashes(words, len(words)) + _U(len(words)))
    return np.unique(window_hashes(words, size))
