"""Token ids of whole texts, memoised by space-delimited unit.

The byte-level pre-tokenizer always starts a new piece at a space that
follows or precedes a non-space character, so the ids of a text are the ids
of its units ``" word"`` in a row.  Units are encoded once by the tokenizers
library and remembered; texts in which a space stands between two white-space
characters, where that rule doesn't hold, are encoded whole.
"""

from __future__ import annotations

import functools
import os
import re
import sys
from itertools import filterfalse

import numpy as np

END_MARK = "<|endoftext|>"
ENCODED_AT_ONCE = 4000
PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+[,.]").fullmatch


def vocabulary_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class UnitEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids as bytes.

    Memory is bounded: units live in two generations of about ``capacity``
    entries each, the older being dropped when the newer is full.
    """

    def __init__(self, path: str, capacity: int = 800_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.capacity = capacity
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        size = self.tokenizer.get_vocab_size()
        self.marks = dict(zip(",.", self.whole([",", "."])))
        self.opens = np.zeros(size, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.opens[i] = token.startswith("Ġ")

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, units: list[str]) -> None:
        """A run of units is encoded as one text and cut where a token opens with a space."""
        plain = [u for u in units if END_MARK not in u]
        for at in range(0, len(plain), ENCODED_AT_ONCE):
            some = plain[at : at + ENCODED_AT_ONCE]
            ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            starts = np.flatnonzero(self.opens[ids])
            if len(starts) == len(some):
                raw, cuts = ids.tobytes(), [*(starts * 4).tolist(), len(ids) * 4]
                self.new.update(zip(some, map(raw.__getitem__, map(slice, cuts, cuts[1:]))))
            else:
                self.new.update(zip(some, self.whole([" " + u for u in some])))
        odd = [u for u in units if END_MARK in u]
        self.new.update(zip(odd, self.whole([" " + u for u in odd])))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; equal texts are encoded once."""
        if len(distinct := list(dict.fromkeys(texts))) < len(texts):
            return list(map(dict(zip(distinct, self.encode(distinct))).__getitem__, texts))
        split = [t.split(" ") for t in texts]
        heads = [u.pop(0) for u in split]
        if len(self.new) > self.capacity:
            self.old, self.new = self.new, {}
        unknown: set[str] = set()
        for units in split:
            unknown.update(filterfalse(self.new.__contains__, units))
        missing, ended, odd = [], [], set()
        for u in unknown:
            if (known := self.old.get(u)) is not None:
                self.new[u] = known
            elif not u or u[0].isspace() or u[0] in "\x1c\x1d\x1e\x1f\x85":
                odd.add(u)
            elif PLAIN(u):  # letters, then a mark that is always a piece of its own
                ended.append(u)
                if u[:-1] not in self.new and u[:-1] not in unknown:
                    missing.append(u[:-1])
            else:
                missing.append(u)
        if missing:
            self._learn(list(dict.fromkeys(missing)))
        for u in ended:
            self.new[u] = self.new[u[:-1]] + self.marks[u[-1]]
        first = dict(zip(distinct := list(set(heads)), self.whole(distinct)))
        get, out = self.new.__getitem__, []
        for text, head, units in zip(texts, heads, split):
            if odd and not odd.isdisjoint(units):
                out.append(self.whole([text])[0])
            else:
                out.append(first[head] + b"".join(map(get, units)))
        return out


@functools.lru_cache(maxsize=2)
def _encoder(path: str, capacity: int) -> UnitEncoder:
    return UnitEncoder(path, capacity)


def encoder(path: str, capacity: int = 800_000) -> UnitEncoder:
    """One encoder a worker process, kept between its tasks.

    It is looked up in the imported module, not in a pickled copy of it.
    """
    return sys.modules[__name__]._encoder(path, capacity)
