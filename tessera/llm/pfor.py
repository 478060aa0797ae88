"""Patched frame-of-reference coding of token ids, in numpy.

A segment is one self-contained byte string (all numbers little-endian):

    magic "TPF1"; u32 documents, ids, ids a block, blocks, exceptions
    i64 doc_id and u8 null flag and u32 length of each document
    u32 minimum, u8 width, u32 payload start and u32 first exception of each block
    u32 payload words; u16 place and u32 value of each exception

A block holds ``block`` values (a multiple of 32) less their minimum, packed at the width that a
chosen percentile of them needs; larger ones stand in the exception list and
leave zero bits in the payload.  The starts make any block readable alone.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"TPF1"
HEAD = struct.Struct("<4s5I")


def bit_widths(values: np.ndarray) -> np.ndarray:
    return np.where(values > 0, np.floor(np.log2(np.maximum(values, 1).astype(np.float64))) + 1, 0).astype(np.uint8)


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """values: (m, block) u32 below 2**width; gives (m, words) u32.  32 values fill width words exactly."""
    lanes = np.ascontiguousarray(values.reshape(-1, 32).T)
    words = np.zeros((width, lanes.shape[1]), np.uint32)
    for j in range(32):
        word, shift = divmod(j * width, 32)
        words[word] |= lanes[j] << np.uint32(shift)
        if shift + width > 32:
            words[word + 1] |= lanes[j] >> np.uint32(32 - shift)
    return words.T.reshape(len(values), -1)


def unpack(words: np.ndarray, width: int, block: int) -> np.ndarray:
    """words: (m, words) u32; gives (m, block) u32."""
    groups = np.ascontiguousarray(words.reshape(-1, width).T)
    out = np.empty((32, groups.shape[1]), np.uint32)
    mask = np.uint32((1 << width) - 1)
    for j in range(32):
        word, shift = divmod(j * width, 32)
        value = groups[word] >> np.uint32(shift)
        if shift + width > 32:
            value |= groups[word + 1] << np.uint32(32 - shift)
        np.bitwise_and(value, mask, out=out[j])
    return out.T.reshape(len(words), block)


def encode_segment(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, block: int = 256, percentile: float = 95.0) -> bytes:
    if block % 32:
        raise ValueError("a block must hold a multiple of 32 values")
    n = len(ids)
    blocks = -(-n // block)
    padded = np.empty(blocks * block, np.uint32)
    padded[:n] = ids
    if n:
        padded[n:] = ids[-1]
    padded = padded.reshape(blocks, block)
    low = padded.min(axis=1) if blocks else np.zeros(0, np.uint32)
    delta = padded - low[:, None]
    at = min(block - 1, max(0, int(np.ceil(percentile / 100 * block)) - 1))
    widths = bit_widths(np.partition(delta, at, axis=1)[:, at]) if blocks else np.zeros(0, np.uint8)
    over = delta > ((np.uint64(1) << widths.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)[:, None]
    rows, places = np.nonzero(over)
    values = delta[rows, places]
    delta[over] = 0
    size = block // 32 * widths.astype(np.int64)
    starts = np.cumsum(size) - size
    payload = np.zeros(int(size.sum()), "<u4")
    for width in np.unique(widths):
        if which := list(np.flatnonzero(widths == width)) if width else []:
            packed = pack(delta[which], int(width))
            payload[(starts[which][:, None] + np.arange(packed.shape[1])).ravel()] = packed.ravel()
    first = np.searchsorted(rows, np.arange(blocks))
    return b"".join((
        HEAD.pack(MAGIC, len(doc_ids), n, block, blocks, len(rows)),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        np.array([d is None for d in doc_ids], np.uint8).tobytes(),
        np.array(lengths, "<u4").tobytes(),
        low.astype("<u4").tobytes(),
        widths.tobytes(),
        starts.astype("<u4").tobytes(),
        first.astype("<u4").tobytes(),
        payload.tobytes(),
        places.astype("<u2").tobytes(),
        values.astype("<u4").tobytes(),
    ))


class Segment:
    """Reads one segment, whole or block by block."""

    def __init__(self, data: bytes) -> None:
        magic, docs, self.n, self.block, self.blocks, odd = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a TPF1 segment")
        at = HEAD.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        ids, null = take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if z else d for d, z in zip(ids.tolist(), null.tolist())]
        self.lengths = take("<u4", docs)
        self.low, self.widths, self.starts, self.first = take("<u4", self.blocks), take("u1", self.blocks), take("<u4", self.blocks), take("<u4", self.blocks)
        self.payload = take("<u4", int((self.block // 32 * self.widths.astype(np.int64)).sum()))
        self.places, self.values = take("<u2", odd), take("<u4", odd)

    def decode_blocks(self, begin: int, end: int) -> np.ndarray:
        """The values of blocks begin to end - 1, found by the index of block starts."""
        out = np.zeros((end - begin, self.block), np.uint32)
        widths = self.widths[begin:end]
        for width in np.unique(widths):
            which = np.flatnonzero(widths == width)
            if width:
                words = self.block // 32 * int(width)
                out[which] = unpack(self.payload[self.starts[begin:end][which][:, None].astype(np.int64) + np.arange(words)], int(width), self.block)
        bounds = np.append(self.first, len(self.places))
        some = slice(int(bounds[begin]), int(bounds[end]))
        rows = np.repeat(np.arange(end - begin), np.diff(bounds[begin : end + 1].astype(np.int64)))
        out[rows, self.places[some]] = self.values[some]
        return (out + self.low[begin:end, None]).ravel()[: max(0, self.n - begin * self.block)]

    def decode(self) -> np.ndarray:
        return self.decode_blocks(0, self.blocks)

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document, from its own blocks alone."""
        start = int(self.lengths[:k].sum())
        end = start + int(self.lengths[k])
        begin = start // self.block
        return self.decode_blocks(begin, -(-end // self.block))[start - begin * self.block : end - begin * self.block]
