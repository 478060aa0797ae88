"""Operator 10: vector best-fit packing of documents into token sequences.

Each text is encoded whole and closed with an end id; documents over the
token capacity are cut, the first piece taking the remainder and the others
the full capacity.  Pieces (a few numbers each, never their text) are dealt
evenly into packing tasks.  There, in falling size, each goes to the open
sequence that suits it best under every one of three residual capacities:
tokens, documents and attention cost (the sum of squared lengths).  ``norm``
takes the least weighted norm of what would be left, ``dot`` the greatest
weighted product of need and residual.

Cases: null text is empty (one piece, the end id alone); rows that repeat a
doc_id are packed each for itself; null doc_id passes through; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, map_arrow, strings
from tessera.llm.tokens import encoder, vocabulary_file

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
TEXTS_AT_ONCE = 1000
_ARROW = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64()}


def cut_pieces(docs: DataFrame, *, capacity: int = 1024, end_id: int = 2, vocabulary: str | None = None) -> DataFrame:
    """One row a piece; no shuffle, texts stay where they were read."""
    vocabulary = vocabulary or vocabulary_file()
    end = np.array([end_id], "<u4").tobytes()

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows: list[list] = [[], [], [], [], []]
            ids, texts = batch.column("doc_id").to_pylist(), strings(batch.column("text"))
            for at in range(0, len(ids), TEXTS_AT_ONCE):
                for doc, raw in zip(ids[at:], encoder(vocabulary).encode(texts.slice(at, TEXTS_AT_ONCE).to_pylist())):
                    raw += end
                    n = len(raw) // 4
                    begins = [0] if n <= capacity else [*([0] if n % capacity else []), *range(n % capacity, n, capacity)]
                    for k, (b, e) in enumerate(zip(begins, [*begins[1:], n])):
                        for column, value in zip(rows, (doc, k, b, e - b, zlib.crc32(raw[4 * b : 4 * e]))):
                            column.append(value)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, list(_ARROW.values())[:5])], names=list(_ARROW)[:5])

        return step

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), make, PIECES, encodes=True)


def best_fit(lengths: np.ndarray, capacity: int, max_docs: int, max_attention: int, weights: tuple[float, float, float], rule: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each piece, and the number of bins."""
    scale = 1 / np.array([capacity, max_docs, max_attention], np.float64)
    weight = np.array(weights, np.float64)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    least = int(lengths.min(initial=1))
    room = np.zeros((1024, 3), np.int64)  # of open sequences
    name = np.zeros(1024, np.int64)
    n_open = n_bins = 0
    for k in order.tolist():
        length = int(lengths[k])
        need = np.array([length, 1, length * length], np.int64)
        at = -1
        if n_open and length < capacity:
            left = room[:n_open] - need
            fits = (left >= 0).all(axis=1)
            if fits.any():
                if rule == "norm":
                    score = ((left * scale) ** 2) @ weight
                    score[~fits] = np.inf
                    at = int(score.argmin())
                else:
                    score = (room[:n_open] * scale * (need * scale)) @ weight
                    score[~fits] = -np.inf
                    at = int(score.argmax())
        if at < 0:
            if n_open == len(room):
                room, name = np.concatenate([room, np.zeros_like(room)]), np.concatenate([name, np.zeros_like(name)])
            at, n_open = n_open, n_open + 1
            room[at], name[at] = (capacity, max_docs, max_attention), n_bins
            n_bins += 1
        bins[k], offsets[k] = name[at], capacity - room[at, 0]
        room[at] -= need
        if room[at, 0] < least or room[at, 1] < 1 or room[at, 2] < least * least:
            n_open -= 1
            room[at], name[at] = room[n_open], name[n_open]
    return bins, offsets, n_bins


def pack(pieces: DataFrame, *, capacity: int = 1024, max_docs: int = 1024, max_attention: int | None = None, weights: tuple[float, float, float] = (1.0, 0.02, 0.02), rule: str = "norm", pieces_a_task: int = 20_000) -> DataFrame:
    """Adds sequence_id and offset.  ``pieces`` must be cheap to read again (checkpointed)."""
    max_attention = max_attention or capacity * capacity
    tasks = max(1, -(-pieces.count() // pieces_a_task))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches):
        held = list(batches)
        if not held:
            return
        whole = pa.Table.from_batches(held).combine_chunks()
        bins, offsets, _ = best_fit(whole["length"].to_numpy(), capacity, max_docs, max_attention, weights, rule)
        first = TaskContext.get().partitionId() << 32
        whole = whole.append_column("sequence_id", pa.array(bins + first)).append_column("offset", pa.array(offsets))
        yield from whole.to_batches()

    return pieces.select(*names).repartition(tasks).mapInArrow(run, PIECES + ", sequence_id long, offset long")


def best_fit_pack(docs: DataFrame, *, capacity: int = 1024, **options) -> DataFrame:
    return pack(cut(cut_pieces(docs, capacity=capacity)), capacity=capacity, **options)


def op10_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
