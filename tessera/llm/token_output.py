"""Operator 2: token ids in patched frame-of-reference blocks.

``write_tokens`` range-partitions documents by doc_id, encodes each whole text,
closes it with an end id and writes segments (see ``pfor``) as the binary
column of a Parquet table: part, seg, ids_before (in the part), n_docs, n_ids,
data.  ``read_tokens`` decodes them; ``read_ids`` fetches single documents.

Cases: null text counts as empty (the end id alone); null doc_id sorts first;
rows that repeat a doc_id are kept side by side, in any order; an empty table
writes no segment and reads as no row; further columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import pfor
from tessera.llm.common import map_arrow, partitions, scratch, strings
from tessera.llm.tokens import encoder, vocabulary_file

SEGMENTS = "part int, seg int, ids_before long, n_docs int, n_ids int, data binary"
ROWS = "doc_id long, part int, at long, n_tokens long, ids_crc32 long"
TEXTS_AT_ONCE = 1000


def write_tokens(docs: DataFrame, path: str, *, vocabulary: str | None = None, end_id: int = 0, segment_ids: int = 1 << 18, block: int = 256, percentile: float = 95.0, files: int | None = None) -> None:
    """Writes the ids of all documents to ``path``, in ascending doc_id order over the parts."""
    vocabulary = vocabulary or vocabulary_file()
    end = np.array([end_id], "<u4").tobytes()
    kind = pa.schema([("part", pa.int32()), ("seg", pa.int32()), ("ids_before", pa.int64()), ("n_docs", pa.int32()), ("n_ids", pa.int32()), ("data", pa.binary())])

    def run(batches):
        part, seg, before = TaskContext.get().partitionId(), 0, 0
        names, lengths, parts, held = [], [], [], 0

        def flush():
            nonlocal seg, before, names, lengths, parts, held
            data = pfor.encode_segment(names, lengths, np.frombuffer(b"".join(parts), "<u4"), block, percentile)
            out = pa.RecordBatch.from_pylist([{"part": part, "seg": seg, "ids_before": before, "n_docs": len(names), "n_ids": held, "data": data}], schema=kind)
            seg, before, names, lengths, parts, held = seg + 1, before + held, [], [], [], 0
            return out

        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), strings(batch.column("text"))
            for at in range(0, len(ids), TEXTS_AT_ONCE):
                for name, raw in zip(ids[at:], encoder(vocabulary).encode(texts.slice(at, TEXTS_AT_ONCE).to_pylist())):
                    names.append(name)
                    parts.append(raw + end)
                    lengths.append(len(raw) // 4 + 1)
                    held += lengths[-1]
                    if held >= segment_ids:
                        yield flush()
        if names:
            yield flush()

    n = files or partitions(docs.sparkSession)
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(run, SEGMENTS).write.option("compression", "none").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    segments = spark.read.schema(SEGMENTS).parquet(path)

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            columns: list[list] = [[], [], [], [], []]
            for part, before, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                segment = pfor.Segment(data.as_py())
                raw, ends = segment.decode().astype("<u4").tobytes(), np.cumsum(segment.lengths.astype(np.int64))
                begins = ends - segment.lengths
                columns[0] += segment.doc_ids
                columns[1] += [part] * len(ends)
                columns[2] += (begins + before).tolist()
                columns[3] += segment.lengths.tolist()
                columns[4] += [zlib.crc32(raw[4 * b : 4 * e]) for b, e in zip(begins.tolist(), ends.tolist())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "part", "at", "n_tokens", "ids_crc32"])

        return step

    rows = map_arrow(segments.select("part", "ids_before", "data"), make, ROWS)
    # One row a write task: the bound of this broadcast is the number of files.
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("total"))
    from pyspark.sql import Window

    bases = parts.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    return rows.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, path: str, wanted: list[int]) -> DataFrame:
    """doc_id and ids of the wanted documents, from their own blocks alone."""
    some = set(wanted)

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [(d, segment.document(k)) for data in batch.column(0) for segment in [pfor.Segment(data.as_py())] for k, d in enumerate(segment.doc_ids) if d in some]
            return pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.int64()), pa.array([x.tolist() for _, x in found], pa.list_(pa.int64()))], names=["doc_id", "ids"])

        return step

    return map_arrow(spark.read.schema(SEGMENTS).parquet(path).select("data"), make, "doc_id long, ids array<long>")


def op2_pfor_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = scratch(spark, "tokens")
    write_tokens(docs, path)
    return read_tokens(spark, path)
