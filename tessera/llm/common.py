"""Session, storage and Arrow helpers shared by the operators of this package."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or one of our own if unset.

    Where neither is set, a master that runs in this process gets a folder under /tmp/checkpoints;
    on a cluster only its owner knows what is shared, so that is an error.
    """
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = f"file:///tmp/checkpoints/{sc.applicationId}"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """Ends the lineage with an eager, replicated-by-storage checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Workspace:
    """Tables that an operator writes to the shared folder for itself: ``put`` one, ``drop`` it, or leave all to ``close``.

    What outlives the operator must not read them any more (see ``cut``)."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.at, self.paths = spark, scratch(spark, name), {}

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{self.at}/{len(self.paths)}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[path] = out
        return out

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)

    def drop(self, *tables: DataFrame) -> None:
        for path, table in self.paths.items():
            if any(table is t for t in tables):
                self._delete(path)
                self.paths[path] = None

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_: object) -> None:
        self._delete(self.at)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A plain large_string array; null becomes the empty string."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def drop_encoders() -> None:
    """Frees the token encoders that an earlier operator left in this worker process."""
    if loaded := sys.modules.get("tessera.llm.tokens"):
        loaded._encoder.cache_clear()


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: T.StructType | str, *, encodes: bool = False) -> DataFrame:
    """``mapInArrow`` with a per-task factory, so that models load once a task.

    Unless the step encodes tokens, encoders of earlier tasks make room for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not encodes:
            drop_encoders()
        step = None
        for batch in batches:
            if batch.num_rows:
                step = step or make()
                if (out := step(batch)) is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


SIEVE_BITS = 24


def sieve(keys: Column, df: DataFrame) -> DataFrame:
    """A set of hashes of keys, as rows of bits: 2 MB at most, whatever the number of keys."""
    place = F.pmod(F.xxhash64(keys), F.lit(1 << SIEVE_BITS))
    return df.groupBy(F.shiftright(place, 15).alias("sieve_row")).agg(F.bitmap_construct_agg(place.bitwiseAND(32767)).alias("sieve_bits"))


def sifted(df: DataFrame, key: Column, rows: DataFrame, name: str) -> DataFrame:
    """df with a boolean column ``name``: false only where the key is in no row that ``sieve`` saw.

    A broadcast of at most 2 MB; it spares rows a shuffle, and a join has the last word on those that pass."""
    place = F.pmod(F.xxhash64(key), F.lit(1 << SIEVE_BITS))
    at = place.bitwiseAND(32767)
    byte = F.conv(F.hex(F.col("sieve_bits").substr(F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.call_function("shiftright", byte, at.bitwiseAND(7).cast("int")).bitwiseAND(1) == 1
    out = df.join(F.broadcast(rows), F.shiftright(place, 15) == F.col("sieve_row"), "left")
    return out.withColumn(name, F.coalesce(hit, F.lit(False))).drop("sieve_row", "sieve_bits")


def spread(column: Column, n: int | Column) -> Column:
    """A bucket from 0 to n - 1 by the column's hash."""
    return F.pmod(F.xxhash64(column), F.lit(n) if isinstance(n, int) else n)


def hash32(*parts: Column) -> Column:
    """A uniform 32-bit number by hash; the same in any engine that has md5.  Null parts are left out."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long")


HASH32_SQL = "('0x' || substr(md5({}), 1, 8))::BIGINT"
