"""Ingest as a stream of files (an extension beside the batch engine)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tessera.operators import services, store
from tessera.params import DEFAULTS, Params
from tessera.plans.pipelines import ingest
from tessera.sources.files import Converter, extract


def stream_ingest(spark: SparkSession, root: str, store_root: str, checkpoint: str, embed: services.Embed, convert: Converter | None = None, params: Params = DEFAULTS) -> StreamingQuery:
    """Each micro-batch of new files becomes the store's next snapshot; a repeated batch changes nothing, as rows are keyed by content."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).load(root)

    def put(batch: DataFrame, _: int) -> None:
        session = batch.sparkSession
        store.write_snapshot(ingest(store.read_snapshot(session, store_root), extract(batch.select("path", "length", "content"), convert, params), embed, params), store_root)

    return files.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
