"""The versioned chunk table: diff, upsert, retire, delete, as whole-snapshot DataFrames.

Parquet tables have no UPDATE or MERGE: each step gives the next snapshot, and
``write_snapshot`` puts it into a new folder and then moves the pointer.  All documents of a
batch are treated at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.params import DEFAULTS, Params

SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("source_path", T.StringType()), T.StructField("file_sha256", T.StringType()),
    T.StructField("document_title", T.StringType()), T.StructField("chunk_index", T.IntegerType()), T.StructField("text", T.StringType()),
    T.StructField("article_ref", T.StringType()), T.StructField("page_start", T.IntegerType()), T.StructField("page_end", T.IntegerType()),
    T.StructField("quality_flag", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("embedded_at", T.TimestampType()),
    T.StructField("active", T.BooleanType()), T.StructField("indexable", T.BooleanType()), T.StructField("scope_label", T.StringType()),
])
KEY = ["file_sha256", "chunk_index"]


def chunk_id() -> Column:
    """A stable id of a chunk from what identifies it."""
    return F.xxhash64("source_path", *KEY)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def migrate(rows: DataFrame) -> DataFrame:
    """Rows of an older shape in today's: flags default to true, other missing columns to null."""
    defaults = {"active": F.lit(True), "indexable": F.lit(True)}
    return rows.select(*((F.coalesce(F.col(f.name), defaults[f.name]) if f.name in rows.columns and f.name in defaults else F.col(f.name) if f.name in rows.columns else defaults.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in SCHEMA))


def read_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """The current snapshot; an empty table if there is none."""
    pointers = spark.read.schema("version long").parquet(f"{root}/versions") if _exists(spark, f"{root}/versions") else None
    version = pointers.agg(F.max("version")).first()[0] if pointers is not None else None
    return empty(spark) if version is None else migrate(spark.read.parquet(f"{root}/snapshot-{version}"))


def write_snapshot(rows: DataFrame, root: str) -> int:
    """Writes the next snapshot by active flag, then points to it; readers never see half of one."""
    spark = rows.sparkSession
    last = spark.read.schema("version long").parquet(f"{root}/versions").agg(F.max("version")).first()[0] if _exists(spark, f"{root}/versions") else None
    version = 0 if last is None else last + 1
    rows.write.partitionBy("active").parquet(f"{root}/snapshot-{version}")
    spark.range(version, version + 1).toDF("version").coalesce(1).write.mode("append").parquet(f"{root}/versions")
    return version


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def active_hashes(store: DataFrame) -> DataFrame:
    """source_path and the hash of its active version."""
    return store.where("active").groupBy("source_path").agg(F.min("file_sha256").alias("active_sha256"))


def has_active(store: DataFrame, paths: DataFrame) -> DataFrame:
    """The paths with an active chunk."""
    return paths.join(store.where("active").select("source_path"), "source_path", "left_semi")


def pending(store: DataFrame, batch: DataFrame) -> DataFrame:
    """Chunks of the batch that the store hasn't, active or not: what must be embedded.  A key repeated in the batch counts once."""
    order = Window.partitionBy(*KEY).orderBy("source_path")
    once = batch.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    return once.join(store.select(*KEY), KEY, "left_anti")


def changed_paths(store: DataFrame, batch: DataFrame) -> DataFrame:
    """Paths whose active hash differs from the batch's."""
    now = batch.groupBy("source_path").agg(F.min("file_sha256").alias("new_sha256"))
    return active_hashes(store).join(now, "source_path").where("active_sha256 <> new_sha256").select("source_path", "active_sha256", "new_sha256")


def retire(store: DataFrame, paths: DataFrame) -> DataFrame:
    """The store with every chunk of the paths inactive."""
    gone = paths.select("source_path").distinct().withColumn("_gone", F.lit(True))
    return store.join(gone, "source_path", "left").withColumn("active", F.col("active") & F.col("_gone").isNull()).select(*store.columns)


def delete(store: DataFrame, paths: DataFrame) -> DataFrame:
    return store.join(paths.select("source_path"), "source_path", "left_anti")


def prepared(batch: DataFrame) -> DataFrame:
    """Batch rows as the store keeps them: chunks without a vector aren't indexable."""
    rows = migrate(batch).withColumns({"id": chunk_id(), "active": F.lit(True)})
    return rows.withColumns({"indexable": F.col("indexable") & F.col("embedding").isNotNull(), "embedded_at": F.when(F.col("embedding").isNotNull(), F.coalesce("embedded_at", F.current_timestamp()))})


def upsert(store: DataFrame, batch: DataFrame) -> DataFrame:
    """The next snapshot: changed paths retire their old version, known rows of the new version come back to life, new rows are added.

    A document that returns to an earlier content is active again with its earlier rows."""
    now = batch.select("source_path", "file_sha256").distinct().withColumn("_now", F.lit(True))
    touched = batch.select("source_path").distinct().withColumn("_touched", F.lit(True))
    kept = store.join(touched, "source_path", "left").join(now, ["source_path", "file_sha256"], "left")
    kept = kept.withColumn("active", F.when(F.col("_touched").isNull(), F.col("active")).otherwise(F.col("_now").isNotNull())).select(*store.columns)
    return kept.unionByName(prepared(pending(store, batch)))


def ingest_totals(store: DataFrame, batch: DataFrame) -> DataFrame:
    """source_path, embedded, skipped, excluded: what an upsert of the batch does, by document."""
    new = pending(store, batch).select(*KEY).withColumn("_new", F.lit(True))
    vector = F.col("embedding").isNotNull() if "embedding" in batch.columns else F.lit(True)
    wanted = F.coalesce(F.col("indexable"), F.lit(True)) if "indexable" in batch.columns else F.lit(True)
    return batch.join(new, KEY, "left").groupBy("source_path").agg(
        F.count_if(F.col("_new").isNotNull() & wanted & vector).alias("embedded"), F.count_if(F.col("_new").isNull()).alias("skipped"), F.count_if(F.col("_new").isNotNull() & ~wanted).alias("excluded")
    )


def ingest_report(store: DataFrame, batch: DataFrame) -> DataFrame:
    """disposition, documents, embedded, skipped, excluded: what an upsert of the batch does, by disposition and, where it is null, in all."""
    kind = batch.groupBy("source_path").agg(F.max("disposition").alias("disposition"))
    sums = [F.sum(c).alias(c) for c in ("embedded", "skipped", "excluded")]
    return ingest_totals(store, batch).join(kind, "source_path").rollup("disposition").agg(F.count(F.lit(1)).alias("documents"), *sums)


def searchable(store: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """What both rankers read: active and indexable, vectors of the right size."""
    from tessera.operators.dense import checked

    return checked(store.where("active AND indexable"), params)


def metadata(store: DataFrame) -> DataFrame:
    """All columns but the vector, for joins after ranking."""
    return store.drop("embedding")


def mark_current(manifest: DataFrame) -> DataFrame:
    """Adds is_current: in each document_group the newest unrepealed son_versiyon, the first of them if none is dated;
    a group without one has a current entry only if it has a single entry.

    manifest: document_group, version_kind, is_mulga, rg_date (ISO text), seq (the entry's place)."""
    able = (F.col("version_kind") == "son_versiyon") & ~F.coalesce("is_mulga", F.lit(False))
    group = Window.partitionBy("document_group")
    dated = F.when(F.coalesce(F.col("rg_date") != "", F.lit(False)), F.col("rg_date"))
    rows = manifest.withColumns({"_able": able, "_any": F.max(able).over(group), "_n": F.count(F.lit(1)).over(group), "_r": F.row_number().over(group.orderBy(F.desc(able), dated.desc_nulls_last(), "seq"))})
    return rows.withColumn("is_current", F.when(F.col("_any"), (F.col("_r") == 1) & F.col("_able")).otherwise(F.col("_n") == 1)).drop("_able", "_any", "_n", "_r")
