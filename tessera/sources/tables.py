"""Parquet tables, dealt to all cores where a file is too small to be split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def settle(rows: DataFrame) -> DataFrame:
    """The rows written once to the folder that executors share (``spark.checkpoint.dir``; for a master in this process one of our own), their lineage cut."""
    spark = rows.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(at or f"file:///tmp/checkpoints/{sc.applicationId}")
    return rows.checkpoint(eager=True)


def balanced(rows: DataFrame) -> DataFrame:
    """The rows over as many partitions as there are cores, if they came in fewer; large tables stay as they were read."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)
