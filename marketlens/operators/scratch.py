"""Scratch tables: results that several later steps read, written once to shared storage.

A written table cuts the lineage, survives lost executors and is read back with column
pruning and known size. Tables go below the folder in ``spark.checkpoint.dir``, which a
cluster must set to shared storage. Where it is unset, as in tests on one machine, they go
below the warehouse folder, by default a local folder below the working one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return it as a scan of the written files."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete the scratch tables of this application; frames that still read them become invalid."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
