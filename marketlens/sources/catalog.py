"""Warehouse and catalog tables, named relations and ranges of cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def warehouse_table(spark: SparkSession, table: str, fields: Sequence[str] = ()) -> DataFrame:
    """Scan of a saved table, or of parquet files when the name is a path."""
    df = spark.read.parquet(table) if "/" in table else spark.table(table)
    return df.select(*fields) if fields else df


def catalog_table(
    spark: SparkSession, table: str, folder: str | None = None, jdbc: dict[str, str] | None = None,
    split_on: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8,
) -> DataFrame:
    """Catalog table by JDBC (read in parts when a numeric column is given) or from parquet in ``folder``."""
    if jdbc is None:
        return spark.read.parquet(f"{folder}/{table}.parquet")
    reader = spark.read.format("jdbc").options(**jdbc).option("dbtable", table)
    if split_on and bounds:
        reader = (
            reader.option("partitionColumn", split_on).option("lowerBound", bounds[0]).option("upperBound", bounds[1])
            .option("numPartitions", parts)
        )
    return reader.load()


def named_range(df: DataFrame, name: str) -> DataFrame:
    """Register a relation under a name and return it by that name."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def rows_to_range(spark: SparkSession, rows: Sequence[Sequence], schema: StructType | str, null_value=None) -> DataFrame:
    """A small list of rows as a relation; ``null_value`` stands for an empty cell."""
    cleaned = [tuple(None if v == null_value else v for v in row) for row in rows]
    return spark.createDataFrame(cleaned, schema)


def array_to_range(df: DataFrame, keys: Sequence[str], values: str) -> DataFrame:
    """Array columns laid out as cells (keys, column number from 1, value); nulls stay empty and are left out."""
    cells = df.select(*keys, F.posexplode(values).alias("col", "value"))
    return cells.filter(F.col("value").isNotNull()).withColumn("col", F.col("col") + 1)
