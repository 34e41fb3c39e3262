"""Delimited text: reading with dialect, encoding and read filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructType


def read_delimited(
    spark: SparkSession, paths: str | Sequence[str], schema: StructType | str, delimiter: str = ",", enclosure: str = '"',
    encoding: str = "UTF-8", header: bool = False, multiline: bool = False, with_file: bool = False, backslash: bool = False,
) -> DataFrame:
    """Rows of one or several files; several files append to one range.

    Empty fields are null and a leading byte order mark is skipped. Enclosures inside a
    value are doubled; a backslash before one is taken off as well. Files that put
    delimiters right after backslashed enclosures need ``backslash``. ``with_file`` adds
    the file path of each row.
    """
    quote = enclosure or '"'
    reader = (
        spark.read.schema(schema).option("sep", delimiter).option("quote", quote).option("escape", "\\" if backslash else quote)
        .option("unescapedQuoteHandling", "STOP_AT_CLOSING_QUOTE")
        .option("encoding", encoding).option("header", header).option("multiLine", multiline)
        .option("nullValue", "").option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("mode", "PERMISSIVE")
    )
    df = reader.csv(paths if isinstance(paths, str) else list(paths))
    columns: list[Column] = []
    for field in df.schema.fields:
        c = F.col(field.name)
        if isinstance(field.dataType, StringType):
            c = F.replace(c, F.lit("\\" + quote), F.lit(quote)).alias(field.name)
        columns.append(c)
    if with_file:
        columns.append(F.col("_metadata.file_path").alias("file_path"))
    return df.select(*columns)


def only(df: DataFrame, columns: Sequence[str], rows: Column | None = None) -> DataFrame:
    """Read filter: chosen columns and rows; both reach the scan."""
    return (df if rows is None else df.filter(rows)).select(*columns)


def profile(df: DataFrame) -> DataFrame:
    """Row and column count as one row."""
    return df.agg(F.count(F.lit(1)).alias("total_rows")).withColumn("total_columns", F.lit(len(df.columns)))
