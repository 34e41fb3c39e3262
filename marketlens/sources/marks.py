"""Byte order marks of the files in a folder."""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marketlens.operators.scratch import scratch_table

MARK = "EFBBBF"


def has_mark(content: Column) -> Column:
    return F.hex(F.substring(content, 1, 3)) == MARK


def without_mark(content: Column) -> Column:
    return F.when(has_mark(content), F.substring(content, 4, 2147483647)).otherwise(content)


def folder_report(spark: SparkSession, folder: str) -> DataFrame:
    """Every file below the folder: path, whether it starts with a mark, and its content without it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", has_mark(F.col("content")).alias("had_mark"), without_mark(F.col("content")).alias("content"))


def clean_folder(spark: SparkSession, folder: str, target: str) -> DataFrame:
    """Writes every file below the folder to the same place below ``target``, byte for byte but for a mark at its start.

    Returns the report: place below the folder, whether there was a mark, bytes written.
    Empty files hold no mark; Spark's file scans leave them out, so they are not copied.
    Each task writes its files whole, so a task that runs again gives the same files; both
    folders are on storage that all tasks reach.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    root = _bare(folder.rstrip("/"))
    inside = F.expr(f"substr(path, instr(path, {_quoted(root)}) + {len(root) + 1})")
    rows = files.select(inside.alias("file"), has_mark(F.col("content")).alias("had_mark"), without_mark(F.col("content")).alias("content"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = (fs.LocalFileSystem(), _bare(target)) if "://" not in target or target.startswith("file:") else fs.FileSystem.from_uri(target)
        for batch in batches:
            sizes = []
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content").to_pylist()):
                path = posixpath.join(place, file)
                store.create_dir(posixpath.dirname(path), recursive=True)
                with store.open_output_stream(path) as out:
                    out.write(content)
                sizes.append(len(content))
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("had_mark"), pa.array(sizes, pa.int64())], names=["file", "had_mark", "bytes"])

    return scratch_table(rows.mapInArrow(write, "file string, had_mark boolean, bytes bigint"), "cleaned")


def _bare(folder: str) -> str:
    """The folder without its scheme, as it stands in the paths that Spark lists."""
    return folder.split("://", 1)[-1].removeprefix("file:")


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
