"""Exports to delimited and JSON files, previews and formatted ranges."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, functions as F

# Rows per exported file.
SHEET_ROWS, CSV_ROWS, TEST_ROWS = 300_000, 1_000_000, 10_000


def labelled(df: DataFrame, labels: dict[str, str] | None) -> DataFrame:
    return df if not labels else df.select(*[F.col(c).alias(label) for c, label in labels.items()])


def export_delimited(
    df: DataFrame, path: str, delimiter: str = ",", labels: dict[str, str] | None = None, rows_per_file: int = CSV_ROWS,
    compressed: bool = False,
) -> int:
    """Delimited files with header, split by rows; returns the row count of the same job."""
    seen = Observation("export")
    rows = labelled(df, labels).observe(seen, F.count(F.lit(1)).alias("rows"))
    writer = rows.write.mode("overwrite").option("sep", delimiter).option("header", True).option("maxRecordsPerFile", rows_per_file)
    if compressed:
        writer = writer.option("compression", "gzip")
    writer.csv(path)
    return seen.get["rows"]


def export_tabs(df: DataFrame, path: str, labels: dict[str, str] | None = None, rows_per_file: int = SHEET_ROWS, compressed: bool = False) -> int:
    return export_delimited(df, path, "\t", labels, rows_per_file, compressed)


def quoted_line(columns: Sequence[str], delimiter: str = ",", enclosure: str = '"') -> Column:
    """One line with every element enclosed and enclosures doubled; nulls are empty."""
    def element(c: str) -> Column:
        text = F.coalesce(F.col(c).cast("string"), F.lit(""))
        return F.concat(F.lit(enclosure), F.replace(text, F.lit(enclosure), F.lit(enclosure * 2)), F.lit(enclosure))

    return F.concat_ws(delimiter, *[element(c) for c in columns])


def write_csv(
    df: DataFrame, path: str, delimiter: str = ",", enclosure: str = '"', line_ending: str = "\n", use_mark: bool = False,
    spreadsheet: bool = False,
) -> None:
    """Always-enclosed lines; ``use_mark`` starts every file with a byte order mark.

    ``spreadsheet`` means mark, semicolons, CRLF and a ``sep=;`` line on top.
    """
    if spreadsheet:
        delimiter, enclosure, line_ending, use_mark = ";", '"', "\r\n", True
    lines = df.select(quoted_line(df.columns, delimiter, enclosure).alias("value"))
    if use_mark:
        head = "\ufeff" + (f"sep={delimiter}" + line_ending if spreadsheet else "")

        def with_head(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            start = head
            for batch in batches:
                if len(batch) and start:
                    batch = batch.copy()
                    batch.iloc[0, 0] = start + batch.iloc[0, 0]
                    start = ""
                yield batch

        lines = lines.mapInPandas(with_head, "value string")
    lines.write.mode("overwrite").option("lineSep", line_ending).option("maxRecordsPerFile", 0).text(path)  # a task writes one file, with one head


def preview(df: DataFrame, order: Sequence[Column | str], n: int = 200) -> tuple[DataFrame, DataFrame]:
    """The first n rows of the sorted result, and its row count as one row."""
    return df.orderBy(*order).limit(n), df.agg(F.count(F.lit(1)).alias("count"))


def json_rows(df: DataFrame, name: str = "json") -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias(name))


def formatted(df: DataFrame, numbers: dict[str, int] | None = None, dates: dict[str, str] | None = None) -> DataFrame:
    """Range read back as text: numbers with digits, dates by pattern, the rest as it is."""
    numbers, dates = numbers or {}, dates or {}
    columns = []
    for c in df.columns:
        if c in numbers:
            columns.append(F.format_number(c, numbers[c]).alias(c))
        elif c in dates:
            columns.append(F.date_format(c, dates[c]).alias(c))
        else:
            columns.append(F.col(c))
    return df.select(*columns)
