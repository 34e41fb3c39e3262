"""Tables and embedded literals inside page markup."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

TABLE, ROW, CELL = r"(?is)<table\b[^>]*>(.*?)</table>", r"(?is)<tr\b[^>]*>(.*?)</tr>", r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"
LIST, ITEM = r"(?is)<[uo]l\b[^>]*>(.*?)</[uo]l>", r"(?is)<li\b[^>]*>(.*?)</li>"
# The character entities that are resolved.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def plain_text(markup: Column) -> Column:
    """Text of a cell: tags out, entities resolved, white space collapsed."""
    text = F.regexp_replace(markup, r"(?is)<[^>]+>", "")
    for entity, character in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(character))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def cells(pages: DataFrame, key: str, markup: str, table: str = TABLE, row: str = ROW, cell: str = CELL) -> DataFrame:
    """(key, table, row, col, text), numbered from 1, for well-formed markup; no Python involved."""
    tables = pages.select(key, F.posexplode(_all(F.col(markup), table)).alias("table", "_t"))
    rows = tables.select(key, "table", F.posexplode(_all(F.col("_t"), row)).alias("row", "_r"))
    found = rows.select(key, "table", "row", F.posexplode(_all(F.col("_r"), cell)).alias("col", "_c"))
    return found.select(key, *[(F.col(c) + 1).alias(c) for c in ("table", "row", "col")], plain_text(F.col("_c")).alias("text"))


def list_items(pages: DataFrame, key: str, markup: str) -> DataFrame:
    """(key, list, row, text) of the items of lists."""
    lists = pages.select(key, F.posexplode(_all(F.col(markup), LIST)).alias("list", "_l"))
    items = lists.select(key, "list", F.posexplode(_all(F.col("_l"), ITEM)).alias("row", "_i"))
    return items.select(key, (F.col("list") + 1).alias("list"), (F.col("row") + 1).alias("row"), plain_text(F.col("_i")).alias("text"))


class _Cells(HTMLParser):
    """Collects cells even where closing tags are missing."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.table, self.row, self.col, self.text = [], 0, 0, 0, None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self._close()
            self.table, self.row, self.col = self.table + 1, 0, 0
        elif tag == "tr":
            self._close()
            self.row, self.col = self.row + 1, 0
        elif tag in ("td", "th") and self.table:
            self._close()
            self.row, self.col, self.text = max(self.row, 1), self.col + 1, ""

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr", "table"):
            self._close()

    def handle_data(self, data):
        if self.text is not None:
            self.text += data

    def _close(self):
        if self.text is not None:
            self.found.append((self.table, self.row, self.col, " ".join(self.text.split())))
            self.text = None


def lenient_cells(pages: DataFrame, key: str, markup: str) -> DataFrame:
    """As ``cells`` for broken markup, one page at a time in Arrow batches."""
    kind = dict(pages.dtypes)[key]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, text in zip(batch[key], batch[markup]):
                reader = _Cells()
                reader.feed(text or "")
                reader.close()
                reader._close()
                out.extend((name, *cell) for cell in reader.found)
            yield pd.DataFrame(out, columns=[key, "table", "row", "col", "text"])

    return pages.select(key, markup).mapInPandas(parse, f"{key} {kind}, table int, row int, col int, text string")


_TOKEN = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"|\'[^\'\\]*(?:\\.[^\'\\]*)*\'|[\[\],]|[^\[\],"\']+|["\']')


def literal_rows(text: str, name: str) -> list[list[str]]:
    """Fields of the rows of the first array literal ``name = [[..], ..]``; quotes and brackets inside fields are kept.

    Quoted fields lose their quotes and the backslashes before characters, others the space around them.
    """
    begin = re.search(rf"(?<![\w$]){re.escape(name)}\s*=\s*\[", text)
    rows, depth, field = [], 1, None
    for token in _TOKEN.finditer(text, begin.end()) if begin else ():
        t = token.group()
        if depth == 2 and t in (",", "]"):
            if field is not None or t == "," or rows[-1]:
                rows[-1].append(field or "")
            field = None
            depth -= t == "]"
        elif depth == 1 and t == "[":
            rows.append([])
            depth = 2
        elif depth == 1 and t == "]":
            return rows
        elif depth >= 2:
            depth += (t == "[") - (t == "]")
            quoted = len(t) > 1 and t[0] in "\"'" and depth == 2
            part = re.sub(r"\\(.)", r"\1", t[1:-1]) if quoted else t.strip() if depth == 2 and t not in "[]" else t
            if part or quoted:
                field = (field or "") + part
    return []  # the literal never ends


def embedded_rows(pages: DataFrame, key: str, text: str, name: str) -> DataFrame:
    """Rows of an array literal ``name=[[..],[..]]`` anywhere in a page: (key, row, fields)."""
    kind = dict(pages.dtypes)[key]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(k, n, fields) for k, page in zip(batch[key], batch[text]) for n, fields in enumerate(literal_rows(page or "", name), 1)]
            yield pd.DataFrame(found, columns=[key, "row", "fields"])

    return pages.select(key, text).mapInPandas(scan, f"{key} {kind}, row int, fields array<string>")
