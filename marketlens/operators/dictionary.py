"""Transliteration by a dictionary table of any size.

A text is read in pieces, the longest runs of characters that occur in phrases of any
part, since no phrase reaches beyond one, before or after the parts that come first. So
all parts are applied to a piece alone.

A dictionary of moderate size (HELD_PHRASES, HELD_CHARACTERS) is sent to all tasks, which
read their own texts; nothing is shuffled. With a larger one every distinct piece is looked
up once: the grams of its places, of the lengths that phrases with that first character
have, are joined with the phrases. Leftmost longest matches are then read off for each
piece, part by part, and the pieces of a text are replaced. Neither these phrases nor texts
pass through the driver.

Defined results: phrases that are null or empty are left out, one that stands several
times in a part takes its smallest reading, a null reading is empty; a null text stays
null; parts apply in their order, each to what the one before it left.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf
from pyspark.sql.types import StringType

from marketlens.functions.transliterate import prepare, with_surname
from marketlens.operators.joins import salted_join
from marketlens.operators.scratch import scratch_table

#: Phrases, and characters in them and their readings, that may be sent to all tasks.
HELD_PHRASES, HELD_CHARACTERS = 100_000, 4_000_000
#: Readings of short pieces that a task keeps.
KEPT_PIECES, KEPT_LENGTH = 200_000, 64
#: Texts of an Arrow batch that are Python strings at a time.
SLICE = 100


@pandas_udf(StringType())
def _read_off(pieces: pd.Series, matches: pd.Series) -> pd.Series:
    """Every piece with its leftmost matches replaced; ``matches`` come by place, the longest one of a place first."""

    def one(piece, found):
        out, done = [], 0
        for m in found:
            if (at := m["at"] - 1) >= done:
                out += [piece[done:at], m["reading"]]
                done = at + m["size"]
        return "".join(out) + piece[done:]

    return pd.Series([one(p, m) for p, m in zip(pieces, matches)], dtype=object)


@pandas_udf(StringType())
def _put_back(texts: pd.Series, runs: pd.Series, read: pd.Series) -> pd.Series:
    """Texts with their pieces replaced; ``runs`` are a text's pieces in order, ``read`` those that changed."""

    def one(text, pieces, changed):
        if changed is None or not len(changed):
            return text
        readings, out, done = {m["piece"]: m["reading"] for m in changed}, [], 0
        for p in pieces:
            at = text.index(p, done)  # only other characters stand between two pieces
            out += [text[done:at], readings.get(p, p)]
            done = at + len(p)
        return "".join(out) + text[done:]

    return pd.Series([one(t, p, m) for t, p, m in zip(texts, runs, read)], dtype=object)


def read_pieces(pieces: DataFrame, phrases: DataFrame) -> DataFrame:
    """``piece, reading`` of the distinct pieces that hold a phrase."""
    # characters bound this table, whatever the number of phrases
    lengths = phrases.groupBy(F.left("phrase", F.lit(1)).alias("_first")).agg(F.collect_set(F.length("phrase")).alias("_sizes"))
    places = pieces.select("piece", F.explode(F.sequence(F.lit(1), F.length("piece"))).alias("at"))
    grams = places.withColumn("_first", F.substring("piece", F.col("at"), F.lit(1))).join(lengths, "_first")
    grams = grams.select("piece", "at", F.explode("_sizes").alias("size")).filter(F.col("at") + F.col("size") - 1 <= F.length("piece"))
    grams = grams.withColumn("phrase", F.substring("piece", F.col("at"), F.col("size")))
    found = grams.join(phrases, "phrase")
    matches = found.groupBy("piece").agg(F.sort_array(F.collect_list(F.struct("at", (-F.col("size")).alias("_shorter"), "size", "reading"))).alias("matches"))
    return matches.select("piece", _read_off("piece", "matches").alias("reading"))


def romanize(df: DataFrame, text: str, phrases: DataFrame, surnames: Sequence[tuple[str, str]] = (), name: str = "romanized") -> DataFrame:
    """Adds the prepared text with readings for the phrases of the table (part, phrase, reading).

    Surnames are a short list and apply to the beginning of the prepared text.
    """
    usable = phrases.filter(F.length("phrase") > 0).groupBy("part", "phrase").agg(F.coalesce(F.min("reading"), F.lit("")).alias("reading"))
    usable = scratch_table(usable, "phrases")
    rows = df.withColumn(name, with_surname(prepare(F.col(text)), surnames))
    held = usable.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("phrase").cast("bigint") + F.length("reading")).alias("characters")).first()
    if not held.n:
        return rows
    if held.n <= HELD_PHRASES and held.characters <= HELD_CHARACTERS:
        parts: dict = {}
        for r in usable.orderBy("part").collect():
            parts.setdefault(r.part, {})[r.phrase] = r.reading
        return rows.withColumn(name, _read_here(F.col(name), list(parts.values())))
    return _by_pieces(rows, name, usable)


def _replaced(piece: str, words: dict[str, str], sizes: dict[str, list[int]]) -> str:
    """Leftmost longest phrases replaced; ``sizes`` has the lengths of phrases, longest first, by their first two characters."""
    out, done, i, end = [], 0, 0, len(piece)
    while i < end:
        for size in sizes.get(piece[i : i + 2]) or sizes.get(piece[i], ()):
            reading = words.get(piece[i : i + size]) if i + size <= end else None
            if reading is not None:
                out += [piece[done:i], reading]
                done = i = i + size
                break
        else:
            i += 1
    return "".join(out) + piece[done:] if out else piece


def _sizes(words: dict[str, str]) -> dict[str, list[int]]:
    found: dict[str, set[int]] = {}
    for phrase in words:
        found.setdefault(phrase[:2], set()).add(len(phrase))
    for start, sizes in found.items():
        sizes.update(found.get(start[0], ()))  # one character that is a phrase by itself
    return {start: sorted(sizes, reverse=True) for start, sizes in found.items()}


class _Readings(dict):
    """Readings of pieces, made when asked for; short ones are kept."""

    def __init__(self, parts):
        self.parts = parts

    def __missing__(self, piece):
        reading = piece
        for words, sizes in self.parts:
            reading = _replaced(reading, words, sizes)
        if len(piece) <= KEPT_LENGTH:
            if len(self) >= KEPT_PIECES:
                self.clear()
            self[piece] = reading
        return reading


def _read_here(text: Column, parts: Sequence[dict[str, str]]) -> Column:
    """Texts read in their own tasks, part by part; short pieces that come again are read once."""
    characters = {c for words in parts for phrase in words for c in phrase}
    run = "([" + "".join(re.escape(c) for c in sorted(characters)) + "]+)"
    parts = [(words, _sizes(words)) for words in parts]

    @arrow_udf(StringType())
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces, readings = re.compile(run), _Readings(parts)

        def one(value):
            if value is None:
                return None
            cut = pieces.split(value)  # every second one is a piece
            cut[1::2] = map(readings.__getitem__, cut[1::2])
            return "".join(cut)

        for texts in batches:
            # of a batch only a slice at a time is held as Python strings
            slices = (texts.slice(at, SLICE) for at in range(0, len(texts), SLICE))
            yield pa.concat_arrays([pa.array([one(t.as_py()) for t in part], pa.string()) for part in slices] or [pa.array([], pa.string())])

    return read(text)


def _by_pieces(df: DataFrame, text: str, phrases: DataFrame) -> DataFrame:
    characters = phrases.select(F.explode(F.split("phrase", "")).alias("c")).filter("c <> ''").distinct()
    # at most the characters of Unicode, as one class of a pattern
    allowed = "".join(f"\\x{{{ord(r.c):X}}}" for r in characters.collect())
    runs = F.regexp_extract_all(F.col(text), F.lit(f"([{allowed}]+)"), F.lit(1))
    rows = scratch_table(df.withColumn("_row", F.monotonically_increasing_id()), "texts")
    of_text = rows.select("_row", F.explode(F.array_distinct(runs)).alias("piece"))
    read = scratch_table(of_text.select("piece", F.col("piece").alias("reading")).distinct(), "pieces")
    for (part,) in phrases.select("part").distinct().orderBy("part").collect():
        found = read_pieces(read.select(F.col("reading").alias("piece")).distinct(), phrases.filter(F.col("part").eqNullSafe(part)).select("phrase", "reading"))
        found = found.select(F.col("piece").alias("_before"), F.col("reading").alias("_after"))
        after = F.coalesce("_after", "reading").alias("reading")
        read = scratch_table(read.join(found, F.col("reading") == F.col("_before"), "left").select("piece", after), "pieces")
    changed = salted_join(of_text, read.filter("piece <> reading"), ["piece"], ["_row"]).groupBy("_row").agg(F.collect_list(F.struct("piece", "reading")).alias("_read"))
    whole = rows.join(changed, "_row", "left")
    return whole.withColumn(text, _put_back(F.col(text), runs, F.col("_read"))).select(*df.columns)
