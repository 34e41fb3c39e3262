"""Transliteration of text by a few phrases, and the forms made from a romanized text.

Dictionaries of any size are tables, see ``marketlens.operators.dictionary``; the forms
below take the romanized column that it gives as well.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

# Vowels with tone marks, their plain letters and tone numbers, in this order.
TONES = (
    ("üē", "ue", 1), ("üé", "ue", 2), ("üě", "ue", 3), ("üè", "ue", 4),
    ("ā", "a", 1), ("ē", "e", 1), ("ī", "i", 1), ("ō", "o", 1), ("ū", "u", 1), ("ǖ", "v", 1),
    ("á", "a", 2), ("é", "e", 2), ("í", "i", 2), ("ó", "o", 2), ("ú", "u", 2), ("ǘ", "v", 2),
    ("ǎ", "a", 3), ("ě", "e", 3), ("ǐ", "i", 3), ("ǒ", "o", 3), ("ǔ", "u", 3), ("ǚ", "v", 3),
    ("à", "a", 4), ("è", "e", 4), ("ì", "i", 4), ("ò", "o", 4), ("ù", "u", 4), ("ǜ", "v", 4),
)
# Full-width punctuation and its plain form.
PUNCTUATION = {"，": ",", "。": ".", "！": "!", "？": "?", "：": ":", "“": '"', "”": '"', "‘": "'", "’": "'"}
MARKED = "üāēīōūǖáéíóúǘǎěǐǒǔǚàèìòùǜ"
# Character classes are split into an ASCII part, which is one table lookup, and the rest. Runs of
# either stand side by side: a repeated group would take a stack frame for every character.
BEYOND = r"\x{80}-\x{10FFFF}"
DROPPED = r"[\x00-\x08\x0A-\x1F\x7F$+<=>^`|~]+|[" + BEYOND + r"&&[^\p{IsHan}\p{P}\p{Z}\p{M}\p{N}\p{L}]]+"
BETWEEN_WORDS = f"[^A-Za-z0-9{BEYOND}]+|[{BEYOND}&&[^{MARKED}{MARKED.upper()}]]+"
DELIMITERS = ("_", "-", ".", "")
#: Phrases of a part that one pattern tries in turn.
FEW_PHRASES = 200


def prepare(text: Column) -> Column:
    """Latin words are set off by a tab; only letters, marks, digits, punctuation and spaces stay."""
    words = F.regexp_replace(text, "([A-Za-z0-9_-]+)", "\t$1")
    return F.regexp_replace(words, DROPPED, "")


def replace_longest(text: str, words: dict[str, str], longest: dict[str, int], starts: re.Pattern) -> str:
    """Leftmost longest phrases replaced; replaced text is not read again.

    ``starts`` finds the next character that begins a phrase, ``longest`` bounds the
    phrases that begin with it.
    """
    out, done = [], 0
    found = starts.search(text)
    while found:
        i = found.start()
        after = i + 1
        for size in range(min(longest[text[i]], len(text) - i), 0, -1):
            reading = words.get(text[i : i + size])
            if reading is not None:
                out.append(text[done:i])
                out.append(reading)
                done = after = i + size
                break
        found = starts.search(text, after)
    out.append(text[done:])
    return "".join(out)


def with_surname(prepared: Column, surnames: Sequence[tuple[str, str]]) -> Column:
    """Surnames (phrase, reading) apply to the beginning only, the first that fits."""
    if not surnames:
        return prepared
    named = [F.when(F.startswith(prepared, F.lit(s)), F.concat(F.lit(r), F.substr(prepared, F.lit(len(s) + 1)))) for s, r in surnames]
    return F.coalesce(*named, prepared)


def _read_natively(text: Column, words: dict[str, str]) -> Column:
    """One part's leftmost longest phrases replaced, as an expression: the text is cut into phrases, runs without a first character, and first characters of no phrase."""
    literal = lambda s: "".join(f"\\x{{{ord(c):X}}}" for c in s)
    phrases = "|".join(map(literal, sorted(words, key=len, reverse=True)))
    firsts = "".join(literal(c) for c in dict.fromkeys(phrase[0] for phrase in words))
    pieces = F.regexp_extract_all(text, F.lit(f"{phrases}|[^{firsts}]+|[{firsts}]"), F.lit(0))
    readings = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
    return F.array_join(F.transform(pieces, lambda p: F.coalesce(F.try_element_at(readings, p), p)), "")


def romanize(text: Column, parts: Sequence[dict[str, str]], surnames: Sequence[tuple[str, str]] = ()) -> Column:
    """Readings for the phrases of the prepared text, part by part, longest phrase first.

    Parts of up to FEW_PHRASES are expressions and hold one text at a time; only larger
    ones are read in Python, by their first characters.
    """
    prepared = with_surname(prepare(text), surnames)
    for words in parts:
        if words:
            prepared = _read_natively(prepared, words) if len(words) <= FEW_PHRASES else _read_in_python(prepared, words)
    return prepared


def _read_in_python(prepared: Column, words: dict[str, str]) -> Column:
    longest: dict[str, int] = {}
    for phrase in words:
        longest[phrase[0]] = max(longest.get(phrase[0], 0), len(phrase))
    starts = "[" + "".join(re.escape(c) for c in longest) + "]"

    @pandas_udf("string")
    def read(values: pd.Series) -> pd.Series:
        finder = re.compile(starts)
        return values.map(lambda value: replace_longest(value, words, longest, finder), na_action="ignore")

    return read(prepared)


def plain(text: Column) -> Column:
    """Tone marks taken off."""
    for marked, letters, _ in TONES[:4]:
        text = F.replace(text, F.lit(marked), F.lit(letters))
    single = TONES[4:]
    return F.translate(text, "".join(m for m, _, _ in single), "".join(x for _, x, _ in single))


def numbered_tones(text: Column) -> Column:
    """Tone marks taken off, the tone numbers at the end of the word."""
    digits = [F.when(F.contains(text, F.lit(m)), F.lit(str(tone))).otherwise("") for m, _, tone in TONES]
    # The two-letter forms come first and leave no mark behind for the single letters.
    rest = text
    for marked, letters, _ in TONES[:4]:
        rest = F.replace(rest, F.lit(marked), F.lit(letters))
    digits[4:] = [F.when(F.contains(rest, F.lit(m)), F.lit(str(tone))).otherwise("") for m, _, tone in TONES[4:]]
    # most words have no mark and stay as they are
    return F.when(F.rlike(text, F.lit("[" + "".join(m for m, _, _ in TONES[4:]) + "]")), F.concat(plain(text), *digits)).otherwise(text)


def tokens(romanized: Column, option: str = "none") -> Column:
    """Words of a romanized text: plain (none), with tone numbers (ascii) or with tone marks (unicode)."""
    # A mark and its plain letter both belong to words, so the whole text is made plain before the split.
    text = plain(romanized) if option == "none" else romanized
    words = F.array_remove(F.split(text, BETWEEN_WORDS), "")
    return F.transform(words, numbered_tones) if option == "ascii" else words


def convert(text: Column, parts, option: str = "none") -> Column: return tokens(romanize(text, parts), option)
def name(text: Column, parts, surnames, option: str = "none") -> Column: return tokens(romanize(text, parts, surnames), option)


def permalink(text: Column, parts, delimiter: str = "-") -> Column: return slug(romanize(text, parts), delimiter)


def slug(romanized: Column, delimiter: str = "-") -> Column:
    if delimiter not in DELIMITERS:
        raise ValueError("delimiter must be one of '_', '-', '.' or empty")
    joined = F.regexp_replace(F.regexp_replace(plain(romanized), BETWEEN_WORDS, "\n"), "\n+", "\n")
    return F.translate(F.trim(joined, F.lit("\n")), "\n", delimiter)


def abbr(text: Column, parts, delimiter: str = "") -> Column: return initials(romanize(text, parts), delimiter)


def initials(romanized: Column, delimiter: str = "") -> Column:
    return F.array_join(F.transform(tokens(romanized), lambda w: F.left(w, F.lit(1))), delimiter)


def sentence(text: Column, parts, with_tone: bool = False) -> Column: return readable(romanize(text, parts), with_tone)


def readable(romanized: Column, with_tone: bool = False) -> Column:
    """Readable line: other characters out, punctuation plain, tabs and double spaces to one space."""
    ascii_marks = "".join(dict.fromkeys(PUNCTUATION.values()))
    unwanted = f"[^A-Za-z0-9{ascii_marks}\\s_{BEYOND}]+|[{BEYOND}&&[^{MARKED}{MARKED.upper()}{''.join(PUNCTUATION)}]]+"
    kept = F.regexp_replace(romanized, unwanted, "")
    for full, simple in PUNCTUATION.items():
        kept = F.replace(kept, F.lit(full), F.lit(simple))
    kept = F.replace(F.replace(kept, F.lit("\t"), F.lit(" ")), F.lit("  "), F.lit(" "))
    kept = F.regexp_replace(kept, r"^[ \t\n\r\x00\x0B]+|[ \t\n\r\x00\x0B]+$", "")
    return kept if with_tone else plain(kept)
