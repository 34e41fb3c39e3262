"""Text functions as Columns. Positions are 1-based; what the spreadsheet calls an error is null."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

CONTROL = r"[\x00-\x1F]"


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def char(code: Column) -> Column:
    """Character of a code point; null where there is none (below 0, surrogates, beyond 0x10FFFF)."""
    valid = (code >= 0) & (code < 0x110000) & ((code < 0xD800) | (code >= 0xE000))
    # The byte order mark in front is dropped by the decoder, so that U+FEFF itself stays.
    return F.when(valid, F.decode(F.unhex(F.concat(F.lit("0000FEFF"), F.lpad(F.hex(code.cast("bigint")), 8, "0"))), "UTF-32"))


def code(x: Column) -> Column:
    """Code point of the first character."""
    return F.when(F.length(x) > 0, F.ascii(x))


def clean(x: Column) -> Column: return F.regexp_replace(x, CONTROL, "")


def trim(x: Column) -> Column:
    """Inner runs of spaces become one; white space at both ends goes."""
    return F.regexp_replace(F.regexp_replace(x, " +", " "), r"^[ \t\n\r\x00\x0B]+|[ \t\n\r\x00\x0B]+$", "")


def concatenate(*xs: Column) -> Column: return F.concat(*[F.coalesce(x.cast("string"), F.lit("")) for x in xs])


def _grouped(x: Column, decimals: int) -> Column:
    return F.format_number(F.round(x, decimals), max(decimals, 0))


def dollar(x: Column, decimals: int = 2) -> Column: return F.concat(F.lit("$"), _grouped(x, decimals))


def fixed(x: Column, decimals: int = 2, no_commas: bool = False) -> Column:
    text = _grouped(x, decimals)
    return F.replace(text, F.lit(","), F.lit("")) if no_commas else text


# Date tokens of the cell formats and their Spark patterns.
_DATE_TOKENS = {
    "yyyy": "yyyy", "yy": "yy", "mmmm": "MMMM", "mmm": "MMM", "mm": "MM", "m": "M", "dddd": "EEEE", "ddd": "EEE",
    "dd": "dd", "d": "d", "hh": "HH", "h": "H", "ss": "ss", "s": "s", "am/pm": "a",
}


def date_pattern(mask: str) -> str:
    """Spark pattern of a date mask; ``mm`` after hours or before seconds means minutes."""
    tokens = re.findall(r"am/pm|y+|m+|d+|h+|s+|[^ymdhsa]+|a", mask.lower())
    out = []
    for i, token in enumerate(tokens):
        before = next((x for x in reversed(tokens[:i]) if x[0] in "ymdhs"), "")
        after = next((x for x in tokens[i + 1:] if x[0] in "ymdhs"), "")
        if token in ("m", "mm") and (before.startswith("h") or after.startswith("s")):
            out.append(token)
        elif token in _DATE_TOKENS:
            out.append(_DATE_TOKENS[token].replace("HH", "hh").replace("H", "h") if "am/pm" in tokens else _DATE_TOKENS[token])
        else:
            out.append("'" + token + "'" if token.isalpha() else token)
    return "".join(out)


def text_of_number(x: Column, mask: str) -> Column:
    """Number by a mask such as ``0.00``, ``#,##0.0`` or ``0.0%``."""
    m = re.fullmatch(r"([^0#]*)([#,0]*0)(?:\.(0+))?(%?)([^0#]*)", mask)
    head, whole, decimals, percent, tail = m.groups()
    value = x * 100 if percent else x
    shown = _grouped(value, len(decimals or ""))
    if "," not in whole:
        shown = F.replace(shown, F.lit(","), F.lit(""))
    return F.concat(F.lit(head), shown, F.lit(percent + tail))


def text_of_date(x: Column, mask: str) -> Column: return F.date_format(x, date_pattern(mask))


def find(needle, x: Column, start: Column | int = 1) -> Column:
    place = F.call_function("locate", _col(needle), x, _col(start))
    return F.when(place > 0, place)


def search(needle, x: Column, start: Column | int = 1) -> Column: return find(F.lower(_col(needle)), F.lower(x), start)
def left(x: Column, chars: Column | int = 1) -> Column: return F.when(_col(chars) >= 0, F.left(x, _col(chars)))


def mid(x: Column, start: Column | int = 1, chars: Column | int | None = None) -> Column:
    if chars is None:
        return F.when(_col(start) >= 1, F.substr(x, _col(start)))
    return F.when((_col(start) >= 1) & (_col(chars) >= 0), F.substr(x, _col(start), _col(chars)))


def right(x: Column, chars: Column | int = 1) -> Column: return F.when(_col(chars) >= 0, F.right(x, _col(chars)))
def length(x: Column) -> Column: return F.length(x)
def lower(x: Column) -> Column: return F.lower(x)
def upper(x: Column) -> Column: return F.upper(x)


def proper(x: Column) -> Column:
    """First letter of every word upper, the rest lower; a word ends at anything but a letter, digit or apostrophe."""
    words = F.split(F.lower(x), r"(?<=[^\p{L}\p{N}'])")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substr(w, F.lit(2)))), "")


def replace(x: Column, start: Column | int, chars: Column | int, new) -> Column: return F.overlay(x, _col(new), _col(start), _col(chars))


def substitute(x: Column, old: Column | str, new: Column | str, instance: Column | int = 0) -> Column:
    """Every occurrence (instance 0), or the n-th one only.

    For the n-th, occurrences may overlap; a text that has fewer, or an empty ``old``,
    leaves the text as it is. Fractions of an instance are rounded down.
    """
    old, new, n = _col(old), _col(new), F.floor(_col(instance)).cast("int")
    head = F.call_function("substring_index", x, old, n)
    size = F.char_length(head)
    one = F.concat(head, new, F.substr(x, size + F.char_length(old) + 1))
    found = (old != "") & (size < F.char_length(x))
    nothing = x.isNull() | old.isNull() | new.isNull() | n.isNull()
    return F.when(nothing, None).when(n == 0, F.replace(x, old, new)).when((n > 0) & found, one).otherwise(x)


def rept(x: Column, times: Column | int) -> Column: return F.repeat(x, _col(times))


def t(x: Column) -> Column:
    """The text itself, empty for anything that is a number or a truth value."""
    from marketlens.functions.logic import istext

    return F.when(istext(x), x).otherwise(F.lit(""))
