"""Registered transliteration queries (TEXT rows) over whole documents.

A few letters have fixed readings. The dictionary of a table is made from the words of
the benchmark.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.functions import transliterate as X
from marketlens.operators import dictionary as D
from marketlens.registry import query

# Readings of single letters and letter groups, longest first in effect.
LETTERS = {"éau": "\tguān", "éa": "\tlǜ", "é": "\tā", "ñ": "\tnǐ", "ß": "\tshì", "ü": "\tyǔ"}
SURNAMES = [("Le", "\tlè"), ("Th", "\ttáng"), ("L", "\tlí"), ("E", "\tè")]

_PREPARED = r"regexp_replace(regexp_replace({0}, '([A-Za-z0-9_-]+)', chr(9) || '\1', 'g'), '[^\p{{Han}}\p{{P}}\p{{Z}}\p{{M}}\p{{N}}\p{{L}}\t]', '', 'g')"


def _read(body: str) -> str:
    for phrase, reading in LETTERS.items():
        body = f"replace({body}, '{phrase}', '{reading}')"
    return body


_ROMAN = _read(_PREPARED.format("text"))
_MARKS = "āēīōūǖáéíóúǘǎěǐǒǔǚàèìòùǜ"
_PLAINS = "aeiouvaeiouvaeiouvaeiouv"


def _plain(body: str) -> str:
    for marked in ("üē", "üé", "üě", "üè"):
        body = f"replace({body}, '{marked}', 'ue')"
    return f"translate({body}, '{_MARKS}', '{_PLAINS}')"


_SPLIT = "list_filter(regexp_split_to_array({0}, '[^üÜ" + _MARKS + _MARKS.upper() + "a-zA-Z0-9]+'), lambda w: w <> '')"
_WORDS = _SPLIT.format(_ROMAN)


def _parts(t):
    return [LETTERS]


@query("text_1_convert", f"select doc_id, len({_WORDS}) as words, array_to_string({_WORDS}, ' ') as marked, {_plain(f'array_to_string({_WORDS}, chr(32))')} as plain from documents")
def _(t):
    marked = X.convert(F.col("text"), _parts(t), "unicode")
    rows = t.documents.select("doc_id", marked.alias("w"))
    return rows.select("doc_id", F.size("w").alias("words"), F.array_join("w", " ").alias("marked"), F.array_join(F.transform("w", X.plain), " ").alias("plain"))


# The dictionary of a table: benchmark words with their letters reversed, and some of them cut in two by another part.
_PHRASES = r"""phrases as (select distinct 0 as part, w as phrase, chr(9) || reverse(w) as reading from (select unnest(regexp_split_to_array(lower(text), '[^\p{L}]+')) as w from benchmark) where length(w) > 2
    union all select distinct 1, left(w, 2), left(w, 1) || 'ǎ' from (select unnest(regexp_split_to_array(lower(text), '[^\p{L}]+')) as w from benchmark) where length(w) > 2)"""


def _read_part(part: int, source: str) -> str:
    """SQL tables that read one part: pieces, their matches, the walk from match to match, and the texts put together again."""
    p = f"p{part}"
    return rf"""{p} as materialized (select phrase, reading from phrases where part = {part}),
    {p}_class as materialized (select string_agg(c, '' order by c) as c from (select distinct unnest(string_split(phrase, '')) as c from {p})),
    {p}_runs as materialized (select doc_id, generate_subscripts(r, 1) as n, unnest(r) as piece from (select doc_id, regexp_extract_all(t, '[' || c || ']+|[^' || c || ']+') as r from {source}, {p}_class)),
    {p}_pieces as materialized (select distinct piece from {p}_runs, {p}_class where contains(c, left(piece, 1))),
    {p}_places as (select piece, unnest(generate_series(1, length(piece))) as i from {p}_pieces),
    {p}_found as materialized (select piece, i, max(size) as size, arg_max(reading, size) as reading from
      (select piece, i, size, substr(piece, i, size) as gram from {p}_places, (select distinct length(phrase) as size from {p}) where i + size - 1 <= length(piece)) join {p} on phrase = gram group by all),
    {p}_steps as materialized (select piece, i, i + coalesce(size, 1) as beyond, coalesce(reading, substr(piece, i, 1)) as added from {p}_places left join {p}_found using (piece, i)),
    {p}_walk(piece, i, result) as (select piece, 1::bigint, '' from {p}_pieces union all
      select w.piece, s.beyond, w.result || s.added from {p}_walk w join {p}_steps s on s.piece = w.piece and s.i = w.i),
    {p}_read as materialized (select piece, result from {p}_walk where i > length(piece)),
    {p}_texts as materialized (select doc_id, string_agg(coalesce(result, piece), '' order by n) as t from {p}_runs left join {p}_read using (piece) group by doc_id)"""


_BY_TABLE = (
    rf"with recursive {_PHRASES}, prepared as (select doc_id, {_PREPARED.format('text')} as t from documents), " + _read_part(0, "prepared") + ", " + _read_part(1, "p0_texts")
    + f", whole as (select doc_id, coalesce(p1_texts.t, prepared.t) as t from prepared left join p1_texts using (doc_id))"
)
_TABLE_WORDS = _SPLIT.format("t")


def _dictionary(t):
    words = t.benchmark.select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("w")).filter(F.length("w") > 2).distinct()
    whole = words.select(F.lit(0).alias("part"), F.col("w").alias("phrase"), F.concat(F.lit("\t"), F.reverse("w")).alias("reading"))
    return whole.union(words.select(F.lit(1), F.left("w", F.lit(2)), F.concat(F.left("w", F.lit(1)), F.lit("ǎ"))))


@query("text_1_convert_by_table", f"{_BY_TABLE} select doc_id, {_plain(f'array_to_string({_TABLE_WORDS}, chr(32))')} as plain from whole")
def _(t):
    rows = D.romanize(t.documents.select("doc_id", "text"), "text", _dictionary(t))
    return rows.select("doc_id", F.array_join(X.tokens(F.col("romanized")), " ").alias("plain"))


@query(
    "text_3_forms_by_table",
    f"{_BY_TABLE} select doc_id, {_plain(f'array_to_string({_TABLE_WORDS}, chr(45))')} as slug, array_to_string(list_transform({_TABLE_WORDS}, lambda w: left({_plain('w')}, 1)), '') as initials from whole",
)
def _(t):
    rows = D.romanize(t.documents.select("doc_id", "text"), "text", _dictionary(t))
    return rows.select("doc_id", X.slug(F.col("romanized")).alias("slug"), X.initials(F.col("romanized")).alias("initials"))


# Words with a tone number at the end, one for every kind of marked letter in them.
_NUMBERED = _plain("w") + "".join(f" || case when contains(w, '{m}') then '{n}' else '' end" for m, _, n in X.TONES[:4])
_REST = "w"
for _m, _l, _ in X.TONES[:4]:
    _REST = f"replace({_REST}, '{_m}', '{_l}')"
_NUMBERED += "".join(f" || case when contains({_REST}, '{m}') then '{n}' else '' end" for m, _, n in X.TONES[4:])


@query("text_1_tone_numbers", f"select doc_id, array_to_string(list_transform({_WORDS}, lambda w: {_NUMBERED}), ' ') as numbered from documents")
def _(t):
    return t.documents.select("doc_id", F.array_join(X.convert(F.col("text"), _parts(t), "ascii"), " ").alias("numbered"))


_SURNAMED = "case " + " ".join(f"when starts_with(p, '{s}') then '{r}' || substr(p, {len(s) + 1})" for s, r in SURNAMES) + " else p end"


@query("text_2_name", f"with q as (select doc_id, {_PREPARED.format('text')} as p from documents) select doc_id, {_plain('array_to_string(' + _SPLIT.format(_read(_SURNAMED)) + ', chr(32))')} as name from q")
def _(t):
    return t.documents.select("doc_id", F.array_join(X.name(F.col("text"), _parts(t), SURNAMES), " ").alias("name"))


@query("text_3_permalink", f"select doc_id, {_plain(f'array_to_string({_WORDS}, chr(45))')} as slug from documents")
def _(t):
    return t.documents.select("doc_id", X.permalink(F.col("text"), _parts(t), "-").alias("slug"))


@query("text_4_initials", f"select doc_id, array_to_string(list_transform({_WORDS}, lambda w: left({_plain('w')}, 1)), '') as initials from documents")
def _(t):
    return t.documents.select("doc_id", X.abbr(F.col("text"), _parts(t)).alias("initials"))


_KEPT = "regexp_replace(" + _ROMAN + ", '[^üÜ" + _MARKS + _MARKS.upper() + "a-zA-Z0-9，。！？：“”‘’,.!?:\"''\\s_]+', '', 'g')"
_SENTENCE = _KEPT
for _full, _simple in X.PUNCTUATION.items():
    _SENTENCE = f"replace({_SENTENCE}, '{_full}', '{_simple.replace(chr(39), chr(39) * 2)}')"
_SENTENCE = f"regexp_replace(replace(replace({_SENTENCE}, chr(9), ' '), '  ', ' '), '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g')"


@query("text_5_sentence", f"select doc_id, {_SENTENCE} as toned, {_plain(_SENTENCE)} as toneless from documents")
def _(t):
    toned = X.sentence(F.col("text"), _parts(t), with_tone=True)
    return t.documents.select("doc_id", toned.alias("toned")).withColumn("toneless", X.plain(F.col("toned")))


@query("text_6_prepare", f"select doc_id, {_PREPARED.format('text')} as prepared from documents")
def _(t):
    return t.documents.select("doc_id", X.prepare(F.col("text")).alias("prepared"))
