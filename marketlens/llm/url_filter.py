"""URL filter: host and path rules first, then a weighted vocabulary found by an Aho-Corasick automaton.

The vocabulary has strict and soft terms. The automaton finds all terms in one pass over
the url (A-Z as a-z); a find counts if the characters before and after it are no ASCII
letters or digits. One strict term rejects a url, and so do ``SOFT_NEEDED`` different
soft terms; weights say it in one sum: a strict term weighs ``SOFT_NEEDED``, a soft term
1, each once.

Rules decide before the vocabulary: a rule fits its host and all subdomains if the url's
path starts with the rule's path, and the longest rule that fits wins.

Defined results: host and path of a null url and of one without ``://`` are empty, so no
rule fits; a null url holds no term and is allowed; rows, repeated rows and other columns
are kept, columns with the name of a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from marketlens.tables import Tables

#: (verdict, host/path) in any order.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
STRICT = (
    "adult", "camgirls", "casino", "erotic", "escort", "escorts", "gambling", "hardcore", "hentai", "malware", "nsfw", "phishing", "porn", "porno", "pornstar", "sexcam",
    "spam", "sportsbook", "viagra", "warez", "webcamsex", "xxx",
)
SOFT = (
    "ad", "ads", "banner", "bet", "bets", "betting", "bonus", "cheap", "click", "coupon", "crack", "deal", "dating", "discount", "farm", "free", "jackpot", "keygen", "loan",
    "loans", "lottery", "offer", "payday", "pharmacy", "pills", "poker", "popup", "prize", "replica", "serial", "sexy", "slots", "torrent", "track", "tracker", "tracking", "win",
    "winner",
)
SOFT_NEEDED = 2

_A_TO_Z = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lowered(text: Column) -> Column:
    return F.translate(text, *_A_TO_Z)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or end; path: then up to ``?``, ``#`` or end."""
    place = F.instr(url, "://")
    rest = F.when(place > 0, F.substr(url, place + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(lowered(host), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # later ones are longer and win
        domain, slash, start = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def vocabulary(strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT, needed: int = SOFT_NEEDED) -> dict[str, int]:
    return {t: 1 for t in soft} | {t: needed for t in strict}


def automaton(weights: dict[str, int]) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for term, weight in weights.items():
        made.add_word(term, (term, weight))
    made.make_automaton()
    return made


def _inside(c: str) -> bool:
    return "a" <= c <= "z" or "0" <= c <= "9"


def terms_in(url: str | None, made: ahocorasick.Automaton) -> dict[str, int]:
    """Terms of the vocabulary that stand alone in a lower-cased url, with their counts."""
    found: dict[str, int] = {}
    for end, (term, _) in made.iter(url or ""):
        before, after = end - len(term), end + 1
        if (before < 0 or not _inside(url[before])) and (after >= len(url) or not _inside(url[after])):
            found[term] = found.get(term, 0) + 1
    return found


def with_terms(pages: DataFrame, weights: dict[str, int], needed: int = SOFT_NEEDED, url: str = "url") -> DataFrame:
    """Adds ``strict_hits``, ``soft_hits`` (all finds), ``soft_terms`` (different ones), ``weight`` and ``terms``."""
    names = ("strict_hits", "soft_hits", "soft_terms", "weight", "terms")
    kept = [f for f in pages.schema.fields if f.name not in names]
    schema = T.StructType([*kept, *(T.StructField(n, T.IntegerType()) for n in names[:4]), T.StructField("terms", T.StringType())])
    columns = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = automaton(weights) if weights else None
        for batch in batches:
            rows = []
            for text in batch.column(batch.schema.names.index("_lowered")).to_pylist():
                found = terms_in(text, made) if made else {}
                strict = sum(n for t, n in found.items() if weights[t] >= needed)
                soft = [t for t in found if weights[t] < needed]
                rows.append((strict, sum(found[t] for t in soft), len(soft), sum(weights[t] for t in found), ",".join(sorted(found))))
            parts = [pa.array([r[i] for r in rows], pa.int32() if i < 4 else pa.string()) for i in range(5)]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.names.index(n)) for n in columns), *parts], names=[*columns, *names])

    return pages.select(*columns, lowered(F.col(url)).alias("_lowered")).mapInArrow(run, schema)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, weights: dict[str, int] | None = None, needed: int = SOFT_NEEDED) -> DataFrame:
    """Adds ``host``, ``path``, ``rule``, ``verdict`` and the finds of the vocabulary to every page."""
    found = with_terms(pages, vocabulary() if weights is None else weights, needed)
    host, path = host_and_path(F.col("url"))
    found = found.withColumns({"host": host, "path": path})
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    by_terms = F.when(F.col("weight") >= needed, "block").otherwise("allow")
    return found.withColumns({"rule": rule, "verdict": F.coalesce(ruled, by_terms)})


def query(spark: SparkSession, folder: str) -> DataFrame:
    judged = judge(Tables(spark, folder).pages.select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "strict_hits", "soft_hits", "soft_terms")


def _sql() -> str:
    low = "translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def listed(terms: Sequence[str]) -> str:
        return "[" + ", ".join(f"'{t}'" for t in terms) + "]"

    # a boundary may serve two finds, so the url is first spread out: every sign between letters and digits stands twice
    count = "[CAST(len(regexp_extract_all(spread, '(^|[^a-z0-9])' || t || '([^a-z0-9]|$)')) AS INT) for t in {terms}]"
    rule = "CASE " + " ".join(
        f"WHEN (host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}') THEN '{r}'"
        for _, r in sorted(RULES, key=lambda r: -len(r[1]))
    ) + " END"
    verdict = "CASE " + " ".join(f"WHEN rule = '{r}' THEN '{v}'" for v, r in RULES) + f" WHEN strict_hits > 0 OR soft_terms >= {SOFT_NEEDED} THEN 'block' ELSE 'allow' END"
    return f"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest,
    regexp_replace({low}, '([^a-z0-9])', '\\1\\1', 'g') AS spread
  FROM pages
), parts AS (
  SELECT page_id, spread, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), hits AS (
  SELECT page_id, host, path, {rule} AS rule, {count.format(terms=listed(STRICT))} AS strict, {count.format(terms=listed(SOFT))} AS soft FROM parts
), sums AS (
  SELECT page_id, host, path, rule, CAST(list_sum(strict) AS INT) AS strict_hits, CAST(list_sum(soft) AS INT) AS soft_hits,
    CAST(len([n for n in soft if n > 0]) AS INT) AS soft_terms
  FROM hits
)
SELECT page_id, host, path, rule, {verdict} AS verdict, strict_hits, soft_hits, soft_terms FROM sums
"""


SQL = _sql()
