"""Ranked lexical search over K2-treaps of the term-document grid.

Documents are indexed in blocks: rows are a block's terms, the commonest first; columns are
its documents, those with the same common terms side by side; a cell's value is the impact
of the term in the document, which is a whole number that holds all of the score but the
term's weight. A block with its terms, document frequencies, ids and tree is one row of
the index, made by one task from the rows it reads, without a shuffle.

Items are searched in batches of a bounded number of terms. A task keeps the k best
documents of an item over the blocks it reads, and their last score is the least that a
later block must reach; the k best of all tasks are then ranked by a window whose rows are
limited to k before they are shuffled.

Defined results: a null or empty text has no term; documents without terms are no part of
the counts; rows with a repeated doc_id are documents of their own, a null doc_id stands
behind the others among equal scores; repeated rows of an item are items of their own,
with results of their own; an item without terms, or whose terms no document has, gets no
rows; other columns are left out; empty tables give no rows.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from marketlens.llm.k2_treap import Treap, build
from marketlens.operators.scratch import scratch_table
from marketlens.tables import Tables

K = 50
#: A block ends with the document that fills it.
BLOCK_CELLS, BLOCK_DOCUMENTS = 1 << 20, 1 << 13
#: Terms of the items that are sent to the tasks at once.
BATCH_TERMS = 100_000

_SEPARATORS = [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
_FOLD = bytes(0x20 if b in _SEPARATORS and not 0x41 <= b <= 0x5A else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """Runs of letters, digits and characters beyond ASCII, with A-Z lower-cased, as UTF-8."""
    return text.encode().translate(_FOLD).split() if text else []


def counts(documents: DataFrame) -> tuple[int, int]:
    """Documents with a term, and terms in all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents = total = 0
        for batch in batches:
            lengths = [len(terms(x)) for x in batch.column(0).to_pylist()]
            documents, total = documents + sum(map(bool, lengths)), total + sum(lengths)
        yield pa.RecordBatch.from_arrays([pa.array([documents]), pa.array([total])], names=["documents", "total"])

    row = documents.select("text").mapInArrow(run, "documents bigint, total bigint").agg(F.sum("documents"), F.sum("total")).first()
    return row[0] or 0, row[1] or 0


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """Whole-number impacts of terms that occur ``tf`` times in documents of ``n`` terms."""
    if 50 * int(n.max(initial=0)) * documents < 2**63:
        m = 50 + 50 * n * documents // total
    else:
        m = np.array([50 + 50 * int(x) * documents // total for x in n], np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def _block(ids: list, lengths: list[int], names: list[bytes], rows: np.ndarray, places: np.ndarray, tf: np.ndarray, documents: int, total: int) -> pa.RecordBatch:
    df = np.bincount(rows, minlength=len(names))
    common = np.argsort(-df, kind="stable")
    rank = np.empty(len(names), np.int64)
    rank[common] = np.arange(len(names))
    rows = rank[rows]
    # documents in the order of their commonest terms
    by = np.lexsort((rows, places))
    starts = np.searchsorted(places[by], np.arange(len(ids)))
    ends = np.append(starts[1:], len(by))
    heads = [rows[by[np.minimum(starts + i, ends - 1)]] for i in range(4)]
    order = np.lexsort(heads[::-1])
    column = np.empty(len(ids), np.int64)
    column[order] = np.arange(len(ids))
    values = impacts(tf, np.array(lengths, np.int64)[places], documents, total)
    sizes, quarters, maxima = build(rows, column[places], values)
    columns = [
        pa.array([[ids[i] for i in order]], pa.list_(pa.int64())), pa.array([[names[i].decode() for i in common]], pa.list_(pa.string())), pa.array([df[common].tolist()], pa.list_(pa.int64())),
        pa.array([sizes], pa.list_(pa.int64())), pa.array([quarters], pa.binary()), pa.array([maxima], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["ids", "terms", "df", "sizes", "quarters", "maxima"])


def index(documents: DataFrame, n: int, total: int) -> DataFrame:
    """Blocks of all documents with a term, written to scratch; ``n`` and ``total`` as ``counts`` gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, rows, tf, distinct = [], [], [], [], []
        names: dict[bytes, int] = defaultdict()
        names.default_factory = names.__len__

        def ended() -> pa.RecordBatch:
            places = np.repeat(np.arange(len(ids)), distinct)
            return _block(ids, lengths, list(names), np.array(rows, np.int64), places, np.array(tf, np.int64), n, total)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = Counter(every := terms(text))
                if not found:
                    continue
                ids.append(doc_id)
                lengths.append(len(every))
                distinct.append(len(found))
                rows.extend(map(names.__getitem__, found))
                tf.extend(found.values())
                if len(rows) >= BLOCK_CELLS or len(ids) >= BLOCK_DOCUMENTS:
                    yield ended()
                    for x in (ids, lengths, rows, tf, distinct, names):
                        x.clear()
        if ids:
            yield ended()

    schema = "ids array<bigint>, terms array<string>, df array<bigint>, sizes array<bigint>, quarters binary, maxima binary"
    return scratch_table(documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, schema), "treap-index")


def item_terms(items: DataFrame) -> DataFrame:
    """``key, item_id, term``: the distinct terms of every row, with a number of its own for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, item, text in zip(*(c.to_pylist() for c in batch.columns)):
                if found := [t.decode() for t in dict.fromkeys(terms(text))]:
                    m = len(found)
                    yield pa.RecordBatch.from_arrays([pa.array([key] * m, pa.int64()), pa.array([item] * m, pa.int64()), pa.array(found)], names=["key", "item_id", "term"])

    numbered = items.select(F.monotonically_increasing_id().alias("key"), F.col("item_id").cast("bigint").alias("item_id"), "text")
    return scratch_table(numbered.mapInArrow(run, "key bigint, item_id bigint, term string"), "item-terms")


def weight(df: int, n: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def _best_of_batch(blocks: DataFrame, asked: dict[int, list[tuple[str, int]]], k: int) -> DataFrame:
    """``key, doc_id, score``: the k best documents of each item, for every task; ``asked`` has terms and weights by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = defaultdict(list)
        for batch in batches:
            for i in range(len(batch)):
                block = batch.slice(i, 1)
                ids, names, sizes, quarters, maxima = (block.column(c)[0].as_py() for c in ("ids", "terms", "sizes", "quarters", "maxima"))
                treap, rows = Treap(sizes, quarters, maxima), {t: r for r, t in enumerate(names)}
                for key, wanted in asked.items():
                    paths = [(rows[t], w) for t, w in wanted if t in rows]
                    if not paths:
                        continue
                    best = held[key]
                    columns, scores = treap.best(*np.array(paths, np.int64).T, k, -best[-1][0] if len(best) == k else 1)
                    found = [(-s, ids[c] is None, ids[c] or 0) for c, s in zip(columns.tolist(), scores.tolist())]
                    held[key] = heapq.nsmallest(k, best + found)
        for key, best in held.items():
            columns = [pa.array([key] * len(best), pa.int64()), pa.array([None if x[1] else x[2] for x in best], pa.int64()), pa.array([-x[0] for x in best], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "doc_id", "score"])

    return blocks.select("ids", "terms", "sizes", "quarters", "maxima").mapInArrow(run, "key bigint, doc_id bigint, score bigint")


def search(documents: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """``item_id, rank, doc_id, score`` of the k best documents with a score above 0 for every row of ``items``."""
    n, total = counts(documents)
    blocks = index(documents, n, total)
    frequencies = blocks.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.df").alias("df"))
    wanted = scratch_table(item_terms(items).join(frequencies, "term"), "weighed-terms")
    batches = max(1, -(-wanted.count() // BATCH_TERMS))
    parts = []
    for b in range(batches):
        asked: dict[int, list[tuple[str, int]]] = defaultdict(list)
        for r in wanted.filter(F.pmod(F.xxhash64("key"), F.lit(batches)) == b).collect():  # about BATCH_TERMS rows
            if w := weight(r.df, n):
                asked[r.key].append((r.term, w))
        parts.append(_best_of_batch(blocks, dict(asked), k))
    best = Window.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = reduce(DataFrame.union, parts).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.join(wanted.select("key", "item_id").distinct(), "key").select("item_id", "rank", "doc_id", "score")


#: SQL for the query's rows.
SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS place, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
),
held AS (SELECT place, doc_id, terms, len(terms) AS n FROM words WHERE len(terms) > 0),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM held),
cells AS (SELECT place, term, count(*) AS tf FROM (SELECT place, unnest(terms) AS term FROM held) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM cells GROUP BY term),
asked AS (
  SELECT DISTINCT key, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS key, item_id, text FROM benchmark)
),
weighed AS (SELECT key, item_id, term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM asked JOIN df USING (term) CROSS JOIN whole),
scored AS (
  SELECT key, any_value(item_id) AS item_id, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total))))::BIGINT AS score
  FROM weighed JOIN cells USING (term) JOIN held USING (place) CROSS JOIN whole GROUP BY key, place
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, doc_id NULLS LAST) AS r FROM scored WHERE score > 0)
SELECT item_id, r::INTEGER AS rank, doc_id, score FROM ranked WHERE r <= 50
""".replace("\\\\", "\\")


def query(spark: SparkSession, folder: str) -> DataFrame:
    tables = Tables(spark, folder)
    return search(tables.documents, tables.benchmark)
