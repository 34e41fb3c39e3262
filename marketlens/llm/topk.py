"""Exact top-k inner products by the three-phase uniform threshold method.

The dimensions are cut into ``SLICES`` slices, and each slice is a list of local scores
whose sum is the score of a vector. For every query:

1. the best local scores of each slice are gathered, and the vectors seen there are added
   up over all slices; the k-th largest of these sums is a safe cutoff;
2. the cutoff, spread evenly over the slices, is sent back. Every vector with a local
   score of that share or more (counted from the slice's smallest) is collected; no other
   vector can reach the cutoff;
3. collected vectors get their exact score, and the k best of those that reach the
   cutoff are ranked.

Vectors lie in blocks of ``BLOCK`` rows and queries in blocks of ``QUERY_BLOCK``, as the
narrowest whole numbers that hold them. Parts of the queries and parts of the candidates
meet in cells, dealt by one exchange of both: a task holds the queries of its cell (at
most about ``HELD_BYTES``) and reads the candidates block by block. No join is planned
and nothing but sums reaches the driver, so it holds as little for any number of vectors.

Defined results: components count as ``floor(256 * x)`` in double precision; a vector that
is null, or holds a null or non-finite component, or has no id, takes no part; vectors
are compared with vectors of the same length; rows with the same id are rows of their
own, and only a query's own row is no candidate of it; ties go to the smaller id; scores
must fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from marketlens.operators.scratch import scratch_table
from marketlens.tables import Tables

K, EVERY, SLICES = 5, 50, 4
BLOCK, QUERY_BLOCK = 2048, 512
#: Pairs of a query and a candidate in a cell, copies of a vector that cells may take on average, and bytes of queries held by a task.
CELL_PAIRS, COPIES, HELD_BYTES = 1 << 26, 3, 32_000_000
#: Queries compared with a block at once: their scores stay in the processor's cache.
_AT_ONCE = 128
_HELD = 50_000
NONE = np.iinfo(np.int64).min

_BLOCK_SCHEMA = "block bigint, dim int, ids binary, rows array<bigint>, vectors binary"


def _narrow(data: np.ndarray) -> np.ndarray:
    low, high = data.min(initial=0), data.max(initial=0)
    return data.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def _packed(pieces: list[tuple[np.ndarray, np.ndarray, np.ndarray]], names: list[int], dim: int) -> pa.RecordBatch:
    columns = [pa.array(names, pa.int64()), pa.array([dim] * len(names), pa.int32())]
    ids = pa.array([np.ascontiguousarray(p[0]).tobytes() for p in pieces], pa.binary())
    vectors = pa.array([_narrow(p[2]).tobytes() for p in pieces], pa.binary())
    columns += [ids, pa.array([p[1] for p in pieces], pa.list_(pa.int64())), vectors]
    return pa.RecordBatch.from_arrays(columns, names=["block", "dim", "ids", "rows", "vectors"])


def blocks(vectors: DataFrame, size: int = BLOCK) -> DataFrame:
    """Blocks of whole-number vectors of one length, with ids and a number for every row."""
    usable = vectors.filter(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 32
        waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        held: dict[int, int] = {}

        def packed(dim: int) -> pa.RecordBatch:
            nonlocal made
            ids, data = (np.concatenate(x) for x in zip(*waiting.pop(dim)))
            held.pop(dim)
            pieces, names = [], []
            for start in range(0, len(ids), size):
                some = slice(start, start + size)
                n = len(ids[some])
                pieces.append((ids[some], made * size + np.arange(n, dtype=np.int64), data[some]))
                names.append(made)
                made += 1
            return _packed(pieces, names, dim)

        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(1)
            lengths = np.diff(lists.offsets.to_numpy())
            flat = np.floor(256 * lists.flatten().to_numpy())
            flat = np.clip(flat, -(2.0**62), 2.0**62).astype(np.int64)
            ends = np.cumsum(lengths)
            for dim in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == dim)
                data = flat[(ends[at] - dim)[:, None] + np.arange(dim)] if dim else np.zeros((len(at), 0), np.int64)
                waiting.setdefault(dim, []).append((ids[at], data))
                held[dim] = held.get(dim, 0) + len(at)
                if held[dim] >= size:
                    yield packed(dim)
        for dim in list(waiting):
            yield packed(dim)

    return usable.mapInArrow(run, _BLOCK_SCHEMA)


def _parse(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, width = np.frombuffer(row["ids"], np.int64), len(row["vectors"]) * 8 // max(1, len(row["ids"]) * row["dim"])
    return ids, np.array(row["rows"], np.int64), np.frombuffer(row["vectors"], f"i{width or 8}").reshape(len(ids), row["dim"])


def query_blocks(candidates: DataFrame, every: int = EVERY, size: int = QUERY_BLOCK) -> DataFrame:
    """The rows whose id is divisible by ``every``, in blocks of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 32
        waiting: dict[int, list[tuple]] = {}

        def packed(dim: int, least: int) -> Iterator[pa.RecordBatch]:
            nonlocal made
            whole = [np.concatenate(x) for x in zip(*waiting[dim])]
            while len(whole[0]) >= least and len(whole[0]):
                yield _packed([tuple(x[:size] for x in whole)], [made], dim)
                whole = [x[size:] for x in whole]
                made += 1
            waiting[dim] = [tuple(whole)]

        for batch in batches:
            for row in batch.to_pylist():
                ids, rows, vectors = _parse(row)
                mine = ids % every == 0
                waiting.setdefault(row["dim"], []).append((ids[mine], rows[mine], vectors[mine]))
                yield from packed(row["dim"], size)
        for dim in list(waiting):
            yield from packed(dim, 1)

    return candidates.mapInArrow(run, _BLOCK_SCHEMA)


def _reach(vectors: np.ndarray) -> float:
    """The greatest length of a vector."""
    return max(1.0, float(np.sqrt(np.square(vectors.astype(float)).sum(axis=1)).max(initial=0)))


def _exact_type(reach: float, slices: int) -> type:
    """The fastest type for scores up to ``reach``: their sums and multiples by the slices are whole numbers that it holds."""
    most = 2.001 * max(slices, 1) * reach
    return np.float32 if most < 2.0**24 else np.float64 if most < 2.0**53 else np.int64


def local_scores(queries: np.ndarray, vectors: np.ndarray, slices: int = SLICES, kind: type | None = None, room: np.ndarray | None = None) -> list[np.ndarray]:
    """Local scores (query, vector) of every slice, exact; ``room`` (slice, query, vector) takes them where given."""
    dim = vectors.shape[1]
    bounds = [dim * s // slices for s in range(slices + 1)]
    kind = kind or _exact_type(_reach(queries) * _reach(vectors), slices)
    queries, vectors = queries.astype(kind, copy=False), vectors.astype(kind, copy=False)
    room = [None] * slices if room is None else room[:, : len(queries)]
    return [np.matmul(queries[:, a:b], vectors[:, a:b].T, out=x) for a, b, x in zip(bounds, bounds[1:], room)]


def _floor(scores: np.ndarray, number: int) -> np.ndarray:
    """For every row a limit that its ``number`` best reach, and few others: the best of that many of its strides."""
    n, strides = scores.shape[1], 16 * number
    if n >= 4 * strides:
        scores = scores[:, : n - n % strides].reshape(len(scores), -1, strides).max(axis=1)
    at = scores.shape[1] - number
    return np.partition(scores, at, axis=1)[:, at : at + 1]


def _ranked(q: np.ndarray, score: np.ndarray, *ties: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of hits by query, falling score and rising ties, and their places among those of their query."""
    order = np.lexsort((*ties[::-1], -score, q))
    starts = np.flatnonzero(np.diff(q[order], prepend=-1))
    return order, np.arange(len(q)) - np.repeat(starts, np.diff(starts, append=len(q)))


def gathered(scores: list[np.ndarray], own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Phase 1 on one pair of blocks: the k best sums of vectors seen among the best of a slice, from the largest on, and the smallest local score of each slice, per query.

    ``own`` marks a query's own row, which is no candidate. Where fewer than k candidates
    exist, the missing sums are the smallest number.
    """
    least = np.stack([s.min(axis=1) for s in scores], axis=1).astype(np.int64)
    n = scores[0].shape[1]
    seen = np.flatnonzero(reduce(np.logical_or, (s >= _floor(s, min(n, k + 1)) for s in scores)) & ~own)
    q, total = seen // n, sum(s.ravel()[seen].astype(np.int64) for s in scores)
    order, place = _ranked(q, total)
    order, place = order[place < k], place[place < k]
    sums = np.full((len(own), k), NONE)
    sums[q[order], place] = total[order]
    return sums, least


def collected(scores: list[np.ndarray], own: np.ndarray, cutoff: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Phase 2 on one pair of blocks: the pairs with a local score of the cutoff's share or more."""
    above = np.where(cutoff == NONE, 0, cutoff - least.sum(axis=1))  # with fewer candidates than k all are collected
    share = least - (-above // len(scores))[:, None]
    return reduce(np.logical_or, (s >= share[:, i : i + 1].astype(s.dtype) for i, s in enumerate(scores))) & ~own


def resolved(scores: list[np.ndarray], own: np.ndarray, ids: np.ndarray, cutoff: np.ndarray, least: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Phases 2 and 3 on one pair of blocks: ``(query, places, scores)`` of the k best that can reach the cutoff."""
    exact = scores[0].copy()
    for s in scores[1:]:
        exact += s
    # one known share and the others just below theirs allow the cutoff, so all collected pairs are held against it
    found = np.flatnonzero(collected(scores, own, cutoff, least) & (exact >= cutoff[:, None].astype(exact.dtype)))
    q, at = np.divmod(found, exact.shape[1])
    total = exact.ravel()[found].astype(np.int64)
    order, place = _ranked(q, total, ids[at])
    order = order[place < k]
    q, at, total = q[order], at[order], total[order]
    starts = np.flatnonzero(np.diff(q, prepend=-1))
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(q)]):
        yield int(q[a]), at[a:b], total[a:b]


def grid(candidates: int, queries: int, query_bytes: int, cores: int) -> tuple[int, int]:
    """Parts of the queries and of the candidates, so that their cells take few copies of both.

    Cells hold about ``CELL_PAIRS`` pairs. More are put into one where the copies would
    otherwise outgrow the vectors, as long as every core has cells to work on.
    """
    cells = min(-(-candidates * queries // CELL_PAIRS), max(4 * cores, COPIES * COPIES * candidates // (4 * max(queries, 1))))
    of_queries = max(round((cells * queries / max(candidates, 1)) ** 0.5), -(-query_bytes // HELD_BYTES), 1)
    return of_queries, max(1, -(-cells // of_queries))


def _cells(candidates: DataFrame, queries: DataFrame, parts: tuple[int, int]) -> DataFrame:
    """The blocks of every cell, those of its queries first."""

    def every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def dealt(n: int):
        return F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")

    extra = {c: F.lit(None).cast("array<bigint>") for c in ("cutoff", "least")}
    rows = ["dim", "q_part", "c_part", "found", "ids", "rows", "vectors", "cutoff", "least"]
    asked = queries.withColumns({c: x for c, x in extra.items() if c not in queries.columns})
    asked = asked.withColumns({"q_part": dealt(parts[0]), "found": F.lit(False)}).withColumn("c_part", every(parts[1]))
    placed = candidates.withColumns(extra | {"c_part": dealt(parts[1]), "found": F.lit(True)}).withColumn("q_part", every(parts[0]))
    both = asked.select(rows).unionByName(placed.select(rows))
    return both.repartition(2 * parts[0] * parts[1], "dim", "q_part", "c_part").sortWithinPartitions("dim", "q_part", "c_part", "found")


def _compared(batches: Iterator[pa.RecordBatch], slices: int) -> Iterator[tuple[dict[str, np.ndarray], Iterator[tuple]]]:
    """For every cell its queries and, block by block, ``(some of the queries, local scores, own, ids, rows)``."""
    lines = (batch.slice(i, 1).to_pylist()[0] for batch in batches for i in range(batch.num_rows))
    for _, cell in groupby(lines, lambda x: (x["dim"], x["q_part"], x["c_part"])):
        asked, first = [], None
        for row in cell:
            if row["found"]:
                first = row
                break
            asked.append((*_parse(row), row["cutoff"] or [], row["least"] or []))
        if asked and first is not None:
            ids, rows, vectors, cutoff, least = (np.concatenate(x) for x in zip(*asked))
            held = {"ids": ids, "rows": rows, "vectors": vectors, "cutoff": cutoff.astype(np.int64), "least": least.astype(np.int64).reshape(-1, slices)}
            yield held, _block_scores(held, chain([first], cell), slices)


def _block_scores(held: dict[str, np.ndarray], found: Iterator[dict], slices: int) -> Iterator[tuple]:
    """Scores stay valid up to the next ones."""
    reach, room = _reach(held["vectors"]), None
    for row in found:
        ids, rows, vectors = _parse(row)
        kind = _exact_type(reach * _reach(vectors), slices)
        vectors = vectors.astype(kind)
        if room is None or room.dtype != kind or room.shape[2] != len(ids):
            room = np.empty((slices, _AT_ONCE, len(ids)), kind)
        for start in range(0, len(held["ids"]), _AT_ONCE):
            some = slice(start, start + _AT_ONCE)
            mine = held["rows"][some]
            own = np.zeros((len(mine), len(rows)), bool)
            at = np.minimum(np.searchsorted(rows, mine), len(rows) - 1)  # a block's rows are in order
            own[np.arange(len(mine)), at] = rows[at] == mine
            yield some, local_scores(held["vectors"][some], vectors, slices, kind, room), own, ids, rows


def cutoffs(cells: DataFrame, k: int, slices: int) -> DataFrame:
    """``q, cutoff, least``: the safe cutoff and the smallest local scores of every query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, compared in _compared(batches, slices):
            n = len(held["ids"])
            best, smallest = np.full((n, k), NONE), np.full((n, slices), np.iinfo(np.int64).max)
            for some, scores, own, _, _ in compared:
                sums, least = gathered(scores, own, k)
                best[some] = np.sort(np.concatenate([best[some], sums], axis=1), axis=1)[:, -k:]
                smallest[some] = np.minimum(smallest[some], least)
            for start in range(0, n, _HELD):
                some = slice(start, start + _HELD)
                lists = [pa.array(list(x[some]), pa.list_(pa.int64())) for x in (best, smallest)]
                yield pa.RecordBatch.from_arrays([pa.array(held["rows"][some]), *lists], names=["q", "bounds", "least"])

    rows = cells.mapInArrow(run, "q bigint, bounds array<bigint>, least array<bigint>")
    least = [F.min(F.col("least")[i]).alias(f"l{i}") for i in range(slices)]
    merged = rows.groupBy("q").agg(F.flatten(F.collect_list("bounds")).alias("bounds"), *least)
    return merged.select("q", F.get(F.sort_array("bounds", asc=False), F.lit(k - 1)).alias("cutoff"), F.array(*[f"l{i}" for i in range(slices)]).alias("least"))


def _with_cutoffs(queries: DataFrame, found: DataFrame) -> DataFrame:
    """Query blocks with the cutoffs of their rows beside them."""
    placed = queries.select("block", F.posexplode("rows").alias("at", "q"))
    # blocks are estimated far too small, as they are packed and as they have many rows: no side is for the driver to send
    lists = placed.join(found.hint("merge"), "q").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("at", "cutoff", "least"))).alias("cut"))  # a block's rows
    return queries.join(lists.hint("merge"), "block").withColumns({"cutoff": F.col("cut.cutoff"), "least": F.flatten("cut.least")}).drop("cut")


def _best(hits: list[tuple[np.ndarray, ...]], k: int) -> list[tuple[np.ndarray, ...]]:
    """The k best hits ``(query, score, id, row)`` of every query."""
    q, score, ids, rows = (np.concatenate(x) for x in zip(*hits))
    order, place = _ranked(q, score, ids, rows)
    order = order[place < k]
    return [(q[order], score[order], ids[order], rows[order])]


def search(vectors: DataFrame, every: int = EVERY, k: int = K, slices: int = SLICES) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k best of every row whose id is divisible by ``every``."""
    candidates = scratch_table(blocks(vectors), "vector-blocks")
    queries = scratch_table(query_blocks(candidates, every), "query-blocks")
    number = F.coalesce(F.sum(F.size("rows")), F.lit(0))
    n_queries, size = queries.agg(number, F.coalesce(F.sum(F.octet_length("vectors") + 128 * F.size("rows")), F.lit(0))).first()
    parts = grid(candidates.agg(number).first()[0], n_queries, size, vectors.sparkSession.sparkContext.defaultParallelism)
    found = scratch_table(cutoffs(_cells(candidates, queries, parts), k, slices), "cutoffs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, compared in _compared(batches, slices):
            hits, n, most = [], 0, _HELD
            for some, scores, own, ids, rows in compared:
                for q, places, values in resolved(scores, own, ids, held["cutoff"][some], held["least"][some], k):
                    hits.append((np.full(len(places), some.start + q), values, ids[places], rows[places]))
                    n += len(places)
                if n > most:
                    hits = _best(hits, k)
                    n = len(hits[0][0])
                    most = _HELD + 2 * n
            if hits:
                q, score, ids, rows = _best(hits, k)[0]
                columns = [held["rows"][q], held["ids"][q], ids, rows, score]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["q", "query_id", "vec_id", "row", "score"])

    asked = scratch_table(_with_cutoffs(queries, found), "asked")
    hits = _cells(candidates, asked, parts).mapInArrow(run, "q bigint, query_id bigint, vec_id bigint, row bigint, score bigint")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id", "row")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, folder: str) -> DataFrame:
    return search(Tables(spark, folder).embeddings)
