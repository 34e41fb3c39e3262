"""Jaccard join of word shingles: groups of documents that links of high similarity connect.

1. Every text becomes the set of its shingles, as 64-bit hashes. Documents with the same
   set form a class; from here on a class counts once.
2. Two sets of Jaccard similarity t share a shingle among the first ``n - ceil(t n) + 1``
   of each, in any order that all sets follow. The order used is by hash, with shingles
   seen to be frequent at the end, so shared passages rarely come first. Which shingles
   are called frequent only affects speed; their number is bounded by ``FREQUENT``.
3. Classes that share a leading shingle are candidates. For a frequent shingle all its
   classes are tied to the smallest one. For the others a signature tree over the
   classes of the shingle drops what can't overlap enough.
4. Connected candidates form blocks. In a block a signature tree with exact comparison
   of the sets finds the groups. Blocks of more than ``CHUNK`` classes are cut in chunks;
   after the groups inside chunks, representatives of all groups are compared, then all
   pairs of chunks of those blocks that are still in several groups. No pair that could
   link two groups is left out.

Links are needed only as far as they connect, so a comparison is skipped when its two
sets are connected already. Sets are compared by 64-bit hashes; classes are told apart
by 128 bits, and should two classes ever share the first 64, all is done anew with
another seed.

Defined results: words are split at white space, A-Z counts as a-z; a text of fewer words
than a shingle is one shingle of its own kind; null texts and texts without words have
no shingles and stay alone; repeated rows are in one group; a group's name is the
smallest document id in it (null ids count last).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from marketlens.llm import signature_tree as trees
from marketlens.llm.graphs import components
from marketlens.operators.scratch import scratch_table
from marketlens.tables import Tables

PERCENT, SHINGLE = 85, 4
#: What counts as near copies when one document of a group is kept.
COPIES_PERCENT, COPIES_SHINGLE = 80, 5
#: Shingles that may be called frequent: 8 bytes each for every worker.
FREQUENT = 1 << 18
#: A shingle is reported as frequent by a stretch of some million shingles that holds it so often.
OFTEN, STRETCH = 4, 1 << 22
#: Classes compared in one task, and classes tied by a tree under one shingle.
CHUNK = 4096
#: Shingles held by one task of a block, which also limits its classes.
ELEMENTS = 1 << 22
#: Document ids that may be broadcast to choose the texts to read again.
SMALL = 500_000
REMEMBERED = 400_000

_STEP = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit values, one for one."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Shingle sets of texts, with a bounded table of word hashes."""

    def __init__(self, size: int = SHINGLE, seed: int = 0):
        self.size, self.seed = size, seed
        self.known: dict[bytes, int] = {}

    def _word(self, word: bytes) -> int:
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        found = self.known[word] = xxhash.xxh64_intdigest(word, self.seed) or 1
        return found

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted hashes of the different shingles of a text."""
        words = (text or "").encode().lower().split()
        k = self.size
        if not words:
            return np.empty(0, np.uint64)
        if len(words) < k:
            return np.array([xxhash.xxh64_intdigest(b" ".join(words), self.seed + 1_000_003)], np.uint64)
        get, new = self.known.get, self._word
        values = np.array([get(w) or new(w) for w in words], np.uint64)
        n = len(values) - k + 1
        rolled = values[:n]
        for j in range(1, k):
            rolled = _mixed(rolled) * _STEP[(j - 1) % 3] + values[j : j + n]
        return np.unique(_mixed(rolled))


def class_of(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set, as two signed 64-bit numbers."""
    whole = xxhash.xxh128_intdigest(shingles.tobytes())
    low, high = whole & (1 << 64) - 1, whole >> 64
    return low - (1 << 64) if low >> 63 else low, high - (1 << 64) if high >> 63 else high


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def bitmap_of(shingles: np.ndarray) -> bytes:
    width = trees.width_of(len(shingles))
    bits = np.zeros(width, bool)
    bits[(shingles >> np.uint64(20)) & np.uint64(width - 1)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exact test of two sorted sets."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * shared >= percent * (len(both) - shared)


def _batch(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def sets(docs: DataFrame, shingle: int, seed: int) -> DataFrame:
    """``doc_id, text_hash, n, id, check``, and rows without them whose ``often`` holds frequent shingles and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, heap, held = Shingler(shingle, seed), [], 0
        seen: set[int] = set()

        def reported() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(heap), return_counts=True)
            often = counts >= OFTEN
            rows = [{"s": int(s), "c": int(c)} for s, c in zip(values[often].view(np.int64), counts[often])]
            return _batch({"doc_id": pa.array([None], pa.int64()), "text_hash": pa.array([None], pa.int64()), "n": pa.array([None], pa.int64()), "id": pa.array([None], pa.int64()), "check": pa.array([None], pa.int64()),
                           "often": pa.array([rows], pa.list_(pa.struct([("s", pa.int64()), ("c", pa.int64())])))})

        for batch in batches:
            ns, names, checks = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingles(text)
                low, high = class_of(s) if len(s) else (None, None)
                ns.append(len(s))
                names.append(low)
                checks.append(high)
                if len(s) and low not in seen:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(low)
                    heap.append(s)
                    held += len(s)
                    if held >= STRETCH:
                        yield reported()
                        heap, held = [], 0
            empty = pa.array([None] * len(ns), pa.list_(pa.struct([("s", pa.int64()), ("c", pa.int64())])))
            yield _batch({"doc_id": batch.column(0), "text_hash": batch.column(2), "n": pa.array(ns, pa.int64()), "id": pa.array(names, pa.int64()), "check": pa.array(checks, pa.int64()), "often": empty})
        if heap:
            yield reported()

    return docs.mapInArrow(run, "doc_id bigint, text_hash bigint, n bigint, id bigint, check bigint, often array<struct<s:bigint,c:bigint>>")


def leading(docs: DataFrame, frequent: np.ndarray, percent: int, shingle: int, seed: int) -> DataFrame:
    """Per class and task: ``id, n, rare, frequent, bitmap``: its leading shingles of both kinds."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, seen, hot = Shingler(shingle, seed), set(), shared.value
        for batch in batches:
            rows = {"id": [], "n": [], "rare": [], "frequent": [], "bitmap": []}
            for text in batch.column(0).to_pylist():
                s = shingles(text)
                name = class_of(s)[0] if len(s) else None
                if name is None or name in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(name)
                length = prefix_length(len(s), percent)
                often = np.zeros(len(s), bool)
                if len(hot):
                    often = hot[np.minimum(np.searchsorted(hot, s), len(hot) - 1)] == s
                rare = s[~often][:length]
                rows["id"].append(name)
                rows["n"].append(len(s))
                rows["rare"].append(rare.view(np.int64))
                rows["frequent"].append(s[often][: length - len(rare)].view(np.int64))
                rows["bitmap"].append(bitmap_of(s))
            kinds = {"id": pa.int64(), "n": pa.int64(), "rare": pa.list_(pa.int64()), "frequent": pa.list_(pa.int64()), "bitmap": pa.binary()}
            yield _batch({k: pa.array(v, kinds[k]) for k, v in rows.items()})

    return docs.select("text").mapInArrow(run, "id bigint, n bigint, rare array<bigint>, frequent array<bigint>, bitmap binary")


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pd.DataFrame, bool]]:
    """Rows of one key after another, from batches in which equal keys follow each other.

    A run of more than CHUNK rows comes in parts that all begin with its first row and are marked as long.
    """
    rest, long = None, False
    for batch in batches:
        frame = batch.to_pandas()
        if rest is not None:
            frame = pd.concat([rest, frame], ignore_index=True)
        if not len(frame):
            continue
        keys = frame[key].to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1)]
        for a, b in zip(cuts, cuts[1:]):
            yield frame.iloc[a:b], long
            long = False
        rest = frame.iloc[cuts[-1] :]
        if len(rest) > CHUNK:
            yield rest, True
            rest, long = rest.iloc[:1], True
    if rest is not None and len(rest):
        yield rest, long


def shared_shingles(postings: DataFrame, percent: int) -> DataFrame:
    """Rows with another class of the same shingle and of a size that allows the similarity.

    Rows (shingle, n, id) come in that order, so if any class has a fitting size, a
    neighbouring row has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: pa.RecordBatch | None = None  # the last row, whose next neighbour is not known yet
        told = False  # it was returned already, for its neighbour before
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = batch if waiting is None else pa.Table.from_batches([waiting, batch]).combine_chunks().to_batches()[0]
            shingle, size, name = (whole.column(i).to_numpy() for i in range(3))
            fits = (shingle[1:] == shingle[:-1]) & (name[1:] != name[:-1]) & (100 * size[:-1] >= percent * size[1:])
            keep = np.append(False, fits) | np.append(fits, False)
            told_now = bool(keep[-1]) and (len(name) > 1 or told)
            if told and waiting is not None:
                keep[0] = False
            out = whole.filter(pa.array(keep))
            waiting, told = whole.slice(len(name) - 1, 1), told_now
            if out.num_rows:
                yield out

    return postings.mapInArrow(run, postings.schema)


def tied(members: DataFrame, percent: int) -> DataFrame:
    """Candidate links ``a, b`` among the classes of one shingle, as far as they connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[int] = []
        b: list[int] = []
        for frame, long in runs(batches, "shingle"):
            ids, ns, maps = frame["id"].tolist(), frame["n"].tolist(), frame["bitmap"].tolist()
            if long:  # too many for one tree: all are tied to the first
                a += [ids[0]] * (len(ids) - 1)
                b += ids[1:]
            else:
                rows = {i: (n, m) for i, n, m in zip(ids, ns, maps)}
                names = list(rows)
                if len(names) > 1:
                    found = trees.connect([rows[i][0] for i in names], [int.from_bytes(rows[i][1], "little") for i in names], percent)
                    for i, j in found.links:
                        a.append(names[i])
                        b.append(names[j])
            if len(a) >= 50_000:
                yield _batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
                a, b = [], []
        yield _batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return members.mapInArrow(run, "a bigint, b bigint")


def candidate_blocks(lead: DataFrame, percent: int) -> DataFrame:
    """``id, block``: connected candidates."""
    often = lead.select("id", F.explode("frequent").alias("shingle"))
    least = often.groupBy("shingle").agg(F.min("id").alias("a"))  # at most FREQUENT rows
    links = often.join(F.broadcast(least), "shingle").filter("id <> a").select("a", F.col("id").alias("b"))
    rare = lead.select(F.explode("rare").alias("shingle"), "n", "id").repartition("shingle").sortWithinPartitions("shingle", "n", "id")
    shared = scratch_table(shared_shingles(rare, percent).select("shingle", "id"), "shared-shingles")
    known = lead.groupBy("id").agg(F.first("n").alias("n"), F.first("bitmap").alias("bitmap"))
    members = shared.join(known, "id").select("shingle", "id", "n", "bitmap")
    links = links.union(tied(members.repartition("shingle").sortWithinPartitions("shingle", "id"), percent))
    return components(links.distinct()).select("id", F.col("label").alias("block"))


def block_sets(docs: DataFrame, chosen: DataFrame, shingle: int, seed: int) -> DataFrame:
    """``block, part, id, n, bitmap, elements`` of the classes in ``chosen`` (doc_id, id, block, part), read again from the texts."""
    few = chosen.count() <= SMALL
    right = chosen.select(F.col("doc_id").alias("_doc"), "id", "block", "part")
    rows = docs.select("doc_id", "text").join(F.broadcast(right) if few else right, F.col("doc_id").eqNullSafe(F.col("_doc"))).select("text", "id", "block", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(shingle, seed)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                some = batch.slice(start, 1000)
                keep, ns, maps, whole = [], [], [], []
                for at, (text, name) in enumerate(zip(some.column(0).to_pylist(), some.column(1).to_pylist())):
                    s = shingles(text)
                    if len(s) and class_of(s)[0] == name:  # an id that several texts share
                        keep.append(at)
                        ns.append(len(s))
                        maps.append(bitmap_of(s))
                        whole.append(s.tobytes())
                took = some.take(pa.array(keep, pa.int64()))
                yield _batch({"block": took.column(2), "part": took.column(3), "id": took.column(1), "n": pa.array(ns, pa.int64()), "bitmap": pa.array(maps, pa.binary()), "elements": pa.array(whole, pa.binary())})

    return rows.mapInArrow(run, "block bigint, part int, id bigint, n bigint, bitmap binary, elements binary")


def compared(rows: DataFrame, percent: int, keys: list[str]) -> DataFrame:
    """``id, label`` of the rows of every task group; ``label`` of the input, where it has one, says what is connected already."""
    has_label = "label" in rows.columns
    names = ["id", *(["label"] if has_label else []), "n", "bitmap", "elements"]
    spread = rows.select(*keys, *names).repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        now = None

        def solved() -> pa.RecordBatch:
            items = list(held)
            sizes = [held[i][1] for i in items]
            parsed = [np.frombuffer(held[i][3], np.uint64) for i in items]
            forest = trees.Forest(len(items))
            if has_label:
                first: dict[int, int] = {}
                for at, i in enumerate(items):
                    forest.join(at, first.setdefault(held[i][0], at))
            trees.connect(sizes, [int.from_bytes(held[i][2], "little") for i in items], percent, lambda i, j: similar(parsed[i], parsed[j], percent), forest)
            least: dict[int, int] = {}
            for at, i in enumerate(items):
                root = forest.find(at)
                value = held[i][0] if has_label else i
                least[root] = min(least.get(root, value), value)
            return _batch({"id": pa.array([held[i][0] if has_label else i for i in items], pa.int64()), "label": pa.array([least[forest.find(at)] for at in range(len(items))], pa.int64())})

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*keys, *names)]
            for row in zip(*columns):
                key, rest = row[: len(keys)], row[len(keys) :]
                if key != now:
                    if held:
                        yield solved()
                    held, now = {}, key
                held[rest[0]] = rest[1:] if has_label else (None, *rest[1:])
        if held:
            yield solved()

    return spread.mapInArrow(run, "id bigint, label bigint")


def groups(docs: DataFrame, chosen: DataFrame, percent: int, shingle: int, seed: int) -> DataFrame:
    """``id, label`` for all classes in blocks; equal labels are connected by exact links."""
    whole = block_sets(docs, chosen, shingle, seed)
    parts = chosen.agg(F.max("part")).first()[0]
    if not parts:
        return scratch_table(compared(whole, percent, ["block"]).distinct(), "groups")
    whole = scratch_table(whole, "block-sets")
    labels = scratch_table(compared(whole, percent, ["block", "part"]).distinct(), "groups")
    cut = whole.join(chosen.filter("part > 0").select("block").distinct(), "block", "left_semi")
    for crossing in (False, True):
        now = cut.join(labels, "id")
        split = now.groupBy("block").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x < y").select("block")
        open_rows = now.join(split, "block", "left_semi")
        if not crossing:  # representatives of all groups, in tasks of bounded size
            picked = open_rows.filter("id = label")
            tasks = picked.withColumn("part", F.pmod(F.xxhash64("label"), F.lit(16)).cast("int"))
            found = compared(tasks, percent, ["block", "part"])
        else:  # every pair of parts
            counts = open_rows.groupBy("block").agg((F.max("part") + 1).alias("parts"))
            pairs = open_rows.join(counts, "block").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            pairs = pairs.withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")})
            found = compared(pairs.drop("part"), percent, ["block", "low", "high"])
        merged = components(found.select(F.col("id").alias("a"), F.col("label").alias("b")).distinct()).select(F.col("id").alias("label"), F.col("label").alias("_to"))
        labels = scratch_table(labels.join(merged, "label", "left").select("id", F.coalesce("_to", "label").alias("label")), "groups")
    return labels


def link(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, text_hash, n_shingles, component_id`` for every row of ``docs`` (doc_id, text)."""
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    for seed in range(8):
        first = scratch_table(sets(source, shingle, seed), "shingle-sets")
        rows = first.filter("n IS NOT NULL").select("doc_id", "text_hash", "n", "id", "check")
        classes = scratch_table(rows.filter("n > 0").groupBy("id").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.min("check").alias("x"), F.max("check").alias("y")), "classes")
        if classes.filter("x <> y").isEmpty():
            break
    else:
        raise RuntimeError("class names clash under every seed")
    often = first.filter("often IS NOT NULL").select(F.explode("often").alias("o")).groupBy("o.s").agg(F.sum("o.c").alias("c"))
    frequent = np.array(sorted(np.int64(r.s).view(np.uint64) for r in often.orderBy(F.desc("c"), "s").limit(FREQUENT).collect()), np.uint64)
    lead = scratch_table(leading(source, frequent, percent, shingle, seed), "leading")
    blocks = candidate_blocks(lead, percent)
    members = blocks.join(classes, "id")
    sized = members.groupBy("block").agg(F.ceil(F.greatest(F.count(F.lit(1)) / CHUNK, F.sum("n") / ELEMENTS)).cast("int").alias("parts"))
    chosen = members.join(sized, "block")
    chosen = scratch_table(chosen.select("doc_id", "id", "block", F.expr("cast(pmod(xxhash64(id), parts) AS int)").alias("part")), "blocks")
    labels = groups(source, chosen, percent, shingle, seed)
    named = classes.join(labels, "id", "left").select("id", "doc_id", F.coalesce("label", "id").alias("label"))
    least = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    of_class = scratch_table(named.join(least, "label").select("id", "component_id"), "components")
    columns = ["doc_id", "text_hash", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")]
    alone = rows.filter("n = 0").withColumn("component_id", F.col("doc_id"))
    return rows.filter("n > 0").join(of_class, "id").select(*columns).union(alone.select(*columns))


def one_of_group(docs: DataFrame, percent: int = COPIES_PERCENT, shingle: int = COPIES_SHINGLE) -> DataFrame:
    """The rows of ``docs`` without those that are linked to a document with a smaller id.

    Of rows with the same id and text one stays. Rows without an id stay if their group
    has no row with one, one for each text.
    """
    rows = scratch_table(link(docs, percent, shingle), "linked")
    same = [F.col("doc_id").cast("bigint").eqNullSafe(F.col("_id")), F.xxhash64("text") == F.col("_hash")]
    gone = rows.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    stay = docs.select(F.struct("*").alias("_row"), "doc_id", "text").join(gone, same, "left_anti")
    several = scratch_table(rows.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "repeated")
    if several.isEmpty():
        return stay.select("_row.*")
    once = stay.join(several, same, "left_semi").withColumn("_hash", F.xxhash64("text")).dropDuplicates(["doc_id", "_hash"]).drop("_hash")
    return stay.join(several, same, "left_anti").unionByName(once).select("_row.*")


def query(spark: SparkSession, folder: str) -> DataFrame:
    return link(Tables(spark, folder).documents).select("doc_id", "n_shingles", "component_id")
