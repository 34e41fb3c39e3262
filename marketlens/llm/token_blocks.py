"""Token files in patched frame-of-reference blocks.

A file set holds shards, one per range of document ids; a shard holds pages of whole
documents; a page holds blocks of ``BLOCK`` ids. A block subtracts its smallest id, packs
the low bits of all ids at one width, and keeps what sticks out in a list of exceptions
(place and high bits). The width is the bit length at one of ``PERCENTILES`` of the
block, the one that makes the block smallest. Every page has an index of the places where
its blocks start, and the ids and lengths of its documents.

Layout of a block, little-endian: number of ids (2 bytes), width (1), number of exceptions
(2), smallest id (4), packed bits (low bit first), exception places (2 each), their high
bits (4 each). Pages are rows of Parquet files, so they are written and committed by
Spark on any storage, and a lost task is simply done again.

Documents are laid down in ascending order of id (null ids first, equal ids by a hash of
the text). Texts become ids by the tokenizers library; words are encoded once and
remembered in a table of bounded size.

Defined results: a null text counts as empty; the end id follows every document, so each
has at least one id; repeated rows are documents of their own; an empty table gives an
empty file set.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from marketlens.llm.bpe import WordCoder, _little, byte_letters, default_path
from marketlens.operators.scratch import scratch_path
from marketlens.tables import Tables

BLOCK, PAGE = 512, 1 << 16
PERCENTILES = (50, 75, 90, 95, 99, 100)
END = 0
_HEAD = struct.Struct("<HBHI")
_PAGE_SCHEMA = "shard int, page int, doc_ids array<bigint>, n_tokens array<bigint>, n_ids bigint, block_starts binary, payload binary"


def _packed(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of bytes with the low ``width`` bits of every value."""
    if not width:
        return np.zeros((len(values), 0), np.uint8)
    size = 2 if width <= 16 else 4
    bits = np.unpackbits(values.astype(f"<u{size}").view(np.uint8).reshape(*values.shape, size), axis=2, bitorder="little")
    return np.packbits(bits[:, :, :width].reshape(len(values), -1), axis=1, bitorder="little")


def _unpacked(rows: np.ndarray, width: int, n: int) -> np.ndarray:
    if not width:
        return np.zeros((len(rows), n), np.uint32)
    bits = np.unpackbits(rows, axis=1, count=n * width, bitorder="little").reshape(len(rows), n, width)
    size = 2 if width <= 16 else 4
    whole = np.zeros((len(rows), n, 8 * size), np.uint8)
    whole[:, :, :width] = bits
    return np.packbits(whole, axis=2, bitorder="little").view(f"<u{size}").reshape(len(rows), n).astype(np.uint32)


_LENGTHS = np.frexp(np.arange(1 << 16).astype(float))[1].astype(np.uint8)


def _bit_lengths(values: np.ndarray) -> np.ndarray:
    """Bits of every value, by a table of 16-bit numbers."""
    if not len(values) or values.max() < 1 << 16:
        return _LENGTHS[values]
    high = values >> np.uint32(16)
    return np.where(high > 0, _LENGTHS[high] + np.uint8(16), _LENGTHS[values & np.uint32(0xFFFF)])


def _encoded_rows(ids: np.ndarray) -> list[bytes]:
    """Blocks of equal length, one per row."""
    count, n = ids.shape
    least = ids.min(axis=1)
    rest = (ids - least[:, None]).astype(np.uint32)
    lengths = _bit_lengths(rest)
    ranked = np.sort(lengths, axis=1)
    places = [-(-n * p // 100) - 1 for p in PERCENTILES]
    widths = ranked[:, places].astype(np.int64)
    exceptions = np.stack([(lengths > widths[:, i : i + 1]).sum(axis=1) for i in range(len(places))], axis=1)
    best = np.argmin(n * widths + 48 * exceptions, axis=1)
    width = widths[np.arange(count), best]
    out: list[bytes] = [b""] * count
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        packed = _packed(rest[at], w)
        beyond = lengths[at] > w
        for row, i in enumerate(at.tolist()):
            odd = np.flatnonzero(beyond[row])
            head = _HEAD.pack(n, w, len(odd), int(least[i]))
            out[i] = head + packed[row].tobytes() + odd.astype("<u2").tobytes() + (rest[i, odd] >> np.uint32(w)).astype("<u4").tobytes()
    return out


def encode_blocks(ids: np.ndarray, block: int = BLOCK) -> tuple[bytes, bytes]:
    """Index of block starts (unsigned 32-bit numbers) and payload."""
    whole = len(ids) // block * block
    pieces = _encoded_rows(ids[:whole].reshape(-1, block)) if whole else []
    if len(ids) > whole:
        pieces += _encoded_rows(ids[whole:].reshape(1, -1))
    starts = np.cumsum([0, *map(len, pieces)])[:-1]
    return starts.astype("<u4").tobytes(), b"".join(pieces)


def decode_blocks(starts: bytes, payload: bytes) -> np.ndarray:
    """All ids of a page."""
    places = np.frombuffer(starts, "<u4").tolist()
    groups: dict[tuple[int, int], list[int]] = {}
    heads = []
    for i, place in enumerate(places):
        heads.append(_HEAD.unpack_from(payload, place))
        groups.setdefault(heads[-1][:2], []).append(i)
    out: list[np.ndarray | None] = [None] * len(places)
    data = np.frombuffer(payload, np.uint8)
    for (n, width), members in groups.items():
        size = -(-n * width // 8)
        first = np.array([places[i] + _HEAD.size for i in members])
        values = _unpacked(data[first[:, None] + np.arange(size)], width, n)
        for row, i in zip(values, members):
            odd, at = heads[i][2], places[i] + _HEAD.size + size
            if odd:
                where = np.frombuffer(payload, "<u2", odd, at)
                row[where] |= np.frombuffer(payload, "<u4", odd, at + 2 * odd) << np.uint32(width)
            out[i] = row + np.uint32(heads[i][3])
    return np.concatenate(out) if out else np.empty(0, np.uint32)


#: White space beside a space, or at an end of the text: its spaces don't all begin a word.
_UNEVEN = r"\A{0}|{0}\z|{0} | {0}".format(r"[\t-\r\x1c-\x20\x{85}\pZ]")
#: Marks that form one word when they follow letters; an apostrophe may begin a word with letters.
_TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Bytes of text that are taken apart at once.
_SLICE = 8 << 20


def _refuse_unsupported(spec: str) -> None:
    """Only plain byte-level files give the same ids word by word as for whole texts."""
    file = json.loads(spec)
    first = file["pre_tokenizer"] or {}
    if file["normalizer"] or first.get("type") != "ByteLevel" or first.get("add_prefix_space") or not first.get("use_regex", True):
        raise ValueError("only byte-level files without normalizer and prefix space are supported")
    if any(token["lstrip"] or token["rstrip"] or token["single_word"] for token in file["added_tokens"]):
        raise ValueError("added tokens that take white space with them are not supported")


class LibraryCoder(WordCoder):
    """Ids by the tokenizers library, word by word."""

    def __init__(self, spec: str, remembered: int = 800_000):
        from tokenizers import Tokenizer

        _refuse_unsupported(spec)
        tokenizer = Tokenizer.from_str(spec)
        super().__init__({t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}, remembered)
        self.model = tokenizer.model
        self.letters = str.maketrans({chr(b): c for c, b in byte_letters().items()})

    def word_ids(self, word: bytes) -> list[int]:
        return [t.id for t in self.model.tokenize(word.decode("latin-1").translate(self.letters))]

    def _piece(self, table: dict[str, bytes], key: str, text: str) -> bytes:
        words = [text] if key.isalpha() else _plain_words(text)
        if words is None:
            return super()._piece(table, key, text)
        if len(words) == 1:
            letters = self.letters[32] + key if key.isascii() and key != text else text.encode().decode("latin-1").translate(self.letters)
            found = _little([t.id for t in self.model.tokenize(letters)])
        else:
            first, spaced, piece, found = self.first, self.spaced, self._piece, b""
            for w in words:
                if w[0] == " ":
                    found += spaced.get(w[1:]) or piece(spaced, w[1:], w)
                else:
                    found += first.get(w) or piece(first, w, w)
        if len(table) >= self.remembered:
            table.clear()
        table[key] = found
        return found

    def encode_column(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of every text of a column.

        Texts whose spaces all begin a word are cut there by Arrow, each distinct piece
        is looked up once, and the ids are gathered in numpy. The others go one by one.
        """
        texts = pc.fill_null(texts, "")
        easy = pc.and_(pc.greater(pc.binary_length(texts), 0), pc.invert(pc.match_substring_regex(texts, _UNEVEN)))
        for mark in self.specials:
            easy = pc.and_(easy, pc.invert(pc.match_substring(texts, mark)))
        found: list[np.ndarray | None] = [None] * len(texts)
        for i in np.flatnonzero(~easy.to_numpy(zero_copy_only=False)).tolist():
            found[i] = np.frombuffer(self.encode(texts[i].as_py()), "<u4")
        places = np.flatnonzero(easy.to_numpy(zero_copy_only=False))
        for i, ids in zip(places.tolist(), self._gathered(texts.take(pa.array(places)))):
            found[i] = ids
        return found

    def _gathered(self, texts: pa.Array) -> list[np.ndarray]:
        if not len(texts):
            return []
        cut = pc.split_pattern(texts, " ")
        starts = cut.offsets.to_numpy()[:-1] - cut.offsets[0].as_py()
        pieces = cut.flatten().dictionary_encode()
        codes = pieces.indices.to_numpy().astype(np.int64)
        heads = _strings(pieces.dictionary.take(pieces.indices.take(pa.array(starts))))
        size = len(pieces.dictionary)
        codes[starts] = size + np.arange(len(starts))  # the first piece of a text has no space before it
        used = np.zeros(size, bool)
        used[codes[codes < size]] = True
        first, spaced, piece = self.first, self.spaced, self._piece
        table = [b""] * size
        at = np.flatnonzero(used)
        for i, w in zip(at.tolist(), _strings(pieces.dictionary.take(pa.array(at)))):
            table[i] = spaced.get(w) or piece(spaced, w, " " + w)
        table += [first.get(w) or piece(first, w, w) for w in heads]
        flat = np.frombuffer(b"".join(table), "<u4")
        lengths = np.fromiter(map(len, table), np.int64, len(table)) // 4
        begins = np.cumsum(lengths) - lengths
        taken = lengths[codes]
        ends = np.cumsum(taken)
        ids = flat[np.repeat(begins[codes] - ends + taken, taken) + np.arange(ends[-1])]
        return np.split(ids, (ends - taken)[starts[1:]])


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


def _plain_words(text: str) -> list[str] | None:
    """Words of a piece made of letters with marks after them, line by line; None for any other piece."""
    words: list[str] = []
    for i, line in enumerate(text.split("\n")):
        stem = line.rstrip(_TAIL)
        if not (stem[1:] if not i and stem[:1] == " " else stem).isalpha():
            return None
        if i:
            words.append("\n")
        words.append(stem)
        if len(stem) < len(line):
            words.append(line[len(stem) :])
    return words


def _slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``_SLICE`` bytes of text."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(sizes):
        before = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, before + _SLICE, "right")))
        yield start, stop
        start = stop


_coders: dict[int, LibraryCoder] = {}


def _coder(shared) -> LibraryCoder:
    key = hash(shared.value)
    if key not in _coders:
        _coders.clear()
        _coders[key] = LibraryCoder(shared.value)
    return _coders[key]


def pages(docs: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """Pages of the documents (doc_id, text), shards in ascending order of id."""
    with open(tokenizer, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())  # a vocabulary file
    keys = [F.col("doc_id"), F.xxhash64("text")]
    ordered = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").repartitionByRange(*keys).sortWithinPartitions(*keys)
    mark = np.array([end], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard, page = _coder(shared), TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        names: list[int | None] = []
        sizes: list[int] = []
        held = 0

        def closed() -> pa.RecordBatch:
            values = np.concatenate(ids)
            starts, payload = encode_blocks(values)
            columns = [
                pa.array([shard], pa.int32()), pa.array([page], pa.int32()), pa.array([names], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())),
                pa.array([len(values)], pa.int64()), pa.array([starts], pa.binary()), pa.array([payload], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["shard", "page", "doc_ids", "n_tokens", "n_ids", "block_starts", "payload"])

        for batch in batches:
            for start, stop in _slices(batch.column(1)):
                some = batch.slice(start, stop - start)
                for name, found in zip(some.column(0).to_pylist(), coder.encode_column(some.column(1))):
                    ids += [found, mark]
                    names.append(name)
                    sizes.append(len(found) + 1)
                    held += sizes[-1]
                    if held >= PAGE:
                        yield closed()
                        ids, names, sizes, held, page = [], [], [], 0, page + 1
        if ids:
            yield closed()

    return ordered.mapInArrow(run, _PAGE_SCHEMA)


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end: int = END) -> None:
    """Writes the token file set of the documents."""
    pages(docs, tokenizer or default_path(), end).write.option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` and, if wanted, ``ids`` (little-endian) of every document of a file set."""
    stored = spark.read.schema(_PAGE_SCHEMA).parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                values = decode_blocks(row["block_starts"], row["payload"])
                ends = np.cumsum(row["n_tokens"])
                parts = [x.astype("<u4").tobytes() for x in np.split(values, ends[:-1])]
                n = len(parts)
                columns = [
                    pa.array([row["shard"]] * n, pa.int32()), pa.array([row["page"]] * n, pa.int32()), pa.array(row["doc_ids"], pa.int64()),
                    pa.array(ends - np.array(row["n_tokens"]), pa.int64()), pa.array(row["n_tokens"], pa.int64()), pa.array([zlib.crc32(x) for x in parts], pa.int64()),
                ]
                names = ["shard", "page", "doc_id", "inside", "n_tokens", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(parts, pa.binary())] if ids else [])], names=[*names, *(["ids"] if ids else [])])

    found = stored.mapInArrow(run, "shard int, page int, doc_id bigint, inside bigint, n_tokens bigint, ids_crc32 bigint" + (", ids binary" if ids else ""))
    placed = found.join(page_starts(stored), ["shard", "page"])
    return placed.select("doc_id", (F.col("page_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if ids else []))


def page_starts(stored: DataFrame) -> DataFrame:
    """``shard, page, page_start``: the number of ids before every page."""
    sizes = stored.select("shard", "page", "n_ids")
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shard_start"))
    inside = Window.partitionBy("shard").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    within = sizes.select("shard", "page", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("before"))
    return within.join(shards, "shard").select("shard", "page", (F.col("shard_start") + F.col("before")).alias("page_start"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "token-file")
    write(Tables(spark, folder).documents, path)
    return read(spark, path, ids=False)
