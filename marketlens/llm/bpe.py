"""Byte-level BPE with a deterministic automaton over token arcs.

The automaton starts as one state with an arc per byte. Every merge ``(u, v) -> uv``, in
order of rank, adds one gadget: the state ``q`` that all ``u`` arcs enter is copied
without its ``v`` arc, the ``u`` arcs are redirected to the copy, and every state with a
``u`` arc gets a ``uv`` arc to the place where ``v`` leads from ``q``. What remains
accepts exactly one path of arcs for every byte string, and that path is its BPE
tokenization. Two facts keep the tables small: all arcs of one token enter the same
state (``target``), and a state differs from the one it was copied from by one missing
arc (``removed``). So the arcs of 50,000 states are three integers per state and per
token, and "has state p an arc t" is a look-up of intervals in the tree of copies.

Encoding follows the arcs of a word through the tables. Decoding emits the arc labels.

Texts are split into words as the byte-level tokenizers do it. Words are encoded once
and remembered in a table of bounded size.

Defined results: a null text counts as empty and has no ids; rows, other columns and
repeated rows are kept as they are; added special tokens (for instance an end mark) that
stand in a text become their one id.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

#: Fixed value: the pattern by which byte-level BPE splits texts into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words remembered by a Python worker; beyond that the table is emptied.
REMEMBERED = 400_000


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files, reversed.

    Fixed rule of the file format: printable Latin-1 bytes stand for themselves, the
    others take the code points from 256 on.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Automaton:
    """Tables of the automaton; small enough to be sent to every worker."""

    def __init__(self, labels: list[bytes], merges: list[tuple[int, int, int]], specials: dict[str, int] | None = None):
        """labels: bytes of every id (empty where an id is unused); merges: (left, right, merged) ids by rank."""
        size = len(labels)
        self.labels, self.specials = labels, dict(specials or {})
        special_ids = set(self.specials.values())
        merged = {t for _, _, t in merges}
        self.ids = {x: i for i, x in enumerate(labels) if x and i not in special_ids and (len(x) == 1 or i in merged)}
        self.reach: dict[bytes, int] = {}  # longest token by its first four bytes; other tokens are shorter
        for x in self.ids:
            if len(x) > 3:
                self.reach[x[:4]] = max(self.reach.get(x[:4], 4), len(x))
        self.target = [0] * size
        self.left = [-1] * size
        self.rank = [0] * size
        self.alive = [len(x) == 1 for x in labels]
        parent, gone, made = [0], [-1], [0]  # per state: copied from, arc left out, rank of the merge that made it
        for k, (u, v, t) in enumerate(merges, 1):
            if self.left[t] != -1 or not self.alive[u] or not self.alive[v] or not self._arc_while_built(self.target[u], v, parent, gone, made):
                continue  # u is never followed by v any more, so the merge changes nothing
            q = self.target[u]
            parent.append(q)
            gone.append(v)
            made.append(k)
            beyond = self.target[v]
            self.target[u] = len(parent) - 1
            self.target[t], self.left[t], self.rank[t], self.alive[t] = beyond, u, k, True
        self._number(parent, gone, made)

    def _arc_while_built(self, state: int, token: int, parent: list[int], gone: list[int], made: list[int]) -> bool:
        spine, bound = {}, len(self.left) + 1
        while token != -1:
            spine.setdefault(token, bound)
            bound, token = self.rank[token], self.left[token]
        while state:
            upto = spine.get(gone[state])
            if upto is not None and made[state] <= upto:
                return False
            state = parent[state]
        return True

    def _number(self, parent: list[int], gone: list[int], made: list[int]) -> None:
        """Interval numbers of the tree of copies: x is above p if enter[x] <= enter[p] < leave[x]."""
        n = len(parent)
        below = [1] * n
        for s in range(n - 1, 0, -1):  # copies are numbered after what they were copied from
            below[parent[s]] += below[s]
        enter, free = [0] * n, [0] * n
        free[0] = 1
        for s in range(1, n):
            p = parent[s]
            enter[s] = free[p]
            free[p] += below[s]
            free[s] = enter[s] + 1
        self.enter = enter
        spans: dict[int, list[tuple[int, int, int]]] = {}
        for s in range(1, n):
            spans.setdefault(gone[s], []).append((enter[s], enter[s] + below[s], made[s]))
        # a token is left out once on a way down the tree, so the intervals of a token are disjoint
        self.without = {t: tuple(zip(*sorted(x))) for t, x in spans.items()}

    def has_arc(self, state: int, token: int) -> bool:
        if not self.alive[token]:
            return False
        at, bound = self.enter[state], 1 << 60
        while token != -1:
            found = self.without.get(token)
            if found is not None:
                i = bisect_right(found[0], at) - 1
                if i >= 0 and at < found[1][i] and found[2][i] <= bound:
                    return False
            bound, token = self.rank[token], self.left[token]
        return True


def load_automaton(path: str) -> Automaton:
    """From a ``tokenizers`` file with a byte-level BPE model."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, letters = spec["model"], byte_letters()
    plain = {"dropout": None, "unk_token": None, "byte_fallback": False, "ignore_merges": False}
    first = spec["pre_tokenizer"] or {}
    if any(model.get(k) not in (v, None, "") for k, v in plain.items()) or spec["normalizer"] or first.get("type") != "ByteLevel":
        raise ValueError("only plain byte-level BPE without a normalizer can be compiled")
    if first.get("add_prefix_space") or not first.get("use_regex", True):
        raise ValueError("a prefix space and texts that are not split are not supported")
    specials = {}
    for token in spec["added_tokens"]:
        if token["lstrip"] or token["rstrip"] or token["single_word"]:
            raise ValueError("added tokens that take white space with them are not supported")
        specials[token["content"]] = token["id"]
    vocab = model["vocab"]
    labels = [b""] * (1 + max([*vocab.values(), *specials.values()], default=-1))
    for token, i in vocab.items():
        labels[i] = bytes(letters[c] for c in token)
    for token, i in specials.items():
        labels[i] = token.encode()
    merges = []
    for pair in model["merges"]:
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        merges.append((vocab[a], vocab[b], vocab[a + b]))
    return Automaton(labels, merges, specials)


def _little(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class WordCoder:
    """Ids of whole texts from ids of words, with a table of remembered words of bounded size."""

    def __init__(self, specials: dict[str, int], remembered: int = REMEMBERED):
        self.specials, self.remembered = specials, remembered
        self.first: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}
        self.words = regex.compile(WORDS)
        self.uneven = regex.compile(r"\A\s|\s\Z| \s|\s ")
        marks = sorted(specials, key=len, reverse=True)
        self.marks = re.compile("(" + "|".join(map(re.escape, marks)) + ")") if marks else None

    def word_ids(self, word: bytes) -> list[int]:
        raise NotImplementedError

    def _piece(self, table: dict[str, bytes], key: str, text: str) -> bytes:
        known, found = self.known, b""
        # letters alone are one word, and so is one mark after them: no pattern is needed
        core = key[:-1]
        if key.isalpha():
            words = (text,)
        elif core.isalpha() and key[-1] in ".,;:!?)":
            words = (text[:-1], key[-1])
        else:
            words = self.words.findall(text)
        for word in words:
            ids = known.get(word)
            if ids is None:
                if len(known) >= self.remembered:
                    known.clear()
                ids = known[word] = _little(self.word_ids(word.encode()))
            found += ids
        if len(table) >= self.remembered:
            table.clear()
        table[key] = found
        return found

    def _plain(self, text: str) -> bytes:
        """Ids of a text without added tokens.

        A lone space between other characters always begins a word, so a text whose
        spaces all stand alone falls into independent pieces there.
        """
        if not text:
            return b""
        first, spaced, piece = self.first, self.spaced, self._piece
        if self.uneven.search(text):
            return b"".join([first.get(w) or piece(first, w, w) for w in self.words.findall(text)])
        head, *rest = text.split(" ")
        out = [first.get(head) or piece(first, head, head)]
        out += [spaced.get(w) or piece(spaced, w, " " + w) for w in rest]
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.marks is None or not self.marks.search(text):
            return self._plain(text)
        specials = self.specials
        parts = self.marks.split(text)
        return b"".join(_little([specials[x]]) if i % 2 else self._plain(x) for i, x in enumerate(parts))


class Coder(WordCoder):
    """Encoder and decoder by the automaton."""

    def __init__(self, automaton: Automaton, remembered: int = REMEMBERED):
        super().__init__(automaton.specials, remembered)
        self.automaton = automaton
        self.arcs: dict[int, bool] = {}

    def word_ids(self, word: bytes) -> list[int]:
        """Arcs of the only accepted path of a word.

        Long arcs are tried first. A path that can't go on steps back; places where that
        happened are marked, so every state is left at most once at each place.
        """
        a = self.automaton
        ids, arcs, target, labels, has_arc, reach = a.ids, self.arcs, a.target, a.labels, a.has_arc, a.reach
        n, at, state, out, closed = len(word), 0, 0, [], set()
        width = min(n, reach.get(word[:4], 3))
        while at < n:
            while width:
                token = ids.get(word[at : at + width])
                if token is not None:
                    key = state << 20 | token
                    there = arcs.get(key)
                    if there is None:
                        if len(arcs) >= self.remembered:
                            arcs.clear()
                        there = arcs[key] = has_arc(state, token)
                    if there and (not closed or (at + width, target[token]) not in closed):
                        break
                width -= 1
            if width:
                out.append(token)
                at, state = at + width, target[token]
                width = min(n - at, reach.get(word[at : at + 4], 3))
            elif out:
                closed.add((at, state))
                width = len(labels[out.pop()])
                at -= width
                width, state = width - 1, target[out[-1]] if out else 0
            else:
                raise ValueError("the vocabulary lacks a byte of the text")
        return out

    def decode(self, ids: bytes | None) -> str:
        labels = self.automaton.labels
        return b"".join([labels[i] for i in np.frombuffer(ids or b"", "<u4").tolist()]).decode("utf-8", "replace")


_coders: dict[str, Coder] = {}


def coder_of(shared) -> Coder:
    """The coder of this worker for a broadcast automaton; it outlives the task."""
    key, automaton = shared.value
    if key not in _coders:
        _coders.clear()
        _coders[key] = Coder(automaton)
    return _coders[key]


def share(spark, path: str):
    """Broadcast the automaton of a vocabulary file; its size is that of the vocabulary."""
    with open(path, "rb") as file:
        key = hashlib.sha256(file.read()).hexdigest()
    return spark.sparkContext.broadcast((key, load_automaton(path)))


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds ``ids``: the token ids of the whole text, as little-endian unsigned 32-bit integers."""
    shared = share(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(shared)
        for batch in batches:
            coded = pa.array([coder.encode(x) for x in batch.column(text).to_pylist()], pa.binary())
            yield _with(batch, ids, coded)

    return docs.mapInArrow(run, _schema(docs, ids, T.BinaryType()))


def decode(docs: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds ``text``: the labels of the ids, read as UTF-8."""
    shared = share(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(shared)
        for batch in batches:
            yield _with(batch, text, pa.array([coder.decode(x) for x in batch.column(ids).to_pylist()], pa.string()))

    return docs.mapInArrow(run, _schema(docs, text, T.StringType()))


def round_trip(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds ``ids`` and ``decoded`` in one pass; the text itself is not returned."""
    shared = share(docs.sparkSession, path)
    kept = docs.drop(text)
    schema = _schema(_schema(kept, decoded, T.StringType()), ids, T.BinaryType())
    schema = T.StructType([f for f in schema.fields if f.name != decoded]).add(decoded, T.StringType())
    names = [c for c in kept.columns if c not in (ids, decoded)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(shared)
        for batch in batches:
            column = batch.column(batch.schema.names.index(text))
            for start in range(0, batch.num_rows, 500):  # a few documents at a time, so that their ids stay few
                some = batch.slice(start, 500)
                coded = [coder.encode(x) for x in column.slice(start, 500).to_pylist()]
                texts = [coder.decode(x) for x in coded]
                yield pa.RecordBatch.from_arrays([*(some.column(n) for n in names), pa.array(coded, pa.binary()), pa.array(texts, pa.string())], names=[*names, ids, decoded])

    return docs.mapInArrow(run, schema)


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document the number of ids and the SHA-256 of ids and decoded text."""
    done = round_trip(docs.select("doc_id", "text"), path or default_path())
    return done.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _schema(df: DataFrame | T.StructType, name: str, kind: T.DataType) -> T.StructType:
    fields = (df if isinstance(df, T.StructType) else df.schema).fields
    return T.StructType([f for f in fields if f.name != name] + [T.StructField(name, kind)])


def _with(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    names = [n for n in batch.schema.names if n != name]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), column], names=[*names, name])
