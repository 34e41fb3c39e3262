"""Chat formatting by columnar byte assembly.

A turn becomes five segments: start mark, role, middle mark, text, end mark. For a batch of
turns the segment lengths are a matrix, their running sum gives every segment's place, and
scatter indices copy each column (marks and contents) at once into one preallocated buffer,
which becomes the values buffer of an Arrow string array. The same running sum gives the
loss mask: spans of code points that hold the texts of learned roles.

Control strings inside roles and texts are escaped: a backslash goes behind the first
character, and where backslashes stand there already, one more. So no control string of
the template or of the listed foreign templates stays in a content, and taking one
backslash away gives the content back.

Rows are dealt by ranges of conversation and turn, so the turns of one long conversation
are formatted by many tasks, as pieces whose ``place`` orders them. What ``digests`` reads
back is reduced in the same tasks for every conversation that lies within one range; only
the first and last one of a range are sent on, to be hashed from their pieces in order. A
hash over a conversation is one sequential pass; it streams and holds no conversation.

Defined results: turns are ordered by turn (null first), then role, then text (first 64
characters, then hash); a null role or text counts as empty; rows with a null ``conv_id``
are one conversation; repeated rows are turns of their own; any role name is kept, and
only learned roles (assistant) are under the mask; other columns are left out; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from marketlens.tables import Tables

#: Bytes of contents that are assembled at once; one longer turn is a batch of its own.
ASSEMBLED = 8 << 20
_PREFIX = 64


@dataclass(frozen=True)
class Template:
    """Marks of a turn, control strings of other templates that are escaped too, and roles under the loss mask."""

    start: str = "<|im_start|>"
    middle: str = "<|im_sep|>"
    end: str = "<|im_end|>"
    foreign: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<|system|>", "<|user|>", "<|assistant|>", "<|endoftext|>", "<|eot_id|>")
    learned: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        openers = {x[:1] for x in self.controls}
        for x in self.controls:
            if len(x) < 2 or "\\" in x or any(o in x[1:] for o in openers):
                raise ValueError(f"{x!r} can't be escaped: two characters at least, no backslash, no first character of a control string behind the first")

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.start, self.middle, self.end, *self.foreign)

    def _patterns(self, inner: str) -> list[str]:
        """One pattern for every first character: the character, ``inner``, the rest of one of its control strings."""
        return [f"({re.escape(o)}{inner}(" + "|".join(re.escape(x[1:]) for x in self.controls if x[0] == o) + ")" for o in dict.fromkeys(x[0] for x in self.controls)]

    def escape(self, contents: pa.Array) -> pa.Array:
        for pattern in self._patterns(r"\\*)"):
            contents = pc.replace_substring_regex(contents, pattern, r"\1\\\2")
        return contents

    def unescape(self, text: str) -> str:
        for pattern in self._patterns(r"\\*)\\"):
            text = re.sub(pattern, r"\1\2", text)
        return text


CHAT = Template()


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(lengths, bytes)`` of a string array without nulls."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return np.diff(offsets), data


def assemble(roles: pa.Array, texts: pa.Array, first: np.ndarray, template: Template = CHAT) -> tuple[pa.Array, list[list[int]], list[list[int]]]:
    """Formatted strings of runs of turns, and the starts and ends (code points) of their learned texts.

    ``first`` holds the row at which each run begins, 0 at first. Roles and texts have no nulls.
    """
    contents = [None, template.escape(roles), None, template.escape(texts), None]
    marks = [template.start.encode(), None, template.middle.encode(), None, template.end.encode()]
    n = len(roles)
    lengths, sources = np.empty((n, 5), np.int64), {}
    for k in range(5):
        if marks[k] is not None:
            lengths[:, k] = len(marks[k])
        else:
            lengths[:, k], sources[k] = _bytes_of(contents[k])
    places = np.concatenate([[0], np.cumsum(lengths.ravel())])
    starts, total = places[:-1].reshape(n, 5), int(places[-1])
    buffer = np.empty(total, np.uint8)
    for k in range(5):
        if marks[k] is not None:
            buffer[starts[:, k, None] + np.arange(len(marks[k]))] = np.frombuffer(marks[k], np.uint8)
        else:
            before = np.cumsum(lengths[:, k]) - lengths[:, k]
            buffer[np.repeat(starts[:, k] - before, lengths[:, k]) + np.arange(len(sources[k]))] = sources[k]
    runs = np.concatenate([starts[first, 0], [total]])
    strings = pa.StringArray.from_buffers(len(first), pa.py_buffer(runs.astype(np.int32).tobytes()), pa.py_buffer(buffer))

    points = np.concatenate([[0], np.cumsum((buffer & 0xC0) != 0x80)])  # code points before each byte
    run = np.searchsorted(first, np.arange(n), side="right") - 1
    learned = np.flatnonzero(pc.is_in(roles, pa.array(template.learned, pa.string())).to_numpy(zero_copy_only=False))
    begin = points[starts[learned, 3]] - points[runs[run[learned]]]
    finish = begin + points[starts[learned, 4]] - points[starts[learned, 3]]
    cuts = np.searchsorted(run[learned], np.arange(1, len(first)))
    return strings, [x.tolist() for x in np.split(begin, cuts)], [x.tolist() for x in np.split(finish, cuts)]


def _in_order(conversations: DataFrame) -> DataFrame:
    """Turns dealt by ranges of conversation and turn; repeated rows may be split over ranges."""
    turns = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")])
    keys = ["conv_id", "turn", F.substring("role", 1, _PREFIX), F.substring("text", 1, _PREFIX), F.xxhash64("role", "text")]
    return turns.repartitionByRange(*keys, F.monotonically_increasing_id()).sortWithinPartitions(*keys)


def formatted(conversations: DataFrame, template: Template = CHAT) -> DataFrame:
    """``conv_id, place, formatted, loss_starts, loss_ends``: conversations in pieces, ordered by place.

    A conversation is one piece unless it crosses a range or a batch; its formatted text is
    that of its pieces one behind the other. The spans count from the start of their piece.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 40
        for whole in batches:
            if not len(whole):
                continue
            sizes = np.cumsum(np.diff(np.frombuffer(whole.column("text").buffers()[1], np.int32)[whole.column("text").offset :][: len(whole) + 1])) // ASSEMBLED
            for part in np.split(np.arange(len(whole)), np.flatnonzero(np.diff(sizes)) + 1):
                batch = whole.slice(int(part[0]), len(part))
                ids = batch.column("conv_id")
                numbers = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
                unknown = pc.is_null(ids).to_numpy(zero_copy_only=False)
                first = np.concatenate([[0], np.flatnonzero((np.diff(numbers) != 0) | (np.diff(unknown.astype(np.int8)) != 0)) + 1])
                strings, starts, ends = assemble(batch.column("role"), batch.column("text"), first, template)
                columns = [ids.take(pa.array(first)), pa.array(place + np.arange(len(first))), strings, pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64()))]
                place += len(first)
                yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "place", "formatted", "loss_starts", "loss_ends"])

    return _in_order(conversations).select("conv_id", "role", "text").mapInArrow(run, "conv_id bigint, place bigint, formatted string, loss_starts array<bigint>, loss_ends array<bigint>")


def turns_of(formatted: str, template: Template = CHAT) -> list[tuple[str, str]]:
    """Roles and texts of a formatted piece."""
    out = []
    for turn in formatted.split(template.end)[:-1]:
        if not turn.startswith(template.start):
            raise ValueError("not a formatted conversation")
        role, text = turn[len(template.start) :].split(template.middle, 1)
        out.append((template.unescape(role), template.unescape(text)))
    return out


_DIGEST = [("conv_id", pa.int64()), ("place", pa.int64()), ("n_turns", pa.int64()), ("turns", pa.binary()), ("loss_chars", pa.int64()), ("loss", pa.binary()), ("formatted_chars", pa.int64()), ("open", pa.bool_())]
_RESULT = [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]


def _batch(rows: list[tuple], names: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, names)], names=[n for n, _ in names])


class _Sums:
    """Running counts and hashes of one conversation."""

    def __init__(self, conv_id, place):
        self.conv_id, self.place, self.n, self.chars, self.total = conv_id, place, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, n: int, turns: bytes, chars: int, loss: bytes, total: int) -> None:
        self.n, self.chars, self.total = self.n + n, self.chars + chars, self.total + total
        self.turns.update(turns)
        self.loss.update(loss)


def digests(pieces: DataFrame, template: Template = CHAT) -> DataFrame:
    """Counts and hashes of the turns and of the text under the loss mask, read back from formatted pieces."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the first and the last conversation of a range may go on in other ranges: their pieces are sent on
        held: _Sums | None = None
        leading, last, seen = None, [], False
        for batch in batches:
            out = []
            for conv_id, place, text, starts, ends in zip(*(c.to_pylist() for c in batch.columns)):
                turns = turns_of(text, template)
                loss = [template.unescape(text[a:b]) for a, b in zip(starts, ends)]
                row = (len(turns), "".join(f"{r}\n{t}\n" for r, t in turns).encode(), sum(map(len, loss)), "".join(loss).encode(), len(text))
                if not seen:
                    seen, leading = True, (conv_id,)
                if leading == (conv_id,):
                    out.append((conv_id, place, row[0], row[1], row[2], row[3], row[4], True))
                    continue
                leading = None
                if held is not None and held.conv_id != conv_id:
                    out.append((held.conv_id, held.place, held.n, held.turns.digest(), held.chars, held.loss.digest(), held.total, False))
                    held, last = None, []
                held = held or _Sums(conv_id, place)
                held.add(*row)
                last.append((conv_id, place, *row, True))
                if len(last) > 1 and sum(len(x[3]) for x in last) > ASSEMBLED:  # a long one is sent on, its pieces aren't held
                    out += last
                    leading, held, last = (conv_id,), None, []
            yield _batch(out, _DIGEST)
        yield _batch(last, _DIGEST)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: _Sums | None = None

        def told(x: _Sums) -> tuple:
            return x.conv_id, x.n, x.turns.hexdigest(), x.chars, x.loss.hexdigest(), x.total

        for batch in batches:
            out = []
            for conv_id, place, n, turns, chars, loss, total, is_open in zip(*(c.to_pylist() for c in batch.columns)):
                if held is not None and (held.conv_id != conv_id or not is_open):
                    out.append(told(held))
                    held = None
                if is_open:
                    held = held or _Sums(conv_id, place)
                    held.add(n, turns, chars, loss, total)
                else:
                    out.append((conv_id, n, turns.hex(), chars, loss.hex(), total))
            yield _batch(out, _RESULT)
        if held is not None:
            yield _batch([told(held)], _RESULT)

    rows = pieces.mapInArrow(read, "conv_id bigint, place bigint, n_turns bigint, turns binary, loss_chars bigint, loss binary, formatted_chars bigint, open boolean")
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return dealt.mapInArrow(finish, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


#: The conversation that the query adds to the table: fixed values.
PLANTED = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def _sql(template: Template = CHAT) -> str:
    """SQL for the query's rows: the length of the escaped contents and the marks, hashes of the ordered turns."""

    def escaped(column: str) -> str:
        for pattern in template._patterns(r"\\*)"):
            column = f"regexp_replace({column}, '{pattern}', '\\1\\\\\\2', 'g')"
        return column

    planted = ", ".join(f"({i}, {n}, '{r}', '{t}')" for i, n, r, t in PLANTED)
    marks = len(template.start + template.middle + template.end)
    learned = ", ".join(f"'{r}'" for r in template.learned)
    return f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES {planted}) AS x(conv_id, turn, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role IN ({learned})), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role IN ({learned})), '')) AS loss_sha256,
  sum({marks} + length({escaped("role")}) + length({escaped("text")}))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""


SQL = _sql()


def query(spark: SparkSession, folder: str) -> DataFrame:
    table = Tables(spark, folder).conversations.select("conv_id", "turn", "role", "text")
    return digests(formatted(table.union(spark.createDataFrame(PLANTED, "conv_id bigint, turn bigint, role string, text string"))))
