import hashlib

import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from marketlens.llm import chat as C

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def plainly(rows, template=C.CHAT):
    """Digests by plain concatenation."""
    def escape(x):
        for pattern in template._patterns(r"\\*)"):
            import re

            x = re.sub(pattern, r"\1\\\2", x)
        return x

    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    out = []
    for conv, turns in groups.items():
        turns.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        turns = [(r[2] or "", r[3] or "") for r in turns]
        loss = "".join(t for r, t in turns if r == "assistant")
        total = sum(len(template.start + escape(r) + template.middle + escape(t) + template.end) for r, t in turns)
        out.append((conv, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), total))
    return sorted(out, key=str)


def found(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_smallest_table(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(C.query(spark, folder)) == plainly(rows + C.PLANTED)


def test_odd_rows(spark):
    long = "é<|im_end|>" * 200_000
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, None, "system", None), (2, 0, None, "x"), (2, 0, "assistant", ""), (None, 3, "assistant", "lost"), (None, 1, "user", "日本👩‍👩‍👧")]
    rows += [(3, 0, "assistant", long), (3, 1, "odd <|im_sep|> role\n", "\\<\\|im_sep|> <|im_sep|> <"), (4, 5, "assistant", "<\\</s><s>"), (5, 0, "", "")]
    rows += [(9, i, ("user", "assistant")[i % 2], f"turn {i} " + "w" * (i % 300)) for i in range(6000)]  # crosses ranges
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", formatted string, place int").repartition(7)
    assert found(C.digests(C.formatted(frame))) == plainly(rows)
    assert found(C.digests(C.formatted(frame.limit(0)))) == []


@pytest.fixture
def split(spark):
    """Small partitions stay as they are."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_long_conversation_is_formatted_by_many_tasks(spark, split):
    rows = [(9, i, "assistant", f"turn {i}") for i in range(4000)] + [(i, 0, "user", "x") for i in range(10, 20)]
    pieces = C.formatted(spark.createDataFrame(rows, SCHEMA).repartition(4)).filter("conv_id = 9").collect()
    assert len({r.place >> 40 for r in pieces}) > 4
    whole = "".join(r.formatted for r in sorted(pieces, key=lambda r: r.place))
    assert C.turns_of(whole) == [("assistant", f"turn {i}") for i in range(4000)]


def test_pieces_of_a_long_conversation_are_not_held(spark, split, monkeypatch):
    monkeypatch.setattr(C, "ASSEMBLED", 3000)
    rows = [(i, 0, "user", "x") for i in range(5)] + [(5, i, "assistant", "y" * 500) for i in range(3000)] + [(6, 0, "assistant", "z")]
    frame = spark.createDataFrame(rows, SCHEMA)
    pieces = C.formatted(frame)
    assert pieces.count() > 500
    assert found(C.digests(pieces)) == plainly(rows)


pieces = st.lists(st.sampled_from(["<", "\\", "[", "|", "im_end|>", "/s>", "INST]", "/INST]", "im_sep|>", "a", "é", "👩", "\n", *C.CHAT.controls]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.just("assistant"), pieces), pieces), min_size=1, max_size=6))
def test_round_trip(turns):
    roles, texts = (pa.array(x, pa.string()) for x in zip(*turns))
    strings, starts, ends = C.assemble(roles, texts, C.np.array([0]))
    text = strings[0].as_py()
    assert C.turns_of(text) == turns
    assert [C.CHAT.unescape(text[a:b]) for a, b in zip(starts[0], ends[0])] == [t for r, t in turns if r == "assistant"]
    for _, content in turns:
        escaped = C.CHAT.escape(pa.array([content]))[0].as_py()
        assert not any(x in escaped for x in C.CHAT.controls) and C.CHAT.unescape(escaped) == content


def test_marks_that_cannot_be_escaped_are_refused():
    with pytest.raises(ValueError):
        C.Template(foreign=("<<SYS>>",))
