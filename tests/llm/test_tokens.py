"""Byte-level BPE by the automaton, and token files, against the tokenizers library."""

import hashlib
import json
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from marketlens.llm import bpe, token_blocks as B
from marketlens.operators.scratch import scratch_path

ODD = [
    "", " ", "  a", "a  b", "a \n b\n\n c ", "it's I'll 's 't", "<|endoftext|>x <|endoftext|><|endoftext|>", "a" * 3000, "\t\tx\x1cq\x85w", "日本語 テスト 123 ①²½ ǅ \u200b x\u3000y", "👩‍👩‍👧 !!??...", "\r\n  x", " 's",
    "x \u180e y \ufeff", "0" * 500, "\u00a0\u00a0nbsp", "the  the the",
]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(bpe.default_path())
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


@pytest.fixture(scope="module")
def coder():
    return bpe.Coder(bpe.load_automaton(bpe.default_path()))


def test_automaton_equals_library(coder, library, documents):
    for text in [*ODD, *(t for _, t, _ in documents)]:
        want = library.encode(text, add_special_tokens=False).ids
        ids = coder.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert coder.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_random_letters(coder, library):
    random.seed(5)
    for _ in range(1500):
        text = "".join(random.choice("etaoinshr  '\n.1é") for _ in range(random.randint(1, 40)))
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_small_automaton_has_one_path():
    """All strings over two bytes, every vocabulary of a few merges: the same as merging by rank."""
    random.seed(7)
    for _ in range(60):
        labels, merges = [b"a", b"b"], []
        for _ in range(6):
            u, v = random.randrange(len(labels)), random.randrange(len(labels))
            if labels[u] + labels[v] in labels:
                continue
            merges.append((u, v, len(labels)))
            labels.append(labels[u] + labels[v])
        coder = bpe.Coder(bpe.Automaton(labels, merges))
        for n in range(1, 9):
            for code in range(2**n):
                word = bytes(97 + (code >> i & 1) for i in range(n))
                ids = [labels.index(bytes([c])) for c in word]
                for u, v, t in merges:
                    out, i = [], 0
                    while i < len(ids):
                        if ids[i : i + 2] == [u, v]:
                            out.append(t)
                            i += 2
                        else:
                            out.append(ids[i])
                            i += 1
                    ids = out
                assert coder.word_ids(word) == ids


def test_remembered_words_are_bounded(library, documents):
    coder = bpe.Coder(bpe.load_automaton(bpe.default_path()), remembered=50)
    for _, text, _ in documents[:40]:
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert max(len(coder.first), len(coder.spaced), len(coder.arcs)) <= 50


def test_unsupported_files_are_refused(tmp_path):
    with open(bpe.default_path(), encoding="utf-8") as file:
        spec = json.load(file)
    spec["normalizer"] = {"type": "NFC"}
    (tmp_path / "t.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        bpe.load_automaton(str(tmp_path / "t.json"))


def test_digest(spark, odd, nothing, library):
    got = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digest(odd).collect())
    want = []
    for r in odd.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((r.doc_id or 0, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.digest(nothing).count() == 0
    coded = bpe.decode(bpe.encode(odd, bpe.default_path()), bpe.default_path())
    assert all(r.decoded == (r.text or "") for r in coded.collect()) and set(odd.columns) < set(coded.columns)


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 511, 512, 513, 3000):
        for top in (1, 2, 300, 50_000, 2**32 - 1):
            ids = rng.integers(0, top, n, dtype=np.uint32)
            ids[rng.random(n) < 0.01] = 2**32 - 1
            assert np.array_equal(B.decode_blocks(*B.encode_blocks(ids)), ids)
    skewed = np.where(rng.random(5120) < 0.01, 60_000, rng.integers(100, 116, 5120)).astype(np.uint32)
    assert len(B.encode_blocks(skewed)[1]) < 5120  # four bits and a few exceptions for each id


def test_token_files(spark, odd, nothing, library, monkeypatch):
    for docs in (odd, nothing):
        path = scratch_path(spark, "test-tokens")
        B.write(docs, path)
        rows = B.read(spark, path).collect()
        assert len(rows) == docs.count()
        at, known = 0, {}
        for r in odd.collect():
            ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
            known.setdefault(r.doc_id, []).append(ids)
        for r in sorted(rows, key=lambda r: r.start):
            assert r.start == at and bytes(r.ids) in known[r.doc_id] and r.ids_crc32 == zlib.crc32(r.ids) and r.n_tokens == len(r.ids) // 4
            at += r.n_tokens
        order = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
        assert order == sorted(order, key=lambda i: (i is not None, i or 0))


def test_columns_are_encoded_like_whole_texts_by_the_library():
    spec = open(bpe.default_path(), encoding="utf-8").read()
    library, draw = Tokenizer.from_str(spec), random.Random(8)
    letters = [*"ab'sté \n\t.,*\"!?　\xa0\x85\x1c12é漢🙂", " ", " ", "the", "'ll", "\n", "<|endoftext|>", " don't"]
    texts = ["".join(draw.choices(letters, k=draw.randint(0, 25))) for _ in range(3000)]
    texts += [None, "", " ", "\n", "a\nb", "a.\nB***", "a'\nb", " a", "a ", "x" * 5000, "word " * 4000 + "end"]
    for remembered in (3, 10_000):
        coder = B.LibraryCoder(spec, remembered)
        for text, ids in zip(texts, coder.encode_column(pa.array(texts)), strict=True):
            assert ids.tolist() == library.encode(text or "", add_special_tokens=False).ids, text
    assert coder.encode_column(pa.array([], pa.string())) == []


@pytest.mark.parametrize("change", [{"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"prefix": True}])
def test_files_whose_words_are_not_independent_are_refused(change):
    spec = json.load(open(bpe.default_path(), encoding="utf-8"))
    if change.pop("prefix", False):
        spec["pre_tokenizer"]["add_prefix_space"] = True
    with pytest.raises(ValueError):
        B.LibraryCoder(json.dumps(spec | change))
