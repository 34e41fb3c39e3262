"""All stages against plain Python, and on odd rows."""

import collections
import sys
from pathlib import Path

from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parent))
sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import test_jaccard  # noqa: E402
import test_mixing  # noqa: E402
import test_quality  # noqa: E402

import corpus_pipeline  # noqa: E402
from marketlens.llm import bpe, pii  # noqa: E402


def test_against_plain_python(spark, folder, documents):
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    good = {r.doc_id for r in labels if r.quality == 1}
    judged = test_quality.brute([(i, t) for i, t, _ in documents], good)
    rows = [d for d, j in zip(documents, judged) if j[7]]
    groups = test_jaccard.brute([(i, t) for i, t, _ in rows])
    rows = [d for d, g in zip(rows, groups) if g[0] == g[2]]
    weights = pii.train(spark.createDataFrame(rows, "doc_id bigint, text string, source string"))

    def clean(text):
        out, at = "", 0
        for start, end, kind, _ in pii.all_spans(text, weights):
            if start >= at:
                out += text[at:start] + f"<{kind}>"
            at = max(at, end)
        return out + text[at:]

    rows = [(i, clean(t), s) for i, t, s in rows]
    sizes = {i: (size, taken) for i, size, _, _, taken in test_mixing.brute(rows)}
    tokenizer = Tokenizer.from_file(bpe.default_path())
    want = collections.Counter()
    for i, text, _ in rows:
        size, taken = sizes[i]
        want[i, len(tokenizer.encode(text, add_special_tokens=False).ids)] += taken // size
    got = collections.Counter((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, folder).collect())
    assert got == +want


def test_stages_bear_odd_rows(spark, odd, nothing, folder):
    for docs in (odd, nothing):
        for name, stage in corpus_pipeline.STAGES:
            done = stage(spark, docs, folder)
            assert done.count() <= 2 * docs.count(), name
            if name != corpus_pipeline.STAGES[-1][0]:
                assert done.columns == docs.columns, name


def test_near_copies_of_five_word_shingles_leave_one(spark, folder):
    base = [f"word{i}" for i in range(194)]
    near, far = list(base), list(base)
    for i in (30, 70, 110, 150):
        near[i] = f"other{i}"  # 170 of 210 five-word shingles, but 175 of 207 four-word ones
    for i in (20, 50, 80, 110, 140, 170):
        far[i] = f"far{i}"
    five, four = (test_jaccard.shingles(" ".join(base), k) for k in (5, 4))
    five_near, four_near = (test_jaccard.shingles(" ".join(near), k) for k in (5, 4))
    assert 0.80 < len(five & five_near) / len(five | five_near) < 0.82 and len(four & four_near) / len(four | four_near) < 0.85
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far))], "doc_id bigint, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.keep_one_of_group(spark, docs, folder).collect()) == [1, 3]
