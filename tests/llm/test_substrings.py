import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import substrings as sub
from quarry.llm.common import documents


def slow(rows, length=50):
    least = {}
    raw = [(sub.LAST if d is None else d, (t or "").encode()) for d, t in rows]
    for d, t in raw:
        for i in range(len(t) - length + 1):
            s = t[i : i + length]
            least[s] = min(d, least.get(s, d))
    out = []
    for (doc, _), (d, t) in zip(rows, raw, strict=True):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if least[t[i : i + length]] < d:
                gone[i : i + length] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(t) else 0
        out.append((doc, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def compare(docs):
    got = sorted((tuple(r) for r in sub.without_repeats(docs).collect()), key=str)
    assert got == slow([(r.doc_id, r.text) for r in docs.collect()])


def test_documents(spark, sf, monkeypatch):
    monkeypatch.setattr(sub, "BLOCK", 40_000)
    compare(documents(spark, sf))


@pytest.mark.parametrize("hot", [4000, 5])
def test_planted_passages(spark, hot, monkeypatch):
    monkeypatch.setattr(sub, "BLOCK", 6000)
    monkeypatch.setattr(sub, "HOT", hot)
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdeé "), rng.integers(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    line, passage = text(12), text(30)
    rows = []
    for k in range(150):
        parts = [text(int(rng.integers(0, 40))) for _ in range(3)]
        parts.insert(1, [line, passage, passage[5:70], "ab " * 40, ""][k % 5])
        rows.append((int(rng.integers(0, 120)), "\n".join(parts)))
    rows += [rows[3], (500, rows[3][1]), (None, rows[4][1]), (2, passage), (-5, line + line)]
    compare(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))


def test_edges(edge_docs, no_docs):
    compare(edge_docs)
    assert sub.without_repeats(no_docs).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("ab", min_size=0, max_size=90), min_size=1, max_size=5), st.integers(9, 50))
def test_refinement_equals_sorting_by_content(texts, length):
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    end = np.repeat(np.cumsum([len(r) for r in raw]), [len(r) for r in raw])
    bucket = sub.refined(data, end, length)
    whole = data.tobytes()
    content = {}
    for p, b in enumerate(bucket.tolist()):
        if p + length <= end[p]:
            assert content.setdefault(whole[p : p + length], b) == b >= 0
        else:
            assert b == -1
    assert len(set(content.values())) == len(content)
