import itertools
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from quarry.llm import common, similar
from quarry.llm.common import Scratch, byte_view, documents
from quarry.llm.simhash import index_of


def slow_set(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def slow_components(rows, ok):
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if ok(i, j):
            root[find(i)] = find(j)
    return [find(i) for i in range(len(rows))]


def edited_texts(rng, n_bases=60, copies=12, n_words=120):
    """Bases and copies of each with one to five words exchanged."""
    out = []
    for b in range(n_bases):
        base = [f"w{k}" for k in rng.integers(0, 5000, n_words)]
        out.append(" ".join(base))
        for _ in range(copies):
            words = list(base)
            for at in rng.integers(0, n_words, rng.integers(1, 6)):
                words[at] = f"x{rng.integers(0, 10**6)}"
            out.append(" ".join(words))
    return out


def test_shingles_equal_the_slow_ones(spark, sf):
    texts = [r.text for r in documents(spark, sf).collect()] + [None, "", " \n", "One", "one  TWO", "a b c d e", "a b c d e f a b c d e", "é É ÀA\x0bb", "x " * 3000]
    h, of = similar.shingles(*byte_view(pa.array(texts, pa.large_string())))
    slow = [slow_set(t) for t in texts]
    assert np.diff(of).tolist() == [len(s) for s in slow]
    fp, node = similar.majorities(h, of), similar.set_hash(h, of)
    same = {}
    for s, x in zip(slow, node.tolist()):
        assert same.setdefault(s, x) == x
    assert len(set(same.values())) == len(same)
    bits = lambda x: np.unpackbits(similar.mix64(x).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    for k in (0, 7, len(texts) - 1, len(texts) - 3):
        own = h[of[k] : of[k + 1]]
        want = 2 * bits(own ^ np.uint64(0x6A09E667F3BCC909)).sum(0, dtype=int) > len(own)
        assert (np.unpackbits(fp[k : k + 1, 0].astype(">u8").view(np.uint8)) == want).all()


def test_keys_are_the_codewords_of_their_bits():
    rng = np.random.default_rng(1)
    a, b = rng.integers(-(2**63), 2**63, (2, 20), dtype=np.int64)
    keys = similar.Keys()(a, b)
    for row, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        bits = [(x >> (63 - k)) & 1 for k in range(64)] + [(y >> (63 - k)) & 1 for k in range(64)]
        for t, segments in enumerate(similar.places()):
            want = t
            for places in segments:
                want = want << 12 | int(index_of(np.array([sum(bits[p] << k for k, p in enumerate(places))]))[0])
            assert int(keys[row, t]) % 2**32 == want


@pytest.mark.parametrize("block", [8, similar.BLOCK])
def test_components(spark, block, monkeypatch):
    rng = np.random.default_rng(2)
    texts = edited_texts(rng)
    texts += texts[:5] + [t.upper() for t in texts[5:9]] + [None, "", "two words", "Two  words"]
    order = rng.permutation(len(texts))
    if block == 8:
        monkeypatch.setattr(similar, "SHINGLES", 500)
        monkeypatch.setattr(similar, "POINTS_OF_BLOCK", 4)
    docs = spark.createDataFrame([(int(i), texts[i]) for i in order], "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in similar.similar_components(docs, block=block).collect()}
    slow = [slow_set(t) for t in texts]
    want = slow_components(texts, lambda i, j: abs(len(slow[i]) - len(slow[j])) < 40 and likeness(slow[i], slow[j]) >= 0.8)
    together = {}
    for i, c in got.items():  # what is joined belongs together
        assert together.setdefault(c, want[i]) == want[i] and c <= i
    pairs = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if want[i] == want[j]]
    assert np.mean([got[i] == got[j] for i, j in pairs]) >= 0.95
    assert got[len(texts) - 1] == got[len(texts) - 2] and got[len(texts) - 3] == got[len(texts) - 4]


def test_verified_within_a_group():
    rng = np.random.default_rng(4)
    texts = edited_texts(rng, 6, 10, 60)
    h, of = similar.shingles(*byte_view(pa.array(texts, pa.large_string())))
    sets, node = [h[a:b] for a, b in zip(of, of[1:])], np.arange(len(texts))
    block = rng.integers(0, 2, len(texts))
    slow = [slow_set(t) for t in texts]
    for across in (None, block):
        u, v = similar.verified(node, similar.majorities(h, of), sets, across)
        links = set(zip(u.tolist(), v.tolist()))
        got = slow_components(texts, lambda i, j: (i, j) in links)
        want = slow_components(texts, lambda i, j: likeness(slow[i], slow[j]) >= 0.8 and (across is None or block[i] != block[j]))
        same = lambda c: {(i, j) for i, j in itertools.combinations(range(len(c)), 2) if c[i] == c[j]}
        assert same(got) == same(want) and len(links) < len(texts)


def test_recall_of_pairs():
    rng = np.random.default_rng(6)
    texts = edited_texts(rng, 150, 2, 150)
    h, of = similar.shingles(*byte_view(pa.array(texts, pa.large_string())))
    fp, slow = similar.majorities(h, of), [slow_set(t) for t in texts]
    keys = similar.Keys()(*(fp[:, k].copy().view(np.int64) for k in (0, 1)))
    pairs = [(i, j) for b in range(150) for i, j in itertools.combinations(range(3 * b, 3 * b + 3), 2) if likeness(slow[i], slow[j]) >= 0.8]
    found = [(keys[i] == keys[j]).any() and int(np.bitwise_count(fp[i] ^ fp[j]).sum()) <= similar.NEAR for i, j in pairs]
    assert len(pairs) > 150 and np.mean(found) >= 0.9


def test_kept(spark, sf):
    docs = documents(spark, sf)
    kept = similar.keep_one(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter({r.component_id for r in similar.similar_components(docs).collect()})


def test_edges(spark, edge_docs, no_docs):
    got = {(r.doc_id, r.component_id) for r in similar.similar_components(edge_docs).collect()}
    assert got == {(1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (6, 6), (8, 8), (9, 3), (None, None)}
    clashing = edge_docs.selectExpr("*", "1 as gone", "2 as row", "3 as node", "4 as h", "5 as root", "6 as _kept", "7 as `x.y`")
    kept = similar.keep_one(clashing)
    assert kept.columns == clashing.columns
    assert Counter(r.doc_id for r in kept.collect()) == {1: 1, 3: 1, 5: 1, 6: 1, 8: 1, None: 1}
    assert similar.keep_one(no_docs).count() == 0
    a, b = "a clean text unlike any other here", "a second clean text, of its own"
    rows = [(None, a, 1), (None, a, 2), (None, b, 3), (7, "named text of its own", 4), (None, "named text of its own", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(3)
    assert sorted((r.doc_id or 0, r.text) for r in similar.keep_one(docs).collect()) == [(0, a), (0, b), (7, "named text of its own")]


@pytest.mark.parametrize("most", [1 << 15, 1 << 28])
def test_rows_told_apart(spark, monkeypatch, most):
    monkeypatch.setattr(common, "MOST_BITS", most)
    rows = spark.range(40_000).selectExpr("if(id % 1000 = 7, null, id) as id", "xxhash64(id) as x").repartition(3)
    known = spark.range(0, 40_000, 10).selectExpr("xxhash64(id) as key")
    perhaps, clear = common.told_apart(rows, F.when(F.col("id").isNotNull(), F.xxhash64("id")), known, Scratch(spark, "test"))
    one, other = perhaps.collect(), clear.collect()
    assert len(one) + len(other) == 40_000 and perhaps.columns == rows.columns
    assert {r.id for r in one} >= set(range(0, 40_000, 10)) and not {r.id for r in other} & set(range(0, 40_000, 10))
    assert len(one) < (8_000 if most > 1 << 15 else 12_000)
