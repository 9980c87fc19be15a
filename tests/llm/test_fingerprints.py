import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import fingerprints as fp
from quarry.llm.common import byte_view, documents


def of(*texts):
    return fp.digests(*byte_view(pa.array(texts, pa.large_string())))


def slow(rows):
    out = []
    for (doc, a), (_, b) in zip(rows, [*rows[1:], rows[0]], strict=True):
        half = len(a) // 2
        new = a[: len(a) - half] + b[:half]
        sets = [set(of(t)[0].tolist()) for t in (a, new, b)]
        like = [1 - len(sets[0] ^ s) / (len(sets[0]) + len(s)) if sets[0] or s else 1.0 for s in sets[1:]]
        out.append((doc, len(a), hashlib.sha256(new.encode()).hexdigest(), *np.round(like, 9).tolist()))
    return out


def got(docs):
    return [(r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in fp.document_fingerprints(docs).collect()]


def test_documents(spark, sf):
    docs = documents(spark, sf)
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    assert sorted(got(docs)) == slow(rows)
    found = fp.document_fingerprints(docs).collect()
    assert np.mean([r.near_edited for r in found]) > 0.35 > 0.15 > np.mean([r.near_next for r in found])


def test_equal_texts_have_equal_fingerprints(edge_docs):
    rows = fp.document_fingerprints(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add(r.fingerprint)
    assert by[1] == by[2] and len(by[2]) == 1 and by[3] == by[4] and by[1] != by[5]
    order = sorted(((r.doc_id, r.text or "") for r in edge_docs.collect()), key=lambda r: (r[0] is not None, r[0]))
    key = lambda r: (r[0] is not None, r)
    assert sorted(got(edge_docs), key=str) == sorted(slow(order), key=str)


def test_small_tables(spark, no_docs):
    assert fp.document_fingerprints(no_docs).count() == 0
    one = spark.createDataFrame([(5, "a b c d")], "doc_id long, text string")
    assert got(one) == slow([(5, "a b c d")])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(0, 2**64 - 1), max_size=60), st.sets(st.integers(0, 2**64 - 1), max_size=60), st.sets(st.integers(0, 2**64 - 1), max_size=60)), min_size=1, max_size=5))
def test_peeling_recovers_the_differences(pairs):
    def pack(sets):
        return np.array([x for s in sets for x in sorted(s)], np.uint64), np.concatenate([[0], np.cumsum([len(s) for s in sets])])

    a, b = [x | z for x, _, z in pairs], [y | z for _, y, z in pairs]
    k = np.arange(len(pairs))
    pair, value, side, _ = fp.differences(pack(a), k, pack(b), k)
    for i in k:
        mine = pair == i
        assert set(value[mine & (side == 1)].tolist()) == a[i] - b[i]
        assert set(value[mine & (side == -1)].tolist()) == b[i] - a[i]


def test_many_rows_without_or_with_one_doc_id(spark):
    """A third of all rows has no doc_id and a third has one: they are in several buckets, and each row has its follower."""
    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 else k, f"text {k * k} of a row\nline {k}\n" * (k % 4)) for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    placed = fp.following_texts(docs).collect()
    own = [r for r in placed if not r.guest]
    assert len(own) == 900 and len(placed) - 900 <= 64
    for doc in (None, 7):
        size = Counter(r.bucket for r in own if r.doc_id == doc)
        assert len(size) > 8 and max(size.values()) < 100
    order = sorted(own, key=lambda r: (r.key, r.h))
    assert Counter(got(docs)) == Counter(slow([(r.doc_id, r.text) for r in order]))


def test_buckets_against_counting(spark):
    rng = np.random.default_rng(3)
    cuts = sorted(set(map(tuple, rng.integers(-3, 4, (30, 2)).tolist())))
    rows = rng.integers(-5, 6, (400, 2))
    found = fp.bucket_of(rows[:, 0], rows[:, 1], *np.array(cuts).T)
    assert found.tolist() == [sum(c <= tuple(r) for c in cuts) for r in rows.tolist()]


def slow_digests(text):
    """Cells by the rule, cut one by one: at line ends, and before words whose first four bytes hash to 0 modulo CUT."""
    raw, cells, start = text.encode(), [], 0
    white = b"\t\n\x0b\x0c\r "
    for k in range(1, len(raw) + 1):
        word = k < len(raw) and raw[k - 1] in white and raw[k] not in white
        head = sum(b << 8 * i for i, b in enumerate(raw[k : k + 4]))
        if k == len(raw) or raw[k - 1] == 10 or (word and int(fp.mix64(np.array([head], np.uint64))[0]) % fp.CUT == 0):
            cells.append(raw[start:k].rstrip(white))
            start = k
    return Counter(c for c in cells if c)


def test_cells_against_cutting_one_by_one(spark, sf):
    texts = [r.text for r in documents(spark, sf).limit(60).collect()] + ["", "a", " a\n\nb b\n", "é ü\r\nx"]
    value, at = of(*texts)
    known = {}
    for k, t in enumerate(texts):
        cells = slow_digests(t)
        own = value[at[k] : at[k + 1]]
        assert len(own) == sum(cells.values()) == len(set(own.tolist()))
        for c in cells:  # equal cells have equal digests, in whatever text
            alone = of(c.decode())[0]
            if len(slow_digests(c.decode())) == 1 and not c[:1].isspace():
                assert known.setdefault(c, int(alone[0])) in own
