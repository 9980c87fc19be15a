import itertools
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from quarry.llm import simhash
from quarry.llm.common import Scratch, documents
from quarry.llm.components import connected_components


def slow_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(ids, fps, pairs=()):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(ids)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 3 or ids[i] == ids[j] is not None:
            root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(ids))]


def compare(docs):
    rows = docs.collect()
    fps = [slow_fingerprint(r.text) for r in rows]
    want = Counter(zip([r.doc_id for r in rows], [f"{f:016x}" for f in fps], slow_components([r.doc_id for r in rows], fps), strict=True))
    assert Counter(map(tuple, simhash.simhash_components(docs).collect())) == want


def test_documents(spark, sf):
    compare(documents(spark, sf))


def test_edges(edge_docs, no_docs):
    compare(edge_docs)
    assert simhash.simhash_components(no_docs).count() == 0


def test_cycle_covers_all_errors():
    for errors in itertools.product(range(4), repeat=4):
        if sum(errors) <= 3:
            assert any(errors[i] == 0 and errors[(i + 1) % 4] <= 1 for i in range(4))


def test_neighbours_share_a_key():
    keys = [set(k[k >= 0]) for k in simhash.segment_keys()]
    rng = np.random.default_rng(0)
    for w in rng.integers(0, 65536, 500):
        for bit in range(16):
            assert keys[w] & keys[w ^ (1 << bit)]


@pytest.mark.parametrize("block", [4, 2048])
def test_links_of_close_values(spark, block):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.int64)
    fps = {int(b) for b in base}
    for b in base[:20]:
        for _ in range(30):
            b = int(b)
            for bit in rng.integers(0, 62, rng.integers(1, 4)):
                b ^= 1 << int(bit)
            fps.add(b)
    fps = sorted(fps)
    points = spark.createDataFrame([(f,) for f in fps], "fp long")
    scratch = Scratch(spark, "test")
    got = {r.node: r.root for r in connected_components(simhash.links(points, scratch, block), scratch).collect()}
    want = slow_components(fps, fps)
    assert [got.get(f, f) for f in fps] == want
