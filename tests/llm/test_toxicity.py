from itertools import combinations
from zlib import crc32

import numpy as np

from quarry.llm import toxicity as tx
from quarry.llm.common import documents


def slow_kernel(a, b):
    def features(w):
        out = {}
        for i, j, k in combinations(range(len(w)), 3):
            if k - i < tx.SPAN and all(tx.letter_codes(w[x])[0] > 0 for x in (i, j, k)):
                f = w[i] + w[j] + w[k]
                out[f] = out.get(f, 0) + tx.DECAY ** (k - i - 2)
        return out

    fa, fb = features(a), features(b)
    dot = lambda x, y: sum(v * y.get(k, 0) for k, v in x.items())
    n = dot(fa, fa) * dot(fb, fb)
    return (dot(fa, fb) / n**0.5) ** tx.POWER if n else 0.0


def test_kernel_against_all_triples():
    landmarks = ["idiot", "trash", "worthless"]
    vocabulary = ["idiot", "i.d.i.o.t", "idxiot", "ab", "", "trashh", "hsart", "worthlessnessless"]
    got = tx.Comparison(landmarks)(vocabulary)
    want = [[slow_kernel(w, m) for m in landmarks] for w in vocabulary]
    assert np.allclose(got, want, atol=1e-5)
    assert got[1, 0] > 0.5 and got[2, 0] > 0.1 and got[6, 1] < 0.05


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = tx.query(spark, sf).collect()
    assert len(rows) == documents(spark, sf).count()
    held = [r for r in rows if r.held_out and r.doc_id in toxic]
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    hit = [r.predicted for r in held if toxic[r.doc_id]]
    false = [r.predicted for r in held if not toxic[r.doc_id]]
    assert np.mean(hit) > 0.8 and np.mean(false) < 0.02


def test_gapped_insults():
    rng = np.random.default_rng(0)
    filler = ["".join(rng.choice(list("abcdefghilmnoprstu"), 6)) for _ in range(400)]
    text = lambda *w: " ".join([*rng.choice(filler, 40), *(x for v in w for x in (v, *rng.choice(filler, 3))), *rng.choice(filler, 40)])
    bad = ["idiot", "moron", "worthless"]
    texts = [text(bad[k % 3], bad[(k + 1) % 3]) for k in range(150)] + [text() for _ in range(450)]
    order = rng.permutation(600)
    machine = tx.train([texts[i] for i in order], (order < 150).astype(np.int64), 0.25)
    clean = machine.scores([text() for _ in range(100)])
    assert (clean < 0.3).mean() > 0.95
    score = machine.scores([text(w, v) for w, v in (("idiot", "MORON"), ("i.d.i.o.t", "m-oron"), ("i d i o t", "m o r o n"), ("i--d--i--o--t", "m**o**r**o**n"), ("i  d  i  o  t", "m  o  r  o  n"), ("wor*thl*ess", "idxiot"))])
    assert (score > np.quantile(clean, 0.95)).all(), (score, clean)
    assert score[0] >= 0.3


def test_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 0, 1), (5, 1, 0), (None, 1, 1), (8, 1, None)], "doc_id long, quality int, toxic int")
    rows = tx.toxicity(edge_docs, tx.fit(edge_docs, labels)).collect()
    assert len(rows) == edge_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (3, 4, 9)}) == 1
    assert tx.fit(no_docs, labels) is None and tx.fit(edge_docs, labels.limit(0)) is None
    assert tx.toxicity(no_docs, None).count() == 0
