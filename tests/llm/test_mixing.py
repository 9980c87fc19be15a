import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest

from quarry.llm import mixing
from quarry.llm.common import Scratch, documents


def weights(tokens, alpha):
    w = {s: t**alpha for s, t in tokens.items()}
    z = sum(w.values())
    return {s: x / z for s, x in w.items()}


def slow(unit, alpha, budget):
    """The mix, given the exponent: {(doc_id, source, block)} with multiplicities."""
    tokens = Counter()
    for u in unit:
        tokens[u.source] += u.n_tokens
    tokens = {s: t for s, t in tokens.items() if t}
    total = sum(tokens.values())
    goal = {s: math.floor(w * budget + 1e-6) for s, w in weights({s: t / total for s, t in tokens.items()}, alpha).items()}
    out = []
    for s, t in tokens.items():
        own = [u for u in unit if u.source == s]
        for block in range(goal[s] // t + 1):
            key = lambda u: (hashlib.md5(f"mix:{block}:{'' if u.doc_id is None else u.doc_id}:{u.digest}".encode()).hexdigest(), u.doc_id)  # noqa: B023, E731
            upto = 0
            for u in sorted(own, key=key):
                upto += u.n_tokens
                if block < goal[s] // t or upto <= goal[s] % t:
                    out.append((u.doc_id, s, block, round((block * t + upto - u.n_tokens) / goal[s], 9)))
    return out


def compare(spark, docs, **how):
    scratch = Scratch(spark, "test")
    unit = scratch.save(mixing.units(docs))
    rows = unit.collect()
    _, alpha = mixing.plan(unit, scratch=scratch, **how)
    budget = how.get("budget") or sum(u.n_tokens for u in rows)
    got = [(r.doc_id, r.source, r.block, round(r.at, 6)) for r in mixing.mixture(docs, **how).collect()]
    want = [(*r[:3], round(r[3], 6)) for r in slow(rows, alpha, budget)]
    assert Counter(got) == Counter(want)
    return rows, alpha, got


def test_documents(spark, sf):
    docs = documents(spark, sf)
    rows, alpha, got = compare(spark, docs)
    text = {r.doc_id: r for r in docs.collect()}
    assert all(u.n_tokens == len(re.findall(r"\S+", text[u.doc_id].text)) for u in rows if text[u.doc_id].text.isascii())
    kept = Counter((r.doc_id, r.source) for r in mixing.resampled(docs).collect())
    assert kept == Counter((d, s) for d, s, _, _ in got)
    assert mixing.resampled(docs).columns == docs.columns


@pytest.mark.parametrize(("entropy", "repeats"), [(0.95, 100.0), (0.999, 2.0), (0.2, 4.0)])
def test_targets(spark, entropy, repeats):
    sizes = {"a": 400, "b": 90, "c": 30, None: 12}
    docs = spark.createDataFrame([(k * 1000 + i, "w " * (1 + i % 5), s, "x") for k, (s, n) in enumerate(sizes.items()) for i in range(n)], "doc_id long, text string, source string, digest string")
    rows, alpha, got = compare(spark, docs, entropy=entropy, repeats=repeats)
    tokens = defaultdict(int)
    for u in rows:
        tokens[u.source] += u.n_tokens
    total = sum(tokens.values())
    w = weights({s: t / total for s, t in tokens.items()}, alpha)
    h = -sum(x * math.log(x) for x in w.values()) / math.log(4)
    most = max(w[s] * total / t for s, t in tokens.items())
    assert most <= repeats + 1e-4
    if alpha < 1:
        assert h == pytest.approx(entropy, abs=1e-4) if most < repeats - 1e-3 else h <= entropy + 1e-4
    else:
        assert h >= entropy
    mixed = Counter(r.source for r in mixing.resampled(docs, entropy, repeats).collect())
    assert mixed == Counter(s for _, s, _, _ in got)
    assert mixing.resampled(docs).columns == docs.columns


def test_edges(spark, edge_docs, no_docs):
    docs = edge_docs.withColumnRenamed("lang", "source")
    compare(spark, docs)
    assert mixing.resampled(docs).columns == docs.columns
    assert mixing.mixture(no_docs).count() == 0 and mixing.resampled(no_docs).count() == 0


@pytest.mark.parametrize("how", [{"repeats": 1.0}, {"budget": 5000}, {"budget": 100}, {"budget": 10}, {"repeats": 1.0, "budget": 600}])
def test_limits_that_hold_just_below_exponent_one(spark, how):
    sizes = {"a": 400, "b": 90, "c": 30, "d": 12}
    docs = spark.createDataFrame([(k * 1000 + i, "w", s) for k, (s, n) in enumerate(sizes.items()) for i in range(n)], "doc_id long, text string, source string")
    rows = mixing.mixture(docs, **how).collect()
    repeats = how.get("repeats", mixing.REPEATS)
    assert 0 < len(rows) <= min(how.get("budget", 532), repeats * 532)
    assert max(Counter(r.doc_id for r in rows).values()) <= math.ceil(repeats)


def test_clashing_columns(spark, sf):
    names = ["blocks", "cut", "copies", "copy", "row", "_source", "_copies", "digest", "h"]
    docs = documents(spark, sf).selectExpr("*", *(f"cast(doc_id as string) as `{n}`" for n in names))
    out = mixing.resampled(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert rows and all(r[n] == str(r.doc_id) for r in rows for n in names)


def test_sources_without_tokens_have_no_share(spark):
    docs = spark.createDataFrame([(1, "a b c", "x"), (2, "", "y"), (3, None, "y")], "doc_id long, text string, source string")
    assert {r.doc_id for r in mixing.resampled(docs).collect()} == {1}
