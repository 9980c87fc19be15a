import zlib
from hashlib import sha256

import duckdb
import pytest

from quarry.llm import merkle
from quarry.llm.oracles import MANIFEST

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][k : k + 16]) for k in range(0, len(out[-1]), 16)])
    return out


def way(levels, place):
    """(digests before, digests after) of each run on the way up."""
    out = []
    for level in levels[:-1]:
        first = place - place % 16
        out.append((level[first:place], level[place + 1 : first + 16]))
        place //= 16
    return out


def lowered(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def slow(rows):
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        own = sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[s] = (own, levels_of([leaf_of(r) for r in own]))
    top = levels_of([trees[s][1][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        own, levels = trees[s]
        for place, row in enumerate(own):
            path = way(levels, place) + way(top, k)
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            node = leaf_of((*row[:4], lowered(row[4]))) if hit else leaf_of(row)
            for before, after in path:
                node = digest(*before, node, *after)
            proof = digest(*(x for before, after in path for x in before + after))
            out.append((row[0], leaf_of(row), levels[-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(out, key=str)


CASES = {
    "sizes": [(k, f"s{n:02}", "en", k, f"Text {k}") for n in (1, 2, 15, 16, 17, 33, 256, 257) for k in range(1000 * n, 1000 * n + n)],
    "many sources": [(k, f"source {k}", None, None, "ABC") for k in range(300)],
    "one row": [(5, None, None, None, None)],
    "edges": [
        (None, "a", "en", 1, "X"), (None, None, None, None, None), (1, "", "en", 2, ""), (1, None, "en", 2, None), (2, "é", "-", -7, "ÀÉ ABC\nİ"),
        (2, "é", "-", -7, "ÀÉ ABC\nİ"), (2, "é", "en", 3, "other"), (3, "z", "1:", 10**15, "long " * 50_000), (-4, "Z", "en", 0, "A:1-"), (10, "z", "en", 0, "NOTHING"), (15, "\U0001f642", "en", 0, "Q"), (20, "￿", "en", 0, "q"),
    ],
    "copies": [(7, "hot", "en", 1, "same")] * 700 + [(k, "hot", "en", 1, "other") for k in range(40)],
}


@pytest.mark.parametrize("case", sorted(CASES))
def test_equals_the_definition(spark, case):
    rows = CASES[case]
    docs = spark.createDataFrame([(*r, "x", 9) for r in rows], SCHEMA + ", leaf string, n int").repartition(6)
    got = merkle.manifest(docs).drop("siblings")
    assert sorted(map(tuple, got.collect()), key=str) == slow(rows)


def test_siblings_prove_a_leaf(spark):
    rows = CASES["sizes"]
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(digest(r["siblings"]) == r["proof_sha256"] and len(r["siblings"]) % 64 == 0 for r in got)
    assert {r["verified"] for r in got} == {True, False}


def test_empty_table(spark, no_docs):
    assert merkle.manifest(no_docs).count() == 0


@pytest.mark.parametrize("case", ["sizes", "many sources", "edges"])
def test_sql_agrees(case):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, source VARCHAR, lang VARCHAR, n_chars BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", CASES[case])
    assert sorted(con.execute(MANIFEST).fetchall(), key=str) == slow(CASES[case])
