from itertools import permutations

import duckdb
import pytest

from quarry.llm import filter_audit
from quarry.llm.oracles import FILTER_AUDIT

LABELS = "doc_id long, quality int, toxic int"


def slow(rows, labels):
    """By the definition, document by document."""
    rows = [(i, t or "", p or "") for i, t, p in rows]
    masks = []
    for i, text, part in rows:
        words = text.encode().split()
        capitals = sum("A" <= c <= "Z" for c in text)
        copy = any(i is not None and j is not None and j < i and u == text for j, u, _ in rows)
        fails = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * capitals > 2 * len(text), any(c in text for c in "#$%&*|"), copy]
        own = [x for x in labels if i is not None and x[0] == i]
        masks.append((part, dict(zip("ABCDE", fails, strict=True)), any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out, removals = {}, {}
    for part in {m[0] for m in masks}:
        for order in permutations("ABCDE"):
            left = [m for m in masks if m[0] == part]
            for step, letter in enumerate(order, 1):
                gone = [m for m in left if m[1][letter]]
                left = [m for m in left if not m[1][letter]]
                everyone = [m for m in masks if m[0] == part and m[1][letter]]
                alone = [m for m in everyone if sum(m[1].values()) == 1]
                out[part, "".join(order), step] = [len(left), len(gone), len(everyone) - len(gone), len(alone), sum(m[2] for m in gone), sum(m[3] for m in gone)]
                removals[part, letter] = removals.get((part, letter), 0) + len(gone)
    return {(*k, *v, removals[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


LONG = " ".join(f"word{k}" for k in range(300))
#: Lengths at the blocks' ends, texts that differ in their last code point, copies over parts, capitals, marks.
DOCS = [
    (1, LONG, "a"), (2, LONG, "b"), (3, LONG + "x", "a"), (4, LONG + "y", "a"), (5, "é" * 64, "a"), (6, "é" * 63 + "e", "a"), (7, "é" * 64, None),
    (8, "AB " * 400, "b"), (9, "ab " * 400, "b"), (10, "ab " * 400, ""), (11, "50 % off", "c"), (12, "x" * 1024 + "a", "c"), (13, "x" * 1024 + "b", "c"),
    (14, "x" * 1024 + "a", "c"), (15, "", "c"), (16, None, "c"), (None, LONG, "a"), (None, None, None), (2, LONG, "b"), (17, "a\x1cb\x85c\xa0d", "c"), (18, LONG.replace("word", "Word") + " " + LONG, "c"),
]


@pytest.mark.parametrize("bits", [64, 1])
def test_equals_the_definition(spark, bits):
    labels = [(1, 1, 0), (2, 0, 1), (4, 1, 1), (4, 0, 0), (8, None, 1), (None, 1, 1), (99, 1, 1)]
    docs = spark.createDataFrame([(*r, 1) for r in DOCS], "doc_id long, text string, source string, mask int").repartition(5)
    got = filter_audit.audit(docs, spark.createDataFrame(labels, LABELS), bits=bits).collect()
    assert len(got) == 4 * 600
    assert {tuple(r) for r in got} == slow(DOCS, labels)


def test_a_group_of_copies_and_hot_lengths(spark):
    rows = [(k, "same text" if k % 3 else f"text {k:05}", "s") for k in range(3000)]
    got = filter_audit.audit(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(16), spark.createDataFrame([], LABELS))
    row = got.where("filter_order = 'EABCD' and step = 1").first()
    assert (row["kept"], row["removed"], row["redundant"], row["good_lost"]) == (1001, 1999, 0, 0)


def test_edge_cases(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([], LABELS)
    assert filter_audit.audit(no_docs, labels).count() == 0
    rows = [(r["doc_id"], r["text"], None) for r in edge_docs.collect()]
    got = filter_audit.audit(edge_docs.withColumn("source", edge_docs["lang"].substr(9, 1)), labels)
    assert {tuple(r) for r in got.collect()} == slow(rows, [])


def test_sql_agrees_on_the_cases(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR); CREATE TABLE labels (doc_id BIGINT, quality INT, toxic INT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", DOCS)
    con.execute("INSERT INTO labels VALUES (1, 1, 0), (4, 1, 1)")
    assert set(con.execute(FILTER_AUDIT).fetchall()) == slow(DOCS, [(1, 1, 0), (4, 1, 1)])
