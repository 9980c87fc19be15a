import random
import re

from quarry.llm import license_scan as ls
from quarry.llm.common import documents

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def slow(text):
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    words = WORD.findall(low)
    at = []
    for n in ls.BASE:
        p = n.phrase.encode().split()
        at += [(i, n.label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def compare(docs):
    got = {}
    for r in ls.license_scan(docs).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
    for r in docs.collect():
        assert slow(r.text) in got[r.doc_id]
    assert sum(map(len, got.values())) == docs.count()


def test_documents(spark, sf):
    compare(documents(spark, sf))


def test_edges(edge_docs, no_docs):
    compare(edge_docs)
    assert ls.license_scan(no_docs).count() == 0


def test_fuzzy(spark):
    texts = [
        "Released UNDER the-MIT   License. cc by nc cc by nc",
        "released under teh MIT license today",
        "under the mitten license; apache licence version 2; Apache License, Version 2.0",
        "xcc by nc ccby nc",
        "unter den linden",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    compare(docs)
    got = {r.doc_id: r for r in ls.license_scan(docs).collect()}
    assert got[0].base_labels == "cc-by-nc,mit" and got[0].n_base == 3
    assert got[1].labels == "mit" and got[1].base_labels == "" and 0.8 < got[1].score < 1
    assert {s.edits for s in got[2].spans} == {0, 1} and got[2].labels == "apache-2"
    assert got[3].labels == "" and got[4].labels == ""


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


def slow_labels(text):
    """Of all spans of words those within a notice's edits that hold what tells it."""
    words = WORD.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))
    out = set()
    for n in ls.BASE + ls.ADDED:
        phrase = n.phrase.encode()
        for i in range(len(words)):
            for k in range(1, len(phrase.split()) + n.edits + 1):
                span = b" ".join(words[i : i + k])
                if i + k <= len(words) and abs(len(span) - len(phrase)) <= n.edits:
                    if span == phrase or n.edits and re.search(n.telling.encode(), b" " + span + b" ") and distance(span, phrase) <= n.edits:
                        out.add(n.label)
    return ",".join(sorted(out))


def test_labels_against_all_spans(spark):
    rng = random.Random(3)
    texts = []
    for n in ls.BASE + ls.ADDED:
        for _ in range(40):
            chars = list(n.phrase)
            for _ in range(rng.randint(0, n.edits + 2)):
                at = rng.randrange(len(chars))
                chars[at : at + rng.randint(0, 1)] = rng.choice(["", "x", " ", "e", "2", "m"])
            texts.append(f"{rng.choice(['', 'see ', 'version 2 of '])}{''.join(chars)}{rng.choice(['', ' 0', ' text', '.'])}")
    texts += [" ".join(rng.sample(texts, 5)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.labels for r in ls.license_scan(docs).collect()}
    wrong = [(t, got[i], slow_labels(t)) for i, t in enumerate(texts) if got[i] != slow_labels(t)]
    assert not wrong, wrong[:5]


def test_rivals(spark):
    texts = {
        "released under the MPL license": "",
        "released under the bit license": "",
        "released under the mit-0 license": "",
        "released under the x mit license": "",
        "released under the mit a license": "",
        "released under the mit-licence": "mit",
        "Apache License, Version 1.1": "",
        "apache license version 1": "",
        "apache license version 3": "",
        "apache licence version 2.0": "apache-2",
        "GNU General Public Licence": "gpl",
        "a general public license": "",
        "Eclipse Public License": "",
        "Mozila Public License": "mpl",
        "creative commons attribution commercial": "",
        "Creative Commons Attribution-NonCommercial": "cc-by-nc",
        "creative commons attribution non-commercial": "cc-by-nc",
        "permission is hereby granted, free of charge": "mit",
        "permission is hereby denied free of charge": "",
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.labels for r in ls.license_scan(docs).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts.values())


def test_a_text_full_of_near_notices(spark):
    docs = spark.createDataFrame([(1, "under teh mit license " * 20_000)], "doc_id long, text string")
    row = ls.license_scan(docs).collect()[0]
    assert row.labels == "mit" and row.n_base == 0 and len(row.spans) == 20_000
