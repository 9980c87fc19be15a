import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm import packing
from quarry.llm.common import documents


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))


def check(rows, texts, tokenizer, capacity=4096):
    want = []
    for doc, text in texts:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        want += [(doc, k, a, len(p := ids[a : a + capacity]), zlib.crc32(np.array(p, "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), capacity))]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted((tuple(r)[:5] for r in rows), key=key) == sorted(want, key=key)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for off, n in sorted(b):
            assert off == at
            at += n
        assert at <= capacity
    return len(bins), -(-sum(r.length for r in rows) // capacity)


def test_documents(spark, sf, tokenizer):
    docs = documents(spark, sf)
    n, bound = check(packing.pack(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()], tokenizer)
    assert n <= bound + 1


def test_edges(spark, edge_docs, no_docs, tokenizer):
    check(packing.pack(edge_docs).collect(), [(r.doc_id, r.text) for r in edge_docs.collect()], tokenizer)
    assert packing.pack(no_docs).count() == 0


@pytest.mark.parametrize("text", ["it's we'LL 'd ''s don''t", "a\x1cb\x85c\xa0d", "x²³ ¼ µm ÀÉÎ ß Ÿ İ Σς", "<|endoftext|> a", "a<|startoftext|>B <|endoftext| <|EndOfText|>", "12 345,6%%% --'re"])
def test_remembered_words_equal_the_tokenizer(tokenizer, text):
    ids = packing.Ids(public_tokenizers.path(packing.TOKENIZER))
    assert list(np.frombuffer(ids(text), "<u4")) == tokenizer.encode(text, add_special_tokens=False).ids


def test_special_tokens_are_read_as_such():
    ids = packing.Ids(public_tokenizers.path(packing.TOKENIZER))
    assert np.frombuffer(ids("<|endoftext|> a"), "<u4").tolist() == [49407, 320]


def slow_best(room, pieces):
    sums = {0}
    for p in pieces:
        sums |= {x + p for x in sums if x + p <= room}
    return max(sums)


@pytest.mark.parametrize("seed", range(8))
def test_fillings_waste_the_least(seed):
    rng = np.random.default_rng(seed)
    sizes = np.sort(rng.choice(np.arange(3, 60), rng.integers(1, 8), replace=False))[::-1].astype(np.int64)
    counts = rng.integers(1, 5, len(sizes))
    for room in range(0, 130, 3):
        filling = packing.completion(room, sizes, counts)
        assert all(filling.count(k) <= counts[k] for k in range(len(sizes)))
        assert sum(int(sizes[k]) for k in filling) == slow_best(room, np.repeat(sizes, counts).tolist())


def least_bins(pieces, capacity):
    """By trying all placements, large pieces first."""
    pieces, best = sorted(pieces, reverse=True), [len(pieces)]

    def place(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(pieces):
            best[0] = len(rooms)
            return
        for at in {r: i for i, r in enumerate(rooms) if r >= pieces[k]}.values():
            place(k + 1, [*rooms[:at], rooms[at] - pieces[k], *rooms[at + 1 :]])
        place(k + 1, [*rooms, capacity - pieces[k]])

    place(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(12))
def test_few_pieces_against_all_placements(seed):
    rng = np.random.default_rng(seed)
    pieces = rng.integers(5, 60, 11).tolist()
    histogram = {int(p): pieces.count(p) for p in set(pieces)}
    got, least = sum(t for t, _ in packing.plan(histogram, 100)), least_bins(pieces, 100)
    assert packing.least_sequences(histogram, 100) <= least == got


def test_bin_completion_beats_best_fit():
    """Pieces cut from full bins: best fit needs more, the search over bins finds the cut again."""
    rng, better, proven = np.random.default_rng(11), 0, 0
    for _ in range(30):
        pieces = [int(x) for _ in range(8) for x in np.diff([0, *sorted(rng.choice(np.arange(15, 86), 2, replace=False)), 100])]
        histogram = {p: pieces.count(p) for p in set(pieces)}
        fit = sum(t for t, _ in packing.filled(histogram, 100, lambda *a: packing.best_fit(*a)[0]))
        found = packing.improved(histogram, 100, fit, 8)
        if found is not None:
            count = defaultdict(int)
            for times, sizes in found:
                assert sum(sizes) <= 100
                for s in sizes:
                    count[s] += times
            assert dict(count) == histogram and sum(t for t, _ in found) < fit
            better += 1
        proven += sum(t for t, _ in packing.plan(histogram, 100)) == 8
    assert better >= 10 and proven >= 25


@pytest.mark.parametrize("seed", range(6))
def test_fillings_are_undominated(seed):
    rng = np.random.default_rng(seed)
    sizes = np.sort(rng.choice(np.arange(3, 40), 6, replace=False))[::-1].astype(np.int64)
    counts = rng.integers(1, 3, 6)
    room = int(rng.integers(30, 80))
    got = packing.fillings(room, sizes, counts, 0)
    sums = [sum(int(sizes[k]) for k in f) for f in got]
    assert got and sums == sorted(sums, reverse=True) and max(sums) == slow_best(room, np.repeat(sizes, counts).tolist())
    for f, total in zip(got, sums, strict=True):
        free = [int(sizes[k]) for k in range(6) if counts[k] > f.count(k)]
        assert all(f.count(k) <= counts[k] for k in range(6)) and all(total + x > room for x in free)


def test_plan_holds_every_piece():
    rng = np.random.default_rng(1)
    histogram = {int(s): int(n) for s, n in zip(rng.integers(1, 100, 60), rng.integers(1, 9, 60), strict=True)} | {100: 7}
    bins = packing.plan(histogram, 100)
    count = defaultdict(int)
    for times, sizes in bins:
        assert sum(sizes) <= 100
        for s in sizes:
            count[s] += times
    assert dict(count) == histogram
    assert sum(t for t, _ in bins) <= packing.least_sequences(histogram, 100) + 2
    assert packing.plan({}, 100) == []


def test_equal_rows_have_salts_of_their_own(spark):
    pieces = spark.range(20_000).selectExpr("1L AS doc_id", "0 AS piece", "0L AS start", "7L AS length", "5L AS ids_crc32", "id AS row").repartition(4)
    rows = packing.ranked(pieces, "length", 1_000_000).persist()
    assert sorted(r.rank for r in rows.select("rank").collect()) == list(range(20_000))
    salt = rows.select(F.pmod(F.xxhash64("doc_id", "piece", "row"), F.lit(50)).alias("s")).groupBy("s").count()
    assert salt.count() == 50 and salt.agg(F.max("count")).first()[0] < 600


def test_a_batch_is_learned_at_once(tokenizer, monkeypatch):
    """New runs of all texts go to the tokenizer together, not text by text; the ids stay."""
    texts = ["It's a-b new, word", "", "it's anouwh a-b", "ÀÉ <|endoftext|>", "x²³ ¼ µm ª", "Σς word", *(f"w{k} zq{k}x, 'd{k}" for k in range(600))]
    ids = packing.Ids(public_tokenizers.path(packing.TOKENIZER))
    calls, learn = [], ids._encode_words
    monkeypatch.setattr(ids, "_encode_words", lambda words: calls.append(words) or learn(words))
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in ids.many(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [bool(c) for c in calls] == [True, False]
