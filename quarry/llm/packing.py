"""Best-fit packing of tokenised documents into sequences, by bin completion.

Documents are tokenised where they lie; only one row per piece (its length, a checksum) goes on. Pieces are packed by
length: the histogram of lengths has at most ``capacity`` rows whatever the corpus, and is solved on the driver. The
best-fit solution is the first incumbent; where it has more sequences than the lower bound ``least_sequences``, bin
completion looks for a better one: the largest piece left and each undominated filling of the room beside it are a
branch, bins are completed one after the other, a branch is cut by the waste that a better packing may have in all, and
the search goes back to the last bin with another filling. It ends at the lower bound, when nothing is left to search,
or after ``NODES`` nodes; what stands then is the best packing found.

The plan deals ranks within a length to places. Ranks come from salted row numbers plus the salts' running counts, so
a length that holds a third of all pieces is spread over tasks.

Null and empty texts are documents of one token (id 1). Repeated rows are packed each for itself. An empty table gives
an empty one. Other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import Scratch, column, documents, held_by_worker, id_and_text, shuffle_partitions, small_batches

CAPACITY = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Distinct words, and runs of them without white space, whose ids a worker remembers.
REMEMBERED = 500_000

#: Fillings of a bin, steps to find them, nodes of the search over bins, and pieces up to which a filling is made once a node.
FILLINGS, LOOKS, NODES, FEW = 32, 2000, 300, 400

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Words of a lower-case text in Latin-1, as the tokenizer's pre-tokenizer splits them.
_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^ \t\n\r\x0b\x0ca-zªµºß-öø-ÿ0-9²³¹¼½¾]+")
#: Characters on whose class (white space or not) regular-expression libraries differ.
_UNSURE = re.compile("[\x1c-\x1f\x85\xa0]")


class Ids:
    """Ids of a text as little-endian 32-bit bytes.

    The tokenizer splits a text into words before anything else and treats each word alone, so the ids of words, and of
    what stands between white space, are remembered. Texts beyond Latin-1, with characters of unsure class or with special tokens go to the tokenizer whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, k in self.tokenizer.get_vocab().items():
            ends[k] = token.endswith("</w>")
        self.ends = ends  # ids that end a word

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word: many are encoded as one text, which costs far less, and told apart by the ids that end words."""
        out: list[bytes] = []
        parts = [words[k : k + 512] for k in range(0, len(words), 512)]
        for part, found in zip(parts, self.tokenizer.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(part) and cuts[-1] == len(ids):
                raw, at = ids.tobytes(), [0, *(4 * cuts).tolist()]
                out += [raw[a:b] for a, b in zip(at, at[1:], strict=False)]
            else:
                out += self._encode(part)
        return out

    def whole(self, text: str) -> bytes:
        return self._encode([text])[0]

    def _is_plain(self, text: str) -> bool:
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return False
        return not (_UNSURE.search(text) or any(t in text for t in self.special))

    def __call__(self, text: str) -> bytes:
        return self.many([text])[0]

    def many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. Runs that are new in any of them are learned at once, before any is put together."""
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        runs = [t.lower().split() if self._is_plain(t) else None for t in texts]  # no word has white space
        new: dict[str, None] = {}
        for own in runs:
            new.update(dict.fromkeys([r for r in own or () if r not in known]))
        self._learn(list(new))
        look = known.__getitem__
        return [self.whole(t) if own is None else b"".join(map(look, own)) for t, own in zip(texts, runs, strict=True)]

    def _learn(self, runs: list[str]) -> None:
        """Remembers the ids of new runs and of the words in them."""
        known = self.known
        words = dict.fromkeys([r for r in runs if r.isalpha()])  # letters alone are one word
        parts = [(r, _WORDS.findall(r)) for r in runs if not r.isalpha()]
        words.update(dict.fromkeys([w for _, ws in parts for w in ws if w not in known]))
        new = list(words)
        known.update(zip(new, self._encode_words(new), strict=True))
        known.update([(r, b"".join([known[w] for w in ws])) for r, ws in parts if r not in words])


def tokenized_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of each document's ids, one row each."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = held_by_worker(f"packing {path}", lambda: Ids(path))
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc, raw in zip(column(batch, "doc_id").to_pylist(), ids.many(column(batch, "text").to_pylist()), strict=True):
                raw += end
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return id_and_text(docs).mapInArrow(run, PIECES)


def best_fit(room: int, sizes: np.ndarray, counts: np.ndarray) -> tuple[list[int], int]:
    """Positions in ``sizes`` (falling) of the best-fit filling: the largest piece that fits, again and again; and its waste."""
    out: list[int] = []
    at, left = 0, room
    while (at := max(at, int(np.searchsorted(-sizes, -left)))) < len(sizes):
        times = min(int(counts[at]), left // int(sizes[at]))
        out += [at] * times
        left -= times * int(sizes[at])
        at += 1
    return out, left


def reachable(room: int, sizes: np.ndarray, counts: np.ndarray) -> list[int]:
    """For each position the sums up to ``room`` that pieces from there on can have: bit n is set if n is one."""
    mask = (1 << (room + 1)) - 1
    out, sums = [1] * (len(sizes) + 1), 1
    for k in range(len(sizes) - 1, -1, -1):
        size, left, part = int(sizes[k]), min(int(counts[k]), room // int(sizes[k])), 1
        while left:  # 1, 2, 4, ... pieces at once, and the rest: all numbers up to the count
            part = min(part, left)
            sums |= sums << (size * part) & mask
            left, part = left - part, 2 * part
        out[k] = sums
    return out


def completion(room: int, sizes: np.ndarray, counts: np.ndarray) -> list[int]:
    """Positions in ``sizes`` (falling) of a filling of ``room`` with the least waste there is.

    The best-fit filling is the incumbent. The search branches on how many pieces of the largest size, then of the next,
    are taken, more first, so that no filling comes after one that it dominates. Its waste bound is exact: the sums that
    the pieces left can still reach. So a branch that can't reach the least waste is never entered, no other is left
    again, and no limit on the search is needed.
    """
    best, waste = best_fit(room, sizes, counts)
    if not waste:
        return best
    first = int(np.searchsorted(-sizes, -room))
    sizes, counts = sizes[first:], counts[first:]
    sums = reachable(room, sizes, counts)
    left = sums[0].bit_length() - 1  # the fullest filling
    if left == room - waste:
        return best
    out: list[int] = []
    for k, size in enumerate(sizes.tolist()):
        times = min(int(counts[k]), left // size)
        while not sums[k + 1] >> (left - times * size) & 1:
            times -= 1
        out += [first + k] * times
        left -= times * size
    return out


def least_sequences(histogram: dict[int, int], capacity: int = CAPACITY) -> int:
    """No packing has fewer: pieces over half need a sequence each, and others of k or more fit only in what those leave."""
    best = 0
    for k in range(capacity // 2 + 1):
        alone = sum(n for s, n in histogram.items() if s > capacity - k)
        large = [(s, n) for s, n in histogram.items() if capacity // 2 < s <= capacity - k]
        room = sum(n * (capacity - s) for s, n in large)
        small = sum(s * n for s, n in histogram.items() if k <= s <= capacity // 2)
        best = max(best, alone + sum(n for _, n in large) + max(0, -(-(small - room) // capacity)))
    return best


def filled(histogram: dict[int, int], capacity: int, fill: Callable[[int, np.ndarray, np.ndarray], list[int]]) -> list[tuple[int, list[int]]]:
    """(repetitions, lengths in order): the longest piece left and its ``fill``, as often as the counts allow, and so on."""
    left = {s: n for s, n in histogram.items() if n}
    out = [(left.pop(capacity), [capacity])] if capacity in left else []
    sizes = np.array(sorted(left, reverse=True), np.int64)
    counts = np.array([left[int(s)] for s in sizes], np.int64)
    while len(sizes):
        counts[0] -= 1
        bin_ = [0, *fill(capacity - int(sizes[0]), sizes, counts)]
        counts[0] += 1
        need = np.bincount(bin_, minlength=len(sizes))
        times = int((counts[need > 0] // need[need > 0]).min())
        out.append((times, [int(sizes[k]) for k in bin_]))
        counts -= times * need
        keep = counts > 0
        if not keep.all():
            sizes, counts = sizes[keep], counts[keep]
    return out


def fillings(room: int, sizes: np.ndarray, counts: np.ndarray, least: int) -> list[list[int]]:
    """Undominated fillings of ``room`` (positions in ``sizes``, falling) with a sum of ``least`` or more, the fullest first.

    A filling is dominated if another piece still fits, or if a piece that is left can take the place of a smaller one, or
    of two that together are no larger: these pack wherever that piece would have. Sums that the pieces left can't
    reach are not looked for. FILLINGS are taken at most, those with large pieces first, and LOOKS steps are made.
    """
    sums, found = reachable(room, sizes, counts), []
    values, has = sizes.tolist(), counts.tolist()

    rising = values[::-1]

    def free(taken: dict[int, int], lo: int, hi: int) -> bool:
        """Whether a piece that is left has a size from lo to hi."""
        at = bisect_left(rising, lo)
        while at < len(rising) and rising[at] <= hi:
            k = len(rising) - 1 - at
            if has[k] > taken.get(k, 0):
                return True
            at += 1
        return False

    def undominated(taken: dict[int, int], left: int) -> bool:
        own = [values[k] for k, n in taken.items() for _ in range(min(n, 2))]
        two = {x + y for i, x in enumerate(own) for y in own[i + 1 :]}
        return not (free(taken, 0, left) or any(free(taken, a + 1, a + left) for a in own) or any(free(taken, a, a + left) for a in two))

    stack: list[tuple[int, int, dict[int, int]]] = [(0, room, {})]
    looks = 0
    while stack and len(found) < FILLINGS and looks < LOOKS:
        k, left, taken = stack.pop()
        k, looks = max(k, bisect_left(values, -left, key=lambda v: -v)), looks + 1  # larger ones don't fit
        if not (sums[k] & ((1 << (left + 1)) - 1)) >> max(0, least - (room - left)):
            continue
        if k == len(values):
            if undominated(taken, left):
                found.append((left, [p for p, n in taken.items() for _ in range(n)]))
            continue
        for n in range(min(has[k], left // values[k]) + 1):  # more pieces of a size are looked at first
            stack.append((k + 1, left - n * values[k], {**taken, k: n} if n else taken))
    return [f for _, f in sorted(found, key=lambda x: x[0])]


def improved(histogram: dict[int, int], capacity: int, n_best: int, bound: int, nodes: int = NODES) -> list[tuple[int, list[int]]] | None:
    """A packing into fewer than ``n_best`` sequences, by branch and bound over bins; None if none is found.

    A node is the multiset of pieces that are left. Its branches are the undominated fillings beside the largest piece; a
    filling is repeated as often as the counts allow where more than FEW pieces are left, else made once. A branch is cut
    when the waste so far is more than a packing with one sequence less can have, which also says how full the next bin must
    be. Each packing found is the new incumbent; the search ends at the lower bound, when all is searched, or after
    ``nodes`` nodes.
    """
    total = sum(s * n for s, n in histogram.items())
    every = np.array(sorted(histogram, reverse=True), np.int64)
    best = None

    def branches(counts: np.ndarray, waste: int) -> Iterator[tuple[int, np.ndarray, int]]:
        """(repetitions, counts of the pieces, waste) of each way to fill the bin of the largest piece."""
        have = np.flatnonzero(counts)
        rest = counts[have].copy()
        rest[0] -= 1
        room = capacity - int(every[have[0]])
        spare = (n_best - 1) * capacity - total - waste
        for filling in fillings(room, every[have], rest, room - spare):
            need = np.bincount(have[[0, *filling]], minlength=len(every))
            times = int((counts[need > 0] // need[need > 0]).min()) if counts.sum() > FEW else 1
            yield times, need, capacity - int((need * every).sum())

    counts = np.array([histogram[int(s)] for s in every], np.int64)
    path: list[tuple[int, np.ndarray]] = []
    stack = [(counts, 0, 0, branches(counts, 0))]
    while stack and nodes:
        counts, waste, used, ways = stack[-1]
        step = next(ways, None)
        if step is None:
            stack.pop()
            path = path[: len(stack) - 1] if stack else []
            continue
        times, need, own = step
        nodes -= 1
        counts, waste, used = counts - times * need, waste + times * own, used + times
        if waste > (n_best - 1) * capacity - total:
            continue
        path = [*path[: len(stack) - 1], (times, need)]
        if counts.any():
            stack.append((counts, waste, used, branches(counts, waste)))
            continue
        best, n_best = [(t, np.repeat(every, n).tolist()) for t, n in path], used
        if n_best <= bound:
            break
    return best


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(repetitions, lengths in order) of the sequences; every piece of the histogram is in one.

    The best-fit solution is the first incumbent, that by the fullest completions the next. If neither meets the lower
    bound, the search over bins looks for a packing with fewer sequences.
    """
    size = lambda bins: sum(t for t, _ in bins)
    histogram = {s: n for s, n in histogram.items() if n}
    best, bound = filled(histogram, capacity, lambda *a: best_fit(*a)[0]), least_sequences(histogram, capacity)
    if size(best) > bound:
        best = min(best, filled(histogram, capacity, completion), key=size)
    if size(best) > bound:
        best = improved(histogram, capacity, size(best), bound) or best
    return best


def places(bins: list[tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, first sequence, offset) in order of first rank; a row's ranks count on from there."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    rank: dict[int, int] = {}
    sequence = 0
    for times, sizes in bins:
        offset = 0
        for s in sizes:
            out.setdefault(s, []).append((rank.get(s, 0), sequence, offset))
            rank[s] = rank.get(s, 0) + times
            offset += s
        sequence += times
    return {s: np.array(rows, np.int64) for s, rows in out.items()}


def ranked(pieces: DataFrame, by: str, n_rows: int) -> DataFrame:
    """``pieces`` with ``rank``, 0, 1, ... within each value of ``by``, without the rows of a value meeting in a task."""
    salts = max(16, n_rows // 20_000)
    # equal rows differ in their number
    rows = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "row"), F.lit(salts)).cast("int"))
    counts = rows.groupBy(by, "salt").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy(by).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select(by, "salt", F.coalesce("before", F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy(by, "salt").orderBy("doc_id", "piece")) - 1
    return rows.withColumn("own", own).join(before, [by, "salt"]).withColumn("rank", F.col("own") + F.col("before")).drop("own", "before", "salt")


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "packing")
    pieces = tokenized_pieces(docs, path or public_tokenizers.path(TOKENIZER), capacity)
    pieces = scratch.save(pieces.withColumn("row", F.monotonically_increasing_id()))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    held = spark.sparkContext.broadcast(places(plan(histogram, capacity)))  # rows follow the lengths, not the corpus
    rows = ranked(pieces, "length", sum(histogram.values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        for batch in batches:
            length, rank = column(batch, "length").to_numpy(), column(batch, "rank").to_numpy()
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for own in np.split(order, cuts):
                if len(own):
                    t = table[int(length[own[0]])]
                    k = np.searchsorted(t[:, 0], rank[own], "right") - 1
                    seq[own], off[own] = t[k, 1] + rank[own] - t[k, 0], t[k, 2]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(column(batch, n) for n in names), pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    return rows.mapInArrow(run, PIECES + ", sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
