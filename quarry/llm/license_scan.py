"""License scans: fuzzy search for short notices.

A notice of n characters with k allowed edits is cut into k + 1 parts; by the pigeonhole principle any text within k
edits of it holds one part unchanged. The parts are looked up exactly (one pass of ``bytes.find`` over a batch), and
the text around each hit is verified by the ``regex`` library's bounded-error matching, which also gives the span. Edits
must leave what tells a notice from its rivals: a span counts only if its notice's ``telling`` expression is found in it,
so "under the mpl license" isn't the MIT license, "under the mit-0 license" neither, and "apache license version 1.1" isn't
version 2.

Texts are compared as words: A-Z are lower-cased, words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``, and one space stands
between two words. Null and empty texts have no words, no label and score 0. Rows with equal doc_id are scanned each
for itself; other columns are ignored.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from quarry.llm.common import byte_view, column, documents, id_and_text, small_batches

SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, spans array<struct<label:string,first_word:long,n_words:int,edits:int,base:boolean>>"
)


@dataclass(frozen=True)
class Notice:
    """phrase: lower-case words with one space between; edits: how many the fuzzy search allows; telling: what a span
    must hold unchanged, an expression searched in the span's words with a space before and after each.
    """

    phrase: str
    label: str
    edits: int
    base: bool = False
    telling: str = ""


#: The phrases and labels of the contract.
BASE = (
    Notice("under the mit license", "mit", 2, True, " [a-z]{2,} mit [a-z]{5,} "),
    Notice("apache license version 2", "apache-2", 2, True, " [a-z]+ 2 (?:0 )?$"),
    Notice("cc by nc", "cc-by-nc", 0, True),
)
#: Notices that the fuzzy search adds.
ADDED = (
    Notice("gnu general public license", "gpl", 3, telling=" gnu "),
    Notice("mozilla public license", "mpl", 2, telling=" mozil+a "),
    Notice("permission is hereby granted free of charge", "mit", 4, telling=" granted .*free "),
    Notice("redistribution and use in source and binary forms", "bsd", 5, telling=" source .*binary "),
    Notice("creative commons attribution noncommercial", "cc-by-nc", 4, telling=" non ?commercial "),
)

_WORD = np.ones(256, bool)
for lo, hi in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
    _WORD[lo : hi + 1] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Words of each text, each followed by one space, with a newline and a space before each text's words."""
    low = _LOWER[data]
    word = _WORD[low]
    last = np.zeros(len(low), bool)  # the last byte of a text's word
    if len(low):
        last[:-1] = word[:-1] & ~word[1:]
        last[-1] = word[-1]
        ends = offsets[1:][offsets[1:] > offsets[:-1]] - 1
        last[ends] = word[ends]
    size = word.astype(np.int8) + last
    at = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    starts = at[offsets] + 2 * np.arange(len(offsets))
    out = np.full(int(at[-1]) + 2 * (len(offsets) - 1), 32, np.uint8)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    out[(at[:-1] + 2 * (doc + 1))[word]] = low[word]
    out[starts[:-1]] = 10
    return out.tobytes(), starts


def parts(notice: Notice) -> list[tuple[int, bytes]]:
    """edits + 1 parts with their offsets in the phrase."""
    raw, n = notice.phrase.encode(), notice.edits + 1
    cuts = [len(raw) * i // n for i in range(n + 1)]
    return [(a, raw[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def find_all(text: bytes, part: bytes) -> Iterator[int]:
    at = text.find(part)
    while at >= 0:
        yield at
        at = text.find(part, at + 1)


class Scanner:
    def __init__(self, notices: tuple[Notice, ...]) -> None:
        self.notices = notices
        self.fuzzy = [
            regex.compile(rf"(?b)(?<=[ \n])(?:{regex.escape(n.phrase)}){{e<={n.edits}}}(?= )".encode()) for n in notices
        ]
        self.telling = [regex.compile(n.telling.encode()) for n in notices]

    def near(self, text: bytes, k: int, whole: list[int]) -> list[tuple[int, int, int]]:
        """(start, end, edits) of the notice's spans with edits, apart from each other and from its whole phrases."""
        notice = self.notices[k]
        size, room = len(notice.phrase.encode()), notice.edits + 1
        exact = set(whole)
        seeds = sorted({(at - offset, at) for offset, part in parts(notice) for at in find_all(text, part) if at - offset not in exact})
        out: list[tuple[int, int, int]] = []
        for start, at in seeds:  # in order of place, so a span can only meet the last one, or the phrases around it
            lo, hi = max(0, start - room, out[-1][1] if out else 0), start + size + room
            lo = max(lo, text.rfind(b"\n", lo, max(lo, at)) + 1)  # not beyond the hit's own text
            end = text.find(b"\n", at, hi)
            hi = end if end >= 0 else min(hi, len(text))
            after = bisect.bisect_right(whole, start)
            if after:
                lo = max(lo, whole[after - 1] + size)
            if after < len(whole):
                hi = min(hi, whole[after])
            for found in self.fuzzy[k].finditer(text, lo, hi, overlapped=True) if lo < hi else ():
                if self.telling[k].search(b" " + found.group() + b" "):
                    out.append((found.start(), found.end(), sum(found.fuzzy_counts)))
                    break
        return out

    def scan(self, text: bytes) -> list[tuple[int, int, int, int, bool]]:
        """(start, end, notice, edits, whole phrase) in a batch's normalised text."""
        found = []
        for k, notice in enumerate(self.notices):
            raw = notice.phrase.encode()
            whole = [at + 1 for at in find_all(text, b" " + raw + b" ")]
            found += [(at, at + len(raw), k, 0, True) for at in whole]
            if notice.edits:
                found += [(a, b, k, n, False) for a, b, n in self.near(text, k, whole)]
        return sorted(found)


def license_scan(docs: DataFrame, notices: tuple[Notice, ...] = BASE + ADDED) -> DataFrame:
    """One row per document: counts and places of whole base phrases, labels, score, and all spans found.

    score is the best 1 - edits / length of the phrase over the spans, 0 without any.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices)
        for batch in batches:
            data, offsets = byte_view(column(batch, "text"))
            text, starts = normalised(data, offsets)
            spaces = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
            before = np.searchsorted(spaces, starts)
            n_words = np.diff(before) - 1
            rows: list[list] = [[] for _ in range(batch.num_rows)]
            for s, e, k, edits, whole in scanner.scan(text):
                doc = int(np.searchsorted(starts, s, "right")) - 1
                first = int(np.searchsorted(spaces, s)) - int(before[doc]) - 1
                rows[doc].append((k, first, text.count(b" ", s, e) + 1, edits, whole and notices[k].base))
            base = [[r for r in row if r[4]] for row in rows]
            label = lambda row: ",".join(sorted({notices[r[0]].label for r in row}))
            yield pa.RecordBatch.from_arrays(
                [
                    column(batch, "doc_id"),
                    pa.array(n_words, pa.int64()),
                    pa.array([len(r) for r in base], pa.int64()),
                    pa.array([min((x[1] for x in r), default=None) for r in base], pa.int64()),
                    pa.array([max((x[1] for x in r), default=None) for r in base], pa.int64()),
                    pa.array([label(r) for r in base], pa.string()),
                    pa.array([label(r) for r in rows], pa.string()),
                    pa.array([max((1 - x[3] / len(notices[x[0]].phrase) for x in r), default=0.0) for r in rows], pa.float64()),
                    pa.array(
                        [[dict(label=notices[k].label, first_word=f, n_words=n, edits=x, base=b) for k, f, n, x, b in r] for r in rows],
                        pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int32()), ("edits", pa.int32()), ("base", pa.bool_())])),
                    ),
                ],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
            )

    return id_and_text(docs).mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))
