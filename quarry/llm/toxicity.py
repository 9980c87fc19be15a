"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel of two words counts the letter triples that occur in both, in order and not necessarily adjacent: a triple
that spans s characters counts ``DECAY`` ** (s - 3) in each word, up to ``SPAN`` characters; characters that aren't
letters only widen gaps. It is normalised and raised to ``POWER`` (still a kernel). So "i.d.i.o.t", "idxiot" and "idiot"
are close; a word with marks between its letters ("i--d--i--o--t") is compared without them as well. A text is compared with a landmark by its best word and by the sum and mean of its words' squares; runs of single characters ("i d i o t") are joined to a
word as well. Landmarks are words of the training texts, the most telling of toxic ones first and no two alike.
Comparisons with the landmarks, whitened by the landmarks' own kernel matrix, are the features of a linear support
vector machine (squared hinge); a logistic curve fitted on a part set aside turns its margin into the score.

All words of a text are compared. A worker remembers the comparisons of ``REMEMBERED`` words. Null and empty texts have
no words: all comparisons are 0, and they get the score that the curve gives to that. Without a row of each label to
learn from, every score is 0. Rows are scored each for itself; of several labels of one doc_id the largest counts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import bounded_sample, column, crc_of_id, documents, small_batches

LANDMARKS = 56
SPAN, DECAY, POWER = 6, 0.5, 3
THRESHOLD = 0.3
#: Lengths of words' beginnings that can be landmarks as well as whole words.
STEMS = (5, 6, 7)
#: Labelled rows that are learned from, at most, of each label; and characters of each (scoring takes whole texts).
SAMPLE_ROWS, SAMPLE_CHARS = 3000, 50_000
REMEMBERED = 200_000
LETTERS = 43  # 26, 16 classes of other letters, and 0
_GAPS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]
_RUN = re.compile(r"(?<!\S)(?:\S\s{1,4}){3,}\S(?!\S)")
#: A word with marks between its letters.
_MARKED = re.compile(r"(?:[^\W\d_][\W\d_]+){3,}[^\W\d_]")
_MARKS = re.compile(r"[\W\d_]+")


def words(text: str) -> list[str]:
    """Words, runs of single characters as one word, and words with marks between most letters without these."""
    low = text.lower()
    out = low.split()
    more = ["".join(x.split()) for x in _RUN.findall(low)]
    if not low.isalnum():
        more += [_MARKS.sub("", w) for w in out if not w.isalpha() and _MARKED.search(w)]
    return out + more


def letter_codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.where((points >= 97) & (points <= 122), points - 96, 0)
    far = points >= 0xAA
    if far.any():
        code = np.where(far, 27 + (points * np.uint32(2654435761) >> np.uint32(28)), code)
    return code.astype(np.int64)


def triples(vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, triple, weight), each triple of a word once; the weights of a word have norm 1."""
    size = np.array([len(w) for w in vocabulary], np.int64)
    end = np.cumsum(size)
    codes = np.concatenate([letter_codes("".join(vocabulary)), np.zeros(SPAN, np.int64)])
    owner = np.repeat(np.arange(len(vocabulary)), size)
    limit = end[owner]
    at = np.flatnonzero(codes[: len(owner)] > 0)
    key, weight = [], []
    for a, b in _GAPS:
        i = at[(at + b < limit[at]) & (codes[at + a] > 0) & (codes[at + b] > 0)]
        key.append(owner[i] * LETTERS**3 + (codes[i] * LETTERS + codes[i + a]) * LETTERS + codes[i + b])
        weight.append(np.full(len(i), DECAY ** (b - 2)))
    key, weight = np.concatenate(key), np.concatenate(weight)
    order = np.argsort(key, kind="stable")
    key, weight = key[order], weight[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    total = np.add.reduceat(weight, first) if len(first) else np.zeros(0)
    word, triple = key[first] // LETTERS**3, key[first] % LETTERS**3
    norm = np.sqrt(np.bincount(word, total**2, len(vocabulary)))
    return word, triple, (total / norm[word]).astype(np.float32)


class Comparison:
    """Kernel values of words with the landmarks."""

    def __init__(self, landmarks: list[str]) -> None:
        self.n = len(landmarks)
        word, triple, weight = triples(landmarks)
        self.row = np.zeros(LETTERS**3, np.int32)
        used = np.unique(triple)
        self.row[used] = 1 + np.arange(len(used))
        self.table = np.zeros((len(used) + 1, self.n), np.float32)
        self.table[self.row[triple], word] = weight

    def __call__(self, vocabulary: list[str]) -> np.ndarray:
        out = np.zeros((len(vocabulary), self.n), np.float32)
        for k in range(0, len(vocabulary), 10_000):
            part = vocabulary[k : k + 10_000]
            word, triple, weight = triples(part)
            row = self.row[triple]
            some = row > 0
            word, row, weight = word[some], row[some], weight[some]
            if len(word):
                first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
                out[k + word[first]] = np.add.reduceat(self.table[row] * weight[:, None], first)
        return np.minimum(out, 1) ** POWER


@dataclass
class Machine:
    landmarks: list[str]
    whiten: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    shift: float
    known: dict[str, int] = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "values", "compare")} | {"known": {}}

    def pooled(self, texts: list[str]) -> np.ndarray:
        """For each text and landmark: the best word, the damped sum over words, the mean over words (scaled)."""
        if not hasattr(self, "compare"):
            self.compare, self.values = Comparison(self.landmarks), np.zeros((0, len(self.landmarks)), np.float32)
        n = len(self.landmarks)
        best, total = np.zeros((len(texts), n), np.float32), np.zeros((len(texts), n), np.float32)
        of = [words(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known, self.values = {}, self.values[:0]
        known = self.known
        new = list(dict.fromkeys(w for ws in of for w in ws if w not in known))
        if new:
            self.values = np.concatenate([self.values, self.compare(new)])
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
        for i, ws in enumerate(of):
            for k in range(0, len(ws), 20_000):
                part = self.values[[known[w] for w in ws[k : k + 20_000]]]
                np.maximum(best[i], part.max(0), out=best[i])
                total[i] += np.einsum("ij,ij->j", part, part)
        size = np.array([[max(1, len(ws))] for ws in of], np.float32)
        out = np.concatenate([best, np.log1p(total), np.minimum(1, 20 * total / size)], 1)
        return out

    def features(self, pooled: np.ndarray) -> np.ndarray:
        n = len(self.landmarks)
        return np.concatenate([pooled[:, k * n : k * n + n] @ self.whiten for k in range(3)], 1)

    def margins(self, pooled: np.ndarray) -> np.ndarray:
        return self.features(pooled) @ self.weights + self.bias

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(self.pooled(texts)) + self.shift, -50, 50)))


def choose_landmarks(texts: list[str], y: np.ndarray, n: int = LANDMARKS) -> list[str]:
    """Three quarters from toxic texts: each time the string that tells most of the texts that the ones chosen before
    don't cover yet (a text's weight halves with each); the rest are the strings most typical of other texts.
    """
    counts = [Counter(), Counter()]
    inside = []
    for t, label in zip(texts, y, strict=True):
        own = {w for w in words(t) if len(w) >= 4}
        own |= {w[:k] for w in own for k in STEMS if len(w) > k}
        counts[label].update(own)
        if label:
            inside.append(own)
    n1, n0 = max(1, len(inside)), max(1, len(texts) - len(inside))
    telling = lambda w: counts[1][w] / n1 - 3 * counts[0][w] / n0
    usable = lambda w: (letter_codes(w) > 0).sum() >= 3
    toxic = sorted((w for w in counts[1] if counts[1][w] >= 2 and telling(w) > 0), key=lambda w: (-telling(w), w))[:8000]
    toxic = [w for w in toxic if usable(w)]
    clean = sorted(counts[0], key=lambda w: (telling(w), w))[: 4 * n]
    at = {w: k for k, w in enumerate(toxic)}
    cells = [(k, at[w]) for k, own in enumerate(inside) for w in own if w in at]
    doc, cand = (np.array(x, np.int64) for x in zip(*cells, strict=True)) if cells else (np.zeros(0, np.int64),) * 2
    weight, cost = np.ones(len(inside)), np.array([3 * n1 / n0 * counts[0][w] for w in toxic])
    out: list[str] = []
    open_ = np.ones(len(toxic), bool)
    while open_.any() and len(out) < 3 * n // 4:
        gain = np.where(open_, np.bincount(cand, weight[doc], len(toxic)) - cost, -np.inf)
        k = int(gain.argmax())
        open_[k] = False
        if gain[k] <= 0:
            break
        if not out or Comparison(out)([toxic[k]]).max() < 0.9**POWER:
            out.append(toxic[k])
            weight[doc[cand == k]] *= 0.5
    for w in clean:
        if len(out) < n and usable(w) and (not out or Comparison(out)([w]).max() < 0.85**POWER):
            out.append(w)
    return out


def squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights and bias by Newton steps on the active set; y is -1 or 1."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[-1, -1] = 1e-8
    for _ in range(30):
        on = y * (x @ w) < 1
        new = np.linalg.solve((x[on] * weight[on, None]).T @ x[on] + penalty, (x[on] * weight[on, None]).T @ y[on])
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w


def logistic(f: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the curve of y (0 or 1) over margins f, by Newton steps; slightly pulled to 1 and 0."""
    x, w = np.stack([f, np.ones_like(f)], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + 1e-2 * (w - [1.0, 0.0])
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def train(texts: list[str], y: np.ndarray, share: float) -> Machine:
    """share: how many of all labelled rows are toxic; the sample may hold more of them."""
    aside = np.arange(len(y)) % 4 == 3
    if len(set(y[aside])) < 2 or len(set(y[~aside])) < 2:
        aside = np.zeros(len(y), bool)
    fit = ~aside
    landmarks = choose_landmarks([t for t, f in zip(texts, fit, strict=True) if f], y[fit]) or ["none"]
    kernel = Comparison(landmarks)(landmarks).astype(np.float64)
    value, vector = np.linalg.eigh((kernel + kernel.T) / 2)
    whiten = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-2))) @ vector.T
    machine = Machine(landmarks, whiten, np.zeros(3 * len(landmarks)), 0.0, 1.0, 0.0)
    pooled = np.concatenate([machine.pooled(texts[k : k + 256]) for k in range(0, len(texts), 256)])
    weight = np.where(y == 1, share / max(1e-9, y.mean()), (1 - share) / max(1e-9, 1 - y.mean()))
    w = squared_hinge(machine.features(pooled[fit]), 2.0 * y[fit] - 1, weight[fit])
    machine.weights, machine.bias = w[:-1], float(w[-1])
    margins, on = machine.margins(pooled), aside if aside.any() else fit
    machine.slope, machine.shift = logistic(margins[on], y[on], weight[on])
    return machine


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Machine | None:
    """Learns from labelled rows whose crc32(doc_id) mod 4 isn't 2, of at most ``rows`` of each label."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    own = own.where((crc_of_id() % 4 != 2) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in own.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    picked = bounded_sample(own.where("toxic = 1"), rows).unionByName(bounded_sample(own.where("toxic = 0"), rows))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # picked: 2 * rows at most; of several texts with one doc_id the first in order
    found = text.join(F.broadcast(picked), "doc_id").withColumn("text", F.substring("text", 1, SAMPLE_CHARS))
    table = found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).toArrow()
    order = sorted(zip(table["doc_id"].to_pylist(), table["text"].to_pylist(), table["toxic"].to_pylist(), strict=True), key=lambda r: (r[0], r[1] or ""))
    y = np.array([r[2] for r in order], np.int64)
    if len(set(y.tolist())) < 2:
        return None
    shuffled = np.random.default_rng(2).permutation(len(order))
    return train([order[i][1] or "" for i in shuffled], y[shuffled], counts[1] / sum(counts.values()))


def toxicity(docs: DataFrame, machine: Machine | None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``."""
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            texts = column(batch, "text").to_pylist()
            score = model.scores(texts) if model is not None and texts else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), column(batch, "held_out"), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(crc_of_id() % 4 == 2, F.lit(False)).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
