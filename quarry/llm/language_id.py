"""Language identification by a byte convolutional network.

A text's UTF-8 bytes, letters folded to lower case, are cut into windows of ``WINDOW`` bytes, all of them. Bytes are
embedded; filters of several widths run over each window; ReLU, max pooling over positions and softmax give each
window's language. A text's prediction is the mean of its windows' log probabilities, renormalised. The network is
trained in numpy, on a sample of labelled texts whose size is bounded by ``sample_rows``.

Null texts and texts without a letter get ``und`` with score 0, and so does every text where no labelled row was to be
learned from. Labels are those seen in training. Rows with equal doc_id are predicted each for itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import bounded_sample, byte_view, column, crc_of_id, documents, held_by_worker, small_batches

WINDOW = 128
WIDTHS = (2, 3, 4, 5)
FILTERS = 12
EMBED = 8
#: Labelled rows that the network is fitted on, at most; and windows of each.
SAMPLE_ROWS = 4000
SAMPLE_WINDOWS = 4
#: A document is rejected below this score.
LEAST_SCORE = 0.4

_CLASS = np.empty(256, np.uint8)
_CLASS[:128] = 29
for _c in range(26):
    _CLASS[ord("a") + _c] = _CLASS[ord("A") + _c] = 1 + _c
_CLASS[ord("0") : ord("9") + 1] = 27
for _c in b" \t\n\r\x0b\x0c":
    _CLASS[_c] = 28
_CLASS[128:] = 30 + np.arange(128)
CLASSES = 158
_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = _LETTER[ord("A") : ord("Z") + 1] = True


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows (rows of WINDOW classes, 0 beyond the text) and the text of each."""
    n = -(-np.diff(offsets) // WINDOW)
    owner = np.repeat(np.arange(len(n)), n)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    at = offsets[:-1][owner] + within * WINDOW
    codes = np.concatenate([_CLASS[data], np.zeros(WINDOW, np.uint8)])
    out = codes[at[:, None] + np.arange(WINDOW)]
    size = np.minimum(offsets[1:][owner] - at, WINDOW)
    short = np.flatnonzero(size < WINDOW)
    out[short] = np.where(np.arange(WINDOW) < size[short, None], out[short], 0)
    return out, owner


@dataclass
class Network:
    embed: np.ndarray  # CLASSES x EMBED
    filters: np.ndarray  # (widest * EMBED) x (FILTERS * widths), zero beyond each filter's width
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    labels: list[str]

    def pooled(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Patches, pooled activations and the position of each maximum."""
        w = max(WIDTHS)
        padded = np.concatenate([codes, np.zeros((len(codes), w - 1), np.uint8)], 1)
        emb = self.embed[padded].reshape(len(codes), -1)
        step = emb.strides[1]
        patches = np.lib.stride_tricks.as_strided(emb, (len(codes), WINDOW, w * EMBED), (emb.strides[0], EMBED * step, step))
        act = np.ascontiguousarray(patches).reshape(-1, w * EMBED) @ self.filters
        return patches, act.reshape(len(codes), WINDOW, -1), padded

    def log_probabilities(self, codes: np.ndarray) -> np.ndarray:
        _, act, _ = self.pooled(codes)
        z = np.maximum(act.max(1) + self.bias, 0) @ self.out + self.out_bias
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))


def train(codes: np.ndarray, y: np.ndarray, labels: list[str], epochs: int = 6, seed: int = 7) -> Network:
    """Cross entropy, Adam, batches of 64; each class weighs alike."""
    rng = np.random.default_rng(seed)
    w, f = max(WIDTHS), FILTERS * len(WIDTHS)
    mask = np.concatenate([np.repeat((np.arange(w) < k).astype(np.float32), EMBED)[:, None].repeat(FILTERS, 1) for k in WIDTHS], 1)
    normal = lambda *s: rng.standard_normal(s).astype(np.float32)
    net = Network(normal(CLASSES, EMBED) * 0.5, normal(w * EMBED, f) * 0.25 * mask, np.zeros(f, np.float32), normal(f, len(labels)) * 0.2, np.zeros(len(labels), np.float32), labels)
    net.embed[0] = 0
    names = ("embed", "filters", "bias", "out", "out_bias")
    m = {k: np.zeros_like(getattr(net, k)) for k in names}
    v = {k: np.zeros_like(getattr(net, k)) for k in names}
    weight = (len(y) / np.maximum(1, np.bincount(y, minlength=len(labels))) / len(labels)).astype(np.float32)
    t = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for k in range(0, len(order), 64):
            i = order[k : k + 64]
            patches, act, padded = net.pooled(codes[i])
            top = act.argmax(1)
            pre = np.take_along_axis(act, top[:, None], 1)[:, 0] + net.bias
            h = np.maximum(pre, 0)
            z = h @ net.out + net.out_bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(i)), y[i]] -= 1
            p *= weight[y[i]][:, None] / len(i)
            dh = (p @ net.out.T) * (pre > 0)
            at = patches[np.arange(len(i))[:, None], top]  # batch x filter x patch
            demb = np.zeros_like(net.embed)
            dpatch = (dh[:, :, None] * net.filters.T[None]).reshape(len(i), f, w, EMBED)
            code = padded[np.arange(len(i))[:, None, None], top[:, :, None] + np.arange(w)]
            np.add.at(demb, code.ravel(), dpatch.reshape(-1, EMBED))
            demb[0] = 0
            grad = {"embed": demb, "filters": np.einsum("bf,bfp->pf", dh, at) * mask, "bias": dh.sum(0), "out": h.T @ p, "out_bias": p.sum(0)}
            t += 1
            for name in names:
                g = grad[name]
                m[name] = 0.9 * m[name] + 0.1 * g
                v[name] = 0.999 * v[name] + 0.001 * g * g
                step = 0.01 * (m[name] / (1 - 0.9**t)) / (np.sqrt(v[name] / (1 - 0.999**t)) + 1e-8)
                setattr(net, name, (getattr(net, name) - step).astype(np.float32))
    return net


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Network | None:
    """Learns from text and non-null lang of rows whose crc32(doc_id) mod 5 isn't 0; of at most ``rows`` of them."""
    small_batches(docs.sparkSession)
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    labelled = labelled.where((crc_of_id() % 5 != 0) & F.col("lang").isNotNull() & (F.length("text") > 0))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, owner = windows(*byte_view(column(batch, "text")))
            n = np.bincount(owner, minlength=batch.num_rows)
            chosen = [at + np.sort(np.random.default_rng(5).permutation(k)[:SAMPLE_WINDOWS]) for at, k in zip(np.cumsum(n) - n, n, strict=True)]
            rows = pa.array(np.repeat(np.arange(batch.num_rows), [len(c) for c in chosen]))
            raw = pa.array([codes[k].tobytes() for c in chosen for k in c], pa.binary())
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id").take(rows), column(batch, "lang").take(rows), raw], names=["doc_id", "lang", "raw"])

    # only the windows come to the driver, rows * SAMPLE_WINDOWS of WINDOW bytes at most
    table = bounded_sample(labelled, rows).mapInArrow(pick, "doc_id long, lang string, raw binary").toArrow()
    if not table.num_rows:
        return None
    table = table.sort_by([("doc_id", "ascending"), ("raw", "ascending")])
    codes = np.frombuffer(b"".join(table["raw"].to_pylist()), np.uint8).reshape(-1, WINDOW)
    labels = sorted(set(table["lang"].to_pylist()))
    return train(codes, np.searchsorted(labels, table["lang"].to_pylist()).astype(np.int64), labels)


def language_id(docs: DataFrame, network: Network | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of ``docs``."""
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_by_worker("language_id")
        net = held.value
        for batch in batches:
            texts = column(batch, "text")
            data, offsets = byte_view(texts)
            names, score = predict(net, data, offsets, texts)
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), column(batch, "held_out"), pa.array(names, pa.string()), pa.array(score, pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(crc_of_id() % 5 == 0, F.lit(False)).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def predict(net: Network | None, data: np.ndarray, offsets: np.ndarray, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    n = len(offsets) - 1
    if net is None:
        return ["und"] * n, np.zeros(n)
    total = np.zeros((n, len(net.labels)))
    ascii_letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
    has = ascii_letters[offsets[1:]] > ascii_letters[offsets[:-1]]
    for i in np.flatnonzero(~has):
        has[i] = any(c.isalpha() for c in texts[int(i)].as_py())
    for lo, hi in spans(offsets, 512 * WINDOW):
        codes, owner = windows(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        for k in range(0, len(codes), 512):
            np.add.at(total, owner[k : k + 512] + lo, net.log_probabilities(codes[k : k + 512]))
    mean = total / np.maximum(1, -(-np.diff(offsets) // WINDOW))[:, None]
    p = np.exp(mean - mean.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    best = p.argmax(1)
    score = np.where(has, p[np.arange(n), best], 0.0)
    return [net.labels[b] if h else "und" for b, h in zip(best, has, strict=True)], score


def spans(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that get a language with LEAST_SCORE or more, by their own text.

    Without a row to learn from no text can be told from another, so that is an error unless the table is empty.
    """
    spark, network = docs.sparkSession, fit(docs)
    if network is None:
        if docs.isEmpty():
            return docs
        raise ValueError("no labelled text to learn languages from")
    small_batches(spark)
    held = spark.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_by_worker("language_id")
        net = held.value
        for batch in batches:
            texts = column(batch, "text").fill_null("")
            names, score = predict(net, *byte_view(texts), texts)
            yield batch.filter(pa.array([s >= LEAST_SCORE and x != "und" for x, s in zip(names, score, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language_id(docs, fit(docs))
