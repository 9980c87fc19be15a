from zlib import crc32

import numpy as np
import pytest

from quarry.llm import language_id
from quarry.llm.common import documents


def test_held_out_accuracy(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    rows = language_id.query(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(lang)
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    out = [r.lang_pred == lang[r.doc_id] for r in rows if r.held_out]
    assert np.mean(out) > 0.95


def test_edges(edge_docs, no_docs):
    net = language_id.fit(edge_docs)
    rows = language_id.language_id(edge_docs, net).collect()
    assert len(rows) == edge_docs.count()
    got = {r.doc_id: (r.lang_pred, r.score) for r in rows}
    assert got[3] == got[4] == got[5] == got[9] == ("und", 0.0)
    assert got[8][0] in net.labels
    assert language_id.fit(no_docs) is None
    assert language_id.language_id(no_docs, None).count() == 0
    kept = language_id.accepted(edge_docs)
    assert kept.columns == edge_docs.columns and {r.doc_id for r in kept.collect()}.isdisjoint({3, 4, 5, 9})


def test_windows_cover_whole_texts():
    data = np.frombuffer(b"a" * 300 + b"b" * 128, np.uint8)
    codes, owner = language_id.windows(data, np.array([0, 300, 300, 428]))
    assert list(owner) == [0, 0, 0, 2]
    assert (codes == 1).sum() == 300 and (codes == 2).sum() == 128


def slow_log_probabilities(net, text):
    """The mean over windows, each convolved position by position."""
    out = []
    for at in range(0, len(text), language_id.WINDOW):
        codes = [int(language_id._CLASS[b]) for b in text[at : at + language_id.WINDOW]]
        codes += [0] * (language_id.WINDOW + max(language_id.WIDTHS) - 1 - len(codes))
        best = np.full(net.filters.shape[1], -np.inf)
        for p in range(language_id.WINDOW):
            patch = np.concatenate([net.embed[c] for c in codes[p : p + max(language_id.WIDTHS)]])
            best = np.maximum(best, patch @ net.filters)
        z = np.maximum(best + net.bias, 0) @ net.out + net.out_bias
        out.append(z - np.log(np.exp(z).sum()))
    return np.mean(out, 0)


def test_predictions_equal_the_slow_version(spark, sf):
    docs = documents(spark, sf).limit(25)
    net = language_id.fit(documents(spark, sf))
    for r, text in zip(language_id.language_id(docs, net).collect(), [d.text for d in docs.collect()], strict=True):
        p = np.exp(slow_log_probabilities(net, text.encode()))
        p /= p.sum()
        if r.lang_pred != "und":
            assert r.lang_pred == net.labels[int(p.argmax())] and abs(r.score - p.max()) < 1e-4


def test_training_follows_the_gradient():
    """Each width's filters see their own width only, and the loss of the training windows falls far below chance."""
    rng = np.random.default_rng(0)
    codes = rng.integers(1, 27, (300, language_id.WINDOW)).astype(np.uint8)
    y = np.arange(300) % 3
    for k in range(3):
        codes[y == k, 10:14] = [1 + k, 2 + k, 3 + k, 4 + k]
        codes[y == k, 60:64] = [1 + k, 2 + k, 3 + k, 4 + k]
    net = language_id.train(codes, y, ["a", "b", "c"], epochs=12)
    loss = -net.log_probabilities(codes)[np.arange(300), y].mean()
    assert loss < 0.3 * np.log(3)
    shaped = net.filters.reshape(max(language_id.WIDTHS), language_id.EMBED, len(language_id.WIDTHS), language_id.FILTERS)
    for k, width in enumerate(language_id.WIDTHS):
        assert not shaped[width:, :, k].any() and shaped[:width, :, k].any()


def test_without_labels_nothing_is_dropped_silently(spark, no_docs):
    rows = spark.createDataFrame([(1, "some text", None), (2, "more text", None)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="no labelled text"):
        language_id.accepted(rows)
    assert language_id.accepted(no_docs).count() == 0
