"""Embedding client, tables, streams, configuration, extensions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quarry import config
from quarry.chunkers.base import Chunk
from quarry.extension import Extension, Extensions, Tool
from quarry.functions import keys, text, vectors
from quarry.operators import chunking, embedding
from quarry.streaming import changes


class Flaky(embedding.HashClient):
    def __init__(self, fails=(), limit=None):
        super().__init__(8, 10)
        self.fails, self.limit, self.calls = list(fails), limit, []

    def embed_documents(self, texts):
        self.calls.append(texts)
        if self.fails:
            e = self.fails.pop(0)
            if e:
                raise e
        if self.limit and any(len(t) > self.limit for t in texts):
            raise embedding.TooLong("Given: 99")
        return super().embed_documents(texts)


def test_batches():
    assert embedding.batches([13, 186, 900, 1281, 5, 5], 32, 1000) == [[0, 1], [2], [3], [4, 5]]
    assert embedding.batches([1] * 5, 2, 100) == [[0, 1], [2, 3], [4]] and embedding.batches([], 2, 5) == []


def test_retries_and_quarantine():
    waits = []
    c = Flaky([embedding.Transient(), embedding.Transient(retry_after=7)])
    got = embedding.Resilient(c, sleep=waits.append).embed(["a", "b"])
    assert got == c.embed_documents(["a", "b"]) and waits == [1.0, 7]
    assert embedding.Resilient(Flaky([embedding.Transient()] * 9), retries=2, sleep=waits.append).embed(["a"]) == [None]
    c = Flaky([ValueError(), None, ValueError()])
    assert [v is None for v in embedding.Resilient(c).embed(["a", "b"])] == [False, True]
    c.embed_documents = lambda texts: [[float("nan")] * 8 for _ in texts]
    assert embedding.Resilient(c).embed(["a"]) == [None]


def test_long_inputs_are_pooled():
    c = Flaky()
    v = embedding.Resilient(c).embed(["x" * 100, "y"])
    assert len(c.calls[0]) > 2 and sum(a * a for a in v[0]) == pytest.approx(1)
    assert embedding.Resilient(Flaky(limit=20)).embed(["z" * 40])[0] is not None
    assert embedding.mean_pooled([[1.0, 0.0], None], 2) is None and embedding.mean_pooled([[1.0, 0.0], [-1.0, 0.0]], 2) is None


def test_hash_embedding_is_the_client(spark):
    row = spark.range(1).select(vectors.hash_embedding(F.lit("some é text"), 10).alias("v")).first().v
    assert row == pytest.approx(embedding.HashClient(10).embed_query("some é text"))


def test_stream_equals_batch(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = [("live", f"f{k % 3}", "purge" if k % 5 == 0 else "index", at + dt.timedelta(milliseconds=700 * k * (1 + k % 4)), k) for k in range(60)]
    schema = "tier string, file_path string, op string, ts timestamp, seq long"
    ops = spark.createDataFrame(rows, schema)
    ops.write.parquet(str(tmp_path / "in"))
    # a last event far ahead moves the watermark past all bursts
    spark.createDataFrame([("live", "end", "index", at + dt.timedelta(days=9), 99)], schema).write.mode("append").parquet(str(tmp_path / "in"))
    out = []
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    changes.run(stream, lambda df, _: out.extend(map(tuple, df.collect())), str(tmp_path / "c"), "1 day").awaitTermination()
    assert sorted(map(tuple, changes.debounced(ops).collect())) == sorted(r for r in out if r[1] != "end")


def test_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    import uuid

    assert one(keys.uuid5(F.lit("a:bé"))) == str(uuid.uuid5(uuid.NAMESPACE_URL, "a:bé"))
    assert one(keys.parsed_stamp(F.lit("a@b@2,c@1")))[0].chunk_key == "a@b"
    assert one(text.lines(F.lit("a\r\nb\x85c d\n"))) == "a\r\nb\x85c d\n".splitlines()
    assert one(keys.common_tail(F.lit("a.b.c"), F.lit("b.c"))) and not one(keys.common_tail(F.lit("a.b.c"), F.lit("a.c")))
    assert one(text.redacted(F.lit('token = "abc" x Bearer q.w-e aB3dE5gH7jK9mN1pQ3sT5uV7 aaaaaaaaaaaaaaaaaaaaaaaaaaaaa'))) == "token = *** x Bearer *** *** aaaaaaaaaaaaaaaaaaaaaaaaaaaaa"
    assert one(keys.is_test_path(F.lit("a/tests/b.py"))) and one(keys.is_test_path(F.lit("a/b_test.py"))) and not one(keys.is_test_path(F.lit("tests.py")))


def test_config(monkeypatch):
    c = config.Config(project="p", state_dir="/s", root="/r")
    assert [r.tier for r in c.effective_roots()] == ["default"] and len(config.fingerprint(c)) == 64
    assert config.fingerprint(c) != config.fingerprint(c.model_copy(update={"chunkers": {".py": "text"}}))
    for bad in ({"project": "P"}, {"project": "p", "more": 1}, {"project": "p", "roots": [{"tier": "t", "path": "x", "policy": "static"}]}):
        with pytest.raises(ValueError):
            config.Config(state_dir="/s", **bad)
    monkeypatch.setenv("EMPTY", "")
    with pytest.raises(ValueError):
        config.secret("EMPTY")


def test_extensions(spark):
    log = []

    class One(Extension):
        name = "one"

        def chunkers(self):
            return {"one": (lambda s, c: [Chunk("one", "x", s, 1, 1)], [".one"], None)}

        def tools(self, engine):
            return [Tool("t", lambda: None)]

        def format(self):
            return F.lit("formatted")

        def rerank(self, hits, query):
            return hits.where("id > 1")

        def on_startup(self, engine):
            log.append("up")

        def on_shutdown(self, engine):
            log.append("down")

    class Fails(Extension):
        def on_startup(self, engine):
            raise RuntimeError

    registry, chunkers, ex = chunking.default_registry(), dict(chunking.CHUNKERS), Extensions()
    ex.register(One(), registry, chunkers)
    with pytest.raises(ValueError):
        ex.register(One(), registry, chunkers)
    files = spark.createDataFrame([("t", "a.ONE", "text"), ("t", "bad.xml", "<a>")], "tier string, file_path string, content string")
    rows = {r.file_path: r for r in chunking.chunk_files(files, registry, {k: v for k, v in chunkers.items() if k != "one"} | {"one": chunking.CHUNKERS["text"]}).collect()}
    assert rows["a.ONE"].chunk_type == "text" and rows["bad.xml"].error.startswith("ExpatError")
    assert ex.augmented(spark.range(4), "q").count() == 2 and spark.range(1).select(ex.format(F.lit("x")).alias("x")).first().x == "formatted"
    ex.items.append(Fails())
    with pytest.raises(RuntimeError):
        ex.start(None)
    assert log == ["up", "down"]
    with pytest.raises(ValueError):
        registry.override({".py": "text", ".x": "unknown"})
    assert ".py" not in registry.overrides
