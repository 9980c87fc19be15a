"""What the operators share: the scratch folder, Arrow helpers, hashing and row streams."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that an Arrow batch to Python holds at most, unless a single row has more.
BATCH_BYTES = 512 * 1024


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table ``documents``."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id as long and text, whatever other columns there are; a null text is empty."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )


def whole_row(docs: DataFrame) -> Column:
    """All columns as one struct, so that no other column can clash with any of them, whatever their names."""
    return F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in docs.columns))


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches to Python by bytes, so that long texts make batches of few rows.

    The bound is the same for all operators: plans are lazy, so a bound of each one's own would depend on who is last.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: ``spark.checkpoint.dir``. Only a session on one machine may do without."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (found or "/tmp/quarry-checkpoints").rstrip("/")


class Scratch:
    """Intermediate tables written as Parquet in the shared folder, so that a lost executor costs no lineage.

    Plans that read them may run at any time, so the folder goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str, collect_every: int = 4) -> None:
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n, self.collect_every = 0, collect_every

    def save(self, df: DataFrame) -> DataFrame:
        """Writes ``df`` and returns the table that reads it back."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.mode("overwrite").parquet(path)
        if self.n == 1:
            folder, files = self._folder(self.root)
            files.deleteOnExit(folder)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path  # type: ignore[attr-defined]
        # Spark removes the shuffles of finished steps only when the driver's garbage is collected
        if self.n % self.collect_every == 0:
            self.spark.sparkContext._jvm.System.gc()
        return out

    def drop(self, df: DataFrame) -> None:
        """Deletes a table of this folder that no later plan reads."""
        path = getattr(df, "_scratch_path", None)
        if path:
            folder, files = self._folder(path)
            files.delete(folder, True)

    def _folder(self, path: str):
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return folder, folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())


#: Bits of the bitmap by which rows are told that can't be in a table: 16 for each of its keys, this many at most.
MOST_BITS = 1 << 28


def told_apart(rows: DataFrame, key: Column, known: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Rows whose key (a hash) may be one of ``known`` (key long), and those whose key is none, null among them.

    So that of long rows only the few that matter are shuffled. The bitmap that goes to all tasks has 32 MB at most; for
    tables of so many keys that it fills up, more rows, in the end all, are among the first.
    """
    bits = 1 << 15
    n = known.count()
    while bits < min(16 * n, MOST_BITS):
        bits *= 2
    place = lambda c: F.pmod(c, F.lit(bits)) + 1
    own = known.select(place(F.col("key")).alias("place")).withColumn("bucket", F.bitmap_bucket_number("place"))
    maps = own.repartition(shuffle_partitions(rows.sparkSession), "bucket").groupBy("bucket").agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bitmap"))
    maps = F.broadcast(scratch.save(maps))
    found = rows.withColumn("place", place(key)).join(maps, F.bitmap_bucket_number("place") == F.col("bucket"), "left")
    at = F.bitmap_bit_position("place")
    byte = F.conv(F.hex(F.substr("bitmap", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(byte.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) != 0, F.lit(False))
    found = found.withColumn("hit", hit)
    return found.where("hit").select(*rows.columns), found.where("not hit").select(*rows.columns)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_HELD: dict[str, object] = {}


def held_by_worker(owner: str, make: Callable[[], Any] = lambda: None) -> Any:
    """What an operator keeps in a Python worker from task to task. A worker that comes to another operator drops it, so
    that a reused worker holds the tables of one.
    """
    if owner not in _HELD:
        _HELD.clear()
        gc.collect()
        _HELD[owner] = make()
    return _HELD[owner]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def byte_view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and the offsets where each begins (one more than texts)."""
    arr = texts.cast(pa.large_binary())
    if arr.null_count:
        arr = pc.fill_null(arr, b"")
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[arr.offset : arr.offset + len(arr) + 1]
    if data is None or len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    base = int(offsets[0])
    return np.frombuffer(data, dtype=np.uint8)[base : int(offsets[-1])], offsets - base


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shift, multiply, shift), for arrays of uint64."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def byte_codes(seed: int) -> np.ndarray:
    """A 64-bit code for each byte value, from a seeded generator."""
    return np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def groups_of(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that hold whole runs of equal ``key`` from a stream sorted by it; the last run is carried along."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = column(batch, key).to_numpy(zero_copy_only=False)
        change = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        first = not held or column(held[-1], key)[-1].as_py() != keys[0]
        if first and held:
            yield pa.Table.from_batches(held)
            held = []
        if len(change):
            cut = int(change[-1])
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def bounded_sample(rows: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """At most ``n`` rows, the same ones each time: those of the least hashes of ``key``. For fitting models only.

    The threshold is found from hashes alone, so no text is moved that isn't in the sample. Of rows with one key that are
    more than fit, those of the least hashes of all columns stay.
    """
    h = F.xxhash64(F.col(key), F.lit("sample"))
    top = rows.select(h.alias("h")).orderBy("h").limit(n).agg(F.max("h")).first()[0]
    return rows.where(h <= F.lit(top if top is not None else -(2**63))).orderBy(h, F.xxhash64(*rows.columns)).limit(n)


def crc_of_id(col: str = "doc_id"):
    """crc32 of doc_id written as text."""
    return F.crc32(F.col(col).cast("string").cast("binary"))
