"""What the operators share: reading, scratch tables, hashing of words."""

from __future__ import annotations

import os
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_text(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text), where the empty text stands for none. An id may be null: any 64-bit number is one that documents may have."""
    return df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def small_batches(spark: SparkSession, rows: int = 512, mb: int = 16) -> None:
    """Bounds what one Arrow batch brings into a Python worker, by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))


def scratch_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir). On one machine, as in tests, a local one stands in; on several it must be set."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        at = f"/tmp/histora-scratch-{os.getpid()}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it back, which cuts its lineage.

    The files outlive lost executors. They are removed when the driver ends.
    """
    spark = df.sparkSession
    at = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(at)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


# -- words and hashes (run in Python workers) ------------------------------------


class WordIds(dict):
    """64-bit hash of a word (bytes), remembered up to a bound."""

    MOST = 400_000

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) >= self.MOST:
            self.clear()
        self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hash of each word. Where words vary, hashing one takes less than remembering it."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        m = max(n, 2 * len(_powers[0]), 4096)
        for at, base in ((0, _BASE), (1, _INVERSE)):
            step = np.full(m, base, np.uint64)
            step[0] = 1
            _powers[at] = np.multiply.accumulate(step)
    return _powers[0][:n], _powers[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit value."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k values: polynomial in prefix sums, modulo 2**64."""
    n = len(ids)
    if n < k:
        return np.empty(0, np.uint64)
    up, down = _grown(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(ids * up, out=total[1:])
    return mixed((total[k:] - total[: n - k + 1]) * down[: n - k + 1] + np.uint64(k))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w values in a row, by doubling."""
    if len(x) < w:
        return np.empty(0, x.dtype)
    size = 1
    while size * 2 <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = w - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def texts(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow text column without nulls."""
    import pyarrow as pa

    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()
