"""Helpers that the training-data operators share.

Everything that must outlive one job is written as a table below the folder that
``spark.checkpoint.dir`` names, which all executors share; nothing here uses a
machine-local folder unless that setting is missing (as in tests).
"""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables; our own only where none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back: cuts lineage, survives executor loss."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the files of shuffles that no table or plan refers to any more.

    It acts when the driver collects garbage, which may be long after a stage of many has ended.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_batches(df: DataFrame, most: int = 4 << 20) -> DataFrame:
    """``df``, after telling its session to hand Python about ``most`` bytes at a time, however long the texts are.

    A single row may be larger. What any query returns doesn't depend on the setting, which stays.
    """
    key, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    units = {"b": 0, "k": 10, "m": 20, "g": 30, "t": 40}
    now = conf.get(key).strip().lower().removesuffix("b") or "0"
    size = int(now.rstrip("kmgtib")) << units.get(now[-1], 0)
    if not 0 < size <= most:
        conf.set(key, f"{most}b")
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(id_column: str, modulus: int):
    """Fold number of a row: crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over uint64 arrays (multiplications wrap)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class WordHashes(dict):
    """Word -> stable unsigned 64-bit hash, remembered for a bounded number of words."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))
