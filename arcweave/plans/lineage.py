"""Lineage control for iterative plans: tables and checkpoints in the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; our own only where none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame, **options: str) -> DataFrame:
    """``df`` written once as a table and read back: what follows knows its size, and a lost executor costs nothing before it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graph/{uuid.uuid4().hex}"
    df.write.parquet(path, **options)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete what ``cut`` wrote for these ``tables``, and let Spark remove the files of shuffles that nothing refers to any more.

    Spark does so when the driver collects garbage, which may be long after the last use. Its queues of events hold the
    last query until there is another one, hence the small one here.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {name.rsplit("/", 1)[0] for df in tables for name in df.inputFiles()}:
        at = jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(conf).delete(at, True)
    spark.range(1).collect()
    gc.collect()
    jvm.System.gc()


def placed(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt out and sorted by ``key`` once and checkpointed, which keeps both: joins on the key move only the other side."""
    shared_dir(df.sparkSession)
    return cut(df).repartition(key).sortWithinPartitions(key).checkpoint()


_KEPT: dict[tuple[str, str], DataFrame] = {}


def kept(spark: SparkSession, key: str, make) -> DataFrame:
    """What ``make`` gives, written as a table once in a Spark application."""
    own = (spark.sparkContext.applicationId, key)
    if own not in _KEPT:
        _KEPT[own] = cut(make())
    return _KEPT[own]
