"""The kept graph: Parquet tables of nodes, references and imports, partitioned by a hash of the file.

An update replaces the partitions of changed files only and edges are resolved anew from the
references, so an incremental update gives what a full build gives.
"""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of another version are as good as none: a new version of the engine starts from an empty store.
VERSION, BUCKETS = "1", 64


def bucket(file="file"):
    return F.pmod(F.xxhash64(file), F.lit(BUCKETS)).cast("int")


def save(df: DataFrame, path: str) -> None:
    """Write a table of rows with a ``file`` column; a row without a file keeps the columns of an empty one."""
    blank = df.sparkSession.createDataFrame([(None,) * len(df.columns)], T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields]))
    df.union(blank).withColumn("engine_version", F.lit(VERSION)).withColumn("bucket", F.coalesce(bucket(), F.lit(0))).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("file").isNotNull() & (F.col("engine_version") == VERSION)).drop("bucket", "engine_version")


def files(spark: SparkSession, path: str) -> DataFrame:
    """The files that a kept table holds."""
    return load(spark, path).select("file").distinct()


def clear(spark: SparkSession, path: str) -> None:
    """Leave an empty table of the same columns."""
    save(spark.createDataFrame([], spark.read.parquet(path).drop("engine_version", "bucket").schema), path)


def newer_than(listing: DataFrame, mtime) -> DataFrame:
    """One row: whether any of ``listing(mtime)`` is newer; an empty listing is not."""
    return listing.agg(F.coalesce(F.max("mtime") > F.lit(mtime), F.lit(False)).alias("newer"))


def update(spark: SparkSession, path: str, fresh: DataFrame, gone: DataFrame) -> None:
    """Replace the rows of the files in ``fresh`` and of ``gone(file)``; only their partitions are rewritten."""
    from ..plans.lineage import cut

    old = spark.read.parquet(path)
    changed = fresh.select("file").union(gone.select("file")).distinct()
    touched = changed.select(bucket().alias("bucket")).distinct()
    kept = old.join(F.broadcast(touched), "bucket", "left_semi").join(changed, "file", "left_anti").select(old.columns)
    new = cut(kept.unionByName(fresh.withColumn("engine_version", F.lit(VERSION)).withColumn("bucket", bucket()).select(old.columns)))
    # a row without a file in each: a bucket that lost its last file is overwritten as well
    rows = new.unionByName(touched, allowMissingColumns=True).repartition("bucket")
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        rows.write.mode("overwrite").partitionBy("bucket").parquet(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)


def stale(listing: DataFrame, cached: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``listing(file, mtime)`` against ``cached(file, mtime)``: files to parse (new or another time), files that are gone."""
    changed = listing.join(cached.select("file", F.col("mtime").alias("old")), "file", "left").where("old is null or old <> mtime").drop("old")
    return changed, cached.select("file").join(listing, "file", "left_anti")


def commit(spark: SparkSession, path: str, tables: dict[str, DataFrame]) -> str:
    """Write ``tables`` below ``path`` as one version: they count from the moment its row is added to ``path/versions``, all or none."""
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    for name, df in tables.items():
        df.write.parquet(f"{path}/{version}/{name}")
    spark.createDataFrame([(version, VERSION)], "version string, engine_version string").coalesce(1).write.mode("append").parquet(f"{path}/versions")
    return version


def committed(spark: SparkSession, path: str) -> str | None:
    """Folder of the last committed version; None if there is none of this engine's."""
    try:
        last = spark.read.parquet(f"{path}/versions").where(F.col("engine_version") == VERSION).agg(F.max("version")).first()[0]
    except AnalysisException:  # nothing was ever kept there
        return None
    return last and f"{path}/{last}"
