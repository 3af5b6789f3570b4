"""Upkeep of a stored graph from a stream of file changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rank, resolve
from ..plans.lineage import cut
from ..sources import files, store

TABLES = ("nodes", "refs", "imports")


def build(spark: SparkSession, sources: DataFrame, path: str) -> None:
    """Parse ``sources(file, content)`` and keep nodes, references and imports below ``path``."""
    for name, df in zip(TABLES, files.tables(cut(files.parse_files(sources)))):
        store.save(df, f"{path}/{name}")


def edges(spark: SparkSession, path: str) -> DataFrame:
    """Call edges of the kept graph, resolved anew, so they are those of a full build."""
    nodes, refs, imports = (store.load(spark, f"{path}/{name}") for name in TABLES)
    return resolve.resolve_edges(refs, nodes.select("nid", F.col("qualified_name").alias("fqn"), "file"), imports)


def apply_changes(spark: SparkSession, path: str, changes: DataFrame) -> None:
    """Apply ``changes(file, ts, op, content)``: the last one of each file counts; ``remove`` drops it.

    Fit for ``foreachBatch``: only the partitions of changed files are rewritten.
    """
    last = changes.groupBy("file").agg(F.max_by(F.struct("op", "content"), "ts").alias("c")).select("file", "c.op", "c.content")
    fresh = last.where("op <> 'remove'").select("file", "content")
    for name, df in zip(TABLES, files.tables(cut(files.parse_files(fresh)))):
        store.update(spark, f"{path}/{name}", df, last.select("file"))


def edge_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(src, dst, ref, kind, op)``: edges that an update added or removed, for whoever follows the graph."""
    key = ["src", "dst", "ref", "kind"]
    added = after.select(key).exceptAll(before.select(key)).withColumn("op", F.lit("added"))
    return added.union(before.select(key).exceptAll(after.select(key)).withColumn("op", F.lit("removed")))


def centrality(spark: SparkSession, path: str) -> DataFrame:
    """Centrality of the kept graph, from the scores kept before where there are any; the new ones are kept as a version."""
    nodes, own = store.load(spark, f"{path}/nodes"), edges(spark, path)
    folder = store.committed(spark, f"{path}/scores")
    warm = spark.read.parquet(f"{folder}/centrality").select("nid", "raw") if folder else None
    store.commit(spark, f"{path}/scores", {"centrality": rank.centrality(nodes, own, warm=warm)})
    return spark.read.parquet(f"{store.committed(spark, f'{path}/scores')}/centrality")


def follow(stream: DataFrame, path: str, checkpoint: str):
    """Start a query that keeps the graph at ``path`` up to date with a stream of changes."""
    return stream.writeStream.foreachBatch(lambda batch, _: apply_changes(batch.sparkSession, path, batch)).option("checkpointLocation", checkpoint).start()


def sync(spark: SparkSession, root: str, path: str) -> DataFrame:
    """One poll of a source tree: new, touched and removed files are applied to the graph at ``path``; ``(file, op)`` of each.

    Files are told apart by their times, kept as a version below ``path/listing``; contents are read for changed ones only.
    """
    listing = files.scan_files(spark, root)
    folder = store.committed(spark, f"{path}/listing")
    before = spark.read.parquet(f"{folder}/files") if folder else spark.createDataFrame([], "file string, mtime timestamp")
    fresh, gone = store.stale(listing.select("file", "mtime"), before)
    done = cut(fresh.select("file", F.lit("modify").alias("op")).union(gone.select("file", F.lit("remove").alias("op"))))
    if folder is None:
        build(spark, listing.select("file", "content"), path)
    elif not done.isEmpty():
        apply_changes(spark, path, done.join(listing.select("file", "content"), "file", "left").withColumn("ts", F.current_timestamp()))
    store.commit(spark, f"{path}/listing", {"files": listing.select("file", "mtime")})
    return done


def watch(spark: SparkSession, root: str, path: str, checkpoint: str, every: str = "2 seconds"):
    """Start a query that polls the tree ``every`` so often and keeps the graph at ``path`` up to date."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(lambda batch, _: sync(batch.sparkSession, root, path)).trigger(processingTime=every).option("checkpointLocation", checkpoint).start()
