"""Centrality: a test-aware PageRank over calls, and percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import is_test_ranking
from ..plans.lineage import cut, placed


#: In even shares: a hundredth of the last digit that counts, and far more than sums in another order differ by.
_LIFT = 1e-9


def centrality_raw(nodes: DataFrame, edges: DataFrame, rounds: int = 20, damping: float = 0.85, warm: DataFrame | None = None, every: int = 5, tolerance: float | None = 1e-9) -> DataFrame:
    """``(nid, raw)``. Parallel calls count; callers in test files weigh a tenth; the mass of nodes without calls is lost.

    A round is one join of the shares, which are aggregated and placed by source once, with what the round
    before gave, and one aggregation by target: only nodes with callers move, all others keep the base score.
    Every ``every`` rounds the gains become a table and the loop ends when no score has moved by
    ``tolerance``, or by 1e-5 of an even share in graphs so large that this is less. ``warm(nid, raw)`` seeds the rounds with earlier scores.
    """
    total = nodes.count()
    if not total:
        return nodes.select("nid", F.lit(0.0).alias("raw"))
    calls = edges.where("kind = 'calls'").groupBy("src", "dst").agg(F.count("*").alias("n"))
    weight = nodes.select(F.col("nid").alias("src"), F.when(is_test_ranking(F.col("file")), 0.1).otherwise(1.0).alias("weight"))
    out = calls.groupBy("src").agg(F.sum("n").alias("out"))
    shares = placed(calls.join(out, "src").join(weight, "src").select("src", "dst", (F.col("weight") * F.col("n") / F.col("out")).alias("share")), "src")
    base = (1 - damping) / total
    ids = nodes.select("nid")
    passed = F.sum(F.col("share") * F.col("raw")).alias("gain")
    if warm is None:
        seed = shares.withColumn("raw", F.lit(1.0 / total))
    else:
        seed = shares.join(_rescaled(cut(ids), shares, warm, base, damping), F.col("src") == F.col("nid"))
    gains = seed.groupBy(F.col("dst").alias("nid")).agg(passed)
    before = None
    for k in range(2, rounds + 1):
        fed = shares.join(gains, F.col("src") == F.col("nid"), "left").select("dst", "share", (F.lit(base) + damping * F.coalesce("gain", F.lit(0.0))).alias("raw"))
        gains = fed.groupBy(F.col("dst").alias("nid")).agg(passed)
        if k % every == 0 and k < rounds:
            gains = cut(gains)
            if tolerance is not None and before is not None:
                moved = gains.join(before.withColumnRenamed("gain", "old"), "nid").agg(F.max(F.abs(F.col("gain") - F.col("old")))).first()[0]
                if moved is None or damping * moved < min(tolerance, 1e-5 / total):
                    break
            before = gains
    if rounds < 1:
        return ids.withColumn("raw", F.lit(1.0 / total))
    return ids.join(gains, "nid", "left").select("nid", (F.lit(base) + damping * F.coalesce("gain", F.lit(0.0))).alias("raw"))


def _rescaled(ids: DataFrame, shares: DataFrame, warm: DataFrame, base: float, damping: float) -> DataFrame:
    """Earlier scores times the one factor for which their sum is what a round would leave unchanged."""
    seed = cut(ids.join(warm.select("nid", F.col("raw").alias("old")), "nid", "left").select("nid", F.coalesce("old", F.lit(base)).alias("raw")))
    held = seed.agg(F.sum("raw")).first()[0] or 0.0
    passed = shares.join(seed, F.col("src") == F.col("nid")).agg(F.sum(F.col("share") * F.col("raw"))).first()[0] or 0.0
    n = ids.count()
    factor = n * base / max(held - damping * passed, 1e-300) if held > damping * passed else 1.0
    return seed.withColumn("raw", F.col("raw") * factor)


def percentile(scores: DataFrame) -> DataFrame:
    """``(nid, raw, pct)``: the share of the other nodes strictly below; ties share it; a single node has 1.

    Scores are equal if they are to seven digits of an even share, as sums in another order differ a little.
    Scores that end in exactly half a digit (shares of an eighth of a tenth do) are lifted over it first, else
    those differences would part nodes with the same callers, other ones in each run.
    No global window: the distinct scores are range-partitioned, counted by partition, and each gets the
    counts before its partition plus a running sum within it.
    """
    total = scores.count()
    scores = scores.withColumn("raw", F.round(F.col("raw") * total + _LIFT, 7) / total)
    values = cut(scores.groupBy("raw").agg(F.count("*").alias("n")).repartitionByRange("raw").withColumn("part", F.spark_partition_id()))
    whole = values.groupBy("part").agg(F.sum("n").alias("m"))
    # one row for each partition
    before = whole.select("part", F.coalesce(F.sum("m").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("m").over(Window.partitionBy()).alias("total"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("raw").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = values.withColumn("inside", inside).join(before, "part")
    ranked = ranked.select("raw", F.when(F.col("total") == 1, 1.0).otherwise((F.col("before") + F.col("inside")) / (F.col("total") - 1)).alias("pct"))
    return scores.join(ranked, "raw").select("nid", "raw", "pct")


def centrality(nodes: DataFrame, edges: DataFrame, **options) -> DataFrame:
    """``(nid, raw, pct)``: both are kept together, so a later warm start has its seed."""
    return percentile(centrality_raw(nodes, edges, **options))


def degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(nid, callers, callees)``: calls at either end, parallel ones counted."""
    edges = edges.where("kind = 'calls'")
    ends = edges.select(F.col("dst").alias("nid"), F.lit(1).alias("i"), F.lit(0).alias("o")).union(edges.select("src", F.lit(0), F.lit(1)))
    sums = ends.groupBy("nid").agg(F.sum("i").alias("callers"), F.sum("o").alias("callees"))
    return nodes.select("nid").join(sums, "nid", "left").select("nid", F.coalesce("callers", F.lit(0)).alias("callers"), F.coalesce("callees", F.lit(0)).alias("callees"))
