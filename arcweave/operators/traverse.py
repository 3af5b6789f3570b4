"""Traversals: breadth-first search from many sources, impact, paths and audits.

Frontiers are DataFrames; a hop is an equi-join with the edges, an aggregation and an anti-join with what
has been seen. Each frontier is a table: it feeds the next hop and what has been seen, and its size is
known, so small ones are broadcast and large ones shuffled. The loop ends when a frontier is empty.

Where only who reaches whom and after how many hops counts, 64 sources are the bits of one number
(``reach``), so the rows grow with the nodes, not with pairs of nodes. Counts for all nodes at once
(``reach_counts``) come from one search, in which groups of sources unite what their neighbours reach.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import words
from ..functions.predicates import SINKS, is_test_audit, severity
from ..plans.lineage import cut, drop, placed


def directed(edges: DataFrame, direction: str) -> DataFrame:
    """``(at, to, kind)``: out follows calls, in goes to callers, both ignores direction."""
    out = edges.select(F.col("src").alias("at"), F.col("dst").alias("to"), "kind")
    back = edges.select(F.col("dst").alias("at"), F.col("src").alias("to"), "kind")
    return {"out": out, "in": back, "both": out.union(back)}[direction]


def bfs(edges: DataFrame, seeds: DataFrame, depth: int = 0, direction: str = "in") -> DataFrame:
    """``seeds(target, nid)`` -> ``(target, nid, hop, entry_edge)`` with the least hop of each pair; depth 0 is unlimited.

    entry_edge: kind of the first hop on a least path, the smallest of several; null at hop 0.
    """
    step = placed(directed(edges, direction).distinct(), "at")
    frontier = cut(seeds.select("target", "nid").distinct().withColumn("hop", F.lit(0)).withColumn("entry_edge", F.lit(None).cast("string")))
    seen, hop = frontier, 0
    while not depth or hop < depth:
        hop += 1
        frontier = (
            frontier.join(step, F.col("nid") == F.col("at")).groupBy("target", F.col("to").alias("nid"))
            .agg(F.min(F.coalesce("entry_edge", "kind")).alias("entry_edge"))
            .join(seen.select("target", "nid"), ["target", "nid"], "left_anti").select("target", "nid", F.lit(hop).alias("hop"), "entry_edge")
        )
        frontier = cut(frontier)
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen


def reach(edges: DataFrame, seeds: DataFrame, depth: int = 0, direction: str = "in") -> tuple[DataFrame, DataFrame]:
    """``seeds(nid)`` -> their numbers ``(nid, k)`` and ``(nid, block, hop, bits)``: the seeds that first reach a node at that hop.

    Bit b of block c stands for seed 64 c + b; hop 0 is each seed itself; depth 0 is unlimited.
    """
    numbers = cut(seeds.select("nid").distinct().withColumn("k", F.monotonically_increasing_id()))
    return numbers, _spread(placed(directed(edges, direction).select("at", "to").distinct(), "at"), numbers, depth)


def _spread(step: DataFrame, numbers: DataFrame, depth: int) -> DataFrame:
    """The rows of ``reach`` along ``step(at, to)`` for seeds of these ``numbers(nid, k)``; dead shuffles are removed after each hop."""
    frontier = cut(numbers.select("nid", F.expr("k div 64").alias("block"), F.lit(0).alias("hop"), F.expr("shiftleft(1L, cast(k % 64 as int))").alias("bits")))
    seen, hop = frontier, 0
    while not depth or hop < depth:
        hop += 1
        came = frontier.join(step, F.col("nid") == F.col("at")).groupBy(F.col("to").alias("nid"), "block").agg(F.bit_or("bits").alias("bits"))
        known = seen.groupBy("nid", "block").agg(F.bit_or("bits").alias("known"))
        fresh = came.join(known, ["nid", "block"], "left").withColumn("bits", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("known", F.lit(0)))))
        frontier = cut(fresh.where("bits <> 0").select("nid", "block", F.lit(hop).alias("hop"), "bits"))
        drop(step.sparkSession)
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen


#: Links in a group of sources, words that a group may unite at once, and words that may move at once: about 1 GB, before compression.
GROUP_LINKS = 1 << 19
GROUP_WORDS = 1 << 24
PART_WORDS = 1 << 26
#: Links that are dealt out at a time, the bits of a stretch of sources that stays in one part, and blocks in one row of packed words (16 KB at most).
PART_LINKS = 1 << 26
PART_BITS = 20
#: A group is cut into so many bits of slices of the numbers at most; a group's id has them free.
SLICE_BITS = 16
PACK = 1 << 10


def reach_counts(edges: DataFrame, depth: int = 0) -> tuple[DataFrame, DataFrame]:
    """``(nid, downstream)`` and ``(nid, upstream, direct)``: how many other nodes each node reaches, and is reached by, within ``depth`` hops.

    Nodes with a count of 0 are left out or have 0; depth 0 is unlimited; repeated edges count once. Both counts
    come from the same pairs, so one search is enough: what a node reaches is what its neighbours reach within a hop
    less. Only nodes that are called can lie between, so all hops but the last are made for those alone.

    Sources are grouped by ranges of their numbers, once. A hop sends a group the words of each node it has links to once,
    however many of its sources have them, and unites them there. Edges and words move in parts, whose files are
    deleted after them, so disk is bounded beyond the tables of links and words. Called nodes are numbered by the
    power of two of their callers, then by ``nid``: what a node reaches is few words.
    """
    spark = edges.sparkSession
    pairs = edges.select("src", "dst").where("src <> dst")
    drop(spark)
    called = cut(pairs.groupBy(F.col("dst").alias("nid")).agg(F.count("*").alias("n")))
    links = called.agg(F.sum(F.col("n") + 1)).first()[0] or 0
    ordered = called.select("nid", F.floor(F.log2("n")).alias("size"))
    numbers = cut(ordered.repartitionByRange(F.desc("size"), "nid").sortWithinPartitions(F.desc("size"), "nid").select("nid", F.monotonically_increasing_id().alias("k")))
    drop(spark, called)
    grouped = _grouped(pairs.union(numbers.select("nid", F.col("nid").alias("dst"))), links)
    direct = cut(grouped.groupBy(F.col("dst").alias("nid")).agg((F.sum(F.length("srcs") / 8) - 1).cast("long").alias("direct")))
    drop(spark)
    pack, packed = PACK, "nid long, pack long, blocks binary, bits binary, n long"
    reached = cut(numbers.select("nid", "k").mapInArrow(lambda batches: words.alone(batches, pack), packed))
    inner, hop, bits = grouped.where("inner"), 1, 0
    while depth != hop and bits < (bits := reached.agg(F.sum("n")).first()[0] or 0):
        before, hop = reached, hop + 1
        reached = _hop(inner, before, lambda rows: words.spread(rows, pack), packed)
        drop(spark, before)
    found = _hop(grouped, reached, words.counted, "id long, up boolean, n long")
    drop(spark, reached, grouped)
    sums = found.groupBy("id", "up").agg(F.sum("n").alias("n"))
    itself = numbers.select("nid", F.lit(1).alias("itself"))
    downstream = sums.where("not up").select(F.col("id").alias("nid"), "n").join(itself, "nid", "left").select("nid", (F.col("n") - F.coalesce("itself", F.lit(0))).alias("downstream"))
    upstream = sums.where("up").select(F.col("id").alias("k"), (F.col("n") - 1).alias("upstream")).join(numbers, "k").join(direct, "nid")
    return downstream, upstream.select("nid", "upstream", "direct")


def _grouped(pairs: DataFrame, links: int) -> DataFrame:
    """``pairs(src, dst)``, ``links`` at most, as ``(g, dst, inner, first, srcs)``: a group has a range of the sources and all their links."""
    spark, parts = pairs.sparkSession, 1 + links // PART_LINKS
    out = []
    for part in range(parts):
        mine = pairs.where(F.pmod(F.xxhash64(F.expr(f"shiftright(src, {PART_BITS})")), F.lit(parts)) == part) if parts > 1 else pairs
        dealt = mine.repartitionByRange(1 + links // parts // GROUP_LINKS, "src")
        out.append(cut(dealt.mapInArrow(words.grouped, "g long, dst long, inner boolean, first boolean, srcs binary").withColumn("g", F.lit(part << 40) + F.expr(f"shiftleft(g, {SLICE_BITS})")), compression="zstd"))
        drop(spark)
    return reduce(DataFrame.union, out)


def _hop(grouped: DataFrame, reached: DataFrame, unite, schema: str) -> DataFrame:
    """What ``unite`` makes of each group with the words of all that its sources have links to."""
    spark = grouped.sparkSession
    size = reached.groupBy(F.col("nid").alias("dst")).agg(F.sum(F.expr("length(blocks) div 8")).alias("w"))
    sizes = grouped.select("g", "dst", "first", F.expr("length(srcs) div 8").alias("n")).join(size, "dst").groupBy("g").agg(F.sum(F.when(F.col("first"), F.col("w"))).alias("w"), F.sum(F.col("w") * F.col("n")).alias("united"))
    sizes = cut(sizes.select("g", "w", F.expr(f"least(1 + united div {GROUP_WORDS}, {1 << SLICE_BITS})").alias("slices")))
    drop(spark)
    parts = 1 + (sizes.agg(F.sum("w")).first()[0] or 0) // PART_WORDS
    out = []
    for part in range(parts):
        mine = grouped.join(F.broadcast(sizes.where(F.pmod(F.xxhash64("g"), F.lit(parts)) == part)), "g")
        none = F.lit(b"")
        ends = mine.select(F.explode(F.sequence("g", F.expr("g + slices - 1"))).alias("g"), "dst", "srcs", none.alias("blocks"), none.alias("bits"))
        sent = mine.where("first").select("g", "dst", "slices").join(reached.withColumnRenamed("nid", "dst"), "dst")
        sent = sent.select((F.col("g") + F.pmod("pack", "slices")).alias("g"), "dst", none.alias("srcs"), "blocks", "bits")
        out.append(cut(ends.union(sent).groupBy("g").applyInArrow(unite, schema)))
        drop(spark)
    return reduce(DataFrame.union, out)


def _bit_sums(rows: DataFrame, *by: str) -> DataFrame:
    """How many of the rows of each group have a bit, as columns n0 to n63."""
    return rows.groupBy(*by).agg(*[F.sum(F.getbit("bits", F.lit(b)).cast("long")).alias(f"n{b}") for b in range(64)])


def _by_number(sums: DataFrame, *by: str) -> DataFrame:
    """A row ``(*by, k, n)`` for each such count that isn't 0."""
    each = F.explode(F.array(*[F.struct((F.col("block") * 64 + b).alias("k"), F.col(f"n{b}").alias("n")) for b in range(64)]))
    return sums.select(*by, each.alias("c")).where("c.n > 0").select(*by, "c.k", "c.n")


def hop_counts(numbers: DataFrame, reached: DataFrame) -> DataFrame:
    """``(target, hop, n)`` of what ``reach`` gives: how many nodes each seed reaches first at a hop, itself apart."""
    each = _by_number(_bit_sums(reached.where("hop > 0"), "block", "hop"), "hop")
    return each.join(numbers, "k").select(F.col("nid").alias("target"), "hop", "n")


def impact(edges: DataFrame, targets: DataFrame, depth: int = 0, direction: str = "upstream") -> DataFrame:
    """Affected nodes ``(target, nid, hop, severity, entry_edge)`` of each of ``targets(nid)``, the target itself excluded."""
    seeds = targets.select(F.col("nid").alias("target"), "nid")
    found = bfs(edges, seeds, depth, "in" if direction == "upstream" else "out").where("hop > 0")
    return found.withColumn("severity", severity(F.col("hop")))


def impact_both(edges: DataFrame, targets: DataFrame, depth: int = 0) -> DataFrame:
    """Both directions with a ``direction`` column; a node on both sides appears twice."""
    return impact(edges, targets, depth, "upstream").withColumn("direction", F.lit("upstream")).union(impact(edges, targets, depth, "downstream").withColumn("direction", F.lit("downstream")))


def impact_counts(found: DataFrame) -> DataFrame:
    """(target, direct, transitive, distant, total) of impact rows."""
    return found.groupBy("target").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("direct", "transitive", "distant")], F.count("*").alias("total"))


def impact_summary(edges: DataFrame, targets: DataFrame, depth: int = 0, direction: str = "upstream") -> DataFrame:
    """The same counts for each of ``targets(nid)`` that affects anything, without a row for each affected node."""
    counts = hop_counts(*reach(edges, targets, depth, "in" if direction == "upstream" else "out")).withColumn("severity", severity(F.col("hop")))
    of = lambda s: F.sum(F.when(F.col("severity") == s, F.col("n")).otherwise(0)).alias(s)
    return counts.groupBy("target").agg(*map(of, ("direct", "transitive", "distant")), F.sum("n").alias("total"))


def neighbours(edges: DataFrame, nid: int, side: str, kind: str = "calls") -> DataFrame:
    """Callers (side "in") or callees ("out") of a node, one row per parallel edge."""
    return directed(edges.where(F.col("kind") == kind), side).where(F.col("at") == nid).select(F.col("to").alias("nid"))


def shortest_path(edges: DataFrame, source: int, target: int) -> DataFrame:
    """``(step, nid)`` of a shortest directed path, however long: the least one by node numbers; no rows if there is none.

    Two searches meet: levels from the source and levels to the target, the smaller one growing by a hop.
    Then levels shrink to what lies on a shortest path, and the path follows the smallest node of each;
    only its own nodes, one a step, go to the driver.
    """
    spark = edges.sparkSession
    calls = edges.select("src", "dst").distinct()
    one = lambda nid: cut(spark.range(1).select(F.lit(nid).cast("long").alias("nid")))
    ends = {"src": ("dst", [one(source)]), "dst": ("src", [one(target)])}
    sizes = {"src": 1, "dst": 1}
    met = source == target
    while not met:
        at = min(sizes, key=sizes.get)
        to, levels = ends[at]
        fresh = levels[-1].join(calls, F.col("nid") == F.col(at)).select(F.col(to).alias("nid")).distinct()
        levels.append(cut(fresh.join(reduce(DataFrame.union, levels), "nid", "left_anti")))
        facing = ends[to][1][-1].withColumn("met", F.lit(True))
        sizes[at], met = levels[-1].join(facing, "nid", "left").agg(F.count("*"), F.count("met")).first()
        if not sizes[at]:
            return spark.createDataFrame([], "step int, nid long")
    from_source, to_target = ends["src"][1], ends["dst"][1]
    on = [cut(from_source[-1].join(to_target[-1], "nid", "left_semi"))]
    for level in from_source[-2::-1]:  # back from the meeting: what leads on to it
        leads = calls.join(on[0].select(F.col("nid").alias("dst")), "dst", "left_semi").select(F.col("src").alias("nid")).distinct()
        on.insert(0, cut(level.join(leads, "nid", "left_semi")))
    path = [source]
    for level in [*on[1:], *to_target[-2::-1]]:  # a level to the target needs no shrinking: all of it leads on
        after = calls.where(F.col("src") == path[-1]).select(F.col("dst").alias("nid"))
        path.append(after.join(level, "nid", "left_semi").agg(F.min("nid")).first()[0])
    return spark.createDataFrame(list(enumerate(path)), "step int, nid long")


def audit_sinks(nodes: DataFrame, edges: DataFrame, targets: DataFrame, depth: int = 8, direction: str = "upstream") -> DataFrame:
    """``(target, nid, name, hop)``: what each of ``targets(nid)`` reaches, or is reached from by default, that is named like a sink."""
    found = impact(edges, targets, depth, direction)
    return found.join(nodes, "nid").where(F.lower("name").rlike(SINKS)).select("target", "nid", "name", "hop")


def audit_paths(nodes: DataFrame, edges: DataFrame, sinks: DataFrame, depth: int = 8, skip_tests: bool = True) -> DataFrame:
    """Simple call paths from each of ``sinks(nid)`` up to nodes without callers, or of ``depth`` nodes.

    ``(sink, root, trace array<long>, severity)``; parallel edges repeat a path; a node all of whose callers are
    tests ends none. The number of paths can grow exponentially with ``depth``; nothing is capped.
    """
    calls = edges.where("kind = 'calls'").select("src", "dst")
    tests = nodes.where(is_test_audit(F.col("file"))).select(F.col("nid").alias("src"))
    called = calls.select(F.col("dst").alias("end")).distinct()
    step = calls.join(tests, "src", "left_anti") if skip_tests else calls
    grown = sinks.select(F.col("nid").alias("sink"), F.col("nid").alias("end"), F.array("nid").alias("trace"))
    done = []
    for k in range(1, depth + 1):
        done.append(grown.join(called, "end", "left_anti") if k < depth else grown)
        if k < depth:
            grown = grown.join(step, F.col("end") == F.col("dst")).where(~F.array_contains("trace", F.col("src"))).select("sink", F.col("src").alias("end"), F.concat("trace", F.array("src")).alias("trace"))
    out = done[0].select("sink", "end", "trace")
    for more in done[1:]:
        out = out.union(more.select("sink", "end", "trace"))
    size = F.size("trace")
    level = F.when(size <= 2, "critical").when(size <= 4, "high").when(size <= 6, "medium").otherwise("low")
    return out.select("sink", F.col("end").alias("root"), "trace", level.alias("severity"))
