"""Traversal and ranking on small graphs with known answers."""

import pytest
from pyspark.sql import functions as F

from arcweave.operators import rank, summary, traverse


def graph(spark, pairs, files=None, kind="calls"):
    ids = sorted({x for p in pairs for x in p[:2]})
    files = files or {}
    nodes = spark.createDataFrame([(i, f"n{i}", f"m.n{i}", "function", files.get(i, "src/a.py"), 1, 5, None, None) for i in ids], "nid long, name string, qualified_name string, kind string, file string, line_start int, line_end int, signature string, docstring string")
    return nodes, spark.createDataFrame([(*p, kind) if len(p) == 2 else p for p in pairs], "src long, dst long, kind string")


def seed(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "nid long")


def hops(df):
    return {r["nid"]: r["hop"] for r in df.collect()}


def test_chain_both_directions(spark):
    _, edges = graph(spark, [(1, 2), (2, 3)])
    rows = {(r["nid"], r["direction"], r["hop"], r["severity"]) for r in traverse.impact_both(edges, seed(spark, 2)).collect()}
    assert rows == {(1, "upstream", 1, "direct"), (3, "downstream", 1, "direct")}


def test_diamond_meets_once(spark):
    _, edges = graph(spark, [(1, 2), (1, 3), (2, 4), (3, 4)])
    assert hops(traverse.impact(edges, seed(spark, 1), direction="downstream")) == {2: 1, 3: 1, 4: 2}


def test_cycle_ends_and_leaves_out_the_target(spark):
    _, edges = graph(spark, [(1, 2), (2, 3), (3, 1)])
    assert hops(traverse.impact(edges, seed(spark, 1))) == {3: 1, 2: 2}


@pytest.mark.parametrize("depth", [1, 3, 7])
def test_depth_limit(spark, depth):
    _, edges = graph(spark, [(i, i + 1) for i in range(9)])
    assert hops(traverse.impact(edges, seed(spark, 0), depth, "downstream")) == {i: i for i in range(1, depth + 1)}


def test_entry_edge_is_the_first_kind_of_a_least_path(spark):
    _, edges = graph(spark, [(1, 2, "imports"), (1, 3, "calls"), (2, 4, "calls"), (3, 4, "imports")])
    found = {r["nid"]: r["entry_edge"] for r in traverse.impact(edges, seed(spark, 1), 3, "downstream").collect()}
    assert found == {2: "imports", 3: "calls", 4: "calls"}


def test_shortest_path_takes_the_smallest_nodes(spark):
    _, edges = graph(spark, [(1, 5), (1, 3), (5, 9), (3, 9), (9, 10)])
    assert [r["nid"] for r in traverse.shortest_path(edges, 1, 10).orderBy("step").collect()] == [1, 3, 9, 10]
    assert traverse.shortest_path(edges, 10, 1).count() == 0


def test_shortest_path_has_no_limit(spark):
    _, edges = graph(spark, [(i, i + 1) for i in range(16)] + [(5, 9), (9, 5), (16, 0)])
    assert [r["nid"] for r in traverse.shortest_path(edges, 0, 16).orderBy("step").collect()] == [0, 1, 2, 3, 4, 5, *range(9, 17)]
    assert [r["nid"] for r in traverse.shortest_path(edges, 7, 7).collect()] == [7]


def test_bits_of_many_sources_equal_pairs(spark):
    import random

    rng = random.Random(3)
    _, edges = graph(spark, [(rng.randrange(150), rng.randrange(150)) for _ in range(260)])
    seeds = seed(spark, *range(0, 150))
    pairs = traverse.impact(edges, seeds, 4)
    assert {tuple(r) for r in traverse.impact_summary(edges, seeds, 4).collect()} == {tuple(r) for r in traverse.impact_counts(pairs).collect()}


@pytest.mark.parametrize("depth", [1, 2, 4, 0])
def test_profiles_in_parts_equal_pairs(spark, monkeypatch, depth):
    """Cycles, loops and parallel edges; the last hop in several parts; no table of a part stays on disk."""
    import os
    import random

    rng = random.Random(5)
    nodes, edges = graph(spark, [(rng.randrange(300), rng.randrange(200) if k % 9 else 7) for k in range(420)] + [(8, 8), (9, 7), (9, 7), (301, 301)])
    monkeypatch.setattr(traverse, "PART_WORDS", 900)
    monkeypatch.setattr(traverse, "PACK", 2)
    kept = set()
    whole = traverse.drop
    monkeypatch.setattr(traverse, "drop", lambda session, *tables: (kept.update(f for t in tables for f in t.inputFiles()), whole(session, *tables)))
    found = {r["nid"]: (r["upstream"], r["downstream"], r["direct"]) for r in summary.profiles(nodes, edges, depth).collect()}
    assert len(kept) > 1 and not any(os.path.exists("/" + f.split(":", 1)[1].lstrip("/")) for f in kept)
    ids = [r["nid"] for r in nodes.collect()]
    pairs = {(r["src"], r["dst"]) for r in edges.collect()}

    def reach(node, pairs):
        seen = at = {node}
        k = 0
        while at and (not depth or k < depth):
            at = {b for a, b in pairs if a in at} - seen
            seen, k = seen | at, k + 1
        return len(seen) - 1

    back = {(b, a) for a, b in pairs}
    assert found == {n: (reach(n, back), reach(n, pairs), len({a for a, b in pairs if b == n != a})) for n in ids}


@pytest.mark.parametrize("depth", [3, 0])
def test_counts_in_groups_and_slices_equal_pairs(spark, monkeypatch, depth):
    """Repeated edges, far and negative numbers; groups, parts of them and slices of their words of a few rows."""
    import random

    rng = random.Random(6)
    far = lambda n: n * 3_000_000 - 50_000_000
    pairs = [(far(rng.randrange(90)), far(rng.randrange(60))) for _ in range(110)] + [(far(1), far(n)) for n in range(40, 60)] + [(far(3), far(3))]
    edges = spark.createDataFrame(pairs + pairs[:50], "src long, dst long")
    for name, most in (("GROUP_LINKS", 30), ("GROUP_WORDS", 40), ("PART_LINKS", 100), ("PACK", 1)):
        monkeypatch.setattr(traverse, name, most)
    down, up = traverse.reach_counts(edges, depth)
    down, up = down.where("downstream > 0").collect(), up.where("upstream > 0").collect()
    expected = set()
    for node in {n for p in pairs for n in p}:
        seen = at = {node}
        k = 0
        while at and (not depth or k < depth):
            at = {b for a, b in pairs if a in at} - seen
            seen, k = seen | at, k + 1
        expected |= {(node, n) for n in seen if n != node}
    count = lambda end: {n: sum(p[end] == n for p in expected) for n in {p[end] for p in expected}}
    assert {r["nid"]: r["downstream"] for r in down} == count(0) and len(down) == len(count(0))
    assert {r["nid"]: r["upstream"] for r in up} == count(1) and len(up) == len(count(1))
    assert {r["nid"]: r["direct"] for r in up} == {n: len({a for a, b in pairs if b == n != a}) for n in count(1)}


def test_drop_frees_the_shuffles_of_the_last_query(spark):
    import time

    from arcweave.plans.lineage import cut, drop

    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {x for x in disk.getAllFiles().mkString(" ").split() if "shuffle_" in x}
    drop(spark)
    before = files()
    cut(spark.range(1000).repartition(7, "id"))
    assert files() - before
    drop(spark)
    for _ in range(20):
        if not files() - before:
            break
        time.sleep(0.2)
    assert not files() - before


def test_audit_paths_skip_tests(spark):
    nodes, edges = graph(spark, [(1, 2), (2, 9), (3, 9), (4, 9)], {4: "tests/x.py"})
    traces = {tuple(r["trace"]): r["severity"] for r in traverse.audit_paths(nodes, edges, seed(spark, 9)).collect()}
    assert traces == {(9, 2, 1): "high", (9, 3): "critical"}


def test_callers_keep_parallel_edges(spark):
    _, edges = graph(spark, [(1, 2), (1, 2), (3, 2)])
    assert sorted(r["nid"] for r in traverse.neighbours(edges, 2, "in").collect()) == [1, 1, 3]


@pytest.mark.parametrize("n", [3, 40])
def test_star_hub_is_on_top(spark, n):
    scores = {r["nid"]: r["pct"] for r in rank.centrality(*graph(spark, [(i, 0) for i in range(1, n + 1)])).collect()}
    assert scores[0] == 1.0 and all(scores[i] == 0.0 for i in range(1, n + 1))


def test_callers_in_tests_weigh_less_and_imports_nothing(spark):
    nodes, edges = graph(spark, [(1, 2), (3, 4), (5, 6, "imports")], {3: "src/tests/a.py"})
    raw = {r["nid"]: r["raw"] for r in rank.centrality_raw(nodes, edges).collect()}
    assert raw[2] > raw[4] > raw[6] == pytest.approx(raw[5])


def test_single_node_has_percentile_one(spark):
    nodes, edges = graph(spark, [(1, 1)])
    assert [r["pct"] for r in rank.centrality(nodes, edges).collect()] == [1.0]


def test_percentiles_of_tiny_scores(spark):
    n = 2_000_000
    scores = spark.range(n).select(F.col("id").alias("nid"), (F.lit(1e-13) * (1 + F.col("id") % 1000)).alias("raw"))
    found = {r["nid"]: r["pct"] for r in rank.percentile(scores).where("nid < 1000").collect()}
    assert found == pytest.approx({k: 2000 * k / (n - 1) for k in range(1000)})


def _halves(spark):
    """Two scores that end in half a digit but for the order of a sum, 1.00000005 even shares, and two others."""
    half = 1.00000005
    low = half - 4e-16
    assert low < half
    return spark.createDataFrame([(1, half / 4), (2, low / 4), (3, 0.9 / 4), (4, 1.1 / 4)], "nid long, raw double")


def test_half_digits_do_not_part_equal_scores(spark):
    found = {r["nid"]: r["pct"] for r in rank.percentile(_halves(spark)).collect()}
    assert found == pytest.approx({1: 1 / 3, 2: 1 / 3, 3: 0.0, 4: 1.0})


def test_half_digits_do_not_part_inspections(spark):
    nodes, edges = graph(spark, [(1, 4), (2, 4), (3, 4)])
    rows = summary.inspected(nodes, rank.degree(nodes, edges), rank.percentile(_halves(spark))).collect()
    assert len({(r["callers"], r["callees"], r["pct"], r["role"]) for r in rows if r["nid"] in (1, 2)}) == 1


def test_half_digits_do_not_order_a_map(spark):
    nodes, _ = graph(spark, [(1, 4), (2, 4), (3, 4)])
    swapped = _halves(spark).withColumn("nid", F.expr("CASE nid WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE nid END"))
    rows = summary.map_rows(nodes, rank.percentile(swapped)).collect()
    assert [r["nid"] for r in sorted(rows, key=lambda r: r["file_rank"])] == [4, 1, 2, 3]


def test_slices_do_not_depend_on_batches(spark):
    nodes, edges = graph(spark, [(0, k) for k in range(1, 400)])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
        rows = summary.slice_context(nodes, edges, 0, budget=100_000, depth=1).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(rows) == 401 and rows[-1]["nid"] is None and rows[-1]["tokens"] == sum(r["tokens"] for r in rows[:-1])


def test_warm_equals_cold(spark):
    nodes, edges = graph(spark, [(i, 0) for i in range(1, 31)] + [(0, 31), (31, 32)])
    cold = {r["nid"]: r["raw"] for r in rank.centrality_raw(nodes, edges, rounds=60).collect()}
    warm = spark.createDataFrame([(i, 0.5 / (i + 1)) for i in range(33)], "nid long, raw double")
    again = {r["nid"]: r["raw"] for r in rank.centrality_raw(nodes, edges, rounds=60, warm=warm).collect()}
    assert again == pytest.approx(cold, abs=1e-6)


def test_slice_skips_what_is_too_large(spark):
    nodes, edges = graph(spark, [(1, 2), (1, 3), (3, 4)])
    nodes = nodes.withColumn("line_end", F.when(F.col("nid") == 2, 500).otherwise(5))
    rows = summary.slice_context(nodes, edges, 1, budget=200, depth=2).collect()
    assert [r["nid"] for r in rows if r["nid"] is not None] == [1, 3, 4] and rows[-1]["reason"] == "token_budget"
    pinned = summary.slice_context(nodes, edges, 1, budget=200, depth=2, pinned=[2]).collect()
    assert 2 in [r["nid"] for r in pinned]
    short = summary.slice_context(nodes, edges, 1, budget=0, depth=1).collect()
    assert short[-1]["reason"] == "max_depth"


def test_profile_thresholds(spark):
    for up in (0, 1, 2, 3, 6, 21, 51):
        for down in (0, 1, 3, 6, 30):
            row = spark.range(1).select(summary.role(F.lit(up), F.lit(down)).alias("r"), summary.confidence_level(F.lit(up), F.lit(down)).alias("c")).first()
            role = "isolated" if up == down == 0 else "entry_point" if not up else "utility" if not down else "adapter" if (up <= 2 and down > 5) or (down <= 2 and up > 5) else "core_logic"
            level = "low" if up == down == 0 else ("medium" if down > 5 else "high") if not up else "high" if not down else "low" if up + down > 50 else "medium" if up + down > 20 else "high"
            assert (row["r"], row["c"]) == (role, level)


def test_sinks_in_either_direction(spark):
    nodes, edges = graph(spark, [(1, 2), (2, 3)])
    nodes = nodes.withColumn("name", F.when(F.col("nid") == 1, "runQuery").when(F.col("nid") == 3, "sendMail").otherwise("plain"))
    assert [r["nid"] for r in traverse.audit_sinks(nodes, edges, seed(spark, 2)).collect()] == [1]
    assert [r["nid"] for r in traverse.audit_sinks(nodes, edges, seed(spark, 2), direction="downstream").collect()] == [3]


def test_profiles_and_ranges_cover_everything(spark):
    from arcweave.operators import summary
    from arcweave.plans import queries as plans

    data = "/root/testdata/sf0.001"
    nodes = plans._graph(spark, data)[0].count()
    found = plans.queries()
    assert found["node_role"](spark, data).select("nid").distinct().count() == found["confidence_level"](spark, data).count() == nodes
    orders = {f"order_{r[0]}" for r in spark.read.parquet(f"{data}/orders.parquet").select("o_orderkey").collect()}
    hit = {r["file"] for r in found["changed_ranges"](spark, data).collect()}
    missed = {r["file"] for r in found["files_without_hits"](spark, data).collect()}
    assert hit & orders | missed == orders and not hit & missed

    pairs = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 7), (7, 8), (9, 4), (9, 8)]

    def reach(node, pairs, hops=5):
        seen = at = {node}
        for _ in range(hops):
            at = {b for a, b in pairs if a in at} - seen
            seen = seen | at
        return len(seen) - 1

    edges = spark.createDataFrame([(a, b, "calls") for a, b in pairs], "src long, dst long, kind string")
    rows = summary.profile(edges, spark.createDataFrame([(k,) for k in range(1, 11)], "nid long")).collect()
    assert {r["nid"]: (r["upstream"], r["downstream"]) for r in rows} == {k: (reach(k, [(b, a) for a, b in pairs]), reach(k, pairs)) for k in range(1, 11)}
