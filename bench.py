"""Times the headline queries: one JSON line with warm medians in seconds.

The graph of a folder of tables and its centrality are built once, as an index is, and queries run on what is kept:
``build_graph`` and ``centrality_raw`` time the building. With BENCH_TREE set, ``index_tree`` parses and resolves a generated
source tree of 12,406 files, once.

BENCH_SF_DIR: the tables (default sf0.1); BENCH_CPUS: local cores (default 8); BENCH_RUNS: timed runs of each (default 3).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [os.path.dirname(os.path.abspath(__file__)), os.environ.get("PYTHONPATH")]))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from arcweave.api import CodeGraph  # noqa: E402
from arcweave.operators import rank  # noqa: E402
from arcweave.plans import queries as plans  # noqa: E402
from arcweave.plans.lineage import cut  # noqa: E402
from arcweave.sources import tables  # noqa: E402

NAMES = ["graph_stats", "degree", "impact_upstream", "impact_downstream", "impact_summary", "shortest_path", "centrality_raw", "centrality_percentile", "resolve_refs", "search_ranked", "tokenize_documents", "blast_radius", "changed_ranges", "map_topk_per_file", "audit_paths", "debounce_events", "export_edges"]


def fan_graph(spark: SparkSession):
    """200 hubs with 49 callers each, every fourth caller in a test file, the hubs in a chain: 10,000 nodes, 9,999 edges."""
    ids = spark.range(10_000).select(F.col("id").alias("nid"), (F.col("id") % 50).alias("k"), F.expr("id div 50").alias("hub"))
    nodes = ids.select("nid", F.when((F.col("k") > 0) & (F.col("k") % 4 == 0), "src/tests/t.py").otherwise("src/a.py").alias("file"))
    edges = ids.where("k > 0 or hub < 199").select(F.col("nid").alias("src"), F.when(F.col("k") > 0, F.col("hub") * 50).otherwise(F.col("nid") + 50).alias("dst"), F.lit("calls").alias("kind"))
    return nodes, edges


def source_tree(root: str, files: int = 12_406, functions: int = 29) -> None:
    """Python files in directories of 50, whose functions call each other by names that occur once, often, and never."""
    for k in range(files):
        folder = os.path.join(root, f"pkg{k // 50}")
        os.makedirs(folder, exist_ok=True)
        body = [f"from pkg{(k + 7) % files // 50}.m{(k + 7) % files} import f{(k + 7) % files}_0"]
        for j in range(functions):
            body.append(f"def f{k}_{j}(x):\n    f{k}_{(j + 1) % functions}(x)\n    helper_{j % 9}(x)\n    f{(k + 7) % files}_0(x)\n    x.run_{j}()\n    return missing_{j}(x)\n")
        body.append(f"def helper_{k % 9}(x):\n    return x\n")
        with open(os.path.join(folder, f"m{k}.py"), "w", encoding="utf-8") as f:
            f.write("\n".join(body))


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus, runs = int(os.environ.get("BENCH_CPUS", "8")), int(os.environ.get("BENCH_RUNS", "3"))
    conf = {"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": str(cpus), "spark.driver.memory": "12g", "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false"}
    conf["spark.checkpoint.dir"] = tempfile.mkdtemp(prefix="bench-")
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    todo = {name: (lambda f=plans.queries()[name]: f(spark, d)) for name in NAMES}
    todo["centrality_fan_10k"] = lambda: rank.centrality_raw(*fan_graph(spark), tolerance=None)
    todo["build_graph"] = lambda: (cut(tables.nodes(spark, d)), cut(tables.edges(spark, d)))[1]
    if os.environ.get("BENCH_TREE"):
        tree = tempfile.mkdtemp(prefix="tree-")
        source_tree(tree)
        todo["index_tree"] = lambda: CodeGraph.of_source(spark, tree).edges
    times = {}
    for name, query in todo.items():
        taken = []
        for _ in range(1 if name == "index_tree" else runs + 1):
            began = time.time()
            query().write.format("noop").mode("overwrite").save()
            taken.append(time.time() - began)
        times[name] = round(statistics.median(taken[1:] or taken), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "seconds, warm median, all queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(d.rstrip("/")), "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
