"""The engine as one object: a session, a graph, and the questions one asks of it."""

from __future__ import annotations

from functools import cached_property

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import change, rank, resolve, search, summary, traverse
from .plans.lineage import cut
from .sources import files, store, tables


class CodeGraph:
    """``nodes`` and ``edges`` with every operator as a method that returns a DataFrame.

    Centrality is made on first use and kept with both its raw values and percentiles.
    """

    def __init__(self, nodes: DataFrame, edges: DataFrame, lexicon: dict[str, list[str]] | None = None):
        self.nodes, self.edges, self.lexicon = nodes, edges, lexicon

    @classmethod
    def of_tables(cls, spark: SparkSession, sf_dir: str) -> CodeGraph:
        return cls(tables.nodes(spark, sf_dir), tables.edges(spark, sf_dir))

    @classmethod
    def of_source(cls, spark: SparkSession, root: str, patterns: list[str] | None = None) -> CodeGraph:
        """Parse a source tree and resolve its references."""
        # parsed once: nodes, references and imports are read from what parsing gave
        nodes, refs, imports = files.tables(cut(files.parse_files(files.scan_files(spark, root, patterns))))
        return cls.of_symbols(nodes, refs, imports)

    @classmethod
    def of_symbols(cls, nodes: DataFrame, refs: DataFrame, imports: DataFrame) -> CodeGraph:
        return cls(nodes, resolve.resolve_edges(refs, nodes.select("nid", F.col("qualified_name").alias("fqn"), "file"), imports))

    @cached_property
    def centrality(self) -> DataFrame:
        return cut(rank.centrality(self.nodes, self.edges))

    @cached_property
    def degrees(self) -> DataFrame:
        return rank.degree(self.nodes, self.edges)

    def _one(self, nid: int) -> DataFrame:
        return self.edges.sparkSession.range(1).select(F.lit(nid).cast("long").alias("nid"))

    def info(self) -> DataFrame:
        return summary.graph_stats(self.nodes, self.edges)

    def callers(self, nid: int) -> DataFrame:
        return traverse.neighbours(self.edges, nid, "in").join(self.nodes, "nid")

    def callees(self, nid: int) -> DataFrame:
        return traverse.neighbours(self.edges, nid, "out").join(self.nodes, "nid")

    def impact(self, nid: int, depth: int = 5) -> DataFrame:
        return traverse.impact_both(self.edges, self._one(nid), depth)

    def path(self, source: int, target: int) -> DataFrame:
        return traverse.shortest_path(self.edges, source, target).join(self.nodes, "nid").orderBy("step")

    def search(self, query: str) -> DataFrame:
        return search.search_ranked(self.nodes, query, self.lexicon)

    def symbol(self, name: str) -> DataFrame:
        return search.resolve_symbol(self.nodes, self.degrees, self.centrality, name)

    def inspect(self, nid: int) -> DataFrame:
        """Role by direct calls, with the node's own columns."""
        return summary.inspected(self.nodes.where(F.col("nid") == nid), self.degrees, self.centrality).join(self.nodes, "nid")

    def profile(self, nid: int) -> DataFrame:
        """Role, confidence and their reasons by what is reached either way."""
        return summary.profile(self.edges, self._one(nid)).join(self.nodes, "nid")

    def node(self, nid: int) -> DataFrame:
        """One row: the node with the ids of its distinct callers and callees."""
        ids = self.nodes.select(F.col("nid"), F.col("id").alias("other"))
        sides = [traverse.neighbours(self.edges, nid, side).distinct().join(ids, "nid").agg(F.sort_array(F.collect_list("other")).alias(name)) for side, name in (("in", "callers"), ("out", "callees"))]
        return self.nodes.where(F.col("nid") == nid).join(F.broadcast(sides[0])).join(F.broadcast(sides[1]))

    def overview(self) -> DataFrame:
        return summary.overview(self.nodes, self.edges)

    def onboard(self, k: int = 20) -> DataFrame:
        return summary.onboard(self.nodes, self.edges, self.centrality, k)

    def entry_points(self) -> DataFrame:
        return summary.entry_points(self.nodes)

    def file_graph(self, file: str) -> DataFrame:
        return summary.file_graph(self.nodes, self.edges, file)

    def suggest(self, word: str, k: int = 3) -> DataFrame:
        return search.suggest(self.nodes, self.edges, word, k)

    def discover(self, query: str, k: int = 10, kind: str | None = None) -> DataFrame:
        return search.discover(self.nodes, self.centrality, query, k, kind)

    def context(self, query: str, budget: int = 8000) -> DataFrame:
        return search.context_prefix(self.nodes, self.centrality, query, budget)

    def page(self, query: str, offset: int, limit: int) -> DataFrame:
        return search.page(search.search_literal(self.nodes, query), offset, limit)

    def direct_only(self, nid: int) -> DataFrame:
        return self.impact(nid, 1)

    def all_affected(self, nid: int, depth: int = 5) -> DataFrame:
        """Each affected node once, with its least hop on either side."""
        return self.impact(nid, depth).groupBy("nid").agg(F.min("hop").alias("hop"))

    def blast_radius(self, changed: DataFrame, depth: int = 5) -> DataFrame:
        return change.blast_radius(self.nodes, self.edges, change.changed_files(self.nodes, changed), depth)

    def guard(self, changed: DataFrame, most: int = 25) -> DataFrame:
        return change.guard(self.blast_radius(changed), self.review(changed), most)

    def audit_sinks(self, nid: int, depth: int = 8) -> DataFrame:
        return traverse.audit_sinks(self.nodes, self.edges, self._one(nid), depth)

    def batch(self, names: list[str]) -> DataFrame:
        """All nodes of the given names; names that don't occur are skipped."""
        return self.nodes.where(F.col("name").isin(*names)).join(self.degrees, "nid")

    def map(self, budget: int = 1024, focus: DataFrame | None = None) -> DataFrame:
        return summary.map_view(self.nodes, self.centrality, budget, focus)

    def explain(self, nid: int, max_tokens: int = 4000, depth: int = 2) -> DataFrame:
        return summary.slice_context(self.nodes, self.edges, nid, max_tokens, depth)

    def check(self, changed: DataFrame, most: int = 25) -> DataFrame:
        """Gate over changed files ``(changed)``."""
        return change.gate(change.blast_radius(self.nodes, self.edges, change.changed_files(self.nodes, changed)), most)

    def review(self, changed: DataFrame) -> DataFrame:
        return change.review(self.nodes, self.edges, self.centrality, change.changed_files(self.nodes, changed))

    def audit(self, sinks: DataFrame, depth: int = 8) -> DataFrame:
        return traverse.audit_paths(self.nodes, self.edges, sinks, depth)

    def save(self, path: str) -> None:
        """Keep nodes, edges and centrality below ``path`` as one version; a reader sees the version before or this one."""
        spark = self.nodes.sparkSession
        store.commit(spark, path, {"nodes": self.nodes, "edges": self.edges, "centrality": self.centrality})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> CodeGraph:
        folder = store.committed(spark, path)
        if folder is None:
            raise FileNotFoundError(f"no graph of this engine is kept in {path}")
        graph = cls(spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges"))
        graph.centrality = spark.read.parquet(f"{folder}/centrality")
        return graph

    @classmethod
    def of_snapshot(cls, spark: SparkSession, path: str) -> CodeGraph:
        """The graph of a JSON snapshot."""
        nodes, edges = spark.read.json(f"{path}/nodes"), spark.read.json(f"{path}/edges")
        return cls(nodes, edges)

    @classmethod
    def open(cls, spark: SparkSession, root: str, kept: str | None = None, snapshot: str | None = None) -> CodeGraph:
        """The kept graph if there is one, else that of a snapshot, else the tree is parsed anew and, given a place, kept."""
        if kept is not None and store.committed(spark, kept) is not None:
            return cls.load(spark, kept)
        if snapshot is not None:
            try:
                return cls.of_snapshot(spark, snapshot)
            except AnalysisException:  # no snapshot there
                pass
        graph = cls.of_source(spark, root)
        if kept is not None:
            graph.save(kept)
            graph = cls.load(spark, kept)
        return graph
