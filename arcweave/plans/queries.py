"""The registered queries of the graph operators, each with the same question in SQL where SQL can put it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon, predicates, text
from ..operators import change, rank, resolve, search, summary, traverse
from ..parse.lines import RULES, line_symbols, markdown_sections
from ..plans.lineage import kept
from ..sources import tables
from ..streaming.debounce import debounce

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

NATION, REGION, ORDER, PART = 3 * 8 + 1, 1 * 8, 3 * 8 + 5, 7 * 8 + 4


def _query(sql: str | None = None):
    def keep(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return keep


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The graph of a folder of tables: built once in a Spark application, as an index is, and kept as two tables."""
    return kept(spark, f"nodes {d}", lambda: tables.nodes(spark, d)), _edges(spark, d)


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return kept(spark, f"edges {d}", lambda: tables.edges(spark, d))


def _centrality(spark: SparkSession, d: str) -> DataFrame:
    """Centrality of that graph, kept like it; ``centrality_raw`` works it out each time."""
    return kept(spark, f"centrality {d}", lambda: rank.centrality(*_graph(spark, d), tolerance=None))


def _ids(spark: SparkSession, *nids: int) -> DataFrame:
    return spark.createDataFrame([(n,) for n in nids], "nid long")


def _with(*ctes: str) -> str:
    return "WITH RECURSIVE " + ", ".join([tables.WITH_GRAPH, *ctes])


def _reach(name: str, seeds: str, side: str, depth: int) -> str:
    """CTEs ``name(target, nid, hop)`` with least hops, hop 0 included."""
    at, to = ("dst", "src") if side == "in" else ("src", "dst")
    return f"{name}_all AS (SELECT nid AS target, nid, 0 AS hop FROM ({seeds}) s UNION SELECT r.target, e.{to}, r.hop + 1 FROM {name}_all r JOIN edges e ON e.{at} = r.nid WHERE r.hop < {depth}), {name} AS (SELECT target, nid, min(hop) AS hop FROM {name}_all GROUP BY target, nid)"


_SEVERITY = "CASE WHEN hop <= 1 THEN 'direct' WHEN hop <= 3 THEN 'transitive' ELSE 'distant' END"
_TEST_RANKING = r"regexp_matches(lower(file), '[/\\](test|spec)|__test__|_test\.|\.(test|spec)\.|/(fixture|mock|stub|fake)|test\.(ts|js)$')"
_TEST_SEGMENT = r"(regexp_matches(replace(lower(file), '\', '/'), '(^|/)(test|tests|spec|specs|fixture|fixtures|mock|mocks|__tests__|__mocks__|testfixtures)(/|$)') OR regexp_matches(replace(lower(file), '\', '/'), 'tests?\.java$|test\.(rs|tsx?|jsx?|py|go)$|tests?\.cs$|_test\.dart$|\.(spec|test)\.|(^|/)test_[^/]*$|(^|/)conftest\.py$'))"
_ENTRY = r"""(kind IN ('function', 'method') AND (name IN ('main', '__main__')
 OR (regexp_matches(lower(name), '_(view|handler|controller|endpoint)$|^(handle|get|post|put|delete|patch)_') AND regexp_matches(lower(file), 'route|view|handler|controller|endpoint|api'))
 OR regexp_matches(lower(name), 'webhook|receive|subscribe|^on_') OR (starts_with(lower(name), 'handle') AND NOT contains(lower(file), 'test'))
 OR (regexp_matches(lower(name), 'job|task|worker|cron|_run$|^(run|execute|process)$') AND regexp_matches(lower(file), 'job|task|worker|cron|celery|sidekiq|background'))
 OR regexp_matches(lower(name), 'command|_cmd$|^(cli|invoke)$')))"""
_HANDLER = "(kind IN ('function', 'method') AND regexp_matches(lower(name), '^(on|handle)|(handler|callback|listener)$'))"
_CALLBACK = "regexp_matches(lower(name), '(fn|callback|handler)$|^on_')"
_WIDGET = "(kind = 'class' AND regexp_matches(name, '(Widget|State|Page|Screen|View)$'))"


@_query(f"{_with()} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(DISTINCT file) FROM nodes) AS files, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM edges WHERE kind = 'calls') AS calls")
def graph_stats(spark, d):
    return summary.graph_stats(*_graph(spark, d))


@_query(f"{_with()} SELECT regexp_extract(file, '\\.([^./]+)$', 1) AS ext, count(DISTINCT file) AS files FROM nodes GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def status_languages(spark, d):
    return summary.languages(_graph(spark, d)[0])


@_query(f"{_with()} SELECT e.src AS nid, n.name FROM edges e JOIN nodes n ON n.nid = e.src WHERE e.dst = {NATION} AND e.kind = 'calls'")
def callers(spark, d):
    nodes, edges = _graph(spark, d)
    return traverse.neighbours(edges, NATION, "in").join(nodes, "nid").select("nid", "name")


@_query(f"{_with()} SELECT e.dst AS nid, n.name FROM edges e JOIN nodes n ON n.nid = e.dst WHERE e.src = {ORDER} AND e.kind = 'calls'")
def callees(spark, d):
    nodes, edges = _graph(spark, d)
    return traverse.neighbours(edges, ORDER, "out").join(nodes, "nid").select("nid", "name")


@_query(f"{_with()} SELECT n.nid, (SELECT count(*) FROM edges e WHERE e.dst = n.nid AND kind = 'calls') AS callers, (SELECT count(*) FROM edges e WHERE e.src = n.nid AND kind = 'calls') AS callees FROM nodes n")
def degree(spark, d):
    return rank.degree(*_graph(spark, d))


@_query(f"{_with(_reach('r', f'SELECT CAST({REGION} AS BIGINT) AS nid', 'in', 3))} SELECT nid, hop FROM r WHERE hop > 0")
def dependents(spark, d):
    return traverse.impact(_graph(spark, d)[1], _ids(spark, REGION), 3).select("nid", "hop")


def _impact_sql(nid: int, side: str, depth: int) -> str:
    """Least hops, and the smallest kind of first hop on a least path, by hop."""
    at, to = ("dst", "src") if side == "in" else ("src", "dst")
    reach = _reach("r", f"SELECT CAST({nid} AS BIGINT) AS nid", side, depth)
    entry = [f"e1 AS (SELECT e.{to} AS nid, min(e.kind) AS entry_edge FROM edges e WHERE e.{at} = {nid} AND e.{to} <> {nid} GROUP BY 1)"]
    for k in range(2, depth + 1):
        entry.append(f"e{k} AS (SELECT e.{to} AS nid, min(p.entry_edge) AS entry_edge FROM e{k - 1} p JOIN edges e ON e.{at} = p.nid JOIN r ON r.nid = e.{to} AND r.hop = {k} GROUP BY 1)")
    union = " UNION ALL ".join(f"SELECT * FROM e{k}" for k in range(1, depth + 1))
    return f"{_with(reach, *entry)} SELECT r.nid, r.hop, {_SEVERITY} AS severity, x.entry_edge FROM r JOIN ({union}) x ON x.nid = r.nid WHERE r.hop > 0"


@_query(_impact_sql(NATION, "in", 5))
def impact_upstream(spark, d):
    return traverse.impact(_graph(spark, d)[1], _ids(spark, NATION), 5).select("nid", "hop", "severity", "entry_edge")


@_query(_impact_sql(ORDER, "out", 5))
def impact_downstream(spark, d):
    return traverse.impact(_graph(spark, d)[1], _ids(spark, ORDER), 5, "downstream").select("nid", "hop", "severity", "entry_edge")


_NATIONS = "SELECT nid FROM nodes WHERE file = 'src/geo/nations.py'"


@_query(f"{_with(_reach('r', _NATIONS, 'in', 5))} SELECT target, count(*) FILTER (WHERE hop <= 1) AS direct, count(*) FILTER (WHERE hop IN (2, 3)) AS transitive, count(*) FILTER (WHERE hop > 3) AS distant, count(*) AS total FROM r WHERE hop > 0 GROUP BY target")
def impact_summary(spark, d):
    nodes, edges = _graph(spark, d)
    return traverse.impact_summary(edges, nodes.where("file = 'src/geo/nations.py'"), 5)


# Least distances to the target, keyed by node, and the walk from the source: neither has a limit.
_PATH = (
    "away(nid, hop) USING KEY (nid) AS (SELECT CAST({target} AS BIGINT), 0 UNION SELECT e.src, r.hop + 1 FROM away r JOIN edges e ON e.dst = r.nid LEFT JOIN recurring.away k ON k.nid = e.src WHERE k.nid IS NULL),"
    " walk(step, nid, hop) AS (SELECT 0, nid, hop FROM away WHERE nid = {source} UNION ALL SELECT w.step + 1, min(e.dst), w.hop - 1 FROM walk w JOIN edges e ON e.src = w.nid JOIN away a ON a.nid = e.dst AND a.hop = w.hop - 1 GROUP BY w.step, w.hop)"
)


@_query(f"{_with(_PATH.format(source=101 * 8 + 5, target=REGION))} SELECT step, nid FROM walk")
def shortest_path(spark, d):
    """From order 101 to a region; no rows where none leads there."""
    return traverse.shortest_path(_graph(spark, d)[1], 101 * 8 + 5, REGION)


_CHAIN = f"WITH RECURSIVE edges AS (SELECT c_custkey AS src, c_custkey + 1 AS dst FROM customer UNION ALL SELECT c_custkey, c_custkey + 3 FROM customer WHERE c_custkey % 5 = 0), {_PATH.format(source=1, target=60)}"


@_query(f"{_CHAIN} SELECT step, nid FROM walk")
def shortest_path_long(spark, d):
    """A path of dozens of hops along a chain of customers with short cuts."""
    customers = tables.load(spark, d, "customer")
    chain = customers.select(F.col("c_custkey").alias("src"), (F.col("c_custkey") + 1).alias("dst"))
    return traverse.shortest_path(chain.union(customers.where("c_custkey % 5 = 0").select("c_custkey", F.col("c_custkey") + 3)), 1, 60)


def _rank_ctes(rounds: int = 20) -> str:
    base = (
        f", wt AS MATERIALIZED (SELECT nid, CASE WHEN {_TEST_RANKING} THEN 0.1 ELSE 1.0 END::DOUBLE AS weight FROM nodes), n AS MATERIALIZED (SELECT count(*)::DOUBLE AS n FROM nodes), o AS MATERIALIZED (SELECT src, count(*)::DOUBLE AS out FROM edges WHERE kind = 'calls' GROUP BY src)"
        ", share AS MATERIALIZED (SELECT e.src, e.dst, wt.weight / o.out AS share FROM edges e JOIN o ON o.src = e.src JOIN wt ON wt.nid = e.src WHERE e.kind = 'calls'), s0 AS MATERIALIZED (SELECT nid, 1.0 / n.n AS raw FROM nodes, n)"
    )
    for k in range(1, rounds + 1):
        base += f", s{k} AS MATERIALIZED (SELECT i.nid, 0.15::DOUBLE / n.n + 0.85::DOUBLE * coalesce(g.gain, 0) AS raw FROM nodes i CROSS JOIN n LEFT JOIN (SELECT h.dst, sum(h.share * s.raw) AS gain FROM share h JOIN s{k - 1} s ON s.nid = h.src GROUP BY h.dst) g ON g.dst = i.nid)"
    return base + f", c AS MATERIALIZED (SELECT nid, round(raw * n.n, 7) / n.n AS raw, percent_rank() OVER (ORDER BY round(raw * n.n, 7)) AS pct FROM s{rounds}, n)"


@_query(f"{_with()}{_rank_ctes()} SELECT nid, round(raw, 9) AS raw FROM c")
def centrality_raw(spark, d):
    return rank.centrality_raw(*_graph(spark, d), tolerance=None).select("nid", F.round("raw", 9).alias("raw"))


@_query(f"{_with()}{_rank_ctes()} SELECT nid, round(pct, 6) AS pct FROM c")
def centrality_percentile(spark, d):
    return _centrality(spark, d).select("nid", F.round("pct", 6).alias("pct"))


@_query(f"{_with()}{_rank_ctes()}, top AS (SELECT * FROM c ORDER BY pct DESC, nid LIMIT 20) SELECT n.nid, n.name, n.file, round(top.pct, 6) AS pct FROM top JOIN nodes n ON n.nid = top.nid")
def hotspots(spark, d):
    nodes, edges = _graph(spark, d)
    return summary.hotspots(nodes, _centrality(spark, d)).withColumn("pct", F.round("pct", 6))


# The resolver, written as lists of candidates rather than as joins on counts.
_RESOLVER = (
    f"WITH {tables.WITH_SYMBOLS}, sfx AS MATERIALIZED (SELECT nid, fqn, file, regexp_extract(file, '^(.*)/[^/]*$', 1) AS dir, fqn AS key FROM symbols UNION ALL SELECT nid, fqn, file, regexp_extract(file, '^(.*)/[^/]*$', 1), split_part(fqn, '.', 2) FROM symbols WHERE contains(fqn, '.')),"
    " imp AS MATERIALIZED (SELECT file, local, max(module) AS module FROM imports GROUP BY 1, 2), nrm AS (SELECT file, local, regexp_replace(module, '\\.py$', '') AS module FROM imp),"
    " asked AS MATERIALIZED (SELECT src, file, ref, starts_with(ref, '.') AS unknown, regexp_replace(ref, '^\\.', '') AS key, regexp_extract(file, '^(.*)/[^/]*$', 1) AS dir FROM refs),"
    " cand AS MATERIALIZED (SELECT a.src, a.ref, a.file, a.dir, a.unknown, a.key, s.nid, s.fqn = a.key AS exact, s.file AS sfile, s.dir AS sdir, contains('.' || regexp_replace(replace(s.file, '/', '.'), '\\.py$', '') || '.', '.' || nrm.module || '.') AS imported FROM asked a JOIN sfx s ON s.key = a.key LEFT JOIN nrm ON nrm.file = a.file AND nrm.local = a.key),"
    " agg AS (SELECT src, ref, any_value(file) AS file, any_value(unknown) AS unknown, any_value(key) AS key, count(*) AS n, count(*) FILTER (WHERE exact) AS ne, min(nid) FILTER (WHERE exact) AS enid, min(nid) AS anid, count(*) FILTER (WHERE sfile = file) AS nf, min(nid) FILTER (WHERE sfile = file) AS fnid, count(*) FILTER (WHERE imported) AS ni, min(nid) FILTER (WHERE imported) AS inid, count(*) FILTER (WHERE sdir = dir) AS nd, min(nid) FILTER (WHERE sdir = dir) AS dnid FROM cand GROUP BY src, ref),"
    " rung AS MATERIALIZED (SELECT src, ref, file, unknown, key, n, CASE WHEN ne = 1 THEN 'exact' WHEN n = 1 THEN CASE WHEN ne > 0 THEN 'exact' ELSE 'unique_suffix' END WHEN nf = 1 THEN 'same_file' WHEN ni = 1 THEN 'via_import' WHEN nd = 1 THEN 'same_dir' ELSE 'ambiguous' END AS resolution, CASE WHEN ne = 1 THEN enid WHEN n = 1 THEN anid WHEN nf = 1 THEN fnid WHEN ni = 1 THEN inid WHEN nd = 1 THEN dnid END AS nid FROM agg),"
    " drawn AS (SELECT src, ref, file, unknown, resolution, nid AS dst FROM rung WHERE nid IS NOT NULL UNION ALL SELECT r.src, r.ref, r.file, r.unknown, r.resolution, c.nid FROM rung r JOIN cand c ON c.src = r.src AND c.ref = r.ref WHERE r.nid IS NULL AND r.n <= CASE WHEN r.unknown THEN 2 ELSE 4 END),"
    " based AS (SELECT x.*, s.file AS dfile, CASE resolution WHEN 'exact' THEN 1.0 WHEN 'same_file' THEN 0.95 WHEN 'via_import' THEN 0.93 WHEN 'unique_suffix' THEN 0.8 WHEN 'same_dir' THEN 0.55 ELSE 0.25 END::DOUBLE * CASE WHEN unknown THEN 0.55 ELSE 1.0 END::DOUBLE AS base FROM drawn x JOIN symbols s ON s.nid = x.dst WHERE x.src <> x.dst),"
    " resolved AS MATERIALIZED (SELECT b.src, b.dst, b.ref, b.resolution, CASE WHEN b.unknown OR NOT EXISTS (SELECT 1 FROM imp WHERE imp.file = b.file) OR contains(b.ref, '.') THEN base WHEN EXISTS (SELECT 1 FROM imp WHERE imp.file = b.file AND imp.local = b.ref) THEN greatest(base, 0.95) WHEN b.file = b.dfile THEN base WHEN regexp_extract(b.file, '^(.*)/[^/]*$', 1) = regexp_extract(b.dfile, '^(.*)/[^/]*$', 1) THEN base * 0.6 ELSE base * 0.3 END::DOUBLE AS confidence FROM based b)"
)


def _parsed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """References, symbols and imports of a folder of tables: what parsing gives, kept like the graph."""
    return tuple(kept(spark, f"{name} {d}", lambda name=name: getattr(tables, name)(spark, d)) for name in ("references", "symbols", "imports"))


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    edges = resolve.resolve_edges(*_parsed(spark, d))
    return edges.withColumn("confidence", F.round(F.col("confidence").cast("double"), 4))


@_query(f"{_RESOLVER} SELECT src, dst, ref, resolution, round(confidence, 4) AS confidence FROM resolved")
def resolve_refs(spark, d):
    return _resolved(spark, d).drop("kind")


@_query(f"{_RESOLVER} SELECT a.unknown, coalesce(r.resolution, 'unresolved') AS resolution, count(*) AS refs FROM asked a LEFT JOIN rung r ON r.src = a.src AND r.ref = a.ref GROUP BY 1, 2")
def resolution_rungs(spark, d):
    found = resolve.resolve(*_parsed(spark, d))
    return found.groupBy("unknown", "resolution").agg(F.count("*").alias("refs"))


@_query(f"{_RESOLVER} SELECT resolution, round(confidence, 4) AS confidence, count(*) AS edges FROM resolved GROUP BY 1, 2")
def edge_confidence_histogram(spark, d):
    return _resolved(spark, d).groupBy("resolution", "confidence").agg(F.count("*").alias("edges"))


@_query(f"{_RESOLVER} SELECT count(*) AS edges, count(*) FILTER (WHERE round(confidence, 4) >= 0.75) AS confident FROM resolved")
def confident_edges(spark, d):
    return _resolved(spark, d).agg(F.count("*").alias("edges"), F.count_if(F.col("confidence") >= resolve.CONFIDENT).alias("confident"))


@_query(f"WITH {tables.WITH_SYMBOLS} SELECT key, count(DISTINCT nid) AS n FROM (SELECT nid, fqn AS key FROM symbols UNION ALL SELECT nid, split_part(fqn, '.', 2) FROM symbols WHERE contains(fqn, '.')) t GROUP BY key")
def symbol_suffixes(spark, d):
    return resolve.definitions(_parsed(spark, d)[1]).groupBy("key").agg(F.count("*").alias("n"))


@_query(f"{_with()}{_rank_ctes()}, own AS (SELECT nid, file, (SELECT count(*) FROM edges e WHERE (e.dst = n.nid OR e.src = n.nid) AND kind = 'calls') AS degree FROM nodes n WHERE name = (SELECT name FROM nodes WHERE nid = {PART})) SELECT row_number() OVER (ORDER BY degree DESC, pct DESC, file, own.nid) AS rank, own.nid, file, degree FROM own JOIN c ON c.nid = own.nid")
def resolve_symbol_ranked(spark, d):
    """The nodes that share the name of part 7."""
    nodes, edges = _graph(spark, d)
    name = nodes.where(F.col("nid") == PART).first()
    return search.resolve_symbol(nodes, rank.degree(nodes, edges), _centrality(spark, d), name["name"] if name else "").withColumn("rank", F.col("rank").cast("long"))


@_query(f"{_with()} SELECT nid, name FROM nodes WHERE contains(lower(name), 'gear') OR contains(lower(name), 'page')")
def search_literal(spark, d):
    return search.search_literal(_graph(spark, d)[0], "gear|Page").select("nid", "name")


def _tokens_sql(column: str) -> str:
    spaced = f"regexp_replace(regexp_replace({column}, '([\\p{{Ll}}\\p{{N}}])(\\p{{Lu}})', '\\1 \\2', 'g'), '(\\p{{Lu}})(\\p{{Lu}}\\p{{Ll}})', '\\1 \\2', 'g')"
    return f"list_filter(regexp_split_to_array(translate({spaced}, '{text.UPPER}', '{text.LOWER}'), '[^\\p{{L}}\\p{{N}}]+'), lambda t: octet_length(encode(t)) >= 2)"


def _stem_sql(t: str) -> str:
    rules = [(s, len(s) + more) for group, more in ((("ing", "ers", "ed"), 3), (("es", "er", "s"), 2)) for s in group]
    return "CASE " + " ".join(f"WHEN octet_length(encode({t})) > {n} AND ends_with({t}, '{s}') THEN left({t}, -{len(s)})" for s, n in rules) + f" ELSE {t} END"


def _ranked_sql(query: str) -> str:
    tokens = search._plain_tokens(query)
    stems = sorted({search._plain_stem(t) for t in tokens})
    others = sorted({search._plain_stem(r) for t in tokens for r in lexicon.expand(t) - {t}})
    listed = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    own = f"list_transform({_tokens_sql('name')}, lambda t: {_stem_sql('t')})"
    doc = f"list_transform({_tokens_sql('concat_ws(chr(32), docstring, signature, file, qualified_name)')}, lambda t: {_stem_sql('t')})"
    return (
        f"{_with()}, t AS (SELECT nid, lower(name) AS low, {own} AS own, {doc} AS doc FROM nodes), m AS (SELECT nid, CASE WHEN low = '{query}' THEN 1 WHEN contains(low, '{query}') THEN 2 WHEN list_has_all(own, {listed(stems)}) THEN 3 WHEN list_has_any(own, {listed(stems)}) THEN 4 WHEN list_has_any(own, {listed(others)}) THEN 5 WHEN list_has_any(doc, {listed(stems)}) THEN 6 END AS k FROM t)"
        " SELECT nid, ['exact', 'substring', 'all_tokens', 'some_tokens', 'concept', 'documentation'][k] AS match, [1.0, 0.85, 0.8, 0.55, 0.45, 0.3][k]::DOUBLE AS score FROM m WHERE k IS NOT NULL"
    )


@_query(_ranked_sql("get query member"))
def search_ranked(spark, d):
    return search.search_ranked(_graph(spark, d)[0], "get query member")


@_query(f"SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, {_tokens_sql('text')} AS t FROM documents) x")
def tokenize_documents(spark, d):
    docs = tables.load(spark, d, "documents").select("doc_id", text.tokenize(F.col("text")).alias("t"))
    return docs.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


@_query(f"{_with()}, t AS (SELECT DISTINCT unnest({_tokens_sql('name')}) AS token FROM nodes) SELECT token, {_stem_sql('token')} AS stem FROM t")
def stem_tokens(spark, d):
    tokens = _graph(spark, d)[0].select(F.explode(text.tokenize(F.col("name"))).alias("token")).distinct()
    return tokens.select("token", text.stem(F.col("token")).alias("stem"))


_LEXICON = ", ".join(f"('{c}', '{w}')" for c, words in lexicon.clusters().items() for w in dict.fromkeys(words))


@_query(f"WITH l(concept, token) AS (VALUES {_LEXICON}) SELECT DISTINCT a.token, b.token AS related FROM l a JOIN l b ON b.concept = a.concept")
def concept_expand(spark, d):
    rows = [(c, w) for c, words in lexicon.clusters().items() for w in dict.fromkeys(words)]
    table = spark.createDataFrame(rows, "concept string, token string")
    return table.alias("a").join(table.alias("b"), "concept").select("a.token", F.col("b.token").alias("related")).distinct()


@_query(f"{_with()} SELECT nid, name FROM nodes WHERE {_ENTRY}")
def entry_points(spark, d):
    return summary.entry_points(_graph(spark, d)[0]).select("nid", "name")


@_query(
    f"{_with()}, f AS (SELECT DISTINCT file FROM nodes) SELECT file, {_TEST_RANKING} AS ranking, {_TEST_SEGMENT} AS segment, regexp_matches(lower(file), '/(test|spec|fixture|mock)|__tests__|\\.(test|spec)\\.|_test\\.') AS service, regexp_matches(lower(file), 'test|spec') AS audit,"
    " regexp_matches(lower(file), '\\.min\\.(js|css)$|\\.(chunk|bundle)\\.|/(dist|build|generated)/|/resources/(monitor|static)/|(^|/)[^./]*\\.[0-9a-f]{8,}\\.[^/]*$') AS generated FROM f"
)
def test_file_flags(spark, d):
    file = F.col("file")
    flags = {"ranking": predicates.is_test_ranking, "segment": predicates.is_test_segment, "service": predicates.is_test_service, "audit": predicates.is_test_audit, "generated": predicates.is_generated}
    return _graph(spark, d)[0].select("file").distinct().select("file", *[f(file).alias(name) for name, f in flags.items()])


@_query(f"{_with()} SELECT nid, 'event_source' AS source, 'event_handler' AS kind, 0.7::DOUBLE AS confidence FROM nodes WHERE {_HANDLER} UNION ALL SELECT nid, 'caller', 'callback', 0.6::DOUBLE FROM nodes WHERE {_CALLBACK} UNION ALL SELECT nid, 'parent_widget', 'widget_tree', 0.8::DOUBLE FROM nodes WHERE {_WIDGET}")
def uncertain_edges(spark, d):
    return summary.uncertain_edges(_graph(spark, d)[0])


@_query(f"{_with()}, s AS (SELECT 'callback' AS pattern, count(*) AS n, 5 AS m FROM nodes WHERE {_CALLBACK} UNION ALL SELECT 'event_handler', count(*), 3 FROM nodes WHERE {_HANDLER} UNION ALL SELECT 'widget', count(*), 0 FROM nodes WHERE {_WIDGET}) SELECT pattern, n FROM s WHERE n > m")
def analysis_limitations(spark, d):
    return summary.limitations(_graph(spark, d)[0])


_ALL = "SELECT nid FROM nodes"
_COUNTED = "SELECT target, count(*) AS n FROM {} WHERE hop > 0 GROUP BY target"
_PROFILE_SQL = (
    f"{_with(_reach('u', _ALL, 'in', 5), _reach('w', _ALL, 'out', 5))}, p AS (SELECT t.nid, coalesce(a.n, 0) AS upstream, coalesce(b.n, 0) AS downstream"
    f" FROM nodes t LEFT JOIN ({_COUNTED.format('u')}) a ON a.target = t.nid LEFT JOIN ({_COUNTED.format('w')}) b ON b.target = t.nid)"
)


def _profiled(spark: SparkSession, d: str) -> DataFrame:
    """Of every node; only ends of edges and numbers of nodes are read, once each, so neither table of the graph is needed."""
    return kept(spark, f"profile {d}", lambda: summary.profiles(tables.nodes(spark, d), tables.edges(spark, d, repeats=True)).drop("direct", "reasons"))


@_query(f"{_PROFILE_SQL} SELECT nid, upstream, downstream, CASE WHEN upstream = 0 AND downstream = 0 THEN 'isolated' WHEN upstream = 0 THEN 'entry_point' WHEN downstream = 0 THEN 'utility' WHEN (upstream <= 2 AND downstream > 5) OR (downstream <= 2 AND upstream > 5) THEN 'adapter' ELSE 'core_logic' END AS role FROM p")
def node_role(spark, d):
    """Of every node."""
    return _profiled(spark, d).select("nid", "upstream", "downstream", "role")


@_query(f"{_PROFILE_SQL} SELECT nid, CASE WHEN upstream = 0 AND downstream = 0 THEN 'low' WHEN upstream = 0 THEN CASE WHEN downstream > 5 THEN 'medium' ELSE 'high' END WHEN downstream = 0 THEN 'high' WHEN upstream + downstream > 50 THEN 'low' WHEN upstream + downstream > 20 THEN 'medium' ELSE 'high' END AS confidence FROM p")
def confidence_level(spark, d):
    return _profiled(spark, d).select("nid", "confidence")


@_query(
    f"{_with()}{_rank_ctes()}, ins AS (SELECT dst AS nid, count(*) AS n FROM edges WHERE kind = 'calls' GROUP BY dst), outs AS (SELECT src AS nid, count(*) AS n FROM edges WHERE kind = 'calls' GROUP BY src),"
    f" q AS (SELECT n.nid, coalesce(i.n, 0) AS callers, coalesce(o.n, 0) AS callees, round(c.pct, 6) AS pct, {_ENTRY} AS entry FROM nodes n JOIN c ON c.nid = n.nid LEFT JOIN ins i ON i.nid = n.nid LEFT JOIN outs o ON o.nid = n.nid)"
    " SELECT *, CASE WHEN entry THEN 'entry_point' WHEN callers = 0 THEN 'unreachable' WHEN callees = 0 THEN 'utility' ELSE 'internal' END AS role FROM q"
)
def inspect_role(spark, d):
    nodes, edges = _graph(spark, d)
    return summary.inspected(nodes, rank.degree(nodes, edges), _centrality(spark, d)).withColumn("pct", F.round("pct", 6))


@_query(
    f"{_with()}{_rank_ctes()}, e AS (SELECT name, file, row_number() OVER (ORDER BY name, nid) AS rank FROM nodes WHERE {_ENTRY}), h AS (SELECT n.name, n.file, round(c.pct, 6) AS pct, row_number() OVER (ORDER BY c.pct DESC, c.nid) AS rank FROM c JOIN nodes n ON n.nid = c.nid)"
    " SELECT 'total' AS section, 1::BIGINT AS rank, 'symbols' AS name, NULL::VARCHAR AS detail, (SELECT count(*) FROM nodes)::DOUBLE AS value UNION ALL SELECT 'total', 2, 'connections', NULL, (SELECT count(*) FROM edges)::DOUBLE"
    " UNION ALL SELECT DISTINCT 'language', NULL::BIGINT, regexp_extract(file, '\\.([^./]+)$', 1), NULL, NULL::DOUBLE FROM nodes WHERE regexp_matches(file, '\\.([^./]+)$')"
    " UNION ALL SELECT 'entry', rank, name, file, NULL::DOUBLE FROM e WHERE rank <= 20 UNION ALL SELECT 'hotspot', rank, name, file, pct FROM h WHERE rank <= 20"
)
def agent_onboard(spark, d):
    return summary.onboard(*_graph(spark, d), _centrality(spark, d)).withColumn("value", F.round("value", 6))


_CHANGED = "SELECT nid FROM nodes WHERE file IN ('src/jobs/supply_1.py', 'src/geo/regions.py')"
_BLAST = (
    f"{_with(_reach('u', _CHANGED, 'in', 5), _reach('w', _CHANGED, 'out', 5))}, a AS MATERIALIZED (SELECT nid, hop FROM u WHERE hop > 0 UNION ALL SELECT nid, hop FROM w WHERE hop > 0), ids AS (SELECT DISTINCT nid FROM a),"
    f" b AS (SELECT (SELECT count(*) FROM ({_CHANGED}) c) AS changed, (SELECT count(DISTINCT nid) FROM a WHERE hop <= 1) AS direct, (SELECT count(DISTINCT nid) FROM a WHERE hop > 1) AS indirect, (SELECT count(*) FROM ids) AS affected,"
    " (SELECT count(*) FROM ids WHERE nid NOT IN (SELECT dst FROM edges)) AS entrypoints, (SELECT count(DISTINCT file) FROM nodes WHERE nid IN (SELECT nid FROM ids) AND file NOT IN ('src/jobs/supply_1.py', 'src/geo/regions.py')) AS files)"
)
_RISK = "CASE WHEN affected > 50 THEN 'critical' WHEN affected > 25 THEN 'high' WHEN affected > 10 THEN 'medium' ELSE 'low' END AS risk"


def _blast(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(spark, d)
    files = spark.createDataFrame([("jobs/supply_1.py",), ("src/geo/regions.py",)], "changed string")
    return change.blast_radius(nodes, edges, change.changed_files(nodes, files))


@_query(f"{_BLAST} SELECT *, {_RISK} FROM b")
def blast_radius(spark, d):
    return _blast(spark, d)


@_query(f"{_BLAST} SELECT affected, (affected > 25 OR entrypoints > 0 OR indirect > 12) AS risky FROM b")
def check_gate(spark, d):
    return change.gate(_blast(spark, d)).select("affected", "risky")


@_query(f"{_with()} SELECT nid, file FROM nodes WHERE ends_with(file, '/jobs/supply_1.py') OR file = 'src/geo/regions.py'")
def changed_file_match(spark, d):
    files = spark.createDataFrame([("jobs\\supply_1.py",), ("src/geo/regions.py",), ("ply_2.py",)], "changed string")
    return change.changed_files(_graph(spark, d)[0], files)


_RANGES = "syms AS (SELECT l_orderkey * 8 + l_linenumber AS nid, concat('order_', CAST(l_orderkey AS VARCHAR)) AS file, 10 * l_linenumber AS line_start, 10 * l_linenumber + CAST(floor(l_quantity) AS INT) AS line_end FROM lineitem), ranges AS (SELECT concat('order_', CAST(o_orderkey AS VARCHAR)) AS file, 15 AS start, 35 AS stop FROM orders)"


def _ranges(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    items, orders = tables.load(spark, d, "lineitem"), tables.load(spark, d, "orders")
    start = 10 * F.col("l_linenumber")
    symbols = items.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("nid"), F.concat(F.lit("order_"), F.col("l_orderkey").cast("string")).alias("file"), start.alias("line_start"), (start + F.floor("l_quantity").cast("int")).alias("line_end"))
    return symbols, orders.select(F.concat(F.lit("order_"), F.col("o_orderkey").cast("string")).alias("file"), F.lit(15).alias("start"), F.lit(35).alias("stop"))


@_query(f"WITH {_RANGES} SELECT nid, file FROM syms s WHERE EXISTS (SELECT 1 FROM ranges r WHERE r.file = s.file AND (s.line_end = 0 OR (r.start <= s.line_end AND s.line_start <= r.stop)))")
def changed_ranges(spark, d):
    return change.changed_ranges(*_ranges(spark, d))


@_query(f"WITH {_RANGES} SELECT DISTINCT file FROM ranges r WHERE NOT EXISTS (SELECT 1 FROM syms s WHERE r.file = s.file AND (s.line_end = 0 OR (r.start <= s.line_end AND s.line_start <= r.stop)))")
def files_without_hits(spark, d):
    return change.files_without_hits(*_ranges(spark, d))


@_query(
    "WITH h AS (SELECT o_orderkey, o_custkey % 900 AS c, o_orderkey % 5 AS n FROM orders WHERE o_orderkey % 11 <> 0) SELECT o_orderkey, CASE WHEN n = 0 THEN greatest(c, 1) ELSE c END AS start,"
    " CASE WHEN n = 4 THEN c WHEN n = 0 THEN greatest(c, 1) ELSE c + n - 1 END AS stop FROM h"
)
def hunk_parse(spark, d):
    orders = tables.load(spark, d, "orders")
    c, n = (F.col("o_custkey") % 900).cast("string"), F.col("o_orderkey") % 5
    line = F.concat(F.lit("@@ -1,2 +"), c, F.when(n == 4, "").otherwise(F.concat(F.lit(","), n.cast("string"))), F.when(F.col("o_orderkey") % 11 == 0, " @").otherwise(" @@ def f():"))
    return orders.select("o_orderkey", text.hunk(line).alias("h")).where("h is not null").select("o_orderkey", "h.start", "h.stop")


@_query(f"{_with()}, geo AS (SELECT nid FROM nodes WHERE starts_with(file, 'src/geo/')) SELECT src, dst, kind FROM edges WHERE src IN (FROM geo) AND dst IN (FROM geo)")
def file_graph(spark, d):
    """The directory of regions and nations, as one file."""
    nodes, edges = _graph(spark, d)
    return summary.file_graph(nodes.withColumn("file", text.parent(F.col("file"))), edges, "src\\geo")


_MAP = (
    f"{_with()}{_rank_ctes()}, sc AS (SELECT n.nid, name, file, round(c.pct + CASE WHEN {_ENTRY} THEN 0.3 ELSE 0.0 END::DOUBLE + CASE WHEN kind IN ('class', 'interface', 'struct') THEN 0.1 WHEN kind = 'constructor' THEN -0.1 WHEN kind IN ('field', 'constant') THEN -0.2 ELSE 0.0 END::DOUBLE, 9) AS score FROM nodes n JOIN c ON c.nid = n.nid WHERE kind NOT IN ('import', 'export', 'module') AND NOT {_TEST_SEGMENT}),"
    " rk AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY score DESC, nid) AS file_rank FROM sc)"
)


@_query(f"{_MAP} SELECT nid, name, file, round(score, 6) AS score, file_rank FROM rk WHERE file_rank <= 5")
def map_topk_per_file(spark, d):
    nodes, edges = _graph(spark, d)
    rows = summary.map_rows(nodes, _centrality(spark, d))
    return rows.select("nid", "name", "file", F.round("score", 6).alias("score"), F.col("file_rank").cast("long").alias("file_rank"))


# A signature as name(a, b), and the fold over symbols in order: used characters, taken symbols, the file that is full, the end.
_SHORT = (
    "left(CASE WHEN n.signature IS NULL THEN n.name ELSE regexp_extract(n.signature, '([^ (]+)\\(', 1) || '('"
    " || array_to_string(list_transform(string_split(regexp_extract(n.signature, '\\((.*)\\)', 1), ','), lambda x: trim(string_split(string_split(x, ':')[1], '=')[1])), ', ') || ')' END, 80)"
)
_FOLD = (
    ", lead AS (SELECT file, score AS lead, nid AS lead_nid FROM rk WHERE file_rank = 1), so AS MATERIALIZED (SELECT row_number() OVER (ORDER BY l.lead DESC, l.lead_nid, r.file_rank) AS k, r.file_rank, l.lead_nid AS f, r.nid, r.file, r.score,"
    f" {_SHORT} AS short FROM rk r JOIN lead l ON l.file = r.file JOIN nodes n ON n.nid = r.nid WHERE r.file_rank <= 5),"
    " fold(k, used, taken, took, full_file, over) AS (SELECT 0::BIGINT, 0::BIGINT, 0::BIGINT, false, NULL::BIGINT, false UNION ALL"
    " SELECT k, CASE WHEN fits THEN used + cost ELSE used END, taken + fits::BIGINT, fits, CASE WHEN NOT fits THEN f ELSE full_file END, ended FROM (SELECT s.k, o.used, o.taken, o.full_file, s.f, length(s.short) + 50 AS cost,"
    " o.over OR (s.file_rank = 1 AND o.used >= 4096) AS ended, NOT (o.over OR (s.file_rank = 1 AND o.used >= 4096)) AND s.f IS DISTINCT FROM o.full_file AND (o.used + length(s.short) + 50 <= 4096 OR o.taken = 0) AS fits FROM fold o JOIN so s ON s.k = o.k + 1) x)"
)


@_query(
    _MAP + _FOLD
    + " SELECT o.taken AS rank, s.nid, CASE WHEN len(string_split(s.file, '/')) > 4 THEN concat(string_split(s.file, '/')[1], '/.../', array_to_string(string_split(s.file, '/')[-3:], '/')) ELSE s.file END AS path, s.short AS signature, round(s.score * 100) / 100 AS centrality"
    " FROM fold o JOIN so s ON s.k = o.k WHERE o.took"
)
def map_budget(spark, d):
    nodes, edges = _graph(spark, d)
    return summary.map_view(nodes, _centrality(spark, d))


@_query(
    f"{_with()}, ways AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),"
    f" near_all AS (SELECT CAST({ORDER} AS BIGINT) AS nid, 0 AS hop UNION SELECT w.b, n.hop + 1 FROM near_all n JOIN ways w ON w.a = n.nid WHERE n.hop < 3), near AS (SELECT nid, min(hop) AS hop FROM near_all GROUP BY nid),"
    " ordered AS MATERIALIZED (SELECT row_number() OVER (ORDER BY hop, x.nid) AS k, x.nid, hop, CAST(ceil((length(qualified_name) + length(file) + length(coalesce(signature, '')) + 2 + greatest(line_end - line_start, 0) * 40) / 4) AS BIGINT) AS tokens FROM near x JOIN nodes n ON n.nid = x.nid WHERE hop <= 2),"
    " fold(k, used, took) AS (SELECT 0::BIGINT, 0::BIGINT, false UNION ALL SELECT o.k, f.used + CASE WHEN f.used + o.tokens <= 2000 THEN o.tokens ELSE 0 END, f.used + o.tokens <= 2000 FROM fold f JOIN ordered o ON o.k = f.k + 1),"
    " why AS (SELECT CASE WHEN (SELECT count(*) FROM fold WHERE took) < (SELECT count(*) FROM ordered) THEN 'token_budget' WHEN EXISTS (SELECT 1 FROM near WHERE hop = 3) THEN 'max_depth' ELSE 'complete' END AS reason)"
    " SELECT o.nid, o.hop AS depth, o.tokens, false AS pinned, reason FROM fold f JOIN ordered o ON o.k = f.k CROSS JOIN why WHERE f.took UNION ALL SELECT NULL, NULL, (SELECT max(used) FROM fold), false, reason FROM why"
)
def slice_context(spark, d):
    return summary.slice_context(*_graph(spark, d), ORDER, 2000, 2)


@_query(f"{_with()}{_rank_ctes()}, hits AS (SELECT n.nid, name, c.pct, CAST(greatest(line_end - line_start, 0) * 40 // 4 AS BIGINT) AS tokens FROM nodes n JOIN c ON c.nid = n.nid WHERE contains(lower(name), 'gear')), run AS (SELECT *, sum(tokens) OVER (ORDER BY pct DESC, nid ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM hits) SELECT nid, name, tokens, used FROM run WHERE used <= 8000")
def context_prefix(spark, d):
    nodes, edges = _graph(spark, d)
    return search.context_prefix(nodes, _centrality(spark, d), "gear")


@_query(f"{_with()}{_rank_ctes()} SELECT n.nid, name, round(c.pct, 6) AS pct FROM nodes n JOIN c ON c.nid = n.nid WHERE contains(lower(name), 'supply') AND kind = 'function' ORDER BY c.pct DESC, n.nid LIMIT 10")
def discover(spark, d):
    nodes, edges = _graph(spark, d)
    return search.discover(nodes, _centrality(spark, d), "Supply", 10, "function").select("nid", "name", F.round("pct", 6).alias("pct"))


@_query(f"{_with()} SELECT count(*) AS nodes, count(DISTINCT file) AS files, count(DISTINCT regexp_extract(file, '^(.*)/[^/]*$', 1)) AS directories, count(*) FILTER (WHERE {_ENTRY}) AS entry_points, (SELECT count(*) FROM edges) AS edges FROM nodes")
def architecture_overview(spark, d):
    return summary.overview(*_graph(spark, d))


@_query(
    f"{_with()}, calls AS (SELECT src, dst FROM edges WHERE kind = 'calls'), step AS (SELECT c.src, c.dst FROM calls c JOIN nodes n ON n.nid = c.src WHERE NOT regexp_matches(lower(n.file), 'test|spec')),"
    f" p AS (SELECT nid AS sink, nid AS fin, [nid] AS trace FROM nodes WHERE nid IN (SELECT nid FROM nodes WHERE file = 'src/jobs/supply_3.py') UNION ALL SELECT p.sink, s.src, list_append(p.trace, s.src) FROM p JOIN step s ON s.dst = p.fin WHERE len(p.trace) < 4 AND NOT list_contains(p.trace, s.src)),"
    " d AS (SELECT * FROM p WHERE len(trace) = 4 OR fin NOT IN (SELECT dst FROM calls)) SELECT sink, fin AS root, array_to_string(trace, '>') AS trace, CASE WHEN len(trace) <= 2 THEN 'critical' WHEN len(trace) <= 4 THEN 'high' WHEN len(trace) <= 6 THEN 'medium' ELSE 'low' END AS severity FROM d"
)
def audit_paths(spark, d):
    nodes, edges = _graph(spark, d)
    found = traverse.audit_paths(nodes, edges, nodes.where("file = 'src/jobs/supply_3.py'").select("nid"), depth=4)
    return found.withColumn("trace", F.array_join(F.transform("trace", lambda x: x.cast("string")), ">"))


@_query(f"{_with(_reach('r', f'SELECT CAST({NATION} AS BIGINT) AS nid', 'in', 8))} SELECT r.nid, n.name, r.hop FROM r JOIN nodes n ON n.nid = r.nid WHERE hop > 0 AND regexp_matches(lower(n.name), 'query|exec|eval|write|delete|connect|send|request|fetch|open|read_file|spawn|database|sql|db|auth|login|password')")
def audit_sinks(spark, d):
    """Dependents of a node whose names look like sinks."""
    nodes, edges = _graph(spark, d)
    return traverse.audit_sinks(nodes, edges, _ids(spark, NATION)).select("nid", "name", "hop")


@_query(f"{_with()}, h AS (SELECT nid, name FROM nodes WHERE contains(lower(name), 'customer')), t AS (SELECT count(*) AS total FROM h) SELECT h.*, total, 60 < total AS has_more, CASE WHEN 60 < total THEN 60 END::BIGINT AS next_offset FROM h, t ORDER BY nid LIMIT 20 OFFSET 40")
def pagination(spark, d):
    return search.page(search.search_literal(_graph(spark, d)[0], "customer").select("nid", "name"), 40, 20)


@_query(
    f"{_with()}, s AS (SELECT nid, name, CASE WHEN lower(name) = 'supply_12' THEN 100 WHEN ends_with(lower(id), '.supply_12') THEN 80 WHEN starts_with(lower(name), 'supply_12') THEN 60 WHEN contains(lower(name), 'supply_12') THEN 40 WHEN jaro_winkler_similarity(lower(name), 'supply_12') > 0.75 THEN 30 END AS score FROM nodes)"
    " SELECT s.nid, s.name, s.score, (SELECT count(DISTINCT src) FROM edges e WHERE e.dst = s.nid) AS callers FROM s WHERE score IS NOT NULL ORDER BY score DESC, callers DESC, s.nid LIMIT 3"
)
def suggest(spark, d):
    return search.suggest(*_graph(spark, d), "supply_12")


@_query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents) SELECT doc_id, CAST(line AS INT) AS line, CAST(length(regexp_extract(raw, '^(#{1,6})[ \\t]', 1)) AS INT) AS level, regexp_extract(raw, '^#{1,6}\\s+.*?([A-Za-z_][A-Za-z0-9_]*)', 1) AS name FROM l WHERE regexp_matches(raw, '^#{1,6}\\s+\\S') AND regexp_extract(raw, '^#{1,6}\\s+.*?([A-Za-z_][A-Za-z0-9_]*)', 1) <> ''")
def markdown_headings(spark, d):
    return markdown_sections(tables.load(spark, d, "documents").select("doc_id", "text"), F.col("text")).drop("text")


_RULED = [(kind, f"regexp_matches(raw, '{rule}')", f"regexp_extract(raw, '{rule}', 1)") for kind, rule in RULES]


@_query(
    "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents), k AS (SELECT doc_id, CAST(line AS INT) AS line,"
    f" CASE {' '.join(f'WHEN {test} THEN {kind!r}' for kind, test, _ in _RULED)} END AS kind, CASE {' '.join(f'WHEN {test} THEN {name}' for _, test, name in _RULED)} END AS name FROM l WHERE NOT regexp_matches(raw, '^ *(#|//)')) SELECT * FROM k WHERE kind IS NOT NULL"
)
def line_declarations(spark, d):
    """All rules of the line parser over all documents."""
    docs = tables.load(spark, d, "documents").select("doc_id", "text")
    return line_symbols(docs, F.col("text")).drop("text")


@_query("SELECT page_id, target, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS target FROM pages) t WHERE target <> '' GROUP BY 1, 2")
def page_links(spark, d):
    return tables.links(spark, d)


@_query("SELECT src, dst, 'flows_to' AS kind FROM (SELECT event_id AS src, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) t WHERE dst IS NOT NULL")
def session_flow(spark, d):
    return tables.flows(spark, d)


@_query(
    "WITH g AS (SELECT user_id, ts, event_id, event_type, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)"
    " SELECT user_id AS path, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*) AS n, max_by(event_type, ts) AS op FROM s GROUP BY user_id, k"
)
def debounce_events(spark, d):
    changes = tables.load(spark, d, "events").select(F.col("user_id").alias("path"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("op"))
    return debounce(changes, "6 hours").select("path", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"), "n", "op")


def _review(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(spark, d)
    files = spark.createDataFrame([("jobs/supply_1.py",), ("src/geo/regions.py",)], "changed string")
    return change.review(nodes, edges, _centrality(spark, d), change.changed_files(nodes, files))


_REVIEW = f"{_BLAST}{_rank_ctes()}, rv AS (SELECT n.nid, n.name, (SELECT count(*) FROM edges e WHERE e.dst = n.nid AND e.kind = 'calls') AS callers, {_ENTRY} AS entry, c.pct FROM nodes n JOIN c ON c.nid = n.nid WHERE n.nid IN ({_CHANGED}))"


@_query(f"{_REVIEW} SELECT nid, name, callers, entry, round(pct, 6) AS pct, CASE WHEN pct > 0.3 OR entry OR callers > 10 THEN 'high' WHEN pct > 0.1 OR callers > 3 THEN 'medium' ELSE 'low' END AS risk FROM rv")
def agent_review(spark, d):
    return _review(spark, d).withColumn("pct", F.round("pct", 6))


@_query(f"{_REVIEW}, g AS (SELECT (SELECT affected <= 25 FROM b) AS radius_ok, (SELECT count(*) = 0 FROM rv WHERE entry) AS entries_ok, (SELECT count(*) = 0 FROM rv WHERE pct > 0.4) AS central_ok) SELECT *, radius_ok AND entries_ok AND central_ok AS pass FROM g")
def agent_guard(spark, d):
    return change.guard(_blast(spark, d), _review(spark, d))


@_query(f"{_with()} SELECT nid, name, file, (SELECT count(*) FROM edges e WHERE e.dst = n.nid AND kind = 'calls') AS callers FROM nodes n WHERE name IN ('supply_3', 'customer_4', 'no_such_name')")
def batch_query(spark, d):
    nodes, edges = _graph(spark, d)
    return nodes.where(F.col("name").isin("supply_3", "customer_4", "no_such_name")).join(rank.degree(nodes, edges), "nid").select("nid", "name", "file", "callers")


@_query(f"{_with()} SELECT s.id AS source, t.id AS target, e.kind FROM edges e JOIN nodes s ON s.nid = e.src JOIN nodes t ON t.nid = e.dst")
def export_edges(spark, d):
    return summary.export_edges(*_graph(spark, d))


@_query(f"{_with()}, gone AS (SELECT nid FROM nodes WHERE file = 'tests/orders_test.py') SELECT (SELECT count(*) FROM nodes WHERE file <> 'tests/orders_test.py') AS nodes, (SELECT count(*) FROM edges WHERE src NOT IN (SELECT nid FROM gone) AND dst NOT IN (SELECT nid FROM gone)) AS edges")
def remove_file(spark, d):
    nodes, edges = summary.remove_files(*_graph(spark, d), spark.createDataFrame([("tests/orders_test.py",)], "file string"))
    return nodes.agg(F.count("*").alias("nodes")).join(F.broadcast(edges.agg(F.count("*").alias("edges"))))


@_query(f"{_with()} SELECT CASE WHEN {_TEST_SEGMENT} THEN 'tests' WHEN regexp_matches(lower(file), '\\.(md|rst|txt)$') THEN 'docs' WHEN regexp_matches(lower(file), '\\.(toml|ya?ml|json|ini|cfg|lock)$') THEN 'config' ELSE 'source' END AS category, count(*) AS files FROM (SELECT DISTINCT file FROM nodes) f GROUP BY 1")
def change_categories(spark, d):
    return summary.file_kinds(_graph(spark, d)[0].select("file").distinct())


@_query(f"{_with()} SELECT nid, {_WIDGET} AS widget, (kind IN ('function', 'class') AND ends_with(file, '.tsx') AND regexp_matches(name, '^\\p{{Lu}}')) AS component, {_HANDLER} AS handler, {_CALLBACK} AS callback, regexp_matches(lower(name), '(factory|provider|injector|container)$|singleton') AS injection FROM nodes")
def role_flags(spark, d):
    return summary.role_flags(_graph(spark, d)[0])


@_query(_SQL["audit_paths"].replace("SELECT sink, fin AS root", ", a AS (SELECT sink, fin AS root") + ") SELECT count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'high') AS high, count(*) FILTER (WHERE severity = 'medium') AS medium, count(*) FILTER (WHERE severity = 'low') AS low, count(DISTINCT n.name) AS entry_names, count(DISTINCT n.file) AS files FROM a JOIN nodes n ON n.nid = a.root")
def audit_summary(spark, d):
    nodes, edges = _graph(spark, d)
    return summary.audit_summary(traverse.audit_paths(nodes, edges, nodes.where("file = 'src/jobs/supply_3.py'").select("nid"), depth=4), nodes)


@_query(f"{_with()}{_rank_ctes()}, s AS (SELECT DISTINCT 'caller' AS side, src AS nid FROM edges WHERE dst = {PART} AND kind = 'calls' UNION SELECT DISTINCT 'callee', dst FROM edges WHERE src = {PART} AND kind = 'calls') SELECT side, s.nid, name, file, round(pct, 6) AS pct FROM s JOIN nodes n ON n.nid = s.nid JOIN c ON c.nid = s.nid")
def logic_brief(spark, d):
    nodes, edges = _graph(spark, d)
    return summary.brief(nodes, edges, _centrality(spark, d), PART).withColumn("pct", F.round("pct", 6))


@_query(f"{_with(_reach('u', _CHANGED, 'in', 3))} SELECT target, count(*) FILTER (WHERE hop > 0) AS affected, count(*) FILTER (WHERE hop = 1) AS callers FROM u GROUP BY target HAVING count(*) FILTER (WHERE hop > 0) > 0")
def pr_summary(spark, d):
    """Reach of each changed symbol within three hops."""
    nodes, edges = _graph(spark, d)
    changed = change.changed_files(nodes, spark.createDataFrame([("jobs/supply_1.py",), ("src/geo/regions.py",)], "changed string"))
    return traverse.impact(edges, changed, 3).groupBy("target").agg(F.count("*").alias("affected"), F.count_if(F.col("hop") == 1).alias("callers"))


@_query(f"{_with()} SELECT e.dst AS nid, count(*) AS n FROM edges e JOIN nodes n ON n.nid = e.src WHERE {_TEST_SEGMENT} GROUP BY e.dst")
def tested_by(spark, d):
    """How many test symbols call each node directly."""
    nodes, edges = _graph(spark, d)
    tests = nodes.where(predicates.is_test_segment(F.col("file"))).select(F.col("nid").alias("src"))
    return edges.join(tests, "src", "left_semi").groupBy(F.col("dst").alias("nid")).agg(F.count("*").alias("n"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
