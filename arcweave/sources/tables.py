"""Relational tables as a graph: an order-management schema read as code.

Vertices are rows (``nid`` = key * 8 + a digit for the table, so it needs no global numbering) with
the attributes of symbols; edges are foreign keys read as calls. The expressions are plain SQL that
Spark and other engines read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ID = "left(md5(concat_ws(chr(1), file, qualified_name, kind)), 16)"

NODES = f"""
SELECT nid, {_ID} AS id, name, qualified_name, kind, file, CAST(1 + 10 * (key % 50) AS INT) AS line_start,
       CAST(4 + 10 * (key % 50) + key % 30 AS INT) AS line_end,
       CASE WHEN kind IN ('function', 'method') THEN concat('def ', name, '(key: int, depth: int = ', CAST(key % 7 AS VARCHAR(20)), ')') END AS signature,
       CASE WHEN key % 3 = 0 THEN concat('Handles the ', kind, ' ', name, '.') END AS docstring
FROM (
  SELECT CAST(r_regionkey AS BIGINT) * 8 AS nid, CAST(r_regionkey AS BIGINT) AS key, lower(r_name) AS name, concat('geo.', lower(r_name)) AS qualified_name, 'module' AS kind, 'src/geo/regions.py' AS file FROM {{region}}
  UNION ALL
  SELECT CAST(n_nationkey AS BIGINT) * 8 + 1, CAST(n_nationkey AS BIGINT), concat(lower(n_name), 'Page'), concat('geo.', lower(n_name)), 'class', 'src/geo/nations.py' FROM {{nation}}
  UNION ALL
  SELECT c_custkey * 8 + 2, c_custkey, concat(CASE WHEN c_custkey % 10 = 0 THEN 'handle_' WHEN c_custkey % 10 = 1 THEN 'get_' WHEN c_custkey % 10 = 2 THEN 'execQueryFor' ELSE '' END, 'customer_', CAST(c_custkey AS VARCHAR(20))),
         concat('api.', lower(c_mktsegment), '.customer_', CAST(c_custkey AS VARCHAR(20))), 'function', concat('src/api/', lower(c_mktsegment), '_routes.py') FROM {{customer}}
  UNION ALL
  SELECT s_suppkey * 8 + 3, s_suppkey, concat(CASE WHEN s_suppkey % 7 = 0 THEN 'on_' ELSE '' END, 'supply_', CAST(s_suppkey AS VARCHAR(20))), concat('supply_', CAST(s_suppkey AS VARCHAR(20))), 'function', concat('src/jobs/supply_', CAST(s_suppkey % 5 AS VARCHAR(20)), '.py') FROM {{supplier}}
  UNION ALL
  SELECT p_partkey * 8 + 4, p_partkey, concat(replace(p_name, ' ', '_'), '_', CAST(p_partkey % 601 AS VARCHAR(20))), concat(replace(p_brand, '#', ''), '.', replace(p_name, ' ', '_'), '_', CAST(p_partkey % 601 AS VARCHAR(20))), CASE WHEN p_size % 3 = 0 THEN 'class' ELSE 'function' END,
         concat('src/', lower(split_part(p_type, ' ', 1)), '/', lower(replace(p_brand, '#', '_')), '.py') FROM {{part}}
  UNION ALL
  SELECT o_orderkey * 8 + 5, o_orderkey, concat('order_', CAST(o_orderkey AS VARCHAR(20))), concat('orders.Order.order_', CAST(o_orderkey AS VARCHAR(20))), 'method', CASE WHEN o_orderpriority = '5-LOW' THEN 'tests/orders_test.py' ELSE concat('src/orders/status_', lower(o_orderstatus), '.py') END FROM {{orders}}
) t
"""

EDGES = """
SELECT DISTINCT l_orderkey * 8 + 5 AS src, l_partkey * 8 + 4 AS dst, 'calls' AS kind FROM {lineitem}
UNION ALL SELECT DISTINCT l_partkey * 8 + 4, l_suppkey * 8 + 3, 'calls' FROM {lineitem}
UNION ALL SELECT o_orderkey * 8 + 5, o_custkey * 8 + 2, 'calls' FROM {orders}
UNION ALL SELECT c_custkey * 8 + 2, CAST(c_nationkey AS BIGINT) * 8 + 1, 'calls' FROM {customer}
UNION ALL SELECT s_suppkey * 8 + 3, CAST(s_nationkey AS BIGINT) * 8 + 1, 'calls' FROM {supplier}
UNION ALL SELECT CAST(n_nationkey AS BIGINT) * 8 + 1, CAST(n_regionkey AS BIGINT) * 8, 'calls' FROM {nation}
UNION ALL SELECT CAST(n_regionkey AS BIGINT) * 8, CAST(n_nationkey AS BIGINT) * 8 + 1, 'imports' FROM {nation} WHERE n_regionkey = 0
"""

SYMBOLS = """
SELECT p_partkey * 8 + 4 AS nid, concat(replace(p_brand, '#', ''), '.', replace(p_name, ' ', '_'), '_', CAST(CASE p_partkey % 3 WHEN 0 THEN p_partkey WHEN 1 THEN p_partkey % 601 ELSE p_partkey % 7 END AS VARCHAR(20))) AS fqn,
       concat(replace(p_name, ' ', '_'), '_', CAST(CASE p_partkey % 3 WHEN 0 THEN p_partkey WHEN 1 THEN p_partkey % 601 ELSE p_partkey % 7 END AS VARCHAR(20))) AS name,
       concat(lower(split_part(p_type, ' ', 1)), '/', lower(replace(p_brand, '#', '_')), '.py') AS file FROM {part}
UNION ALL
SELECT s_suppkey * 8 + 3, concat('supply_', CAST(s_suppkey AS VARCHAR(20))), concat('supply_', CAST(s_suppkey AS VARCHAR(20))),
       concat(CASE s_suppkey % 6 WHEN 0 THEN 'economy' WHEN 1 THEN 'standard' WHEN 2 THEN 'promo' WHEN 3 THEN 'small' WHEN 4 THEN 'medium' ELSE 'large' END, '/brand_', CAST(1 + s_suppkey % 25 AS VARCHAR(20)), '.py') FROM {supplier}
"""

REFS = """
SELECT s.nid AS src, s.file AS file, CASE l.l_partkey % 5 WHEN 0 THEN p.fqn WHEN 1 THEN concat('.', p.name) WHEN 2 THEN concat('ext_', p.name) ELSE p.name END AS ref
FROM (SELECT DISTINCT l_suppkey, l_partkey FROM {lineitem}) l JOIN {symbols} s ON s.nid = l.l_suppkey * 8 + 3 JOIN {symbols} p ON p.nid = l.l_partkey * 8 + 4
"""

IMPORTS = """
SELECT file, local, replace(substr(best, 21), '/', '.') AS module FROM (
  SELECT s.file AS file, p.name AS local, max(concat(lpad(CAST(p.nid AS VARCHAR(20)), 20, '0'), p.file)) AS best
  FROM (SELECT DISTINCT l_suppkey, l_partkey FROM {lineitem} WHERE l_linenumber = 1 AND l_partkey % 5 > 2) l
  JOIN {symbols} s ON s.nid = l.l_suppkey * 8 + 3 JOIN {symbols} p ON p.nid = l.l_partkey * 8 + 4 GROUP BY s.file, p.name) t
"""

#: The same tables for an engine in which the base tables are views of their own names.
_BASE = {t: t for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}
WITH_GRAPH = f"nodes AS MATERIALIZED ({NODES.format(**_BASE)}), edges AS MATERIALIZED ({EDGES.format(**_BASE)})"
WITH_SYMBOLS = f"symbols AS MATERIALIZED ({SYMBOLS.format(**_BASE)}), refs AS MATERIALIZED (SELECT DISTINCT * FROM ({REFS.format(symbols='symbols', **_BASE)}) x), imports AS MATERIALIZED ({IMPORTS.format(symbols='symbols', **_BASE)})"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql(spark: SparkSession, sf_dir: str, text: str, **more: DataFrame) -> DataFrame:
    tables = {t: load(spark, sf_dir, t) for t in _BASE if f"{{{t}}}" in text}
    return spark.sql(text, **tables, **more)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, NODES)


def edges(spark: SparkSession, sf_dir: str, repeats: bool = False) -> DataFrame:
    """``repeats``: rows that name the same edge all stay, for those who need no exchange to part them."""
    return _sql(spark, sf_dir, EDGES.replace("SELECT DISTINCT", "SELECT") if repeats else EDGES)


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, SYMBOLS)


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, REFS, symbols=symbols(spark, sf_dir)).distinct()


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, IMPORTS, symbols=symbols(spark, sf_dir))


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive events of a user as ``flows_to`` edges."""
    from pyspark.sql import Window

    events = load(spark, sf_dir, "events")
    following = F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return events.select(F.col("event_id").alias("src"), following.alias("dst"), F.lit("flows_to").alias("kind")).where("dst is not null")


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``imports`` edges from a page to the targets that its HTML links to."""
    pages = load(spark, sf_dir, "pages")
    target = F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))
    return pages.select("page_id", target.alias("target")).where("target <> ''").groupBy("page_id", "target").agg(F.count("*").alias("n"))
