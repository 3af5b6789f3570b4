"""The registered queries of the training-data operators: each applies its operator to a whole table.

``queries()`` and ``oracle_sql()`` have the form that the repository's entry module asks for. An
operator whose result SQL can't express has no SQL; its query is tested against a brute-force version.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .additive import search
from .bpe import round_trip
from .common import crc_mod, table
from .jaccard import jaccard_join
from .katz import katz_scores
from .lattice import near_duplicates
from .licenses import license_scan
from .packing import pack
from .spans import dedup_texts
from .toxicity import fit, score_toxicity, toxic_labels
from .urls import LOWER, UPPER, url_filter

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

#: Levels that the SQL of op1 spells out; the query has no such limit, so the two agree where no path has more segments.
DEPTH = 3


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page counts as bad where ``labels`` calls the document of the same number toxic or of low quality."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).cast("int").alias("bad"))
    return url_filter(table(spark, sf_dir, "pages").select("page_id", "url"), labels, RULES)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_additive_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learnt = crc_mod("doc_id", 3) != 1
    model = fit(toxic_labels(docs.where(learnt), table(spark, sf_dir, "labels").where(learnt)))
    scores = score_toxicity(docs, model).withColumnRenamed("id", "doc_id")
    return scores.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op7_katz_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_scores(table(spark, sf_dir, "documents"), crc_mod("doc_id", 5) != 1).withColumnRenamed("id", "doc_id")


def op8_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).withColumnRenamed("id", "doc_id")


def _url_sql(z: float = 2.58, least_children: int = 16, variable: float = 0.5, least_purity: float = 0.5, smoothing: float = 10.0) -> str:
    """The URL filter as SQL: the same tree, level by level."""
    parts = r"'(?s)^.*?://([^/?#]*)([^?#]*)'"
    levels = range(1, DEPTH + 1)
    segment = lambda k: f"CASE WHEN len(p) > {k + 1} THEN p[{k + 1}] || '/**' ELSE p[{k + 1}] END" if k == DEPTH else f"p[{k + 1}]"
    ctes = [
        f"own AS MATERIALIZED (SELECT page_id, translate(regexp_extract(coalesce(url, ''), {parts}, 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(url, ''), {parts}, 2) AS path FROM pages)",
        "said AS (SELECT doc_id AS page_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 WHEN (toxic = 1 OR quality = 0) IS NULL THEN NULL ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL AND (toxic = 1 OR quality = 0) IS NOT NULL GROUP BY 1)",
        "cut AS (SELECT o.page_id, host, string_split(regexp_replace(path, '[0-9]+', '{n}', 'g'), '/') AS p, bad FROM own o LEFT JOIN said s ON s.page_id = o.page_id)",
        f"seg AS MATERIALIZED (SELECT page_id, host, {', '.join(f'{segment(k)} AS s{k}' for k in levels)}, bad FROM cut)",
        "good AS (SELECT CASE WHEN count(bad) = 0 THEN 1.0::DOUBLE ELSE 1 - sum(bad)::DOUBLE / count(bad) END AS good FROM seg)",
        f"tree0 AS MATERIALIZED (SELECT host, {', '.join(f's{k}' for k in levels)}, count(*) AS n, count(bad) AS lab, coalesce(sum(bad), 0)::BIGINT AS bad FROM seg GROUP BY ALL)",
    ]
    for k in levels:
        node = ["host", *(f"t{i}" for i in range(1, k))]
        same = lambda a, b: " AND ".join(f"{a}.{c} IS NOT DISTINCT FROM {b}.{c}" for c in node)  # noqa: E731,B023
        ctes += [
            f"child{k} AS (SELECT {', '.join(node)}, s{k} AS s, sum(n)::BIGINT AS n, sum(lab)::BIGINT AS lab, sum(bad)::BIGINT AS bad FROM tree{k - 1} WHERE s{k} IS NOT NULL GROUP BY ALL)",
            f"whole{k} AS (SELECT {', '.join(node)}, count(*) AS children, sum(n)::BIGINT AS n, sum(lab)::BIGINT AS lab, sum(bad)::BIGINT AS bad FROM child{k} GROUP BY ALL)",
            f"apart{k} AS (SELECT {', '.join(f'c.{x}' for x in node)}, c.s, c.lab, c.bad, c.bad / c.lab AS share FROM child{k} c JOIN whole{k} w ON {same('c', 'w')} WHERE NOT (w.children >= {least_children} AND w.children >= {variable}::DOUBLE * w.n)"
            f" AND pow(CAST(c.bad * (w.lab - c.lab) - (w.bad - c.bad) * c.lab AS DOUBLE), 2) * w.lab > {z * z!r}::DOUBLE * w.bad * CAST(w.lab - w.bad AS DOUBLE) * c.lab * (w.lab - c.lab))",
            f"beside{k} AS (SELECT *, lag(lab) OVER o AS l, lag(bad) OVER o AS b FROM apart{k} WINDOW o AS (PARTITION BY {', '.join(node)} ORDER BY share, s))",
            f"runs{k} AS (SELECT *, sum(CASE WHEN l IS NULL OR pow(CAST(bad * l - b * lab AS DOUBLE), 2) * (lab + l) > {z * z!r}::DOUBLE * (bad + b) * CAST(lab + l - bad - b AS DOUBLE) * lab * l THEN 1 ELSE 0 END) OVER (PARTITION BY {', '.join(node)} ORDER BY share, s ROWS UNBOUNDED PRECEDING) AS run FROM beside{k})",
            f"kept{k} AS (SELECT {', '.join(node)}, s, CASE WHEN count(*) OVER a > 1 THEN min(s) OVER a || '|*' ELSE s END AS name FROM runs{k} WINDOW a AS (PARTITION BY {', '.join(node)}, run))",
            f"tree{k} AS MATERIALIZED (SELECT t.*, CASE WHEN k.s IS NOT NULL THEN k.name WHEN t.s{k} IS NOT NULL THEN '*' END AS t{k} FROM tree{k - 1} t LEFT JOIN kept{k} k ON {same('t', 'k')} AND t.s{k} = k.s)",
        ]
    key = ", ".join(["host", *(f"t{k}" for k in levels)])
    ctes += [
        f"judged AS (SELECT *, (sum(lab) OVER w - sum(bad) OVER w + {smoothing}::DOUBLE * (SELECT good FROM good)) / (sum(lab) OVER w + {smoothing}::DOUBLE) AS purity FROM tree{DEPTH} WINDOW w AS (PARTITION BY {key}))",
        f"refused AS (SELECT host, {', '.join(f's{k}' for k in levels)} FROM judged WHERE purity < {least_purity})",
        "ruled AS (SELECT *, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/' WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'"
        " WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/' WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM own)",
    ]
    match = " AND ".join(f"f.{c} IS NOT DISTINCT FROM g.{c}" for c in ["host", *(f"s{k}" for k in levels)])
    return (
        f"WITH {', '.join(ctes)} SELECT r.page_id, r.host, r.path, r.rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'"
        f" WHEN EXISTS (SELECT 1 FROM seg g JOIN refused f ON {match} WHERE g.page_id = r.page_id) THEN 'block' ELSE 'allow' END AS verdict FROM ruled r"
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": _url_sql()}
