"""Reports of small results: Markdown, Mermaid and CSV text, and the export of a whole graph as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def markdown(df: DataFrame, title: str, most: int = 50) -> str:
    """A titled table of the first ``most`` rows, in the order of ``df``."""
    rows = df.limit(most).collect()
    head = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*head, *("| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in rows)])


def mermaid(nodes: DataFrame, edges: DataFrame, most: int = 50) -> str:
    """The first ``most`` edges by number as a flow chart."""
    names = nodes.select("nid", "name")
    rows = edges.join(names.withColumnsRenamed({"nid": "src", "name": "a"}), "src").join(names.withColumnsRenamed({"nid": "dst", "name": "b"}), "dst").select("src", "dst", "a", "b").distinct().orderBy("src", "dst").limit(most).collect()
    plain = lambda s: str(s).replace('"', "'")
    return "\n".join(["graph LR", *(f'  n{r["src"]}["{plain(r["a"])}"] --> n{r["dst"]}["{plain(r["b"])}"]' for r in rows)])


def csv_lines(df: DataFrame) -> DataFrame:
    """Rows as CSV text in one column ``value``; quotes are doubled. Arrays are joined by ``>``."""
    cells = []
    for name, kind in df.dtypes:
        own = F.array_join(F.transform(F.col(name), lambda x: x.cast("string")), ">") if kind.startswith("array") else F.col(name).cast("string")
        own = F.coalesce(own, F.lit(""))
        cells.append(F.when(own.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(own, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(own))
    return df.select(F.concat_ws(",", *cells).alias("value"))


def export(nodes: DataFrame, path: str, version: str = "1") -> None:
    """Nodes as JSON lines, with the version on each."""
    nodes.withColumn("version", F.lit(version)).write.mode("overwrite").json(path)


def snapshot(nodes: DataFrame, edges: DataFrame, path: str, version: str = "1") -> None:
    """A whole graph as JSON: lines of nodes, lines of edges, and one of ``(version, nodes, edges, files)``, written last."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")
    stats = nodes.agg(F.lit(version).alias("version"), F.count("*").alias("nodes"), F.count_distinct("file").alias("files")).join(F.broadcast(edges.agg(F.count("*").alias("edges"))))
    stats.write.mode("overwrite").json(f"{path}/stats")
