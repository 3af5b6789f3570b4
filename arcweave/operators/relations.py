"""Relations by name and line: which symbol a line lies in, and edges from the relations that a parser reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines per bucket of the interval join.
BUCKET = 64


def enclosing(places: DataFrame, symbols: DataFrame) -> DataFrame:
    """``places(file, line, ...)`` with ``nid`` of the smallest symbol ``(nid, file, line_start, line_end)`` around each; null outside any.

    An equi-join on (file, bucket of lines); a long symbol lies in several buckets, a place in one.
    """
    spread = symbols.where("line_start > 0").select("nid", "file", "line_start", "line_end", F.explode(F.expr(f"sequence(line_start div {BUCKET}, greatest(line_end, line_start) div {BUCKET})")).alias("bucket"))
    asked = places.withColumn("bucket", F.expr(f"line div {BUCKET}"))
    hits = asked.select("file", "line", "bucket").distinct().join(spread, ["file", "bucket"]).where("line between line_start and line_end")
    least = hits.groupBy("file", "line").agg(F.min_by("nid", F.struct(F.col("line_end") - F.col("line_start"), F.col("nid"))).alias("nid"))
    return asked.drop("bucket").join(least, ["file", "line"], "left")


def relation_edges(relations: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges ``(src, dst, kind, file, line)`` of ``relations(file, line, to_name, kind)``: from the enclosing symbol to the first of the last name's symbols.

    Of several symbols of a name the smallest number is taken; names without a symbol are dropped.
    """
    first = symbols.groupBy("name").agg(F.min("nid").alias("dst"))
    asked = enclosing(relations, symbols).where("nid is not null").withColumn("name", F.regexp_extract("to_name", r"([^.:]*)$", 1))
    return asked.join(first, "name").where("nid <> dst").select(F.col("nid").alias("src"), "dst", "kind", "file", "line")
