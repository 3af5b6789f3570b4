"""Source trees as tables: listing, ignore rules, parsing."""

from __future__ import annotations

import fnmatch
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import extension
from ..parse import EXTENSIONS, NODE_SCHEMA, parse_source

# Directories that are never walked.
IGNORED = (".git", ".arcweave", "node_modules", "venv", ".venv", "site-packages", "__pycache__", "target", "dist", "build", "out")


def is_supported(path: Column) -> Column:
    return extension(path).isin(*sorted(EXTENSIONS))


def ignored(path: Column, patterns: list[str] | None = None) -> Column:
    """Hidden or ignored by name, or by gitignore ``patterns`` (later ones win; ``!`` re-includes), as one Column expression."""
    out = path.rlike(r"(^|/)\.[^/.]") | path.rlike("(^|/)(" + "|".join(d.replace(".", r"\.") for d in IGNORED) + ")(/|$)")
    for raw in patterns or []:
        line = raw.strip()
        if not line or line.startswith("#"):
            continue
        keep, line = line.startswith("!"), line.lstrip("!")
        anchored, folder = "/" in line.rstrip("/"), line.endswith("/")
        body = fnmatch.translate(line.strip("/").replace("**/", "\0")).replace("\\\0", "(?:.*/)?").replace("\0", "(?:.*/)?")
        body = body.removeprefix("(?s:").removesuffix(")\\z").removesuffix(")\\Z").replace(".*", "[^/]*").replace("(?:[^/]*/)?", "(?:.*/)?")
        rule = ("^" if anchored else "(^|/)") + body + ("/" if folder else "(/|$)")
        out = F.when(path.rlike(rule), F.lit(not keep)).otherwise(out)
    return out


def ignore_patterns(spark: SparkSession, root: str, config: str = ".arcweave/config.json") -> list[str]:
    """Patterns of the tree's own rules: the root's ``.gitignore``, then ``.ignore``, then the ``ignore`` list of a JSON configuration.

    They are read through Hadoop, so any file system does; a missing or malformed one adds nothing.
    """
    found: list[str] = []
    for name in (".gitignore", ".ignore", config):
        text = _text(spark, f"{root.rstrip('/')}/{name}")
        if name != config:
            found += text.splitlines()
            continue
        try:
            said = json.loads(text or "{}")
        except ValueError:
            continue
        found += [x.strip() for x in said.get("ignore", []) if isinstance(x, str) and x.strip()] if isinstance(said, dict) else []
    return found


def _text(spark: SparkSession, path: str) -> str:
    """A small file's text, empty without one; Spark's own readers pass over files with a dot before the name."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return ""
    stream = fs.open(at)
    try:
        return sc._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def scan_files(spark: SparkSession, root: str, patterns: list[str] | None = None) -> DataFrame:
    """``(root, file, mtime, content)`` of the supported files below ``root``; paths are filtered before contents are read.

    The tree's own ignore rules apply, then ``patterns``.
    """
    rules = [*ignore_patterns(spark, root), *(patterns or [])]
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/") + "/"
    path = F.regexp_replace("path", r"^[a-z]+:/*", "/")
    at = F.instr(path, base)
    file = F.when(at > 0, path.substr(at + len(base), F.length(path))).otherwise(path)
    return listed.select(F.lit(root).alias("root"), file.alias("file"), F.col("modificationTime").alias("mtime"), F.col("content")).where(is_supported(F.col("file")) & ~ignored(F.col("file"), rules))


def parse_files(files: DataFrame) -> DataFrame:
    """Symbol rows of ``files(file, content)``; what can't be parsed gives a row of kind ``error``."""

    parsers = dict(EXTENSIONS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [row for file, content in zip(batch["file"], batch["content"]) for row in parse_source(file, bytes(content).decode("utf-8", "replace"), parsers)]
            yield pd.DataFrame(rows, columns=[f.name for f in NODE_SCHEMA.fields])

    return files.select("file", "content").mapInPandas(run, NODE_SCHEMA)


def tables(parsed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (numbered by a stable hash), references and imports of parsed rows."""
    nid = F.xxhash64("file", "byte_start", "qualified_name", "kind")
    full = parsed.where("kind not in ('import', 'error')").withColumn("nid", nid).withColumn("id", F.substring(F.md5(F.concat_ws("\x01", "file", "qualified_name", "kind")), 1, 16))
    refs = full.select(F.col("nid").alias("src"), "file", F.explode("references").alias("ref")).distinct()
    imports = parsed.where("kind = 'import'").select("file", F.explode("references").alias("local"), F.col("name").alias("module"), F.col("byte_start").alias("seq"))
    return full.drop("references"), refs, imports
