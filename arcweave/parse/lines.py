"""Line rules for languages without a parser, in Python and as Column expressions over whole tables."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NAME = r"([A-Za-z_][A-Za-z0-9_]*)"
_MODIFIERS = r"(?:(?:public|private|internal|open|abstract|final|static|override|suspend|data|sealed|export|async|protected|fileprivate)\s+)*"
#: (kind, pattern with one group for the name), first match of a line wins.
RULES = [
    ("class", rf"^\s*{_MODIFIERS}class\s+{_NAME}"),
    ("interface", rf"^\s*{_MODIFIERS}(?:interface|protocol|trait)\s+{_NAME}"),
    ("struct", rf"^\s*{_MODIFIERS}struct\s+{_NAME}"),
    ("enum", rf"^\s*{_MODIFIERS}enum\s+(?:class\s+)?{_NAME}"),
    ("module", rf"^\s*(?:module|object|namespace)\s+{_NAME}"),
    ("function", rf"^\s*{_MODIFIERS}(?:fun|func|def|function)\s+(?:self\.)?{_NAME}"),
    ("function", rf"^\s*{_NAME}\s*\(\)\s*\{{?"),
]


def parse_lines(file: str, text: str) -> Iterator[dict]:
    """One-line nodes without references; lines that start with ``#`` or ``//`` are comments."""
    at = 0
    for k, line in enumerate(text.split("\n"), 1):
        plain = line.strip()
        if plain and not plain.startswith(("#", "//")):
            for kind, rule in RULES:
                found = re.match(rule, line)
                if found:
                    yield {"name": found[1], "qualified_name": found[1], "kind": kind, "file": file, "line_start": k, "line_end": k, "column": found.start(1), "byte_start": at, "byte_end": at + len(line.encode()), "signature": plain}
                    break
        at += len(line.encode()) + 1


def line_symbols(files: DataFrame, text: Column, rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """The same rules as one JVM-side plan: ``files`` columns plus ``(line, kind, name)``."""
    rows = files.select("*", F.posexplode(F.split(text, "\n")).alias("at", "raw")).where(~F.ltrim("raw").rlike("^(#|//)"))
    kind = name = F.lit(None).cast("string")
    for k, rule in reversed(rules or RULES):
        kind, name = F.when(F.col("raw").rlike(rule), k).otherwise(kind), F.when(F.col("raw").rlike(rule), F.regexp_extract("raw", rule, 1)).otherwise(name)
    return rows.withColumns({"line": F.col("at") + 1, "kind": kind, "name": name}).where("kind is not null").drop("at", "raw")


def markdown_sections(docs: DataFrame, text: Column) -> DataFrame:
    """``docs`` columns plus ``(line, level, name)`` for each heading; the name is its first identifier."""
    rows = docs.select("*", F.posexplode(F.split(text, "\n")).alias("at", "raw")).where(F.col("raw").rlike(r"^#{1,6}\s+\S"))
    name = F.regexp_extract("raw", r"^#{1,6}\s+.*?([A-Za-z_][A-Za-z0-9_]*)", 1)
    return rows.select(*docs.columns, (F.col("at") + 1).alias("line"), F.length(F.regexp_extract("raw", r"^(#{1,6})\s", 1)).alias("level"), name.alias("name")).where("name <> ''")
