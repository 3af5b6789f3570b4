"""Identifier, path and diff text as Column expressions: all of it stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tokenize(identifier: Column) -> Column:
    """Words of an identifier: split at separators, case changes and the ends of acronyms; ASCII lower case; two bytes or more."""
    spaced = F.regexp_replace(identifier, r"([\p{Ll}\p{N}])(\p{Lu})", "$1 $2")
    spaced = F.regexp_replace(spaced, r"(\p{Lu})(\p{Lu}\p{Ll})", "$1 $2")
    return F.filter(F.split(F.translate(spaced, UPPER, LOWER), r"[^\p{L}\p{N}]+"), lambda t: F.octet_length(t) >= 2)


def stem(token: Column) -> Column:
    """A crude stem: the first of -ing -ers -ed (four bytes must stay), else of -es -er -s (three must stay)."""
    out = F.when(F.lit(False), token)
    for suffixes, more in ((("ing", "ers", "ed"), 3), (("es", "er", "s"), 2)):
        for s in suffixes:
            out = out.when((F.octet_length(token) > len(s) + more) & token.endswith(s), token.substr(F.lit(1), F.length(token) - len(s)))
    return out.otherwise(token)


def slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def parent(path: Column) -> Column:
    """Directory of a path; empty for a bare file name."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    """Lower-case extension; empty without one."""
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def module_path(raw: Column) -> Column:
    """Dot-separated segments of a module or file path, without source extensions and the segments that name no module."""
    path = F.regexp_replace(F.regexp_replace(raw, "::", "."), r"[/\\]", ".")
    path = F.regexp_replace(path, r"^\.+", "")
    for ext in ("py", "ts", "js", "rs", "go"):
        path = F.regexp_replace(path, rf"(\.{ext})+$", "")
    plain = ("", "index", "mod", "crate", "self", "super")
    return F.array_join(F.filter(F.split(path, r"\."), lambda s: ~s.isin(*plain)), ".")


def suffixes(fqn: Column) -> Column:
    """Every suffix of a qualified name that begins a segment, the whole name first."""
    parts = F.split(fqn, r"(?<=[.:])(?![.:])")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, k + 1, F.size(parts)), ""))


def hunk(line: Column) -> Column:
    """``struct(start, stop)`` of the new side of a unified diff's hunk header; null for other lines.

    Without a count it is one line; a count of zero is the line itself, at least the first.
    """
    header = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
    start = F.try_to_number(F.regexp_extract(line, header, 1), F.lit("9999999999")).cast("long")
    raw = F.regexp_extract(line, header, 2)
    count = F.when(raw == "", F.lit(1)).otherwise(F.try_to_number(raw, F.lit("9999999999")).cast("long"))
    begin = F.when(count == 0, F.greatest(start, F.lit(1))).otherwise(start)
    return F.when(line.rlike(header), F.struct(begin.alias("start"), F.when(count == 0, begin).otherwise(start + count - 1).alias("stop")))


def compress_path(path: Column) -> Column:
    """``first/.../grandparent/parent/file`` for paths of more than four parts."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 4, F.concat(F.get(parts, F.lit(0)), F.lit("/.../"), F.array_join(F.slice(parts, -3, 3), "/"))).otherwise(path)


def token_estimate(qualified: Column, file: Column, signature: Column, lines: Column) -> Column:
    """Tokens of a node's text by the four-characters rule: its names, signature and forty characters a line."""
    text = F.length(qualified) + F.length(file) + F.length(F.coalesce(signature, F.lit(""))) + 2 + F.greatest(lines, F.lit(0)) * 40
    return F.ceil(text / 4).cast("long")


def callee(text: Column) -> Column:
    """A call's callee as a reference: a bare name, ``Class.method``, ``.method`` of an unknown receiver, or null.

    Optional chaining is plain access; ``this`` and ``super`` receivers leave the bare method.
    """
    plain = F.regexp_replace(F.regexp_replace(F.trim(text), r"\?\.", "."), r"^(this|super)\.", "")
    method = F.regexp_extract(plain, r"([A-Za-z_$][\w$]*)$", 1)
    return (
        F.when(plain.rlike(r"^[A-Za-z_$][\w$]*$"), F.when(~plain.isin("this", "super"), plain))
        .when(plain.rlike(r"^[A-Z][\w$]*\.[A-Za-z_$][\w$]*$"), plain)
        .when(plain.rlike(r"\.[A-Za-z_$][\w$]*$"), F.concat(F.lit("."), method))
    )
