"""Reference resolution: textual references to confidence-weighted call edges.

Every rung of the ladder is an equi-join of the references with definition counts that are
aggregated beforehand by key, (key, file), (key, module) and (key, directory), so a name with many
definitions costs one row per key. Candidates are only expanded for ambiguous references within the
fan-out limits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import module_path, parent, suffixes
from ..plans.lineage import cut

# Confidence of a match, penalty of an unknown receiver, limits of ambiguous fan-out.
CONFIDENCE = {"exact": 1.0, "same_file": 0.95, "via_import": 0.93, "unique_suffix": 0.80, "same_dir": 0.55, "ambiguous": 0.25}
UNKNOWN_RECEIVER, FANOUT, UNKNOWN_FANOUT, CONFIDENT = 0.55, 4, 2, 0.75


def normalize_receiver(refs: DataFrame) -> DataFrame:
    """References that name their own receiver or use ``::``, rewritten to what definitions are called; an option before ``resolve``.

    ``self.m`` and ``this.m`` become ``.m``, a receiver of unknown type; ``Type::m`` becomes ``Type.m``.
    """
    plain = F.regexp_replace(F.regexp_replace("ref", "::", "."), r"^(self|this|super)\.", ".")
    return refs.withColumn("ref", plain).distinct()


def import_map(imports: DataFrame) -> DataFrame:
    """``imports(file, local, module[, seq])`` with one module per (file, local): the last written one; namespace aliases apart."""
    order = "seq" if "seq" in imports.columns else "module"
    return imports.where(~F.col("local").startswith("*as:")).groupBy("file", "local").agg(F.max_by("module", order).alias("module"))


def definitions(symbols: DataFrame) -> DataFrame:
    """``symbols(nid, fqn, file)`` -> ``(key, nid, file, dir, exact)``: each symbol under every suffix of its name."""
    named = symbols.where("fqn <> ''").select("nid", "fqn", "file", parent(F.col("file")).alias("dir"), F.explode(suffixes(F.col("fqn"))).alias("key"))
    return named.groupBy("key", "nid").agg(F.first("file").alias("file"), F.first("dir").alias("dir"), F.max(F.col("key") == F.col("fqn")).alias("exact"))


def _module_runs(file):
    """All runs of consecutive segments of a file's module path: what a segment-aligned ``contains`` accepts."""
    parts = F.split(module_path(file), r"\.")
    starts = F.sequence(F.lit(1), F.size(parts))
    return F.array_distinct(F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.size(parts) - i + 1), lambda n: F.array_join(F.slice(parts, i, n), ".")))))


def resolve(refs: DataFrame, symbols: DataFrame, imports: DataFrame, defs: DataFrame | None = None) -> DataFrame:
    """``refs(src, file, ref)`` -> one row per reference ``(src, file, ref, key, unknown, resolution, nid, n)``.

    resolution: exact, unique_suffix, same_file, via_import, same_dir, ambiguous (nid null) or unresolved.
    An exact match of one definition wins however many suffixes match. ``defs``: the symbols' ``definitions``, if
    they are at hand as a table; each rung reads them.
    """
    defs = cut(definitions(symbols)) if defs is None else defs
    by_key = defs.groupBy("key").agg(F.count("*").alias("n"), F.min("nid").alias("any_nid"), F.count_if("exact").alias("n_exact"), F.min(F.when(F.col("exact"), F.col("nid"))).alias("exact_nid"))
    one = lambda *by: defs.groupBy(*by).agg(F.count("*").alias("c"), F.min("nid").alias("x")).where("c = 1")
    by_file = one("key", "file").select("key", "file", F.col("x").alias("file_nid"))
    by_dir = one("key", "dir").select("key", "dir", F.col("x").alias("dir_nid"))
    known = import_map(imports).withColumn("module", module_path(F.col("module")))
    wanted = known.where("module <> ''").select(F.col("local").alias("key"), "module").distinct()
    runs = defs.join(wanted.select("key").distinct(), "key", "left_semi").select("key", "nid", F.explode(_module_runs(F.col("file"))).alias("module"))
    by_module = runs.join(wanted, ["key", "module"]).groupBy("key", "module").agg(F.count("*").alias("c"), F.min("nid").alias("x")).where("c = 1").select("key", "module", F.col("x").alias("module_nid"))
    by_import = known.join(by_module, (known["local"] == by_module["key"]) & (known["module"] == by_module["module"])).select("file", "key", "module_nid")
    asked = refs.select("src", "file", "ref", F.col("ref").startswith(".").alias("unknown"), F.regexp_replace("ref", r"^\.", "").alias("key"), parent(F.col("file")).alias("dir")).where("key <> ''")
    found = asked.join(by_key, "key", "left").join(by_file, ["key", "file"], "left").join(by_import, ["file", "key"], "left").join(by_dir, ["key", "dir"], "left")
    rung = (
        F.when(F.col("n_exact") == 1, "exact").when(F.col("n").isNull(), "unresolved")
        .when(F.col("n") == 1, F.when(F.col("n_exact") > 0, "exact").otherwise("unique_suffix"))
        .when(F.col("file_nid").isNotNull(), "same_file").when(F.col("module_nid").isNotNull(), "via_import").when(F.col("dir_nid").isNotNull(), "same_dir").otherwise("ambiguous")
    )
    nid = F.when(F.col("n_exact") == 1, F.col("exact_nid")).when(F.col("n") == 1, F.col("any_nid")).otherwise(F.coalesce("file_nid", "module_nid", "dir_nid"))
    return found.select("src", "file", "ref", "key", "unknown", rung.alias("resolution"), F.when(rung != "ambiguous", nid).alias("nid"), "n")


def resolve_edges(refs: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """Call edges ``(src, dst, ref, kind, resolution, confidence float)`` of references, import validation applied."""
    defs = cut(definitions(symbols))
    found = cut(resolve(refs, symbols, imports, defs).select("src", "file", "ref", "key", "unknown", "resolution", "nid", "n"))
    single = found.where("nid is not null").withColumn("dst", F.col("nid"))
    limit = F.when(F.col("unknown"), UNKNOWN_FANOUT).otherwise(FANOUT)
    several = found.where((F.col("resolution") == "ambiguous") & (F.col("n") <= limit))
    # only definitions of ambiguous names within the limit are expanded: a common name's are dropped by its count
    few = defs.select("key", F.col("nid").alias("dst")).join(several.select("key").distinct(), "key", "left_semi")
    drawn = single.select("src", "file", "ref", "key", "unknown", "resolution", "dst").union(several.join(few, "key").select("src", "file", "ref", "key", "unknown", "resolution", "dst")).where("src <> dst")
    base = F.create_map(*[F.lit(x) for pair in CONFIDENCE.items() for x in pair])[F.col("resolution")]
    drawn = drawn.withColumn("base", F.when(F.col("unknown"), base * UNKNOWN_RECEIVER).otherwise(base))
    files = symbols.select(F.col("nid").alias("dst"), F.col("file").alias("dst_file"))
    known = import_map(imports)
    importing = known.select("file").distinct().withColumn("imports", F.lit(True))
    named = known.select("file", F.col("local").alias("ref")).withColumn("imported", F.lit(True))
    judged = drawn.join(files, "dst").join(importing, "file", "left").join(named, ["file", "ref"], "left")
    confidence = (
        F.when(F.col("unknown") | F.col("imports").isNull() | F.col("ref").contains("."), F.col("base"))
        .when(F.col("imported"), F.greatest("base", F.lit(0.95)))
        .when(F.col("file") == F.col("dst_file"), F.col("base"))
        .when(parent(F.col("file")) == parent(F.col("dst_file")), F.col("base") * 0.6)
        .otherwise(F.col("base") * 0.3)
    )
    return judged.select("src", "dst", "ref", F.lit("calls").alias("kind"), "resolution", confidence.cast("float").alias("confidence")).where("confidence > 0")
