"""Change sets from git: the output of ``git diff`` as rows, parsed by Column expressions."""

from __future__ import annotations

import os
import subprocess
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import is_generated


def _git(root: str, *args: str) -> list[str]:
    done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, check=False)
    return done.stdout.splitlines() if done.returncode == 0 else []


def lines(root: str, base: str | None = None) -> tuple[list[str], list[str], list[str]]:
    """Name-status, numstat and untracked lines of a range, or else of the work tree and index; white space ignored, renames followed."""
    base = base or os.environ.get("CHANGE_RANGE")
    spans = [[base]] if base else [[], ["--cached"]]
    status = [x for s in spans for x in _git(root, "diff", "-w", "-M", "--name-status", *s)]
    counts = [x for s in spans for x in _git(root, "diff", "-w", "-M", "--numstat", *s)]
    return status, counts, [] if base else _git(root, "ls-files", "--others", "--exclude-standard")


def name_status(raw: DataFrame) -> DataFrame:
    """``raw(line)`` -> ``(status, changed)``: a rename is its new path, deletions are dropped."""
    parts = F.split("line", "\t")
    rows = raw.select(F.substring(F.get(parts, F.lit(0)), 1, 1).alias("status"), F.element_at(parts, -1).alias("changed"), F.size(parts).alias("n"))
    return rows.where("n > 1 and status <> 'D'").select("status", "changed").distinct()


def numstat(raw: DataFrame) -> DataFrame:
    """``raw(line)`` -> ``(changed, added, deleted)``; binary files count nothing; ``a/{b => c}/d`` is the new path."""
    parts = F.split("line", "\t")
    path = F.regexp_replace(F.regexp_replace(F.get(parts, F.lit(2)), r"\{[^{}]* => ([^{}]*)\}", "$1"), r"^.* => ", "")
    number = lambda k: F.coalesce(F.get(parts, F.lit(k)).try_cast("long"), F.lit(0))
    return raw.where(F.size(parts) == 3).select(F.regexp_replace(path, "//+", "/").alias("changed"), number(0).alias("added"), number(1).alias("deleted"))


def changed_files(spark: SparkSession, root: str, base: str | None = None) -> DataFrame:
    """``(changed)``: paths with any added or deleted line, or untracked, generated ones left out, in order."""
    status, counts, fresh = (spark.createDataFrame([(x,) for x in part], "line string") for part in lines(root, base))
    touched = numstat(counts).where("added + deleted > 0").select("changed").distinct()
    both = name_status(status).select("changed").join(touched, "changed", "left_semi").union(fresh.select(F.col("line").alias("changed")))
    return both.where(~is_generated(F.col("changed"))).distinct().orderBy("changed")


# What the looser listing leaves out, wherever it stands in a path.
INTERNAL = ["node_modules/", "target/", "dist/", "build/", ".arcweave/", "package-lock.json", "Cargo.lock", "generated/", ".min.js", ".min.css"]


def changed_files_between(spark: SparkSession, root: str, base: str | None = None, head: str | None = None) -> DataFrame:
    """``(changed)`` by the looser rules of a tool server: deletions count, and paths that contain a generated part go.

    Between two commits all listed files count; in the work tree those with added or deleted lines, and untracked ones.
    """
    base, head = base or os.environ.get("CHANGE_BASE"), head or os.environ.get("CHANGE_HEAD")
    ranged = bool(base and head)
    spans = [[f"{base}..{head}"]] if ranged else [[], ["--cached"]]
    listed = spark.createDataFrame([(x,) for s in spans for x in _git(root, "diff", "-w", "--name-status", "--find-renames", *s)], "line string")
    parts = F.split("line", "\t")
    paths = listed.where(F.size(parts) > 1).select(F.when(F.col("line").startswith("R") & (F.size(parts) > 2), F.get(parts, F.lit(2))).otherwise(F.get(parts, F.lit(1))).alias("changed"))
    if not ranged:
        counts = spark.createDataFrame([(x,) for s in spans for x in _git(root, "diff", "-w", "--find-renames", "--numstat", *s)], "line string")
        fresh = spark.createDataFrame([(x,) for x in _git(root, "ls-files", "--others", "--exclude-standard")], "changed string")
        paths = paths.join(numstat(counts).where("added > 0 or deleted > 0").select("changed").distinct(), "changed", "left_semi").union(fresh)
    path = F.translate("changed", "\\", "/")
    internal = [path.contains(x) | path.endswith(x.rstrip("/")) for x in INTERNAL]
    return paths.select(path.alias("changed")).where(~reduce(or_, internal)).distinct().orderBy("changed")


def hunks(spark: SparkSession, diff: list[str]) -> DataFrame:
    """``(file, start, stop)`` of the new side's ranges in the lines of a unified diff; malformed headers are skipped."""
    from pyspark.sql import Window

    from ..functions.text import hunk

    raw = spark.createDataFrame(list(enumerate(diff)), "at long, line string")
    name = F.when(F.col("line").startswith("+++ "), F.regexp_replace("line", r"^\+\+\+ (b/)?", ""))
    # one diff is one ordered text; it is parsed where it was read
    named = raw.withColumn("file", F.last(name, ignorenulls=True).over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
    return named.withColumn("h", hunk(F.col("line"))).where("h is not null and file <> '/dev/null'").select("file", "h.start", "h.stop")
