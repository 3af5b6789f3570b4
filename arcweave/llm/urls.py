"""URL filter: host and path rules first, then a tree of path templates for each host.

Only DataFrame functions run here. Digits in a path are masked; each host's paths then form a tree
with a level for each segment, however deep. From the root down, a branch stays apart only where its share of bad labels differs from its siblings' by a two-proportion z-test
and the node is not a variable one (many distinct children for its size); all others are merged
into the wildcard branch ``*``. Branches that stay apart are merged with each other as well where they are alike: in
the order of their shares, each joins the one before it unless the same test tells the two apart; a
merged branch is named after its smallest segment, with ``|*`` behind it. A template is rejected when its smoothed share of good labels falls
below ``least_purity``; templates without labels keep the corpus's share and are never rejected
unless the corpus itself is.

Defined results: a null url or one without ``://`` has empty host and path; an empty path is a tree
of its own; repeated urls and page ids count as often as they occur; without labels all that no
rule blocks is allowed. Columns other than the named ones are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SALTS = 32
DEPTH = 8  # no limit of the operator: the levels that the brute-force test spells out


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.coalesce(F.regexp_extract(url, parts, 1), F.lit("")), UPPER, LOWER), F.coalesce(F.regexp_extract(url, parts, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule ``(verdict, host, path prefix)`` that fits, as text, and its verdict; null if none does."""
    found = verdict = F.lit(None).cast("string")
    for said, rule_host, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(prefix)
        found, verdict = F.when(fits, rule_host + prefix).otherwise(found), F.when(fits, said).otherwise(verdict)
    return found, verdict


def _masked(path: Column) -> Column:
    return F.regexp_replace(path, "[0-9]+", "{n}")


def templates(pages: DataFrame, least_children: int = 16, variable: float = 0.5, z: float = 2.58) -> DataFrame:
    """``pages(host, path, bad int or null)`` -> ``(host, masked, t, n, labelled, bad)``: each masked path and its template, one entry a segment.

    A group of paths that share a template so far grows on only while it holds several paths and both
    good and bad labels: without them no branch below can differ from its siblings, all are ``*``.
    """
    known = pages.select("host", _masked(F.col("path")).alias("masked"), "bad")
    tree = known.groupBy("host", "masked").agg(F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad"))
    parts = F.split("masked", "/")
    tree = tree.withColumn("s", F.slice(parts, F.lit(2), F.size(parts))).withColumn("t", F.array().cast("array<string>"))
    counts, finished, level = ("n", "labelled", "bad"), [], 0
    while True:
        tree = stored(tree)  # each level reads it several times
        mixed = tree.groupBy("host", "t").agg(F.count("*").alias("paths"), *[F.sum(c).alias(f"all_{c}") for c in ("labelled", "bad")])
        mixed = mixed.where("paths > 1 and all_bad > 0 and all_bad < all_labelled").select(F.col("host").alias("k_host"), F.col("t").alias("k_t"), F.lit(True).alias("mixed"))
        tree = tree.join(mixed, (F.col("host") == F.col("k_host")) & (F.col("t") == F.col("k_t")), "left").withColumn("open", F.col("mixed").isNotNull() & (F.size("s") > level)).drop("k_host", "k_t", "mixed")
        tree = stored(tree)
        finished.append(tree.where("not open").select("host", "masked", F.concat("t", F.array_repeat(F.lit("*"), F.size("s") - level)).alias("t"), *counts))
        tree = tree.where("open").drop("open")
        if tree.isEmpty():
            break
        level += 1
        own = F.get("s", F.lit(level - 1))
        child = tree.groupBy("host", "t", own.alias("own")).agg(*[F.sum(c).alias(c) for c in counts])
        whole = child.groupBy("host", "t").agg(F.count("*").alias("children"), *[F.sum(c).alias(f"all_{c}") for c in counts])
        both = child.join(whole, ["host", "t"])
        # (bad / labelled - rest_bad / rest)^2 > z^2 p (1 - p) (1 / labelled + 1 / rest), cleared of fractions
        rest, rest_bad = F.col("all_labelled") - F.col("labelled"), F.col("all_bad") - F.col("bad")
        apart = F.pow((F.col("bad") * rest - rest_bad * F.col("labelled")).cast("double"), F.lit(2.0)) * F.col("all_labelled") > F.lit(z * z) * F.col("all_bad") * (F.col("all_labelled") - F.col("all_bad")).cast("double") * F.col("labelled") * rest
        kept = both.where(~((F.col("children") >= least_children) & (F.col("children") >= variable * F.col("all_n")))).where(apart)
        # of those, neighbours in the order of their shares that the test can't tell apart are one branch
        by_share = Window.partitionBy("host", "t").orderBy(F.col("bad") / F.col("labelled"), "own")
        kept = kept.select("host", "t", "own", "labelled", "bad", F.lag("labelled").over(by_share).alias("l"), F.lag("bad").over(by_share).alias("b"), (F.col("bad") / F.col("labelled")).alias("share"))
        both_bad, both = F.col("bad") + F.col("b"), F.col("labelled") + F.col("l")
        new = F.pow((F.col("bad") * F.col("l") - F.col("b") * F.col("labelled")).cast("double"), F.lit(2.0)) * both > F.lit(z * z) * both_bad * (both - both_bad).cast("double") * F.col("labelled") * F.col("l")
        run = F.sum(F.when(F.col("l").isNull() | new, 1).otherwise(0)).over(Window.partitionBy("host", "t").orderBy("share", "own").rowsBetween(Window.unboundedPreceding, 0))
        alike = Window.partitionBy("host", "t", "run")
        name = F.when(F.count("*").over(alike) > 1, F.concat(F.min("own").over(alike), F.lit("|*"))).otherwise(F.col("own"))
        kept = kept.withColumn("run", run).select(F.col("host").alias("k_host"), F.col("t").alias("k_t"), "own", name.alias("literal"))
        tree = tree.join(kept, (F.col("host") == F.col("k_host")) & (F.col("t") == F.col("k_t")) & (own == F.col("own")), "left")
        tree = tree.withColumn("t", F.concat("t", F.array(F.coalesce("literal", F.lit("*"))))).drop("k_host", "k_t", "own", "literal")
    return stored(reduce(DataFrame.union, finished))


def url_filter(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]], least_purity: float = 0.5, smoothing: float = 10.0) -> DataFrame:
    """``pages(page_id, url)``, ``labels(page_id, bad int)`` -> ``(page_id, host, path, rule, verdict)``."""
    host, path = host_path(F.col("url"))
    own = stored(pages.select("page_id", host.alias("host"), path.alias("path")))
    said = labels.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    labelled = own.join(said, "page_id", "left").select("host", "path", "bad")
    total = labelled.agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    good = 1 - total["bad"] / total["n"] if total["n"] else 1.0
    tree = templates(labelled)
    by = tree.groupBy("host", "t").agg(F.sum("labelled").alias("labelled_all"), F.sum("bad").alias("bad_all"))
    purity = (F.col("labelled_all") - F.col("bad_all") + F.lit(smoothing * good)) / (F.col("labelled_all") + F.lit(smoothing))
    refused = by.where(purity < least_purity).select(F.col("host").alias("k_host"), F.col("t").alias("k_t"))
    refused = tree.join(refused, (F.col("host") == F.col("k_host")) & (F.col("t") == F.col("k_t"))).select(F.col("host").alias("r_host"), F.col("masked").alias("r_masked"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("r_salt"), F.lit("block").alias("refused"))
    dealt = own.select("*", _masked(F.col("path")).alias("masked"), F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int").alias("salt"))
    judged = dealt.join(refused, (F.col("salt") == F.col("r_salt")) & (F.col("host") == F.col("r_host")) & (F.col("masked") == F.col("r_masked")), "left")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.col("refused"), F.lit("allow")).alias("verdict"))
