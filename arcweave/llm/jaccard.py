"""N-gram Jaccard join: MinHash candidates, Bayesian pruning, exact verification.

Candidates come from bands of MinHash values. For each candidate pair the values are compared in
steps; after each step the pair is dropped when the posterior probability (uniform prior on the
similarity) that it reaches the threshold is below ``tolerance``. The rest are verified exactly on
their sets of word shingles. Copies (documents with equal shingle sets) take part as one class with
a weight, so they are linked without being expanded into pairs.

Defined results: words are white-space separated and lower-cased; a text of fewer than ``words``
words is one shingle; null and empty texts have no shingles and link with nothing; rows whose id is
null link with nothing and are their own (null) class; rows that repeat an id count as that many
copies. Other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import bucket_links
from .common import WordHashes, mix64, small_batches, stored
from .components import components

#: Shape of the MinHash signature: BANDS bands of ROWS values find a pair of similarity 0.8 but for 2 in a million.
BANDS, ROWS, STEP, VALUES = 25, 4, 32, 128


def shingles(words: list[str], size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of ``size`` words."""
    if not words:
        return np.empty(0, np.uint64)
    h = hashes.of(words)
    size = min(size, len(h))
    run = h[: len(h) - size + 1].copy()
    for k in range(1, size):
        run = mix64(run) + h[k : len(h) - size + 1 + k]
    return np.unique(mix64(run))


def _multipliers() -> np.ndarray:
    return np.random.default_rng(20_031).integers(1, 2**63, VALUES).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def signature(own: np.ndarray, by: np.ndarray) -> np.ndarray:
    """MinHash values of a non-empty shingle set, in slices so that long texts need little memory."""
    least = np.full(len(by), 2**32 - 1, np.uint32)
    for at in range(0, len(own), 4096):
        np.minimum(least, ((own[at : at + 4096, None] * by) >> np.uint64(32)).astype(np.uint32).min(0), out=least)
    return least


def bands(sig: np.ndarray) -> np.ndarray:
    """A non-zero int64 for each band."""
    x = np.zeros(BANDS, np.uint64)
    for k in range(ROWS):
        x = mix64(x + np.uint64(0x9E3779B97F4A7C15)) ^ sig[k : BANDS * ROWS : ROWS].astype(np.uint64)
    return mix64(x + np.uint64(1)).view(np.int64) | 1


def least_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """Values compared -> fewest matches with which a pair stays: P(similarity >= threshold | matches) >= tolerance."""
    grid = (np.arange(20_000) + 0.5) / 20_000
    out = {}
    for n in range(STEP, VALUES + 1, STEP):
        for m in range(n + 1):
            p = np.exp(m * np.log(grid) + (n - m) * np.log1p(-grid) - m * math.log(max(m, 1e-9) / n) - (n - m) * math.log(max(n - m, 1e-9) / n))
            if p[grid >= threshold].sum() >= tolerance * p.sum():
                out[n] = m
                break
    return out


def _same(own: np.ndarray) -> bytes | None:
    """A key that only equal shingle sets share (128 bits of hashes and the size); None for an empty set."""
    return np.array([mix64(own + np.uint64(k)).sum() for k in (1, 2)], np.uint64).tobytes() + len(own).to_bytes(4, "little") if len(own) else None


def _profile(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, by = WordHashes(), _multipliers()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                own = [shingles((t.as_py() or "").lower().split(), words, hashes) for t in part.column(1)]
                same = [None if i is None else _same(x) for i, x in zip(part.column(0).to_pylist(), own)]
                cells = [None if s is None else bands(signature(x, by)) for s, x in zip(same, own)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(same, pa.binary()), pa.array(cells, pa.list_(pa.int64()))], names=["id", "same", "cells"])

    return run


def _content(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, by = WordHashes(), _multipliers()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                own = [shingles((t.as_py() or "").lower().split(), words, hashes) for t in part.column(0)]
                own = [x for x in own if len(x)]
                columns = [map(_same, own), (signature(x, by).tobytes() for x in own), (x.tobytes() for x in own)]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()) for c in columns], names=["same", "sig", "own"])

    return run


def _load(part: pa.Table) -> dict:
    own = [np.frombuffer(x, np.uint64) for x in part["own"].to_pylist()]
    return {"sig": np.frombuffer(b"".join(part["sig"].to_pylist()), np.uint32).reshape(part.num_rows, VALUES), "own": own, "size": np.array([len(x) for x in own])}


def _shared(a: dict, b: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact sizes of the intersections of many pairs."""
    out = np.zeros(len(i), np.int64)
    if len(i) < 64:
        for k, (x, y) in enumerate(zip(i.tolist(), j.tolist())):
            out[k] = len(np.intersect1d(a["own"][x], b["own"][y], assume_unique=True))
        return out
    order = np.argsort(i, kind="stable")
    edges = np.nonzero(np.diff(i[order]))[0] + 1
    for rows in np.split(order, edges):
        one = a["own"][i[rows[0]]]
        many = [b["own"][y] for y in j[rows].tolist()]
        flat = np.concatenate(many)
        at = np.searchsorted(one, flat)
        at[at == len(one)] = 0
        hits = np.concatenate([[0], np.cumsum(one[at] == flat)])
        ends = np.cumsum([len(x) for x in many])
        out[rows] = hits[ends] - hits[np.concatenate([[0], ends[:-1]])]
    return out


def _linked(threshold: float, tolerance: float):
    need = least_matches(threshold, tolerance)

    def run(a: dict, b: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        stay, matches = np.arange(len(i)), np.zeros(len(i), np.int64)
        for n, least in need.items():
            x = slice(n - STEP, n)
            matches = matches + (a["sig"][i[stay], x] == b["sig"][j[stay], x]).sum(1)
            good = matches >= least
            stay, matches = stay[good], matches[good]
            if not len(stay):
                break
        out = np.zeros(len(i), bool)
        for at in range(0, len(stay), 4096):
            k = stay[at : at + 4096]
            both = _shared(a, b, i[k], j[k])
            # |A & B| / |A | B| >= threshold without dividing
            out[k] = both >= threshold * (a["size"][i[k]] + b["size"][j[k]] - both) - 1e-9
        return out

    return run


def jaccard_join(docs: DataFrame, threshold: float = 0.8, words: int = 5, tolerance: float = 1e-5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, copies_of, class_id, n_links)``, one row per row of ``docs``.

    copies_of: smallest id with the same shingle set; class_id: smallest id reachable by links;
    n_links: other rows at similarity ``threshold`` or more (exact Jaccard), copies included.
    """
    texts = small_batches(docs).select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    profile = stored(texts.mapInArrow(_profile(words), "id long, same binary, cells array<long>"))
    some = profile.where("same is not null")
    classes = stored(some.groupBy("same").agg(F.min("id").alias("rep"), F.count("*").alias("weight"), F.first("cells").alias("home")).withColumn("id", F.xxhash64("same")))
    items = classes.select("id", "weight", "home", F.col("home").alias("filed"))

    def fetch(ids: DataFrame) -> DataFrame:
        wanted = classes.join(ids, "id", "left_semi").select("rep").distinct()
        own = texts.join(wanted, texts.id == wanted.rep, "left_semi").select("text").mapInArrow(_content(words), "same binary, sig binary, own binary")
        return own.withColumn("id", F.xxhash64("same")).join(ids, "id", "left_semi").select("id", "sig", "own").dropDuplicates(["id"])

    found = stored(bucket_links(items, ["sig", "own"], BANDS, _load, _linked(threshold, tolerance), merge_equal=True, fetch=fetch))
    counts = found.groupBy("id").agg(F.sum("n_links").alias("links"))
    whole = components(found.select(F.col("id").alias("src"), F.col("root").alias("dst")))
    linked = stored(classes.select("id", "rep").join(counts, "id").join(whole, "id"))
    least = linked.groupBy("component").agg(F.min("rep").alias("class_id"))
    linked = linked.join(least, "component").select("id", "links", "class_id")
    classes = classes.select("id", "same", "rep", "weight").join(linked, "id", "left")
    classes = classes.select("same", F.col("rep").alias("copies_of"), F.coalesce("class_id", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    blank = profile.where("same is null").select("id", F.col("id").alias("copies_of"), F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return some.select("id", "same").join(classes, "same").select("id", "copies_of", "class_id", "n_links").union(blank)
