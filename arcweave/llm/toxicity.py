"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are hashed character n-grams of the distinct lower-cased words of a text. Training uses at
most ``most_rows`` labelled rows, those with the smallest hashed ids, so their ids can be broadcast and
no text is shuffled; ``most_cells`` bounds what the regression holds. Log-count ratios r come from counts over them (aggregated on the executors to
``BUCKETS`` pairs of numbers), then a logistic regression on the scaled features f * r is fitted. A score is the sigmoid of
bias + sum over distinct words of the word's weight, so scoring needs one dictionary look-up a word.

Defined results: null and empty texts score as a text without words (the bias alone); rows with null
ids or labels train nothing; without both classes in training, all scores are the smoothed share of
the toxic. Ids, languages, sources and labels are never inputs of a score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, small_batches, stored

BUCKETS, SIZES = 1 << 18, (3, 4, 5)


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all ``words``, with marks at their ends, and the place of the word that each is from."""
    marked = [f"<{w}>" for w in words]
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    point = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(marked)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(point))
    buckets, places, run = [], [], np.zeros(len(point), np.uint64)
    for n in range(1, max(SIZES) + 1):
        run = run[: len(point) - n + 1] * np.uint64(1_000_003) + point[n - 1 :] if len(point) >= n else run[:0]
        if n in SIZES:
            at = np.flatnonzero(left[: len(run)] >= n)
            buckets.append((mix64(run[at] + np.uint64(n)) % np.uint64(BUCKETS)).astype(np.int32))
            places.append(word[at])
    return np.concatenate(buckets), np.concatenate(places)


def _features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the distinct words of a text, and how often each occurs in them."""
    return np.unique(grams(list(set((text or "").lower().split())))[0], return_counts=True)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of two count vectors for each task: texts of either class in which a bucket occurs."""
    seen, rows = np.zeros((2, BUCKETS), np.int64), np.zeros(2, np.int64)
    for batch in batches:
        for label, text in zip(batch.column(1).to_pylist(), batch.column(2)):
            seen[label][_features(text.as_py())[0]] += 1
            rows[label] += 1
    for label in (0, 1):
        if rows[label]:
            at = np.flatnonzero(seen[label])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at) + 1, label), pa.int32()), pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(seen[label][at], rows[label]), pa.int64())], names=["label", "bucket", "n"])


def _vectors(useful: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(BUCKETS, -1, np.int32)
        place[useful] = np.arange(len(useful))
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                own = [_features(t.as_py()) for t in part.column(2)]
                own = [(place[b[place[b] >= 0]], n[place[b] >= 0].astype(np.int32)) for b, n in own]
                columns = [part.column(1), *(pa.array([x[k].tobytes() for x in own], pa.binary()) for k in (0, 1)), pa.array([len(x[0]) for x in own], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["label", "buckets", "counts", "cells"])

    return run


def fit(train: DataFrame, steps: int = 200, least_ratio: float = 0.5, ridge: float = 1e-4, most_cells: int = 20_000_000) -> tuple[np.ndarray, float]:
    """``train(id, label int, text)`` -> bucket weights (already times r) and the bias.

    Buckets whose log-count ratio is under ``least_ratio`` in size carry next to nothing and get no weight. Ratios
    come from all of ``train``; the regression's rows go to the driver, in the order of a hash of their features
    as long as they hold ``most_cells`` features at most, which bounds the memory however long the texts are.
    """
    train = train.where("id is not null and label in (0, 1)").select("id", F.col("label").cast("int").alias("label"), "text")
    summed = train.mapInArrow(_counts, "label int, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toPandas()
    label, bucket, n = (summed[c].to_numpy() for c in ("label", "bucket", "n"))
    rows, seen, whole = np.zeros(2), np.zeros((2, BUCKETS)), bucket < 0
    rows[label[whole]] = n[whole]
    seen[label[~whole], bucket[~whole]] = n[~whole]
    if not rows.all():
        share = (rows[1] + 1) / (rows.sum() + 2)
        return np.zeros(BUCKETS), math.log(share / (1 - share))
    ratio = np.log((seen[1] + 1) / (rows[1] + 2)) - np.log((seen[0] + 1) / (rows[0] + 2))
    ratio[np.abs(ratio) < least_ratio] = 0
    useful = np.flatnonzero(ratio)
    vectors = stored(train.mapInArrow(_vectors(useful), "label int, buckets binary, counts binary, cells long").withColumn("h", F.xxhash64("label", "buckets", "counts")))
    sizes = vectors.groupBy("h").agg(F.sum("cells").alias("cells")).orderBy("h").collect()
    room = np.searchsorted(np.cumsum([r["cells"] for r in sizes]), most_cells, "right")
    if room < len(sizes):
        vectors = vectors.where(F.col("h") < sizes[max(room, 1)]["h"])
    sample = vectors.select("label", "buckets", "counts").toPandas()
    sample = sample.sort_values(["label", "buckets", "counts"], kind="stable")  # summation in one order
    y = sample["label"].to_numpy().astype(float)
    buckets = [np.frombuffer(x, np.int32) for x in sample["buckets"]]
    doc, col = np.repeat(np.arange(len(y)), [len(x) for x in buckets]), np.concatenate(buckets)
    value = np.concatenate([np.frombuffer(x, np.int32) for x in sample["counts"]]) * ratio[useful[col]]
    weight, bias = np.zeros(len(useful)), math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    mean, square = np.zeros(len(useful) + 1), np.zeros(len(useful) + 1)
    for k in range(1, steps + 1):
        off = 1 / (1 + np.exp(-np.clip(bias + np.bincount(doc, value * weight[col], len(y)), -500, 500))) - y
        slope = np.append(np.bincount(col, value * off[doc], len(useful)) / len(y) + ridge * weight, off.mean())
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        step = 0.05 * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-8)
        weight, bias = weight - step[:-1], bias - step[-1]
    out = np.zeros(BUCKETS)
    out[useful] = weight * ratio[useful]
    return out, float(bias)


def _scored(weights: np.ndarray, bias: float, memo: dict[str, float], column: pa.Array) -> list[float]:
    texts = [set((t.as_py() or "").lower().split()) for t in column]
    if len(memo) > 200_000:
        memo.clear()
    new = list(set().union(*texts) - memo.keys())
    for k in range(0, len(new), 20_000):
        words = new[k : k + 20_000]
        bucket, word = grams(words)
        memo.update(zip(words, np.bincount(word, weights[bucket], len(words)).tolist()))
    # math.fsum: the order of a set must not show in the score
    sums = (bias + math.fsum(map(memo.__getitem__, words)) for words in texts)
    return [1 / (1 + math.exp(-max(-700.0, min(700.0, x)))) for x in sums]


def _score(weights: np.ndarray, bias: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, float] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_scored(weights, bias, memo, part.column(1)), pa.float64())], names=["id", "score"])

    return run


def score_toxicity(docs: DataFrame, model: tuple[np.ndarray, float], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, score)`` for every row of ``docs``; the model is ``BUCKETS`` numbers whatever the corpus is."""
    return small_batches(docs).select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")).mapInArrow(_score(*model), "id long, score double")


def toxic_labels(docs: DataFrame, labels: DataFrame, most_rows: int = 8000, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Training rows ``(id, label, text)``: at most ``most_rows`` of ``docs``, those of the labelled ids with the smallest hashes.

    An id labelled twice takes its larger label; one that occurs in several rows brings them all, and is left out if
    they don't fit. The sample is the same however the tables are partitioned.
    """
    said = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").cast("int").alias("label"))
    said = said.orderBy(F.xxhash64("id"), "id").limit(most_rows).withColumn("h", F.xxhash64("id"))
    own = F.col(id_column).cast("long").alias("id")
    # at most ``most_rows`` ids; rows are counted by the id column alone
    found = docs.select(own).join(F.broadcast(said), "id").groupBy("id", "label", "h").agg(F.count("*").alias("rows")).orderBy("h", "id").collect()
    chosen, left = [], most_rows
    for r in found:
        if r["rows"] <= left:
            chosen.append((r["id"], r["label"]))
            left -= r["rows"]
    said = docs.sparkSession.createDataFrame(chosen, "id long, label int")
    return small_batches(docs).select(own, F.col(text_column).alias("text")).join(F.broadcast(said), "id").select("id", "label", "text")


def drop_toxic(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = 0.7, text_column: str = "text") -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; all columns pass through, in one pass and without a shuffle."""
    at_text = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, float] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                yield part.filter(pa.array([x < threshold for x in _scored(*model, memo, part.column(at_text))], pa.bool_()))

    return small_batches(docs).mapInArrow(run, docs.schema)
