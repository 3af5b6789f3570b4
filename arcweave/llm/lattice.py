"""Embedding near-dedup by lattice hashing: random projections decoded to E8 lattice points.

Each of T tables projects a unit vector to 8 dimensions, scales it and files it under the nearest E8
lattice point and the nearest of that point's 240 neighbours (multi-probe). Vectors that meet in a
cell that is the nearest one for either are verified by exact cosine in double precision.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows
without a label, link with nothing and are kept; vectors of different length never link; equal
vectors of a label are one class with a weight, so groups of copies are never expanded; repeated
ids count as often as they occur. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import bucket_links
from .common import mix64, stored
from .components import components

TABLES, PROBES, SCALE = 10, 5, 2.4


def neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8: all of D8's, and the even sign patterns of halves."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) / 2 for s in product((1.0, -1.0), repeat=8) if np.prod(s) > 0]
    return np.array(out)


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    y = np.rint(x)
    off = x - y
    odd = np.flatnonzero(np.rint(y.sum(1)).astype(np.int64) & 1)
    at = np.abs(off[odd]).argmax(1)
    y[odd, at] += np.where(off[odd, at] < 0, -1.0, 1.0)
    return y


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest point of E8 = D8 and D8 + (1/2, ..., 1/2) for each row of ``x`` (n, 8)."""
    whole, half = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    closer = ((x - half) ** 2).sum(1) < ((x - whole) ** 2).sum(1)
    return np.where(closer[:, None], half, whole)


def projections(size: int) -> np.ndarray:
    """(T, size, 8): orthonormal columns scaled so that a cell holds what is about as near as the threshold asks."""
    rng = np.random.default_rng(88_000 + size)
    wide = max(size, 8)
    return np.stack([np.linalg.qr(rng.standard_normal((wide, 8)))[0][:size] for _ in range(TABLES)]) * SCALE * np.sqrt(wide / 8)


def _cell(points: np.ndarray, table: int, label: np.ndarray, size: int) -> np.ndarray:
    """Non-zero int64 for each lattice point (doubled coordinates are integers)."""
    x = mix64(label.astype(np.int64).view(np.uint64) + np.uint64(table * 100_003 + size))
    x = np.broadcast_to(x[:, None], points.shape[:2]) if points.ndim == 3 else x
    for k in range(8):
        x = mix64(x + np.rint(points[..., k] * 2).astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return x.view(np.int64) | 1


def file_under(unit: np.ndarray, label: np.ndarray) -> np.ndarray:
    """(n, T, 1 + P) cells of unit vectors (n, size): the nearest first."""
    near, out = neighbours(), np.empty((len(unit), TABLES, 1 + PROBES), np.int64)
    for t, by in enumerate(projections(unit.shape[1])):
        x = unit @ by
        home = nearest_e8(x)
        order = np.argpartition(-((x - home) @ near.T), PROBES - 1, axis=1)[:, :PROBES]
        points = np.concatenate([home[:, None], home[:, None] + near[order]], axis=1)
        out[:, t] = _cell(points, t, label, unit.shape[1])
    return out


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            sizes = np.diff(part.column(2).offsets.to_numpy())
            for size in np.unique(sizes).tolist():
                own = part.take(pa.array(np.flatnonzero(sizes == size)))
                x = own.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(own.num_rows, size)
                x = x / np.abs(x).max(1, keepdims=True)
                unit = x / np.sqrt((x**2).sum(1, keepdims=True))
                cells = file_under(unit, own.column(1).to_numpy()).reshape(own.num_rows, -1)
                columns = [own.column(0), pa.array(list(cells[:, :: 1 + PROBES]), pa.list_(pa.int64())), pa.array(list(cells), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "home", "filed"])


def _load(part: pa.Table) -> dict:
    return {"vector": [x.values.to_numpy(zero_copy_only=False).astype(np.float64) for x in part["vector"]]}


def _linked(threshold: float):
    def run(a: dict, b: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        size = len(a["vector"][0])
        x, y = np.stack([v if len(v) == size else np.zeros(size) for v in a["vector"]]), np.stack([v if len(v) == size else np.zeros(size) for v in b["vector"]])
        x, y = (v / np.maximum(np.abs(v).max(1, keepdims=True), 1e-300) for v in (x, y))
        nx, ny = np.sqrt((x**2).sum(1)), np.sqrt((y**2).sum(1))
        out = np.empty(len(i), bool)
        for at in range(0, len(i), 8192):
            p, q = i[at : at + 8192], j[at : at + 8192]
            out[at : at + 8192] = np.einsum("ij,ij->i", x[p], y[q]) >= threshold * (nx[p] * ny[q])
        return out

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """``(id, n_links, component_id, kept)``, one row per row: vectors of the same label with cosine >= ``threshold`` are linked."""
    own = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).cast("long").alias("label"), F.col(vector_column).cast("array<double>").alias("vector"))
    fit = F.size("vector") > 0
    fit &= F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vector", lambda x: x != 0)
    fit = F.coalesce(fit & F.col("label").isNotNull() & F.col("id").isNotNull(), F.lit(False))
    some = own.where(fit).withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0)))
    key = F.struct("label", "vector")
    classes = stored(some.groupBy("label", "vector").agg(F.count("*").alias("weight"), F.min("id").alias("rep")).withColumn("id", F.xxhash64(key)))
    cells = classes.select("id", "label", "vector").mapInArrow(_cells, "id long, home array<long>, filed array<long>")
    items = stored(cells.join(classes.select("id", "weight", "vector"), "id"))
    found = stored(bucket_links(items, ["vector"], TABLES, _load, _linked(threshold)))
    counts = found.groupBy("id").agg(F.sum("n_links").alias("links"))
    whole = components(found.select(F.col("id").alias("src"), F.col("root").alias("dst")))
    linked = stored(classes.select("id", "rep").join(counts, "id").join(whole, "id"))
    least = linked.groupBy("component").agg(F.min("rep").alias("least"))
    linked = linked.join(least, "component").select("id", "links", "least")
    classes = classes.join(linked, "id", "left").select(F.col("id").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("least", "rep").alias("component_id"))
    member = some.select("id", F.xxhash64(key).alias("class")).join(classes, "class").select("id", "n_links", "component_id")
    rest = own.where(~fit).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return member.union(rest).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
