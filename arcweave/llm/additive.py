"""Approximate nearest neighbours by additive quantisation.

A vector is the sum of one full-dimensional codeword from each of M codebooks, each fitted by k-means
to what the ones before leave, on a bounded sample of rows. Encoding is a beam search: the best partial sums are extended codebook by codebook. Each code is stored with the
ratio of the vector's norm to its reconstruction's. A query's score for a code is a sum of M
look-ups in its table of inner products, times that ratio; the best ``rerank`` of all rows are
scored exactly.

Every row is indexed and every query meets every code: codes are held in groups of ``GROUP`` and
queries stream past them in parts, so memory is bounded, and only each part's best lists move on.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no
part, nor do rows with a null id; vectors of different lengths have no inner product, so each length
has an index of its own; rows that repeat an id are one candidate (the one that scores best) and never a
neighbour of that id; an id that asks with several vectors asks with one of them for each length. Ties go to the smaller id. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

BOOKS, WORDS, BEAM, GROUP, QUERIES = 24, 256, 4, 65_536, 4096


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, steps: int = 8) -> np.ndarray:
    c = x[rng.permutation(len(x))[:k]].copy()
    if len(c) < k:
        c = np.concatenate([c, np.zeros((k - len(c), x.shape[1]), x.dtype)])
    for _ in range(steps):
        near = (x @ c.T - 0.5 * (c**2).sum(1)).argmax(1)
        n = np.bincount(near, minlength=k)
        order = np.argsort(near, kind="stable")
        full = np.flatnonzero(n)
        sums = np.add.reduceat(x[order], np.concatenate([[0], np.cumsum(n[full])[:-1]]), axis=0)
        c[full] = sums / n[full, None]
        if len(full) < k:
            c[n == 0] = x[rng.integers(0, len(x), k - len(full))]
    return c


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """(n, M) uint8 codes by beam search."""
    n, size = x.shape
    m, words, _ = books.shape
    left = x[:, None, :]  # what each partial sum still lacks
    codes = np.zeros((n, 1, 0), np.uint8)
    for book in books:
        # |r - c|^2 = |r|^2 - 2 r.c + |c|^2
        cost = (left**2).sum(2)[:, :, None] - 2 * (left.reshape(-1, size) @ book.T).reshape(n, -1, words) + (book**2).sum(1)
        flat = cost.reshape(n, -1)
        keep = min(beam, flat.shape[1])
        best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
        source, word = np.divmod(best, words)
        left = np.take_along_axis(left, source[:, :, None], 1) - book[word]
        codes = np.concatenate([np.take_along_axis(codes, source[:, :, None], 1), word[:, :, None].astype(np.uint8)], 2)
    best = (left**2).sum(2).argmin(1)
    return codes[np.arange(n), best]


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return sum(books[m][codes[:, m]] for m in range(len(books)))


def train(x: np.ndarray) -> np.ndarray:
    """(M, 256, size) residual codebooks for the rows of ``x``."""
    rng, left, books = np.random.default_rng(404), x.astype(np.float32), []
    for _ in range(BOOKS):
        book = _kmeans(left, WORDS, rng)
        books.append(book)
        left = left - book[(left @ book.T - 0.5 * (book**2).sum(1)).argmax(1)]
    return np.stack(books)


def _rows(column: pa.ListArray, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _index(books: np.ndarray, groups: int, copies: int):
    """Codes in packs, each a row for every part of the queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x = _rows(part.column(1), books.shape[2])
                codes = encode(x.astype(np.float32), books)
                ratio = np.sqrt((x**2).sum(1)) / np.maximum(np.sqrt((decode(codes, books).astype(np.float64) ** 2).sum(1)), 1e-30)
                ids = part.column(0).to_numpy()
                group = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % groups
                rows = []
                for g in np.unique(group).tolist():
                    own = group == g
                    packed = ids[own].tobytes(), codes[own].tobytes(), ratio[own].astype(np.float32).tobytes()
                    rows += [(g, s, 0, None, *packed) for s in range(copies)]
                yield _packed(rows)

    return run


_PACK = "g int, part int, kind int, query_id long, ids binary, codes binary, ratio binary"


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32()] * 3 + [pa.int64()] + [pa.binary()] * 3
    columns = list(zip(*rows)) if rows else [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["g", "part", "kind", "query_id", "ids", "codes", "ratio"])


def _best(scores: np.ndarray, ids: np.ndarray, own: int, most: int) -> np.ndarray:
    """Places of the ``most`` best scores but the query's own, ties by id."""
    scores = np.where(ids == own, -np.inf, scores)
    if len(scores) > most:
        bar = np.partition(scores, len(scores) - most)[len(scores) - most]
        sure, tied = np.flatnonzero(scores > bar), np.flatnonzero(scores == bar)
        tied = tied[np.argsort(ids[tied], kind="stable")][: most - len(sure)]
        at = np.concatenate([sure, tied])
    else:
        at = np.arange(len(scores))
    return at[np.isfinite(scores[at])]


def _search(books: np.ndarray, rerank: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, packs, held = None, [], None
        for batch in batches:
            rows = [batch.column(k).to_pylist() for k in range(4)]
            out, waiting = [], []

            def flush() -> None:
                ids, codes, ratio = held
                for at in range(0, len(waiting), 64):
                    some = waiting[at : at + 64]
                    q = np.stack([np.frombuffer(v, np.float32) for _, v in some])
                    total = np.zeros((len(ids), len(some)), np.float32)
                    for m, book in enumerate(books):
                        total += (book @ q.T)[codes[:, m]]
                    total *= ratio[:, None]
                    for k, (query_id, _) in enumerate(some):
                        best = _best(total[:, k], ids, query_id, rerank)
                        out.append((query_id, now[0], total[best, k], -ids[best]))
                waiting.clear()

            for k, (g, part, kind, query_id) in enumerate(zip(*rows)):
                if (g, part) != now:
                    if waiting:
                        flush()
                    now, packs, held = (g, part), [], None
                pack = [batch.column(c)[k].as_py() for c in (4, 5, 6)]
                if kind == 0:
                    packs.append(pack)
                    continue
                if held is None:
                    ids, codes, ratio = (b"".join(p[c] for p in packs) for c in range(3))
                    held = np.frombuffer(ids, np.int64), np.frombuffer(codes, np.uint8).reshape(-1, len(books)), np.frombuffer(ratio, np.float32)
                    packs = []
                waiting.append((query_id, pack[0]))
            if waiting:
                flush()
            found = [[{"score": float(s), "back": int(i)} for s, i in zip(o[2], o[3])] for o in out]
            kind = pa.list_(pa.struct([("score", pa.float32()), ("back", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int32()), pa.array(found, kind)], names=["query_id", "g", "best"])

    return run


def _exact(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.einsum("ij,ij->i", _rows(batch.column(2), size), _rows(batch.column(3), size))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64())], names=["query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, is_query, k: int = 20, rerank: int = 256, sample: int = 10_000, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row where the Column ``is_query`` holds, its k nearest by inner product."""
    spark = vectors.sparkSession
    vector = F.col(vector_column).cast("array<double>")
    fit = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(vector, lambda x: x != 0) & F.col(id_column).isNotNull()
    own = vectors.where(F.coalesce(fit, F.lit(False))).select(F.col(id_column).cast("long").alias("vec_id"), vector.alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    # one row for each length that occurs
    lengths = own.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n"), F.sum(F.col("asks").cast("long")).alias("asking")).where("asking > 0").orderBy("size").collect()
    scored = [_scored(own.where(F.size("vector") == size), size, n, asking, rerank, sample) for size, n, asking in lengths]
    if not scored:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    scored = reduce(DataFrame.union, scored).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def sampled(own: DataFrame, sample: int) -> np.ndarray:
    """At most ``sample`` distinct vectors, those with the smallest hashes of id and vector, in one order."""
    by = F.xxhash64("vec_id", "vector")
    limit = own.select(by.alias("h")).orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    # repeated rows have equal hashes; they are dropped before anything moves to the driver
    fitted = own.where(by <= limit).groupBy("vec_id", "vector").agg(F.lit(1)).select("vec_id", "vector").toPandas()
    rows = sorted(zip(fitted["vec_id"].tolist(), map(tuple, fitted["vector"].tolist())))
    return np.array([v for _, v in rows])


def _scored(own: DataFrame, size: int, n: int, asking: int, rerank: int, sample: int) -> DataFrame:
    """``(query_id, vec_id, score)`` with exact scores of the ``rerank`` best rows of each query, all vectors being of one length."""
    books = train(sampled(own, sample))
    groups, parts = -(-n // GROUP), max(1, -(-asking // QUERIES))
    codes = own.select("vec_id", "vector").mapInArrow(_index(books, groups, parts), _PACK)
    asks = own.where("asks").dropDuplicates(["vec_id"]).select("vec_id", "vector")
    pack = lambda batches: (pa.RecordBatch.from_arrays([b.column(0), pa.array([x.astype(np.float32).tobytes() for x in _rows(b.column(1), size)], pa.binary())], names=["query_id", "ids"]) for b in batches)
    queries = asks.mapInArrow(pack, "query_id long, ids binary").select(
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("kind"), "query_id", "ids", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("binary").alias("ratio")
    )
    met = codes.union(queries).repartition("g", "part").sortWithinPartitions("g", "part", "kind")
    best = met.mapInArrow(_search(books, rerank), "query_id long, g int, best array<struct<score: float, back: long>>")
    while groups > 1:
        best = best.groupBy("query_id", F.expr("g div 64").cast("int").alias("g")).agg(F.slice(F.sort_array(F.flatten(F.collect_list("best")), asc=False), 1, rerank).alias("best"))
        groups = -(-groups // 64)
    near = stored(best.select("query_id", F.explode("best").alias("c")).select("query_id", (-F.col("c.back")).alias("vec_id")).distinct())
    pairs = near.join(own.select(F.col("vec_id"), F.col("vector").alias("v")), "vec_id").join(asks.select(F.col("vec_id").alias("query_id"), F.col("vector").alias("q")), "query_id")
    return pairs.select("query_id", "vec_id", "q", "v").mapInArrow(_exact(size), "query_id long, vec_id long, score double")
