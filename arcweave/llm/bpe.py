"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token's adjacent pairs wait in buckets, one per merge rank, of positions in a linked list of
parts. A bitmap of two levels marks the ranks with waiting pairs: find-first-set on each level gives the
next rank in a time that doesn't depend on the pre-token's length. Within a rank the leftmost pair goes
first; entries whose pair has changed meanwhile are stale and skipped. So a pre-token of n bytes
takes O(n log n) steps (the logarithm only for many pairs of equal rank), never O(n * n).

Encoding is per pre-token, so each worker remembers a bounded number of them. Decoding looks ids up
in the table of token bytes.

Defined results: a null or empty text has no tokens; lone surrogates can't occur in Spark strings;
decoding the ids of a text gives its UTF-8 bytes; an id that the table lacks is an error.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

BITS = 6
MASK = (1 << BITS) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank of a ``.tiktoken`` file."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token.

    The queue: ``buckets[rank]`` is a heap of positions, ``words[rank >> BITS]`` has a bit for each rank
    with a bucket in use, ``top`` one for each word in use. It is written out in place, as a call for
    each push and pop would double the time.
    """
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    rank_of = ranks.get
    buckets: dict[int, list[int]] = {}
    words: dict[int, int] = {}
    top = 0
    end = list(range(1, n + 1))  # end[i]: where the part that begins at i ends, and so where the next one begins
    before = list(range(-1, n))
    waiting: list[int | None] = [rank_of(piece[i : i + 2]) for i in range(n)]  # rank of the pair that begins at i; anything else in the queue is stale
    waiting[n - 1] = None
    for i, rank in enumerate(waiting):
        if rank is not None:
            if rank in buckets:
                buckets[rank].append(i)
            else:
                buckets[rank] = [i]
                word = rank >> BITS
                words[word] = words.get(word, 0) | 1 << (rank & MASK)
                top |= 1 << word
    while top:
        word = (top & -top).bit_length() - 1
        bits = words[word]
        rank = word << BITS | (bits & -bits).bit_length() - 1
        bucket = buckets[rank]
        i = heappop(bucket)
        if not bucket:
            del buckets[rank]
            words[word] = bits = bits & (bits - 1)
            if not bits:
                top &= top - 1
        if waiting[i] != rank:
            continue
        j = end[i]
        stop = end[i] = end[j]
        waiting[j] = None
        changed = []
        if stop < n:
            before[stop] = i
            changed.append((i, rank_of(piece[i : end[stop]])))
        else:
            waiting[i] = None
        if i:
            left = before[i]
            changed.append((left, rank_of(piece[left:stop])))
        for at, rank in changed:
            waiting[at] = rank
            if rank is not None:
                if rank in buckets:
                    heappush(buckets[rank], at)
                else:
                    buckets[rank] = [at]
                    word = rank >> BITS
                    words[word] = words.get(word, 0) | 1 << (rank & MASK)
                    top |= 1 << word
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Coder(dict):
    """Pre-token -> its ids, for a bounded number of short pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, most: int = 1_000_000):
        super().__init__()
        self.ranks, self.find, self.most = ranks, regex.compile(pattern).findall, most
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.digits = {rank: str(rank) for rank in self.bytes_of}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = tuple(merge(piece.encode(), self.ranks))
        if len(piece) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for ids in map(self.__getitem__, self.find(text)):
            out += ids
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=1)
def worker_coder(path: str, pattern: str) -> Coder:
    """One coder for all tasks that a Python worker runs, so that what it remembers outlives a task."""
    return Coder(read_ranks(path), pattern)


def encoded(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, ids array<int>)`` for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = worker_coder(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([coder.encode(t.as_py() or "") for t in part.column(1)], pa.list_(pa.int32()))], names=["id", "ids"])

    return small_batches(docs).select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")).mapInArrow(run, "id long, ids array<int>")


def decoded(ids: DataFrame, path: str) -> DataFrame:
    """``(id, bytes binary)`` for each row of ``ids(id, ids array<int>)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = {rank: token for token, rank in read_ranks(path).items()}
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([b"".join(map(bytes_of.__getitem__, x.as_py() or ())) for x in part.column(1)], pa.binary())], names=["id", "bytes"])

    return ids.select("id", "ids").mapInArrow(run, "id long, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)``: every text is encoded and its ids are decoded, in one pass that sends no ids anywhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = worker_coder(path, pattern)
        digits = coder.digits.__getitem__
        for batch in batches:
            rows = []
            for text in batch.column(1):
                ids = coder.encode(text.as_py() or "")
                rows.append((len(ids), hashlib.sha256(",".join(map(digits, ids)).encode()).hexdigest(), hashlib.sha256(coder.decode(ids)).hexdigest()))
            columns = list(zip(*rows)) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return small_batches(docs).select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")).mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
