"""Sets of nodes as words of 64 bits, in Arrow tables: what ``traverse.reach_counts`` does within one group of sources.

Lists of numbers are the bytes of little-endian 64-bit integers, which Spark hands over as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext

#: Words that are united at a time; one source's words are never parted.
CHUNK = 1 << 20


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.flatnonzero(new)


def _listed(starts: np.ndarray, values: np.ndarray) -> pa.Array:
    ends = pa.py_buffer((8 * np.append(starts, len(values))).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, ends, pa.py_buffer(np.ascontiguousarray(values))])


def _lists(rows: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    column = rows.column(name).combine_chunks()
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.diff(ends) // 8, np.frombuffer(column.buffers()[2] or b"", np.int64, (ends[-1] - ends[0]) // 8, ends[0])


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(src, dst)`` of one partition -> ``(g, dst, inner, first, srcs)`` without repeats.

    g: the partition; inner: these sources also have a link to themselves; first: the first row of ``dst``.
    """
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    src, dst = (np.concatenate([b.column(k).to_numpy() for b in parts]) for k in (0, 1))
    group = TaskContext.get().partitionId()
    order = np.lexsort((src, dst))
    src, dst = src[order], dst[order]
    once = _starts(src, dst)
    src, dst = src[once], dst[once]
    own = np.isin(src, src[src == dst])
    for inner in (True, False):
        s, d = src[own == inner], dst[own == inner]
        if len(s):
            at = _starts(d)
            first = np.full(len(at), True) if inner else ~np.isin(d[at], dst[own])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), group)), pa.array(d[at]), pa.array(np.full(len(at), inner)), pa.array(first), _listed(at, s)], ["g", "dst", "inner", "first", "srcs"])


def _united(rows: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``src, block, bits``: the union of the words of all that a source has links to, sorted, some whole sources at a time.

    A row has the sources of ``dst`` (srcs) or some of its words (blocks, bits).
    """
    dst = rows.column("dst").to_numpy()
    n, src = _lists(rows, "srcs")
    at = np.repeat(dst, n)
    n, block = _lists(rows, "blocks")
    bits, to = _lists(rows, "bits")[1].view(np.uint64), np.repeat(dst, n)
    if not len(to) or not len(at):
        return
    order = np.argsort(to, kind="stable")
    to, bits = to[order], bits[order]
    blocks, block = np.unique(block[order], return_inverse=True)
    first = _starts(to)
    names, first = to[first], np.append(first, len(to))
    k = np.minimum(np.searchsorted(names, at), len(names) - 1)
    there = names[k] == at
    src, k = src[there], k[there]
    order = np.argsort(src, kind="stable")
    src, k = src[order], k[order]
    count = first[k + 1] - first[k]
    before = np.append(0, np.cumsum(count))
    own = _starts(src)
    source, own, nth = src[own], np.append(own, len(src)), np.repeat(np.arange(len(own)), np.diff(np.append(own, len(src))))
    lo = 0
    while lo < len(source):
        hi = max(lo + 1, int(np.searchsorted(before[own], before[own[lo]] + CHUNK, "right")) - 1)
        i, j = own[lo], own[hi]
        c = count[i:j]
        word = np.repeat(first[k[i:j]] - (before[i:j] - before[i]), c) + np.arange(before[j] - before[i])
        key = np.repeat(nth[i:j] - lo, c) * len(blocks) + block[word]
        order = np.argsort(key)
        key = key[order]
        run = _starts(key)
        yield source[lo + key[run] // len(blocks)], blocks[key[run] % len(blocks)], np.bitwise_or.reduceat(bits[word[order]], run)
        lo = hi


def alone(batches: Iterator[pa.RecordBatch], pack: int) -> Iterator[pa.RecordBatch]:
    """``(nid, k)`` -> what ``spread`` gives for sources that reach number k only."""
    for b in batches:
        block, each = b.column(1).to_numpy() // 64, np.arange(b.num_rows)
        bits = np.left_shift(np.uint64(1), (b.column(1).to_numpy() % 64).astype(np.uint64))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(block // pack), _listed(each, block), _listed(each, bits), pa.array(np.ones(len(each), np.int64))], schema=PACKED)


def spread(rows: pa.Table, pack: int) -> pa.Table:
    """The united words as ``(nid, pack, blocks, bits, n)``, a row for ``pack`` blocks of a source; n: how many bits are set."""
    out = []
    for src, block, bits in _united(rows):
        at = _starts(src, block // pack)
        out.append(pa.table([pa.array(src[at]), pa.array(block[at] // pack), _listed(at, block), _listed(at, bits), pa.array(np.add.reduceat(np.bitwise_count(bits).astype(np.int64), at))], PACKED))
    return pa.concat_tables(out) if out else PACKED.empty_table()


def counted(rows: pa.Table) -> pa.Table:
    """``(id, up, n)``: how many bits each source has, and (up) in how many sources bit id % 64 of block id div 64 is set."""
    out = []
    for src, block, bits in _united(rows):
        at = _starts(src)
        out.append((src[at], np.zeros(len(at), bool), np.add.reduceat(np.bitwise_count(bits).astype(np.int64), at)))
        blocks, k = np.unique(block, return_inverse=True)
        bit = np.flatnonzero(np.unpackbits(bits.astype("<u8").view(np.uint8), bitorder="little"))
        sums = np.bincount(k[bit >> 6] * 64 + (bit & 63), minlength=len(blocks) * 64)
        some = np.flatnonzero(sums)
        out.append((blocks[some >> 6] * 64 + (some & 63), np.ones(len(some), bool), sums[some]))
    if not out:
        return COUNTED.empty_table()
    found = pa.table([np.concatenate(c) for c in zip(*out, strict=True)], COUNTED)
    return found.group_by(["id", "up"]).aggregate([("n", "sum")]).select(["id", "up", "n_sum"]).rename_columns(["id", "up", "n"]).cast(COUNTED)


PACKED = pa.schema([("nid", pa.int64()), ("pack", pa.int64()), ("blocks", pa.binary()), ("bits", pa.binary()), ("n", pa.int64())])
COUNTED = pa.schema([("id", pa.int64()), ("up", pa.bool_()), ("n", pa.int64())])
