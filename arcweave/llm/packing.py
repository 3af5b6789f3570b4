"""Best-fit decreasing packing of token sequences.

Each document is tokenised and, where it is longer than a sequence, cut into pieces. Best-fit
decreasing treats pieces of equal length alike, so it needs only how many there are of each length:
those counts (at most ``capacity`` numbers) go to the driver, which packs them with a segment tree
over the remaining capacities. The tightest open bin that fits is found in logarithmic time, for a
run of equal pieces at once, and the outcome is what placing them one by one would give. The plan
says where the pieces of each length with ranks a..b go; its size is bounded by the capacity, and it is a
table that the pieces are joined with. Ranks are dealt out on the executors in groups of about
``SALT_PIECES``, so that one very common length is no hot spot; full pieces need no rank.

Defined results: a null text is empty; an empty text is one token; a document longer than the
capacity has its short piece first; repeated rows are packed as often as they occur; a null id is
kept as null. Other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, stored

#: White space runs from this length on are left to the tokenizers library: the fast coder's pattern gives up on very long ones.
LONG_GAP = 50_000
#: Pieces of equal length that get their ranks in one task, and ranks that one row of the plan's index covers.
SALT_PIECES, RANKS = 50_000, 32
_GAP = re.compile(r"\s+")


def _has_long_gap(text: str) -> bool:
    return len(text) >= LONG_GAP and any(m.end() - m.start() >= LONG_GAP for m in _GAP.finditer(text))


def merges_are_ranks(model: dict, byte: dict[str, int]) -> bool:
    """Whether a tokenizer file is plain byte-level BPE whose merges, in order, make the ids that follow the single bytes."""
    bpe, before = model["model"], model["pre_tokenizer"] or {}
    plain = bpe["type"] == "BPE" and not any(bpe.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    plain = plain and model["normalizer"] is None and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    if not plain or not all(c in bpe["vocab"] for c in byte):
        return False
    made = ["".join(m if isinstance(m, list) else m.split(" ")) for m in bpe["merges"]]
    ids = [bpe["vocab"].get(x, -1) for x in made]
    known = set(byte) | set(made) | {x["content"] for x in model["added_tokens"]}
    return ids == sorted(set(ids)) and (not ids or ids[0] > max(bpe["vocab"][c] for c in byte)) and known >= set(bpe["vocab"])


@lru_cache(maxsize=1)
def byte_bpe(path: str):
    """text -> ids, made once in a Python worker, for the tokenizer file ``path`` (byte-level BPE of the tokenizers library, no special tokens added).

    The merges of such a file, taken as ranks, are the same coder that tiktoken runs, several times
    faster. The file is checked for that; else, and for texts that hold the string of a special token or a very
    long run of white space, the tokenizers library does the work.
    """
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    special = [x["content"] for x in model["added_tokens"]]
    slow: list[Tokenizer] = []  # loaded only when a text asks for it

    def library(text: str) -> list[int]:
        if not slow:
            slow.append(Tokenizer.from_file(path))
            slow[0].encode_special_tokens = True
        return slow[0].encode(text, add_special_tokens=False).ids

    if not merges_are_ranks(model, byte):
        return library
    ranks = {bytes(byte[c] for c in token): rank for token, rank in model["model"]["vocab"].items() if token not in special}
    # fixed value: the pattern of byte-level pre-tokenisation
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda text: library(text) if any(x in text for x in special) or _has_long_gap(text) else fast.encode_ordinary(text)


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; the short one, if any, is first."""
    first = length % capacity or capacity
    return [(0, min(first, length)), *((k, capacity) for k in range(first, length, capacity))]


def _pieces(tokenizer: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = []
                part = batch.slice(at, 500)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1)):
                    ids = np.array([*encode(text.as_py() or ""), end_id], "<u4")
                    for k, (start, length) in enumerate(cut(len(ids), capacity)):
                        rows.append((doc_id, k, start, length, zlib.crc32(ids[start : start + length].tobytes())))
                columns = list(zip(*rows)) if rows else [()] * 5
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["id", "piece", "start", "length", "ids_crc32"])

    return run


class OpenBins:
    """Segment tree over remaining capacities 0..capacity: how many open bins have each; finds the least one >= need."""

    def __init__(self, capacity: int):
        self.base = 1 << capacity.bit_length()
        self.tree = np.zeros(2 * self.base, np.int64).tolist()

    def add(self, room: int, n: int) -> None:
        at = room + self.base
        while at:
            self.tree[at] += n
            at //= 2

    def tightest(self, need: int) -> int | None:
        """Smallest remaining capacity >= ``need`` with an open bin."""
        at = need + self.base
        if self.tree[at]:
            return need
        while at > 1 and (at & 1 or not self.tree[at + 1]):
            at //= 2
        if at <= 1:
            return None
        at += 1
        while at < self.base:
            at = 2 * at if self.tree[2 * at] else 2 * at + 1
        return at - self.base


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over ``length -> count``: rows (length, first rank, pieces, first bin, pieces a bin, offset).

    The pieces of a row fill the bins one after the other, ``pieces a bin`` in each, from ``offset`` on.
    """
    bins, open_bins, made, out = defaultdict(list), OpenBins(capacity), 0, []
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = open_bins.tightest(length)
            if room is None:  # new bins, each filled with this length as far as it goes before the next is opened
                each = capacity // length
                whole, rest = divmod(left, each)
                fresh = [(whole, each), (1, rest)]
                room = capacity
                groups = [(made if k == 0 else made + whole, n, per) for k, (n, per) in enumerate(fresh) if n and per]
                made += whole + bool(rest)
            else:
                # one bin takes pieces until it holds no more (it stays the tightest); then the next of this capacity
                start, n = bins[room].pop()
                each = room // length
                whole, rest = divmod(min(left, n * each), each)
                groups = [(start, whole, each)] if whole else []
                if rest:
                    groups.append((start + whole, 1, rest))
                used = whole + bool(rest)
                if n > used:
                    bins[room].append((start + used, n - used))
                open_bins.add(room, -used)
            for start, n, per in groups:
                out.append((length, rank, n * per, start, per, capacity - room))
                rank, left = rank + n * per, left - n * per
                if rest_room := room - per * length:
                    bins[rest_room].append((start, n))
                    open_bins.add(rest_room, n)
    return out


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per piece: ``(id, piece, start, length, ids_crc32, sequence_id, offset)``."""
    spark = docs.sparkSession
    texts = small_batches(docs).select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    pieces = texts.mapInArrow(_pieces(tokenizer, capacity, end_id), "id long, piece int, start long, length long, ids_crc32 long")
    pieces = stored(pieces.withColumn("row", F.monotonically_increasing_id()))
    columns = ["id", "piece", "start", "length", "ids_crc32"]
    # a full piece is a sequence of its own: nothing to plan
    full = pieces.where(F.col("length") == capacity).select(*columns, (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    short = pieces.where(F.col("length") < capacity)
    counted = short.groupBy("length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in counted.collect()}  # fewer than ``capacity`` rows
    # ranks: each length is dealt in as many groups as it needs, and a group begins where those before it end
    salts = F.ceil(F.col("n") / SALT_PIECES).cast("long")
    dealt = short.join(F.broadcast(counted.select(F.col("length").alias("of"), salts.alias("salts"))), F.col("length") == F.col("of"))
    dealt = dealt.withColumn("salt", F.pmod(F.xxhash64("row"), F.col("salts"))).drop("of", "salts")
    groups = dealt.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = groups.select(F.col("length").alias("g_length"), F.col("salt").alias("g_salt"), before.alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("row"))
    ranked = dealt.withColumn("own", own).join(groups, (F.col("length") == F.col("g_length")) & (F.col("salt") == F.col("g_salt")))
    ranked = ranked.select(*columns, (F.col("own") - 1 + F.col("before")).alias("rank"))
    # the plan as a table: a row for every RANKS ranks that it covers, so that pieces find theirs by an equi-join
    rows = np.array(plan(counts, capacity), np.int64).reshape(-1, 6)
    names = ["p_length", "first", "pieces", "first_bin", "per", "base"]
    planned = stored(spark.createDataFrame(pa.table([pa.array(rows[:, k]) for k in range(6)], names=names)))
    spread = planned.withColumn("block", F.explode(F.expr(f"sequence(first div {RANKS}, (first + pieces - 1) div {RANKS})")))
    fits = (F.col("length") == F.col("p_length")) & (F.expr(f"rank div {RANKS}") == F.col("block")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("pieces"))
    place = F.col("rank") - F.col("first")
    placed = ranked.join(spread, fits).select(*columns, (F.col("first_bin") + F.floor(place / F.col("per"))).alias("sequence_id"), (F.col("base") + place % F.col("per") * F.col("length")).alias("offset"))
    return placed.union(full)
