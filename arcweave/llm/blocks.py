"""Exact link counting inside hash buckets, block by block, without emitting pairs.

Every item lies in a *home* cell of each of T tables and may also be filed under neighbouring
(*extra*) cells. Two items meet in a cell that both are filed under when it is the home of at
least one of them. A meeting is judged in one place only (the first table, then the home cell of
the smaller id), so a link counts once however many cells the two share.

A cell with n items is cut into ceil(n / block) hashed blocks and each pair of blocks is one small
group of rows: memory is bounded by two blocks, a cell of any size is spread over many groups, and
the rows sent grow as n * n / block, not as n * n. What comes back is one row per item and group:
its weighted number of links and the root of its spanning tree there, enough for exact link counts
and for connected components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

OUT = "id long, n_links long, root long"
#: Pairs judged at a time.
PAIRS = 16_384


def _meetings(t: int, cell: int, a: dict, b: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs (a[i], b[j]) of cell ``cell`` in table ``t`` are judged here."""
    swap = a["id"][i] > b["id"][j]
    home_i, home_j = a["home"][i], b["home"][j]
    at_i, at_j = home_i[:, t] == cell, home_j[:, t] == cell
    first = np.where(swap, at_j, at_i)
    good = at_i | at_j
    if good.any() and not first.all():
        # here only the larger id is at home: the smaller one's home cell comes first if they meet there as well
        other = np.where(swap, (a["filed"][i, t] == home_j[:, t, None]).any(1), (b["filed"][j, t] == home_i[:, t, None]).any(1))
        good &= first | ~other
    for s in range(t):
        met = ((b["filed"][j, s] == home_i[:, s, None]) & (home_i[:, s, None] != 0)).any(1)
        met |= ((a["filed"][i, s] == home_j[:, s, None]) & (home_j[:, s, None] != 0)).any(1)
        good &= ~met
        if not good.any():
            break
    return good


def _judge(t: int, cell: int, a: dict, b: dict, same: bool, linked: Callable) -> Iterator[tuple]:
    n, m = len(a["id"]), len(b["id"])
    if not n or not m:
        return
    i, j = np.triu_indices(n, 1) if same else map(np.ravel, np.indices((n, m), dtype=np.int32))
    kept = []
    for at in range(0, len(i), PAIRS):
        p, q = i[at : at + PAIRS], j[at : at + PAIRS]
        good = a["id"][p] != b["id"][q]
        for judge in (lambda x, y: _meetings(t, cell, a, b, x, y), lambda x, y: linked(a, b, x, y)):
            p, q = p[good], q[good]
            if not len(p):
                break
            good = judge(p, q)
        else:
            p, q = p[good], q[good]
        kept.append((p, q))
    i, j = (np.concatenate([k[c] for k in kept]).astype(np.int64) if kept else np.empty(0, np.int64) for c in (0, 1))
    if not len(i):
        return
    ids = np.concatenate([a["id"]] if same else [a["id"], b["id"]])
    j = j if same else j + n
    weight = np.concatenate([a["weight"]] if same else [a["weight"], b["weight"]])
    count = np.bincount(i, weight[j], len(ids)) + np.bincount(j, weight[i], len(ids))
    root = ids.copy()
    while True:
        least = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        if (new == root).all():
            break
        root = new
    touched = np.nonzero(count)[0]
    yield ids[touched], count[touched].astype(np.int64), root[touched]


def _grouped(batches: Iterator[pa.RecordBatch], tables: int, load: Callable, linked: Callable) -> Iterator[pa.RecordBatch]:
    def flush(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = pa.Table.from_batches(rows).combine_chunks()
        t, cell, left, right = (part[c][0].as_py() for c in ("t", "cell", "left", "right"))
        every = load(part)
        every["id"], every["weight"] = (part[c].to_numpy() for c in ("id", "weight"))
        home = part["home"].combine_chunks().flatten().fill_null(0).to_numpy(zero_copy_only=False)
        every["home"] = home.reshape(part.num_rows, tables)
        every["filed"] = part["filed"].combine_chunks().flatten().fill_null(0).to_numpy(zero_copy_only=False).reshape(part.num_rows, tables, -1)
        if left == right:
            sides = [every, every]
        else:
            mine = part["mine"].to_numpy()
            sides = [{k: v[np.nonzero(mine == x)[0]] if isinstance(v, np.ndarray) else [v[k2] for k2 in np.nonzero(mine == x)[0]] for k, v in every.items()} for x in (left, right)]
        for ids, count, root in _judge(t, cell, *sides, left == right, linked):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(count, pa.int64()), pa.array(root, pa.int64())], names=["id", "n_links", "root"])

    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("t", "cell", "left", "right")]
        change = np.zeros(batch.num_rows, bool)
        for x in marks:
            change[1:] |= x[1:] != x[:-1]
        starts = [0, *np.nonzero(change)[0].tolist(), batch.num_rows]
        for lo, hi in zip(starts, starts[1:]):
            key = tuple(int(x[lo]) for x in marks)
            if key != now and held:
                yield from flush(held)
                held = []
            now = key
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield from flush(held)


def bucket_links(items: DataFrame, payload: list[str], tables: int, load: Callable, linked: Callable, block: int = 512, merge_equal: bool = False, fetch: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One row ``(id, n_links, root)`` per item and group where it has links; sum and unite them by id.

    ``items``: id long (unique), weight long, home array<long> (a cell of each table, never 0),
    filed array<long> (the cells of table 0, then of table 1, ..., equally many each, home first).
    ``fetch(DataFrame of ids)`` gives ``(id, *payload)`` for the ids that share any cell at all.
    ``load(table)`` turns a group's rows into arrays or lists; ``linked(a, b, i, j)`` judges pairs.
    ``merge_equal``: of several cells that hold exactly the same items, keep one (for home cells only).
    """
    filed = items.select("id", F.posexplode("filed").alias("at", "cell"), F.size("filed").alias("n_filed"))
    filed = filed.select("id", F.expr(f"cast(at div (n_filed div {tables}) as int)").alias("t"), "cell", (F.expr(f"at % (n_filed div {tables})") == 0).alias("own"))
    cells = filed.groupBy("t", "cell").agg(
        F.count("*").alias("n"), F.max(F.col("own").cast("int")).alias("lived_in"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y")
    ).where("n > 1 and lived_in = 1")
    if merge_equal:
        cells = cells.groupBy("n", "x", "y").agg(F.min(F.struct("t", "cell")).alias("k")).select(F.col("k.t").alias("t"), F.col("k.cell").alias("cell"), "n")
    members = stored(filed.join(cells.select("t", "cell", "n"), ["t", "cell"]).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("t", "cell", "n"))).alias("cells")))
    full = members.join(items.select("id", "weight", "home", "filed"), "id")
    if merge_equal:  # cells that were merged away are no meeting places
        kept = F.transform(F.sequence(F.lit(0), F.lit(tables - 1)), lambda t: F.coalesce(F.get(F.transform(F.filter("cells", lambda c: c["t"] == t), lambda c: c["cell"]), 0), F.lit(0)))
        full = full.withColumn("home", kept).withColumn("filed", kept)
    full = full.join(fetch(members.select("id")) if fetch else items.select("id", *payload), "id")
    dealt = full.withColumn("c", F.explode("cells")).select("id", "weight", "home", "filed", *payload, F.col("c.t").alias("t"), F.col("c.cell").alias("cell"), F.ceil(F.col("c.n") / block).cast("int").alias("blocks"))
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("id", F.lit(7)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("id", "weight", "home", "filed", *payload, "t", "cell", F.least("mine", "other").alias("left"), F.greatest("mine", "other").alias("right"), "mine")
    dealt = dealt.repartition("t", "cell", "left", "right").sortWithinPartitions("t", "cell", "left", "right")
    return dealt.mapInArrow(lambda batches: _grouped(batches, tables, load, linked), OUT)
