"""Substring dedup over sliding runs of sentences.

A text is cut into sentences: after ``.``, ``!``, ``?`` and white space, after their full-width forms, or at a line end. Sentences of
up to ``longest`` words stay whole. Longer ones, as text without punctuation, are cut after words that a
hash picks, so that a word more or less upstream doesn't shift the cuts: as wholes they would
never repeat where a passage begins or ends within them. Every run of ``span`` consecutive sentences is hashed. Runs that occur
more than once are joined globally; all but the first occurrence (smallest id, then position) mark
the sentences that they cover, and all marked sentences are removed, however short. Callers who want
short stock phrases to stay can set ``least_words``: marked stretches of fewer words then stay.

Defined results: a null text stays null and counts as empty; texts of fewer than ``span`` sentences
are one run; rows that repeat an id count as one occurrence if they repeat the text as well, else each
counts by itself, in the order of a hash of their texts; rows whose id is null count each by itself and
come last.
Case and the white space within a sentence don't count. Other columns pass through ``dedup_texts``, but
columns of the input that are called n_sentences, n_removed or words_removed give way to its own.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, stored

_CUT = re.compile(r"(?<=[.!?])\s+|(?<=[\u3002\uff01\uff1f])\s*|\n\s*")  # linear, however long a run of white space is
_WORDS = re.compile(r"\S+\s*")
#: Most words of a piece of a sentence that is too long.
PIECE = 12


def sentences(text: str, longest: int = 20) -> list[str]:
    """The pieces of ``text``, each with the white space after it: joined they give the text again."""
    whole, at = [], 0
    for cut in _CUT.finditer(text):
        if text[at : cut.end()].strip():
            whole.append(text[at : cut.end()])
            at = cut.end()
    if at < len(text):
        whole.append(text[at:])
    out = []
    for sentence in whole:
        words = _WORDS.findall(sentence) if len(sentence.split()) > longest else ()
        if len(words) <= longest:
            out.append(sentence)
            continue
        piece, n = sentence[: len(sentence) - sum(map(len, words))], 0
        for word in words:
            piece, n = piece + word, n + 1
            if n == PIECE or zlib.crc32(word.strip().lower().encode("utf-8", "surrogatepass")) % 6 == 0:
                out.append(piece)
                piece, n = "", 0
        if piece:
            out.append(piece)
    return out


def run_hashes(pieces: list[str], span: int) -> list[int]:
    """Signed 64-bit hash of each run of ``span`` pieces (of the whole if there are fewer), by its start."""
    plain = [" ".join(x.lower().split()) for x in pieces]
    if not any(plain):
        return []
    return [xxhash.xxh3_64_intdigest("\n".join(plain[k : k + span]).encode("utf-8", "surrogatepass")) - 2**63 for k in range(max(1, len(plain) - span + 1))]


def _runs(span: int, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                hashes = [run_hashes(sentences(t.as_py() or "", longest), span) for t in part.column(1)]
                n = [len(x) for x in hashes]
                ids = np.repeat(np.arange(part.num_rows), n)
                again = []
                for own in hashes:
                    seen: set[int] = set()
                    again += [h in seen or bool(seen.add(h)) for h in own]
                own = [part.column(k).take(pa.array(ids)) for k in (0, 2)]
                columns = [pa.array([h for x in hashes for h in x], pa.int64()), *own, pa.array([k for m in n for k in range(m)], pa.int32()), pa.array(again, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, names=["run", "id", "row", "at", "again"])

    return run


def _removed(pieces: list[str], starts: list[int], span: int, least_words: int) -> np.ndarray:
    gone = np.zeros(len(pieces), bool)
    for k in starts:
        gone[k : k + span] = True
    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
    for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist()):
        if sum(len(x.split()) for x in pieces[lo:hi]) < least_words:
            gone[lo:hi] = False
    return gone


def with_row_keys(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``docs`` with ``__id`` and ``__row``, which tell rows apart and come out the same each time ``docs`` is read.

    ``__row`` is 0 for an id that occurs once, a hash of the text for one that occurs again, and a stored number where
    the id is null, as such rows can be equal. Only ids are counted, so tables without clashes pass through.
    """
    own = docs[id_column].cast("long")
    counted = stored(docs.select(own.alias("__clash")).groupBy("__clash").agg(F.count("*").alias("rows")).where("rows > 1 or __clash is null"))
    clashes, nulls = counted.where("__clash is not null").select("__clash"), counted.where("__clash is null")
    keyed = docs.withColumn("__id", own)
    out = keyed.where("__id is not null")
    if clashes.isEmpty():
        out = out.withColumn("__row", F.lit(0).cast("long"))
    else:
        out = out.join(clashes, F.col("__id") == F.col("__clash"), "left")
        out = out.withColumn("__row", F.when(F.col("__clash").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(text_column))).drop("__clash")
    if nulls.isEmpty():
        return out
    numbered = stored(keyed.where("__id is null").withColumn("__row", F.monotonically_increasing_id()))
    return out.unionByName(numbered.withColumn("__id", F.lit(2**63 - 1)))


def repeated_runs(docs: DataFrame, span: int = 3, longest: int = 20) -> DataFrame:
    """``docs(id long, text, row long)`` -> ``(id, row, starts array<int>)``: where non-first occurrences of repeated runs begin."""
    runs = stored(docs.mapInArrow(_runs(span, longest), "run long, id long, row long, at int, again boolean"))
    often = stored(runs.groupBy("run").agg(F.count("*").alias("n"), F.min(F.struct("id", "row")).alias("first")).where("n > 1"))
    # a run with more than a 2,000th of all occurrences is one of 2,000 at most: broadcast; the rest are joined by hash
    total = often.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = often.where(F.col("n") > total / 2000).select("run", F.col("first").alias("hot_first"))
    rest = often.where(F.col("n") <= total / 2000).select("run", "first")
    # outer joins: every run passes once, marked with the first place of its kind or not; the hot ones are dealt by their place
    known = runs.join(F.broadcast(hot), "run", "left")
    key = F.when(F.col("hot_first").isNull(), F.col("run")).otherwise(F.xxhash64("id", "row", "at"))
    rest = rest.withColumnRenamed("run", "of")
    later = known.withColumn("key", key).join(rest, (F.col("key") == F.col("of")) & F.col("hot_first").isNull(), "left")
    later = later.select("id", "row", "at", "again", F.coalesce("hot_first", "first").alias("first")).where("first is not null")
    return later.where("again or id <> first.id or row <> first.row").groupBy("id", "row").agg(F.sort_array(F.collect_set("at")).alias("starts"))


def dedup_texts(docs: DataFrame, span: int = 3, longest: int = 20, least_words: int = 0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with repeated sentences taken out of the text, and ``n_sentences``, ``n_removed``, ``words_removed``.

    A row that is nothing but repeats keeps its place with an empty text.
    """
    keyed = with_row_keys(small_batches(docs), id_column, text_column)
    starts = repeated_runs(keyed.select(F.col("__id").alias("id"), F.col(text_column).alias("text"), F.col("__row").alias("row")), span, longest)
    starts = starts.withColumnsRenamed({"id": "__of", "row": "__of_row", "starts": "__starts"})
    with_starts = keyed.join(starts, (F.col("__id") == F.col("__of")) & (F.col("__row") == F.col("__of_row")), "left")
    fields = [f for f in docs.schema.fields if f.name not in ("n_sentences", "n_removed", "words_removed")]
    schema = T.StructType([*fields, T.StructField("n_sentences", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("words_removed", T.LongType())])
    names = [f.name for f in fields]
    with_starts = with_starts.select(*[F.col(f"`{n}`") for n in names], "__starts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text_at = names.index(text_column)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts, counts = [], []
                for text, own in zip(part.column(text_at), part.column(len(names)).to_pylist()):
                    text = text.as_py()
                    pieces = sentences(text or "", longest)
                    gone = _removed(pieces, own or [], span, least_words)
                    if gone.any():
                        text = "".join(x for x, g in zip(pieces, gone.tolist()) if not g)
                    texts.append(text)
                    counts.append((len(pieces), int(gone.sum()), sum(len(x.split()) for x, g in zip(pieces, gone.tolist()) if g)))
                columns = [part.column(k) for k in range(len(names))]
                columns[text_at] = pa.array(texts, part.schema.field(text_at).type)
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array([c[k] for c in counts], pa.int64()) for k in range(3))], names=[*names, "n_sentences", "n_removed", "words_removed"])

    return with_starts.mapInArrow(cut, schema)
