"""A corpus pipeline: toxicity, near duplicates, repeated passages, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept; all but the
last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.llm.common import stored, table
from arcweave.llm.jaccard import jaccard_join
from arcweave.llm.packing import pack
from arcweave.llm.spans import dedup_texts
from arcweave.llm.toxicity import drop_toxic, fit, toxic_labels


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.7 or more go; it learns from at most 8,000 labelled ones of ``docs``, picked by a hash of their ids."""
    model = fit(toxic_labels(docs, table(spark, sf_dir, "labels")))
    return drop_toxic(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked at a similarity of 0.8 or more the document with the smallest id stays.

    Rows that share an id are documents of their own, equal or near ones as any others; blank ones leave one row an id.
    Rows whose id is null stay.
    """
    if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        gone = stored(jaccard_join(docs).where("id <> class_id").select(F.col("id").alias("doc_id")))
        return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    # numbers in the order of the ids tell the rows apart
    order = F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id())
    keyed = stored(docs.orderBy("doc_id", F.xxhash64("text")).withColumn("__key", order))
    gone = stored(jaccard_join(keyed, id_column="__key").where("id <> class_id").select(F.col("id").alias("__key")))
    kept = keyed.join(gone, "__key", "left_anti").select(docs.columns)
    blank = F.col("doc_id").isNotNull() & F.coalesce("text", F.lit("")).rlike(r"(?U)^[\s\x1c-\x1f]*$")
    return kept.where(~blank).union(kept.where(blank).dropDuplicates(["doc_id"]))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go from the texts; ``n_chars`` follows. Columns of any other name pass through."""
    own = {c: f"__own_{c}" for c in docs.columns if c in ("n_sentences", "n_removed", "words_removed")}
    cut = dedup_texts(docs.withColumnsRenamed(own))
    n_chars = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return cut.withColumn("n_chars", n_chars).drop("n_sentences", "n_removed", "words_removed").withColumnsRenamed({v: k for k, v in own.items()}).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, as pieces in sequences of at most 2,048 tokens: ``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("substring_dedup", substring_dedup), ("packing", packing)]

#: The classifier's training, the span hashes and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other on ``documents``; each one's result is a table in the shared folder that the next reads.

    An empty table gives no rows; null and empty texts stay (one of each id) and are packed as their end token; extra columns are carried to the last stage.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
