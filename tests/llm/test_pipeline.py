"""The pipeline's stages on a small corpus with planted cases, and the registered queries."""

import random

import duckdb
import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from arcweave.llm import queries, spans
from tests.llm.test_texts import brute_links, classes, near, prose

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    from tests.llm.conftest import DOCS

    rng = random.Random(11)
    passage = ". ".join(prose(rng, 9) for _ in range(8)) + "."
    base = [". ".join(prose(rng, rng.randint(4, 12)) for _ in range(9)) + "." for _ in range(60)]
    texts = [t if k % 10 else t + " " + passage for k, t in enumerate(base)]
    texts += [near(rng, texts[k], 1) for k in range(1, 9)] + [texts[3]] * 5 + [t + f" zgromp{c} and zgromp{c}" for t, c in zip(base[20:40], "abcd" * 5)] + ["", None]
    path = tmp_path_factory.mktemp("corpus")
    rows = [(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    toxic = [(k, 1, int("zgromp" in (t or ""))) for k, t in enumerate(texts)]
    spark.createDataFrame(toxic, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), dict(enumerate(texts))


def test_stages_one_after_the_other(spark, folder):
    from tokenizers import Tokenizer

    path, texts = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    names, steps = zip(*corpus_pipeline.STAGES)
    assert names == ("toxicity", "near_duplicates", "substring_dedup", "packing")
    clean = steps[0](spark, docs, path)
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == {k for k, t in texts.items() if "zgromp" not in (t or "")}
    kept = steps[1](spark, clean, path)
    left = [(r["doc_id"], r["text"]) for r in clean.collect()]
    group = classes(brute_links(left))
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted({group[i] for i, _ in left})
    cut = steps[2](spark, kept, path)
    own = sorted((r["doc_id"], r["text"] or "") for r in kept.collect())
    from tests.llm.test_texts import brute_spans

    want = brute_spans(own)
    assert cut.columns == docs.columns and {r["doc_id"]: r["text"] or "" for r in cut.collect()} == want
    assert all(r["n_chars"] == len(r["text"] or "") for r in cut.collect())
    packed = steps[3](spark, cut, path).collect()
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    length = {i: len(coder.encode(t, add_special_tokens=False).ids) + 1 for i, t in want.items()}
    assert {i: sum(r["length"] for r in packed if r["doc_id"] == i) for i in want} == length
    assert len({r["sequence_id"] for r in packed}) <= np.ceil(sum(length.values()) / 2048) + 1
    whole = corpus_pipeline.run(spark, path).select("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted(map(tuple, whole.collect())) == sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed)


def test_odd_tables_from_end_to_end(spark, tmp_path):
    from pyspark.sql import functions as F

    from tests.llm.conftest import CLASH, DOCS
    from tests.llm.test_texts import odd

    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    rows = [*odd(), (7, "y" * 400_000), (8, " " * 300_000), (9, prose(random.Random(3), 20))]
    for name, own in (("empty", []), ("odd", rows)):
        docs = spark.createDataFrame([(i, t, None, "s", len(t or "")) for i, t in own], DOCS)
        docs = docs.withColumns({k: F.lit(v) for k, v in CLASH.items()} | {"n_removed": F.lit(5), "words_removed": F.lit("w"), "sequence_id": F.lit(1), "offset": F.lit(2)})
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
    kept = spark.read.parquet(f"{tmp_path}/odd/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, f"{tmp_path}/odd")
        assert out.columns == kept.columns and out.schema["n_removed"].dataType == kept.schema["n_removed"].dataType
        assert {r["n_removed"] for r in out.select("n_removed").distinct().collect()} <= {5}
    found = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert {r["doc_id"] for r in found} <= {i for i, _ in rows} and {1, 2, 3, 5, 6, 7, 8, 9} <= {r["doc_id"] for r in found}


def test_repeated_rows_leave_one(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").where("doc_id < 6")
    kept = corpus_pipeline.near_duplicates(spark, docs.union(docs.where("doc_id in (2, 4)")), path)
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 2, 3, 4, 5]
    assert corpus_pipeline.near_duplicates(spark, docs.where("false"), path).count() == 0


def test_clashing_ids_are_judged_by_row(spark):
    from tests.llm.conftest import DOCS

    rng = random.Random(12)
    a, b, c, d = (prose(rng, 60) for _ in range(4))
    rows = [(1, a), (2, b), (2, c), (2, c), (3, b), (4, a), (4, d), (5, ""), (5, " "), (5, None), (None, a), (None, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
    kept = [(r["doc_id"], (r["text"] or "").strip()) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert sorted(kept, key=repr) == sorted([(1, a), (2, b), (2, c), (4, d), (5, ""), (None, a), (None, a)], key=repr)


def test_registered_queries(spark):
    found = queries.queries()
    assert sorted(int(name[2:].split("_")[0]) for name in found) == list(range(1, 11))
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    plain = lambda rows: sorted(rows, key=repr)
    mine = found["op1_url_filter"](spark, DATA).select("page_id", "host", "path", "rule", "verdict").collect()
    assert plain(map(tuple, mine)) == plain(con.execute(queries.oracle_sql()["op1_url_filter"]).fetchall())


def test_spans_module_is_whole():
    assert "".join(spans.sentences("A b c. D e f!\n\nG h")) == "A b c. D e f!\n\nG h"
