"""Every rung of the resolver and the weights of its edges."""

import pytest

from arcweave.operators import resolve

SYMBOLS = "nid long, fqn string, file string"
REFS = "src long, file string, ref string"
IMPORTS = "file string, local string, module string"


def edges(spark, symbols, refs, imports=()):
    made = resolve.resolve_edges(spark.createDataFrame(refs, REFS), spark.createDataFrame(symbols, SYMBOLS), spark.createDataFrame(list(imports), IMPORTS))
    return {(r["src"], r["dst"]): (r["resolution"], pytest.approx(r["confidence"], abs=1e-6)) for r in made.collect()}


def test_exact_name(spark):
    found = edges(spark, [(1, "main", "a.py"), (2, "pkg.Utils.helper", "b.py"), (3, "x.pkg.Utils.helper", "c.py")], [(1, "a.py", "pkg.Utils.helper")])
    assert found == {(1, 2): ("exact", 1.0)}


def test_unknown_receiver(spark):
    found = edges(spark, [(1, "main", "a.py"), (2, "Repo.findOne", "b.py")], [(1, "a.py", ".findOne")])
    assert found == {(1, 2): ("unique_suffix", 0.44)}


def test_unknown_receiver_of_many_names_is_dropped(spark):
    assert edges(spark, [(1, "main", "a.py"), *[(k, f"C{k}.get", f"{k}.py") for k in (2, 3, 4)]], [(1, "a.py", ".get")]) == {}


def test_collision_without_evidence(spark):
    found = edges(spark, [(1, "main", "d/m.py"), (2, "A.process", "x/a.py"), (3, "B.process", "y/b.py")], [(1, "d/m.py", "process")])
    assert found == {(1, 2): ("ambiguous", 0.25), (1, 3): ("ambiguous", 0.25)}


def test_same_file_before_import_before_directory(spark):
    symbols = [(1, "f", "d/m.py"), (2, "A.go", "d/m.py"), (3, "B.go", "e/n.py"), (4, "C.go", "d/o.py")]
    imports = [("d/m.py", "go", "e.n")]
    assert edges(spark, symbols, [(1, "d/m.py", "go")], imports) == {(1, 2): ("same_file", 0.95)}
    assert edges(spark, [s for s in symbols if s[0] != 2], [(1, "d/m.py", "go")], imports) == {(1, 3): ("via_import", 0.95)}
    assert edges(spark, [s for s in symbols if s[0] != 2], [(1, "d/m.py", "go")]) == {(1, 4): ("same_dir", 0.55)}


def test_modules_match_by_whole_segments(spark):
    symbols = [(1, "f", "x/m.py"), (2, "A.v", "deep/l0/m1.py"), (3, "B.v", "deep/l0/m14.py")]
    assert edges(spark, symbols, [(1, "x/m.py", "v")], [("x/m.py", "v", "l0.m14")])[1, 3][0] == "via_import"


@pytest.mark.parametrize(("file", "imports", "weight"), [("y/m.py", [("y/m.py", "other", "o")], 0.3), ("y/m.py", [("y/m.py", "helper", "x.b")], 1.0), ("x/m.py", [("x/m.py", "other", "o")], 0.6)])
def test_import_validation(spark, file, imports, weight):
    found = edges(spark, [(1, "main", file), (2, "helper", "x/b.py")], [(1, file, "helper")], imports)
    assert found == {(1, 2): ("exact", weight)}


def test_double_colon_suffixes_and_self_edges(spark):
    found = edges(spark, [(1, "a::b::run", "a.rs"), (2, "c", "c.rs")], [(2, "c.rs", "b::run"), (1, "a.rs", "run")])
    assert found == {(2, 1): ("unique_suffix", 0.8)}


def test_partitioning_does_not_matter(spark):
    symbols = [(k, f"C{k}.m{k % 3}", f"d{k % 2}/f{k}.py") for k in range(1, 20)]
    refs = [(k, f"d{k % 2}/f{k}.py", f"m{(k + 1) % 3}") for k in range(1, 20)]
    want = edges(spark, symbols, refs)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert edges(spark, symbols[::-1], refs[::-1]).keys() == want.keys()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_receivers_can_be_normalised(spark):
    symbols = [(1, "f", "a.py"), (2, "K.run", "b.py"), (3, "P.new", "c.rs")]
    refs = spark.createDataFrame([(1, "a.py", "self.run"), (1, "a.py", "P::new")], REFS)
    plain = resolve.resolve_edges(refs, spark.createDataFrame(symbols, SYMBOLS), spark.createDataFrame([], IMPORTS))
    assert plain.count() == 0
    rewritten = [tuple(r) for r in resolve.normalize_receiver(refs).collect()]
    assert edges(spark, symbols, rewritten) == {(1, 2): ("unique_suffix", 0.44), (1, 3): ("exact", 1.0)}
