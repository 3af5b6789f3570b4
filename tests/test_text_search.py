"""Text functions, predicates, search layers, diffs, parsers, the store and the debouncer."""

import pytest
from pyspark.sql import functions as F

from arcweave.functions import lexicon, predicates, similarity, text
from arcweave.operators import change, search
from arcweave.parse import parse_source
from arcweave.parse.lines import line_symbols, markdown_sections
from arcweave.sources import files, store
from arcweave.streaming.debounce import debounce


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("word", "tokens"), [("snake_case_name", ["snake", "case", "name"]), ("parseHTTPResponse", ["parse", "http", "response"]), ("PascalCase", ["pascal", "case"]), ("a_b", []), ("v2Update", ["v2", "update"]), ("", []), ("été_ÉTÉ", ["été", "ÉtÉ"])])
def test_tokenize(spark, word, tokens):
    assert one(spark, text.tokenize(F.lit(word))) == tokens


@pytest.mark.parametrize(("word", "stem"), [("handlers", "handl"), ("handling", "handl"), ("handler", "handl"), ("boxes", "box"), ("sing", "sing"), ("bed", "bed"), ("runs", "run")])
def test_stem_agrees_with_the_plain_one(spark, word, stem):
    assert one(spark, text.stem(F.lit(word))) == stem == search._plain_stem(word)


@pytest.mark.parametrize(("line", "want"), [("@@ -12,7 +12,9 @@", (12, 20)), ("@@ -1 +5 @@ def f", (5, 5)), ("@@ -3,2 +0,0 @@", (1, 1)), ("@@ bad @@", None), ("+ x", None)])
def test_hunks(spark, line, want):
    found = one(spark, text.hunk(F.lit(line)))
    assert (found and (found["start"], found["stop"])) == want


def test_module_paths(spark):
    for raw in ("deep.l0.m14", "deep/l0/m14", "./deep/l0/m14.py", "crate::deep::l0::m14"):
        assert one(spark, text.module_path(F.lit(raw))) == "deep.l0.m14"


@pytest.mark.parametrize(("raw", "want"), [("f", "f"), ("this.run", "run"), ("A.run", "A.run"), ("svc.find", ".find"), ("a?.b", ".b"), ("super.go", "go"), ("f()()", None)])
def test_callee(spark, raw, want):
    assert one(spark, text.callee(F.lit(raw))) == want


def test_paths_and_predicates(spark):
    assert one(spark, text.compress_path(F.lit("a/b/c/d/e.py"))) == "a/.../c/d/e.py"
    assert one(spark, text.compress_path(F.lit("a/b/c.py"))) == "a/b/c.py"
    assert one(spark, predicates.is_generated(F.lit("js/main.d094b1b69ba24b63.js"))) and not one(spark, predicates.is_generated(F.lit("a.b.js")))
    assert one(spark, predicates.is_test_segment(F.lit("tests\\a.py"))) and not one(spark, predicates.is_test_segment(F.lit("contest/a.py")))
    assert one(spark, predicates.is_test_audit(F.lit("contest/a.py")))
    assert one(spark, predicates.is_entry_point(F.lit("get_user"), F.lit("function"), F.lit("api/x.py"))) and not one(spark, predicates.is_entry_point(F.lit("get_user"), F.lit("function"), F.lit("lib/x.py")))


def test_lexicon_is_whole():
    by = lexicon.clusters()
    assert len(by) == 19 and all(words[0] == concept and len(words) == len(set(words)) for concept, words in by.items())
    sizes = "auth 28 crypto 19 secret 10 payment 18 database 19 network 20 validate 12 user 16 file 12 log 12 cache 9 queue 14 error 11 test 10 parse 13 create 10 delete 8 get 9 set 8".split()
    assert {concept: len(words) for concept, words in by.items()} == {c: int(n) for c, n in zip(sizes[::2], sizes[1::2])} and sum(map(len, by.values())) == 258
    assert lexicon.related("redis", "cache") and lexicon.related("get", "lookup") and lexicon.concepts_for("query") == ["database", "get"]


def test_lexicon():
    assert lexicon.related("login", "password") and not lexicon.related("login", "cache")
    assert lexicon.expand("zebra") == {"zebra"}
    assert lexicon.expand("gnu", lexicon.from_rows([("animal", "gnu"), ("animal", "lion")])) == {"gnu", "lion"}


def test_signatures_and_similarity():
    assert similarity.short_signature("def f(a: Map<int, str>, b=(1, 2))") == "f(a, b)"
    assert similarity.jaro_winkler("autth", "auth") == pytest.approx(0.9533, abs=1e-4)


NODE = "nid long, id string, name string, qualified_name string, kind string, file string, line_start int, line_end int, signature string, docstring string"


def test_search_layers(spark):
    names = ["validate_user", "validate_email", "send_email", "get_user_profile", "getAuthenticated"]
    nodes = spark.createDataFrame([(k, str(k), n, n, "function", "src/a.py", 1, 2, None, "Sends a billing reminder." if k == 2 else None) for k, n in enumerate(names)], NODE)
    ranked = lambda q: {r["nid"]: r["match"] for r in search.search_ranked(nodes, q).collect()}
    assert ranked("validate_user") == {0: "exact", 1: "some_tokens", 3: "some_tokens"}
    assert ranked("user_validate")[0] == "all_tokens"
    assert ranked("login") == {4: "concept"}
    assert ranked("billing") == {2: "documentation"}
    assert ranked("  ") == {}
    assert {r["nid"] for r in search.search_literal(nodes, "EMAIL|profile").collect()} == {1, 2, 3}
    assert {r["nid"] for r in search.search_literal(nodes, "g").collect()} == {3, 4}


def test_ranges(spark):
    symbols = spark.createDataFrame([(1, "a.py", 1, 10), (2, "a.py", 20, 30), (3, "a.py", 40, 50), (4, "b.py", 0, 0)], "nid long, file string, line_start int, line_end int")
    ranges = spark.createDataFrame([("a.py", 10, 20), ("b.py", 7, 7), ("c.py", 1, 1)], "file string, start int, stop int")
    assert {r["nid"] for r in change.changed_ranges(symbols, ranges).collect()} == {1, 2, 4}
    assert [r["file"] for r in change.files_without_hits(symbols, ranges).collect()] == ["c.py"]


def test_changed_files_match_whole_parts(spark):
    nodes = spark.createDataFrame([(1, "/w/src/a.py"), (2, "/w/src/ba.py"), (3, "src\\a.py")], "nid long, file string")
    assert {r["nid"] for r in change.changed_files(nodes, spark.createDataFrame([("src/a.py",)], "changed string")).collect()} == {1, 3}


def kinds(file, code):
    return {(r["kind"], r["qualified_name"]): r["references"] for r in parse_source(file, code)}


def test_python_parser():
    code = "from a import b as c\nLIMIT = 3\nclass K:\n    x = 1\n    async def run(self):\n        self.go(); c()\ndef f():\n    def g():\n        h()\n    g()\n"
    assert kinds("m.py", code) == {("import", "a"): ["c"], ("constant", "LIMIT"): [], ("class", "K"): [], ("method", "K.run"): ["c", "self.go"], ("function", "f"): ["g", "h"], ("function", "g"): ["h"]}
    assert parse_source("pkg/__init__.py", "") == [] and parse_source("m.py", "")[0]["kind"] == "error"
    assert {k for k, _ in kinds("bad.py", "def (:\nclass Z\n")} == {"error", "class"}


@pytest.mark.parametrize(("file", "code", "want"), [
    ("a.ts", "import {x as y} from './m';\nexport class A { run(a) { this.go(); b.c(); } }\nconst g = (a) => { y(a) }\n", {("import", "./m"): ["y"], ("class", "A"): [], ("method", "A.run"): [".c", "go"], ("function", "g"): ["y"]}),
    ("b.rs", "use std::io;\nimpl P { pub fn new() -> P { helper(1) } }\nfn main() { P::new(); }\n", {("import", "std::io"): [], ("method", "P.new"): ["helper"], ("function", "main"): ["P::new"]}),
    ("c.go", "package m\nfunc (t *T) Do() { fmt.Println(1) }\nfunc main() { run() }\n", {("module", "m"): [], ("method", "T.Do"): ["fmt.Println"], ("function", "main"): ["run"]}),
    ("D.java", "import a.C;\npublic class D { public D(int x) { q(); } int m(int a) { helper(); c.run(); return 1; } }\n", {("import", "a.C"): [], ("class", "D"): [], ("constructor", "D.D"): [], ("method", "D.m"): ["c.run", "helper"]}),
    ("e.c", "#include <x.h>\nint add(int a, int b);\n", {("import", "x.h"): [], ("function", "add"): []}),
    ("f.cpp", "void n::K::z() { h(); o.p(); }\n", {("method", "n::K::z"): ["h"]}),
    ("h.cs", "using S;\nnamespace N { public class Q { public void M() { R(); } } }\n", {("import", "S"): [], ("module", "N"): [], ("class", "Q"): [], ("method", "Q.M"): ["R"]}),
    ("i.dart", "class W { void b() { this.c(); x.y(); d(); } }\n", {("class", "W"): [], ("method", "W.b"): ["c", "d"]}),
    ("j.rb", "# class No\nclass Foo\n  def bar\n", {("class", "Foo"): [], ("function", "bar"): []}),
    ("k.kt", "data class P(val x: Int)\nfun go() = 1\n", {("class", "P"): [], ("function", "go"): []}),
])
def test_brace_and_line_parsers(file, code, want):
    assert kinds(file, code) == want


@pytest.mark.parametrize(("file", "code", "want"), [
    ("a.ts", "export type Id = string | number;\ntype Pair<A> = [A, A]\nconst x = 1;\n", {("type_alias", "Id"), ("type_alias", "Pair")}),
    ("b.rs", "pub const MAX: u32 = 3;\nstatic mut N: i32 = 0;\npub type R = Vec<u8>;\nfn f() { const IN: u8 = 1; }\n", {("constant", "MAX"), ("constant", "N"), ("type_alias", "R"), ("function", "f")}),
    ("c.go", "package m\nconst A = 1\nvar b int\nconst (\n\tC = iota\n\tD\n)\ntype Ids []int\ntype S struct { x int }\nfunc f() {\n\tvar z int\n}\n", {("module", "m"), ("constant", "A"), ("variable", "b"), ("constant", "C"), ("constant", "D"), ("type_alias", "Ids"), ("struct", "S"), ("function", "f")}),
    ("D.java", "package a.b;\nclass D {\n  private final int x = f(1), y;\n  static Map<String, Integer> m;\n  void g() { int local = 1; }\n}\n", {("module", "a.b"), ("class", "D"), ("field", "D.x"), ("field", "D.y"), ("field", "D.m"), ("method", "D.g")}),
    ("e.c", "typedef unsigned long size;\ntypedef struct { int x; } Point;\ntypedef int (*cb)(int);\n", {("type_alias", "size"), ("type_alias", "Point"), ("type_alias", "cb")}),
    ("f.cpp", "using std::string;\nclass K {\npublic:\n  int n;\n  void z() { int q; }\n};\ntemplate <typename T> class B { T v; };\n", {("import", "std::string"), ("class", "K"), ("field", "K::n"), ("method", "K::z"), ("class", "B"), ("field", "B::v")}),
    ("h.cs", "namespace N;\nclass Q {\n  public int X { get; set; }\n  private readonly string name;\n  void M() { int l = 1; }\n}\n", {("module", "N"), ("class", "Q"), ("field", "Q.X"), ("field", "Q.name"), ("method", "Q.M")}),
    ("i.dart", "library app;\nfinal int top = 1;\nclass W { void b() { var x = 1; } }\n", {("module", "app"), ("variable", "top"), ("class", "W"), ("method", "W.b")}),
])
def test_declarations_without_blocks(file, code, want):
    assert set(kinds(file, code)) == want


def test_registered_parsers_reach_the_workers(spark):
    from arcweave import parse

    parse.register("own", lambda file, text: [{"name": line, "qualified_name": line, "kind": "section", "file": file, "line_start": k} for k, line in enumerate(text.split(), 1)])
    try:
        df = spark.createDataFrame([("x.own", bytearray(b"one two")), ("y.py", bytearray(b"def f(): pass"))], "file string, content binary")
        assert {(r["file"], r["name"]) for r in files.parse_files(df).collect()} == {("x.own", "one"), ("x.own", "two"), ("y.py", "f")}
    finally:
        del parse.EXTENSIONS["own"]


def test_ignore_files_of_the_tree(spark, tmp_path):
    for name, text in {".gitignore": "*.gen.py\n# no\n", ".ignore": "private/\n", ".arcweave/config.json": '{"ignore": ["old_*"]}', "a.py": "x = 1", "b.gen.py": "x = 1", "private/c.py": "x = 1", "old_d.py": "x = 1", "out/e.py": "x = 1"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    assert files.ignore_patterns(spark, str(tmp_path)) == ["*.gen.py", "# no", "private/", "old_*"]
    assert [r["file"] for r in files.scan_files(spark, str(tmp_path)).collect()] == ["a.py"]
    (tmp_path / ".arcweave/config.json").write_text("not json")
    assert {r["file"] for r in files.scan_files(spark, str(tmp_path)).collect()} == {"a.py", "old_d.py"}


def test_line_rules_as_columns(spark):
    docs = spark.createDataFrame([(1, "# Head One\ntext\n## 2 Next\nclass Foo\n// class No\nfunc bar()")], "doc_id long, text string")
    assert [(r["line"], r["level"], r["name"]) for r in markdown_sections(docs, F.col("text")).collect()] == [(1, 1, "Head"), (3, 2, "Next")]
    assert [(r["line"], r["kind"], r["name"]) for r in line_symbols(docs, F.col("text")).collect()] == [(4, "class", "Foo"), (6, "function", "bar")]


def test_source_tree_end_to_end(spark, tmp_path):
    from arcweave.api import CodeGraph

    for name, code in {"pkg/a.py": "from pkg.b import helper\ndef main():\n    helper()\n", "pkg/b.py": "def helper():\n    pass\n", "node_modules/x.py": "def no(): pass\n", ".hidden/y.py": "def no(): pass\n", "gen/z.py": "def no(): pass\n", "pkg/c.txt": "no"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(code)
    found = CodeGraph.of_source(spark, str(tmp_path), ["gen/", "!keep"])
    assert {r["qualified_name"] for r in found.nodes.collect()} == {"main", "helper"}
    assert [(r["resolution"], r["confidence"]) for r in found.edges.collect()] == [("exact", 1.0)]
    found.save(str(tmp_path / "kept"))
    assert CodeGraph.load(spark, str(tmp_path / "kept")).info().first()["nodes"] == 2


def test_incremental_store_equals_a_full_one(spark, tmp_path):
    rows = [(f"f{k}.py", f"n{k}") for k in range(30)]
    save = lambda r, p: store.save(spark.createDataFrame(r, "file string, name string"), str(tmp_path / p))
    save(rows, "x")
    fresh = [("f3.py", "new"), ("f99.py", "more")]
    store.update(spark, str(tmp_path / "x"), spark.createDataFrame(fresh, "file string, name string"), spark.createDataFrame([("f7.py",), ("f8.py",)], "file string"))
    want = sorted([r for r in rows if r[0] not in ("f3.py", "f7.py", "f8.py")] + fresh)
    assert sorted(map(tuple, store.load(spark, str(tmp_path / "x")).select("file", "name").collect())) == want
    assert store.files(spark, str(tmp_path / "x")).count() == len(want)
    listing = spark.createDataFrame([("a", 1), ("b", 3)], "file string, mtime long")
    changed, gone = store.stale(listing, spark.createDataFrame([("b", 2), ("c", 1)], "file string, mtime long"))
    assert [store.newer_than(listing, t).first()["newer"] for t in (2, 3)] == [True, False]
    assert {r["file"] for r in changed.collect()} == {"a", "b"} and [r["file"] for r in gone.collect()] == ["c"]


def test_empty_and_cleared_tables_keep_their_columns(spark, tmp_path):
    store.save(spark.createDataFrame([], "file string, x int"), str(tmp_path / "e"))
    assert store.load(spark, str(tmp_path / "e")).columns == ["file", "x"] and store.load(spark, str(tmp_path / "e")).count() == 0
    store.update(spark, str(tmp_path / "e"), spark.createDataFrame([("a.py", 1)], "file string, x int"), spark.createDataFrame([], "file string"))
    assert [tuple(r) for r in store.load(spark, str(tmp_path / "e")).collect()] == [("a.py", 1)]
    store.clear(spark, str(tmp_path / "e"))
    assert store.load(spark, str(tmp_path / "e")).count() == 0
    assert store.committed(spark, str(tmp_path / "none")) is None


def test_rows_of_another_version_are_none(spark, tmp_path, monkeypatch):
    store.save(spark.createDataFrame([("a.py", 1)], "file string, x int"), str(tmp_path / "v"))
    monkeypatch.setattr(store, "VERSION", "2")
    assert store.load(spark, str(tmp_path / "v")).count() == 0


def test_debounce_in_batch_and_as_a_stream(spark, tmp_path):
    rows = [("a", 0.00, "create"), ("a", 0.10, "modify"), ("a", 0.50, "remove"), ("b", 0.05, "modify")]
    changes = spark.createDataFrame(rows, "path string, s double, op string").select("path", F.timestamp_seconds("s").alias("ts"), "op")
    want = {("a", 2, "modify"), ("a", 1, "remove"), ("b", 1, "modify")}
    assert {(r["path"], r["n"], r["op"]) for r in debounce(changes).collect()} == want
    changes.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(changes.schema).parquet(str(tmp_path / "in"))
    query = debounce(stream, late="1 second").writeStream.outputMode("complete").format("memory").queryName("quiet").start()
    query.processAllAvailable()
    query.stop()
    assert {(r["path"], r["n"], r["op"]) for r in spark.table("quiet").collect()} == want


def test_ignore_rules(spark):
    paths = ["a/b.log", "keep.log", "build/x.py", "src/tmp/y.py", "tmp/z.py", "src/ok.py", ".git/x"]
    df = spark.createDataFrame([(p,) for p in paths], "p string").where(~files.ignored(F.col("p"), ["*.log", "!keep.log", "/tmp"]))
    assert {r["p"] for r in df.collect()} == {"keep.log", "src/tmp/y.py", "src/ok.py"}
