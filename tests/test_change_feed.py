"""Git change sets, relations by line, reports, and incremental upkeep that equals a full build."""

import subprocess

from arcweave.operators.relations import enclosing, relation_edges
from arcweave.plans import report
from arcweave.sources import git
from arcweave.streaming import incremental


def repo(root, *commands):
    for c in commands:
        subprocess.run(c, cwd=root, shell=True, check=True, capture_output=True)


def changed(spark, root, base=None):
    return [r["changed"] for r in git.changed_files(spark, str(root), base).collect()]


def test_git_changes(spark, tmp_path):
    body = "\n".join(f"x{k} = {k}" for k in range(30)) + "\n"
    for name in ("a.py", "b.py", "old.py", "gone.py", "dist/app.min.js"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(body)
    repo(tmp_path, "git init -q", "git config user.email a@b.c", "git config user.name n", "git add .", "git commit -qm one")
    (tmp_path / "a.py").write_text(body.replace("x1 =", "x1  ="))
    (tmp_path / "b.py").write_text(body + "y = 1\n")
    (tmp_path / "dist/app.min.js").write_text(body + "z\n")
    repo(tmp_path, "git mv old.py new.py", "git rm -q gone.py")
    (tmp_path / "new.py").write_text(body + "w = 2\n")
    (tmp_path / "fresh.py").write_text("q = 1\n")
    repo(tmp_path, "git add new.py")
    assert changed(spark, tmp_path) == ["b.py", "fresh.py", "new.py"]
    repo(tmp_path, "git add .", "git commit -qm two")
    assert changed(spark, tmp_path) == []
    assert changed(spark, tmp_path, "HEAD~1..HEAD") == ["b.py", "fresh.py", "new.py"]


def test_numstat_paths(spark):
    rows = git.numstat(spark.createDataFrame([("1\t2\tsrc/{a => b}/x.py",), ("-\t-\timg.png",), ("3\t0\told.py => new.py",), ("bad",)], "line string")).collect()
    assert {(r["changed"], r["added"], r["deleted"]) for r in rows} == {("src/b/x.py", 1, 2), ("img.png", 0, 0), ("new.py", 3, 0)}


def test_diff_ranges(spark):
    diff = ["--- a/x.py", "+++ b/x.py", "@@ -1,2 +3,4 @@", "+@@ not one", "@@ -9 +12,0 @@", "--- a/y.py", "+++ /dev/null", "@@ -1 +0,0 @@", "@@ broken"]
    assert {tuple(r) for r in git.hunks(spark, diff).collect()} == {("x.py", 3, 6), ("x.py", 12, 12)}


def test_enclosing_symbol_is_the_smallest(spark):
    symbols = spark.createDataFrame([(1, "a.py", "C", 1, 300), (2, "a.py", "m", 10, 200), (3, "a.py", "n", 70, 75), (4, "b.py", "f", 1, 2)], "nid long, file string, name string, line_start int, line_end int")
    places = spark.createDataFrame([("a.py", 72, "x.f", "calls"), ("a.py", 150, "n", "calls"), ("a.py", 250, "zzz", "calls"), ("b.py", 9, "m", "calls")], "file string, line int, to_name string, kind string")
    assert {(r["file"], r["line"]): r["nid"] for r in enclosing(places, symbols).collect()} == {("a.py", 72): 3, ("a.py", 150): 2, ("a.py", 250): 1, ("b.py", 9): None}
    assert {(r["src"], r["dst"]) for r in relation_edges(places, symbols).collect()} == {(3, 4), (2, 3)}


def test_reports(spark):
    nodes = spark.createDataFrame([(1, 'a"x'), (2, "b|y")], "nid long, name string")
    edges = spark.createDataFrame([(1, 2)], "src long, dst long")
    assert report.mermaid(nodes, edges) == 'graph LR\n  n1["a\'x"] --> n2["b|y"]'
    assert report.markdown(nodes.orderBy("nid"), "T").splitlines()[-1] == "| 2 | b\\|y |"
    rows = spark.createDataFrame([(1, 'say "hi", you', [1, 2]), (2, None, [])], "k long, t string, trace array<long>")
    assert sorted(r["value"] for r in report.csv_lines(rows).collect()) == ['1,"say ""hi"", you",1>2', "2,,"]


FILES = {"p/a.py": "from p.b import helper\ndef main():\n    helper()\n    other()\n", "p/b.py": "def helper():\n    pass\n", "q/c.py": "def other():\n    main()\n", "q/d.py": "class K:\n    def run(self):\n        other()\n"}


def state(spark, path):
    from arcweave.sources import store

    names = {r["nid"]: (r["file"], r["qualified_name"]) for r in store.load(spark, f"{path}/nodes").collect()}
    return {(names[r["src"]], names[r["dst"]], r["resolution"], round(r["confidence"], 4)) for r in incremental.edges(spark, path).collect()}, set(names.values())


def table(spark, files):
    return spark.createDataFrame([(f, bytearray(c.encode())) for f, c in files.items()], "file string, content binary")


def test_incremental_equals_batch(spark, tmp_path):
    from pyspark.sql import functions as F

    incremental.build(spark, table(spark, FILES), str(tmp_path / "inc"))
    edits = [("p/b.py", 1, "modify", "def helper():\n    other()\ndef more():\n    pass\n"), ("q/d.py", 2, "remove", None), ("q/e.py", 3, "create", "def late():\n    more()\n"), ("p/b.py", 5, "modify", "def helper():\n    late()\n"), ("q/c.py", 4, "modify", FILES["q/c.py"])]
    feed = spark.createDataFrame([(f, t, op, None if c is None else bytearray(c.encode())) for f, t, op, c in edits], "file string, ts long, op string, content binary")
    feed.repartition(1).write.parquet(str(tmp_path / "feed"))
    stream = spark.readStream.schema(feed.schema).parquet(str(tmp_path / "feed"))
    query = incremental.follow(stream.where(F.lit(True)), str(tmp_path / "inc"), str(tmp_path / "mark"))
    query.processAllAvailable()
    query.stop()
    now = {f: c for f, c in FILES.items() if f != "q/d.py"} | {"p/b.py": "def helper():\n    late()\n", "q/e.py": "def late():\n    more()\n"}
    incremental.build(spark, table(spark, now), str(tmp_path / "full"))
    assert state(spark, str(tmp_path / "inc")) == state(spark, str(tmp_path / "full"))


def test_polls_equal_a_full_build(spark, tmp_path):
    tree, kept = tmp_path / "tree", str(tmp_path / "kept")
    tree.mkdir()
    for name, code in {"a.py": "def main():\n    helper()\n", "b.py": "def helper():\n    pass\n", "c.py": "def other():\n    helper()\n"}.items():
        (tree / name).write_text(code)
    assert {r["op"] for r in incremental.sync(spark, str(tree), kept).collect()} == {"modify"}
    now = incremental.edges(spark, kept)
    before = spark.createDataFrame(now.collect(), now.schema)
    scores = incremental.centrality(spark, kept)
    assert scores.count() == 3 and before.count() == 2
    assert incremental.sync(spark, str(tree), kept).count() == 0
    (tree / "c.py").unlink()
    (tree / "d.py").write_text("def more():\n    helper()\n    main()\n")
    assert {(r["file"], r["op"]) for r in incremental.sync(spark, str(tree), kept).collect()} == {("c.py", "remove"), ("d.py", "modify")}
    incremental.build(spark, spark.createDataFrame([(p.name, bytearray(p.read_bytes())) for p in tree.glob("*.py")], "file string, content binary"), str(tmp_path / "full"))
    rows = lambda p: sorted(map(tuple, incremental.edges(spark, p).collect()))
    assert rows(kept) == rows(str(tmp_path / "full"))
    delta = incremental.edge_changes(before, incremental.edges(spark, kept)).collect()
    assert sorted((r["ref"], r["op"]) for r in delta) == [("helper", "added"), ("helper", "removed"), ("main", "added")]
    again = {r["nid"]: r["raw"] for r in incremental.centrality(spark, kept).collect()}
    incremental.centrality(spark, str(tmp_path / "full"))
    assert len(again) == 3


def test_watching_a_tree(spark, tmp_path):
    import time

    (tmp_path / "tree").mkdir()
    (tmp_path / "tree/a.py").write_text("def f():\n    g()\n")
    query = incremental.watch(spark, str(tmp_path / "tree"), str(tmp_path / "kept"), str(tmp_path / "ck"), "1 second")
    try:
        from arcweave.sources import store

        until = time.time() + 90
        (tmp_path / "tree/b.py").write_text("def g():\n    pass\n")
        while time.time() < until:
            assert query.exception() is None
            if store.committed(spark, str(tmp_path / "kept/listing")) and incremental.edges(spark, str(tmp_path / "kept")).count() == 1:
                break
            time.sleep(1)
        else:
            raise AssertionError("the change never arrived")
    finally:
        query.stop()


def test_opening_prefers_what_is_kept(spark, tmp_path):
    from arcweave.api import CodeGraph

    (tmp_path / "tree").mkdir()
    (tmp_path / "tree/a.py").write_text("def main():\n    helper()\ndef helper():\n    pass\n")
    kept, snap = str(tmp_path / "kept"), str(tmp_path / "snap")
    made = CodeGraph.open(spark, str(tmp_path / "tree"))
    report.snapshot(made.nodes, made.edges, snap)
    assert spark.read.json(f"{snap}/stats").first()["nodes"] == 2
    (tmp_path / "tree/b.py").write_text("def third():\n    pass\n")
    assert CodeGraph.open(spark, str(tmp_path / "tree"), kept, snap).info().first()["nodes"] == 2
    assert CodeGraph.open(spark, str(tmp_path / "tree"), kept).info().first()["nodes"] == 3
    (tmp_path / "tree/b.py").unlink()
    again = CodeGraph.open(spark, str(tmp_path / "tree"), kept, snap)
    assert again.info().first()["nodes"] == 3 and again.centrality.count() == 3
    main = next(r for r in again.nodes.collect() if r["name"] == "main")
    row = again.node(main["nid"]).first()
    assert len(row["callees"]) == 1 and row["callers"] == []
    assert again.inspect(main["nid"]).first()["role"] == "entry_point"
    assert again.guard(spark.createDataFrame([("a.py",)], "changed string")).count() == 1


def test_looser_git_listing(spark, tmp_path):
    for name in ("a.py", "gone.py", "x/dist/app.js", "Cargo.lock"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x = 1\ny = 2\n")
    repo(tmp_path, "git init -q", "git config user.email a@b.c", "git config user.name n", "git add .", "git commit -qm one")
    for name in ("a.py", "x/dist/app.js", "Cargo.lock"):
        (tmp_path / name).write_text("x = 1\ny = 3\n")
    repo(tmp_path, "git rm -q gone.py")
    found = lambda *r: [x["changed"] for x in git.changed_files_between(spark, str(tmp_path), *r).collect()]
    assert found() == ["a.py", "gone.py"]
    repo(tmp_path, "git add .", "git commit -qm two")
    assert found() == [] and found("HEAD~1", "HEAD") == ["a.py", "gone.py"]
