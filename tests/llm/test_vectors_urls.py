"""Operators on vectors and urls against brute force, and their defined results for odd rows."""

import math
import random

import numpy as np
import pytest

from arcweave.llm import additive, lattice, urls
from arcweave.llm.queries import RULES
from tests.llm.conftest import CLASH

ODD = [(900, None, 1), (901, [], 1), (902, [0.0] * 16, 1), (903, [1.0, None] + [0.0] * 14, 1), (904, [math.inf] + [0.0] * 15, 1), (905, [math.nan] + [1.0] * 15, 1), (None, [1.0] * 16, 1), (906, [1.0] * 4, 1)]


def cloud(rng, n, size=16):
    centres = rng.standard_normal((6, size))
    x = centres[rng.integers(0, 6, n)] + rng.standard_normal((n, size)) * rng.choice([0.03, 0.15, 0.9], n)[:, None]
    return x.astype(np.float32)


def test_lattice_decoder_finds_the_nearest_point():
    near = lattice.neighbours()
    assert len(near) == 240 and np.allclose((near**2).sum(1), 2)
    x = np.random.default_rng(0).standard_normal((2000, 8)) * 3
    home = lattice.nearest_e8(x)
    doubled = np.rint(home * 2).astype(int)
    assert np.allclose(home * 2, doubled) and ((doubled % 2 == doubled[:, :1] % 2).all()) and (np.rint(home.sum(1)).astype(int) % 2 == 0).all()
    best = ((x - home) ** 2).sum(1)
    assert all((best <= ((x - home - v) ** 2).sum(1) + 1e-9).all() for v in near)


def test_near_duplicates_against_brute_force(vectors):
    rng = np.random.default_rng(1)
    x = cloud(rng, 400)
    rows = [(k, v.tolist(), int(k % 3)) for k, v in enumerate(x)] + [(500 + k, x[0].tolist(), 0) for k in range(40)] + [(600, x[3].tolist(), None)]
    found = {r["id"]: r for r in lattice.near_duplicates(vectors(rows + ODD, **CLASH)).collect()}
    ids = [r[0] for r in rows if r[2] is not None]
    m = np.array([r[1] for r in rows if r[2] is not None], np.float32).astype(float)
    label = np.array([r[2] for r in rows if r[2] is not None])
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    link = (unit @ unit.T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(link, False)
    total, kept = link.sum(), sum(found[i]["n_links"] for i in ids)
    assert kept <= total and kept >= 0.99 * total
    assert all(found[i]["n_links"] <= n for i, n in zip(ids, link.sum(1)))
    root = {}
    for i in sorted(ids):
        todo = [i]
        while todo:
            y = todo.pop()
            if y not in root:
                root[y] = i
                todo += [ids[j] for j in np.flatnonzero(link[ids.index(y)])]
    if kept == total:
        assert {i: found[i]["component_id"] for i in ids} == root
    assert all(found[i]["kept"] == (found[i]["component_id"] == i) for i in ids)
    for i, *_ in [*ODD, (600,)]:
        assert found[i]["n_links"] == 0 and found[i]["component_id"] == i and found[i]["kept"]


def test_near_duplicates_in_several_blocks(vectors):
    rng = np.random.default_rng(2)
    base = rng.standard_normal(16)
    x = (base + rng.standard_normal((900, 16)) * 0.02).astype(np.float32)
    rows = lattice.near_duplicates(vectors([(k, v.tolist(), 1) for k, v in enumerate(x)])).collect()
    assert {(r["n_links"], r["component_id"]) for r in rows} == {(899, 0)}
    assert lattice.near_duplicates(vectors([])).count() == 0


def test_search_against_brute_force(vectors):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(3)
    x = cloud(rng, 800)
    rows = [(k, v.tolist(), 0) for k, v in enumerate(x)] + [(2000 + k, x[5].tolist(), 0) for k in range(30)]
    found = {}
    for r in additive.search(vectors(rows + ODD, **CLASH), F.col("vec_id") % 20 == 0).collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    ids = np.array([r[0] for r in rows])
    m = np.array([r[1] for r in rows], np.float32).astype(float)
    hits = 0
    for q in ids[ids % 20 == 0]:
        score = m @ m[np.flatnonzero(ids == q)[0]]
        own = found[q]
        assert sorted(own) == list(range(1, 21)) and all(v == pytest.approx(score[np.flatnonzero(ids == i)[0]], abs=1e-9) for i, v in own.values())
        listed = [own[k] for k in range(1, 21)]
        assert listed == sorted(listed, key=lambda p: (-p[1], p[0])) and q not in [p[0] for p in listed]
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:20]
        hits += len({ids[i] for i in order} & {p[0] for p in listed})
    assert hits >= 0.97 * 20 * len(ids[ids % 20 == 0])


def test_search_few_and_none(vectors):
    from pyspark.sql import functions as F

    few = additive.search(vectors([(0, [1.0, 0.0], 0), (1, [0.5, 0.5], 0), (2, [2.0, 0.0], None), (2, [2.0, 0.0], None)]), F.col("vec_id") == 0).collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in sorted(few, key=lambda r: r["rank"])] == [(1, 2, 2.0), (2, 1, 0.5)]
    assert additive.search(vectors([]), F.lit(True)).count() == 0
    assert additive.search(vectors(ODD[:7]), F.lit(True)).count() == 0


def test_search_of_several_lengths(vectors):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(5)
    x, y = rng.standard_normal((30, 2)).astype(np.float32), rng.standard_normal((20, 3)).astype(np.float32)
    rows = [(k, v.tolist(), 0) for k, v in enumerate(x)] + [(100 + k, v.tolist(), 0) for k, v in enumerate(y)]
    found = {}
    for r in additive.search(vectors(rows), F.col("vec_id") % 20 == 0).collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    for q in (0, 20, 100):
        own, at = (x, q) if q < 100 else (y, q - 100)
        score = own.astype(float) @ own[at].astype(float)
        want = [int(i) + q - at for i in np.lexsort((np.arange(len(own)), -score)) if i != at][:20]
        assert [found[q][k] for k in sorted(found[q])] == want
    assert sorted(found) == [0, 20, 100]


def test_sample_is_bounded_in_rows(vectors):
    rows = [(k % 3, [float(k % 50), 1.0], 0) for k in range(600)]
    own = vectors(rows).selectExpr("vec_id", "cast(embedding as array<double>) as vector")
    assert len(additive.sampled(own, 40)) <= 40


URLS = [
    (1, "https://a.example.net/en/1", "example.net/en/", "allow"), (2, "https://a.example.net/de/1", "net/", "block"), (3, "HTTP://A.Example.COM/de/x?y", "example.com/de/", "block"), (4, "x://notexample.com/de/", None, "allow"),
    (5, "https://q.org/fr/", "org/fr/", "allow"), (6, "https://b.net", None, "allow"), (7, None, None, "allow"), (8, "no scheme", None, "allow"), (9, "", None, "allow"), (10, "a://net/", "net/", "block"), (11, "a://b://c.net/x#y", None, "allow"),
]


def test_rules(spark):
    pages = spark.createDataFrame([(i, u, 1, "k") for i, u, *_ in URLS], "page_id long, url string, host_ int, key string")
    labels = spark.createDataFrame([], "page_id long, bad int")
    found = {r["page_id"]: r for r in urls.url_filter(pages, labels, RULES).collect()}
    for i, u, rule, verdict in URLS:
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = rest[:cut].lower(), rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
        r = found[i]
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict), u
    assert urls.url_filter(pages.where("false"), labels, RULES).count() == 0


def brute_templates(rows, z=2.58, least=16, variable=0.5, purity=0.5, smoothing=10.0):
    """Verdicts of (host, path, bad) rows by the same tree, grown with dictionaries."""
    import re
    from collections import defaultdict

    def segments(path):
        parts = re.sub("[0-9]+", "{n}", path).split("/")
        own = [parts[k] if k < len(parts) else None for k in range(1, urls.DEPTH + 1)]
        if len(parts) > urls.DEPTH + 1:
            own[-1] += "/**"
        return own

    known = [bad for *_, bad in rows if bad is not None]
    good = 1 - sum(known) / len(known) if known else 1.0
    items = [{"host": h, "s": segments(p), "t": [], "bad": b} for h, p, b in rows]
    for k in range(urls.DEPTH):
        nodes = defaultdict(lambda: defaultdict(lambda: [0, 0, 0]))
        for x in items:
            if x["s"][k] is not None:
                c = nodes[x["host"], tuple(x["t"])][x["s"][k]]
                c[0] += 1
                c[1] += x["bad"] is not None
                c[2] += x["bad"] or 0
        differ = lambda l1, b1, l2, b2: float(b1 * l2 - b2 * l1) ** 2 * (l1 + l2) > z * z * (b1 + b2) * float(l1 + l2 - b1 - b2) * l1 * l2
        names = {}
        for node, own in nodes.items():
            n, lab, bad = (sum(c[i] for c in own.values()) for i in range(3))
            if len(own) >= least and len(own) >= variable * n:
                continue
            apart = sorted((cb / cl, s, cl, cb) for s, (_, cl, cb) in own.items() if cl and differ(cl, cb, lab - cl, bad - cb))
            runs = []
            for share, s, cl, cb in apart:
                if runs and not differ(cl, cb, *runs[-1][-1][2:]):
                    runs[-1].append((share, s, cl, cb))
                else:
                    runs.append([(share, s, cl, cb)])
            names |= {(node, s): s if len(run) == 1 else min(r[1] for r in run) + "|*" for run in runs for _, s, *_ in run}
        for x in items:
            s = x["s"][k]
            x["t"].append(None if s is None else names.get(((x["host"], tuple(x["t"])), s), "*"))
    sums = defaultdict(lambda: [0, 0])
    for x in items:
        c = sums[x["host"], tuple(x["t"])]
        c[0] += x["bad"] is not None
        c[1] += x["bad"] or 0
    return ["block" if (sums[x["host"], tuple(x["t"])][0] - sums[x["host"], tuple(x["t"])][1] + smoothing * good) / (sums[x["host"], tuple(x["t"])][0] + smoothing) < purity else "allow" for x in items]


def test_templates_against_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for k in range(1500):
        section = rng.choice(["news", "shop", "spam", "u", ""])
        leaf = f"slug-{rng.choice('abcdefghijklmnopqrstuvwxyz')}{rng.choice('abcdefghij')}x" if section == "u" else rng.choice(["a", "b", "12", "77.html"])
        bad = None if rng.random() < 0.4 else int(rng.random() < (0.9 if section == "spam" else 0.6 if (section, leaf) == ("shop", "b") else 0.1))
        rows.append((rng.choice(["x.test", "y.test"]), "/" + "/".join([section, leaf, *["deep"] * rng.randint(0, 3)]), bad))
    pages = spark.createDataFrame([(k, f"http://{h}{p}") for k, (h, p, _) in enumerate(rows)], "page_id long, url string")
    labels = spark.createDataFrame([(k, b) for k, (*_, b) in enumerate(rows) if b is not None], "page_id long, bad int")
    found = {r["page_id"]: r["verdict"] for r in urls.url_filter(pages, labels, []).collect()}
    want = brute_templates(rows)
    assert [found[k] for k in range(len(rows))] == want and 100 < want.count("block") < 700


def test_alike_branches_are_merged(spark):
    # two bad sections too small to be refused alone, and one that is clean
    rows = [(f"/spam{'ab'[k % 2]}/x", int(k % 10 < 7)) for k in range(60)] + [("/news/x", 0)] * 150 + [("/shop/x", int(k % 3 == 0)) for k in range(60)]
    pages = spark.createDataFrame([("h.test", p, b) for p, b in rows], "host string, path string, bad int")
    found = {r["masked"]: r["t"] for r in urls.templates(pages).collect()}
    assert found["/spama/x"] == found["/spamb/x"] == ["spama|*", "*"] and found["/news/x"] == ["news", "*"] and found["/shop/x"] == ["*", "*"]


def test_bad_branches_below_the_third_level(spark):
    rows = []
    for depth in range(4, 9):
        # 60 clean and 40 bad pages a depth share everything but the segment at that depth
        top = "/".join(["", f"d{'abcdefghi'[depth]}", *["x"] * (depth - 2)])
        rows += [(f"{top}/news/{k}", 0) for k in range(60)] + [(f"{top}/spam/{k}", 1) for k in range(40)]
    rows += [("/" + "y/" * 40, 0), ("/" + "y/" * 40 + "z", 1)]
    pages = spark.createDataFrame([(k, f"http://h.test{p}") for k, (p, _) in enumerate(rows)], "page_id long, url string")
    labels = spark.createDataFrame([(k, b) for k, (_, b) in enumerate(rows)], "page_id long, bad int")
    found = {r["page_id"]: r["verdict"] for r in urls.url_filter(pages, labels, []).collect()}
    assert all(found[k] == ("block" if b else "allow") for k, (p, b) in enumerate(rows[:-2]))


def test_pairs_near_the_threshold_meet():
    rng = np.random.default_rng(7)
    a, b = rng.standard_normal((2, 20_000, 128))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    x, y = (lattice.file_under(v, np.zeros(len(v), np.int64)) for v in (a, b))
    met = ((x[:, :, :1] == y).any(2) | (y[:, :, :1] == x).any(2)).any(1)
    assert (~met).sum() <= 10
