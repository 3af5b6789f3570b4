"""Operators on texts against brute force, and their defined results for odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from arcweave.llm import bpe, jaccard, katz, licenses, packing, spans, toxicity
from tests.llm.conftest import CLASH

WORDS = [f"w{k}" for k in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def odd(n=3):
    """Null, empty, blank, short, repeated and very long texts."""
    long = prose(random.Random(9), 30_000)
    return [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (4, "one two"), (5, long), (6, "x" * 50_000), (None, "a null id"), (None, "a null id")]


# substring dedup


def own_sentences(text, longest=20):
    """The rule for sentences, word by word: (words, text) of each."""
    out, held = [], []

    def close():
        if held:
            out.append(held[:])
            held.clear()

    for gap, word, after in re.findall(r"(^\s*)?(\S+)(\s*)", text):
        held.append(gap + word + after)
        if "\n" in after or (after and word[-1] in ".!?"):
            close()
    close()
    cut = []
    for words in out:
        if len(words) <= longest:
            cut.append("".join(words))
            continue
        piece = []
        for w in words:
            piece.append(w)
            if len(piece) == 12 or zlib.crc32(w.strip().lower().encode()) % 6 == 0:
                cut.append("".join(piece))
                piece = []
        cut += ["".join(piece)] * bool(piece)
    return cut


def brute_spans(docs, span=3):
    """Texts without what a non-first run of ``span`` sentences covers, with runs as they are instead of hashes."""
    seen, out = set(), {}
    for i, t in sorted(docs, key=lambda r: r[0]):
        pieces = own_sentences(t or "")
        plain = [tuple(p.lower().split()) for p in pieces]
        gone = set()
        for at in range(max(1, len(plain) - span + 1)):
            run = tuple(plain[at : at + span])
            if any(run):
                if run in seen:
                    gone.update(range(at, min(at + span, len(plain))))
                seen.add(run)
        out[i] = "".join(p for k, p in enumerate(pieces) if k not in gone)
    return out


def test_spans_against_brute_force(documents):
    rng = random.Random(1)
    passage = ". ".join(prose(rng, 9) for _ in range(7)) + "."
    docs = [(k, ". ".join(prose(rng, rng.randint(1, 30)) for _ in range(8)) + ".") for k in range(40)]
    docs = [(k, t if k % 3 else t[: len(t) // 2] + " " + passage + "\n" + t[len(t) // 2 :]) for k, t in docs] + [(90, docs[5][1]), (91, passage + passage)]
    found = {r["doc_id"]: r for r in spans.dedup_texts(documents(docs)).collect()}
    want = brute_spans(docs)
    assert {i: r["text"] for i, r in found.items()} == want
    assert want[90] == "" and passage[:200] in want[0] and passage[100:250] not in want[3]
    assert found[1]["n_removed"] == 0


def test_spans_cut_and_join():
    rng = random.Random(2)
    for k in range(300):
        t = "".join(rng.choice(["a", "bc ", ". ", "\n", "! ", " ", "é?", "x " * 30]) for _ in range(rng.randint(0, 40)))
        assert "".join(spans.sentences(t)) == t
        assert [p for p in spans.sentences(t) if p.strip()] == own_sentences(t)
    blank = " " * 1_000_000
    assert spans.sentences(blank) == [blank] and len(spans.sentences("a." + blank + "b\n" + blank)) == 2
    assert spans.sentences("\u4e00\u4e8c\u3002\u4e09\uff01 \u56db") == ["\u4e00\u4e8c\u3002", "\u4e09\uff01 ", "\u56db"]


def test_spans_odd_rows(documents):
    rows = spans.dedup_texts(documents(odd(), **CLASH)).collect()
    assert len(rows) == 9
    assert {r["text"] for r in rows if r["doc_id"] in (1, 2)} == {None, ""}
    assert all(r["n_removed"] == 0 for r in rows if r["doc_id"] == 4)
    assert spans.dedup_texts(documents([])).count() == 0


def test_short_repeated_spans_go(documents):
    short, unspaced = "Ab cd. Ef gh. Ij kl. ", "".join(c * 30 + "\n" for c in "\u4e00\u4e8c\u4e09")
    docs = [(1, short + "Mn op."), (2, "Qr st. Uv wx. " + short), (3, unspaced + "x"), (4, "y\nz\n" + unspaced)]
    found = {r["doc_id"]: r["text"] for r in spans.dedup_texts(documents(docs)).collect()}
    assert found == {1: docs[0][1], 2: "Qr st. Uv wx. ", 3: docs[2][1], 4: "y\nz\n"}


def test_spans_of_rows_without_an_id_of_their_own(documents):
    rng = random.Random(6)
    text = lambda: ". ".join(prose(rng, 9) for _ in range(8)) + ". "
    shared, mine, passage = text(), [text() for _ in range(6)], text()
    # what repeats an earlier row goes from the row that has it, and nothing from the others of the same id
    docs = [(1, shared + mine[0]), (None, mine[1] + shared), (None, mine[2]), (None, mine[3] + passage), (None, passage), (7, mine[4]), (7, shared + mine[5]), (9, None)]
    found = [(r["doc_id"], r["text"]) for r in spans.dedup_texts(documents(docs, **CLASH)).collect()]
    left = [t for i, t in found if i is None]
    assert [t for i, t in found if i == 1] == [docs[0][1]] and {t for i, t in found if i == 7} == {mine[4], mine[5]}
    assert mine[1] in left and mine[2] in left and sum(passage in t for t in left) == 1 and not any(shared in t for t in left)
    assert sum(t.count(m) for t in left for m in mine[1:4]) == 3 and len(found) == 8
    equal = spans.dedup_texts(documents([(None, passage), (None, passage), (3, mine[0]), (3, mine[0])])).collect()
    assert sorted(r["text"] for r in equal) == sorted([passage, "", mine[0], mine[0]])


# Jaccard


def brute_links(docs):
    hashes = jaccard.WordHashes()
    sets = [set(jaccard.shingles((t or "").lower().split(), 5, hashes).tolist()) for _, t in docs]
    links = {i: set() for i, _ in docs}
    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links[docs[a][0]].add(docs[b][0])
                links[docs[b][0]].add(docs[a][0])
    return links


def classes(links):
    out = {}
    for i in sorted(links):
        todo = [i]
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = i
                todo += links[x]
    return out


def near(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return " ".join(words)


def test_jaccard_against_brute_force(documents):
    rng = random.Random(3)
    base = [prose(rng, rng.randint(30, 150)) for _ in range(12)]
    docs = [(k, near(rng, rng.choice(base), rng.randint(0, 4))) for k in range(150)] + [(200 + k, prose(rng, 3)) for k in range(5)] + [(300, base[0].upper()), (301, base[0])]
    want = brute_links(docs)
    found = {r["id"]: r for r in jaccard.jaccard_join(documents(docs)).collect()}
    assert {i: r["n_links"] for i, r in found.items()} == {i: len(x) for i, x in want.items()}
    assert {i: r["class_id"] for i, r in found.items()} == classes(want)


def test_jaccard_large_groups_in_blocks(documents):
    rng = random.Random(4)
    base = prose(rng, 120)
    docs = [(k, near(rng, base, 1)) for k in range(700)] + [(1000 + k, base) for k in range(50)]
    want = brute_links(docs)
    assert {r["id"]: r["n_links"] for r in jaccard.jaccard_join(documents(docs)).collect()} == {i: len(x) for i, x in want.items()}


def test_jaccard_odd_rows(documents):
    rows = jaccard.jaccard_join(documents(odd(), **CLASH)).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["id"]].append((r["class_id"], r["n_links"]))
    assert len(rows) == 9 and by[1] == [(1, 0)] and by[2] == [(2, 0)] and by[4] == [(4, 1), (4, 1)] and by[None] == [(None, 0)] * 2
    assert jaccard.jaccard_join(documents([])).count() == 0


def test_least_matches_keep_what_may_reach_the_threshold():
    need = jaccard.least_matches(0.8, 1e-5)
    for n, m in need.items():
        lost = sum(math.comb(n, k) * 0.8**k * 0.2 ** (n - k) for k in range(m))
        assert 0 < m < 0.8 * n and lost < 1e-4


# toxicity


def test_toxicity_on_held_out_rows(spark, documents):
    rng = random.Random(5)
    docs = [(k, prose(rng, 60) + (f" zgromp{rng.choice('abcdef')}" if k % 5 == 0 else "")) for k in range(600)]
    df = documents(docs)
    labels = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(0, 600) if k % 2 or k % 5 == 0], "doc_id long, toxic int")
    learnt = df.where("doc_id < 400")
    model = toxicity.fit(toxicity.toxic_labels(learnt, labels))
    scores = {r["id"]: r["score"] for r in toxicity.score_toxicity(df.where("doc_id >= 400"), model).collect()}
    assert all((s >= 0.7) == (k % 5 == 0) for k, s in scores.items())
    kept = toxicity.drop_toxic(df.withColumns({}), model)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.where("doc_id >= 400").collect()} == {k for k in range(400, 600) if k % 5}


def plain_bucket(gram):
    """The bucket of one n-gram in plain integers."""
    mask, x = 2**64 - 1, 0
    for c in gram:
        x = (x * 1_000_003 + ord(c)) & mask
    x = (x + len(gram)) & mask
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = ((x ^ x >> 33) * factor) & mask
    return (x ^ x >> 33) % toxicity.BUCKETS


def test_toxicity_against_brute_force(spark, documents):
    rng = random.Random(51)
    docs = [(k, prose(rng, rng.randint(0, 25)) + (f" Zgr\u00f6mp{rng.choice('abc')}" if k % 4 == 0 else "")) for k in range(120)]
    said = {k: int(k % 4 == 0) for k in range(80)}
    labels = spark.createDataFrame(list(said.items()), "doc_id long, toxic int")
    df = documents(docs)
    found = {r["id"]: r["score"] for r in toxicity.score_toxicity(df, toxicity.fit(toxicity.toxic_labels(df, labels))).collect()}
    features = {}
    for i, t in docs:
        features[i] = Counter(plain_bucket(f"<{w}>"[a : a + n]) for w in set(t.lower().split()) for n in (3, 4, 5) for a in range(len(w) + 2 - n + 1))
    rows = [Counter(), Counter()]
    size = [sum(v == c for v in said.values()) for c in (0, 1)]
    for i, c in said.items():
        rows[c].update(set(features[i]))
    ratio = {b: math.log((rows[1][b] + 1) / (size[1] + 2)) - math.log((rows[0][b] + 1) / (size[0] + 2)) for b in {*rows[0], *rows[1]}}
    useful = sorted(b for b, r in ratio.items() if abs(r) >= 0.5)
    x = np.array([[features[i][b] * ratio[b] for b in useful] for i in said])
    y = np.array(list(said.values()), float)
    w = np.zeros(len(useful) + 1)
    w[-1] = math.log((size[1] + 1) / (size[0] + 1))
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, 201):
        off = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1]))) - y
        slope = np.append(x.T @ off / len(y) + 1e-4 * w[:-1], off.mean())
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        w = w - 0.05 * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-8)
    for i, t in docs:
        z = w[-1] + sum(features[i][b] * ratio[b] * w[k] for k, b in enumerate(useful))
        assert found[i] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-6)


def test_toxicity_samples_are_bounded(spark, documents):
    docs = [(k // 4, f"word{k} other{k % 7}") for k in range(200)] + [(99, "many rows")] * 60
    labels = spark.createDataFrame([(k, k % 2) for k in range(50)] + [(99, 1)], "doc_id long, toxic int")
    rows = toxicity.toxic_labels(documents(docs), labels, most_rows=42).collect()
    assert len(rows) == 40 and all(sum(r["id"] == i for r in rows) == 4 for i in {r["id"] for r in rows})
    train = toxicity.toxic_labels(documents(docs), labels)
    weights, bias = toxicity.fit(train, least_ratio=0.01, most_cells=100)
    assert weights.any() and math.isfinite(bias)


def test_toxicity_odd_rows(spark, documents):
    labels = spark.createDataFrame([(4, 1), (4, 0), (5, 0), (None, 1), (1, 0), (2, None)], "doc_id long, toxic int")
    df = documents(odd(), **CLASH)
    rows = toxicity.score_toxicity(df, toxicity.fit(toxicity.toxic_labels(df, labels))).collect()
    assert len(rows) == 9 and all(0 <= r["score"] <= 1 for r in rows)
    none = toxicity.fit(toxicity.toxic_labels(df, labels.where("toxic = 0")))
    assert len({r["score"] for r in toxicity.score_toxicity(df, none).collect()}) == 1
    assert toxicity.score_toxicity(documents([]), none).count() == 0


# licences


def test_licences_against_brute_force(documents):
    rng = random.Random(6)
    vocabulary = ["mit", "license", "apache", "general", "public", "the", "Licensed", "under", "é", "x1", "MIT License", "CC BY-NC 4.0.", "Licensed under CC BY-NC 4.0"]
    docs = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))) for k in range(200)]
    found = {r["id"]: r for r in licenses.license_scan(documents(docs)).collect()}
    for i, t in docs:
        words = licenses.words_of(t)
        places = {label: [k for k in range(len(words)) if words[k : k + len(p.split())] == p.split()] for p, label in licenses.BASE.items()}
        every = [k for own in places.values() for k in own]
        r = found[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(every), min(every, default=None), max(every, default=None))
        assert r["base_labels"] == ",".join(sorted(x for x, own in places.items() if own))
        labels = r["labels"].split(",")  # the whole notice is always found; without its key phrase it never is
        assert "cc-by-nc" in labels or "licensed under cc by nc 4 0" not in " ".join(words)
        assert "cc-by-nc" not in labels or "cc by nc" in " ".join(words)
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))


def brute_labels(words, idf, least=0.7):
    """Labels and the best score by trying every template at every place."""
    labels, best = set(), 0.0
    for label, many in licenses.NOTICES.items():
        for text in many:
            own, keys, inside = [], [], False
            for part in text.split():
                inside = inside or part.startswith("[")
                own.append(part.strip("[]"))
                keys.append(inside)
                inside = inside and not part.endswith("]")
            for at in range(len(words)):
                seen = words[at : at + len(own)] + [None] * max(0, at + len(own) - len(words))
                if all(x == w for x, w, key in zip(seen, own, keys) if key):
                    share = sum(idf[w] for x, w in zip(seen, own) if x == w) / sum(idf[w] for w in own)
                    if share >= least:
                        labels.add(label)
                        best = max(best, share)
    return labels, best


def test_whole_licence_texts_against_brute_force(documents):
    rng = random.Random(61)
    texts = [n.replace("[", "").replace("]", "") for many in licenses.NOTICES.values() for n in many]
    docs = []
    for k, t in enumerate(texts * 3):
        words = t.split()
        for _ in range(rng.choice([0, 1, len(words) // 8, len(words) // 3])):
            words[rng.randrange(len(words))] = rng.choice(["license", "odd", "the"])
        docs.append((k, f"{prose(rng, 20)} {' '.join(words)} {prose(rng, 15)} {rng.choice(texts)[:60] if k % 4 == 0 else ''}"))
    docs += [(900 + k, prose(rng, 50)) for k in range(20)]
    found = {r["id"]: r for r in licenses.license_scan(documents(docs)).collect()}
    split = {i: licenses.words_of(t) for i, t in docs}
    vocabulary = {w.strip("[]") for many in licenses.NOTICES.values() for n in many for w in n.split()} | {w for p in licenses.BASE for w in p.split()}
    idf = {w: math.log((len(docs) + 1) / (sum(w in own for own in map(set, split.values())) + 1)) for w in vocabulary}
    for i, words in split.items():
        labels, best = brute_labels(words, idf)
        base = set(filter(None, found[i]["base_labels"].split(",")))
        assert set(filter(None, found[i]["labels"].split(","))) == labels | base, docs[i]
        assert found[i]["score"] == (1.0 if base else pytest.approx(min(best, 1.0)))
    labelled = [found[k]["labels"] for k in range(len(texts))]
    assert sum(map(bool, labelled)) > len(texts) * 0.6


def test_licences_odd_rows(documents):
    rows = licenses.license_scan(documents(odd(), **CLASH)).collect()
    assert len(rows) == 9 and {(r["n_words"], r["labels"], r["score"]) for r in rows if r["id"] in (1, 2, 3)} == {(0, "", 0.0)}
    assert licenses.license_scan(documents([])).count() == 0
    assert licenses.words_of("ÀB ﬀ K-k") == ["Àb", "ﬀ", "k", "k"]


# Katz


@pytest.mark.parametrize("order, batch, hot", [(3, 200, 1000), (3, 3_000_000, 1000), (2, 200, 20), (4, 300, 20), (1, 300, 1000)])
def test_katz_against_brute_force(documents, monkeypatch, order, batch, hot):
    monkeypatch.setattr(katz, "BATCH_TOKENS", batch)
    monkeypatch.setattr(katz, "HOT", hot)
    rng = random.Random(7)
    docs = [(k, " ".join(f"v{int(rng.paretovariate(0.7))}" for _ in range(rng.randint(0, 40)))) for k in range(120)]
    docs += [(200 + k, docs[k][1]) for k in range(0, 60, 3)]
    from pyspark.sql import functions as F

    found = {r["id"]: r for r in katz.katz_scores(documents(docs), F.col("doc_id") % 5 != 1, order).collect()}
    tokens = {i: [*t.encode().lower().split(), None] for i, t in docs}
    counts = [Counter() for _ in range(order + 1)]  # counts[n]: n-grams; a text begins with one "<s>", which is no token
    for i, own in tokens.items():
        if i % 5 != 1:
            for n in range(1, order + 1):
                padded = own if n == 1 else ["<s>", *own]
                counts[n].update(tuple(padded[k : k + n]) for k in range(len(padded) - n + 1))
    total, types = sum(counts[1].values()), len(counts[1])
    d = [None, *(katz.discounts(np.array([0, *(sum(v == r for v in c.values()) for r in range(1, 7))])) for c in counts[1:])]
    d = [x if x is None or x.any() else np.ones(7) for x in d]
    assert (d[1] < 1).any()
    unknown = 1 - sum(d[1][min(c, 6)] * c / total for c in counts[1].values())
    followers = defaultdict(dict)
    for c in counts[2:]:
        for gram, k in c.items():
            followers[gram[:-1]][gram[-1]] = k

    def p(history, w):
        n = len(history) + 1
        if not history:
            return d[1][min(counts[1][w,], 6)] * counts[1][w,] / total if (w,) in counts[1] else unknown
        after = followers.get(history)
        if after is None:
            return p(history[1:], w)
        below = sum(after.values()) + all(d[n][min(c, 6)] >= 1 for c in after.values())
        if w in after:
            return d[n][min(after[w], 6)] * after[w] / below
        return (1 - sum(d[n][min(c, 6)] * c / below for c in after.values())) / (1 - sum(p(history[1:], v) for v in after)) * p(history[1:], w)

    for h in [*followers][:: max(1, len(followers) // 40)]:
        assert sum(p(h, w) for (w,) in counts[1]) + p(h, "no such word") == pytest.approx(1)
    for i, own in tokens.items():
        r, padded = found[i], ["<s>", *own]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i % 5 == 1, len(own), sum((w,) in counts[1] for w in own), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[1][w,] + 0.5) / (total + 0.5 * (types + 1))) for w in own))
        want = sum(math.log10(p(tuple(padded[max(0, k - order + 1) : k]) if order > 1 else (), padded[k])) for k in range(1, len(padded)))
        assert r["score"] == pytest.approx(want)


def test_katz_tables_hold_all_counts(spark, documents):
    rng = random.Random(17)
    docs = [(k, " ".join(f"v{int(rng.paretovariate(0.9))}" for _ in range(30))) for k in range(50)]
    texts = documents(docs).selectExpr("doc_id as id", "text", "true as train")
    kept = katz._Tables(spark)
    _, tables = katz.ngram_tables(kept.bucketed(texts.mapInArrow(katz._batches, katz._BATCH), "batch"), 3, kept)
    for n, table in enumerate(tables[1:], 2):
        held = sorted(c for r in table.where("batch is null").collect() for c in katz._unzip(r["blobs"][3]).tolist())
        want = Counter(tuple(own[k : k + n]) for own in (["<s>", *t.split(), None] for _, t in docs) for k in range(len(own) - n + 1))
        assert held == sorted(want.values())
    kept.drop()


def test_katz_odd_rows(documents):
    from pyspark.sql import functions as F

    rows = katz.katz_scores(documents(odd(), **CLASH), F.lit(True)).collect()
    assert len(rows) == 9 and {r["n_tokens"] for r in rows if r["id"] in (1, 2, 3)} == {1} and all(math.isfinite(r["score"]) for r in rows)
    blank = katz.katz_scores(documents([(k, "") for k in range(20)]), F.lit(True)).collect()
    assert len(blank) == 20 and {r["n_tokens"] for r in blank} == {1}
    none = katz.katz_scores(documents(odd()), F.lit(False)).collect()
    assert {(r["train_tokens"], r["n_known"], r["score"]) for r in none} == {(0, 0, 0.0)}
    assert katz.katz_scores(documents([]), F.lit(True)).count() == 0


# packing


def naive_bins(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        best = min((k for k, room in enumerate(bins) if room >= n), key=lambda k: bins[k], default=None)
        if best is None:
            bins.append(capacity)
            best = len(bins) - 1
        bins[best] -= n
    return sorted(bins)


def test_plan_is_best_fit_decreasing():
    for seed in range(150):
        rng = random.Random(seed)
        capacity = rng.choice([5, 16, 64, 100])
        lengths = [rng.randint(1, capacity) if rng.random() < 0.7 else rng.choice([1, 2, 3]) for _ in range(rng.randint(1, 120))]
        filled = defaultdict(list)
        for n, _, pieces, first, per, offset in packing.plan(Counter(lengths), capacity):
            for k in range(pieces):
                filled[first + k // per].append((offset + k % per * n, n))
        for own in filled.values():
            at = 0
            for offset, n in sorted(own):
                assert offset == at
                at += n
        assert sorted(capacity - sum(n for _, n in own) for own in filled.values()) == naive_bins(lengths, capacity)


def test_packing_round_trip(documents):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    coder = Tokenizer.from_file(path)
    coder.encode_special_tokens = True
    rng = random.Random(8)
    docs = [(k, prose(rng, rng.choice([0, 3, 30, 900]))) for k in range(60)] + [(100, "<|endoftext|> x"), (101, None), (102, "é中\u2028 ")]
    rows = packing.pack(documents(docs, **CLASH), path).collect()
    by, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r["id"]].append(r)
        bins[r["sequence_id"]].append(r)
    for i, t in docs:
        ids, at = np.array([*coder.encode(t or "", add_special_tokens=False).ids, 0], "<u4"), 0
        for k, r in enumerate(sorted(by[i], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            assert r["length"] == 2048 or k == 0
            at += r["length"]
        assert at == len(ids)
    for own in bins.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert len(bins) == len(naive_bins([r["length"] for r in rows], 2048))


def test_packing_odd_rows(documents):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = packing.pack(documents(odd(), **CLASH), path).collect()
    assert Counter(r["id"] for r in rows if r["piece"] == 0) == {1: 1, 2: 1, 3: 1, 4: 2, 5: 1, 6: 1, None: 2}
    assert packing.pack(documents([]), path).count() == 0


def test_packing_very_long_runs(documents):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    coder = Tokenizer.from_file(path)
    docs = [(1, " " * 2_000_000), (2, "a" * 2_000_000), (3, "x\n" + "\n" * 60_000 + " y"), (4, "y " * 60_000), (None, "same"), (None, "same")]
    rows = packing.pack(documents(docs), path).collect()
    for i, t in docs[:4]:
        ids, at = np.array([*coder.encode(t, add_special_tokens=False).ids, 0], "<u4"), 0
        for r in sorted((r for r in rows if r["id"] == i), key=lambda r: r["piece"]):
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    full = [r["sequence_id"] for r in rows if r["length"] == 2048]
    assert len(full) == len(set(full)) > 1000 and not set(full) & {r["sequence_id"] for r in rows if r["length"] < 2048}
    assert sum(r["id"] is None for r in rows) == 2


def test_packing_of_many_equal_pieces(documents, monkeypatch):
    monkeypatch.setattr(packing, "SALT_PIECES", 50)
    rng = random.Random(81)
    docs = [(k, " ".join(["a"] * rng.choice([700, 700, 700, 300, 5]))) for k in range(900)]
    rows = packing.pack(documents(docs), public_tokenizers.path("byte_bpe_50k.json")).collect()
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        assert [o for o, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:k]) for k in range(len(own))]
    assert len(rows) == 900 and sorted(2048 - sum(n for _, n in own) for own in bins.values()) == naive_bins([r["length"] for r in rows], 2048)


def test_merges_must_be_ranks():
    import json

    model = json.load(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8"))
    byte = {c: 0 for c in model["model"]["vocab"] if len(c) == 1 and model["model"]["vocab"][c] < 256}
    assert packing.merges_are_ranks(model, byte)
    assert not packing.merges_are_ranks(model | {"normalizer": {"type": "NFC"}}, byte)
    assert not packing.merges_are_ranks(model | {"pre_tokenizer": {"type": "Whitespace"}}, byte)
    assert not packing.merges_are_ranks(model | {"model": model["model"] | {"merges": model["model"]["merges"][::-1]}}, byte)


# byte-level BPE


@pytest.fixture(scope="module")
def multi():
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.read_ranks(path)
    return path, ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_tiktoken(multi):
    _, ranks, known = multi
    coder, rng = bpe.Coder(ranks, public_tokenizers.PATTERN), random.Random(10)
    texts = ["".join(rng.choice(["a", "aa", "b", " ", "\n", "é", "ß", "1", "the", "!!", "中", "  ", "'s", "\U0001f600"]) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    for t in [*texts, "ab" * 30_000 + "a" * 30_001, "", " "]:
        ids = coder.encode(t)
        assert ids == known.encode_ordinary(t) and coder.decode(ids) == t.encode()


def test_bpe_tables(documents, multi):
    path, _, known = multi
    df = documents(odd(), **CLASH)
    rows = bpe.round_trip(df, path, public_tokenizers.PATTERN).collect()
    want = Counter()
    for i, t in odd():
        ids = known.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert Counter((r["id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows) == want
    back = bpe.decoded(bpe.encoded(df.where("doc_id = 5"), path, public_tokenizers.PATTERN), path).first()
    assert bytes(back["bytes"]).decode() == odd()[5][1]
    assert bpe.round_trip(documents([]), path, public_tokenizers.PATTERN).count() == 0
