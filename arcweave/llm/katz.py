"""Language-model scoring: an n-gram model with Katz backoff and Good-Turing discounts.

Recursion for each token, from the longest history (``order`` - 1 words) down: an n-gram seen in training has its
discounted relative frequency; any other has its history's backoff weight times the probability with a
history that is a word shorter, and an unseen word the mass that the unigram discounts leave (one unknown
type). Backoff weights are exact: the mass that a history's discounts leave, over the lower-order mass
of what it wasn't seen with, so each history sums to one. A history that wasn't seen weighs one.

Texts are tokenised once into batches of a bounded number of tokens. Then each order is one exchange: a
batch asks the part of the n-gram table that owns a history once for each of its distinct n-grams, with
their training counts; the part adds up the counts of all batches, keeps them as its rows of the table, and answers
with the sums and with what the backoff weights of the histories need. N-grams are pairs of numbers that the
orders below have given out, (history, word), so nothing but words is known by a hash (of 64 bits).
The sum of the lower-order probabilities that a backoff weight needs is made from counts that come with the
question, as whatever follows a history has been seen after the shorter one as well. Histories with more
than a thousandth of all tokens (a thousand at most) are spread by the following word; the sums of their
parts are added up and go to every batch.

Defined results: a null text is empty; an empty text is the end token alone; without training tokens
everything has probability one; counts of counts that Good-Turing can't use give way to one pseudo-count
(c / (N + 1)); repeated rows count and are scored as often as they occur; a null id falls in the fold
of the empty text. Other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_shuffles, mix64, small_batches, stored

#: Counts up to MOST are discounted. END and START stand for themselves among the word hashes.
MOST, END, START = 5, 1, 2
BATCH_TOKENS, PART_TOKENS, HOT = 800_000, 800_000, 1000


def discounts(seen: np.ndarray) -> np.ndarray:
    """Good-Turing discount factors for counts 0..MOST + 1 (the last: for all larger) from counts of counts seen[r], r = 0..MOST + 1.

    Katz's formula with the largest limit k <= MOST for which all factors lie in (0, 1); zeros throughout if there is none.
    """
    out = np.ones(MOST + 2)
    for k in range(MOST, 0, -1):
        n = seen[: k + 2].astype(float)
        if (n[1 : k + 2] <= 0).any() or (k + 1) * n[k + 1] >= n[1]:
            continue
        r = np.arange(1, k + 1)
        common = (k + 1) * n[k + 1] / n[1]
        d = ((r + 1) * n[r + 1] / n[r] / r - common) / (1 - common)
        if (d > 0).all() and (d < 1).all():
            out[1 : k + 1] = d
            return out
    return np.zeros(MOST + 2)


def unigram_logs(count: np.ndarray, total: int, seen: np.ndarray) -> np.ndarray:
    """log10 of the discounted unigram probability; count 0: the unknown type."""
    if not total:
        return np.zeros(len(count))
    d = discounts(seen)
    if not d.any():
        return np.log10(np.where(count > 0, count, 1) / (total + 1))
    left = 1 - (total - (np.arange(1, MOST + 1) * seen[1 : MOST + 1] * (1 - d[1 : MOST + 1])).sum()) / total
    return np.log10(np.where(count > 0, d[np.minimum(count, MOST + 1)] * np.maximum(count, 1) / total, left))


def _zip(x: np.ndarray) -> bytes:
    """Numbers that aren't negative, compressed by planes of bytes: the high bytes of small ones take next to nothing."""
    most = int(x.max(initial=0))
    size = next(k for k in (1, 2, 4, 8) if most < 256**k)
    raw = np.ascontiguousarray(x.astype(f"<u{size}").view(np.uint8).reshape(len(x), size).T).tobytes()
    return bytes([size]) + len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unzip(raw: bytes) -> np.ndarray:
    size = raw[0]
    flat = np.frombuffer(pa.decompress(raw[9:], int.from_bytes(raw[1:9], "little"), codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(flat.reshape(size, -1).T).view(f"<u{size}").ravel().astype(np.int64)


def _zip_sorted(x: np.ndarray) -> bytes:
    """Numbers that mostly rise, by their steps; a step down is an odd number."""
    step = np.diff(x, prepend=0)
    return _zip(step << 1 ^ step >> 63)


def _unzip_sorted(raw: bytes, signed: bool = True) -> np.ndarray:
    step = _unzip(raw)
    return np.cumsum(step >> 1 ^ -(step & 1) if signed else step)


def _zip_words(x: np.ndarray, count: np.ndarray) -> list[bytes]:
    """Word ids with their counts: sorted distinct ids, their counts, which mostly fall, and places among them."""
    words, first, at = np.unique(x, return_index=True, return_inverse=True)
    return [_zip_sorted(words), _zip_sorted(count[first]), _zip(at)]


def _unzip_words(ids: bytes, counts: bytes, at: bytes) -> tuple[np.ndarray, np.ndarray]:
    at = _unzip(at)
    return _unzip_sorted(ids)[at], _unzip_sorted(counts)[at]


def _order(major: np.ndarray, minor: np.ndarray) -> np.ndarray:
    """Stable order by two numbers that aren't negative."""
    wide = int(minor.max(initial=0)) + 1
    if int(major.max(initial=0)) < 2**62 // wide:
        return np.argsort(major * wide + minor, kind="stable")
    return np.lexsort((minor, major))


class _Places(dict):
    def __missing__(self, word: bytes) -> int:
        place = self[word] = len(self)
        return place


_BATCH = "batch long, ids array<long>, train binary, sizes binary, tokens binary, words binary, counts binary, n long"


def _batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokenised texts: one row per batch."""
    names = [x.split()[0] for x in _BATCH.split(", ")]
    place, k = TaskContext.get().partitionId(), 0
    ids, train, sizes, tokens, local, held = [], [], [], [], _Places(), 0

    def flush() -> pa.RecordBatch:
        flat = np.concatenate(tokens)
        n, kept = np.array(sizes, np.uint32), np.array(train, bool)
        # places by frequency, so that tokens compress; START comes last
        often = np.bincount(flat, minlength=len(local) + 1)
        order = np.argsort(-often[:-1], kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        hashes = np.fromiter((END if w is None else xxhash.xxh3_64_intdigest(w) for w in local), np.uint64, len(local))[order]
        flat = rank[flat]
        counts = np.bincount(flat[np.repeat(kept, n)], minlength=len(order))
        values = [place << 32 | k, list(ids), kept.tobytes(), n.tobytes(), _zip(flat), np.append(hashes, np.uint64(START)).tobytes(), _zip(np.append(counts, kept.sum())), int(n.sum())]
        kinds = [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 5, pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], names=names)

    for batch in rows:
        for doc_id, fold, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(1)):
            words = (text.as_py() or "").encode().lower().split()  # on bytes: A-Z and ASCII white space only
            words.append(None)
            tokens.append(np.fromiter(map(local.__getitem__, words), np.int32, len(words)))
            ids.append(doc_id)
            train.append(fold)
            sizes.append(len(words))
            held += len(words)
            if held >= BATCH_TOKENS:
                yield flush()
                k, held = k + 1, 0
                ids, train, sizes, tokens, local = [], [], [], [], _Places()
    if ids:
        yield flush()


_ASK = "part int, batch long, blobs array<binary>"
_TOLD = "n int, part int, batch long, blobs array<binary>, sums array<double>, hot array<array<double>>"


def _asked(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.list_(pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["part", "batch", "blobs"])


def _told(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.float64()), pa.list_(pa.list_(pa.float64()))]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["n", "part", "batch", "blobs", "sums", "hot"])


def _in_parts(to: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Stable order by part, and where each part's items end."""
    order = np.argsort(to, kind="stable")
    return order, np.searchsorted(to[order], np.arange(parts + 1))


class Model:
    """What is known of all orders up to one: totals, discounts, and the sums of hot histories."""

    def __init__(self, parts: int, total: int, types: int, seen: np.ndarray):
        self.parts, self.total, self.types, self.seen = parts, total, types, seen
        d = discounts(seen)
        #: by order: discount factors of counts 0..MOST + 1; all ones where Good-Turing can't be used
        self.discount = {1: d if d.any() else np.ones(MOST + 2)}
        self.words_below = total + (not d.any())
        self.hot: dict[int, dict[int, np.ndarray]] = {}

    def learn(self, n: int, seen: np.ndarray, hot: dict[int, np.ndarray]) -> None:
        d = discounts(seen)
        self.discount[n], self.hot[n] = d if d.any() else np.ones(MOST + 2), hot

    def is_hot(self, count: np.ndarray) -> np.ndarray:
        return count * HOT > self.total


class _Grams:
    """The distinct n-grams of one order in a batch, in the order in which they are asked for."""

    count: np.ndarray  # in training, over all batches
    ids: np.ndarray
    least: np.ndarray  # of each history, the least count of what follows it (MOST + 1: none is discounted)
    backoff: np.ndarray  # log10 of each history's backoff weight

    def __init__(self, at: np.ndarray, history: np.ndarray, word: np.ndarray):
        self.at, self.history, self.word = at, history, word


class _Batch:
    """One batch of tokens and what its answers so far say of its n-grams."""

    def __init__(self, row: dict, model: Model):
        self.model, self.batch = model, row["batch"]
        self.sizes = np.frombuffer(row["sizes"], np.uint32).astype(np.int64)
        self.train, self.ids = np.frombuffer(row["train"], bool), row["ids"]
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.learnt = np.repeat(self.train, self.sizes)
        self._words(np.frombuffer(row["words"], np.uint64), _unzip(row["tokens"]), row["told1"])
        self.grams: dict[int, _Grams] = {}
        for n in range(2, max(model.discount) + 1):
            self.grams[n] = self._find(n)
            self._hear(n, row.pop(f"told{n}") or [])  # none where no text is long enough

    def _words(self, words: np.ndarray, tokens: np.ndarray, told: list[dict]) -> None:
        parts = self.model.parts
        order = np.lexsort((words, words % np.uint64(parts)))
        count, ids = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        count[order] = np.concatenate([_unzip(x["blobs"][0]) for x in told])
        ids[order] = np.concatenate([_unzip(x["blobs"][1]) * parts + x["part"] for x in told])
        # words are renumbered by their ids; START was the last
        by = np.argsort(ids)
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        self.count, self.word_ids, self.start, self.tokens = count[by], ids[by], rank[-1], rank[tokens].astype(np.int32)

    def _history(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts and ids of the (n-1)-grams as histories, and by position the one before it."""
        if n == 2:
            before = np.empty(len(self.tokens), np.int32)
            before[1:] = self.tokens[:-1]
            before[self.starts] = self.start
            return self.count, self.word_ids, before
        g = self.grams[n - 1]
        before = np.full(len(self.tokens), -1, np.int32)
        before[1:] = g.at[:-1]
        for k in range(n - 2):  # a text's first words have no such history
            before[self.starts[self.sizes > k] + k] = -1
        return g.count, g.ids, before

    def _find(self, n: int) -> _Grams:
        """Distinct n-grams by the part, the id and the word of their history; those of unseen histories come last.

        A history is at home where its own id comes from.
        """
        parts = self.model.parts
        count, ids, before = self._history(n)
        home = ids % parts
        home[count == 0] = parts
        by = _order(home, ids // parts)
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        there = np.flatnonzero(before >= 0)
        width = len(self.count)
        key, inverse = np.unique(rank[before[there]] * width + self.tokens[there], return_inverse=True)
        at = np.full(len(self.tokens), -1, np.int32)
        at[there] = inverse
        history, word = np.divmod(key, width)
        g = _Grams(at, by[history], word)
        g.times = np.bincount(inverse[self.learnt[there]], minlength=len(key))
        # only n-grams of seen histories are asked for
        g.asked = int(np.searchsorted(key, int((count > 0).sum()) * width))
        to = home[g.history[: g.asked]]
        hot = np.flatnonzero(self.model.is_hot(count[g.history[: g.asked]]))
        to[hot] = (to[hot] + (mix64(self.word_ids[g.word[hot]].astype(np.uint64)) % np.uint64(parts)).astype(np.int64)) % parts
        g.order, g.ends = _in_parts(to, parts)
        return g

    def _rows(self, g: _Grams, part: int) -> tuple[np.ndarray, np.ndarray]:
        """N-grams asked of a part, and where a history's first one is among them."""
        own = g.order[g.ends[part] : g.ends[part + 1]]
        return own, np.flatnonzero(np.diff(g.history[own], prepend=-1))

    def _hear(self, n: int, told: list[dict]) -> None:
        """Take in the answers to what ``_find`` asks."""
        g, parts, (count, ids, _) = self.grams[n], self.model.parts, self._history(n)
        g.count, g.ids = np.zeros(len(g.history), np.int64), np.zeros(len(g.history), np.int64)
        g.least, needs = np.full(len(count), MOST + 1, np.int64), []
        for x in told:
            own, head = self._rows(g, x["part"])
            g.count[own] = _unzip(x["blobs"][0])
            if x["blobs"][1]:
                g.ids[own] = _unzip_sorted(x["blobs"][1]) * parts + x["part"]
            names = g.history[own[head]]
            g.least[names] = _unzip(x["blobs"][2])
            at = names[_unzip_sorted(x["blobs"][3])]
            needs.append((at, _unzip(x["blobs"][4]).reshape(MOST, len(at)), np.frombuffer(x["blobs"][5], "<f8")))
        d = self.model.discount[n]
        for name in np.flatnonzero(self.model.is_hot(count)).tolist():
            sums = self.model.hot[n].get(int(ids[name]))
            if sums is not None:
                g.least[name] = sums[0]
                needs.append((np.array([name]), sums[1 : MOST + 1, None], sums[MOST + 1 :]))
        #: what a history's counts are divided by: one more where nothing is discounted, to leave mass for the rest
        g.below = count + (d[g.least] >= 1)
        g.backoff, shorter = np.zeros(len(count)), self._shorter(n)
        for at, of, low in needs:
            mass = (of * np.arange(1, MOST + 1)[:, None] * (1 - d[1 : MOST + 1, None])).sum(0)
            left = np.where(d[g.least[at]] >= 1, 1.0, mass) / g.below[at]
            g.backoff[at] = np.log10(left) - np.log10(1 - low / shorter[at])

    def _lower(self, g: _Grams, n: int) -> np.ndarray:
        """Where each n-gram without its first word is among the (n-1)-grams: both end at the same positions."""
        there, low_at = np.flatnonzero(g.at >= 0), np.empty(len(g.history), np.int64)
        low_at[g.at[there]] = self.grams[n - 1].at[there]
        return low_at

    def _shorter(self, n: int) -> np.ndarray:
        """By history of order ``n``: what the counts after the history without its first word are divided by."""
        if n == 2:
            return np.full(len(self.count), float(self.model.words_below))
        g, lower = self.grams[n], self.grams[n - 1]
        below = np.ones(len(lower.count))
        below[g.history] = lower.below[lower.history[self._lower(g, n)]]
        return below

    def ask(self, n: int) -> Iterator[tuple]:
        """Rows (part, batch, blobs) that ask for the n-grams of the next order."""
        g, (count, ids, _) = self._find(n), self._history(n)
        low_count = None if n == 2 else self.grams[n - 1].count[self._lower(g, n)]
        hot = self.model.is_hot(count)
        for part in np.flatnonzero(np.diff(g.ends)).tolist():
            own, head = self._rows(g, part)
            names = g.history[own[head]]
            # a history from elsewhere is one of the hot ones: its part comes along
            away = (ids[names] % self.model.parts - part) % self.model.parts
            blobs = [_zip_sorted(ids[names] // self.model.parts), _zip(away), _zip(hot[names].astype(np.int64)), _zip(np.diff(np.append(head, len(own))))]
            words = self.word_ids[g.word[own]]
            low = _zip_words(words, self.count[g.word[own]]) if n == 2 else [_zip(words), _zip(low_count[own])]
            yield part, self.batch, [*blobs, _zip(g.times[own]), *low]

    def scores(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By text: base score, known tokens, and the model's log10 probability."""
        model = self.model
        base = np.log10((self.count + 0.5) / (model.total + 0.5 * (model.types + 1)))[self.tokens]
        log = unigram_logs(self.count, model.total, model.seen)[self.tokens]
        for n, g in self.grams.items():
            there = np.flatnonzero(g.at >= 0)
            d, at = model.discount[n], g.at[there]
            with np.errstate(divide="ignore", invalid="ignore"):
                held = np.log10(d[np.minimum(g.count, MOST + 1)] * g.count / g.below[g.history])
            log[there] = np.where(g.count[at] > 0, held[at], g.backoff[g.history[at]] + log[there])
        add = lambda x: np.add.reduceat(x, self.starts)
        return add(base), add((self.count > 0)[self.tokens].astype(np.int64)), add(log)


def _each(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[_Batch]:
    for b in batches:
        for k in range(b.num_rows):
            yield _Batch(b.slice(k, 1).to_pylist()[0], model)


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows, as dicts, of each part; they come sorted by it."""
    rows = (b.slice(k, 1).to_pylist()[0] for b in batches for k in range(b.num_rows))
    for part, own in groupby(rows, itemgetter("part")):
        yield part, list(own)


def _ask_words(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                batch, words, counts = (b.column(c)[k].as_py() for c in range(3))
                words, counts = np.frombuffer(words, np.uint64), _unzip(counts)
                to = (words % np.uint64(parts)).astype(np.int64)
                order = np.lexsort((words, to))
                ends = np.searchsorted(to[order], np.arange(parts + 1))
                cut = [order[lo:hi] for lo, hi in zip(ends, ends[1:])]
                rows = [(p, batch, [_zip(np.diff(words[own], prepend=np.uint64(0))), _zip(counts[own])]) for p, own in enumerate(cut) if len(own)]
                yield _asked(rows)

    return run


def _tell_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers (counts, numbers), the part's table (hashes, counts by number), and its (tokens, types, counts of counts).

    Words are numbered by falling counts: common ones get small numbers, which take little room in n-grams.
    """
    for part, rows in _by_part(batches):
        asked = [_unzip_sorted(r["blobs"][0], signed=False).view(np.uint64) for r in rows]
        words, at = np.unique(np.concatenate(asked), return_inverse=True)
        total = np.bincount(at, np.concatenate([_unzip(r["blobs"][1]) for r in rows]), len(words)).astype(np.int64)
        by = np.argsort(-total, kind="stable")
        number = np.empty(len(by), np.int64)
        number[by] = np.arange(len(by))
        ends = np.cumsum([0, *map(len, asked)])
        for r, lo, hi in zip(rows, ends, ends[1:]):
            yield _told([(1, part, r["batch"], [_zip(total[at[lo:hi]]), _zip(number[at[lo:hi]])], None, None)])
        own = total[words != START]
        sums = [own.sum(), (own > 0).sum(), *((own == r).sum() for r in range(1, MOST + 2))]
        yield _told([(1, part, None, [words[by].tobytes(), _zip(total[by])], list(map(float, sums)), None)])


def _ask(n: int, model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _each(batches, model):
            rows = []
            for row in own.ask(n):
                rows.append(row)
                if len(rows) == 16:
                    yield _asked(rows)
                    rows = []
            del own  # before the next one is made
            if rows:
                yield _asked(rows)

    return run


def _tell(n: int, model: Model, last: bool):
    """Answers, the part's table (histories, sizes, words, counts), its counts of counts, and the sums of hot histories.

    An answer holds the counts, the n-grams' numbers (unless this order is the last), the least count after each history, and
    for histories that have to back off how many words follow 1..MOST times and the lower-order mass of all
    that follow, but for what all of it is divided by, which the batch knows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _by_part(batches):
            asked, histories, words, lows, hots, sizes_of = [], [], [], [], [], []
            for r in rows:
                x = r["blobs"]
                sizes = _unzip(x[3])
                names = _unzip_sorted(x[0]) * model.parts + (part + _unzip(x[1])) % model.parts
                word, low = _unzip_words(*x[5:]) if n == 2 else map(_unzip, x[5:])
                histories.append(np.repeat(names, sizes))
                hots.append(np.repeat(_unzip(x[2]), sizes))
                words.append(word)
                asked.append(_unzip(x[4]))
                lows.append(low)
                sizes_of.append(sizes)
                r["blobs"] = None
            history, word = np.concatenate(histories), np.concatenate(words)
            del histories, words
            order = _order(history, word)
            history, word = history[order], word[order]
            new = np.flatnonzero((np.diff(history, prepend=-1) != 0) | (np.diff(word, prepend=-1) != 0))
            at = np.empty(len(order), np.int64)
            at[order] = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(order))))
            history, word, lead = history[new], word[new], order[new]
            count = np.bincount(at, np.concatenate(asked), len(new)).astype(np.int64)
            low, warm = np.concatenate(lows)[lead], np.concatenate(hots)[lead]
            head = np.flatnonzero(np.diff(history, prepend=-1))
            sizes = np.diff(np.append(head, len(history)))
            owner = np.repeat(np.arange(len(head)), sizes)
            capped = np.minimum(count, MOST + 1)
            least = np.minimum.reduceat(np.where(count > 0, capped, MOST + 1), head)
            of = np.stack([np.bincount(owner[capped == r], minlength=len(head)) for r in range(1, MOST + 1)])
            lower = np.bincount(owner, np.where(count > 0, model.discount[n - 1][np.minimum(low, MOST + 1)] * low, 0.0), len(head))
            done = 0
            for r, n_of in zip(rows, sizes_of):
                first = np.cumsum(n_of) - n_of
                own = at[done : done + int(n_of.sum())]
                done += len(own)
                names = owner[own[first]]
                need = np.flatnonzero(np.minimum.reduceat(count[own], first) == 0)
                blobs = [_zip(count[own]), b"" if last else _zip_sorted(own), _zip(least[names]), _zip_sorted(need), _zip(of[:, names[need]].ravel()), lower[names[need]].astype("<f8").tobytes()]
                yield _told([(n, part, r["batch"], blobs, None, None)])
            hot = [[float(history[head[k]]), float(least[k]), *map(float, of[:, k]), float(lower[k])] for k in np.flatnonzero(warm[head]).tolist()]
            yield _told([(n, part, None, [_zip_sorted(history[head]), _zip(sizes), _zip(word), _zip(count)], [float((count == r).sum()) for r in range(1, MOST + 2)], hot)])

    return run


_OUT = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _each(batches, model):
            base, known, score = own.scores()
            columns = [pa.array(own.ids, pa.int64()), pa.array(~own.train), pa.array(own.sizes), pa.array(known), pa.array(np.full(len(own.ids), model.total), pa.int64()), pa.array(base), pa.array(score)]
            del own  # before the next one is made
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _OUT.split(", ")])

    return run


def katz_scores(docs: DataFrame, learns, order: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``; the model, of n-grams up to ``order`` words, learns from those where the Column ``learns`` holds.

    ``(id, held_out, n_tokens, n_known, train_tokens, base_score, score)``
    """
    spark = docs.sparkSession
    texts = small_batches(docs).select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"), F.coalesce(learns, F.lit(False)).alias("train"))
    kept = _Tables(spark)
    try:
        batches = kept.bucketed(texts.mapInArrow(_batches, _BATCH), "batch")
        model, tables = ngram_tables(batches, order, kept)
        return stored(_answered(batches, tables).mapInArrow(_score(model), _OUT))
    finally:
        kept.drop()


class _Tables:
    """Tables in the warehouse, bucketed by batch: answers are brought to their batches once and then neither is shuffled again."""

    def __init__(self, spark: SparkSession):
        self.spark, self.names = spark, []

    def bucketed(self, df: DataFrame, key: str) -> DataFrame:
        self.names.append(f"katz_{uuid.uuid4().hex}")
        df.write.bucketBy(int(self.spark.conf.get("spark.sql.shuffle.partitions")), key).saveAsTable(self.names[-1])
        return self.spark.table(self.names[-1])

    def told(self, df: DataFrame, last: bool = False) -> DataFrame:
        """Answers go to their batches; the parts' own rows are dealt out. The last order's answers are read only once, so they go later."""
        df = df.withColumn("to", F.coalesce("batch", -1 - F.col("part")))
        if last:
            return stored(df)
        return self.bucketed(df.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "to"), "to")

    def drop(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def _answered(batches: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """Batches with the answers of all orders so far, in order of the parts."""
    for n, table in enumerate(tables, 1):
        told = table.where("batch is not null").groupBy("to").agg(F.sort_array(F.collect_list(F.struct("part", "blobs"))).alias(f"told{n}"))
        batches = batches.join(told, batches["batch"] == told["to"], "left").drop("to")
    return batches


def ngram_tables(batches: DataFrame, order: int, kept: _Tables) -> tuple[Model, list[DataFrame]]:
    """The model, and for each order a stored table: answers by batch, and a row for each part of the n-gram table (batch null).

    A part's row holds, compressed, the histories (ids that the order below gave out), how many words follow each,
    the words' ids and the counts; an n-gram's own id is its place in the row times the number of parts, plus the part.
    """
    spark = batches.sparkSession
    parts = max(4, -(-(batches.agg(F.sum("n")).first()[0] or 0) // PART_TOKENS))
    placed = lambda asked: asked.repartition(parts, "part").sortWithinPartitions("part", "batch")
    tables = [kept.told(placed(batches.select("batch", "words", "counts").mapInArrow(_ask_words(parts), _ASK)).mapInArrow(_tell_words, _TOLD), order == 1)]
    added = lambda n, size: [int(x or 0) for x in tables[n - 1].where("sums is not null").select([F.sum(F.col("sums")[k]) for k in range(size)]).first()]
    total, types, *of = added(1, MOST + 3)
    model = Model(parts, total, types, np.array([0, *of]))
    for n in range(2, order + 1):
        drop_shuffles(spark)  # of the order below: its answers are a table now
        tables.append(kept.told(placed(_answered(batches, tables).mapInArrow(_ask(n, model), _ASK)).mapInArrow(_tell(n, model, n == order), _TOLD), n == order))
        # at most HOT histories, each in as many rows as there are parts: added up before they move
        hot = tables[-1].where("sums is not null").select(F.explode("hot").alias("h")).groupBy(F.col("h")[0].alias("id"))
        hot = hot.agg(F.min(F.col("h")[1]), *[F.sum(F.col("h")[k]) for k in range(2, MOST + 3)]).collect()
        model.learn(n, np.array([0, *added(n, MOST + 1)]), {int(r[0]): np.array(r[1:], float) for r in hot})
    drop_shuffles(spark)
    return model, tables
