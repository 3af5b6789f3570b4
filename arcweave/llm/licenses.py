"""License scan with a positional rare-token index.

Templates are licence texts and the short notices that stand for them; in each some key phrases are
mandatory. The index holds the positions of the words of those phrases. For each file its licence words are
looked up from the highest inverse document frequency (counted over all documents) down. The
first word of a template gives the places where the template would have to begin, the next ones are
intersected with them by relative position; a template that lacks one of its words in the file is never
placed. At each place that is left the key phrases must stand word for word, and the share (by inverse
document frequency) of template words found in place is the score. Base phrases are templates
that must match in full.

Defined results: a null text is empty; a text without words has no labels, places or score (0.0);
repeated rows and null ids are scanned like any other row; ties of rarity go by the word itself.
Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

# The word pattern, the base phrases, and the public texts and notices below.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
_NO_WARRANTY = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose"
_BSD_HEAD = "[redistribution and use in source and binary forms] with or without modification [are permitted] provided that the following conditions are met"
_BSD_TERMS = (
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
    " redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
)
#: label -> whole texts and notices; the words in brackets are the mandatory key phrases.
NOTICES = {
    "apache-2.0": [
        "licensed under the [apache license version 2 0]",
        "you may obtain a copy of the license at http www [apache org licenses] license 2 0",
        "licensed under the [apache license version 2 0] the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www [apache org licenses] license 2 0"
        " unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"
        " see the license for the specific language governing permissions and limitations under the license",
    ],
    "bsd": [
        _BSD_HEAD,
        f"{_BSD_HEAD} 1 {_BSD_TERMS.replace(' redistributions in', ' 2 redistributions in')}",
        f"{_BSD_HEAD} {_BSD_TERMS} neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ],
    "bsl-1.0": [
        "[boost software license version 1 0]",
        "[permission is hereby granted free of charge to any person or organization] obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software",
    ],
    "cc-by": ["licensed under [cc by] 4 0", "licensed under the [creative commons attribution] 4 0 international license"],
    "cc-by-nc": ["licensed under [cc by nc] 4 0", "licensed under the [creative commons attribution noncommercial] 4 0 international license"],
    "cc-by-sa": ["licensed under [cc by sa] 4 0", "licensed under the [creative commons attribution sharealike] 4 0 international license"],
    "cc0": ["[cc0 1 0] universal public domain dedication", "to the extent possible under law the author has [waived all copyright]"],
    "gpl-2.0": [
        "licensed under the gnu [general public license version 2]",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu [general public license] as published by the free software foundation either [version 2] of the license or at your option any later version",
    ],
    "gpl-3.0": [
        "licensed under the gnu [general public license version 3]",
        "under the terms of the gnu [general public license] as published by the free software foundation either [version 3] of the license",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu [general public license] as published by the free software foundation either [version 3] of the license or at your option any later version"
        " this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
    ],
    "isc": [
        "[permission to use copy modify and or distribute this software] for any purpose with or without fee is hereby granted",
        "[permission to use copy modify and or distribute this software] for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"
        " the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"
        " in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits"
        " whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ],
    "lgpl": [
        "licensed under the gnu [lesser general public license]",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu [lesser general public license] as published by the free software foundation",
    ],
    "mit": [
        "released under the [mit license]",
        "[permission is hereby granted free of charge] to any person obtaining a copy of this software",
        "[permission is hereby granted free of charge] to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"
        " and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"
        f" {_NO_WARRANTY} and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ],
    "mpl-2.0": [
        "this source code form is subject to the terms of the [mozilla public license] v 2 0",
        "this source code form is subject to the terms of the [mozilla public license] v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    ],
    "proprietary": ["[all rights reserved] unauthorized copying of this file via any medium is strictly prohibited"],
    "unlicense": [
        "this is free and unencumbered software [released into the public domain]",
        "this is free and unencumbered software [released into the public domain] anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    ],
    "zlib": [
        "[this software is provided as is without any express or implied warranty in no event will the authors be held liable] for any damages arising from the use of this software"
        " permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    ],
}


def words_of(text: str | None) -> list[str]:
    """Words of a text; only A-Z are lower-cased."""
    return _find((text or "").encode().lower().decode())  # on bytes, lower() leaves all but A-Z alone


_find = re.compile(WORD).findall


def _template(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Words of a notice and the (start, stop) of its key phrases."""
    words, phrases, start = [], [], None
    for part in text.split():
        if part.startswith("["):
            start = len(words)
        words.append(part.strip("[]"))
        if part.endswith("]"):
            phrases.append((start, len(words)))
    return words, phrases


class Index:
    """Postings word -> [(template, position)] of the words of mandatory phrases, given document frequencies."""

    def __init__(self, notices: dict[str, list[str]], base: dict[str, str], documents: int, frequency: dict[str, int], rarest: int = 4, least_share: float = 0.7):
        self.rarest, self.least_share = rarest, least_share
        self.templates = [(label, *_template(n), False) for label, many in sorted(notices.items()) for n in many]
        self.templates += [(label, *_template(f"[{phrase}]"), True) for phrase, label in sorted(base.items())]
        self.idf = {w: math.log((documents + 1) / (frequency.get(w, 0) + 1)) for t in self.templates for w in t[1]}
        self.postings: dict[str, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        self.mandatory = []
        for k, (_, words, phrases, _) in enumerate(self.templates):
            for a, b in phrases:
                for p in range(a, b):
                    self.postings[words[p]][k].append(p)
            self.mandatory.append({w for a, b in phrases for w in words[a:b]})
        self.order = {w: at for at, w in enumerate(sorted(self.postings, key=lambda w: (-self.idf[w], w)))}
        self.postings = {w: dict(own) for w, own in self.postings.items()}

    def places(self, words: list[str]) -> dict[int, set[int]]:
        """template -> where it may begin: the file's licence words, highest inverse document frequency first, intersected by relative position."""
        at: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            if w in self.postings:
                at.setdefault(w, []).append(i)
        out: dict[int, set[int]] = {}
        looked: Counter = Counter()
        for w in sorted(at, key=self.order.__getitem__):
            for k, positions in self.postings[w].items():
                if looked[k] == self.rarest or (k in out and not out[k]) or not self.mandatory[k] <= at.keys():
                    continue
                looked[k] += 1
                starts = {i - p for i in at[w] for p in positions if i >= p}
                out[k] = out[k] & starts if k in out else starts
        return out

    def scan(self, words: list[str]) -> tuple[list[int], set[str], set[str], float]:
        """Base places, base labels, labels of the method, best score."""
        found, base, labels, best = [], set(), set(), 0.0
        for k, starts in self.places(words).items():
            label, own, phrases, exact = self.templates[k]
            for at in starts:
                if not all(words[at + a : at + b] == own[a:b] for a, b in phrases):
                    continue
                if exact:
                    found.append(at)
                    base.add(label)
                    best = 1.0
                    continue
                share = sum(self.idf[w] for w, x in zip(own, words[at : at + len(own)]) if w == x) / (sum(self.idf[w] for w in own) or 1.0)
                if share >= self.least_share:
                    labels.add(label)
                    best = max(best, share)
        return found, base, labels, min(best, 1.0)


def _frequency(vocabulary: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            seen[""] += batch.num_rows
            for text in batch.column(0):
                seen.update(vocabulary.intersection(words_of(text.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    return run


def license_scan(docs: DataFrame, notices: dict[str, list[str]] = NOTICES, base: dict[str, str] = BASE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, n_words, n_base, first_word, last_word, base_labels, labels, score)`` for each row."""
    texts = small_batches(docs).select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    vocabulary = frozenset(w for many in notices.values() for n in many for w in _template(n)[0]) | {w for p in base for w in p.split()}
    # as many rows as the templates have words
    counted = texts.select("text").mapInArrow(_frequency(vocabulary), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    frequency = {r["word"]: r["n"] for r in counted}
    index = Index(notices, base, frequency.pop("", 0), frequency)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                words = words_of(text.as_py())
                places, own, more, score = index.scan(words)
                rows.append((len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(own)), ",".join(sorted(own | more)), score))
            columns = list(zip(*rows)) if rows else [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["id", *names])

    return texts.mapInArrow(run, "id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
