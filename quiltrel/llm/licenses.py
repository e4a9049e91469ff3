"""License scan: a positional rare-token index over licence templates.

Each text is handled on its own inside Arrow batches: one scan, no shuffle. Null is the empty
text. The index is built from the fixed TEMPLATES below, so it has a constant size. Of each
template it proposes by the rarest words, as many as it takes that the rest alone weigh too
little to match: no alignment that would match is left out. Words may be put in or left out
between a template's words: each counts that stands within GAP words of its place.

A text without words has counts 0. Of ties the highest coverage counts. Whole texts are searched
however long; repeated rows give equal results; other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltrel.llm.common import text_or_empty

#: Over UTF-8 bytes with A-Z lowered: bytes from 80 up are word characters, as all code points
#: from U+0080 up are. Translate every other byte to a space and split.
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)

BASE = ((b"mit license", "mit"), (b"apache license", "apache"), (b"general public license", "gpl"))

#: label -> (template, phrases of which every one must stand in the text)
TEMPLATES: dict[str, tuple[str, tuple[str, ...]]] = {
    "apache-2.0": (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance"
        " with the license",
        ("apache license version 2 0",),
    ),
    "mit": (
        "mit license permission is hereby granted free of charge to any person obtaining a copy of this software and"
        " associated documentation files to deal in the software without restriction",
        ("permission is hereby granted free of charge", "deal in the software without restriction"),
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby"
        " granted provided that the above copyright notice and this permission notice appear in all copies",
        ("for any purpose with or without fee",),
    ),
    "bsd-3-clause": (
        "redistribution and use in source and binary forms with or without modification are permitted neither the name"
        " of the copyright holder nor the names of its contributors may be used to endorse or promote products",
        ("redistribution and use in source and binary forms", "endorse or promote products"),
    ),
    "bsd-2-clause": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that"
        " the following conditions are met",
        ("redistribution and use in source and binary forms",),
    ),
    "gpl-2.0": (
        "under the terms of the gnu general public license as published by the free software foundation version 2",
        ("gnu general public license", "version 2"),
    ),
    "gpl-3.0": (
        "under the terms of the gnu general public license as published by the free software foundation version 3",
        ("gnu general public license", "version 3"),
    ),
    "lgpl": (
        "under the terms of the gnu lesser general public license as published by the free software foundation",
        ("lesser general public license",),
    ),
    "agpl-3.0": (
        "under the terms of the gnu affero general public license as published by the free software foundation",
        ("affero general public license",),
    ),
    "mpl-2.0": (
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        ("mozilla public license v 2 0",),
    ),
    "cc-by-nc-4.0": ("licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    "cc-by-sa-4.0": ("licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    "cc-by-4.0": ("licensed under cc by 4 0", ("cc by 4 0",)),
    "cc0-1.0": ("cc0 1 0 universal public domain dedication", ("cc0 1 0",)),
    "unlicense": (
        "this is free and unencumbered software released into the public domain",
        ("free and unencumbered software",),
    ),
    "bsl-1.0": (
        "boost software license version 1 0 permission is hereby granted free of charge",
        ("boost software license version 1 0",),
    ),
    "zlib": (
        "this software is provided as is without any express or implied warranty in no event will the authors be held"
        " liable for any damages arising from the use of this software",
        ("in no event will the authors be held liable",),
    ),
    "epl-2.0": (
        "this program and the accompanying materials are made available under the terms of the eclipse public license"
        " 2 0",
        ("eclipse public license 2 0",),
    ),
}
LEAST = 0.6  # share of a template's IDF weight that must stand about one relative position
GAP = 8


class Index:
    """rare word of a template -> [(template, position)], with the IDF of each word over the templates."""

    def __init__(self, templates: dict[str, tuple[str, tuple[str, ...]]] = TEMPLATES):
        self.words = {k: t.encode().split() for k, (t, _) in templates.items()}
        self.needs = {k: [p.encode() for p in ps] for k, (_, ps) in templates.items()}
        seen = Counter(w for ws in self.words.values() for w in set(ws))
        self.idf = {w: math.log((1 + len(templates)) / n) for w, n in seen.items()}
        self.weight = {k: sum(self.idf[w] for w in ws) for k, ws in self.words.items()}
        # the mandatory phrases decide; alignment tells a template's text from words that only share it,
        # and of a long template a shortened notice is enough
        self.least = {k: LEAST if len(ws) <= 12 else LEAST / 2 for k, ws in self.words.items()}
        self.postings: dict[bytes, list[tuple[str, int]]] = defaultdict(list)
        for k, ws in self.words.items():
            rest = self.weight[k]
            for w in sorted(set(ws), key=lambda w: (-self.idf[w], w)):
                if rest < self.least[k] * self.weight[k] - 1e-9:
                    break
                rest -= self.idf[w] * ws.count(w)
                self.postings[w] += [(k, i) for i, v in enumerate(ws) if v == w]
        #: one of these stands in every text that a template can match
        self.gate = sorted({max(p.split(), key=lambda w: self.idf.get(w, 0)) for ps in self.needs.values() for p in ps[:1]})

    def match(self, words: list[bytes], flat: bytes) -> dict[str, float]:
        """label -> coverage in 0 to 1 of every template found."""
        allowed = {k for k in self.words if self._needed(k, flat)}
        out: dict[str, float] = {}
        if not allowed:
            return out
        tried: set[tuple[str, int]] = set()
        inside = {w for k in allowed for w in self.words[k]}
        places: dict[bytes, list[int]] = defaultdict(list)
        for at, w in enumerate(words):
            if w in inside:
                places[w].append(at)

        def stands(w: bytes, at: int) -> bool:
            own = places.get(w, ())
            i = bisect_left(own, at - GAP)
            return i < len(own) and own[i] <= at + GAP

        for at, w in enumerate(words):  # intersect: each posting proposes about where its template would start
            for k, i in self.postings.get(w, ()):
                for start in range(at - i - GAP, at - i + GAP + 1) if k in allowed else ():
                    if (k, start) in tried:
                        continue
                    tried.add((k, start))
                    got = sum(self.idf[v] for j, v in enumerate(self.words[k]) if stands(v, start + j))
                    share = got / self.weight[k]
                    if share >= self.least[k] and share > out.get(k, 0):
                        out[k] = share
        return out

    def _needed(self, label: str, flat: bytes) -> bool:
        return all(b" " + p + b" " in flat for p in self.needs[label])


def places(words: list[bytes]) -> list[tuple[int, str]]:
    """(start word, label) of every base phrase."""
    out = []
    for phrase, label in BASE:
        parts = phrase.split()
        out += [(i, label) for i, w in enumerate(words) if w == parts[0] and words[i : i + len(parts)] == parts]
    return sorted(out)


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string,"
    " score double"
)


def scan(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> SCHEMA. A text without words has counts 0, nulls and empty labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index()
        gate = re.compile(b"|".join([b"license", *map(re.escape, index.gate)]))
        for batch in batches:
            out = []
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                low = raw.translate(_TABLE)
                words = low.split()
                base, got = [], {}
                if gate.search(low):
                    flat = b" " + b" ".join(words) + b" "
                    base, got = places(words), index.match(words, flat)
                labels = {x for _, x in base}
                out.append(
                    (doc, len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None,
                     ",".join(sorted(labels)), ",".join(sorted(labels | set(got))),
                     min(1.0, max([0.5 * bool(base), *got.values()])))
                )
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True)] if out else [pa.array([], t) for t in _TYPES],
                names=_NAMES,
            )

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().cast("binary").alias("raw")).mapInArrow(run, SCHEMA)


_NAMES = [x.split()[0] for x in SCHEMA.split(",")]
_TYPES = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[x.split()[1]] for x in SCHEMA.split(",")]
