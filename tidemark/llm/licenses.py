"""License scans with a positional rare-token index.

The index has postings of the templates' words: word -> (template, place). A file's licence words are looked up by falling IDF over
the whole corpus. A word at place p of the file that a template has at place i gives the offset p - i. Each further word
of the template, by falling IDF too, is intersected with the offsets by its relative position; an offset goes once so many
words were missed that the rest can't reach the share that must agree. As that many words may be missed, only the rarest ones
of a template, one more than may be missed, begin an offset, so common words are never looked up on their own.

Around an offset words may stand some places earlier or later (a band, a fifth of the template's length), in order, so
that inserted and dropped words don't lose a licence. What is left is verified: the mandatory phrases must stand, the first
of them at the offset, the others in the band, and the longest common subsequence in the band must be large enough. Of
alignments of different licences, one inside a longer one goes (MIT in MIT-0).
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import table
from tidemark.llm.tokens import parts

# Phrases and the labels of the places where they stand.
BASE = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Public licences by their short identifiers, with names that are used for them. A name stands word by word.
NAMES = {
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD"],
    "AFL-3.0": ["Academic Free License version 3.0", "Academic Free License v3.0"],
    "AGPL-3.0": ["GNU Affero General Public License version 3", "GNU Affero General Public License v3", "AGPLv3", "AGPL v3", "AGPL-3.0"],
    "Apache-1.1": ["Apache Software License, Version 1.1", "Apache License 1.1"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache License v2.0", "Apache Software License 2.0", "Apache 2.0 License", "Apache-2.0"],
    "Artistic-2.0": ["Artistic License 2.0", "Artistic License, Version 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "FreeBSD License", "BSD-2-Clause"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License", "Revised BSD License", "BSD-3-Clause"],
    "BSD-4-Clause": ["BSD 4-Clause License", "4-Clause BSD License", "Original BSD License"],
    "BSL-1.0": ["Boost Software License - Version 1.0", "Boost Software License 1.0", "Boost Software License, Version 1.0"],
    "CC0-1.0": ["CC0 1.0 Universal", "CC0 1.0", "Creative Commons Zero v1.0", "CC0 Public Domain Dedication"],
    "CDDL-1.0": ["Common Development and Distribution License 1.0", "Common Development and Distribution License (CDDL) Version 1.0"],
    "CECILL-2.1": ["CeCILL Free Software License Agreement v2.1", "CeCILL 2.1"],
    "CPL-1.0": ["Common Public License Version 1.0", "Common Public License 1.0"],
    "ECL-2.0": ["Educational Community License, Version 2.0", "Educational Community License 2.0"],
    "EPL-1.0": ["Eclipse Public License - v 1.0", "Eclipse Public License v1.0", "Eclipse Public License 1.0", "Eclipse Public License, Version 1.0"],
    "EPL-2.0": ["Eclipse Public License - v 2.0", "Eclipse Public License v2.0", "Eclipse Public License 2.0", "Eclipse Public License, Version 2.0"],
    "EUPL-1.1": ["European Union Public Licence v. 1.1", "EUPL v1.1", "European Union Public Licence 1.1"],
    "EUPL-1.2": ["European Union Public Licence v. 1.2", "EUPL v1.2", "European Union Public Licence 1.2"],
    "GFDL-1.3": ["GNU Free Documentation License, Version 1.3", "GNU Free Documentation License 1.3"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2", "GNU General Public License (GPL) version 2", "GNU GPL version 2", "GNU GPL v2", "GPLv2", "GPL v2", "GPL version 2", "GPL-2.0"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3", "GNU General Public License (GPL) version 3", "GNU GPL version 3", "GNU GPL v3", "GPLv3", "GPL v3", "GPL version 3", "GPL-3.0"],
    "ISC": ["ISC License"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "LGPLv2.1", "LGPL v2.1", "LGPL 2.1", "LGPL-2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3", "LGPLv3", "LGPL v3", "LGPL-3.0"],
    "LPPL-1.3c": ["LaTeX Project Public License, version 1.3c", "LaTeX Project Public License"],
    "MIT": ["MIT License", "MIT Licence", "MIT Public License", "Expat License", "license: MIT"],
    "MIT-0": ["MIT No Attribution", "MIT-0 License"],
    "MPL-1.1": ["Mozilla Public License Version 1.1", "Mozilla Public License 1.1", "MPL 1.1"],
    "MPL-2.0": ["Mozilla Public License, v. 2.0", "Mozilla Public License Version 2.0", "Mozilla Public License 2.0", "Mozilla Public License v2.0", "MPL 2.0", "MPL-2.0"],
    "MS-PL": ["Microsoft Public License"],
    "MS-RL": ["Microsoft Reciprocal License"],
    "MulanPSL-2.0": ["Mulan Permissive Software License, Version 2", "Mulan PSL v2"],
    "NCSA": ["University of Illinois/NCSA Open Source License"],
    "ODbL-1.0": ["Open Database License (ODbL) v1.0", "Open Database License"],
    "OFL-1.1": ["SIL Open Font License, Version 1.1", "SIL Open Font License 1.1", "SIL OFL 1.1"],
    "OSL-3.0": ["Open Software License version 3.0", "Open Software License v. 3.0", "Open Software License 3.0"],
    "PostgreSQL": ["PostgreSQL License"],
    "PSF-2.0": ["Python Software Foundation License Version 2", "Python Software Foundation License"],
    "Unlicense": ["The Unlicense", "unlicense.org"],
    "UPL-1.0": ["Universal Permissive License v1.0", "Universal Permissive License (UPL), Version 1.0", "Universal Permissive License 1.0"],
    "Vim": ["Vim License"],
    "W3C": ["W3C Software Notice and License", "W3C Software and Document Notice and License"],
    "WTFPL": ["Do What The Fuck You Want To Public License"],
    "Zlib": ["zlib License", "zlib/libpng License"],
    "ZPL-2.1": ["Zope Public License (ZPL) Version 2.1", "Zope Public License Version 2.1", "Zope Public License 2.1"],
}

# The parts of Creative Commons licences, in the orders that exist, and their versions.
CC_PARTS = ["BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND"]
CC_NAMES = {"BY": "Attribution", "SA": "ShareAlike", "ND": "NoDerivatives", "NC": "NonCommercial"}
CC_VERSIONS = ["2.0", "2.5", "3.0", "4.0"]

# Sentences that grant or disclaim, with the phrases that must stand in each.
GRANTS = {
    "mit": [(
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        ["permission is hereby granted free of charge", "without restriction"],
    )],
    "bsd": [(
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
        ["redistribution and use in source and binary forms", "following conditions are met"],
    )],
    "isc": [(
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted",
        ["with or without fee is hereby granted"],
    )],
    "mpl-2.0": [(
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        ["mozilla public license v 2 0"],
    )],
    "gpl-2.0": [(
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any "
        "later version",
        ["gnu general public license", "version 2 of the license"],
    )],
    "gpl-3.0": [(
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version",
        ["gnu general public license", "version 3 of the license"],
    )],
    "agpl-3.0": [(
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version",
        ["gnu affero general public license", "version 3 of the license"],
    )],
    "lgpl-2.1": [(
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your "
        "option) any later version",
        ["gnu lesser general public license", "version 2 1 of the license"],
    )],
    "apache-2.0": [(
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
        ["apache org licenses license 2 0"],
    )],
    "unlicense": [("This is free and unencumbered software released into the public domain", ["free and unencumbered software"])],
    "cc0-1.0": [("To the extent possible under law, the author has waived all copyright and related rights", ["waived all copyright and related"])],
    "zlib": [(
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software",
        ["provided as is without any express or implied warranty", "authors be held liable"],
    )],
    "bsl-1.0": [(
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
        "accompanying documentation covered by this license",
        ["permission is hereby granted free of charge", "accompanying documentation covered by this license"],
    )],
}


def _templates() -> dict[str, list[tuple[str, list[str]]]]:
    """By label (the identifier in lower case): names, identifiers after the usual tag, Creative Commons names, grants."""
    names = {k: list(v) for k, v in NAMES.items()}
    for kind in CC_PARTS:
        for version in CC_VERSIONS:
            long = "-".join(CC_NAMES[p] for p in kind.split("-"))
            names[f"CC-{kind}-{version}"] = [f"CC {kind} {version}", f"Creative Commons {long} {version}", f"creativecommons.org/licenses/{kind.lower()}/{version}"]
    out = {k.lower(): [(t, [t]) for t in [*v, f"SPDX-License-Identifier: {k}"]] for k, v in names.items()}
    for label, grants in GRANTS.items():
        out.setdefault(label, []).extend(grants)
    return out


#: Alternatives of wording for each label: the words, and the phrases that must stand in them.
TEMPLATES = _templates()

#: Share of a template's words that must agree at an alignment.
AGREE = 0.75
#: How many words of a template give one word of the band's width.
BAND_WORDS = 5

#: A-Z become a-z; other ASCII characters that aren't letters or digits become spaces; the rest of UTF-8 stays.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def words(text: str) -> list[bytes]:
    return text.encode().translate(_FOLD).split()


@dataclass
class Scan:
    """What a file holds: its words, the places of the base phrases with their label, and the alignments."""

    n_words: int
    base: list[tuple[int, str]]
    found: dict[str, float]
    places: dict[str, int]


class Index:
    """Postings of the templates' words, with the words' IDF over a corpus."""

    def __init__(self, document_frequency: dict[bytes, int], documents: int, templates: dict = TEMPLATES, base: dict = BASE):
        every = [(label, words(text), [words(p) for p in must]) for label, wordings in templates.items() for text, must in wordings]
        self.labels, self.templates, self.phrases = (list(x) for x in zip(*every)) if every else ([], [], [])
        self.base = [(words(p), label) for p, label in base.items()]
        self.vocabulary = frozenset(x for p in [*self.templates, *(p for p, _ in self.base)] for x in p)
        self.idf = {x: math.log((1 + documents) / (1 + document_frequency.get(x, 0))) for x in self.vocabulary}
        rare = lambda x: (-self.idf[x], x)
        self.heads: dict[bytes, list[tuple[list[bytes], str]]] = defaultdict(list)
        for p, label in self.base:
            self.heads[min(p, key=rare)].append((p, label))
        self.by_idf = {x: n for n, x in enumerate(sorted(self.vocabulary, key=rare))}
        self.musts = [frozenset(x for p in must for x in p) for must in self.phrases]
        self.slack = [len(t) - math.ceil(AGREE * len(t)) for t in self.templates]
        #: Of each template the places of its words by falling IDF; the first slack + 1 begin offsets and are posted.
        self.order = [sorted(range(len(t)), key=lambda i, t=t: (self.by_idf[t[i]], i)) for t in self.templates]
        self.postings: dict[bytes, set[int]] = defaultdict(set)
        for k, (t, order) in enumerate(zip(self.templates, self.order)):
            for i in order[: self.slack[k] + 1]:
                self.postings[t[i]].add(k)

    def scan(self, text: str) -> Scan:
        w = words(text)
        here = self.vocabulary.intersection(w)
        if not here:
            return Scan(len(w), [], {}, {})
        met = {k for x in sorted(here, key=self.by_idf.get) if x in self.postings for k in self.postings[x] if self.musts[k] <= here}
        wanted = {x for k in met for x in self.templates[k]} | {x for x in here if x in self.heads}
        places: dict[bytes, list[int]] = defaultdict(list)
        for i, x in enumerate(w):
            if x in wanted:
                places[x].append(i)
        found = [x for k in sorted(met) for x in self._alignments(w, k, places)]
        return Scan(len(w), self._base(w, places), *best_alignments(found))

    def _base(self, w: list[bytes], places: dict[bytes, list[int]]) -> list[tuple[int, str]]:
        """Every place where a base phrase stands, found from its rarest word."""
        got = set()
        for x, phrases in self.heads.items():
            for phrase, label in phrases:
                at = phrase.index(x)
                for i in places.get(x, ()):
                    if i >= at and w[i - at : i - at + len(phrase)] == phrase:
                        got.add((i - at, label))
        return sorted(got)

    def offsets(self, k: int, places: dict[bytes, list[int]]) -> set[int]:
        """Offsets at which enough words of a template may stand: postings intersected by relative position."""
        t, slack, reach = self.templates[k], self.slack[k], 2 * band(self.templates[k])
        missed: dict[int, int] = {}
        for n, i in enumerate(self.order[k]):
            own = places.get(t[i], [])
            for o in list(missed):
                at = bisect_left(own, o + i - reach)
                if at == len(own) or own[at] > o + i + reach:
                    missed[o] += 1
                    if missed[o] > slack:
                        del missed[o]
            if n <= slack:
                for p in own:
                    missed.setdefault(p - i, n)
            elif not missed:
                break
        return set(missed)

    def _alignments(self, w: list[bytes], k: int, places: dict[bytes, list[int]]) -> Iterator[tuple[str, float, int, int]]:
        """(label, share of words that agree, first place, end) of a template's alignments."""
        t, (first, *others), width = self.templates[k], self.phrases[k], band(self.templates[k])
        near = {o + d for o in self.offsets(k, places) for d in range(-width, width + 1)}
        for at in sorted(near):
            if self._stands(w, t, first, at) and all(self._stands(w, t, p, at, width) for p in others):
                agree = 1.0 if len(first) == len(t) else agreeing(w, t, at, width) / len(t)
                if agree >= AGREE:
                    yield self.labels[k], agree, at, at + len(t)

    @staticmethod
    def _stands(w, t, phrase, at, width=0) -> bool:
        """Whether a phrase stands in the file where the template has it, or up to ``width`` words from there."""
        n = len(phrase)
        return any(
            w[j : j + n] == phrase
            for i in range(len(t)) if t[i : i + n] == phrase
            for j in range(max(0, at + i - width), at + i + width + 1)
        )


def best_alignments(found: list[tuple[str, float, int, int]]) -> tuple[dict[str, float], dict[str, int]]:
    """By label the largest share and where that alignment starts, the first of equal ones; alignments inside a longer one of another
    label are left out."""
    best: dict[str, tuple[float, int]] = {}
    reach: dict[str, int] = {}  # by label how far its alignments go that begin no later
    for (at, end), group in groupby(sorted(found, key=lambda x: (x[2], -x[3])), key=lambda x: x[2:]):
        same = list(group)
        for label, agree, *_ in same:
            if not any(far >= end and other != label for other, far in reach.items()):
                best[label] = max(best.get(label, (0.0, -at)), (agree, -at))
        for label, *_ in same:
            reach[label] = max(end, reach.get(label, end))
    return {k: a for k, (a, _) in best.items()}, {k: -at for k, (_, at) in best.items()}


def band(template: list[bytes]) -> int:
    """How far a word may stand from where the offset puts it."""
    return len(template) // BAND_WORDS


def agreeing(w: list[bytes], t: list[bytes], at: int, width: int) -> int:
    """Most words of a template that stand in the file in order, each up to ``width`` words from its place at ``at``."""
    best = [0] * (2 * width + 2)  # by distance from the place; the last is beyond the band
    for i, x in enumerate(t):
        last = 0
        for d in range(2 * width + 1):
            j = at + i + d - width
            same = 0 <= j < len(w) and w[j] == x
            last = best[d] = max(last, best[d + 1], best[d] + same)
    return max(best)


def document_frequency(docs: DataFrame, text_col: str = "text") -> tuple[dict[bytes, int], int]:
    """In how many documents each licence word stands, and how many documents there are, over all rows.

    A row per word of the templates, whose number is fixed, comes to the driver.
    """
    vocabulary = Index({}, 0).vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in parts(batches, 0):
            seen[b""] += b.num_rows
            for t in b.column(0).to_pylist():
                if t:
                    seen.update(vocabulary.intersection(words(t)))
        yield pa.record_batch(
            [pa.array([x.decode() for x in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"]
        )

    rows = docs.select(text_col).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r["word"].encode(): r["n"] for r in rows}
    return found, found.pop(b"", 0)


SCHEMA = (
    "doc_id long, n_words long, base array<struct<word:long,label:string>>, "
    "alignments array<struct<label:string,word:long,share:double>>"
)


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, base (every place of a base phrase), alignments (templates that stand in the text).

    Whole texts are scanned; null counts as empty and has no words. Null ids stay null, repeated rows stay repeated.
    An empty table gives no rows. Of several alignments of a template the one with the largest share, then
    the first, is given. Other columns are not read.
    """
    index = docs.sparkSession.sparkContext.broadcast(Index(*document_frequency(docs, text_col)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base_type = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
        aligned_type = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("share", pa.float64())]))
        for b in parts(batches, 1):
            got = [index.value.scan(t or "") for t in b.column(1).to_pylist()]
            base = [[{"word": i, "label": x} for i, x in s.base] for s in got]
            aligned = [[{"label": k, "word": s.places[k], "share": a} for k, a in sorted(s.found.items())] for s in got]
            yield pa.record_batch(
                [b.column(0), pa.array([s.n_words for s in got], pa.int64()), pa.array(base, base_type), pa.array(aligned, aligned_type)],
                names=["doc_id", "n_words", "base", "alignments"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def op1_licenses(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document.

    score is 1 where a base phrase stands, else the largest share of a template's words that agree, else 0. Null text has no
    words; null ids are kept, repeated rows stay repeated, an empty table has no rows.
    """
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    base, aligned = F.col("base.label"), F.col("alignments.label")
    share = F.coalesce(F.array_max("alignments.share"), F.lit(0.0))
    return scan_licenses(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.word").alias("first_word"),
        F.array_max("base.word").alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.concat(base, aligned)).alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(share).alias("score"),
    )
