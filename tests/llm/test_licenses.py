import random
import re

import pytest

from tidemark.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ALL = [(label, text, must) for label, wordings in licenses.TEMPLATES.items() for text, must in wordings]
GRANTS = [x for x in ALL if x[1:] not in [(t, [t]) for _, t, _ in ALL]]


def split(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def base_of(w):
    phrases = [(p.split(), label) for p, label in licenses.BASE.items()]
    return sorted((i, label) for p, label in phrases for i in range(len(w)) if w[i : i + len(p)] == p)


def alignments(w):
    """(label, share, start, end) straight from the definition: every offset of every wording, longest common subsequences in the
    band about it."""
    out = []
    for label, text, must in ALL:
        t = split(text)
        width = len(t) // licenses.BAND_WORDS
        first, *others = [[(p, i) for i in range(len(t)) if t[i : i + len(p)] == p] for p in map(split, must)]
        stands = lambda p, j: j >= 0 and w[j : j + len(p)] == p
        for at in sorted({j - i for p, i in first for j in range(len(w)) if w[j] == p[0] and stands(p, j)}):
            if not all(any(stands(p, at + i + d) for p, i in o for d in range(-width, width + 1)) for o in others):
                continue
            rows = [[0] * (len(w) + 1)]
            for i, x in enumerate(t):
                rows.append([0])
                for j, y in enumerate(w):
                    same = x == y and abs(j - at - i) <= width
                    rows[-1].append(max(rows[i][j + 1], rows[-1][j], rows[i][j] + same))
            if rows[-1][-1] / len(t) >= licenses.AGREE:
                out.append((label, rows[-1][-1] / len(t), at, at + len(t)))
    return out


def brute(text):
    w = split(text)
    found, best = alignments(w), {}
    for label, share, a, e in found:
        if not any(m != label and b <= a and e <= f and f - b > e - a for m, _, b, f in found):
            best[label] = max(best.get(label, 0), share)
    return len(w), base_of(w), best


TEXTS = [
    None, "", "CC BY", "cc by cc by-nc", "xcc by", "cc\x00by", "ccé by", "All Rights  reserved. all rights\nreserved",
    "GNU General Public License, version 3 and General Public License", "Released under the MIT License.",
    "x Licensed under the Apache License, Version 2.0. y", "Licensed under CC BY-NC 4.0.", "the mit licence", "É CC BY İ",
    "This work is licensed under the GNU General Public License, version 3.", "MIT License " * 50, "license license mit mit license",
    "mit-0 license and mit license", "SPDX-License-Identifier: MIT-0", "Apache License 2.0 Apache-2.0 GPLv2 or GPLv3",
]


def mixed(n):
    """Wordings with words replaced, inserted, dropped and shuffled, between other words."""
    r = random.Random(2)
    for k in range(n):
        w = "the of and this is a under to license version 2 0".split() + r.choice(ALL)[1].split()
        t = r.choice(GRANTS if k % 2 else ALL)[1].split()
        for _ in range(r.randint(0, 5)):
            i = r.randrange(len(t) + 1)
            t[i : i + r.randint(0, 1)] = r.choice([[], [r.choice(w)], ["dnl", "x"]])
        if k % 9 == 0:
            i = r.randrange(len(t) + 1)
            t[i : i + 4] = r.sample(t[i : i + 4], len(t[i : i + 4]))
        yield " ".join([*(r.choice(w) for _ in range(r.randint(0, 9))), *t, *(r.choice(w) for _ in range(r.randint(0, 9)))])


def test_against_brute_force(spark, tmp_path):
    texts = TEXTS + list(mixed(60))
    rows = list(enumerate(texts)) + [(None, "cc by"), (9999, "the and of to " * 30000 + " cc by")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in licenses.op1_licenses(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        n, base, found = brute(t) if i != 9999 else (120_002, [(120_000, "cc-by")], {})
        r = got[i]
        at = [x for x, _ in base]
        assert (r["n_words"], r["n_base"]) == (n, len(base))
        assert (r["first_word"], r["last_word"]) == ((min(at), max(at)) if at else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in base}))
        assert r["labels"] == ",".join(sorted({x for _, x in base} | set(found))) and 0 <= r["score"] <= 1


@pytest.mark.parametrize("frequent", [{}, {b"apache": 900, b"license": 950, b"mit": 800, b"the": 990, b"permission": 999}])
def test_every_alignment_is_found(frequent):
    """Whatever is rare in the corpus, the index finds what the definition finds."""
    index = licenses.Index(frequent, 1000)
    for t in mixed(250):
        assert index.scan(t).found == brute(t)[2], t


def test_templates_find_themselves():
    index = licenses.Index({}, 10)
    assert len(licenses.TEMPLATES) >= 60
    for label, text, _ in ALL:
        assert index.scan(f"one two {text} three").found[label] == 1.0, text


def test_no_documents(spark):
    assert licenses.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_files_with_several_notices():
    index = licenses.Index({b"apache": 900, b"license": 950, b"mit": 800, b"cc": 990, b"gnu": 999}, 1000)
    r = random.Random(4)
    texts = ["; ".join(t for _, t, _ in GRANTS), "; ".join(t for _, t, _ in r.sample(ALL, 40))]
    texts += [" ".join(r.sample(sorted(x.decode() for x in index.vocabulary), 60)) + " | " + r.choice(ALL)[1] for _ in range(30)]
    for t in texts:
        assert index.scan(t).found == brute(t)[2]


def test_usual_wordings():
    index = licenses.Index({}, 10)
    for text, label in [
        ("Released under the terms of the MIT License", "mit"), ("Licensed under the Apache License 2.0", "apache-2.0"),
        ("Licensed under the well known Apache License, Version 2.0", "apache-2.0"), ("SPDX-License-Identifier: Apache-2.0", "apache-2.0"),
        ("GNU GENERAL PUBLIC LICENSE Version 3", "gpl-3.0"), ("Creative Commons Attribution-ShareAlike 4.0 International License", "cc-by-sa-4.0"),
        ("the author(s) have waived all copyright and related rights: CC0 1.0 Universal", "cc0-1.0"), ("GNU Lesser General Public License v2.1", "lgpl-2.1"),
        ("// SPDX-License-Identifier: GPL-2.0-or-later", "gpl-2.0"), ("the BSD 3-Clause License", "bsd-3-clause"), ("licensed under the MPL 2.0", "mpl-2.0"),
    ]:
        assert list(index.scan(text).found) == [label], text
    assert list(index.scan("SPDX-License-Identifier: MIT-0").found) == ["mit-0"]
    assert set(index.scan("MIT-0 License, not the MIT License").found) == {"mit-0", "mit"}
    for text in ("a license", "the mit and a license", "apache version 2", "permission is hereby granted", "cc 4 0", "general public license"):
        assert not index.scan(text).found, text


def test_real_notices():
    index = licenses.Index({}, 10)
    mit = """Permission is hereby granted, free of charge, to any person obtaining a copy
    dnl of this software and associated documentation files (the "Software"), to deal
    dnl in the Software without restriction, including without limitation the rights
    dnl to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
    dnl copies of the Software, and to permit persons to whom the Software is furnished to do so"""
    isc = "Permission to use, copy, modify, and{} distribute this software for any purpose with or without fee is hereby granted"
    gpl = """This file is part of X. X is free software: you can redistribute it and/or modify it under the terms of the GNU
    General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
    option) any later version."""
    assert "mit" in index.scan(mit).found and "mit" in index.scan(mit.replace("dnl", "")).found
    assert "mit" in index.scan(mit.replace('(the "Software")', "").replace("dnl", "")).found
    assert all("isc" in index.scan(isc.format(x)).found for x in ("", "/or"))
    assert "gpl-3.0" in index.scan(gpl).found and "gpl-2.0" not in index.scan(gpl).found
