import hashlib
import random

import pytest

from tidemark.llm import line_dedup as ld


def brute(rows):
    """Straight from the definition, over all pairs of lines."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    places = {}
    for d, (_, t) in enumerate(rows):
        for no, line in enumerate((t or "").split("\n")):
            w = tuple(line.split())
            if len(w) >= ld.LEAST_WORDS:
                places.setdefault(w, []).append((d, no))
    bad = set()
    kinds = [(w, *kind(w)) for w in places if kind(w)]
    for a, x, how in kinds:
        for b, y, other in kinds:
            if a != b and how == other and places[b][0] < places[a][0] and one_edit(x, y):
                bad.add(a)
    out = []
    for d, (i, t) in enumerate(rows):
        lines, kept = (t or "").split("\n"), []
        for no, line in enumerate(lines):
            w = tuple(line.split())
            if w not in places or places[w][0] == (d, no) and w not in bad:
                kept.append(line)
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def kind(words):
    """What an edit changes in a line, or None: words of ten and more, characters of twenty and more."""
    line = " ".join(words)
    return (words, "words") if len(words) >= 10 else (tuple(line), "characters") if len(line) >= 20 else None


def one_edit(a, b):
    """Whether what is left beside the common start and end is one unit at most."""
    n = max(len(a), len(b))
    if n - min(len(a), len(b)) > 1:
        return False
    start = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    end = next((k for k, (x, y) in enumerate(zip(a[::-1], b[::-1])) if x != y), min(len(a), len(b)))
    return start + end >= n - 1


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def corpus(n, seed):
    r = random.Random(seed)
    word = lambda: r.choice("alpha beta gamma delta eps zeta eta".split())
    base = [[word() for _ in range(r.choice([3, 5, 9, 10, 11, 16, 17, 30, 31, 32]))] for _ in range(12)]
    rows = []
    for i in range(n):
        lines = []
        for _ in range(r.randint(0, 6)):
            w = list(r.choice(base))
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                k = r.randrange(len(w) + 1)
                kind = r.choice("rid")
                w[k : k + (kind != "i")] = [] if kind == "d" else [word()]
            lines.append(r.choice([" ", "  "]).join(w))
        rows.append((i * 3, "\n".join(lines)))
    r.shuffle(rows)
    return rows


def test_against_brute_force(spark, tmp_path):
    rows = corpus(120, 1) + [(1000, None), (1001, ""), (1002, "\n\n"), (1003, "w " * 30_000), (1004, "w " * 29_999)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in ld.op3_line_dedup(spark, str(tmp_path)).collect()}
    want = {x for x in brute([r for r in rows if r[0] < 1003])}
    assert {x for x in got if x[0] < 1003} == want
    assert [x[2] for x in sorted(got)[-2:]] == [0, 1]


def test_one_edit():
    r = random.Random(0)
    for _ in range(3000):
        a = [r.choice([b"x", b"y"]) for _ in range(r.randint(0, 7))]
        b = [r.choice([b"x", b"y"]) for _ in range(r.randint(0, 7))]
        assert ld.within_one_edit(a, b) == (distance(a, b) <= 1) == one_edit(a, b)


def test_near_lines_share_an_anchor_and_a_variant():
    r = random.Random(1)
    for _ in range(2000):
        a = [b"%d" % r.randrange(50) for _ in range(r.randint(ld.EDIT_WORDS, 70))]
        b, k = list(a), r.randrange(len(a))
        b[k : k + r.randint(0, 1)] = [] if r.random() < 0.4 and len(a) > ld.EDIT_WORDS else [b"new"]
        assert set(ld.anchors(a)) & set(ld.anchors(b))
        assert set(ld.variants(a)) & set(ld.variants(b))


def test_keeps_columns_and_drops_what_is_left_without_text(spark):
    line = "one two three four five six"
    docs = spark.createDataFrame(
        [(1, line, "x"), (2, line, "y"), (3, None, "z"), (4, "", "q"), (None, line + "\nshort", "n")],
        "doc_id long, text string, gone string",
    )
    got = {(r["doc_id"], r["text"], r["gone"]) for r in ld.keep_new_lines(docs).collect()}
    assert got == {(1, line, "x"), (3, None, "z"), (4, "", "q"), (None, "short", "n")}
    assert ld.keep_new_lines(docs.where("false")).count() == 0


def test_short_lines_and_lines_without_spaces(spark):
    r = random.Random(8)
    han = "".join(chr(r.randrange(0x4E00, 0x9FFF)) for _ in range(400))
    words = ["a", "b", "ab", "ba", "abc", "xbc", "abcd", "é", han, han[:200] + "x" + han[200:], han[:150] + han[151:], han + "yz", han[:19], han[:18], han[:20], han[:20] + "x", han[:21], "a line of twenty-five and", "a line of twenty-four and", "a line of twenty-five end", "a b", "c b", "a c b", "p q", "p q r s t"]
    rows = [(i, "\n".join([w, *(r.choice(words) for _ in range(2))])) for i, w in enumerate(words + words)]
    first, want = {}, {}
    for i, t in rows:
        for no, line in enumerate(t.split("\n")):
            first.setdefault(line, (i, no))
    own = {line: kind(tuple(line.split())) for line in first}
    near = lambda x: any(first[y] < first[x] and own[x] and own[y] and own[x][1] == own[y][1] and distance(own[x][0], own[y][0]) == 1 for y in first)
    assert sum(map(near, first)) > 3
    for i, t in rows:
        want[i] = "\n".join(line for no, line in enumerate(t.split("\n")) if first[line] == (i, no) and not near(line))
    got = {x["doc_id"]: x["__kept"] for x in ld.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_bounds_are_parameters(spark):
    lines = ["a", "a", "b c", "b d", "b c", "e f g", "e x g", "e f g h"]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    kept = lambda **k: [r["doc_id"] for r in sorted(ld.dedup_lines(docs, **k).collect()) if not r["__lines_dropped"]]
    assert kept() == [0, 2, 3, 5, 6, 7]
    assert kept(edit_words=2) == [0, 2, 5]
    assert kept(edit_words=3) == [0, 2, 3, 5]
    assert kept(edit_characters=5) == [0, 2, 3, 5, 7]  # a word more is two characters more
    assert kept(edit_words=2, least_words=2) == [0, 1, 2, 5]
    assert kept(least_words=4, edit_words=4) == list(range(8))


def test_short_lines_that_differ_in_a_word_stay(spark):
    lines = ["hello world", "hello there", "Chapter 1", "Chapter 2", "Chapter 1", "see page 4", "see page 5"]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    assert sorted(r["text"] for r in ld.keep_new_lines(docs).collect()) == sorted(set(lines))


def test_names_of_its_own_are_refused(spark):
    with pytest.raises(ValueError):
        ld.dedup_lines(spark.createDataFrame([(1, "a", 2)], "doc_id long, text string, __tm_doc long"))


def test_near_characters_share_an_anchor_and_a_variant():
    r = random.Random(2)
    for _ in range(3000):
        a = "".join(r.choice("abé") for _ in range(r.randint(1, 9)))
        k = r.randrange(len(a))
        b = a[:k] + r.choice(["", "x", "x" + a[k]]) + a[k + 1 :]
        if b:
            x, y = ld.units([a.encode()], (2, 1)), ld.units([b.encode()], (2, 1))
            assert set(ld.anchors(*x)) & set(ld.anchors(*y)) and set(ld.variants(*x)) & set(ld.variants(*y))
