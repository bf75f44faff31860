"""Line dedup against all pairs of documents by brute force, and its edges."""

import random
from difflib import SequenceMatcher

import pytest

from pagewright.llm import line_dedup


def brute(rows, least=8):
    """Text of each row without the lines that a block of `least` words around them shares with a smaller id's text."""
    cut = lambda t: [" ".join(x.split()) for x in t.split("\n")]
    out = []
    for own, text in rows:
        if own is None or text is None:
            out.append(text)
            continue
        lines = cut(text)
        solid = [i for i, x in enumerate(lines) if x]
        a, gone = [lines[i] for i in solid], set()
        for other, t in rows:
            if other is None or t is None or other >= own:
                continue
            b = [x for x in cut(t) if x]
            for i in range(len(a)):
                for j in range(len(b)):
                    n = 0
                    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                        n += 1
                    if sum(len(x.split()) for x in a[i : i + n]) >= least:
                        gone |= set(solid[i : i + n])
        keep = [i for i in solid if i not in gone]
        for i, x in enumerate(lines):
            if not x:
                near = [max((k for k in solid if k < i), default=None), min((k for k in solid if k > i), default=None)]
                if not gone or any(k is not None and k not in gone for k in near):
                    keep.append(i)
        out.append("\n".join(text.split("\n")[i] for i in sorted(keep)))
    return out


@pytest.mark.parametrize("seed,rare", [(1, 4), (2, 4), (3, 2), (4, 0), (5, 99)])
def test_is_brute_force(spark, monkeypatch, seed, rare):
    """All runs aligned in pairs, all looked up, or some of either: the same result."""
    monkeypatch.setattr(line_dedup, "RARE", rare)
    rng = random.Random(seed)
    pool = [" ".join(f"v{rng.randrange(30)}" for _ in range(rng.choice([1, 2, 3, 5, 8, 12]))) for _ in range(14)]
    passage = rng.sample(pool, 5)
    rows = []
    for i in range(40):
        body = [rng.choice(pool) if rng.random() < 0.6 else f"own {i} " + "z " * rng.randrange(9) for _ in range(rng.randrange(12))]
        if i % 3 == 0:
            body[len(body) // 2 : len(body) // 2] = passage
        for _ in range(rng.randrange(3)):
            body.insert(rng.randrange(len(body) + 1), rng.choice(["", "  "]))
        rows.append((i, "\n".join(body)))
    rows += [(50, rows[3][1]), (51, rows[3][1]), (52, None), (None, rows[3][1]), (53, ""), (54, "\n\n"), (55, pool[0] + " \n\n\t" + pool[1])]
    rng.shuffle(rows)
    got = line_dedup.line_dedup(spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "n int, doc_id long, text string")).collect()
    assert {r.n: r.text for r in got} == dict(enumerate(brute(rows)))
    assert any(r.lines_deleted for r in got)


def test_blocks_are_common_and_in_order():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.randrange(1, 12) for _ in range(rng.randrange(14))] for _ in "ab")
        last = (0, 0)
        for i, j, n in line_dedup.patience_blocks(a, b):
            assert a[i : i + n] == b[j : j + n] and i >= last[0] and j >= last[1] and n > 0
            last = (i + n, j + n)
    a, b = list(range(1, 9)), [20, 3, 4, 5, 21, 8]
    assert line_dedup.patience_blocks(a, b) == [(x.a, x.b, x.size) for x in SequenceMatcher(None, a, b, False).get_matching_blocks()[:-1]]
    # 5 stands twice in both, but once between the anchors 1 and 2, and once between 2 and 3
    assert line_dedup.patience_blocks([1, 5, 2, 5, 3], [1, 7, 5, 2, 8, 5, 3]) == [(0, 0, 1), (1, 2, 2), (3, 5, 2)]


def test_line_dedup(spark):
    line = [f"line {i} has exactly eight words in it" for i in range(9)]
    rows = [
        (1, "\n".join([line[0], line[1], "own"]), "x"),
        (2, "\n".join(["before", line[0], line[1], "after"]), "x"),
        (3, "\n".join([line[1], line[2]]), "x"),
        (4, line[2] + "\n\n" + line[3] + "\n", "x"),
        (5, line[0] + "\n" + line[1], "x"),
        (6, None, "x"), (7, "", "x"), (8, "own\nshort", "x"), (None, line[0], "x"),
    ]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string, digest string")).collect()
    text = {r.doc_id: r.text for r in got}
    assert text == {1: rows[0][1], 2: "before\nafter", 3: line[2], 4: "\n" + line[3] + "\n", 5: "", 6: None, 7: "", 8: "own\nshort", None: line[0]}
    assert {r.digest for r in got} == {"x"} and {r.doc_id: r.lines_deleted for r in got}[2] == 2
    assert line_dedup.line_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_copies_whose_lines_stand_alone_elsewhere(spark):
    """Two equal documents, each line of which is short and the whole text of an earlier document."""
    lines = [f"four words line {i}" for i in range(6)]
    rows = [(i + 1, x) for i, x in enumerate(lines)] + [(10, "\n".join(lines)), (11, "\n".join(lines)), (12, "new\n" + "\n".join(lines[1:]))]
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {**dict(rows), 11: "", 12: "new"}


def test_rows_that_share_an_id_and_other_ids(spark):
    long = [f"line {i} " + "w " * 9 for i in range(4)]
    rows = [("a", long[0]), ("b", "\n".join([long[1], long[0], "tail"])), ("b", "\n".join([long[2], long[3]])), ("b", long[1]), ("c", long[3] + "\nend"), ("c", long[3] + "\nend")]
    docs = spark.createDataFrame([(*r, n, -1) for n, r in enumerate(rows)], "doc_id string, text string, first int, lines_deleted int")
    got = {r.first: (r.text, r.lines_deleted) for r in line_dedup.line_dedup(docs).collect()}
    assert got == {0: (long[0], 0), 1: (long[1] + "\ntail", 1), 2: (rows[2][1], 0), 3: (long[1], 0), 4: ("end", 1), 5: ("end", 1)}


def test_moved_repeated_and_very_long(spark):
    p, x, z, q, y = (f"{c} " * 9 + c for c in "pxzqy")
    many = "\n".join(f"{i} " * 8 for i in range(30_000))
    rows = [(1, "\n".join([p, q, p, y, x])), (2, "\n".join([p, z, x])), (3, "\n".join([x, "mid", p, p])), (8, many), (9, many + "\nown")]
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[2], got[3], got[9]) == (z, "mid", "own") and got[8] == many
