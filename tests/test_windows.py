"""Windows against brute force, and location for segments beyond a task."""

import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from pagewright.functions import script as sc
from pagewright.operators import locate as loc
from pagewright.operators import scoring
from pagewright.operators import windows as win


@pytest.mark.parametrize("bits,chars,tried", [(win.MOST_BITS, win.CHARS, win.TRIED), (1 << 12, 20, 3)])
def test_windows_are_brute_force(spark, monkeypatch, bits, chars, tried):
    for name, value in (("MOST_BITS", bits), ("CHARS", chars), ("TRIED", tried)):
        monkeypatch.setattr(win, name, value)
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("ab中\U0001f600\0") for _ in range(n))
    texts = [word(rng.randrange(0, 90)) for _ in range(60)] + ["a" * 300, ""]
    patterns = {word(rng.randrange(1, 6)) for _ in range(100)} | {t[k : k + n] for t in texts for k, n in ((3, 17), (0, 64), (9, 33))} | {"a" * 128, "a" * 301} - {""}
    known = win.patterns(spark.createDataFrame([(p,) for p in patterns if p], "w string").repartition(3))
    found = known.windows(texts)
    assert len(found) == len(set(found)) and {(i, w) for i, w in found if w in patterns} == {(i, p) for i, t in enumerate(texts) for p in patterns if p and p in t}
    assert all(w in texts[i] for i, w in found)


def test_location_reads_pages_once_for_any_number_of_segments(spark, monkeypatch):
    """Before, each block of segments read an index of the pages again, and an index was made for it."""
    for name in ("index", "search"):
        monkeypatch.setattr(loc, name, None)
    monkeypatch.setattr(loc, "BLOCK_BYTES", 400)
    rng = random.Random(8)
    table = {"營": "营", "營業額": "营业总额", "業": "业", "；": "x"}
    alphabet = ["營業額", "營", "業", "营业总额", "a", "b", "，", " ", "。", "　", "\n", "\0", "；"]
    pages = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 60)))) for i in range(80)] + [(80, None), (81, ""), (3, "營業額 a,b"), (82, "a" * 2000)]
    segments = [(900, None), (901, ""), (902, " ，。"), (903, "a" * 1000), (904, "a" * 2001), (905, "；")]
    for i in range(150):
        text = rng.choice(pages)[1] or "x"
        start = rng.randrange(len(text) or 1)
        part = text[start : start + rng.randrange(1, 12)]
        segments.append((i, rng.choice([part, part.replace("，", ""), sc.Converter(table)(part), part + "b", part.replace(" ", "  ")])))
    found = loc.locate(spark.createDataFrame(segments, "id long, s string"), spark.createDataFrame(pages, "page long, t string").repartition(3), "id", "s", "page", "t", table)
    assert found.columns == ["id", "page", "level", "band"]
    convert, want = sc.Converter(table), {}
    for i, s in segments:
        for p, t in pages:
            if s and t and sc.bare(convert(s)) and sc.bare(convert(s)) in sc.bare(convert(t)):
                level = 2 if sc.bare(s) not in sc.bare(t) else 1 if sc.squeezed(s) not in sc.squeezed(t) else 0
                want[i, p] = min(level, want.get((i, p), 2))
    assert {(r.id, r.page): r.level for r in found.collect()} == want and len(want) > 200 and set(want.values()) == {0, 1, 2}


def test_batches_are_bounded(spark):
    """Before, a batch held up to 10,000 rows of any size."""
    pages = spark.createDataFrame([(i, "x" * 1_000_000) for i in range(12)], "page long, t string").coalesce(1)
    loc.locate(spark.createDataFrame([(1, "xx")], "id long, s string"), pages, "id", "s", "page", "t")
    most = pages.mapInArrow(lambda batches: (b.select(["page"]) for b in batches if b.nbytes > 6_000_000), "page long").count()
    assert most == 0


@pytest.mark.parametrize("table", [None, {"營": "营", "業": "业"}, {"營": "营", "營業額": "营业总额", "業": "业", "；": "x"}, {"業": "；"}])
@pytest.mark.parametrize("seen", [loc.SEEN, 2])
def test_standing_is_brute_force(spark, monkeypatch, table, seen):
    monkeypatch.setattr(loc, "SEEN", seen)
    rng = random.Random(5)
    alphabet = ["營業額", "營", "業", "营业总额", "a", "b", "，", " ", "。", "　", "\xa0", "\n", "\0", "；", "\U0001f600"]
    pages = [(i % 20, "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 40)))) for i in range(80)] + [(5, None), (6, ""), (None, "ab，a"), (3, "營業額 a,b"), (7, "a" * 2000)]
    segments = {None, "", " ，。", "a" * 1000, "a" * 2001, "；", "a\xa0b", "營 業額"}
    for _ in range(150):
        text = rng.choice(pages)[1] or "x"
        start = rng.randrange(len(text) or 1)
        part = text[start : start + rng.randrange(1, 12)]
        segments.add(rng.choice([part, part.replace("，", ""), sc.Converter(table)(part), part + "b", part.replace(" ", "  ")]))
    asked = {(s, p) for s in segments for p in rng.sample(range(25), 6)}
    best, there = loc.standing(
        spark.createDataFrame([(s,) for s in segments], "s string"), spark.createDataFrame(pages, "p long, t string").repartition(3), spark.createDataFrame(list(asked), "s string, p long"), "s", "p", "t", table
    )
    convert, want, places = sc.Converter(table), {}, {}
    for s in segments:
        for p, t in pages:
            if s and t and sc.bare(convert(s)) and sc.bare(convert(s)) in sc.bare(convert(t)):
                level = 2 if sc.bare(s) not in sc.bare(t) else 1 if sc.squeezed(s) not in sc.squeezed(t) else 0
                want[s] = min(level, want.get(s, 2))
                if (s, p) in asked:
                    places[s, p] = min(level, places.get((s, p), 2))
    assert {r.s: r.level for r in best.collect()} == want and len(want) > 60
    assert {(r.s, r.p): r.level for r in there.collect()} == places and len(places) > 100


def test_scores_do_not_list_the_pages_of_a_quotation(spark, monkeypatch):
    """Before, a row for each page that holds a quotation's segment, and each form of it, was written and joined."""
    rows, keep = [], loc.written

    def counted(df, *args):
        out = keep(df, *args)
        rows.append(out.count())
        return out

    monkeypatch.setattr(loc, "written", counted)
    pages = spark.createDataFrame([("d", i, f"x{i}，revenue of the year") for i in range(400)], "doc string, page int, text string").repartition(2)
    answers = spark.createDataFrame([("q1", "d", 7, "「revenue of the year」【依据：《d》第 7 页】"), ("q2", "e", 7, "「revenue  of the year」")], "qa_id string, doc string, page int, prediction string")
    found = {r.qa_id: r for r in scoring.citation_score(answers, pages).collect()}
    assert (found["q1"].exact, found["q1"].on_cited, found["q1"].on_source) == (1, 1, 1) and (found["q2"].exact, found["q2"].on_source) == (1, 0)
    assert max(rows) < 40


def test_a_page_is_searched_as_a_whole_once(monkeypatch):
    """Before, a page with any window of a segment was searched twice: in one script, and as a whole without white space as well."""
    rng = random.Random(6)
    pages = ["".join(rng.choice("abcdefgh ,") for _ in range(2000)) for _ in range(40)]
    segments = [p[50 * i : 50 * i + 20] for i, p in enumerate(pages)]
    forms = sorted({f(s) for s in segments for f in (sc.squeezed, sc.bare)})
    bits = win._size(len(forms), win.BITS)
    words = np.zeros(bits // 64, np.uint64)
    for batch in win._marked(bits)([pa.RecordBatch.from_arrays([pa.array(forms)], ["w"])]):
        word, mask = (np.asarray(c) for c in batch.columns)
        np.bitwise_or.at(words, word[word >= 0], mask[word >= 0].view(np.uint64))
    shared = SimpleNamespace(value=(win.Patterns(words, sorted({len(w) for w in forms})), win.Bitmap(np.zeros(64, np.uint64))))
    looked, codes = [], win._codes
    monkeypatch.setattr(win, "_codes", lambda texts: looked.append(sum(map(len, texts))) or codes(texts))
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(range(40)), pa.array(pages)], ["p", "h", "t"])
    found = {(k, w) for out in loc._hits(shared, sc.Converter())([batch]) for k, w in zip(out.column("kind").to_pylist(), out.column("w").to_pylist())}
    assert {(0, sc.squeezed(s)) for s in segments} | {(k, sc.bare(s)) for s in segments for k in (1, 2)} <= found
    assert sum(looked) < 1.2 * sum(len(sc.bare(p)) for p in pages)
