"""The pipeline over a small corpus, and the contract of its stages."""

import random

import corpus_pipeline
from pagewright.llm.shared import written


def test_stages(spark, tmp_path):
    rng = random.Random(3)
    line = lambda n: " ".join(rng.choice(["the", "and", "with"]) + rng.choice(["ing", "tion", "able"]) + str(rng.randrange(9999)) for _ in range(n))
    item = line(30)
    rows = [[i, "\n".join(line(30) for _ in range(6)), "en", f"s{i % 3}"] for i in range(60)]
    rows[10][1] = rows[4][1]  # a copy: nothing of it is left
    rows[11][1] = rows[5][1].replace("\n", " ") + " x"  # a near copy without its lines
    rows[12][1] += "\n" + item
    rows[13][1] += "\n" + rows[6][1].split("\n")[2]
    rows += [[70, None, "en", "s0"], [71, "", None, None], [72, "?? 12", "en", "s1"]]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, str(tmp_path)))
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name != "mixture":
            assert docs.columns == corpus_pipeline.COLUMNS
    every = set(range(60))
    assert kept == {"language_id": every, "line_dedup": every - {10}, "near_duplicates": every - {10}, "decontamination": every - {10, 12}, "mixture": every - {10, 12}} or kept["near_duplicates"] == every - {10, 11}
    assert kept["near_duplicates"] == every - {10, 11} and kept["mixture"] == every - {10, 11, 12}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_null_and_repeated_ids(spark, tmp_path):
    rng = random.Random(9)
    line = lambda: " ".join(rng.choice(["the", "and", "with"]) + rng.choice(["ing", "tion", "able"]) + str(rng.randrange(9999)) for _ in range(30))
    text = lambda: "\n".join(line() for _ in range(6))
    item, clean = line(), {i: text() for i in range(40)}
    rows = [(i, clean[i]) for i in range(40)]
    nulls, other, shared = [text() for _ in range(3)], text(), text()
    rows += [(None, x) for x in nulls] + [(None, nulls[0]), (None, "?? 12"), (None, text() + "\n" + item)]  # a copy, no language, an item
    rows += [(5, clean[5]), (5, clean[5]), (6, other), (7, clean[8].replace("\n", " ") + " x")]  # equal rows; other texts of an id
    rows += [(50, shared), (50, clean[9].split("\n")[1] + "\n" + text())]  # the second alone loses a line
    frame = [(i, t, "en", f"s{n % 3}", len(t)) for n, (i, t) in enumerate(rows)]
    docs = spark.createDataFrame(frame, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    many = lambda d: sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in d.select("doc_id", "text").collect())
    all_rows = sorted((-1 if i is None else i, t) for i, t in rows)

    def without(seq, *gone):
        left = list(seq)
        for x in gone:
            left.remove(x)
        return left

    assert many(corpus_pipeline.language_id(spark, docs, str(tmp_path))) == without(all_rows, (-1, "?? 12"))
    lines = many(corpus_pipeline.line_dedup(spark, docs, str(tmp_path)))
    assert lines == sorted([*without(all_rows, (50, rows[-1][1])), (50, rows[-1][1].split("\n", 1)[1])])
    near = many(corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)))
    assert near == without(all_rows, (-1, nulls[0]), (5, clean[5]), (5, clean[5]), (8, clean[8]))
    assert many(corpus_pipeline.decontamination(spark, docs, str(tmp_path))) == without(all_rows, (-1, rows[45][1]))
    mixed = corpus_pipeline.mixture(spark, docs, str(tmp_path))
    first = many(mixed.where("pass = 0"))
    assert first == all_rows and mixed.count() == corpus_pipeline.mixing.plan(docs, blocks=64, seed=1, repeats=2.0).count()
