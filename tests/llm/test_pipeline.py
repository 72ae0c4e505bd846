"""The pipeline's stages over a small table, each against what it should keep."""

from __future__ import annotations

import random


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as cp

    rng = random.Random(8)
    words = {"en": ["the", "of", "thing", "with", "would", "ring", "there"], "de": ["der", "und", "nicht", "schön", "für", "zwölf", "ich"]}
    line = lambda lang, n: " ".join(rng.choice(words[lang]) + str(rng.randint(0, 9)) * (k % 5 == 0) for k in range(n))
    rows = [(i, "\n".join(line(lang, 25) for _ in range(4)), lang, "s", 0) for i, lang in enumerate(["en", "de"] * 40)]
    copy = rows[0][1].split(" ")
    near = " ".join(copy[:50] + ["other"] + copy[51:])
    rows += [(100, rows[0][1], "en", "s", 0), (101, near, "en", "s", 0), (102, None, None, "s", None), (103, "1234 !!", "en", "s", 7), (104, line("en", 30) + "\n" + rows[2][1].split("\n")[0], "en", "s", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    first = cp.STAGES[0][1](spark, docs, str(tmp_path))
    assert first.columns == docs.columns and {r.doc_id for r in first.collect()} == {r[0] for r in rows} - {102, 103}
    second = cp.STAGES[1][1](spark, first, str(tmp_path))
    got = {r.doc_id: r for r in second.collect()}
    assert second.columns == docs.columns and 100 not in got and got[104].text == rows[-1][1].split("\n")[0] and got[0].text == rows[0][1]
    third = cp.STAGES[2][1](spark, docs.where("text is not null"), str(tmp_path))
    assert {r.doc_id for r in third.collect()} == {r[0] for r in rows} - {100, 101, 102}
    out = cp.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == set(got) and len(cp.STAGES) == 4


def test_null_and_repeated_ids(spark, tmp_path):
    import corpus_pipeline as cp

    rng = random.Random(11)
    text = lambda: "\n".join(" ".join(rng.choice(["the", "of", "thing", "with", "ring", "there"]) + str(rng.randint(0, 99)) for _ in range(20)) for _ in range(3))
    clean = [(i, text(), "en", "s", 0) for i in [*range(20), None, None, 5, 5]]
    rows = clean + [(None, clean[0][1], "en", "s", 0), (5, clean[1][1], "en", "s", 0)]  # copies of earlier texts
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    got = [sorted(((r.doc_id, r.text) for r in stage(spark, docs, str(tmp_path)).collect()), key=key) for _, stage in cp.STAGES[:3]]
    assert got[0] == sorted(((r[0], r[1]) for r in rows), key=key)
    assert got[1] == got[2] == sorted(((r[0], r[1]) for r in clean), key=key)


def test_near_duplicates_are_not_chained_by_quotations(spark, monkeypatch):
    import corpus_pipeline
    from chunkloom.llm import jaccard

    # So few buckets that rarity tells nothing, as those of a large corpus; each text quotes a part of the one before it.
    monkeypatch.setattr(jaccard, "BUCKETS", 64)
    words = [[f"t{i}w{k}" for k in range(200)] for i in range(30)]
    texts = [" ".join(words[i - 1][5:20] + w) for i, w in enumerate(words)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate([*texts, texts[9] + " end"])]
    in_blocks = []
    tiles = jaccard.tiles
    monkeypatch.setattr(jaccard, "tiles", lambda found, tokens: in_blocks.append(found.count()) or tiles(found, tokens))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.keep_one_of_each(spark, docs, "").collect()) == list(range(30))
    assert in_blocks == [2, 2]
