"""Each operator against brute force or its library, over texts with all edge cases."""

from __future__ import annotations

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

SCHEMA = "doc_id long, text string, lang string, key string, rid string, block string, n int, ids string, token string"
BASE = "the ring of an old thing that was here and there, with more words to come in this line of text about nothing much at all. "


def texts() -> list[tuple]:
    rng = random.Random(3)
    word = lambda: rng.choice(["alpha", "beta", "Gamma", "delta", "épée", "the", "of", "x1", "don't", "zwölf", "naïve", "<|endoftext|>", "12,5", "Δω"])
    line = lambda n: " ".join(word() for _ in range(n))
    shared = line(70)
    near = shared.split(" ")
    near[3] = "changed"
    rows = [
        (1, shared + "\n" + line(30)), (2, None), (3, ""), (4, "   \n\t "), (5, " ".join(near)), (6, shared), (7, shared), (8, BASE * 3), (9, (BASE + line(9) + "\n") * 40),
        (10, "one two"), (11, "ONE two"), (12, "x"), (13, "1234 5678"), (14, "a" * 3000), (15, line(400)), (None, line(40)), (20, shared), (20, shared), (40, line(60) + "\n" + shared), (41, "\n\n"), (42, "\t" + shared.replace(" ", " \t", 9) + "\r\n" + line(8)),
    ]
    return [(i, t, None if i == 10 else "en", "k", "r", "b", 1, "i", "t") for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(texts(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, key="doc_id"):
    out = collections.defaultdict(list)
    for r in df.collect():
        out[r[key]].append(r)
    return out


def plain() -> list[tuple]:
    return [(i, t or "") for i, t, *_ in texts()]


def test_bpe_equals_the_library(docs, none):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    from chunkloom.llm.tokens import bpe_decode, bpe_digests, bpe_encode, codec

    path = P.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    digests, ids = by_id(bpe_digests(docs, path)), by_id(bpe_decode(bpe_encode(docs, path), path))
    for i, t in plain():
        want = lib.encode(t, add_special_tokens=False).ids
        r = digests[i][0]
        assert (r.n_tokens, r.ids_sha256) == (len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest())
        assert list(ids[i][0].ids) == want and ids[i][0].text == lib.decode(want, skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(want, skip_special_tokens=False).encode()).hexdigest()
    assert bpe_digests(none, path).count() == 0
    rng, own = random.Random(1), codec(path)
    pool = ["a", "b", "the", "ing", " ", "  ", "\n", "\t", "'s", "'", "1", "12", "é", "<|endoftext|>", "<|", "ß", " ", " ", "ab" * 40, "-" * 70, "\x1c", "\x85", "😀", "aaaaaaa", " " * 30]
    for s in ["".join(rng.choice(pool) for _ in range(rng.randint(0, 25))) for _ in range(400)]:
        assert own.encode_batch([s])[0] == lib.encode(s, add_special_tokens=False).ids, repr(s)
    assert own.decode([50257 + 9]) == "" and own.decode([255]) == lib.decode([255])
    # Every code point next to letters, digits, an apostrophe and blanks, over all planes.
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 3000):
        s = "".join(f"{chr(c)}'s a{chr(c)} {chr(c)}1" for c in points[at : at + 3000])
        assert own.encode_batch([s])[0] == lib.encode(s, add_special_tokens=False).ids, hex(points[at])
    long_words = ["x" * 5000, "".join(rng.choice("abcdefgh") for _ in range(9000)), "é" * 4000]
    assert [own.encode_batch([w])[0] for w in long_words] == [lib.encode(w, add_special_tokens=False).ids for w in long_words]


def test_bpe_takes_a_very_long_word():
    """In a process of its own, whose address space is bounded."""
    import subprocess
    import sys

    code = """
import resource
resource.setrlimit(resource.RLIMIT_AS, (1 << 30, 1 << 30))
import public_tokenizers as P
from chunkloom.llm.tokens import Codec
own = Codec(P.path("byte_bpe_50k.json"))
word = "ab" * 1_000_000
ids = own.encode_batch([word])[0]
assert own.decode(ids) == word
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=300, cwd=__import__("pathlib").Path(__file__).resolve().parents[2])


def test_warc_round_trip(spark, tmp_path):
    from chunkloom.llm.warc import parse, plan_records, read_archives, write_archives

    rows = [(1, "<p>é\r\n\r\nWARC/1.1\r\n"), (2, "same"), (3, "same"), (4, None), (5, ""), (None, "lone"), (7, "x" * 100_000)]
    path = str(tmp_path / "warc")
    write_archives(plan_records(spark.createDataFrame(rows, "page_id long, html string"), "page_id", "html"), path)
    got = {r.record_id: r for r in read_archives(spark, path).collect()}
    assert got["<urn:page:1>"].payload.decode() == rows[0][1] and got["<urn:page:7>"].payload == b"x" * 100_000
    assert got["<urn:page:2>"].record_type == "revisit" and got["<urn:page:2>"].refers_to == "<urn:page:3>" and got["<urn:page:4>"].refers_to == "<urn:page:5>"
    assert got["<urn:page:3>"].payload_digest == "sha1:" + base64.b32encode(hashlib.sha1(b"same").digest()).decode()
    assert "<urn:page:>" in got
    only = read_archives(spark, path).where("record_type = 'revisit' and refers_to = '<urn:page:3>'")
    assert [r.record_id for r in only.collect()] == ["<urn:page:2>"] and got["<urn:page:2>"].headers["warc-profile"].endswith("identical-payload-digest")
    # The reader took the tests: it gives the wanted records alone, and none is left for Spark to test.
    plan = only._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan and "Filter isnotnull" not in plan and "BatchScan" in plan, plan
    from pyspark.sql.datasource import EqualTo

    from chunkloom.llm.warc import WarcReader

    reader = WarcReader({"path": path})
    assert list(reader.pushFilters([EqualTo(("record_type",), "revisit"), EqualTo(("payload",), b"x")])) == [EqualTo(("payload",), b"x")]
    assert {r[0] for p in reader.partitions() for r in reader.read(p)} == {"revisit"}
    assert all(r.payload is None for r in read_archives(spark, path, payload="false").collect())
    empty = str(tmp_path / "none")
    write_archives(plan_records(spark.createDataFrame([], "page_id long, html string"), "page_id", "html"), empty)
    assert read_archives(spark, empty).count() == 0
    import io

    with pytest.raises(ValueError):
        list(parse(io.BytesIO(b"WARC/1.0\r\nContent-Length: 9\r\n\r\nabc"), lambda h: True))
    with pytest.raises(ValueError):
        list(parse(io.BytesIO(b"WARC/1.0\r\nWARC-Type: x\r\n\r\n"), lambda h: True))


def test_line_dedup(docs, none):
    from chunkloom.llm.lines import dedup_lines

    def brute(rows):
        seen, out = [], []
        for i, t in rows:
            kept = []
            for line in (t or "").split("\n"):
                w = [x for x in re.sub("[\t\r\x0b\f]", " ", line).lower().split(" ") if x]
                s = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else None
                if s is None or not any(9 * len(s & o) >= 4 * (len(s) + len(o)) for o in seen):
                    kept.append(line)
                if s is not None:
                    seen.append(s)
            out.append((i, None if t is None else "\n".join(kept)))
        return out

    got = by_id(dedup_lines(docs))
    rows = [(i, t) for i, t, *_ in texts()]
    once = sorted(((i, t) for n, (i, t) in enumerate(rows) if i is not None and (i, t) not in rows[:n]), key=lambda r: r[0])
    assert {i: got[i][0].text for i, _ in once if len(got[i]) == 1} == {i: t for i, t in brute(once) if len(got[i]) == 1}
    assert got[6][0].n_removed == 1 and sorted(r.text for r in got[20]) == ["", ""] and got[None][0].text == texts()[15][1]
    # Rows without an id, and rows that repeat one, are documents of their own, after all others.
    pool = [f"word{k}" for k in range(40)]
    line = lambda k: " ".join(pool[k : k + 12])
    odd = [(3, line(0)), (None, line(3) + "\n" + line(0)), (None, line(20) + "\n" + line(5)), (4, line(9)), (4, line(15) + "\n" + line(0)), (4, line(9))]
    found = sorted((r.doc_id or 0, r.text, r.n_removed) for r in dedup_lines(docs.sparkSession.createDataFrame(odd, "doc_id long, text string")).collect())
    assert found[0][0] == found[1][0] == 0 and sorted(t for i, t, _ in found if i == 4) == ["", line(15), line(9)]
    assert {t for i, t, _ in found if not i} == {line(3), line(20) + "\n" + line(5)} and sum(n for *_, n in found) == 3
    assert dedup_lines(none).count() == 0


def test_line_dedup_counts_a_sample(spark, monkeypatch):
    from chunkloom.llm import lines

    rows = [(i, f"the very same long line of words is in every text here\nbut w{i // 2} w{i // 2 + 1} w{i // 2 + 2} w{i // 2 + 3} w{i // 2 + 4} is in two") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    numbered = docs.withColumnRenamed("doc_id", "rid")
    # Arrays that have no nulls by their type are sorted as numbers.
    assert not lines.token_lines(lines.lines_of(numbered)).schema["tokens"].dataType.containsNull
    level = lambda: max(spark.range(1).select(lines.rarity(numbered).alias("x")).first().x)
    found, levels = [], []
    for sample in (1, 4, 1 << 30):
        monkeypatch.setattr(lines, "SAMPLE", sample)
        found.append(sorted(lines.dedup_lines(docs).collect()))
        levels.append(level())
    # Whatever is counted, all lines of all documents are compared.
    assert found[0] == found[1] == found[2] and sum(r.n_removed for r in found[0]) == 79 + 40
    assert levels[0] > levels[1] > levels[2] == 0


def test_language(spark, docs, none):
    from chunkloom.llm.language import fit, predict

    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["der", "und", "nicht", "schön"] if i % 2 else ["le", "la", "pour", "être"]) for _ in range(40)), "de" if i % 2 else "fr") for i in range(120)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = fit(train.where("doc_id < 80"))
    got = by_id(predict(train, net))
    assert np.mean([got[i][0].lang_pred == lang for i, _, lang in rows if i >= 80]) > 0.95
    edge = by_id(predict(docs, net))
    assert all(edge[i][0].lang_pred == "und" and edge[i][0].score == 0 for i in (2, 3, 4, 13, 41))
    assert all(0 <= r.score <= 1 for rs in edge.values() for r in rs) and len(edge[20]) == 2
    assert fit(none) is None and predict(none, net).count() == 0 and by_id(predict(docs, None))[8][0].lang_pred == "und"


def test_least_hashes(spark):
    from chunkloom.llm.language import least_hashes

    rng = random.Random(2)
    rows = [("a", rng.randrange(-(1 << 63), 1 << 63)) for _ in range(5000)] + [("b", i) for i in range(-3, 40)] + [("c", 7)]
    got = collections.defaultdict(list)
    for r in least_hashes(spark.createDataFrame(rows, "_label string, _hash long").repartition(7), 20).collect():
        got[r[0]].append(r[1])
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(h for x, h in rows if x == k)[:20] for k in "abc"}


def test_language_learns_from_different_texts(spark, monkeypatch):
    from chunkloom.llm import language

    # More copies than the sample holds, of the text that comes first by its hash.
    texts = [(f"text number {i}", "en") for i in range(30)]
    df = spark.createDataFrame(texts, "text string, lang string")
    copied = df.orderBy("lang", language.F.xxhash64("text")).first().text
    learned = []
    monkeypatch.setattr(language, "train", lambda x, y, labels: learned.extend(bytes(w).rstrip(b"\0") for w in x))
    language.fit(spark.createDataFrame(texts + [(copied, "en")] * 50, "text string, lang string"), texts_per_label=20)
    assert len(learned) == 20 and len(set(learned)) == 20 and copied.encode() in learned


def test_packing(docs, none):
    from tokenizers import Tokenizer

    from chunkloom.llm.packing import fullest, pack_documents, plan, vocabulary

    lib = Tokenizer.from_file(vocabulary())
    rows = pack_documents(docs, vocabulary(), capacity=256).collect()
    got, places = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        got[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    for i, t in plain():
        ids = lib.encode(t, add_special_tokens=False).ids + [1]
        want = {(k, a, len(ids[a : a + 256]), zlib.crc32(np.array(ids[a : a + 256], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 256))}
        assert {(r.piece, r.start, r.length, r.ids_crc32) for r in got[i]} == want
    for spans in places.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 256
    assert pack_documents(none, vocabulary()).count() == 0
    rng = random.Random(2)
    for _ in range(60):
        counts = {n: rng.randint(1, 3) for n in rng.sample(range(1, 30), 5)}
        room, sums = rng.randint(1, 60), {0}
        for n, c in counts.items():
            sums = {s + n * k for s in sums for k in range(c + 1)}
        taken = fullest(counts, room)
        assert sum(n * c for n, c in taken) == max(s for s in sums if s <= room) and all(c <= counts[n] for n, c in taken)
        total = collections.Counter()
        for items, times in plan(counts, 64):
            assert sum(n * c for n, c in items) <= 64
            for n, c in items:
                total[n] += c * times
        assert total == counts


def test_sharding(docs, none):
    from chunkloom.llm.sharding import difference, held, shard_rows

    for block_groups in (100_000, 3):
        rows = shard_rows(docs, 4, block_groups=block_groups).collect()
        assert len(rows) == len(texts())
        shards = collections.defaultdict(list)
        for r in rows:
            shards[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in shards.values()) and set(shards) <= set(range(4))
        where = collections.defaultdict(set)
        sizes = {i: t for i, t in plain()}
        for r in rows:
            where[sizes[r.doc_id]].add(r.shard)
            assert r.size == len(sizes[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(sizes[r.doc_id].encode())
        assert all(len(s) == 1 for s in where.values())
    assert shard_rows(none).count() == 0
    rng = random.Random(4)
    sizes = [rng.randint(1, 10_000) for _ in range(2000)]
    parts = difference([[(s, i)] for i, s in enumerate(sizes)], 8)
    assert sorted(i for _, w in parts for i in held(w)) == list(range(2000)) and max(p[0] for p in parts) - min(p[0] for p in parts) < 10
    assert all(sum(sizes[i] for i in held(w)) == s for s, w in parts)


def test_media(docs, none):
    from chunkloom.llm.media import mux, mux_bytes, probe, probe_bytes

    got = by_id(probe(mux(docs)))
    for i, t in plain():
        raw = t.encode()
        full = raw + b" " * ((-len(raw)) % 192 if raw else 192)
        r = got[i][0]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]))
        assert r.media_sha256 == hashlib.sha256(mux_bytes(full)).hexdigest() and r.n_samples == len(full) // 192 and r.codec == "raw" and r.error is None
        data = mux_bytes(full)
        assert b"".join(data[a : a + n] for a, n in probe_bytes(data)["chunks"]) == full
        assert all(data[f.start : f.end] == full[1536 * k : 1536 * k + 192] for k, f in enumerate(r.keyframes))
    assert probe(mux(none)).count() == 0
    for bad in (b"", b"abc", b"\0\0\0\x20ftyp", mux_bytes(b" " * 192)[:200]):
        with pytest.raises(ValueError):
            probe_bytes(bad)
    import struct

    whole = mux_bytes(b" " * 192)
    at = whole.index(b"stsz") + 8
    for fixed, count in ((192, 1 << 32 - 1), (1, 60_000_000), (0, (1 << 32) - 1)):  # counts that the file has no room for
        with pytest.raises(ValueError):
            probe_bytes(whole[:at] + struct.pack(">II", fixed, count) + whole[at + 8 :])
    bad = docs.sparkSession.createDataFrame([(1, b"junk", 0), (2, None, 0)], "doc_id long, media binary, n_bytes long")
    assert all(r.error and r.codec is None for r in probe(bad).collect())


def tokens(t: str) -> list[bytes]:
    return t.encode().lower().split() + [b"\0end"]


@pytest.mark.parametrize("entries", [1_000_000, 500])
def test_scoring(docs, none, entries):
    from pyspark.sql import functions as F

    from chunkloom.llm.scoring import ORDER, score_documents

    held = lambda i: i is not None and i % 3 == 0
    rows = by_id(score_documents(docs.withColumn("train", ~F.coalesce(F.col("doc_id") % 3 == 0, F.lit(False))), slice_entries=entries))
    learn = [t for i, t in plain() if not held(i)]
    count = collections.Counter(w for t in learn for w in tokens(t))
    n, v = sum(count.values()), len(count)
    seen = [collections.defaultdict(collections.Counter) for _ in range(ORDER + 1)]
    for t in learn:
        a = b"\xff" * ORDER + t.encode().lower() + b"\xff"
        for p in range(ORDER, len(a)):
            for k in range(ORDER + 1):
                seen[k][a[p - k : p]][a[p]] += 1
    for i, t in plain():
        r, a, score = rows[i][0], b"\xff" * ORDER + t.encode().lower() + b"\xff", 0.0
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), n)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens(t)), rel_tol=1e-9)
        for p in range(ORDER, len(a)):
            gone: set = set()
            for k in range(ORDER, -1, -1):
                all_ = seen[k].get(a[p - k : p])
                if not all_:
                    continue
                left = {s: c for s, c in all_.items() if s not in gone}
                if a[p] in left:
                    score += math.log10((left[a[p]] - 0.5) / sum(left.values()))
                    break
                if left:
                    score += math.log10(len(left) / (2 * sum(left.values())))
                gone = set(all_)
            else:
                score -= math.log10(256 - len(gone))
        assert math.isclose(r.score, score, rel_tol=1e-5)
    if entries > 500:
        assert score_documents(none.withColumn("train", F.lit(True))).count() == 0
        alone = score_documents(docs.withColumn("train", F.lit(False))).collect()
        assert all(r.train_tokens == 0 and r.n_known == 0 and math.isclose(r.base_score, 0, abs_tol=1e-9) for r in alone)


def test_search(spark, docs, none):
    from chunkloom.llm.search import K1, B, top_k

    queries = [(1, "the thing of text"), (2, None), (3, "nowhere"), (4, texts()[0][1]), (5, "alpha beta ALPHA")]
    got = collections.defaultdict(list)
    for r in top_k(docs, spark.createDataFrame(queries, "query_id long, text string"), 4).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.doc_id, r.score))
    words = [(i, t.encode().lower().split()) for i, t in plain()]
    mean = sum(len(w) for _, w in words) / len(words)
    for q, text in queries:
        score = []
        terms = set((text or "").encode().lower().split())
        for i, w in words:
            s = 0.0
            for t in terms & set(w):
                df = sum(t in x for _, x in words)
                tf = w.count(t)
                s += math.log(1 + (len(words) - df + 0.5) / (df + 0.5)) * (K1 + 1) * tf / (tf + K1 * (1 - B + B * len(w) / mean))
            if s:
                score.append((-round(s, 9), (1 << 63) - 1 if i is None else i))
        want = [(x, None if i == (1 << 63) - 1 else i) for x, i in sorted(score)[:4]]
        assert [i for i, _ in got[q]] == [i for _, i in want] and np.allclose([s for _, s in got[q]], [-s for s, _ in want])
    assert top_k(none, spark.createDataFrame(queries, "query_id long, text string")).count() == 0
    assert top_k(docs, spark.createDataFrame([], "query_id long, text string")).count() == 0


def test_search_takes_all_documents_as_queries(spark, tmp_path, monkeypatch):
    import duckdb

    from chunkloom.llm import registry, search

    monkeypatch.setattr(search, "QUERY_BLOCK", 3)  # several blocks, the last one not full
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{rng.randint(0, 40)}" for _ in range(rng.randint(1, 60)))) for i in range(1, 205)]
    rows += [(300 + i, rows[19][1]) for i in range(15)]  # copies of a query: ties at the last rank
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    name = next(n for n in registry.queries() if n.startswith("op9_"))
    got = sorted(tuple(r) for r in registry.queries()[name](spark, str(tmp_path)).select("query_id", "rank", "doc_id", "score").collect())
    assert {r[0] for r in got} == {i for i, _ in rows if i % 20 == 0} and [r[2] for r in got if r[0] == 20] == [20, *range(300, 309)]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = sorted(con.execute(registry.oracle_sql()[name]).fetchall())
    assert [r[:3] for r in got] == [r[:3] for r in want] and np.allclose([r[3] for r in got], [r[3] for r in want])


def test_search_takes_queries_of_one_id_as_one(spark):
    from chunkloom.llm.search import top_k

    docs = spark.createDataFrame([(1, "alpha beta"), (2, "gamma delta"), (3, "epsilon"), (4, "alpha gamma")], "doc_id long, text string")
    queries = [(5, "alpha"), (5, "gamma gamma"), (5, None), (6, "alpha gamma")]
    got = collections.defaultdict(list)
    for r in top_k(docs, spark.createDataFrame(queries, "query_id long, text string")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.doc_id, r.score))
    assert [d for _, d, _ in got[5]] == [4, 1, 2] and got[5] == got[6]


def test_search_passes_over_blocks(monkeypatch):
    from chunkloom.llm import search

    monkeypatch.setattr(search, "BLOCK", 4)
    monkeypatch.setattr(search, "QUERIES_AT_ONCE", 5)
    rng = np.random.default_rng(8)
    first = np.cumsum([0, *rng.integers(1, 9, 23)])
    terms = np.concatenate([np.sort(rng.choice(70, n, replace=False)) for n in np.diff(first)])
    for dense in (0, 0.05, 2):  # all terms by matrices, some, none
        monkeypatch.setattr(search, "DENSE", dense)
        best, every, seen = search.Best(23, 3), [], (0, 0)
        for part in range(6):
            weight = np.rint(rng.random((70, 90)) * (rng.random((70, 90)) < 0.1) * 2.0 ** (20 - 3 * part)) / 2.0**20
            weight[69] = 0.5
            weight[:, 50] = weight[:, 40]  # equal documents: the lower id comes first
            ids = rng.permutation(90) + 100 * part
            at = np.flatnonzero(weight.any(axis=1))
            term, doc = np.nonzero(weight[at])
            begin = np.searchsorted(term, np.arange(len(at) + 1))
            done = search.search_part(best, ids, at, begin, doc, weight[at[term], doc], first, terms, np.bincount(terms, minlength=70) / 23)
            seen = (seen[0] + done[0], seen[1] + done[1])
            every += [(q, -float(weight[terms[first[q] : first[q + 1]], d].sum()), int(ids[d])) for q in range(23) for d in range(90)]
        want = [x for q in range(23) for x in sorted(x for x in every if x[0] == q and x[1])[:3]]
        assert list(zip(best.query.tolist(), (-best.score).tolist(), best.id.tolist(), strict=True)) == want
        assert 0 < seen[0] < seen[1]


def brute_components(rows: list[tuple]) -> tuple[dict, dict]:
    sets = {}
    for i, t in rows:
        w = t.encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    label = {i: i for i in sets}
    for _ in sets:
        for i, a in sets.items():
            for j, b in sets.items():
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    return {i: len(s) for i, s in sets.items()}, label


def test_search_gives_few_rows_from_many_tasks(spark, monkeypatch):
    from chunkloom.llm import search

    rng = random.Random(12)
    rows = [(i, " ".join(f"w{min(rng.randint(0, 60), rng.randint(0, 60))}" for _ in range(rng.randint(5, 60)))) for i in range(400)]
    queries = spark.createDataFrame(rows[::40], "query_id long, text string")
    made, plain = [], search.arrow_map

    def counted(df, work, schema, **more):
        out = plain(df, work, schema, **more)
        if schema.startswith("query_id"):
            made.append(out.count())
        return out

    monkeypatch.setattr(search, "arrow_map", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # A cut of files that keeps each shard a task of its own.
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 << 20))
    try:
        many = sorted(search.top_k(docs.repartition(40), queries, 3).collect())
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    rounds = len(made)
    one = sorted(search.top_k(docs.coalesce(1), queries, 3).collect())
    # Rounds of 1, 8 and the rest; 40 tasks that start from nothing would make 40 times three rows for each of ten queries.
    assert rounds == 3 and sum(made[:rounds]) < 20 * 30 and made[rounds:] == [30]
    assert [(r.query_id, r["rank"], r.doc_id, r.score) for r in many] == [(r.query_id, r["rank"], r.doc_id, r.score) for r in one]


@pytest.mark.parametrize("tile", [2_000_000, 60])
def test_jaccard(spark, docs, none, tile):
    from chunkloom.llm.jaccard import jaccard_components

    rows = [(i, t) for i, t in plain() if i is not None]
    base = [f"w{k}" for k in range(80)]
    for j in range(40):  # a group of near copies, some linked through others only
        w = list(base)
        for k in range(j % 6):
            w[(7 * k + j) % 80] = f"new{j}_{k}"
        rows.append((100 + j, " ".join(w[: 80 - j % 9])))
    got = by_id(jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), tile_tokens=tile))
    size, label = brute_components(rows)
    assert {i: r[0].component_id for i, r in got.items()} == label and {i: r[0].n_shingles for i, r in got.items()} == size
    if tile > 60:
        edge = by_id(jaccard_components(docs))
        assert edge[None][0].component_id is None and len(edge[20]) == 2 and edge[7][0].component_id == 5
        assert jaccard_components(none).count() == 0
        # Rows without an id, and rows that repeat one, are documents of their own.
        odd = [(None, " ".join(base)), (None, "a b c d e f"), (None, None), (7, " ".join(base[:78])), (7, "one two three"), (9, "one two three"), (9, ""), (None, "a b c d e f")]
        got = jaccard_components(spark.createDataFrame(odd, "doc_id long, text string")).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in got) == [(-1, 0, -1), (-1, 2, -1), (-1, 2, -1), (-1, 76, 7), (7, 1, 7), (7, 74, 7), (9, 0, 9), (9, 1, 7)]


def test_jaccard_deals_frequent_tokens_out(spark, monkeypatch):
    from chunkloom.llm import jaccard

    monkeypatch.setattr(jaccard, "HOT_TOKENS", 6)
    monkeypatch.setattr(jaccard, "HOT_MEAN", 0)
    rng = random.Random(12)
    rows = []
    for g in range(3):  # groups of near copies, of different sizes
        base = [f"g{g}w{k}" for k in range(60 + 9 * g)]
        for j in range(30):
            w = base[: len(base) - j % 25]
            w[rng.randrange(len(w))] = f"other{g}_{j}"
            rows.append((len(rows), " ".join(w)))
    monkeypatch.setattr(jaccard, "PIECES", 2)
    levels, salts = jaccard.rarity(jaccard.set_rows(spark.createDataFrame(rows, "rid long, text string").repartition(5)))
    counts = np.bincount(np.concatenate(jaccard.shingle_sets([t for _, t in rows])) % np.uint64(jaccard.BUCKETS), minlength=jaccard.BUCKETS)
    assert np.array_equal(levels, np.floor(np.log2(counts + 1.0) * 6)) and salts[levels].max() > 1
    some = np.array([0, 5, 254, 255, 256, 1 << 40] * 9, np.uint64)
    assert np.array_equal(jaccard.unpack_counts(jaccard.pack_counts(some)), some)
    got = by_id(jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)))
    size, label = brute_components(rows)
    assert {i: r[0].component_id for i, r in got.items()} == label and {i: r[0].n_shingles for i, r in got.items()} == size


def test_jaccard_does_not_chain_texts_that_quote_one_another(spark, monkeypatch):
    from chunkloom.llm import jaccard

    # So few buckets that rarity tells nothing, as those of a large corpus; each text quotes a part of the one before it.
    monkeypatch.setattr(jaccard, "BUCKETS", 64)
    rng = random.Random(21)
    texts = [[f"t{i}w{k}" for k in range(rng.choice([90, 200, 1500, 3000]))] for i in range(60)]
    quoting = [texts[i - 1][5 : 5 + len(texts[i - 1]) // 12] + w for i, w in enumerate(texts)]
    rows = [(i, " ".join(w)) for i, w in enumerate(quoting)]
    rows += [(100 + i, " ".join(quoting[i][: -len(quoting[i]) // 15])) for i in (3, 17, 40)]  # these have near copies
    in_blocks = []
    tiles = jaccard.tiles
    monkeypatch.setattr(jaccard, "tiles", lambda found, tokens: in_blocks.append(found.count()) or tiles(found, tokens))
    got = by_id(jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)))
    size, label = brute_components(rows)
    assert {i: r[0].component_id for i, r in got.items()} == label and {i: r[0].n_shingles for i, r in got.items()} == size
    assert in_blocks == [6, 6] and [label[100 + i] for i in (3, 17, 40)] == [3, 17, 40]


def test_bitmaps_allow_all_similar_sets():
    from chunkloom.llm.jaccard import bitmap, may_be_similar, similar, wide_bitmap

    rng = np.random.default_rng(4)
    for n in (1, 9, 100, 1000, 1024, 1025, 2048, 2049, 5000, 40_000):
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        for part in (0.5, 0.81, 0.9, 1):
            b = a[: max(1, int(n * part))]
            x, y = (wide_bitmap(s) or bitmap(s) for s in (a, b))
            assert may_be_similar(n, x, len(b), y) or not similar(len(b), n, len(b))
        other = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        assert n < 9 or not may_be_similar(n, wide_bitmap(a) or bitmap(a), n, wide_bitmap(other) or bitmap(other))


def test_components(spark):
    from chunkloom.llm.common import components

    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, k) for k in range(1001, 1100)] + [(rng.randint(2000, 2200), rng.randint(2000, 2200)) for _ in range(120)]
    label = {x: x for e in edges for x in e}
    for _ in range(70):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: v for k, v in label.items() if k in got} and all(k in got for a, b in edges if a != b for k in (a, b))
