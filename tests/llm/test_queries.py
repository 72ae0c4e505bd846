"""Every registered query run as it is, on the driver's smallest tables and on a small odd one, against SQL or an independent account."""

from __future__ import annotations

import collections
import glob
import hashlib
import math
import os
import random
import zlib

import numpy as np
import pytest

from chunkloom.llm import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = registry.oracle_sql()
QUERIES = registry.queries()
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def odd_documents() -> list[tuple]:
    """Unique ids; copies, near copies, null and empty texts, ties, repeated lines, blanks of all kinds."""
    rng = random.Random(21)
    word = lambda: rng.choice(["alpha", "beta", "Gamma", "delta", "épée", "the", "of", "x1", "don't", "zwölf", "<|endoftext|>", "12,5"])
    line = lambda n: " ".join(word() for _ in range(n))
    base = line(60)
    near = base.split(" ")
    near[30] = "changed"
    texts = [base, " ".join(near), base, None, "", "  \t\n ", base + "\n" + line(20), line(20) + "\n" + base, "\t" + base.replace(" ", "\t", 5), "one two", "ONE two", "two\none two\none two", "7", "a" * 3000]
    texts += [line(rng.randint(1, 80)) for _ in range(30)] + [base] * 5
    return [(i, t, rng.choice(["en", "de", None]), "s", None, "e") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(odd_documents(), DOCUMENTS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    pages = [(i, f"https://a/{i}", h, "x") for i, h in enumerate(["<p>é\r\n</p>", "same", None, "", "same", "lone", "x" * 9000, "same"])]
    spark.createDataFrame(pages, "page_id long, url string, html string, extra string").repartition(2).write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame([(20, base_query()), (21, "beta"), (40, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def base_query() -> str:
    return "alpha beta the of zwölf"


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("where", ["data", "odd"])
@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, odd, name, where):
    import duckdb

    folder = DATA if where == "data" else odd
    if not os.path.isdir(folder):
        pytest.skip("the driver's tables are not here")
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}{'/*.parquet' if os.path.isdir(f) else ''}')")
    df = QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    ours = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=repr)
    found = con.execute(SQL[name])
    names = [d[0] for d in found.description]
    theirs = sorted(([plain(dict(zip(names, r, strict=True))[c]) for c in columns] for r in found.fetchall()), key=repr)
    assert sorted(names) == columns and ours == theirs


def rows_of(spark, name: str, folder: str) -> dict[int, list]:
    out = collections.defaultdict(list)
    for r in QUERIES[name](spark, folder).collect():
        out[r.doc_id].append(r)
    return out


def held(i: int, mod: int) -> bool:
    return zlib.crc32(str(i).encode()) % mod == 2


def test_op1(spark, odd):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    lib, got = Tokenizer.from_file(P.path("byte_bpe_50k.json")), rows_of(spark, "op1_bpe", odd)
    for i, t, *_ in odd_documents():
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        assert [(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got[i]] == [want]


def test_op4(spark, odd):
    got = rows_of(spark, "op4_language_id", odd)
    for i, t, *_ in odd_documents():
        (r,) = got[i]
        assert r.held_out == held(i, 4) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, t or ""))) and r.lang_pred in ("und", "en", "de")


def test_op4_never_learns_from_what_is_held_out(spark, tmp_path):
    """Labels, ids and sources of held-out rows change nothing, nor do those of any row in its own prediction."""
    rows = [(i, t, lang, s, n, e) for i, t, lang, s, n, e in odd_documents()]
    other = [(i, t, "xx" if held(i, 4) else lang, f"s{i}", n, e) for i, t, lang, s, n, e in rows]
    found = []
    for k, table in enumerate((rows, other)):
        spark.createDataFrame(table, DOCUMENTS).write.parquet(f"{tmp_path}/{k}/documents.parquet")
        found.append(sorted((r.doc_id, r.lang_pred, r.score) for r in QUERIES["op4_language_id"](spark, f"{tmp_path}/{k}").collect()))
    assert found[0] == found[1]


def test_op5(spark, odd):
    from tokenizers import Tokenizer

    from chunkloom.llm.packing import vocabulary

    lib, got, places = Tokenizer.from_file(vocabulary()), rows_of(spark, "op5_best_fit_packing", odd), collections.defaultdict(list)
    for i, t, *_ in odd_documents():
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        want = [(k, a, len(ids[a : a + 4096]), zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in got[i]) == want
        for r in got[i]:
            places[r.sequence_id].append((r.offset, r.length))
    total = sum(n for p in places.values() for _, n in p)
    assert len(places) == -(-total // 4096)
    for spans in places.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 4096


def test_op6(spark, odd):
    got, slots, bytes_of, shard_of = rows_of(spark, "op6_sharding", odd), collections.defaultdict(list), collections.Counter(), {}
    for i, t, *_ in odd_documents():
        (r,) = got[i]
        raw = (t or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None) and 0 <= r.shard < 8
        assert shard_of.setdefault(raw, r.shard) == r.shard
        slots[r.shard].append(r.slot)
        bytes_of[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = collections.Counter()
    for i, t, *_ in odd_documents():
        groups[t or ""] += len((t or "").encode()) + 1
    assert max(bytes_of.values()) <= max(max(groups.values()), sum(groups.values()) / 8 * 1.6)


def test_op7(spark, odd):
    from chunkloom.llm.media import mux_bytes

    got, seen = rows_of(spark, "op7_media_columns", odd), {}
    for i, t, *_ in odd_documents():
        (r,) = got[i]
        raw = (t or "").encode()
        full = raw + b" " * ((-len(raw)) % 192 if raw else 192)
        media = mux_bytes(full)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest()) and f"samples={len(full) // 192};" in r.feature
        assert seen.setdefault(raw, r.feature) == r.feature


def test_op8(spark, odd):
    got = rows_of(spark, "op8_lm_scoring", odd)
    words = lambda t: [*(t or "").encode().lower().split(), b"\0end"]
    count = collections.Counter(w for i, t, *_ in odd_documents() if not held(i, 7) for w in words(t))
    n, v = sum(count.values()), len(count)
    for i, t, *_ in odd_documents():
        (r,) = got[i]
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words(t))
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i, 7), len(words(t)), sum(count[w] > 0 for w in words(t)), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score <= 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, tmp_path_factory, name):
    folder = str(tmp_path_factory.mktemp("none"))
    for table, schema in (("documents", DOCUMENTS), ("pages", "page_id long, url string, html string"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{folder}/{table}.parquet")
    assert QUERIES[name](spark, folder).count() == 0
