"""Functions, chunking, settings and operators against known values."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from chunkloom.config import GcConfig, StoreConfig
from chunkloom.functions import codecs, hashing, paths
from chunkloom.operators import chunking, ingest, integrity, lifecycle, namespace


def pattern(a: int, b: int, n: int) -> bytes:
    return bytes((i * a + i // b) % 256 for i in range(n))


#: Content, number of chunks, first sizes, file hash and manifest id, for chunks of 8, 16 and 24 bytes of one tenant.
KNOWN = [
    (b"", 1, [0], "bdd38d82f3916c2d47184526d1f440ae95425291a7ecee1d592c9f975d3c17c8", "0450be6d41af19540674901bf0ecbd66751a056672e634126728e68a71b4448e"),
    (b"healthy", 1, [7], "33790c8d21f81c9a1eb16bc76bb2c135df8d598d1f939638943f0fbafa1d38bb", "95cd8c36f771a232906f0f33abd2de441ef0aab4dfc4d390e04123eca41645ad"),
    (b"a" * 512, 22, [24] * 5, "4b918af795dc8a7c4f07670c3e0f9b983b7ea4f14b84ea5368fee126d6b7a526", "a9051a9dcac97b226d2f81ea071b4e19219c7717b0a00b1543fd9eb0c9f598c1"),
    (b"c" * 128, 15, [8] * 5, "d1439c1ae002c83d19fa50ae2a4eb52ffbfa89c3178bac247d7bc4cace54bc4c", "74605a8b2f04d3c715c3dbadd13fb2b73ff9466b1490f0c2074475e8ca099ef4"),
    (pattern(31, 7, 768), 42, [13, 24, 24, 24, 24], "aff15aa702228bdff098aff479e4035438f6a0e1bdc98faaf3714519f66e982d", "3d0340fffb3be4a0c3aef60429f2207212bdeac8f1973ff0ccc7e676b1a43ce2"),
    (pattern(17, 5, 768), 43, [8, 19, 21, 24, 11], "eb3850229e80df130ac78de1bbb7803dd4c86f0cde4eef89f7d17a62713ae244", "caf0c5c288df6cd3bc165b8ab922507c07283105fbde3265f59f4ff8f7b4ac3e"),
    (pattern(37, 11, 4096), 233, [24, 24, 8, 24, 24], "5b0912babae8d8353b943dc8dd2bcc9c9b00bf9f586946b0434a50120359a154", "3bac5e0dc222aba037dfd01bf2ab3428fb7c86ce7553d06d7637e7a2136e2ef3"),
    (b"reuse-me" * 64, 62, [10, 8, 8, 8, 8], "80162b398b7aa0e8f077ce7b8804cdcf94e2a6150082700bedd202a9d577c59c", "63eabe6075739dae4ea6bf2be6959ffe89784d7b951fb3698821019d8cd37aea"),
]


def test_gear():
    assert hashlib.sha256(chunking.gear().astype("<u8").tobytes()).hexdigest() == "d29093e6712e90f0bc37a7f04c5354412a53527b1c94cba195bdba6a7158a4d1"


def test_chunks_and_manifests(spark):
    rows = [(i, "tenant-a", bytearray(c)) for i, (c, *_) in enumerate(KNOWN)] + [(99, "tenant-a", None)]
    df = spark.createDataFrame(rows, "id long, tenant string, raw binary")
    chunks = chunking.chunk(df, 8, 16, 24, scope=F.col("tenant"))
    got = {r.id: r for r in chunking.manifests(chunks, ["id"], F.col("tenant")).collect()}
    sizes = {}
    for r in chunks.orderBy("id", "chunk_index").collect():
        sizes.setdefault(r.id, []).append((r.file_offset, r.chunk_size))
    for i, (content, n, first, file_hash, manifest) in enumerate(KNOWN):
        assert [s for _, s in sizes[i]][:5] == first[: len(sizes[i])] and len(sizes[i]) == n
        assert all(o == sum(s for _, s in sizes[i][:k]) for k, (o, _) in enumerate(sizes[i]))
        assert (got[i].file_hash, got[i].manifest_id, got[i].chunking_type, got[i].file_size) == (file_hash, manifest, "FASTCDC" if n > 1 else "SINGLE", len(content))
    assert sizes[99] == [(0, 0)] and got[99].manifest_id == got[0].manifest_id


def test_cuts_do_not_depend_on_blocks():
    data = random.Random(4).randbytes(5000)
    whole = chunking.possible_cuts(data, 6).tolist()
    assert len(whole) > 30 and all(chunking.possible_cuts(data, 6, block).tolist() == whole for block in (1, 3, 64, 4999, 5000))


def test_cuts_without_a_window():
    """Where chunks may be shorter than the fingerprint's reach, each chunk starts a new one."""
    rng = random.Random(1)
    g = chunking.gear().tolist()
    for low, avg, high in ((2, 64, 100), (8, 16, 24), (10, 1024, 3000)):
        data, want, at = rng.randbytes(9000), [], 0
        while len(data) - at >= high:
            fp, size = 0, high
            for i in range(high):
                fp = (fp * 2 + g[data[at + i]]) % (1 << 64)
                if i + 1 >= low and fp % avg == 0:
                    size = i + 1
                    break
            want.append(size)
            at += size
        assert chunking.chunk_sizes(data, low, avg, high) == want + [len(data) - at] * (at < len(data))


def test_names(spark):
    good, bad = ["a", "A1", "x_y", "x-y", "x.y"], ["", ".", "..", "abcde", "b/t", "b t", "a\0", "a\n", None]
    df = spark.createDataFrame([(x, x in good) for x in good + bad], "v string, ok boolean")
    assert df.where(paths.valid_tenant(F.col("v"), 4) != F.col("ok")).count() == 0
    bad = ["", "/abs", "C:\\abs", "a//b", "a/./b", "a/../b", "abcde", "a" * 9, "a/\0", None]
    df = spark.createDataFrame([(x, x in ("a/b", "a\\b")) for x in ["a/b", "a\\b", *bad]], "v string, ok boolean")
    assert df.where(paths.valid_object_path(F.col("v"), 8, 4) != F.col("ok")).count() == 0
    got = spark.createDataFrame([(1,), (1024,), (1025,), (1048577,)], "n long").select(paths.segment_path(F.col("n"))).collect()
    assert [r[0] for r in got] == ["0000/0000/0000000000000001.blob", "0000/0000/0000000000001024.blob", "0000/0001/0000000000001025.blob", "0001/0000/0000000001048577.blob"]
    modes = spark.range(1).select(paths.file_mode(F.lit(0)), paths.file_mode(F.lit(0o755)), paths.file_mode(F.lit(0o755), True), paths.inode_name(F.lit(7)), paths.parent_path(F.lit("a/b/c")), paths.parent_path(F.lit("a"))).first()
    assert list(modes) == [0o644, 0o644, 0o755, "inode-0000000000000007", "a/b", ""]


def test_settings():
    base = StoreConfig(chunk_min=8, chunk_avg=16, chunk_max=24, gc=GcConfig(-1, -1, 1, 0.25)).normalised().validate()
    assert base.gc == GcConfig(0, 0, 1, 0.25) and StoreConfig(segment_size=0).normalised() == StoreConfig()
    for wrong in ({"compression": "gzip"}, {"checksum": "sha256"}, {"dedup_scope": "all"}, {"algorithm": "rabin"}, {"segment_size": -1}, {"chunk_min": 1 << 30}, {"gc": GcConfig(confirm_cycles=-1)}, {"gc": GcConfig(garbage_ratio=2.0)}):
        with pytest.raises(ValueError):
            StoreConfig(**wrong).normalised().validate()


def test_codecs(spark):
    assert codecs.crc32c_bytes(b"123456789") == 0xE3069283
    rng = random.Random(2)
    values = [rng.randbytes(rng.randint(0, 50)) for _ in range(60)] + [b""]
    assert codecs.crc32c_many(values).tolist() == [codecs.crc32c_bytes(v) for v in values]
    df = spark.createDataFrame([(bytearray(v),) for v in values], "raw binary").withColumn("z", codecs.zstd_compress("raw"))
    assert df.where(codecs.zstd_decompress("z") != F.col("raw")).count() == 0
    assert spark.range(1).select(hashing.scoped_sha256(F.lit(b"hello"), F.lit("tenant-a"))).first()[0] == "5dbc11398f6fbf9c6af9ae2824039943bad202993886dba87fe7170f2bd65346"


def test_next_fit(spark):
    sizes = [1000, 3000, 50, 9000, 10, 3900]
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(sizes)], "b int, i int, size long")
    got = [(r.segment, r.offset) for r in ingest.pack(df, ["b"], ["i"], "size", 4096).orderBy("i").collect()]
    want, segment, end = [], 0, 11
    for s in sizes:
        if end > 11 and end + 104 + s > 4096:
            segment, end = segment + 1, 11
        want.append((segment, end))
        end += 104 + s
    assert got == want


def test_dedup_and_marks(spark):
    new = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, "z")], "i int, chunk_id string")
    stored = spark.createDataFrame([("y", "s1", "ACTIVE", 1), ("z", "s1", "ACTIVE", 0)], "chunk_id string, segment_id string, state string, ref_count long")
    fine = ingest.reusable(stored, spark.createDataFrame([("s1", "SEALED")], "segment_id string, state string"))
    assert [r.disposition for r in ingest.classify(new, fine, ["i"]).orderBy("i").collect()] == ["new", "repeat", "reuse", "new"]
    chunks = spark.createDataFrame(
        [("a", "s", "ACTIVE", 0, 5, 0, 0, 0), ("b", "s", "GARBAGE_CANDIDATE", 0, 5, 0, 0, 1), ("c", "s", "CORRUPT", 0, 5, 0, 0, 0), ("d", "s", "ACTIVE", 1, 7, 0, 0, 0), ("e", "s", "ACTIVE", 0, 5, 99, 0, 0), ("f", "t", "DELETED", 0, 5, 0, 40, 0)],
        "chunk_id string, segment_id string, state string, ref_count long, length long, created_at long, deleted_at long, seen int",
    )
    marks = {r.chunk_id: (r.new_state, r.new_seen) for r in lifecycle.mark_garbage(chunks, 100, 1, 2).collect()}
    assert marks == {"a": ("GARBAGE_CANDIDATE", 1), "b": ("DELETED", 2)}
    segments = [("s", "SEALED", 0, 0, 0), ("t", "SEALED", 0, 0, 0), ("u", "SEALED", 0, 30, 1), ("v", "SEALED", 0, 0, 35), ("w", "SEALED", 41, 0, 0), ("x", "DELETED", 0, 0, 1), ("y", "CORRUPT", 0, 0, 1)]
    segments = spark.createDataFrame(segments, "segment_id string, state string, compacted_at long, sealed_at long, created_at long")
    stats = lifecycle.segment_stats(chunks, segments)
    dead = lambda now, pins=None: {r.segment_id for r in lifecycle.dead_segments(stats, now, 60, pins).collect()}
    pins = spark.createDataFrame([("t",), ("s",)], "segment_id string")
    assert dead(100) == {"t", "u", "v"} and dead(99) == {"u", "v"} and dead(101) == {"t", "u", "v", "w"} and dead(100, pins) == {"u", "v"}
    assert {(r.live, r.garbage) for r in lifecycle.compaction_candidates(stats, 0.7).collect()} == {(7, 20)} and lifecycle.compaction_candidates(stats, 0.7, pins).isEmpty()
    assert lifecycle.compaction_candidates(stats.withColumn("state", F.lit("COMPACTING")), 0.7).isEmpty()


def test_ranges(spark):
    df = spark.createDataFrame([(1, bytearray(b"0123456789abcdef"))], "id long, raw binary")
    chunks = chunking.chunk(df, 2, 4, 6)
    read = lambda a, n: [bytes(r.bytes) for r in integrity.read_range(chunks, ["id"], a, n).collect()]
    assert read(4, 5) == [b"45678"] and read(10, 99) == [b"abcdef"] and read(16, 5) == []
    with pytest.raises(ValueError):
        integrity.range_chunks(chunks, -1, 2)


def test_cycles(spark):
    nodes = spark.createDataFrame([(1, None, "r"), (2, 1, "a"), (3, 4, "b"), (4, 3, "c"), (5, 9, "d"), (6, 3, "e")], "node long, parent long, name string")
    assert {r.node for r in namespace.invalid_parents(nodes).collect()} == {3, 4, 5, 6}
    assert {r.path for r in namespace.full_paths(namespace.rename(nodes, 2, None, "top")).collect()} == {"r", "top"}


def test_deep_trees(spark):
    chain = [(i, i - 1 if i else None, f"n{i}") for i in range(1501)]
    nodes = spark.createDataFrame([*chain, (5000, 4999, "lost"), (5001, 5000, "lost too")], "node long, parent long, name string")
    assert {r.node for r in namespace.unreachable(nodes).collect()} == {5000, 5001}
    deepest = namespace.full_paths(nodes).orderBy(F.desc("depth")).first()
    assert deepest.depth == 1500 and deepest.path == "/".join(n for _, _, n in chain)
    entries = spark.createDataFrame([(1, 2), (2, 3), (3, 2), (1, 3), (8, 9), (9, 8)], "parent long, node long")
    assert {r.node for r in namespace.reachable_by_entries(spark.createDataFrame([(1,)], "node long"), entries).collect()} == {1, 2, 3}


def test_paths_of_the_file_system_and_times(spark):
    df = spark.createDataFrame([("/t//a/./b",), ("\\t\\a",), ("t/../a",), ("c:/x",), ("/",), ("t/" + "x" * 300,)], "p string")
    assert [r[0] for r in df.select(paths.file_system_parts(F.col("p"))).collect()] == [["t", "a", "b"], ["t", "a"], None, None, [], None]
    times = spark.createDataFrame([(1, 2, 3), (0, 2, 3), (0, 0, 3)], "a long, b long, c long")
    assert [r[0] for r in times.select(paths.modified(F.col("a"), F.col("b"), F.col("c"))).collect()] == [1, 2, 3]


def test_long_checksums():
    import os

    for n in (0, 1, 2047, 2048, 5000, 70_001):
        data = os.urandom(n)
        table, crc = codecs.castagnoli().tolist(), 0xFFFFFFFF
        for b in data:
            crc = table[(crc ^ b) & 255] ^ (crc >> 8)
        assert codecs.crc32c_bytes(data) == crc ^ 0xFFFFFFFF == codecs.crc32c_many([data, b"x"])[0]


def most_rows(function) -> int:
    """How many values a Python worker is sent at once."""
    from pyspark.util import PythonEvalType

    return {PythonEvalType.SQL_BATCHED_UDF: 100}.get(function.evalType, 10_000)


def test_objects_go_to_python_in_small_batches():
    assert most_rows(chunking.cut_function(8, 16, 24)) == 100


def test_payloads_go_to_python_in_small_batches(spark):
    assert most_rows(codecs.zstd_compress) == most_rows(codecs.zstd_decompress) == 100
    values = [bytes([i % 251]) * (i % 7) for i in range(2 * codecs.SLICE + 5)]
    df = spark.createDataFrame([(i, bytearray(v)) for i, v in enumerate(values)], "i int, raw binary").repartition(1)
    assert [r[1] for r in df.select("i", codecs.crc32c("raw")).orderBy("i").collect()] == [codecs.crc32c_bytes(v) for v in values]
