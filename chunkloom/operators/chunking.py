"""Content-defined chunking.

A cut falls after a byte whose fingerprint, a sum of random numbers of the bytes before it shifted by their distance,
has zeros in its lowest bits. These bits see the last k bytes only, so where chunks are at least k bytes long, the possible cuts
do not depend on earlier ones: they are found for a whole object at once, and only the choice among them is a loop.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkloom.functions.hashing import manifest_id, scoped_sha256

STEP = 0x9E3779B97F4A7C15


@lru_cache(1)
def gear() -> np.ndarray:
    """256 numbers of the splitmix64 sequence that starts at its own increment."""
    x = np.uint64(STEP) + np.arange(1, 257, dtype=np.uint64) * np.uint64(STEP)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def mask_bits(avg: int) -> int:
    """The power of two that is at least avg, as an exponent."""
    return max(0, int(avg - 1).bit_length())


def possible_cuts(data: bytes, k: int, block: int = 1 << 20) -> np.ndarray:
    """Where the lowest k bits of the fingerprint are zeros. Worked out block by block, each with the k - 1 bytes before it, so that
    the numbers held at once do not grow with the object."""
    table, mask, found = gear() & np.uint64((1 << k) - 1), np.uint64((1 << k) - 1), []
    for start in range(0, len(data), block):
        before = min(start, k - 1)
        g = table[np.frombuffer(data, np.uint8, min(block, len(data) - start) + before, start - before)]
        h = g.copy()
        for j in range(1, k):
            h[j:] += g[: max(0, len(g) - j)] << np.uint64(j)
        found.append(np.flatnonzero((h[before:] & mask) == 0) + start + 1)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def chunk_sizes(data: bytes, low: int, avg: int, high: int) -> list[int]:
    """Sizes of the chunks of an object; what is left when fewer than `high` bytes remain is one chunk."""
    if len(data) < high:
        return [len(data)]
    k, table = mask_bits(avg), gear()
    sizes, at = [], 0
    if low >= k:
        cuts = possible_cuts(data, k)
        while len(data) - at >= high:
            i = int(np.searchsorted(cuts, at + low))
            size = int(cuts[i]) - at if i < len(cuts) and cuts[i] <= at + high else high
            sizes.append(size)
            at += size
    else:
        numbers, mask = table.tolist(), (1 << k) - 1
        while len(data) - at >= high:
            fp, size = 0, high
            for i in range(high):
                fp = ((fp << 1) + numbers[data[at + i]]) & 0xFFFFFFFFFFFFFFFF
                if i + 1 >= low and not fp & mask:
                    size = i + 1
                    break
            sizes.append(size)
            at += size
    if at < len(data):
        sizes.append(len(data) - at)
    return sizes


def manifest_digest(scope: str, file_hash: str, size: int, kind: str, refs: list[dict]) -> str:
    """The same address as `manifest_id` gives, of references in order."""
    found = hashlib.sha256(b"\0".join([b"manifest", scope.encode(), file_hash.encode()]) + b"\0" + size.to_bytes(8, "little") + kind.encode() + b"\0")
    for r in refs:
        found.update(r["chunk_id"].encode() + r["file_offset"].to_bytes(8, "little") + r["chunk_size"].to_bytes(8, "little"))
    return found.hexdigest()


def cut_function(low: int, avg: int, high: int):
    """Row by row, of which Spark sends a hundred at a time: an Arrow batch has ten thousand, whose contents would lie in each Python worker at once."""
    return F.udf(lambda data: chunk_sizes(bytes(data or b""), low, avg, high), "array<long>", useArrow=False)


def chunk(objects: DataFrame, low: int, avg: int, high: int, content: str = "raw", scope: Column | None = None) -> DataFrame:
    """Each object's chunks: the columns of `objects` but its content, with chunk_index, file_offset, chunk_size,
    chunk_id, raw, and the file_hash of the whole object. An empty object has one empty chunk. Objects shorter than `high` are whole and never leave the JVM."""
    raw = F.coalesce(content, F.lit(b""))
    long_ = F.octet_length("_raw") >= high
    whole = F.array(F.octet_length("_raw").cast("long"))
    of = objects.drop(content).columns
    base = objects.select(*of, raw.alias("_raw"), (scope if scope is not None else F.lit(None).cast("string")).alias("_scope"))
    hashed = lambda c: scoped_sha256(F.col(c), F.col("_scope") if scope is not None else None)
    base = base.withColumn("file_hash", hashed("_raw"))
    sized = base.where(~long_).withColumn("_sizes", whole).union(base.where(long_).withColumn("_sizes", cut_function(low, avg, high)("_raw")))
    ends = F.reduce("_sizes", F.array().cast("array<bigint>"), lambda all_, s: F.concat(all_, F.array(F.coalesce(F.try_element_at(all_, F.lit(-1)), F.lit(0)) + s)))
    pieces = sized.withColumn("_ends", F.when(F.size("_sizes") > 1, ends).otherwise(F.col("_sizes")))
    out = pieces.select("*", F.posexplode("_sizes").alias("chunk_index", "chunk_size")).withColumn("file_offset", F.get("_ends", F.col("chunk_index")) - F.col("chunk_size"))
    part = F.when(F.size("_sizes") == 1, F.col("_raw")).otherwise(F.expr("substring(_raw, cast(file_offset + 1 as int), cast(chunk_size as int))"))
    out = out.select(*of, "chunk_index", "file_offset", "chunk_size", "file_hash", part.alias("raw"), "_scope")
    return out.withColumn("chunk_id", hashed("raw")).drop("_scope")


def manifests(chunks: DataFrame, keys: list[str], scope: Column) -> DataFrame:
    """(keys, file_size, chunk_count, chunking_type, file_hash, manifest_id) of objects, from the rows of `chunk`. Only references are
    gathered, no content."""
    refs = F.sort_array(F.collect_list(F.struct("chunk_index", "chunk_id", "file_offset", "chunk_size")))
    out = chunks.withColumn("_scope", scope).groupBy(*keys, "_scope").agg(refs.alias("refs"), F.sum("chunk_size").alias("file_size"), F.first("file_hash").alias("file_hash"))
    out = out.withColumn("chunk_count", F.size("refs")).withColumn("chunking_type", F.when(F.col("chunk_count") > 1, "FASTCDC").otherwise("SINGLE"))
    return out.withColumn("manifest_id", manifest_id(F.col("_scope"), F.col("file_hash"), F.col("file_size"), F.col("chunking_type"), F.col("refs"))).drop("refs", "_scope")
