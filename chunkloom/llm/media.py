"""Media columns: payloads stored in ISO base media files, and what their boxes say, without decoding samples.

`mux` lays a payload out as fixed-size samples of one track: ftyp, moov (with its nested sample tables) and mdat.
`probe` walks the nested boxes of any such file and decodes the sample tables.

Edge cases: a null payload is stored as an empty one; an empty track has no samples and no key frames; equal
payloads give equal files; bytes that are no ISO media file give a row whose `error` says why and whose other fields
are null; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.llm.common import arrow_map, read

#: Bytes of a media sample; samples between key frames; samples of a chunk; units of time a second.
SAMPLE_BYTES, KEY_EVERY, CHUNK_SAMPLES, TIMESCALE = 192, 8, 64, 48_000
#: Boxes that hold boxes, with the bytes before the first of them.
CONTAINERS = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"dinf": 0, b"stbl": 0, b"edts": 0, b"udta": 0, b"mvex": 0, b"moof": 0, b"traf": 0, b"stsd": 8, b"dref": 8}


def box(kind: bytes, *parts: bytes) -> bytes:
    n = 8 + sum(map(len, parts))
    head = struct.pack(">I4s", n, kind) if n < 1 << 32 else struct.pack(">I4sQ", 1, kind, n + 8)
    return head + b"".join(parts)


def full_box(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


def mux_bytes(payload: bytes, sample: int = SAMPLE_BYTES, key_every: int = KEY_EVERY, chunk: int = CHUNK_SAMPLES) -> bytes:
    """A media file of one raw 8-bit track; the length of `payload` is a multiple of `sample`."""
    n = len(payload) // sample
    if n * sample != len(payload):
        raise ValueError("the payload is not a whole number of samples")
    full, rest = divmod(n, chunk)
    chunks = full + bool(rest)
    runs = [(1, chunk)] * bool(full) + [(full + 1, rest)] * bool(rest)
    keys = range(1, n + 1, key_every)
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    duration = n * sample
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"iso2")

    def moov(first: int, wide: bool) -> bytes:
        offsets = [first + i * chunk * sample for i in range(chunks)]
        entry = box(b"raw ", bytes(6), struct.pack(">HIIHHHHI", 1, 0, 0, 1, 8, 0, 0, TIMESCALE << 16))
        stbl = box(
            b"stbl",
            full_box(b"stsd", struct.pack(">I", 1), entry),
            full_box(b"stts", struct.pack(">I", bool(n)), struct.pack(">II", n, sample) if n else b""),
            full_box(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", a, b, 1) for a, b in runs)),
            full_box(b"stsz", struct.pack(">II", sample, n)),
            full_box(b"co64" if wide else b"stco", struct.pack(f">I{chunks}{'Q' if wide else 'I'}", chunks, *offsets)),
            full_box(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
        )
        minf = box(b"minf", full_box(b"smhd", bytes(4)), box(b"dinf", full_box(b"dref", struct.pack(">I", 1), full_box(b"url ", flags=1))), stbl)
        mdia = box(b"mdia", full_box(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, duration & 0xFFFFFFFF, 0x55C4, 0)), full_box(b"hdlr", bytes(4), b"soun", bytes(12), b"\0"), minf)
        tkhd = full_box(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, duration & 0xFFFFFFFF), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), matrix, bytes(8), flags=7)
        mvhd = full_box(b"mvhd", struct.pack(">IIII", 0, 0, TIMESCALE, duration & 0xFFFFFFFF), struct.pack(">IH", 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    wide = len(payload) > 0xF0000000
    head = 8 if len(payload) + 8 < 1 << 32 else 16
    first = len(ftyp) + len(moov(0, wide)) + head
    return ftyp + moov(first, wide) + box(b"mdat", payload)


def boxes(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, first byte of the content, end) of each box between two places."""
    while at < end:
        if at + 8 > end:
            raise ValueError("a box header is cut off")
        n, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if n == 1:
            if at + 16 > end:
                raise ValueError("a box header is cut off")
            (n,), head = struct.unpack_from(">Q", data, at + 8), 16
        elif n == 0:
            n = end - at
        if n < head or at + n > end:
            raise ValueError(f"box {kind!r} does not fit in its parent")
        yield kind, at + head, at + n
        at += n


def find(data: bytes, at: int, end: int, *path: bytes) -> tuple[int, int] | None:
    for kind, a, b in boxes(data, at, end):
        if kind == path[0]:
            return (a, b) if len(path) == 1 else find(data, a + CONTAINERS.get(kind, 0), b, *path[1:])
    return None


def probe_bytes(data: bytes) -> dict:
    """Codec, duration, samples and key frames of the first track, from its tables alone.

    chunks: (offset, bytes) of each chunk in order; keyframes: (start, end) of each key frame's bytes."""
    moov = find(data, 0, len(data), b"moov")
    trak = moov and find(data, *moov, b"trak")
    mdia = trak and find(data, *trak, b"mdia")
    stbl = mdia and find(data, *mdia, b"minf", b"stbl")
    if not stbl:
        raise ValueError("there is no track with sample tables")

    def table(*kinds: bytes) -> int | None:
        got = next((x for x in (find(data, *stbl, k) for k in kinds) if x), None)
        return got[0] if got else None

    mdhd = find(data, *mdia, b"mdhd")[0]
    timescale, duration = struct.unpack_from(">II", data, mdhd + 12) if data[mdhd] == 0 else struct.unpack_from(">IQ", data, mdhd + 20)
    codec = data[table(b"stsd") + 12 : table(b"stsd") + 16].decode("latin-1").strip()
    fixed, n = struct.unpack_from(">II", data, table(b"stsz") + 4)
    # Counts are believed only as far as the file has room for what they count.
    if n * (fixed or 4) > len(data):
        raise ValueError(f"there is no room for {n} samples")
    sizes = [fixed] * n if fixed else list(struct.unpack_from(f">{n}I", data, table(b"stsz") + 12))
    at, form = (table(b"stco"), "I") if table(b"stco") is not None else (table(b"co64"), "Q")
    (chunks,) = struct.unpack_from(">I", data, at + 4)
    offsets = struct.unpack_from(f">{chunks}{form}", data, at + 8)
    at = table(b"stsc")
    (k,) = struct.unpack_from(">I", data, at + 4)
    runs = [struct.unpack_from(">III", data, at + 8 + 12 * i)[:2] for i in range(k)]
    at = table(b"stts")
    (k,) = struct.unpack_from(">I", data, at + 4)
    ticks = sum(a * b for a, b in (struct.unpack_from(">II", data, at + 8 + 8 * i) for i in range(k)))
    at = table(b"stss")
    keys = set(range(1, n + 1)) if at is None else set(struct.unpack_from(f">{struct.unpack_from('>I', data, at + 4)[0]}I", data, at + 8))
    spans, keyframes, s = [], [], 0
    for i, (first, per) in enumerate(runs):
        last = runs[i + 1][0] - 1 if i + 1 < len(runs) else chunks
        for c in range(first - 1, last):
            place = offsets[c]
            for size in sizes[s : s + per]:
                s += 1
                if s in keys:
                    keyframes.append((place, place + size))
                place += size
            if place > len(data):
                raise ValueError("a chunk lies beyond the end of the file")
            spans.append((offsets[c], place - offsets[c]))
    return {"codec": codec, "timescale": timescale, "duration": duration or ticks, "samples": n, "chunks": spans, "keyframes": keyframes}


def mux(df: DataFrame, id_col: str = "doc_id", payload_col: str = "text") -> DataFrame:
    """(id, n_bytes long, media binary) of each row; the payload is padded with spaces to whole samples, one at least."""

    def work(it):
        for cols in it:
            raw = [x if isinstance(x, bytes) else (x or "").encode() for x in cols["payload"]]
            yield {id_col: cols[id_col], "n_bytes": [len(x) for x in raw], "media": [mux_bytes(x + b" " * ((-len(x)) % SAMPLE_BYTES if x else SAMPLE_BYTES)) for x in raw]}

    return arrow_map(df.select(id_col, F.col(payload_col).alias("payload")), work, f"{id_col} {dict(df.dtypes)[id_col]}, n_bytes long, media binary")


def probe(df: DataFrame, id_col: str = "doc_id", media_col: str = "media", keep: tuple[str, ...] = ("n_bytes",)) -> DataFrame:
    """(id, kept columns, codec, duration_s, n_samples, keyframes, media_bytes, media_sha256, payload_bytes,
    payload_sha256, tail_crc32, error) of each stored file; the digests are those of the samples as stored."""

    def one(data: bytes | None) -> tuple:
        try:
            if data is None:
                raise ValueError("there is no file")
            x = probe_bytes(data)
        except (ValueError, struct.error, TypeError, IndexError) as e:
            return (None,) * 9 + (str(e),)
        digest, tail, size = hashlib.sha256(), b"", 0
        view = memoryview(data)
        for offset, n in x["chunks"]:
            digest.update(view[offset : offset + n])
            tail, size = (tail + bytes(view[max(offset, offset + n - 16) : offset + n]))[-16:], size + n
        frames = [{"start": a, "end": b} for a, b in x["keyframes"]]
        return x["codec"], x["duration"] / x["timescale"] if x["timescale"] else 0.0, x["samples"], frames, len(data), hashlib.sha256(data).hexdigest(), size, digest.hexdigest(), zlib.crc32(tail), None

    names = ("codec", "duration_s", "n_samples", "keyframes", "media_bytes", "media_sha256", "payload_bytes", "payload_sha256", "tail_crc32", "error")

    def work(it):
        for cols in it:
            rows = list(zip(*map(one, cols["_media"]), strict=True))
            yield {k: cols[k] for k in (id_col, *keep)} | dict(zip(names, rows, strict=True))

    kinds = dict(df.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in (id_col, *keep)) + ", codec string, duration_s double, n_samples long, keyframes array<struct<start:long,end:long>>, media_bytes long, media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long, error string"
    return arrow_map(df.select(id_col, *keep, F.col(media_col).alias("_media")), work, schema)


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = probe(mux(read(spark, sf_dir, "documents")))
    ranges = F.concat_ws(",", F.transform("keyframes", lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))))
    feature = F.concat_ws(";", F.concat(F.lit("codec="), "codec"), F.concat(F.lit("samples="), "n_samples"), F.concat(F.lit("seconds="), F.format_number("duration_s", 6)), F.concat(F.lit("keyframes="), F.size("keyframes")), F.concat(F.lit("ranges_sha256="), F.sha2(ranges, 256)))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


QUERIES = {"op7_media_columns": op7_media_columns}
