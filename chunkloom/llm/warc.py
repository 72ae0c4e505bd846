"""WARC archives: a Spark sink that writes them and a Python data source that reads them.

Writing uses the text sink with the record separator of the format, so any file system that Spark can write works.
Reading plans partitions from whole files, small ones together. A reader parses a record's header lines first, tests
the pushed predicates on them, and only then takes the payload; unwanted payloads are passed over undecoded.

Edge cases: a null payload is an empty one; rows with equal payloads, empty ones included, become one response (the
largest id) and revisits; null ids are written as an empty id and read back as null; a null URI is `page:` and the id; an empty table
writes no records; other columns of the input are not read. A record that is cut off, or that has no valid length, raises ValueError.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import os
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull

from chunkloom.llm.common import read, shared_dir

END = "\r\n"
VERSION = "WARC/1.1"
#: The profile of records that repeat the payload of another one, a fixed value of the format.
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "record_type string, record_id string, target_uri string, refers_to string, payload_digest string, content_length long, headers map<string,string>, payload binary"
#: Columns that header lines decide, with the names of the lines.
HEADER_COLUMNS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest", "content_length": "content-length"}


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def base32_of_hex(hexed: F.Column) -> F.Column:
    """Upper-case base32 of 40 hex digits: each 5 bits of the four 40-bit parts are one of 32 letters."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    out = []
    for part in range(4):
        value = F.conv(F.substring(hexed, part * 10 + 1, 10), 16, 10).cast("long")
        out += [F.substring(F.lit(letters), F.shiftright(value, shift).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1)) for shift in range(35, -1, -5)]
    return F.concat(*out)


def plan_records(df: DataFrame, id_col: str, payload_col: str, uri_col: str | None = None) -> DataFrame:
    """(id, uri, payload string, digest, record_type, refers_to): of equal payloads, the largest id is the response. Payloads are told
    apart by two hashes and their length, so that two with the same SHA-1 are both kept."""
    uri = F.col(uri_col).cast("string") if uri_col else F.lit(None).cast("string")
    rows = df.select(F.col(id_col).alias("id"), uri.alias("uri"), F.coalesce(payload_col, F.lit("")).alias("payload"))
    rows = rows.withColumn("sha1", F.sha1(F.col("payload").cast("binary")))
    rows = rows.withColumn("same", F.concat_ws("-", "sha1", F.xxhash64("payload"), F.octet_length("payload")))
    best = rows.groupBy("same").agg(F.max("id").alias("best"))
    rows = rows.join(best, "same")
    revisit = F.col("best").isNotNull() & ~F.col("id").eqNullSafe(F.col("best"))
    return rows.select("id", "uri", "payload", base32_of_hex(F.col("sha1")).alias("digest"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("best")).alias("refers_to"))


def write_archives(records: DataFrame, path: str, date: str = "2020-01-01T00:00:00Z", records_per_file: int = 50_000) -> None:
    """Writes the rows of `plan_records` as gzipped archives."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    full = F.octet_length("payload").cast("string")
    revisit = F.col("record_type") == "revisit"
    lines = [
        F.lit(VERSION), F.concat(F.lit("WARC-Type: "), "record_type"), F.concat(F.lit("WARC-Record-ID: <urn:page:"), text("id"), F.lit(">")), F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.coalesce(F.regexp_replace("uri", "[\\r\\n ]", "%20"), F.concat(F.lit("page:"), text("id")))), F.when(revisit, F.lit(f"WARC-Profile: {REVISIT}")), F.concat(F.lit("WARC-Payload-Digest: sha1:"), "digest"), F.concat(F.lit("X-Full-Length: "), full),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), text("refers_to"), F.lit(">"))), F.lit("Content-Type: text/html"), F.concat(F.lit("Content-Length: "), F.when(revisit, "0").otherwise(full)),
    ]
    value = F.concat(F.concat_ws(END, *lines), F.lit(END + END), F.when(revisit, "").otherwise(F.col("payload")))
    records.select(value.alias("value")).write.option("lineSep", END + END).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


@dataclass
class Files(InputPartition):
    paths: list[str] = field(default_factory=list)

    def __init__(self, paths: list[str]):
        super().__init__(0)
        self.paths = paths


def file_system(uri: str):
    """(file system, path) of a URI; local paths need no scheme."""
    from pyarrow import fs

    if urlsplit(uri).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlsplit(uri).path
    return fs.FileSystem.from_uri(uri)


def parse(stream: io.BufferedIOBase, wanted) -> Iterator[tuple[str, dict[str, str], bytes | None]]:
    """(type, header lines, payload) of each record; the payload is None where `wanted(headers)` is false."""
    while line := stream.readline():
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"a record begins with {line[:40]!r}")
        headers: dict[str, str] = {}
        last = ""
        while (line := stream.readline()).strip():
            if line[:1] in b" \t" and last:
                headers[last] += " " + line.strip().decode("utf-8", "replace")
                continue
            name, _, value = line.decode("utf-8", "replace").partition(":")
            last = name.strip().lower()
            headers[last] = value.strip()
        size = headers.get("content-length", "")
        if not size.isdigit():
            raise ValueError(f"a record has the length {size!r}")
        need = int(size)
        if wanted(headers):
            payload = stream.read(need)
            if len(payload) < need:
                raise ValueError("an archive is cut off")
            yield headers.get("warc-type", ""), headers, payload
        else:
            while need:
                got = len(stream.read(min(need, 1 << 20)))
                if not got:
                    raise ValueError("an archive is cut off")
                need -= got
            yield headers.get("warc-type", ""), headers, None


def cell(column: str, headers: dict[str, str]):
    value = headers.get(HEADER_COLUMNS[column])
    return int(value) if column == "content_length" and value is not None else value


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.target = options["path"], int(options.get("partitionBytes", 32 << 20))
        self.payload = options.get("payload", "true").lower() == "true"
        self.tests: list[tuple[str, tuple]] = []
        self.present: list[str] = []

    def pushFilters(self, filters: list[Filter]):
        """Takes equality, membership and presence tests on columns that the header lines decide."""
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else ""
            if name in HEADER_COLUMNS and isinstance(f, EqualTo) and f.value is not None:
                self.tests.append((name, (f.value,)))
            elif name in HEADER_COLUMNS and isinstance(f, In):
                self.tests.append((name, tuple(f.value)))
            elif name in HEADER_COLUMNS and isinstance(f, IsNotNull):
                self.present.append(name)
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        system, path = file_system(self.path)
        infos = system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True)) if system.get_file_info(path).type != fs.FileType.File else [system.get_file_info(path)]
        files = sorted((x.path, x.size) for x in infos if x.type == fs.FileType.File and os.path.basename(x.path)[:1] not in "_." and x.size)
        out: list[Files] = []
        room = 0
        for name, size in files:
            if not out or size > room:
                out.append(Files([]))
                room = self.target
            out[-1].paths.append(name)
            room -= size
        return out or [Files([])]

    def read(self, partition):
        system, _ = file_system(self.path)

        def wanted(headers: dict[str, str]) -> bool:
            return all(cell(c, headers) is not None for c in self.present) and all(cell(c, headers) in values for c, values in self.tests)

        for name in partition.paths:
            with system.open_input_stream(name, compression=None) as raw:
                stream = io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 18) if name.endswith(".gz") else raw
                keep = wanted if self.payload else lambda headers: False
                for kind, headers, payload in parse(stream, keep):
                    if payload is None and not (not self.payload and wanted(headers)):
                        continue
                    yield (kind, *(cell(c, headers) for c in list(HEADER_COLUMNS)[1:]), headers, payload)


class WarcDataSource(DataSource):
    """Options: path; payload (false: headers only); partitionBytes (file bytes of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))


def read_archives(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("warc").options(**options).load(path)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "warc")
    write_archives(plan_records(read(spark, sf_dir, "pages"), "page_id", "html", "url"), path)
    found = read_archives(spark, path).where(F.col("record_type").isin("response", "revisit"))
    number = lambda c: F.expr(f"try_cast(nullif(regexp_extract({c}, '<urn:page:(-?[0-9]*)>', 1), '') AS bigint)")
    response = F.col("record_type") == "response"
    # What a response stores is measured and digested anew; of a revisit, the header lines tell about the full payload.
    stored = base32_of_hex(F.sha1("payload"))
    return found.select(
        number("record_id").alias("page_id"),
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("headers")["x-full-length"].cast("long")).alias("payload_bytes"),
        F.when(response, stored).otherwise(F.regexp_replace("payload_digest", "^sha1:", "")).alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
    )


QUERIES = {"op2_warc": op2_warc}

ORACLE_SQL = {
    "op2_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), d AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(encode(html)) AS h, max(page_id) OVER (PARTITION BY html) AS best FROM p),
    digits AS (SELECT *, list_transform(range(1, 41), lambda i: CAST(strpos('0123456789abcdef', h[i]) - 1 AS INTEGER)) AS x FROM d),
    bits AS (SELECT *, flatten(list_transform(x, lambda v: [v // 8, v // 4 % 2, v // 2 % 2, v % 2])) AS b FROM digits)
    SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(16 * b[5 * i + 1] + 8 * b[5 * i + 2] + 4 * b[5 * i + 3] + 2 * b[5 * i + 4] + b[5 * i + 5] + 1 AS BIGINT), 1)), '') AS payload_digest,
    CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> best THEN best END AS refers_to FROM bits"""
}
