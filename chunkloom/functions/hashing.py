"""Content addresses as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def scope_prefix(scope: Column | None) -> Column:
    """What is hashed before the content: the scope and a zero byte, or nothing for the global scope."""
    return F.lit(b"") if scope is None else F.concat(scope.cast("binary"), F.lit(b"\0"))


def scoped_sha256(content: Column, scope: Column | None = None) -> Column:
    """Lower-case hex SHA-256 of binary content within a scope; null content is empty."""
    return F.sha2(F.concat(scope_prefix(scope), F.coalesce(content, F.lit(b""))), 256)


def u64_le(value: Column) -> Column:
    """Eight bytes of a number, the lowest first."""
    big = F.lpad(F.hex(value.cast("long")), 16, "0")
    return F.unhex(F.concat(*(F.substring(big, i, 2) for i in range(15, 0, -2))))


def manifest_id(scope: Column, file_hash: Column, size: Column, chunking: Column, refs: Column) -> Column:
    """Address of a manifest; refs: array of (chunk_index, chunk_id, file_offset, chunk_size), in order."""
    zero = F.lit(b"\0")
    head = F.concat(F.lit(b"manifest\0"), scope.cast("binary"), zero, file_hash.cast("binary"), zero, u64_le(size), chunking.cast("binary"), zero)
    body = F.reduce(refs, F.lit(b""), lambda all_, r: F.concat(all_, r["chunk_id"].cast("binary"), u64_le(r["file_offset"]), u64_le(r["chunk_size"])))
    return F.sha2(F.concat(head, body), 256)
