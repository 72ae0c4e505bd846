"""Range reads, verification, issues, statistics, health, repair plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def range_chunks(refs: DataFrame, offset: int, length: int) -> DataFrame:
    """The chunk references that a byte range touches, with the part of each: comparisons that reach the scan."""
    if offset < 0 or length < 0:
        raise ValueError("a range must not be negative")
    lo, hi = F.greatest(F.col("file_offset"), F.lit(offset)), F.least(F.col("file_offset") + F.col("chunk_size"), F.lit(offset + length))
    touched = refs.where((F.col("file_offset") < offset + length) & (F.col("file_offset") + F.col("chunk_size") > offset))
    return touched.withColumns({"skip": lo - F.col("file_offset"), "take": hi - lo})


def read_range(refs: DataFrame, keys: list[str], offset: int, length: int) -> DataFrame:
    """(keys, bytes) of a range of each object, from references that carry `raw`."""
    part = F.expr("substring(raw, cast(skip + 1 as int), cast(take as int))")
    rows = range_chunks(refs, offset, length).select(*keys, "file_offset", part.alias("part"))
    parts = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("file_offset", "part"))).alias("p"))
    return parts.select(*keys, F.reduce("p", F.lit(b""), lambda all_, x: F.concat(all_, x["part"])).alias("bytes"))


def chunk_issue(chunk_state: Column, segment_state: Column, has_file: Column, hash_ok: Column) -> Column:
    """The first thing that is wrong with a chunk, or null."""
    return (
        F.when(chunk_state.isNull(), "chunk_missing")
        .when(segment_state.isNull(), "segment_missing")
        .when(chunk_state == "CORRUPT", "chunk_corrupt")
        .when(segment_state == "CORRUPT", "segment_corrupt")
        .when(~has_file, "segment_read_failed")
        .when(~hash_ok, "chunk_hash_mismatch")
    )


def corrupt_from(issues: DataFrame, chunks: DataFrame, whole_segment: bool = True) -> DataFrame:
    """(chunk_id) that issues make unreadable: the chunk, and by default all chunks of its segment."""
    bad = issues.select("chunk_id").distinct()
    if not whole_segment:
        return bad
    segments = chunks.join(bad, "chunk_id", "left_semi").select("segment_id").distinct()
    return chunks.join(segments, "segment_id", "left_semi").select("chunk_id")


def affected_files(refs: DataFrame, bad: DataFrame, path: str = "path") -> DataFrame:
    """(path) of the files that have a bad chunk."""
    return refs.join(bad.select("chunk_id"), "chunk_id", "left_semi").select(path).distinct()


def segments_without_chunks(segments: DataFrame, chunks: DataFrame) -> DataFrame:
    """Segments, but deleted ones, in which no chunk is left that is not deleted."""
    return segments.where("state <> 'DELETED'").join(chunks.where("state <> 'DELETED'").select("segment_id"), "segment_id", "left_anti")


def chunks_without_segment(chunks: DataFrame, segments: DataFrame) -> DataFrame:
    """Chunks, but deleted ones, whose segment is missing or deleted."""
    return chunks.where("state <> 'DELETED'").join(segments.where("state <> 'DELETED'").select("segment_id"), "segment_id", "left_anti")


def chunks_per_segment(chunks: DataFrame, segments: DataFrame) -> DataFrame:
    """(segment_id, chunks): chunks that are not deleted in each segment that is not."""
    usable = segments.where("state <> 'DELETED'").select("segment_id")
    return chunks.where("state <> 'DELETED'").join(usable, "segment_id", "left_semi").groupBy("segment_id").agg(F.count(F.lit(1)).alias("chunks"))


def only_in(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Orphans (files that no record names) and missing files (records without a file)."""
    return left.join(right.select(key), key, "left_anti")


def diagnose(findings: dict[str, DataFrame], key: str) -> DataFrame:
    """(kind, severity, repairable, subject) of the rows found of each kind of issue."""
    out = None
    for kind, rows in findings.items():
        part = rows.select(F.lit(kind).alias("kind"), F.lit(SEVERITY[kind]).alias("severity"), F.lit(kind in REPAIRS).alias("repairable"), F.col(key).cast("string").alias("subject"))
        out = part if out is None else out.unionByName(part)
    return out


#: What repairs each kind of issue that can be repaired.
REPAIRS = {"staging_leftover": "clean_staging", "orphan_segment": "clean_orphan_segment", "compacting_segment": "reset_compacting", "missing_segment": "mark_corrupt"}
#: Severity of each kind of issue.
SEVERITY = {
    "staging_leftover": "info", "orphan_segment": "warn", "missing_segment": "error", "compacting_segment": "warn", "corrupt_chunk": "error",
    "corrupt_segment": "error", "chunk_without_segment": "error", "segment_without_chunks": "warn", "metadata_log_torn_tail": "warn",
}


def repair_plan(issues: DataFrame, most: int = 0) -> DataFrame:
    """(action, subject) for what can be repaired, in a fixed order; `most` of 0 means all."""
    action = F.create_map(*[F.lit(x) for pair in REPAIRS.items() for x in pair])
    plan = issues.where("repairable").select(F.element_at(action, F.col("kind")).alias("action"), "subject").orderBy("action", "subject")
    return plan.limit(most) if most > 0 else plan


def counts(inodes: DataFrame, manifests: DataFrame, chunks: DataFrame, segments: DataFrame) -> DataFrame:
    """One row: active inodes, objects and folders, manifests, chunks and segments by state, and bytes. Deleted chunks have no bytes;
    corrupt ones and candidates have. An unknown state of a chunk counts as active, and of a segment as sealed."""
    state, kind = F.col("state"), F.col("kind")
    none = F.lit(0).cast("long")
    total = lambda column, when: F.coalesce(F.sum(F.when(when, F.col(column))), none)
    parts = [
        inodes.where("state = 'ACTIVE'").agg(F.count(F.lit(1)).alias("inodes"), F.count_if(kind == "FILE").alias("objects"), F.count_if(kind == "DIR").alias("directories"), total("size", kind == "FILE").alias("logical_bytes")),
        manifests.agg(F.count_if(state != "DELETED").alias("manifests_active"), F.count_if(state == "DELETED").alias("manifests_deleted")),
        chunks.agg(
            F.count_if(~state.isin("GARBAGE_CANDIDATE", "DELETED", "CORRUPT")).alias("chunks_active"), F.count_if(state == "GARBAGE_CANDIDATE").alias("chunks_candidate"), F.count_if(state == "DELETED").alias("chunks_deleted"),
            F.count_if(state == "CORRUPT").alias("chunks_corrupt"), total("raw_size", state != "DELETED").alias("raw_bytes"), total("stored_size", state != "DELETED").alias("stored_bytes"),
        ),
        segments.agg(
            F.count_if(~state.isin("COMPACTING", "DELETED", "CORRUPT")).alias("segments_sealed"), F.count_if(state == "COMPACTING").alias("segments_compacting"),
            F.count_if(state == "DELETED").alias("segments_deleted"), F.count_if(state == "CORRUPT").alias("segments_corrupt"),
        ),
    ]
    row = parts[0]
    for part in parts[1:]:  # of one row each
        row = row.select("*", *(part.select(c).scalar().alias(c) for c in part.columns))
    return row


def health(facts: DataFrame) -> DataFrame:
    """(status) of one row of facts: booleans closed, corrupt, unreadable, unwritable, degraded; the first that holds counts."""
    status = F.when(F.col("closed"), "CLOSED").when(F.col("corrupt"), "CORRUPT").when(F.col("unreadable") | F.col("unwritable"), "READ_ONLY").when(F.col("degraded"), "DEGRADED").otherwise("OK")
    return facts.select(status.alias("status"), "*")
