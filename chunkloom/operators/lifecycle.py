"""Reference counts, garbage marking, segment statistics, compaction, pruning.

Chunks: (chunk_id, segment_id, state, ref_count, offset, length, created_at, deleted_at, seen); segments: (segment_id, state,
compacted_at, sealed_at, created_at). Times are whole numbers in one unit, 0 for none; the present is always given."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def manifest_refs(files: DataFrame) -> DataFrame:
    """(manifest_id, ref_count): how many live files have each manifest."""
    return files.groupBy("manifest_id").agg(F.count(F.lit(1)).alias("ref_count"))


def chunk_refs(files: DataFrame, refs: DataFrame) -> DataFrame:
    """(chunk_id, ref_count): references by files; a manifest counts once for each different chunk in it."""
    distinct = refs.select("manifest_id", "chunk_id").distinct()
    return distinct.join(manifest_refs(files), "manifest_id").groupBy("chunk_id").agg(F.sum("ref_count").alias("ref_count"))


def apply_deltas(current: DataFrame, deltas: DataFrame, key: str) -> DataFrame:
    """(key, ref_count, state) after deltas (key, delta): clamped at zero; zero is DELETED, more is ACTIVE. Keys that are not
    stored are passed over."""
    summed = deltas.groupBy(key).agg(F.sum("delta").alias("delta"))
    count = F.greatest(F.lit(0).cast("long"), F.col("ref_count") + F.col("delta"))
    return current.join(summed, key).select(key, count.alias("ref_count"), F.when(count > 0, "ACTIVE").otherwise("DELETED").alias("state"))


def release(files: DataFrame, manifests: DataFrame, chunks: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """What becomes of manifests and chunks when files (manifest_id, delta) take up (1) or give up (-1) manifests: the changed records
    of both. A manifest counts once for each different chunk in it; counts are clamped at zero; a manifest is ACTIVE as long as
    it is referred to and DELETED otherwise; a chunk that is referred to again is ACTIVE and no garbage."""
    moved = files.groupBy("manifest_id").agg(F.sum("delta").alias("delta")).where("delta <> 0").join(manifests, "manifest_id")
    of_chunks = moved.select("manifest_id", "delta", F.explode(F.array_distinct(F.transform("chunks", lambda c: c["chunk_id"]))).alias("chunk_id"))
    count = F.greatest(F.lit(0).cast("long"), F.col("ref_count") + F.col("delta"))
    used = F.col("ref_count") > 0
    made = moved.withColumn("ref_count", count)
    made = made.withColumns({"state": F.when(used, "ACTIVE").otherwise("DELETED"), "deleted_at": F.when(used, 0).otherwise(now).cast("long"), "last_live_at": F.when(used, F.lit(now).cast("long")).otherwise(F.col("last_live_at"))})
    changed = chunks.join(of_chunks.groupBy("chunk_id").agg(F.sum("delta").alias("delta")), "chunk_id").withColumn("ref_count", count)
    zero = lambda c, kind: F.when(used, F.lit(0).cast(kind)).otherwise(F.col(c))
    changed = changed.withColumns({"state": F.when(used, "ACTIVE").otherwise(F.col("state")), "last_seen_at": F.when(used, F.lit(now).cast("long")).otherwise(F.col("last_seen_at")), "deleted_at": zero("deleted_at", "long"), "garbage_candidate_at": zero("garbage_candidate_at", "long"), "garbage_seen_count": zero("garbage_seen_count", "int")})
    return made.select(manifests.columns), changed.select(chunks.columns)


def mark_garbage(chunks: DataFrame, now: int, window: int, confirm: int) -> DataFrame:
    """The chunks that one run changes, with their new state and how often they have been seen as garbage."""
    open_ = chunks.where((F.col("state").isin("ACTIVE", "GARBAGE_CANDIDATE")) & (F.col("ref_count") <= 0) & (F.col("created_at") < now - window))
    seen = F.when(F.col("state") == "ACTIVE", 1).otherwise(F.col("seen") + 1)
    return open_.withColumns({"new_state": F.when(seen >= confirm, "DELETED").otherwise("GARBAGE_CANDIDATE"), "new_seen": seen})


def segment_stats(chunks: DataFrame, segments: DataFrame) -> DataFrame:
    """Of each segment, of its state and its times: bytes alive and dead, when it was compacted or its last chunk died, and whether
    something keeps it from being removed. Segments without chunks are there too. Hot segments are summed in parts."""
    dead, idle = F.col("state") == "DELETED", F.col("ref_count") <= 0
    size = F.col("length")
    sums = chunks.groupBy("segment_id").agg(
        F.sum(F.when(~dead & ~idle, size).otherwise(0)).alias("live"),
        F.sum(F.when(dead | idle, size).otherwise(0)).alias("garbage"),
        F.max(F.when(dead, F.col("deleted_at")).otherwise(0)).alias("_died"),
        F.bool_or(~dead | (F.col("deleted_at") == 0)).alias("blocked"),
    )
    nought = F.lit(0).cast("long")
    both = segments.join(sums, "segment_id", "left")
    return both.select(
        "segment_id", "state", "sealed_at", "created_at", F.coalesce("live", nought).alias("live"), F.coalesce("garbage", nought).alias("garbage"),
        F.greatest(F.coalesce("compacted_at", nought), F.coalesce("_died", nought)).alias("dead_at"), F.coalesce("blocked", F.lit(False)).alias("blocked"),
    )


def unpinned(rows: DataFrame, pins: DataFrame | None) -> DataFrame:
    """Without the segments that readers hold."""
    return rows if pins is None else rows.join(pins.select("segment_id").distinct(), "segment_id", "left_anti")


def compaction_candidates(stats: DataFrame, ratio: float, pins: DataFrame | None = None) -> DataFrame:
    """Sealed segments that no reader holds, with enough garbage beside something alive."""
    share = F.col("garbage") / (F.col("live") + F.col("garbage"))
    return unpinned(stats.where((F.col("state") == "SEALED") & (F.col("live") > 0) & (F.col("garbage") > 0)).where(share >= ratio), pins)


def dead_segments(stats: DataFrame, now: int, delay: int, pins: DataFrame | None = None) -> DataFrame:
    """Segments that no reader holds, with nothing in them that may still be wanted, dead for long enough: since their last chunk died
    or they were compacted, else since they were sealed, else since they were made."""
    died = F.coalesce(F.nullif(F.col("dead_at"), F.lit(0)), F.nullif(F.col("sealed_at"), F.lit(0)), F.col("created_at"))
    open_ = stats.where(~F.col("state").isin("DELETED", "CORRUPT") & ~F.col("blocked"))
    return unpinned(open_.withColumn("dead_at", died).where(F.col("dead_at") <= now - delay), pins)


def valid_compactions(moved: DataFrame, current: DataFrame) -> DataFrame:
    """(source, valid): whether all chunks moved (chunk_id, source, offset, length) from a segment are still where they were, and in
    use. One that is not spoils its whole source."""
    now = current.select("chunk_id", F.col("segment_id").alias("_segment"), F.col("offset").alias("_offset"), F.col("length").alias("_length"), F.col("state").alias("_state"), F.col("ref_count").alias("_refs"))
    here = (F.col("_segment") == F.col("source")) & (F.col("_offset") == F.col("offset")) & (F.col("_length") == F.col("length"))
    same = here & (F.col("_state") != "DELETED") & (F.col("_refs") > 0)
    return moved.join(now, "chunk_id", "left").groupBy("source").agg(F.bool_and(F.coalesce(same, F.lit(False))).alias("valid"))


def prune(dirents: DataFrame, inodes: DataFrame, chunks: DataFrame, segments: DataFrame, manifests: DataFrame | None = None, tenants: DataFrame | None = None) -> dict[str, DataFrame]:
    """What a checkpoint keeps, in five ordered steps: entries (parent, child) of active folders; inodes (inode, state, kind,
    manifest_id) but deleted ones that neither a tenant (inode) nor a kept entry names; manifests (manifest_id, state, ref_count)
    but deleted ones without references that no active file has; chunks but deleted, unreferenced ones of missing or
    deleted segments; segments but deleted ones without a kept chunk."""
    active = inodes.where("state = 'ACTIVE' AND kind = 'DIR'").select("inode")
    entries = dirents.join(active, dirents["parent"] == active["inode"], "left_semi")
    named = entries.select(F.col("child").alias("inode"))
    named = named if tenants is None else named.union(tenants.select("inode"))
    gone = inodes.where("state = 'DELETED'").join(named, "inode", "left_anti").select("inode")
    kept = {"dirents": entries, "inodes": inodes.join(gone, "inode", "left_anti")}
    if manifests is not None:
        used = kept["inodes"].where("state = 'ACTIVE' AND kind = 'FILE'").select("manifest_id")
        idle = manifests.where("state = 'DELETED' AND ref_count <= 0").join(used, "manifest_id", "left_anti").select("manifest_id")
        kept["manifests"] = manifests.join(idle, "manifest_id", "left_anti")
    alive = segments.where("state <> 'DELETED'").select("segment_id")
    dropped = chunks.where("state = 'DELETED' AND ref_count <= 0").join(alive, "segment_id", "left_anti").select("chunk_id")
    kept["chunks"] = chunks.join(dropped, "chunk_id", "left_anti")
    empty = segments.where("state = 'DELETED'").join(kept["chunks"].select("segment_id"), "segment_id", "left_anti").select("segment_id")
    return kept | {"segments": segments.join(empty, "segment_id", "left_anti")}
