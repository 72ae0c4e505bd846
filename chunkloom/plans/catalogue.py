"""Every registered query over the driver's tables, with its SQL oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.functions import codecs, hashing, paths
from chunkloom.operators import chunking, ingest, integrity, lifecycle, namespace
from chunkloom.plans import stores
from chunkloom.plans import tables as t

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


SCOPED = "sha256(encode(source) || '\\x00'::BLOB || encode(text))"


@query(f"SELECT doc_id, {SCOPED} AS chunk_id FROM documents")
def scoped_chunk_hash(spark, sf):
    return t.objects(spark, sf).select("doc_id", hashing.scoped_sha256(F.col("raw"), F.col("tenant")).alias("chunk_id"))


@query(
    f"""WITH h AS (SELECT 'tenant' AS scope, {SCOPED} AS id, octet_length(encode(text)) AS n FROM documents UNION ALL SELECT 'global', sha256(encode(text)), octet_length(encode(text)) FROM documents),
    u AS (SELECT scope, id, count(*) AS copies, min(n) AS n FROM h GROUP BY 1, 2)
    SELECT scope, CAST(sum(copies) AS BIGINT) AS objects, count(*) AS stored, CAST(sum(copies * n) AS BIGINT) AS raw_bytes, CAST(sum(n) AS BIGINT) AS stored_bytes FROM u GROUP BY 1"""
)
def global_vs_tenant_dedup(spark, sf):
    o = t.objects(spark, sf)
    ids = [(F.lit("tenant"), hashing.scoped_sha256(F.col("raw"), F.col("tenant"))), (F.lit("global"), hashing.scoped_sha256(F.col("raw")))]
    rows = o.select(F.octet_length("raw").cast("long").alias("n"), F.explode(F.array(*(F.struct(s.alias("scope"), i.alias("id")) for s, i in ids))).alias("x"))
    each = rows.groupBy("x.scope", "x.id").agg(F.count(F.lit(1)).alias("copies"), F.min("n").alias("n"))
    return each.groupBy("scope").agg(F.sum("copies").alias("objects"), F.count(F.lit(1)).alias("stored"), F.sum(F.col("copies") * F.col("n")).alias("raw_bytes"), F.sum("n").alias("stored_bytes"))


def _chunks(spark, sf, scoped: bool = False) -> DataFrame:
    return chunking.chunk(t.objects(spark, sf), t.LOW, t.AVG, t.HIGH, scope=F.col("tenant") if scoped else None)


@query(f"WITH RECURSIVE {t.chunks_sql()} SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, file_offset, chunk_size, chunk_id FROM chunks")
def cdc_chunks(spark, sf):
    return _chunks(spark, sf).select("doc_id", "chunk_index", "file_offset", "chunk_size", "chunk_id")


@query(
    f"""WITH RECURSIVE {t.chunks_sql("source")}, u AS (SELECT source, chunk_id, count(*) AS n, min(chunk_size) AS size FROM chunks GROUP BY 1, 2)
    SELECT source AS tenant, CAST(sum(n) AS BIGINT) AS chunks, count(*) AS stored_chunks, CAST(sum(n * size) AS BIGINT) AS raw_bytes, CAST(sum(size) AS BIGINT) AS stored_bytes FROM u GROUP BY 1"""
)
def cdc_dedup_savings(spark, sf):
    """How much content-defined deduplication saves each tenant."""
    each = _chunks(spark, sf, True).groupBy("tenant", "chunk_id").agg(F.count(F.lit(1)).alias("n"), F.min("chunk_size").alias("size"))
    return each.groupBy("tenant").agg(F.sum("n").alias("chunks"), F.count(F.lit(1)).alias("stored_chunks"), F.sum(F.col("n") * F.col("size")).alias("raw_bytes"), F.sum("size").alias("stored_bytes"))


@query(
    f"""WITH RECURSIVE {t.chunks_sql("source")}, m AS (SELECT doc_id, source, CAST(count(*) AS INTEGER) AS chunk_count, CAST(sum(chunk_size) AS BIGINT) AS file_size,
      string_agg(hex(encode(chunk_id)) || le(file_offset) || le(chunk_size), '' ORDER BY chunk_index) AS body FROM chunks GROUP BY 1, 2),
    f AS (SELECT m.*, CASE WHEN chunk_count > 1 THEN 'FASTCDC' ELSE 'SINGLE' END AS chunking_type, {SCOPED} AS file_hash FROM m JOIN documents d USING (doc_id))
    SELECT doc_id, chunk_count, file_size, chunking_type, file_hash, sha256(from_hex(hex(encode('manifest')) || '00' || hex(encode(source)) || '00' || hex(encode(file_hash)) || '00' || le(file_size) || hex(encode(chunking_type)) || '00' || body)) AS manifest_id
    FROM f"""
)
def manifest_ids(spark, sf):
    return chunking.manifests(_chunks(spark, sf, True), ["doc_id"], F.col("tenant")).select("doc_id", "chunk_count", "file_size", "chunking_type", "file_hash", "manifest_id")


def _le_sql(sql: str) -> str:
    """Spells le(x), eight little-endian bytes in hex, out."""
    import re

    def spell(m):
        digits = f"lpad(to_hex(CAST({m[1]} AS BIGINT)), 16, '0')"
        return "(" + " || ".join(f"substr({digits}, {i}, 2)" for i in range(15, 0, -2)) + ")"

    return re.sub(r"\b[lL][eE]\((\w+)\)", spell, sql)


SQL["manifest_ids"] = _le_sql(SQL["manifest_ids"]).replace("FROM m JOIN documents d USING (doc_id)", "FROM m JOIN (SELECT doc_id, text FROM documents) d USING (doc_id)")


@query(
    f"""WITH RECURSIVE {t.chunks_sql()}, w AS (SELECT doc_id, chunk_index, chunk_id, row_number() OVER (PARTITION BY chunk_id ORDER BY doc_id, chunk_index) = 1 AS is_writer FROM chunks)
    SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, chunk_id, is_writer FROM w"""
)
def in_batch_writer(spark, sf):
    return ingest.first_writers(_chunks(spark, sf).select("doc_id", "chunk_index", "chunk_id"), ["doc_id", "chunk_index"]).select("doc_id", "chunk_index", "chunk_id", "is_writer")


@query(
    f"""WITH RECURSIVE {t.chunks_sql()}, p AS (SELECT doc_id, chunk_index, chunk_size, 0 AS segment, CAST(11 AS BIGINT) AS place, 115 + chunk_size AS fin FROM chunks WHERE chunk_index = 0
      UNION ALL SELECT c.doc_id, c.chunk_index, c.chunk_size, p.segment + CASE WHEN p.fin + 104 + c.chunk_size > 4096 THEN 1 ELSE 0 END,
        CASE WHEN p.fin + 104 + c.chunk_size > 4096 THEN 11 ELSE p.fin END, CASE WHEN p.fin + 104 + c.chunk_size > 4096 THEN 115 + c.chunk_size ELSE p.fin + 104 + c.chunk_size END
      FROM p JOIN chunks c ON c.doc_id = p.doc_id AND c.chunk_index = p.chunk_index + 1)
    SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, chunk_size, CAST(segment AS INTEGER) AS segment, place AS "offset" FROM p"""
)
def segment_pack(spark, sf):
    return ingest.pack(_chunks(spark, sf).select("doc_id", "chunk_index", "chunk_size"), ["doc_id"], ["chunk_index"], "chunk_size", 4096)


@query("SELECT o_orderkey + 1 AS sequence, printf('%04d/%04d/%016d.blob', o_orderkey // 1048576, (o_orderkey // 1024) % 1024, o_orderkey + 1) AS path FROM orders")
def segment_paths(spark, sf):
    return t.table(spark, sf, "orders").select((F.col("o_orderkey") + 1).alias("sequence"), paths.segment_path(F.col("o_orderkey") + 1).alias("path"))


@query(
    r"""WITH p AS (SELECT page_id, replace(substr(url, 9), '\', '/') AS p FROM pages)
    SELECT page_id, p AS path, len(list_filter(string_split(p, '/'), lambda c: c IN ('', '.', '..') OR octet_length(encode(c)) > 255)) = 0 AND p <> '' AND octet_length(encode(p)) <= 4096 AND substr(p, 2, 1) <> ':' AS valid,
      list_extract(string_split(p, '/'), -1) AS base, CASE WHEN contains(p, '/') THEN regexp_replace(p, '/[^/]*$', '') ELSE '' END AS parent FROM p"""
)
def object_paths(spark, sf):
    p = t.table(spark, sf, "pages").select("page_id", paths.slashes(F.expr("substring(url, 9)")).alias("path"))
    return p.select("page_id", "path", paths.valid_object_path(F.col("path")).alias("valid"), paths.base_name(F.col("path")).alias("base"), paths.parent_path(F.col("path")).alias("parent"))


@query(r"SELECT doc_id, source, octet_length(encode(source)) <= 5 AND regexp_full_match(source, '[A-Za-z0-9_.-]+') AND source NOT IN ('.', '..') AS valid FROM documents")
def tenant_names(spark, sf):
    return t.table(spark, sf, "documents").select("doc_id", "source", paths.valid_tenant(F.col("source"), 5).alias("valid"))


@query(
    r"""WITH p AS (SELECT DISTINCT list_filter(string_split(substr(url, 9), '/'), lambda c: c NOT IN ('', '.')) AS l FROM pages)
    SELECT DISTINCT array_to_string(l[1:i], '/') AS path FROM (SELECT l, unnest(range(1, len(l) + 1)) AS i FROM p)"""
)
def mkdirall_prefixes(spark, sf):
    p = t.table(spark, sf, "pages").select(paths.ancestors(F.expr("substring(url, 9)")).alias("prefixes"))
    return namespace.missing_folders(p, spark.createDataFrame([], "path string"))


FOLD = "f AS (SELECT user_id, k, max(txid) AS txid, arg_max(op, txid) AS op FROM oplog {where} GROUP BY 1, 2)"


@query(f"WITH {t.OPLOG}, {FOLD.format(where='')} SELECT * FROM f WHERE op <> 'delete'")
def log_fold(spark, sf):
    return namespace.latest(t.oplog(spark, sf), ["user_id", "k"], ["txid"]).where("op <> 'delete'").select("user_id", "k", "txid", "op")


@query(f"WITH {t.OPLOG}, {FOLD.format(where='WHERE txid > 5000')} SELECT * FROM f")
def log_after_checkpoint(spark, sf):
    return namespace.latest(t.oplog(spark, sf).where("txid > 5000"), ["user_id", "k"], ["txid"]).select("user_id", "k", "txid", "op")


@query(f"WITH {t.OPLOG} SELECT user_id, k, count(*) AS generation, count(*) FILTER (op = 'put') AS content_generation, count(*) FILTER (op = 'update') AS metadata_generation, count(*) FILTER (op IN ('mkdir', 'delete')) AS namespace_generation FROM oplog GROUP BY 1, 2")
def generations(spark, sf):
    of = lambda *ops: F.count_if(F.col("op").isin(*ops))
    return t.oplog(spark, sf).groupBy("user_id", "k").agg(F.count(F.lit(1)).alias("generation"), of("put").alias("content_generation"), of("update").alias("metadata_generation"), of("mkdir", "delete").alias("namespace_generation"))


@query("SELECT event_id AS epoch, user_id FROM events WHERE event_type = 'purchase' ORDER BY event_id DESC LIMIT 1024")
def gc_history(spark, sf):
    return namespace.last_runs(t.table(spark, sf, "events").where("event_type = 'purchase'").select(F.col("event_id").alias("epoch"), "user_id"), 1024)


@query(
    """SELECT (SELECT max(event_id) + 1 FROM events) AS next_txid, (SELECT max(o_orderkey) + 1 FROM orders) AS next_segment,
    (SELECT max(TRY_CAST(p AS BIGINT)) + 1 FROM (SELECT regexp_extract(p_name, '([0-9]+)$', 1) AS p FROM part)) AS next_part"""
)
def counters(spark, sf):
    def nxt(table, column, name):
        return t.table(spark, sf, table).agg((F.max(column) + 1).alias(name))

    number = F.regexp_extract("p_name", "([0-9]+)$", 1).try_cast("long")
    parts = [nxt("events", F.col("event_id"), "v").select(F.lit("next_txid").alias("k"), "v"), nxt("orders", F.col("o_orderkey"), "v").select(F.lit("next_segment").alias("k"), "v"), nxt("part", number, "v").select(F.lit("next_part").alias("k"), "v")]
    rows = parts[0].union(parts[1]).union(parts[2])
    return rows.agg(*(F.max(F.when(F.col("k") == k, F.col("v"))).alias(k) for k in ("next_txid", "next_segment", "next_part")))


@query(f"WITH RECURSIVE {t.TREE}, {t.paths_sql()} SELECT node, CAST(depth AS INTEGER) AS depth, path FROM paths")
def full_paths(spark, sf):
    return namespace.full_paths(t.tree(spark, sf))


@query(f"WITH {t.TREE} SELECT node, name FROM nodes WHERE parent = 1007 ORDER BY name")
def list_dir(spark, sf):
    return namespace.list_dir(t.tree(spark, sf), 1007)


@query(f"WITH {t.TREE} SELECT node, name FROM nodes WHERE parent = 1007 ORDER BY name LIMIT 10 OFFSET 5")
def readdir_page(spark, sf):
    return namespace.list_page(t.tree(spark, sf), 1007, 5, 10)


@query(f"WITH {t.TREE} SELECT node, parent, name FROM nodes WHERE parent = 1000 AND name = 'none'")
def resolve_missing(spark, sf):
    return namespace.resolve(t.tree(spark, sf), "r0/n0/none/o1").select("node", "parent", "name")


@query(f"WITH {t.TREE} SELECT n.node, n.parent, n.name FROM nodes n JOIN nodes r ON n.parent = r.node WHERE r.name = 'r0' AND n.name = 'n0'")
def resolve_path(spark, sf):
    return namespace.resolve(t.tree(spark, sf), "r0/n0").select("node", "parent", "name")


CUT_TREE = f"{t.TREE}, kept AS (SELECT * FROM nodes WHERE node <> {t.DETACHED})"


@query(f"WITH RECURSIVE {CUT_TREE}, {t.paths_sql('kept')} SELECT node FROM paths")
def reachable(spark, sf):
    return namespace.reachable(namespace.detach(t.tree(spark, sf), t.DETACHED))


@query(f"WITH RECURSIVE {CUT_TREE}, {t.paths_sql('kept')} SELECT node, name FROM kept WHERE node NOT IN (SELECT node FROM paths)")
def unreachable(spark, sf):
    return namespace.unreachable(namespace.detach(t.tree(spark, sf), t.DETACHED)).select("node", "name")


@query(f"WITH RECURSIVE {t.TREE}, moved AS (SELECT node, CASE WHEN node = 1005 THEN 2 ELSE parent END AS parent, CASE WHEN node = 1005 THEN 'moved' ELSE name END AS name FROM nodes), {t.paths_sql('moved')} SELECT node, path FROM paths")
def rename_subtree(spark, sf):
    return namespace.full_paths(namespace.rename(t.tree(spark, sf), 1005, 2, "moved")).select("node", "path")


@query(f"WITH RECURSIVE {CUT_TREE}, {t.paths_sql('kept')} SELECT node, 'inode_parent_invalid' AS kind FROM kept WHERE node NOT IN (SELECT node FROM paths)")
def invalid_parents(spark, sf):
    return namespace.invalid_parents(namespace.detach(t.tree(spark, sf), t.DETACHED))


@query("SELECT sha256(encode(text)) AS manifest_id, count(*) AS ref_count FROM documents GROUP BY 1")
def manifest_refcount(spark, sf):
    return lifecycle.manifest_refs(t.objects(spark, sf).select(hashing.scoped_sha256(F.col("raw")).alias("manifest_id")))


@query(
    f"""WITH RECURSIVE {t.chunks_sql()}, m AS (SELECT doc_id, sha256(encode(text)) AS m FROM documents), r AS (SELECT DISTINCT m, chunk_id FROM chunks JOIN m USING (doc_id)), n AS (SELECT m, count(*) AS n FROM m GROUP BY 1)
    SELECT chunk_id, CAST(sum(n) AS BIGINT) AS ref_count FROM r JOIN n USING (m) GROUP BY 1"""
)
def chunk_refcount(spark, sf):
    files = t.objects(spark, sf).select("doc_id", "raw", hashing.scoped_sha256(F.col("raw")).alias("manifest_id"))
    refs = chunking.chunk(files, t.LOW, t.AVG, t.HIGH).select("manifest_id", "chunk_id")
    return lifecycle.chunk_refs(files.select("manifest_id"), refs)


@query(
    f"""WITH {t.OPLOG}, d AS (SELECT user_id, sum(CASE op WHEN 'delete' THEN -2 WHEN 'put' THEN 1 ELSE 0 END) AS delta FROM oplog GROUP BY 1)
    SELECT user_id, CAST(greatest(0, 1 + delta) AS BIGINT) AS ref_count, CASE WHEN 1 + delta > 0 THEN 'ACTIVE' ELSE 'DELETED' END AS state FROM d"""
)
def ref_delta_clamp(spark, sf):
    log = t.oplog(spark, sf)
    delta = F.when(F.col("op") == "delete", -2).when(F.col("op") == "put", 1).otherwise(0)
    return lifecycle.apply_deltas(log.select("user_id", F.lit(1).cast("long").alias("ref_count")).distinct(), log.select("user_id", delta.alias("delta")), "user_id")


def _marks(confirm: int) -> str:
    state = "DELETED" if confirm <= 1 else "GARBAGE_CANDIDATE"
    return f"WITH {t.CHUNKS} SELECT segment_id, '{state}' AS new_state, count(*) AS n FROM chunks WHERE state = 'ACTIVE' AND ref_count <= 0 AND created_at < {t.NOW - t.WINDOW} GROUP BY 1"


def _mark(spark, sf, confirm: int) -> DataFrame:
    return lifecycle.mark_garbage(t.chunk_records(spark, sf), t.NOW, t.WINDOW, confirm).groupBy("segment_id", "new_state").agg(F.count(F.lit(1)).alias("n"))


@query(_marks(1))
def gc_mark_confirm1(spark, sf):
    return _mark(spark, sf, 1)


@query(_marks(2))
def gc_mark_confirm2(spark, sf):
    return _mark(spark, sf, 2)


#: A segment that has chunks which are not deleted, or whose time of deletion is not known, may not go.
STATS = f"""{t.CHUNKS}, {t.SEGMENTS}, pins AS (SELECT o_orderkey AS segment_id FROM orders WHERE o_orderkey % 11 = 0), stats AS (SELECT s.segment_id, s.state, s.sealed_at, s.created_at,
  CAST(coalesce(sum(CASE WHEN c.state <> 'DELETED' AND c.ref_count > 0 THEN c.length END), 0) AS BIGINT) AS live,
  CAST(coalesce(sum(CASE WHEN c.state = 'DELETED' OR c.ref_count = 0 THEN c.length END), 0) AS BIGINT) AS garbage,
  greatest(s.compacted_at, coalesce(max(CASE WHEN c.state = 'DELETED' THEN c.deleted_at END), 0)) AS dead_at,
  count(CASE WHEN c.state <> 'DELETED' OR c.deleted_at = 0 THEN 1 END) > 0 AS blocked
  FROM segments s LEFT JOIN chunks c ON c.segment_id = s.segment_id GROUP BY s.segment_id, s.state, s.sealed_at, s.created_at, s.compacted_at)"""


def _stats(spark, sf) -> DataFrame:
    return lifecycle.segment_stats(t.chunk_records(spark, sf), t.segment_records(spark, sf))


@query(f"WITH {STATS} SELECT * FROM stats")
def segment_gc_stats(spark, sf):
    return _stats(spark, sf)


@query(f"WITH {STATS} SELECT segment_id, live, garbage FROM stats WHERE state = 'SEALED' AND segment_id NOT IN (SELECT segment_id FROM pins) AND live > 0 AND garbage > 0 AND garbage / (live + garbage) >= 0.6")
def compaction_candidates(spark, sf):
    return lifecycle.compaction_candidates(_stats(spark, sf), 0.6, t.pinned(spark, sf)).select("segment_id", "live", "garbage")


@query(
    f"""WITH {STATS}, d AS (SELECT segment_id, garbage, CASE WHEN dead_at <> 0 THEN dead_at WHEN sealed_at <> 0 THEN sealed_at ELSE created_at END AS dead_at FROM stats
      WHERE state NOT IN ('DELETED', 'CORRUPT') AND NOT blocked AND segment_id NOT IN (SELECT segment_id FROM pins)) SELECT * FROM d WHERE dead_at <= {t.NOW - t.DELAY}"""
)
def dead_segments(spark, sf):
    return lifecycle.dead_segments(_stats(spark, sf), t.NOW, t.DELAY, t.pinned(spark, sf)).select("segment_id", "garbage", "dead_at")


@query(
    f"""WITH {t.CHUNKS}, moved AS (SELECT chunk_id, segment_id + CASE WHEN line > 5 THEN 1 ELSE 0 END AS source, "offset" + CASE WHEN segment_id % 7 = 0 AND line = 4 THEN 1 ELSE 0 END AS place,
      length + CASE WHEN segment_id % 9 = 0 AND line = 3 THEN 1 ELSE 0 END AS size FROM chunks WHERE ref_count > 0)
    SELECT m.source, count(CASE WHEN c.segment_id = m.source AND c."offset" = m.place AND c.length = m.size AND c.state <> 'DELETED' AND c.ref_count > 0 THEN 1 END) = count(*) AS valid
    FROM moved m LEFT JOIN chunks c USING (chunk_id) GROUP BY 1"""
)
def compaction_validate(spark, sf):
    c = t.chunk_records(spark, sf)
    off = lambda column, every, line: (F.col(column) + F.when((F.col("segment_id") % every == 0) & (F.col("line") == line), 1).otherwise(0)).alias(column)
    moved = c.where("ref_count > 0").select("chunk_id", (F.col("segment_id") + F.when(F.col("line") > 5, 1).otherwise(0)).alias("source"), off("offset", 7, 4), off("length", 9, 3))
    return lifecycle.valid_compactions(moved, c)


def _prune(spark, sf) -> dict[str, DataFrame]:
    nodes = t.tree(spark, sf)
    file = F.col("node") >= 10_000_000_000
    inodes = nodes.select(F.col("node").alias("inode"), F.when(F.col("node") % 7 == 3, "DELETED").otherwise("ACTIVE").alias("state"), F.when(file, "FILE").otherwise("DIR").alias("kind"), F.when(file, F.col("node") % 97).alias("manifest_id"))
    dirents = nodes.where("parent IS NOT NULL").select("parent", F.col("node").alias("child"))
    manifests = spark.range(200).select(F.col("id").alias("manifest_id"), F.when(F.col("id") % 3 == 0, "DELETED").otherwise("ACTIVE").alias("state"), (F.col("id") % 2).alias("ref_count"))
    tenants = nodes.where("parent IS NULL").select(F.col("node").alias("inode"))
    return lifecycle.prune(dirents, inodes, t.chunk_records(spark, sf), t.segment_records(spark, sf).select("segment_id", "state"), manifests, tenants)


PRUNE = f"""{t.TREE}, {t.CHUNKS}, {t.SEGMENTS}, inodes AS (SELECT node AS inode, CASE WHEN node % 7 = 3 THEN 'DELETED' ELSE 'ACTIVE' END AS state, CASE WHEN node >= 10000000000 THEN 'FILE' ELSE 'DIR' END AS kind,
    CASE WHEN node >= 10000000000 THEN node % 97 END AS manifest_id FROM nodes),
  e AS (SELECT parent, node AS child FROM nodes WHERE parent IN (SELECT inode FROM inodes WHERE state = 'ACTIVE' AND kind = 'DIR')),
  kept AS (SELECT * FROM inodes WHERE state <> 'DELETED' OR inode IN (SELECT child FROM e) OR inode IN (SELECT node FROM nodes WHERE parent IS NULL)),
  manifests AS (SELECT range AS manifest_id, CASE WHEN range % 3 = 0 THEN 'DELETED' ELSE 'ACTIVE' END AS state, range % 2 AS ref_count FROM range(200)),
  dropped AS (SELECT chunk_id FROM chunks WHERE state = 'DELETED' AND ref_count <= 0 AND segment_id NOT IN (SELECT segment_id FROM segments WHERE state <> 'DELETED'))"""


@query(f"WITH {PRUNE} SELECT parent, child FROM e")
def prune_dirents(spark, sf):
    return _prune(spark, sf)["dirents"].select("parent", "child")


@query(f"WITH {PRUNE} SELECT inode, state FROM kept")
def prune_inodes(spark, sf):
    return _prune(spark, sf)["inodes"].select("inode", "state")


@query(f"WITH {PRUNE} SELECT manifest_id FROM manifests WHERE state <> 'DELETED' OR ref_count > 0 OR manifest_id IN (SELECT manifest_id FROM kept WHERE state = 'ACTIVE' AND kind = 'FILE')")
def prune_manifests(spark, sf):
    return _prune(spark, sf)["manifests"].select("manifest_id")


@query(f"WITH {PRUNE} SELECT segment_id, count(*) AS n FROM chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM dropped) GROUP BY 1")
def prune_chunks(spark, sf):
    return _prune(spark, sf)["chunks"].groupBy("segment_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {PRUNE} SELECT segment_id FROM segments WHERE state <> 'DELETED' OR segment_id IN (SELECT segment_id FROM chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM dropped))")
def prune_segments(spark, sf):
    return _prune(spark, sf)["segments"].select("segment_id")


RANGE = (1000, 5000)


@query(
    f"""WITH RECURSIVE {t.chunks_sql()} SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, greatest(file_offset, 1000) - file_offset AS skip, least(file_offset + chunk_size, 6000) - greatest(file_offset, 1000) AS take
    FROM chunks WHERE file_offset < 6000 AND file_offset + chunk_size > 1000"""
)
def range_read_chunks(spark, sf):
    return integrity.range_chunks(_chunks(spark, sf), *RANGE).select("doc_id", "chunk_index", "skip", "take")


@query("SELECT doc_id, sha256(from_hex(substr(hex(encode(text)), 2001, 10000))) AS digest FROM documents WHERE octet_length(encode(text)) > 1000")
def range_read_bytes(spark, sf):
    return integrity.read_range(_chunks(spark, sf), ["doc_id"], *RANGE).select("doc_id", F.sha2("bytes", 256).alias("digest"))


@query("SELECT doc_id, sha256(encode(text)) AS digest FROM documents")
def file_rehash(spark, sf):
    parts = _chunks(spark, sf).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("chunk_index", "raw"))).alias("p"))
    return parts.select("doc_id", F.sha2(F.reduce("p", F.lit(b""), lambda all_, x: F.concat(all_, x["raw"])), 256).alias("digest"))


@query("SELECT DISTINCT l_orderkey AS segment_id FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def orphan_segments(spark, sf):
    files = t.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("segment_id")).distinct()
    return integrity.only_in(files, t.segment_records(spark, sf).where("state <> 'COMPACTING'"), "segment_id")


#: Segments whose file is there are those of an order that has lines.
FILES = "files AS (SELECT DISTINCT l_orderkey AS segment_id FROM lineitem WHERE l_linenumber <> 3)"


def _files(spark, sf) -> DataFrame:
    return t.table(spark, sf, "lineitem").where("l_linenumber <> 3").select(F.col("l_orderkey").alias("segment_id")).distinct()


@query(f"WITH {t.SEGMENTS}, {FILES} SELECT segment_id FROM segments WHERE state <> 'DELETED' AND segment_id NOT IN (SELECT segment_id FROM files)")
def missing_segments(spark, sf):
    return integrity.only_in(t.segment_records(spark, sf).where("state <> 'DELETED'").select("segment_id"), _files(spark, sf), "segment_id")


@query(f"WITH {t.CHUNKS}, {t.SEGMENTS} SELECT segment_id, state FROM segments WHERE state <> 'DELETED' AND segment_id NOT IN (SELECT segment_id FROM chunks WHERE state <> 'DELETED')")
def segment_without_chunks(spark, sf):
    return integrity.segments_without_chunks(t.segment_records(spark, sf).select("segment_id", "state"), t.chunk_records(spark, sf))


@query(f"WITH {t.CHUNKS}, {t.SEGMENTS} SELECT segment_id, count(*) AS n FROM chunks WHERE state <> 'DELETED' AND segment_id NOT IN (SELECT segment_id FROM segments WHERE state <> 'DELETED') GROUP BY 1")
def chunk_without_segment(spark, sf):
    return integrity.chunks_without_segment(t.chunk_records(spark, sf), t.segment_records(spark, sf)).groupBy("segment_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {t.CHUNKS}, {t.SEGMENTS} SELECT segment_id, count(*) AS chunks FROM chunks JOIN segments USING (segment_id) WHERE chunks.state <> 'DELETED' AND segments.state <> 'DELETED' GROUP BY 1")
def chunks_per_segment(spark, sf):
    return integrity.chunks_per_segment(t.chunk_records(spark, sf), t.segment_records(spark, sf))


@query(
    """SELECT count(*) AS chunks, count(*) FILTER (l_returnflag = 'R') AS deleted, count(*) FILTER (l_returnflag <> 'R' AND l_returnflag = 'N') AS live,
    CAST(sum(CASE WHEN l_returnflag <> 'R' THEN floor(l_quantity) ELSE 0 END) AS BIGINT) AS stored_bytes, (SELECT CAST(sum(octet_length(encode(text))) AS BIGINT) FROM documents) AS logical_bytes FROM lineitem"""
)
def stats_snapshot(spark, sf):
    c = t.chunk_records(spark, sf).agg(F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("state") == "DELETED").alias("deleted"), F.count_if((F.col("state") != "DELETED") & (F.col("ref_count") > 0)).alias("live"), F.sum(F.when(F.col("state") != "DELETED", F.col("length")).otherwise(0)).alias("stored_bytes"))
    logical = t.objects(spark, sf).agg(F.sum(F.octet_length("raw").cast("long")).alias("logical_bytes"))
    return c.select("*", logical.scalar().alias("logical_bytes"))


@query(
    """SELECT CASE WHEN closed THEN 'CLOSED' WHEN corrupt THEN 'CORRUPT' WHEN unreadable OR unwritable THEN 'READ_ONLY' WHEN degraded THEN 'DEGRADED' ELSE 'OK' END AS status, closed, corrupt, unreadable, unwritable, degraded
    FROM (SELECT false AS closed, bool_or(o_orderpriority = 'none') AS corrupt, false AS unreadable, bool_or(o_orderkey < 0) AS unwritable, bool_or(o_orderstatus = 'P') AS degraded FROM orders)"""
)
def health_status(spark, sf):
    o = t.table(spark, sf, "orders")
    return integrity.health(o.agg(F.lit(False).alias("closed"), F.bool_or(F.col("o_orderpriority") == "none").alias("corrupt"), F.lit(False).alias("unreadable"), F.bool_or(F.col("o_orderkey") < 0).alias("unwritable"), F.bool_or(F.col("o_orderstatus") == "P").alias("degraded")))


def _issues(spark, sf) -> DataFrame:
    segments, chunks, files = t.segment_records(spark, sf), t.chunk_records(spark, sf), _files(spark, sf)
    of = lambda df, column: df.select(F.col(column).cast("string").alias("subject"))
    found = {
        "compacting_segment": of(segments.where("state = 'COMPACTING'"), "segment_id"),
        "corrupt_segment": of(segments.where("state = 'CORRUPT'"), "segment_id"),
        "missing_segment": of(integrity.only_in(segments.where("state <> 'DELETED'"), files, "segment_id"), "segment_id"),
        "segment_without_chunks": of(integrity.segments_without_chunks(segments, chunks), "segment_id"),
        "chunk_without_segment": of(integrity.chunks_without_segment(chunks, segments).select("segment_id").distinct(), "segment_id"),
        "orphan_segment": of(integrity.only_in(files, segments.where("state <> 'DELETED'"), "segment_id"), "segment_id"),
    }
    return integrity.diagnose(found, "subject")


ISSUES = f"""{t.CHUNKS}, {t.SEGMENTS}, {FILES}, good AS (SELECT segment_id FROM segments WHERE state <> 'DELETED'), issues AS (
  SELECT 'compacting_segment' AS kind, 'warn' AS severity, true AS repairable, CAST(segment_id AS VARCHAR) AS subject FROM segments WHERE state = 'COMPACTING'
  UNION ALL SELECT 'corrupt_segment', 'error', false, CAST(segment_id AS VARCHAR) FROM segments WHERE state = 'CORRUPT'
  UNION ALL SELECT 'missing_segment', 'error', true, CAST(segment_id AS VARCHAR) FROM good WHERE segment_id NOT IN (SELECT segment_id FROM files)
  UNION ALL SELECT 'segment_without_chunks', 'warn', false, CAST(segment_id AS VARCHAR) FROM good WHERE segment_id NOT IN (SELECT segment_id FROM chunks WHERE state <> 'DELETED')
  UNION ALL SELECT DISTINCT 'chunk_without_segment', 'error', false, CAST(segment_id AS VARCHAR) FROM chunks WHERE state <> 'DELETED' AND segment_id NOT IN (SELECT segment_id FROM good)
  UNION ALL SELECT 'orphan_segment', 'warn', true, CAST(segment_id AS VARCHAR) FROM files WHERE segment_id NOT IN (SELECT segment_id FROM good))"""


@query(f"WITH {ISSUES} SELECT * FROM issues")
def diagnose_issues(spark, sf):
    return _issues(spark, sf)


@query(
    f"""WITH {ISSUES} SELECT CASE kind WHEN 'missing_segment' THEN 'mark_corrupt' WHEN 'orphan_segment' THEN 'clean_orphan_segment' ELSE 'reset_compacting' END AS action, subject
    FROM issues WHERE repairable ORDER BY 1, 2 LIMIT 100"""
)
def repair_plan(spark, sf):
    return integrity.repair_plan(_issues(spark, sf), 100)


KIND = "CASE WHEN s.state IS NULL THEN 'segment_missing' WHEN c.line = 7 THEN 'chunk_corrupt' WHEN s.state = 'CORRUPT' THEN 'segment_corrupt' WHEN c.length = 1 THEN 'segment_read_failed' WHEN c.length = 2 THEN 'chunk_hash_mismatch' END"


@query(
    f"""WITH {t.CHUNKS}, s AS (SELECT o_orderkey AS segment_id, CASE WHEN o_orderpriority LIKE '1%' THEN 'CORRUPT' ELSE 'SEALED' END AS state FROM orders WHERE o_orderstatus <> 'P'),
    k AS (SELECT c.segment_id, {KIND} AS kind FROM chunks c LEFT JOIN s USING (segment_id)) SELECT segment_id, kind, count(*) AS n FROM k WHERE kind IS NOT NULL GROUP BY 1, 2"""
)
def scrub_issue_kind(spark, sf):
    c = t.chunk_records(spark, sf)
    s = t.table(spark, sf, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("segment_id"), F.when(F.col("o_orderpriority").startswith("1"), "CORRUPT").otherwise("SEALED").alias("segment_state"))
    chunk_state = F.when(F.col("line") == 7, "CORRUPT").otherwise(F.col("state"))
    kind = integrity.chunk_issue(chunk_state, F.col("segment_state"), F.col("length") != 1, F.col("length") != 2)
    return c.join(s, "segment_id", "left").select("segment_id", kind.alias("kind")).where("kind IS NOT NULL").groupBy("segment_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH RECURSIVE {t.chunks_sql()}, bad AS (SELECT chunk_id FROM chunks WHERE doc_id % 50 = 7)
    SELECT DISTINCT lang || '/' || printf('%08d', doc_id) AS path FROM chunks JOIN (SELECT doc_id, lang FROM documents) USING (doc_id) WHERE chunk_id IN (SELECT chunk_id FROM bad)"""
)
def affected_files(spark, sf):
    c = _chunks(spark, sf)
    return integrity.affected_files(c.select("path", "chunk_id"), c.where("doc_id % 50 = 7"))


@query(f"WITH RECURSIVE {t.chunks_sql()} SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, chunk_size AS raw_size, true AS same, true AS checked FROM chunks")
def payload_roundtrip(spark, sf):
    """Payloads compressed, checksummed and opened again: the bytes are the same, and so is the checksum of what is compressed once more."""
    c = _chunks(spark, sf).select("doc_id", "chunk_index", "raw", codecs.zstd_compress("raw").alias("stored"))
    back = c.select("*", codecs.crc32c("stored").alias("sum"), codecs.zstd_decompress("stored").alias("opened"))
    again = codecs.crc32c(codecs.zstd_compress("opened"))
    return back.select("doc_id", "chunk_index", F.octet_length("opened").cast("long").alias("raw_size"), (F.col("raw") == F.col("opened")).alias("same"), (F.col("sum") == again).alias("checked"))


def queries() -> dict:
    return QUERIES | stores.QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL | stores.SQL
