"""The driver's tables seen as objects, chunks, trees and logs, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Chunk sizes of the queries, small enough that some documents have several.
LOW, AVG, HIGH = 256, 1024, 4096
#: Days since 1970 of "now", and the waiting times before garbage is marked and segments go.
NOW, WINDOW, DELAY = 10_400, 30, 60
DETACHED = 1003


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.col("source").alias("tenant"), F.format_string("%s/%08d", F.col("lang"), F.col("doc_id")).alias("path"), F.col("text").cast("binary").alias("raw"))


def chunk_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    flag = F.col("l_returnflag")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("segment_id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("chunk_id"),
        F.col("l_linenumber").alias("line"),
        F.when(flag == "R", "DELETED").otherwise("ACTIVE").alias("state"),
        F.when(flag == "N", 1).otherwise(0).cast("long").alias("ref_count"),
        F.floor("l_quantity").cast("long").alias("length"),
        day.alias("created_at"),
        F.when(flag == "R", day).otherwise(0).cast("long").alias("deleted_at"),
        F.lit(1).alias("seen"),
        (F.col("l_linenumber") * 100).cast("long").alias("offset"),
    )


CHUNKS = """chunks AS (SELECT l_orderkey AS segment_id, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS chunk_id, l_linenumber AS line,
  CASE WHEN l_returnflag = 'R' THEN 'DELETED' ELSE 'ACTIVE' END AS state, CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END AS ref_count,
  CAST(floor(l_quantity) AS BIGINT) AS length, CAST(l_linenumber * 100 AS BIGINT) AS "offset", date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS created_at,
  CASE WHEN l_returnflag = 'R' THEN date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) ELSE 0 END AS deleted_at FROM lineitem)"""


def segment_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    status, priority, none = F.col("o_orderstatus"), F.substring("o_orderpriority", 1, 1), F.lit(0).cast("long")
    state = F.when(status == "P", "COMPACTING").when((status == "O") & (priority == "1"), "CORRUPT").when((status == "O") & (priority == "2"), "DELETED").otherwise("SEALED")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("segment_id"),
        state.alias("state"),
        F.when(F.col("o_custkey") % 3 == 0, none).otherwise(day).alias("sealed_at"),
        (day - 5).alias("created_at"),
        F.when(F.col("o_custkey") % 5 == 0, day + 40).otherwise(none).alias("compacted_at"),
    )


SEGMENTS = """segments AS (SELECT segment_id, state, CASE WHEN c % 3 = 0 THEN 0 ELSE day END AS sealed_at, day - 5 AS created_at, CASE WHEN c % 5 = 0 THEN day + 40 ELSE 0 END AS compacted_at FROM (
  SELECT o_orderkey AS segment_id, o_custkey AS c, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS day,
  CASE WHEN o_orderstatus = 'P' THEN 'COMPACTING' WHEN o_orderstatus = 'O' AND o_orderpriority LIKE '1%' THEN 'CORRUPT' WHEN o_orderstatus = 'O' AND o_orderpriority LIKE '2%' THEN 'DELETED' ELSE 'SEALED' END AS state FROM orders))"""


def pinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that readers hold."""
    return table(spark, sf_dir, "orders").where("o_orderkey % 11 = 0").select(F.col("o_orderkey").alias("segment_id"))


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, parent, name): regions, their nations, their customers, their orders."""
    r, n, c, o = (table(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders"))
    name = lambda letter, col: F.concat(F.lit(letter), F.col(col).cast("string")).alias("name")
    num = lambda base, col: (F.col(col).cast("long") + base)
    return (
        r.select(num(1, "r_regionkey").alias("node"), F.lit(None).cast("long").alias("parent"), name("r", "r_regionkey"))
        .union(n.select(num(1000, "n_nationkey"), num(1, "n_regionkey"), name("n", "n_nationkey")))
        .union(c.select(num(1_000_000, "c_custkey"), num(1000, "c_nationkey"), name("c", "c_custkey")))
        .union(o.select(num(10_000_000_000, "o_orderkey"), num(1_000_000, "o_custkey"), name("o", "o_orderkey")))
    )


TREE = """nodes AS (SELECT CAST(r_regionkey AS BIGINT) + 1 AS node, CAST(NULL AS BIGINT) AS parent, 'r' || r_regionkey AS name FROM region
  UNION ALL SELECT CAST(n_nationkey AS BIGINT) + 1000, CAST(n_regionkey AS BIGINT) + 1, 'n' || n_nationkey FROM nation
  UNION ALL SELECT c_custkey + 1000000, CAST(c_nationkey AS BIGINT) + 1000, 'c' || c_custkey FROM customer
  UNION ALL SELECT o_orderkey + 10000000000, o_custkey + 1000000, 'o' || o_orderkey FROM orders)"""


def paths_sql(nodes: str = "nodes") -> str:
    return f"paths AS (SELECT node, 0 AS depth, name AS path FROM {nodes} WHERE parent IS NULL UNION ALL SELECT n.node, p.depth + 1, p.path || '/' || n.name FROM {nodes} n JOIN paths p ON n.parent = p.node)"


def oplog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(txid, user_id, k, op): events as operations; views change nothing and are left out."""
    e = table(spark, sf_dir, "events").where("event_type <> 'view'")
    op = F.element_at(F.create_map(*[F.lit(x) for x in ("click", "put", "purchase", "update", "error", "delete", "signup", "mkdir")]), F.col("event_type"))
    return e.select(F.col("event_id").alias("txid"), "user_id", F.regexp_extract("props", '"k": ?([0-9]+)', 1).try_cast("int").alias("k"), op.alias("op"))


OPLOG = """oplog AS (SELECT event_id AS txid, user_id, TRY_CAST(regexp_extract(props, '"k": ?([0-9]+)', 1) AS INTEGER) AS k,
  CASE event_type WHEN 'click' THEN 'put' WHEN 'purchase' THEN 'update' WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'mkdir' END AS op FROM events WHERE event_type <> 'view')"""


def chunks_sql(scope: str = "") -> str:
    """Content-defined chunks of documents in SQL: fingerprints of ten bytes by lags, then the choice among the cuts."""
    from chunkloom.operators.chunking import gear, mask_bits

    k = mask_bits(AVG)
    rows = ", ".join(f"('{b:02X}', {int(g) & (1 << k) - 1})" for b, g in enumerate(gear()))
    h = " + ".join(f"coalesce(lag(g, {j}) OVER w, 0) * {1 << j}" for j in range(k))
    data = "from_hex(substr(hex, CAST(2 * a + 1 AS BIGINT), CAST(2 * (b - a) AS BIGINT)))"
    hashed = f"encode(source) || '\\x00'::BLOB || {data}" if scope else data
    return f"""gear(hx, g) AS (VALUES {rows}),
  docs AS (SELECT doc_id, source, coalesce(hex(encode(text)), '') AS hex, coalesce(octet_length(encode(text)), 0) AS size FROM documents),
  bytes AS (SELECT doc_id, unnest(l) AS hx, unnest(range(len(l))) AS pos FROM (SELECT doc_id, regexp_extract_all(hex, '..') AS l FROM docs WHERE size >= {HIGH})),
  prints AS (SELECT doc_id, pos, ({h}) % {1 << k} AS h FROM bytes JOIN gear USING (hx) WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
  cuts AS (SELECT doc_id, list(pos + 1 ORDER BY pos) AS c FROM prints WHERE h = 0 GROUP BY 1),
  pieces AS (SELECT doc_id, 0 AS i, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b FROM docs
    UNION ALL SELECT p.doc_id, p.i + 1, p.b, CASE WHEN d.size - p.b < {HIGH} THEN d.size ELSE coalesce(list_filter(c.c, lambda x: x >= p.b + {LOW} AND x <= p.b + {HIGH})[1], p.b + {HIGH}) END
    FROM pieces p JOIN docs d USING (doc_id) LEFT JOIN cuts c USING (doc_id) WHERE p.b < d.size OR p.i = 0),
  chunks AS (SELECT doc_id, source, i - 1 AS chunk_index, a AS file_offset, b - a AS chunk_size, sha256({hashed}) AS chunk_id FROM pieces JOIN docs USING (doc_id) WHERE i > 0)"""
