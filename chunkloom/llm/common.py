"""What the training-data operators share: tables, shared scratch space, Arrow maps, ranks, components."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of an Arrow batch sent to Python: small, since one text may be very long.
BATCH_ROWS = 256


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names. Where that is unset, a temporary folder will do if driver
    and executors are one process, and is an error otherwise: executors would not find one another's files."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="chunkloom-")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/chunkloom/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` to the shared folder and reads it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    # What was shuffled for it is of no more use; Spark removes shuffle files once the driver's references are collected.
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Removes the files of a table that `materialise` gave and that nothing refers to any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def small_or_shuffled(df: DataFrame, most: int) -> DataFrame:
    """Marks a written table for broadcast if it has at most `most` rows; else joins with it shuffle as usual."""
    return F.broadcast(df) if df.count() <= most else df


def arrow_map(df: DataFrame, work: Callable[[Iterator[dict]], Iterator[dict]], schema: str, numbers: bool = False, rows: int = BATCH_ROWS) -> DataFrame:
    """`work` gets each task's batches as dicts of lists, or of numpy arrays if all columns are `numbers`, and yields dicts of lists in
    `schema`. The number of `rows` of a batch holds until the next call, so a table that needs few is to be worked through at once."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    target = spark.createDataFrame([], schema).schema

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(target)

        def columns() -> Iterator[dict]:
            for batch in it:
                if batch.num_rows:
                    yield {n: batch.column(i).to_numpy() if numbers else batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}

        for out in work(columns()):
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, type=f.type) for f, x in ((f, out[f.name]) for f in arrow)], schema=arrow)

    return df.mapInArrow(batches, schema)


def gathered(it: Iterator[dict], text: str, target: int = 8 << 20) -> Iterator[dict]:
    """Joins a task's small batches until their texts have `target` characters."""
    held, size = None, 0
    for cols in it:
        held = cols if held is None else {k: held[k] + cols[k] for k in cols}
        size += sum(len(x) for x in cols[text] if x is not None)
        if size >= target:
            yield held
            held, size = None, 0
    if held is not None:
        yield held


def rank_within(df: DataFrame, keys: list[str], order: list[Column], out: str, salts: int = 256) -> DataFrame:
    """Adds `out`, 0, 1, 2... within `keys`. Each key's rows are ranked in `salts` parts and shifted by the parts'
    sizes, so that no task sorts a whole hot key. `df` must give the same rows when it is computed again."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    sizes = salted.groupBy(*keys, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*keys, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    local = Window.partitionBy(*keys, "_salt").orderBy(*order)
    ranked = salted.withColumn("_r", F.row_number().over(local) - 1)
    return ranked.join(sizes, [*keys, "_salt"]).withColumn(out, (F.col("_base") + F.col("_r")).cast("long")).drop("_salt", "_base", "_r")


def by_row(docs: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """Adds `_row`, a number of each row's own: its id, or one beyond all ids where that is null or repeated. Rows that repeat an id
    follow all others, in an order that their `columns` give. `docs` must give the same rows when it is computed again."""
    rows, ids, last = docs.agg(F.count(F.lit(1)), F.countDistinct(id_col), F.max(F.col(id_col).cast("long"))).first()
    if rows == ids:
        return docs.withColumn("_row", F.col(id_col).cast("long"))
    order = [F.xxhash64(*columns)]
    ranked = materialise(rank_within(docs.where(F.col(id_col).isNotNull()), [id_col], order, "_n"), "ranked")
    first = ranked.where("_n = 0").select(*docs.columns, F.col(id_col).cast("long").alias("_row"))
    others = ranked.where("_n > 0").select(*docs.columns).union(docs.where(F.col(id_col).isNull()))
    others = rank_within(others, [], order, "_n").select(*docs.columns, (F.col("_n") + F.lit((-1 if last is None else last) + 1)).alias("_row"))
    return materialise(first.union(others), "rows")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of the component of each node on an edge (u, v), of longs or of binary keys.

    Alternating large and small stars; each round is written to the shared folder. A hot node's edges are
    joined, not grouped, so that adaptive execution can split them."""
    now = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        mark = tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if mark == seen or not mark[0]:
            break
        seen = mark
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u > v").distinct()
        before, now = now, materialise(small, "edges")
        drop_table(before)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
