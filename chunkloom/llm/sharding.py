"""Sharding: indivisible groups of rows dealt to shards of near-equal bytes by Karmarkar-Karp differencing.

A partial partition has `shards` parts. Differencing takes the two partial partitions of largest spread and joins
the largest part of one with the smallest of the other, until one is left. Groups are first differenced within
blocks, each in one task; the blocks' results are partial partitions again and are differenced in the same way.

Edge cases: a null text has no bytes and counts as an empty one; every row counts one byte more than its text;
equal texts stay together, however many; an empty table gives no rows; repeated rows each get a slot; other columns
of the input are not read. A single group larger than a shard's share cannot be balanced away, since it may not be cut.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.llm.common import materialise, rank_within, read

#: Groups of a block, on average.
BLOCK_GROUPS = 100_000


def difference(partials: list[list[tuple[int, object]]], shards: int) -> list[tuple[int, object]]:
    """One partition from many. A part is (sum, what it holds); what two joined parts hold is a pair (a, b) of theirs,
    None stands for nothing."""
    heap = []
    for i, parts in enumerate(partials):
        parts = sorted([*parts, *[(0, None)] * (shards - len(parts))], key=lambda p: -p[0])
        heap.append((parts[-1][0] - parts[0][0], i, parts))
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        joined = [(x[0] + y[0], (x[1], y[1]) if x[1] is not None and y[1] is not None else x[1] if y[1] is None else y[1]) for x, y in zip(a, reversed(b), strict=True)]
        joined.sort(key=lambda p: -p[0])
        n += 1
        heapq.heappush(heap, (joined[-1][0] - joined[0][0], n, joined))
    return heap[0][2] if heap else [(0, None)] * shards


def held(what: object) -> list:
    """The leaves of nested pairs."""
    out, stack = [], [what]
    while stack:
        x = stack.pop()
        if isinstance(x, tuple):
            stack.extend(x)
        elif x is not None:
            out.append(x)
    return out


def assign_groups(groups: DataFrame, shards: int, block_groups: int = BLOCK_GROUPS) -> DataFrame:
    """(key, size long) of distinct groups to (key, shard int)."""
    import pandas as pd

    blocks = max(1, -(-groups.count() // block_groups))

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "key"], ascending=[False, True], ignore_index=True)
        parts = difference([[(int(s), i)] for i, s in enumerate(pdf["size"])], shards)
        part = pd.Series(0, index=pdf.index, dtype="int32")
        for p, (_, what) in enumerate(parts):
            part.iloc[held(what)] = p
        return pdf.assign(part=part)[["block", "key", "size", "part"]]

    dealt = groups.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
    kind = dict(groups.dtypes)["key"]
    dealt = materialise(dealt.groupBy("block").applyInPandas(block, f"block int, key {kind}, size long, part int"), "groups")
    # One row for each block and part: a block holds block_groups groups, so this is a small share of the groups' number.
    sums: dict[int, list] = {}
    for r in dealt.groupBy("block", "part").agg(F.sum("size").alias("n")).collect():
        sums.setdefault(r["block"], []).append((r["n"], (r["block"], r["part"])))
    tagged = [[(n, [at]) for n, at in sums[b]] for b in sorted(sums)]
    final = difference(tagged, shards)
    places = [(*at, shard) for shard, (_, what) in enumerate(final) for leaf in held(what) for at in leaf]
    to = dealt.sparkSession.createDataFrame(places, "block int, part int, shard int")
    return dealt.join(to, ["block", "part"]).select("key", "shard")


def shard_rows(df: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", block_groups: int = BLOCK_GROUPS) -> DataFrame:
    """(id, size long, text_crc32 long, shard int, slot long) of each row; rows with equal texts share a shard."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(id_col, (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("key"))
    rows = materialise(rows.withColumn("key", F.concat("key", F.col("size").cast("string").cast("binary"))), "rows")
    groups = rows.groupBy("key").agg(F.sum("size").alias("size"))
    placed = rows.join(assign_groups(groups, shards, block_groups), "key").select(id_col, "size", "text_crc32", "shard")
    return rank_within(materialise(placed, "placed"), ["shard"], [F.col(id_col), F.col("text_crc32"), F.col("size")], "slot")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shard_rows(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op6_sharding": op6_sharding}
