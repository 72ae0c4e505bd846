"""Trees of named nodes: full paths, listing, reachability, and the changes that rename and make folders.

Nodes are rows (node, parent, name); roots have a null parent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.plans.scratch import cut


def full_paths(nodes: DataFrame) -> DataFrame:
    """(node, depth, path) of every node that hangs on a root. Nodes on a cycle, or without their parent, hang on none.

    Each round doubles the way that a node knows of its path, so a tree of any depth takes about as many rounds as its depth has
    binary digits. A round that brings no node to its root is the last: had there been deeper ones, their
    ancestors half way up would have got there in it."""
    known = cut(nodes.select("node", F.col("parent").alias("up"), F.lit(0).alias("depth"), F.col("name").alias("path")))
    found = known.where("up IS NULL")
    open_ = known.where("up IS NOT NULL").withColumn("depth", F.lit(1))
    while True:
        above = found.unionByName(open_).select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"), F.col("path").alias("_path"))
        joined = cut(open_.join(above, "up").select("node", F.col("_up").alias("up"), (F.col("depth") + F.col("_depth")).alias("depth"), F.concat_ws("/", "_path", "path").alias("path")))
        there = joined.where("up IS NULL")
        if there.isEmpty():
            return found.select("node", "depth", "path")
        found, open_ = found.unionByName(there), joined.where("up IS NOT NULL")


def reachable(nodes: DataFrame) -> DataFrame:
    return full_paths(nodes).select("node")


def unreachable(nodes: DataFrame) -> DataFrame:
    return nodes.join(reachable(nodes), "node", "left_anti")


def reachable_by_entries(roots: DataFrame, entries: DataFrame) -> DataFrame:
    """(node) that entries (parent, node) lead to from roots (node), by doubling as `full_paths` does. A node may have several entries."""
    found = cut(roots.select("node").distinct())
    open_ = cut(entries.select("node", F.col("parent").alias("up")).distinct().join(found, "node", "left_anti"))
    while True:
        above = open_.select(F.col("node").alias("up"), F.col("up").alias("_up")).unionByName(found.select(F.col("node").alias("up"), F.lit(None).cast("long").alias("_up")))
        joined = cut(open_.join(above, "up").select("node", F.col("_up").alias("up")).distinct())
        there = cut(joined.where("up IS NULL").select("node").distinct())
        if there.isEmpty():
            return found
        found, open_ = found.union(there), joined.where("up IS NOT NULL").join(there, "node", "left_anti")


def invalid_parents(nodes: DataFrame) -> DataFrame:
    """Nodes whose way up never ends in a root: their parent is missing, or they are on a cycle or below one."""
    return unreachable(nodes).select("node", F.lit("inode_parent_invalid").alias("kind"))


def list_dir(nodes: DataFrame, parent: int) -> DataFrame:
    """(node, name) of a folder's entries in order of name."""
    return nodes.where(F.col("parent") == parent).select("node", "name").orderBy("name")


def list_page(nodes: DataFrame, parent: int, offset: int, count: int) -> DataFrame:
    """A page of a folder's entries; `count` of 0 or less means all that are left."""
    rest = list_dir(nodes, parent).offset(offset)
    return rest.limit(count) if count > 0 else rest


def resolve(nodes: DataFrame, path: str) -> DataFrame:
    """The node at a path, or no row: one narrow lookup for each component."""
    at = nodes.where("parent IS NULL")
    for i, name in enumerate(x for x in path.replace("\\", "/").split("/") if x not in ("", ".")):
        if i:
            at = nodes.join(at.select(F.col("node").alias("parent")), "parent", "left_semi")
        at = at.where(F.col("name") == name)
    return at


def rename(nodes: DataFrame, node: int, new_parent: int | None, new_name: str) -> DataFrame:
    """The nodes after a rename: one row changes, whatever hangs below it."""
    here = F.col("node") == node
    parent = F.when(here, F.lit(new_parent).cast("long")).otherwise(F.col("parent"))
    return nodes.withColumns({"parent": parent, "name": F.when(here, new_name).otherwise(F.col("name"))})


def detach(nodes: DataFrame, node: int) -> DataFrame:
    """The nodes after a removal with all that is below: the entry goes, the rest becomes unreachable."""
    return nodes.where(F.col("node") != node)


def missing_folders(paths: DataFrame, existing: DataFrame) -> DataFrame:
    """(path) of the folders to make so that each `path` (an array of its prefixes, `prefixes`) exists."""
    return paths.select(F.explode("prefixes").alias("path")).distinct().join(existing.select("path"), "path", "left_anti")


def latest(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, by `order`: what folding the log leaves, tombstones included."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_x")).select(*keys, "_x.*")


def last_runs(runs: DataFrame, keep: int) -> DataFrame:
    """The latest `keep` runs by epoch: a top-k, which Spark takes from each partition before merging."""
    return runs.orderBy(F.desc("epoch")).limit(keep)


