"""Hash trees over tables, their differences, and repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import bucket_of, leaf_text


def leaves(rows: DataFrame, buckets: int, parts: int = 16) -> DataFrame:
    """(idx, hash) of rows (key, value); '' for an empty bucket.

    A bucket's rows are cut into `parts` by further bits of the key's hash.  A part's hash is the md5 of
    its rows in order, a bucket's the md5 of its parts' hashes in order, so no row holds more than
    1 / (buckets x parts) of the data; raise either with it.
    """
    if buckets < 1:
        raise ValueError("at least one bucket")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("key", "value"))), lambda r: leaf_text(r["key"], r["value"]))
    part = F.pmod(F.conv(F.substring(F.md5(F.col("key").cast("binary")), 9, 8), 16, 10).cast("long"), F.lit(parts))
    inner = rows.groupBy(bucket_of("key", buckets).alias("idx"), part.alias("part")).agg(F.md5(F.array_join(listed, "").cast("binary")).alias("hash"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("part", "hash"))), lambda r: r["hash"])
    found = inner.groupBy("idx").agg(F.md5(F.array_join(in_order, "").cast("binary")).alias("hash"))
    every = rows.sparkSession.range(buckets).select(F.col("id").cast("int").alias("idx"))
    return every.join(found, "idx", "left").select("idx", F.coalesce("hash", F.lit("")).alias("hash"))


def node_diff(holdings: DataFrame, nodes: DataFrame, buckets: int = 8, a: str = "", b: str = "") -> DataFrame:
    """(node_a, node_b, root_a, root_b, idx): differing buckets of two nodes, one row with a null idx if there are none.

    Unless both are named, they are the cluster's first two; fewer than two nodes are an error.
    """
    if not (a and b):
        first = [r.node for r in nodes.orderBy("ord").select("node").limit(2).collect()]
        if len(first) < 2:
            raise ValueError("requires two nodes")
        a, b = first
    x, y = (leaves(holdings.where(F.col("node") == n).select("key", "value"), buckets) for n in (a, b))
    top = lambda leaf, name: root(holdings.sparkSession, leaf, buckets).select(F.col("hash").alias(name))
    heads = top(x, "root_a").join(F.broadcast(top(y, "root_b")), F.lit(True))  # one row each
    return heads.join(F.broadcast(diff(x, y)), F.lit(True), "left").select(F.lit(a).alias("node_a"), F.lit(b).alias("node_b"), "root_a", "root_b", "idx")


def built(leaf: DataFrame) -> DataFrame:
    """(buckets, empty): the number of a tree's buckets, and whether none holds a row."""
    return leaf.agg(F.count("*").cast("int").alias("buckets"), (F.count_if(F.col("hash") != "") == 0).alias("empty"))


def summed_leaves(rows: DataFrame, buckets: int) -> DataFrame:
    """(idx, hash): an order-free variant that adds row hashes, so that a bucket of any size combines before the shuffle."""
    part = lambda i: F.sum(F.conv(F.substring(F.md5(leaf_text("key", "value").cast("binary")), i, 12), 16, 10).cast("decimal(20,0)"))
    found = rows.groupBy(bucket_of("key", buckets).alias("idx")).agg(F.md5(F.concat_ws(",", part(1), part(13), F.count("*")).cast("binary")).alias("hash"))
    every = rows.sparkSession.range(buckets).select(F.col("id").cast("int").alias("idx"))
    return every.join(found, "idx", "left").select("idx", F.coalesce("hash", F.lit("")).alias("hash"))


def tree(leaf: DataFrame, buckets: int) -> DataFrame:
    """(level, idx, hash), level 0 the root: leaves padded to a power of two, a parent of two empty children empty."""
    depth = max(0, (buckets - 1).bit_length())
    out = now = leaf.select(F.lit(depth).alias("level"), "idx", "hash")
    for level in range(depth - 1, -1, -1):
        side = lambda k: F.coalesce(F.max(F.when(F.col("idx") % 2 == k, F.col("hash"))), F.lit(""))
        pair = now.groupBy(F.floor(F.col("idx") / 2).cast("int").alias("p")).agg(side(0).alias("l"), side(1).alias("r"))
        both = F.concat("l", F.lit(":"), "r")
        now = pair.select(F.lit(level).alias("level"), F.col("p").alias("idx"), F.when((F.col("l") == "") & (F.col("r") == ""), "").otherwise(F.md5(both.cast("binary"))).alias("hash"))
        out = out.unionByName(now)
    return out


def root(spark: SparkSession, leaf: DataFrame, buckets: int) -> DataFrame:
    return tree(leaf, buckets).where("level = 0").select("hash")


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """idx of leaves that differ; a bucket that one side lacks counts as empty."""
    x, y = a.select("idx", F.col("hash").alias("x")), b.select("idx", F.col("hash").alias("y"))
    return x.join(y, "idx", "full").where(F.coalesce("x", F.lit("")) != F.coalesce("y", F.lit(""))).select("idx")


def diff_by_levels(a: DataFrame, b: DataFrame, buckets: int) -> DataFrame:
    """diff() of two trees from the root down: only children of nodes that differ are compared.

    The plan grows with the square of the depth: for more than a few dozen buckets give stored trees, or take diff().
    """
    depth = max(0, (buckets - 1).bit_length())
    x, y = a.withColumnRenamed("hash", "x"), b.withColumnRenamed("hash", "y")
    both = x.join(y, ["level", "idx"]).where("x <> y")
    now = both.where("level = 0").select("idx")
    for level in range(1, depth + 1):
        at = both.where(F.col("level") == level).select("idx")
        now = at.join(now.select(F.col("idx").alias("p")), F.floor(F.col("idx") / 2) == F.col("p"), "left_semi")
    return now


def key_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    x, y = a.select("key", F.col("value").alias("a_value")), b.select("key", F.col("value").alias("b_value"))
    return x.join(y, "key", "full").where(~F.col("a_value").eqNullSafe(F.col("b_value")))


def repair(a: DataFrame, b: DataFrame) -> DataFrame:
    """What both sides hold afterwards: the union, a's value where both have one."""
    x, y = a.select("key", F.col("value").alias("a_value")), b.select("key", F.col("value").alias("b_value"))
    return x.join(y, "key", "full").select("key", F.coalesce("a_value", "b_value").alias("value"))
