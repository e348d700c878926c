"""Consistent hashing as tables: ring positions, arcs with preference lists, lookups.

A key's arc is found by an equi-join on the top bits of its hash and a range
check inside, not by a nested loop.  Arcs number nodes * vnodes: the cluster's size, not the data's;
MOST_ARCS guards the broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import RING_SIZE, h32, vnode_name

SLICES = 4096
MOST_ARCS = 200_000
#: Rings whose preference lists hold so many names or fewer, positions x nodes, are made by one task, without a shuffle.
ONE_TASK = 1_000_000


def ring(nodes: DataFrame, vnodes: int) -> DataFrame:
    """(pos, node); of nodes that meet at a position the greatest has it.  Repeated nodes count once."""
    # the cluster's configuration, a row a node: literal rows are counted without a job
    n = len(nodes.select("node").limit(MOST_ARCS).collect())
    nodes = nodes.coalesce(1) if n * n * vnodes <= ONE_TASK else nodes
    rows = nodes.select("node").distinct().select("node", F.explode(F.sequence(F.lit(0), F.lit(vnodes - 1))).alias("i"))
    out = rows.groupBy(h32(vnode_name("node", F.col("i"))).alias("pos")).agg(F.max("node").alias("node"))
    out._most, out._one_task = n * vnodes, n * n * vnodes <= ONE_TASK
    return out


def without(nodes: DataFrame, node: str) -> DataFrame:
    return nodes.where(F.col("node") != node)


def arcs(ring_: DataFrame) -> DataFrame:
    """(lo, hi, pref): keys with lo < hash <= hi prefer pref's nodes in order.  The first arc is there twice, for the wrap.

    Each position looks up every node's next position, so the work is what the lists hold, positions x nodes.  An
    empty ring is an error when rows are asked for.
    """
    n, whole = getattr(ring_, "_most", None), Window.partitionBy()
    ends = ring_.withColumn("prev", F.lag("pos").over(Window.orderBy("pos"))).withColumn("top", F.max("pos").over(whole))
    if getattr(ring_, "_one_task", False):
        ends = ends.withColumn("names", F.collect_set("node").over(whole))
    else:
        ends = ends.join(F.broadcast(ring_.agg(F.collect_set("node").alias("names"))), F.lit(True))  # one row
    grid = ends.select("pos", "prev", "top", F.col("node").alias("at"), F.explode("names").alias("node"))
    onward = Window.partitionBy("node").orderBy("pos").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    own = F.when(F.col("at") == F.col("node"), F.col("pos"))
    first = F.min(own).over(Window.partitionBy("node")) + RING_SIZE
    near = grid.withColumn("d", F.coalesce(F.first(own, ignorenulls=True).over(onward), first) - F.col("pos"))
    pref = near.groupBy("pos", "prev", "top").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "node"))), lambda x: x["node"]).alias("pref"))
    arc = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
    up_to = arc(F.coalesce("prev", F.lit(-1).cast("long")), F.col("pos"))
    past = arc(F.col("top"), F.lit(RING_SIZE).cast("long"))  # the first position's arc begins past the last one
    found = pref.select(F.explode(F.when(F.col("prev").isNull(), F.array(past, up_to)).otherwise(F.array(up_to))).alias("arc"), "pref")
    found = found.select("arc.lo", "arc.hi", "pref").where("lo < hi")
    if not n:
        fault = F.raise_error(F.lit("the ring is empty"))
        empty = ring_.agg(F.count("*").alias("n")).where("n = 0")
        found = found.union(empty.select(fault.cast("long").alias("lo"), fault.cast("long").alias("hi"), F.lit(None).cast("array<string>").alias("pref")))
    found._most = n
    return found


def place(keys: DataFrame, arcs_: DataFrame, key: str = "key") -> DataFrame:
    """keys with pref, the nodes from the key's owner on.  Arcs are broadcast where their number, known from the ring, is small."""
    n = getattr(arcs_, "_most", None)
    n = arcs_.count() if n is None else n
    width = RING_SIZE // SLICES
    cut = arcs_.withColumn("slice", F.expr(f"explode(sequence((lo + 1) div {width}, least(hi, {RING_SIZE - 1}) div {width}))"))
    cut = F.broadcast(cut) if n <= MOST_ARCS else cut
    # a hash that can't be null is made once a row: the join adds no filter that makes it again
    hashed = keys.where(F.col(key).isNotNull()).withColumn("__h", F.coalesce(h32(key), F.lit(0).cast("long"))).withColumn("slice", F.expr(f"__h div {width}"))
    return hashed.join(cut, "slice").where((F.col("__h") > F.col("lo")) & (F.col("__h") <= F.col("hi"))).drop("slice", "lo", "hi", "__h")


def replicas(pref: Column, n: int) -> Column:
    """The first n nodes; an error if there are fewer."""
    enough = F.when(F.size(pref) < n, F.raise_error(F.lit("more replicas than nodes")).cast("array<string>"))
    return F.coalesce(enough, F.slice(pref, 1, n)) if n else F.slice(pref, 1, 0)


def balance(placed: DataFrame) -> DataFrame:
    return placed.groupBy(F.col("pref")[0].alias("node")).agg(F.count("*").alias("n_keys"))


def movement(before: DataFrame, after: DataFrame, key: str = "key") -> DataFrame:
    b, a = before.select(key, F.col("pref")[0].alias("was")), after.select(key, F.col("pref")[0].alias("now"))
    return b.join(a, key).withColumn("moved", F.col("was") != F.col("now"))


def ownership(arcs_: DataFrame) -> DataFrame:
    """Each node's true share of the ring."""
    size = F.least("hi", F.lit(RING_SIZE - 1)) - F.col("lo")
    return arcs_.groupBy(F.col("pref")[0].alias("node")).agg(F.sum(size).alias("positions"))
