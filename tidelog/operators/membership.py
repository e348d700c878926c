"""Heartbeat membership: merging lists, time-outs, gossip rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge(seen: DataFrame) -> DataFrame:
    """(observer, node, heartbeat, last_seen): the highest counter, and when it was first seen.  An equal or lower one refreshes nothing."""
    best = F.max(F.struct("heartbeat", (-F.unix_micros(F.col("seen").cast("timestamp"))).alias("t")))
    out = seen.groupBy("observer", "node").agg(best.alias("m"))
    return out.select("observer", "node", F.col("m.heartbeat").alias("heartbeat"), F.timestamp_micros(-F.col("m.t")).alias("last_seen"))


def overdue(last_seen: Column, as_of: Column, timeout_ms: int) -> Column:
    """Strictly longer ago than the time-out."""
    return F.unix_millis(as_of) - F.unix_millis(last_seen) > timeout_ms


def status(last_seen: Column, as_of: Column, timeout_ms: int, disabled: Column | None = None) -> Column:
    dead = last_seen.isNull() | overdue(last_seen, as_of, timeout_ms)
    return F.when(dead | (disabled if disabled is not None else F.lit(False)), "DEAD").otherwise("ALIVE")


def add(members: DataFrame, new: DataFrame) -> DataFrame:
    """Members not yet known enter with counter 0."""
    return members.unionByName(new.join(members, ["observer", "node"], "left_anti").withColumn("heartbeat", F.lit(0).cast("long")).select(*members.columns))


def remove(members: DataFrame, node: str) -> DataFrame:
    """Everyone forgets the node, but the node itself."""
    return members.where((F.col("node") != node) | (F.col("node") == F.col("observer")))


def round_(members: DataFrame, nodes: DataFrame, now: Column) -> DataFrame:
    """One full-mesh round: live nodes beat, and each takes the highest counters that any live node holds.

    Closed form: a maximum per member over live observers.  The time changes only where the counter rose.
    """
    live = nodes.where(~F.col("disabled")).select(F.col("node").alias("live"))
    beat = F.col("heartbeat") + F.when((F.col("observer") == F.col("node")) & F.col("live").isNotNull(), 1).otherwise(0)
    now_ = members.join(live, F.col("observer") == F.col("live"), "left").withColumn("beat", beat)
    top = now_.where(F.col("live").isNotNull()).groupBy("node").agg(F.max("beat").alias("top"))
    grid = live.select(F.col("live").alias("observer")).join(top, F.lit(True))
    held = now_.select("observer", "node", "heartbeat", "last_seen", "live")
    out = held.join(grid, ["observer", "node"], "full")
    risen = F.col("top").isNotNull() & (F.col("heartbeat").isNull() | (F.col("top") > F.col("heartbeat")))
    return out.select("observer", "node", F.when(risen, F.col("top")).otherwise(F.col("heartbeat")).alias("heartbeat"), F.when(risen, now).otherwise(F.col("last_seen")).alias("last_seen"))


def joined(nodes: DataFrame, now: Column) -> DataFrame:
    """Membership of nodes that just started: each knows itself, at counter 0."""
    return nodes.select(F.col("node").alias("observer"), "node", F.lit(0).cast("long").alias("heartbeat"), now.alias("last_seen"))


def introduced(members: DataFrame, node: str, now: Column) -> DataFrame:
    """A new node and all observers know each other; what is known already stays.  Both sides enter at counter 0."""
    seen = members.select("observer").distinct().where(F.col("observer") != node)
    rows = seen.select("observer", F.lit(node).alias("node")).union(seen.select(F.lit(node).alias("observer"), F.col("observer").alias("node")))
    me = members.sparkSession.range(1).select(F.lit(node).alias("observer"), F.lit(node).alias("node"))
    return add(members, rows.union(me).withColumn("last_seen", now))


def beat(members: DataFrame, node: Column, now: Column, times: int = 1) -> DataFrame:
    """Own heartbeats of the nodes that the condition names: counter up, time now, in their own lists only."""
    own = (F.col("observer") == F.col("node")) & node
    counted = F.when(own, F.col("heartbeat") + times).otherwise(F.col("heartbeat"))
    return members.select("observer", "node", counted.alias("heartbeat"), F.when(own, now).otherwise(F.col("last_seen")).alias("last_seen"))


def rounds(members: DataFrame, nodes: DataFrame, nows: list[Column]) -> DataFrame:
    """The loop of gossip rounds, one for each time given; a stream runs one a trigger."""
    for now in nows:
        members = round_(members, nodes, now)
    return members


def view(members: DataFrame, observer: str, nodes: DataFrame, as_of: Column, timeout_ms: int) -> DataFrame:
    """(node, heartbeat, status) as one observer sees them; a killed or overdue node is DEAD."""
    mine = members.where(F.col("observer") == observer)
    out = mine.join(F.broadcast(nodes.select("node", "disabled")), "node", "left")
    gone = F.coalesce(F.col("disabled"), F.lit(False))
    return out.select("node", "heartbeat", status(F.col("last_seen"), as_of, timeout_ms, gone).alias("status"))
