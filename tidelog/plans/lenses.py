"""The data platform's tables seen as keyed state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ring as R

#: The cluster's node names.
NODE_NAMES = ["node-alpha", "node-beta", "node-gamma"]


def oplog(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    node = F.when(F.col("event_id") % 3 == 0, NODE_NAMES[0]).when(F.col("event_id") % 3 == 1, NODE_NAMES[1]).otherwise(NODE_NAMES[2])
    dead = F.col("event_type") == "error"
    return e.select(
        F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), node.alias("node"), F.when(dead, "DELETE").otherwise("PUT").alias("op"),
        F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"), F.when(dead, "").otherwise(F.col("props")).alias("value"),
    )


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("key"), "o_orderkey", F.col("o_orderstatus").alias("value"))


def replica_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys(spark, sf_dir).select("key", "value")


def replica_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return keys(spark, sf_dir).where(k % 97 != 0).select("key", F.when(k % 89 == 0, "MUT").otherwise(F.col("value")).alias("value"))


def nodes(spark: SparkSession) -> DataFrame:
    rows = "VALUES ('node-alpha', 0, false), ('node-beta', 1, true), ('node-gamma', 2, false), ('node-delta', 3, false)"
    return spark.sql(f"SELECT * FROM {rows} AS t(node, ord, disabled)")


def placed(spark: SparkSession, sf_dir: str, names: DataFrame | None = None, vnodes: int = 50) -> DataFrame:
    return R.place(keys(spark, sf_dir), R.arcs(R.ring(nodes(spark) if names is None else names, vnodes)))


def holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two replicas of each key, less node-gamma's copies where o_orderkey % 11 = 0."""
    rows = placed(spark, sf_dir).select("key", "value", "o_orderkey", F.explode(F.slice("pref", 1, 2)).alias("node"))
    return rows.where((F.col("node") != "node-gamma") | (F.col("o_orderkey") % 11 != 0)).select("node", "key", "value")


def heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        (F.col("event_id") % 3).cast("string").alias("observer"), F.col("user_id").cast("string").alias("node"), (F.col("event_id") % 7).alias("heartbeat"), F.col("ts").alias("seen")
    )


def named(n) -> F.Column:
    """A node name for a number."""
    return F.element_at(F.array(*map(F.lit, NODE_NAMES)), (n % 3 + 1).cast("int"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sighting of a node by a node: (observer, node, heartbeat, seen)."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(named(F.col("event_id")).alias("observer"), named(F.col("user_id")).alias("node"), (F.col("event_id") % 70).alias("heartbeat"), F.col("ts").alias("seen"))


def clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clocks of every second order, and of some keys that no node holds."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    vc = F.create_map(named(F.col("o_custkey")), F.col("o_custkey") % 5 + 1).alias("vc")
    key = lambda kind: F.concat(F.lit(kind), F.col("o_orderkey").cast("string")).alias("key")
    return o.where("o_orderkey % 2 = 0").select(key("order:"), vc).union(o.where("o_orderkey % 50 = 0").select(key("ghost:"), vc))


def switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kills and revivals: (seq, node, kill)."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    node = F.element_at(F.array(*map(F.lit, [*NODE_NAMES, "node-lost"])), (F.col("user_id") % 4 + 1).cast("int"))
    return e.where("event_type in ('error', 'click')").select(F.col("event_id").alias("seq"), node.alias("node"), (F.col("event_type") == "error").alias("kill"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import log as L
    from ..sources import codec

    return codec.run_bytes(L.generations(oplog(spark, sf_dir), 1000))
