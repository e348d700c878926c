"""Operators over a whole cluster: routing, quorum writes, failover reads, inventories."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: A cluster's nodes are configuration; their names stand in the plan, so many at most.
MOST_NODES = 100_000


def _names(nodes: DataFrame, which: str) -> Column:
    rows = nodes.where(which).select("node", "ord").limit(MOST_NODES + 1).collect()  # literal rows need no job
    if len(rows) > MOST_NODES:
        raise ValueError("too many nodes for a plan")
    return F.array(*[F.lit(r.node) for r in sorted(rows, key=lambda r: (r.ord, r.node))]).cast("array<string>")


def _dead(nodes: DataFrame) -> Column:
    """Names of disabled nodes."""
    return _names(nodes, "disabled")


def route(placed: DataFrame, nodes: DataFrame, count: int) -> DataFrame:
    """(key, place, node, status): the owner and its followers."""
    n = F.least(F.greatest(F.lit(count), F.lit(1)), F.size("pref"))
    rows = placed.select("key", F.posexplode(F.slice("pref", F.lit(1), n)).alias("place", "node"))
    return rows.withColumn("status", F.when(F.array_contains(_dead(nodes), F.col("node")), "DEAD").otherwise("ALIVE"))


def first_alive(placed: DataFrame, nodes: DataFrame) -> DataFrame:
    """placed with serves, the first live node of the walk; null if all are dead."""
    dead = _dead(nodes)
    return placed.withColumn("serves", F.get(F.filter("pref", lambda n: ~F.array_contains(dead, n)), F.lit(0)))


def put_placement(placed: DataFrame, nodes: DataFrame, rf: int = 2) -> DataFrame:
    """placed with written, failed and handoff: dead planned nodes are replaced by the next live ones of the walk."""
    dead = _dead(nodes)
    n = F.least(F.lit(rf), F.size("pref"))
    planned = F.slice("pref", F.lit(1), n)
    written = F.slice(F.filter("pref", lambda x: ~F.array_contains(dead, x)), F.lit(1), n)
    return placed.select("*", written.alias("written"), F.array_intersect(planned, dead).alias("failed"), F.array_except(written, planned).alias("handoff"))


def coordinator(requested: Column, known: Column, owner: Column) -> Column:
    """The requested node if the cluster knows it, alive or not; else the key's owner."""
    return F.when(F.array_contains(known, requested), requested).otherwise(owner)


def failover_get(placed: DataFrame, holdings: DataFrame, nodes: DataFrame, requested: Column | None = None, repeats: bool = False) -> DataFrame:
    """(key, node, value, failover): the first live candidate that holds a value.

    Candidates are the requested node, the ring from the key's owner on, then the cluster's nodes in their
    order.  `failover` says that a node was requested (neither null nor empty) and another one answered.
    Give `repeats` if holdings may hold a (node, key) more than once; else it is a key of them.
    """
    dead = _dead(nodes)
    asked = F.nullif(requested if requested is not None else F.lit(None).cast("string"), F.lit(""))
    order = F.array_distinct(F.concat(F.array_compact(F.array(asked)), F.col("pref"), _names(nodes, "true")))
    live = F.filter(order, lambda n: ~F.array_contains(dead, n))
    # a key's holders are nodes, so the list is no longer than the cluster; of repeated rows the smallest value counts
    held = holdings.groupBy("key", "node").agg(F.min("value").alias("value")) if repeats else holdings
    held = held.groupBy("key").agg(F.collect_list(F.struct("node", "value")).alias("held"))
    found = placed.select("key", asked.alias("asked"), live.alias("live")).join(held, "key")
    found = found.withColumn("node", F.get(F.filter("live", lambda n: F.exists("held", lambda h: h["node"] == n)), F.lit(0))).where("node is not null")
    value = F.get(F.filter("held", lambda h: h["node"] == F.col("node")), F.lit(0))["value"]
    return found.select("key", "node", value.alias("value"), F.coalesce(F.col("node") != F.col("asked"), F.lit(False)).alias("failover"))


def newest_get(placed: DataFrame, holdings: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, node, value): of the live replicas' values (holdings with seq) the newest one."""
    live = holdings.where(~F.array_contains(_dead(nodes), F.col("node"))).join(placed.select("key"), "key", "left_semi")
    best = live.groupBy("key").agg(F.max_by(F.struct("node", "value"), F.struct("seq", "node")).alias("b"))
    return best.select("key", "b.node", "b.value")


def stamped(clocks: DataFrame, puts: DataFrame) -> DataFrame:
    """(key, vc): clocks after puts (key, coordinator): each put adds one to its coordinator's counter, keys without a clock begin one."""
    one = puts.select("key", F.col("coordinator").alias("server"), F.lit(1).cast("long").alias("n"))
    was = clocks.select("key", F.explode("vc").alias("server", "n"))
    sums = was.unionByName(one).groupBy("key", "server").agg(F.sum("n").alias("n"))
    return sums.groupBy("key").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("server", "n")))).alias("vc"))


def inventory(holdings: DataFrame, place: Callable[[DataFrame], DataFrame], rf: int = 2, clocks: DataFrame | None = None) -> DataFrame:
    """(key, owner, targets, holding, missing, in_sync) of every key that any node holds.  With clocks (key, vc), a row a
    key, their keys are there too and `vc` follows.

    `place` adds pref to a table with a key.  Holders and clocks are gathered in one pass, so rows are shuffled once.
    """
    rows = holdings.select("key", "node")
    every = [F.collect_set("node").alias("holders")]
    if clocks is not None:
        rows = rows.unionByName(clocks.select("key", "vc"), allowMissingColumns=True)
        every.append(F.first("vc", ignorenulls=True).alias("vc"))
    placed = place(rows.groupBy("key").agg(*every)).withColumn("targets", F.slice("pref", 1, rf))
    holding = F.filter("targets", lambda n: F.array_contains("holders", n))
    missing = F.filter("targets", lambda n: ~F.array_contains("holders", n))
    return placed.select(
        "key", F.col("pref")[0].alias("owner"), "targets", holding.alias("holding"), missing.alias("missing"), (F.size(missing) == 0).alias("in_sync"),
        *([] if clocks is None else ["vc"]),
    )


def state(nodes: DataFrame, holdings: DataFrame, log: DataFrame, gens: DataFrame | None = None, members: DataFrame | None = None) -> DataFrame:
    """(node, status, n_keys, n_log, n_gens, heartbeat, ring_nodes): gens are (node, gen, ...), heartbeat a node's own count of its beats."""
    out = nodes
    own = members.where(F.col("observer") == F.col("node")) if members is not None else None
    parts = [("n_keys", holdings, F.count("*")), ("n_log", log, F.count("*")), ("n_gens", gens, F.count_distinct("gen")), ("heartbeat", own, F.max("heartbeat"))]
    for name, df, agg in (p for p in parts if p[1] is not None):
        out = out.join(df.groupBy("node").agg(agg.alias(name)), "node", "left")
    total = nodes.agg(F.count("*").alias("ring_nodes"))
    counts = [F.coalesce(F.col(name), F.lit(0)).cast("long").alias(name) for name, df, _ in parts if df is not None]
    return out.join(F.broadcast(total), F.lit(True)).select("node", F.when(F.col("disabled"), "DEAD").otherwise("ALIVE").alias("status"), *counts, "ring_nodes")


def storage(node: str, holdings: DataFrame, log_lines: DataFrame, gens: DataFrame) -> DataFrame:
    """(part, key, text) of one node: its entries by key, its log lines by seq, its count of generations."""
    mine = lambda df: df.where(F.col("node") == node)
    entries = mine(holdings).select(F.lit("entry").alias("part"), "key", F.col("value").alias("text"))
    lines = mine(log_lines).select(F.lit("log").alias("part"), F.lpad(F.col("seq").cast("string"), 19, "0").alias("key"), F.col("line").alias("text"))
    runs = mine(gens).agg(F.count_distinct("gen").cast("string").alias("text")).select(F.lit("generations").alias("part"), F.lit("").alias("key"), "text")
    return entries.unionByName(lines).unionByName(runs).orderBy("part", "key")


def visible_by_node(log: DataFrame) -> DataFrame:
    """(node, key, value): what each node's own operations leave visible on it."""
    row = F.struct("op", "value")
    last = log.groupBy("node", "key").agg(F.max_by(row, "seq").alias("r"))
    return last.where("r.op <> 'DELETE'").select("node", "key", "r.value")


def delete_on(log: DataFrame, node: str, key: str, seq: int) -> DataFrame:
    """The log (seq, node, op, key, value) with one DELETE on one node; other nodes keep the key."""
    gone = log.sparkSession.range(1).select(F.lit(seq).cast("long").alias("seq"), F.lit(node).alias("node"), F.lit("DELETE").alias("op"), F.lit(key).alias("key"), F.lit("").alias("value"))
    return log.select("seq", "node", "op", "key", "value").unionByName(gone)


def flush_node(log: DataFrame, node: str, through: int, gen: int) -> DataFrame:
    """(gen, key, value, is_tombstone): the run that a node writes of its operations after `through`; none if there are none."""
    rest = log.where((F.col("node") == node) & (F.col("seq") > through))
    row = F.struct(F.when(F.col("op") == "DELETE", "").otherwise(F.col("value")).alias("value"), (F.col("op") == "DELETE").alias("is_tombstone"))
    return rest.groupBy("key").agg(F.max_by(row, "seq").alias("r")).select(F.lit(gen).alias("gen"), "key", "r.value", "r.is_tombstone")


def switched(nodes: DataFrame, events: DataFrame) -> DataFrame:
    """nodes after kill and revive events (seq, node, kill): the last event of a node rules; unknown nodes enter the set too, without an order."""
    last = events.groupBy("node").agg(F.max_by("kill", "seq").alias("kill"))
    return nodes.join(last, "node", "full").select("node", "ord", F.coalesce("kill", "disabled").alias("disabled"))


def without_node(node: str, **tables: DataFrame) -> dict[str, DataFrame]:
    """Every table (with a node, an observer or both) without that node's rows; nothing is copied elsewhere."""
    drop = lambda df: df.where(" and ".join(f"{c} <> '{node}'" for c in ("node", "observer") if c in df.columns))
    return {name: drop(df) for name, df in tables.items()}


def side_by_side(holdings: DataFrame, a: str, b: str) -> DataFrame:
    """(key, a_value, b_value) of two nodes' entries."""
    one = lambda n, c: F.max(F.when(F.col("node") == n, F.col("value"))).alias(c)
    return holdings.where(F.col("node").isin(a, b)).groupBy("key").agg(one(a, "a_value"), one(b, "b_value"))


def summary(state_: DataFrame) -> DataFrame:
    return state_.agg(F.count("*").alias("nodes"), F.count_if(F.col("status") == "ALIVE").alias("alive"), F.count_if(F.col("status") == "DEAD").alias("dead"), F.sum("n_keys").alias("n_keys"))


def chaos(nodes: DataFrame) -> DataFrame:
    """The node to switch: the last live one if several live, else the first dead one."""
    alive = F.count_if(~F.col("disabled"))
    last = F.max_by("node", F.when(~F.col("disabled"), F.col("ord")))
    first = F.min_by("node", F.when(F.col("disabled"), F.col("ord")))
    return nodes.agg(F.when(alive > 1, last).otherwise(first).alias("node"), (alive > 1).alias("disable"))


def log_tail(log: DataFrame, n: int = 6) -> DataFrame:
    return log.orderBy(F.desc("seq")).limit(n)
