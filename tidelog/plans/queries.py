"""The queries of the engine's own operators; oracle.py has their SQL, formulated another way."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clock as C
from ..functions import scalars as S
from ..operators import cluster as D
from ..operators import log as L
from ..operators import membership as G
from ..operators import merkle as T
from ..operators import ring as R
from ..sources import codec as B
from . import lenses as X

BUCKETS = 1024
HOURS2 = 2 * 3600 * 1000


def _users(spark, d):
    return C.collect(spark.read.parquet(f"{d}/events.parquet"), "user_id", "event_type")


def _pairs(spark, d):
    a = _users(spark, d).select(F.col("key").alias("ka"), F.col("vc").alias("a"))
    b = _users(spark, d).select(F.col("key").alias("kb"), F.col("vc").alias("b"))
    return a.join(b, F.col("kb") == F.col("ka") + 1)


def _gens(spark, d):
    return L.generations(X.oplog(spark, d), 1000)


def _names(spark, *names):
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{n}')" for n in names) + " AS t(node)")


def _text(c):
    return F.array_join(c, ",")


def _orders(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet")


def _json(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", F.to_json(F.struct(F.col("event_type").alias("kind"), F.col("user_id").alias("user"))).alias("body"))


def _run_rows(rows):
    return rows.select(F.col("path").cast("int").alias("gen"), F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "is_tombstone")


def _cleared(s, d):
    o = X.oplog(s, d)
    return L.since_clear(o.withColumn("op", F.when(F.col("seq") % 700 == 699, "CLEAR").otherwise(F.col("op"))))


def _state(s, d):
    gens = X.oplog(s, d).select("node", F.floor(F.col("seq") / 1000).alias("gen"))
    return D.state(X.nodes(s), X.holdings(s, d), X.oplog(s, d), gens, G.merge(X.members(s, d)))


def f1_ring_hash(s, d):
    return X.keys(s, d).select("key", S.h32("key").alias("h"))


def f2_bucket(s, d):
    return X.keys(s, d).select("key", S.bucket_of("key", BUCKETS).alias("bucket"))


def f3_fnv1a(s, d):
    return X.keys(s, d).select("key", S.fnv1a_32("key").alias("h"))


def f4_palette(s, d):
    return X.keys(s, d).select("key", (S.fnv1a_32("key") % 6).cast("int").alias("colour"))


def f5_ring_angle(s, d):
    p = S.on_circle(S.h32("key"))
    return X.keys(s, d).select("key", F.round(p["x"], 6).alias("x"), F.round(p["y"], 6).alias("y"))


def f6_json_object(s, d):
    return _json(s, d).select("event_id", "body")


def f7_json_string(s, d):
    return _json(s, d).select("event_id", S.json_string("body", "kind").alias("kind"), S.json_string("body", "none").alias("none"))


def f8_json_int(s, d):
    return _json(s, d).select("event_id", S.json_int("body", "user", -1).alias("user_id"), S.json_int("body", "kind", 7).alias("kind"))


def f9_url_decode(s, d):
    odd = F.concat(F.replace("key", F.lit(":"), F.lit("+%3A")), F.lit("%zz%c3%A9%4"))
    return X.keys(s, d).select("key", S.url_decode(F.replace("key", F.lit(":"), F.lit("%3A"))).alias("decoded"), S.url_decode(F.concat("key", F.lit("%zz"))).alias("kept"), S.url_decode(odd).alias("mixed"))


def f10_query_parameter(s, d):
    url = F.concat(F.lit("/api/get?key="), F.replace("key", F.lit(":"), F.lit("%3A")), F.lit("&node_id=a+b"))
    bad = F.concat(F.lit("http://x y/?key=a b%zz"), F.col("key"))
    return X.keys(s, d).select("key", S.query_parameter(url, "key").alias("k"), S.query_parameter(url, "node_id").alias("node_id"), S.query_parameter(bad, "key").alias("odd"), S.query_parameter(bad, "node_id").alias("none"))


def f11_clock_text(s, d):
    return _users(s, d).select("key", C.text(F.col("vc")).alias("clock"))


def f12_vnode_name(s, d):
    return X.nodes(s).select(F.explode(F.sequence(F.lit(0), F.lit(49))).alias("i"), "node").select(S.vnode_name("node", F.col("i")).alias("name"))


def f13_leaf_text(s, d):
    return X.replica_a(s, d).select("key", S.leaf_text("key", "value").alias("leaf"))


def f14_now_ms(s, d):
    return X.oplog(s, d).select("seq", F.unix_millis("ts").alias("ms"), (F.unix_millis(F.current_timestamp()) > F.unix_millis("ts")).alias("past"))


def f17_log_line(s, d):
    o = X.oplog(s, d)
    return o.select("seq", S.log_line(F.col("op"), F.col("key"), F.col("value"), F.col("seq") % 5 == 0).alias("line"))


def f18_percent(s, d):
    return X.oplog(s, d).groupBy("key").agg(F.count("*").alias("n")).select("key", S.percent(F.col("n"), 100).alias("percent"))


def s3_log_replay(s, d):
    return X.oplog(s, d).select("seq", "node", "op", "key", "value")


def s5_entry_count(s, d):
    return X.oplog(s, d).where("seq > 999").agg(F.count("*").alias("entries"))


def s15_seed(s, d):
    rows = "('user:alice','Alice Smith (ID: 101)'),('user:bob','Bob Jones (ID: 102)'),('order:9901','MacBook Pro M3 + USB-C Hub'),('session:prod_xyz','authenticated_session_token_99')"
    k = s.sql(f"SELECT * FROM VALUES {rows} AS t(key, value)")
    p = R.place(k, R.arcs(R.ring(_names(s, *X.NODE_NAMES), 50)))
    return p.select("key", "value", _text(R.replicas(F.col("pref"), 2)).alias("replicas"))


def k1_inserted_flag(s, d):
    return L.flagged(X.oplog(s, d)).select("seq", "key", "inserted")


def k2_point_read(s, d):
    return L.visible(X.oplog(s, d).where("key = 'user:7'"))


def k3_delete_existed(s, d):
    return L.flagged(X.oplog(s, d)).where("op = 'DELETE'").select("seq", "key", "existed")


def k4_size(s, d):
    return L.visible(X.oplog(s, d)).agg(F.count("*").alias("n"))


def k5_empty(s, d):
    return L.visible(X.oplog(s, d)).agg((F.count("*") == 0).alias("empty"))


def k6_clear(s, d):
    return L.visible(_cleared(s, d))


def k7_contains(s, d):
    return L.contains(L.visible(X.oplog(s, d)), s.range(200).select(F.concat(F.lit("user:"), "id").alias("key")))


def m1_memtable(s, d):
    return L.fold(X.oplog(s, d)).select("key", "value", "is_tombstone", "seq")


def m4_should_flush(s, d):
    return L.should_flush(L.fold(X.oplog(s, d)), 1024, 48)


def m5_sorted_dump(s, d):
    return L.fold(X.oplog(s, d)).select("key", "is_tombstone").orderBy("key")


def m7_rows(s, d):
    return L.fold(X.oplog(s, d)).agg(F.count("*").alias("n"), F.count_if("is_tombstone").alias("tombstones"), (F.count("*") == 0).alias("empty"))


def m8_bytes(s, d):
    return L.size_bytes(L.fold(X.oplog(s, d)), 48)


def m10_contains(s, d):
    return L.contains(L.fold(X.oplog(s, d)), s.range(200).select(F.concat(F.lit("user:"), "id").alias("key")))


def l1_point_get(s, d):
    return _run_rows(B.run_get(X.runs(s, d), "user:7"))


def l2_range_scan(s, d):
    return L.scan(_gens(s, d), "user:1", "user:5").orderBy("key")


def l4_visible_state(s, d):
    return L.visible_rows(_gens(s, d))


def l5_effective_delete(s, d):
    return L.effective_log(X.oplog(s, d)).select("seq", "op", "key")


def l6_flush(s, d):
    return _gens(s, d).groupBy("gen").agg(F.count("*").alias("rows"), F.count_if("is_tombstone").alias("tombstones"))


def l7_recover(s, d):
    o = X.oplog(s, d)
    gens = L.generations(o.where("seq < 5000"), 1000).unionByName(L.fold(o.where("seq >= 5000")).select(F.lit(1 << 20).alias("gen"), "key", "value", "is_tombstone"))
    return L.visible_rows(gens)


def l9_generations(s, d):
    return _gens(s, d).select("gen").distinct().orderBy(F.desc("gen"))


def l10_compact(s, d):
    return L.compact(_gens(s, d), 4)


def r1_ring(s, d):
    return R.ring(X.nodes(s), 50)


def r2_removal(s, d):
    return R.ring(R.without(X.nodes(s), "node-beta"), 50)


def r3_owner(s, d):
    return X.placed(s, d).select("key", F.col("pref")[0].alias("owner"))


def r4_replica_nodes(s, d):
    return X.placed(s, d).select("key", _text(R.replicas(F.col("pref"), 3)).alias("replicas"))


def r5_node_count(s, d):
    return R.ring(X.nodes(s), 50).agg(F.count_distinct("node").alias("nodes"), (F.count("*") == 0).alias("empty"), (F.count_if(F.col("node") == "node-beta") > 0).alias("has_beta"))


def r8_balance(s, d):
    return R.balance(X.placed(s, d))


def r9_movement(s, d):
    three = X.placed(s, d, _names(s, *X.NODE_NAMES))
    four = X.placed(s, d, _names(s, *X.NODE_NAMES, "node-delta"))
    return R.movement(three, four).groupBy("was", "now").agg(F.count("*").alias("n"), F.count_if("moved").alias("moved"))


def r10_client_ring(s, d):
    return R.ring(X.nodes(s), 40).join(X.nodes(s).select("node", (~F.col("disabled")).alias("alive")), "node").select("pos", "node", "alive")


def c1_increment(s, d):
    return _users(s, d).select("key", C.text(C.increment(F.col("vc"), F.lit("view"))).alias("clock"))


def c2_merge(s, d):
    return _pairs(s, d).select("ka", C.text(C.merge(F.col("a"), F.col("b"))).alias("clock"))


def c3_clock_compare(s, d):
    return _pairs(s, d).select("ka", C.compare(F.col("a"), F.col("b")).alias("verdict"))


def c4_descends(s, d):
    return _pairs(s, d).select("ka", C.descends(C.merge(F.col("a"), F.col("b")), F.col("b")).alias("up"), C.descends(F.col("a"), F.col("b")).alias("descends"))


def c5_counter(s, d):
    return _users(s, d).select("key", C.counter(F.col("vc"), "view").alias("view"), C.counter(F.col("vc"), "none").alias("none"))


def c6_size(s, d):
    return _users(s, d).select("key", F.size("vc").alias("n"), (F.size("vc") == 0).alias("empty"))


def c8_prune(s, d):
    return _users(s, d).select("key", C.text(C.prune(F.col("vc"), 3)).alias("clock"))


def c9_clocks(s, d):
    return _users(s, d).select("key", F.explode("vc").alias("server", "n"))


def c10_compare_three(s, d):
    one = lambda k: F.create_map(F.lit("Sx"), F.col(k) % 4, F.lit("Sy"), F.col(k) % 3, F.lit("Sz"), F.col(k) % 2)
    rows = _orders(s, d).select("o_orderkey", "o_custkey")
    return rows.select("o_orderkey", C.compare(one("o_orderkey"), one("o_custkey")).alias("verdict"))


def c11_merge_increment(s, d):
    return _pairs(s, d).select("ka", C.text(C.increment(C.merge(F.col("a"), F.col("b")), F.lit("click"))).alias("clock"))


def c13_decrement(s, d):
    return _users(s, d).select("key", F.greatest(F.lit(0), C.counter(F.col("vc"), "error") - 20).alias("n"))


def c14_merge_all(s, d):
    v = _users(s, d).select((F.col("key") % 10).alias("key"), "vc")
    return C.merge_all(v).select("key", C.text(F.col("vc")).alias("clock"))


def c15_siblings(s, d):
    v = _users(s, d).select((F.col("key") % 10).alias("key"), F.col("key").alias("version"), "vc")
    return C.siblings(v).select("key", "version")


def _leaf(s, d, side):
    return T.leaves(X.replica_a(s, d) if side == "a" else X.replica_b(s, d), BUCKETS)


def t1_merkle_leaves(s, d):
    return _leaf(s, d, "a")


def t2_merkle_tree(s, d):
    return T.tree(T.leaves(X.replica_a(s, d), 8), 8)


def t3_root(s, d):
    return T.root(s, T.leaves(X.replica_a(s, d), 2), 2)


def t4_bucket_hash(s, d):
    return _leaf(s, d, "a").where("idx = 17").select("hash")


def t5_diff(s, d):
    a, b = T.leaves(X.replica_a(s, d), 16), T.leaves(X.replica_b(s, d), 16)
    return T.diff_by_levels(T.tree(a, 16), T.tree(b, 16), 16)


def t6_merkle_diff(s, d):
    return T.diff(_leaf(s, d, "a"), _leaf(s, d, "b"))


def t9_key_diff(s, d):
    return T.key_diff(X.replica_a(s, d), X.replica_b(s, d))


def t10_repair(s, d):
    return T.repair(X.replica_a(s, d), X.replica_b(s, d))


def t11_equal_roots(s, d):
    def same(name, x, y):
        a, b = (T.root(s, T.leaves(r, 4), 4) for r in (x, y))
        return a.join(F.broadcast(b.withColumnRenamed("hash", "other")), F.lit(True)).select(F.lit(name).alias("pair"), (F.col("hash") == F.col("other")).alias("in_sync"))

    a, b = X.replica_a(s, d), X.replica_b(s, d)
    return same("a-b", a, b).union(same("a-a", a, a.repartition(3)))


def _members(s, d):
    return G.merge(X.heartbeats(s, d))


def g3_heartbeat_merge(s, d):
    return _members(s, d).select("observer", "node", "heartbeat", F.unix_micros("last_seen").alias("seen_us"))


def _last(s, d):
    e = s.read.parquet(f"{d}/events.parquet").select(F.col("user_id").cast("string").alias("node"), F.col("ts").cast("timestamp").alias("ts"))
    seen = e.groupBy("node").agg(F.max("ts").alias("last_seen"))
    return seen.join(F.broadcast(e.agg(F.max("ts").alias("as_of"))), F.lit(True))


def g5_failed_nodes(s, d):
    return _last(s, d).where(G.overdue(F.col("last_seen"), F.col("as_of"), HOURS2)).select("node")


def g6_status(s, d):
    asked = s.range(200).select(F.col("id").cast("string").alias("node"))
    return asked.join(_last(s, d), "node", "left").select("node", G.status(F.col("last_seen"), F.col("as_of"), HOURS2).alias("status"))


def g7_add_member(s, d):
    m = _members(s, d)
    new = s.range(3).select(F.col("id").cast("string").alias("observer"), F.lit("new").alias("node"), F.lit(None).cast("timestamp").alias("last_seen"))
    return G.add(m, new).groupBy("observer").agg(F.count("*").alias("members"))


def g8_remove_member(s, d):
    return G.remove(_members(s, d), "1").select("observer", "node")


def g9_member_count(s, d):
    return _members(s, d).groupBy("observer").agg(F.count("*").alias("members"))


def g10_gossip_round(s, d):
    n = s.sql("SELECT * FROM VALUES ('0', false), ('1', true), ('2', false) AS t(node, disabled)")
    out = G.round_(_members(s, d), n, F.lit("2030-01-01").cast("timestamp"))
    return out.select("observer", "node", "heartbeat", (F.col("last_seen") == F.lit("2030-01-01").cast("timestamp")).alias("refreshed"))


def g12_view(s, d):
    as_of = s.read.parquet(f"{d}/events.parquet").agg(F.max("ts").cast("timestamp").alias("as_of"))
    m = G.merge(X.members(s, d)).join(F.broadcast(as_of), F.lit(True))
    return G.view(m, "node-gamma", X.nodes(s), F.col("as_of"), 600_000)


def g13_kill_revive(s, d):
    return D.switched(X.nodes(s), X.switches(s, d)).select("node", "disabled")


def d1_add_node(s, d):
    return R.ring(X.nodes(s).select("node").union(_names(s, "node-new", "node-alpha")), 50).groupBy("node").agg(F.count("*").alias("positions"))


def d2_remove_node(s, d):
    left = D.without_node("node-alpha", holdings=X.holdings(s, d), log=X.oplog(s, d), members=G.merge(X.members(s, d)), ring=R.ring(X.nodes(s), 50))
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n") for name, df in left.items()]
    return counts[0].union(counts[1]).union(counts[2]).union(counts[3])


def d3_route(s, d):
    return D.route(X.placed(s, d), X.nodes(s), 2)


def d4_put_placement(s, d):
    p = D.put_placement(X.placed(s, d), X.nodes(s))
    after = D.stamped(X.clocks(s, d), p.select("key", F.col("pref")[0].alias("coordinator")))
    p = p.join(after, "key")
    return p.select("key", _text("written").alias("written"), _text("failed").alias("failed"), _text("handoff").alias("handoff"), C.text(F.col("vc")).alias("clock"))


def d5_coordinator(s, d):
    asked = F.when(F.col("o_orderkey") % 3 == 0, "node-beta").when(F.col("o_orderkey") % 3 == 1, "node-none")
    return X.placed(s, d).select("key", D.coordinator(asked, F.col("pref"), F.col("pref")[0]).alias("coordinator"))


def d6_failover_get(s, d):
    k = F.col("o_orderkey")
    asked = F.when(k % 5 == 0, "node-beta").when(k % 5 == 1, "node-gamma").when(k % 5 == 2, "node-none").when(k % 5 == 3, "")
    return D.failover_get(X.placed(s, d), X.holdings(s, d), X.nodes(s), asked)


def d7_delete_key(s, d):
    return D.visible_by_node(D.delete_on(X.oplog(s, d), "node-alpha", "user:7", 1 << 40)).where("key in ('user:7', 'user:8')")


def d10_cluster_state(s, d):
    return _state(s, d)


def d11_node_storage(s, d):
    o = X.oplog(s, d)
    lines = o.select("node", "seq", S.log_line(F.col("op"), F.col("key"), F.col("value")).alias("line"))
    return D.storage("node-alpha", X.holdings(s, d), lines, o.select("node", F.floor(F.col("seq") / 1000).alias("gen")))


def d12_key_inventory(s, d):
    r = D.inventory(X.holdings(s, d), lambda keys: R.place(keys, R.arcs(R.ring(X.nodes(s), 50))), clocks=X.clocks(s, d))
    return r.select("key", "owner", _text("targets").alias("targets"), _text("holding").alias("holding"), _text("missing").alias("missing"), "in_sync", F.coalesce(C.text(F.col("vc")), F.lit("[]")).alias("clock"))


def d13_summary(s, d):
    return D.summary(_state(s, d))


def d15_chaos(s, d):
    return D.chaos(D.switched(X.nodes(s), X.switches(s, d)))


def d16_log_tail(s, d):
    return D.log_tail(X.oplog(s, d).where("node = 'node-alpha'")).select("seq", "key")


def d17_first_alive(s, d):
    return D.first_alive(X.placed(s, d), X.nodes(s)).select("key", "serves")


def d18_ownership(s, d):
    return R.ownership(R.arcs(R.ring(X.nodes(s), 50)))


def d21_node_name(s, d):
    return s.read.parquet(f"{d}/nation.parquet").select(S.node_name(F.concat(F.lit("  "), "n_name", F.lit(" "))).alias("name"))


def f15_monotonic_ms(s, d):
    o = X.oplog(s, d)
    first = F.broadcast(o.agg(F.min("ts").alias("first")))
    return o.join(first, F.lit(True)).select("seq", S.monotonic_ms(F.col("ts"), F.col("first")).alias("ms"))


def f16_verdict_text(s, d):
    return X.keys(s, d).select("key", S.verdict_text((F.col("o_orderkey") % 4).cast("int")).alias("verdict"))


def s4_log_truncate(s, d):
    return _cleared(s, d).select("seq", "op", "key")


def s7_run_write(s, d):
    size = X.runs(s, d).select("path", F.octet_length("content").alias("bytes"), F.hex(F.substring("content", -8, 8)).alias("f"))
    rows = F.conv(F.concat(*[F.substring("f", 15 - 2 * i, 2) for i in range(8)]), 16, 10).cast("long")
    return size.select(F.col("path").cast("int").alias("gen"), F.col("bytes").cast("long").alias("bytes"), rows.alias("rows"))


def s8_run_index(s, d):
    return B.run_index(X.runs(s, d)).select(F.col("path").cast("int").alias("gen"), F.col("key").cast("string").alias("key"), "offset")


def s10_run_full_scan(s, d):
    return _run_rows(B.run_scan(X.runs(s, d)))


def l1_run_range(s, d):
    return _run_rows(B.run_scan(X.runs(s, d), "user:1", "user:5"))


def m2_point_read(s, d):
    return L.fold(X.oplog(s, d).where("key in ('user:7', 'user:8', 'user:9', 'user:none')")).select("key", "value", "is_tombstone")


def m3_tombstones(s, d):
    return L.fold(X.oplog(s, d).where("op = 'DELETE'")).select("key", "value", "is_tombstone", "seq")


def m6_clear(s, d):
    return L.fold(_cleared(s, d)).select("key", "value", "is_tombstone")


def l3_engine_put(s, d):
    return L.put_batches(X.oplog(s, d), 100, 6000, 48)


def c12_key_clock(s, d):
    return d12_key_inventory(s, d).where("key in ('order:2', 'order:4', 'ghost:50', 'order:3')").select("key", "clock", "owner", "targets")


def t7_bucket_count(s, d):
    none = X.replica_a(s, d).where("key = ''")
    full = T.built(T.leaves(X.replica_a(s, d), 16)).withColumn("side", F.lit("a"))
    return full.unionByName(T.built(T.leaves(none, 8)).withColumn("side", F.lit("none")))


def t9_node_diff(s, d):
    return T.node_diff(X.holdings(s, d), X.nodes(s), 8)


def g1_self_registration(s, d):
    return G.joined(X.nodes(s), F.lit("2030-01-01").cast("timestamp")).select("observer", "node", "heartbeat", (F.col("last_seen") == F.lit("2030-01-01").cast("timestamp")).alias("now"))


def g2_own_heartbeat(s, d):
    now = F.lit("2030-01-01").cast("timestamp")
    out = G.beat(G.merge(X.members(s, d)), F.col("node") != "node-beta", now)
    return out.select("observer", "node", "heartbeat", (F.col("last_seen") == now).alias("refreshed"))


def g4_snapshot(s, d):
    return G.merge(X.members(s, d)).where("observer = 'node-alpha'").select("node", "heartbeat", F.unix_micros("last_seen").alias("seen_us"))


def g11_rounds(s, d):
    n = s.sql("SELECT * FROM VALUES ('0', false), ('1', true), ('2', false) AS t(node, disabled)")
    times = [F.lit(t).cast("timestamp") for t in ("2030-01-01 00:00:00", "2030-01-01 00:00:01")]
    return G.rounds(_members(s, d), n, times).select("observer", "node", "heartbeat")


def g14_revive(s, d):
    """Revived nodes, those whose last switch was no kill, beat once."""
    now = D.switched(X.nodes(s), X.switches(s, d)).where("not disabled").select(F.col("node").alias("live"))
    m = G.merge(X.members(s, d)).join(F.broadcast(now), F.col("node") == F.col("live"), "left")
    return G.beat(m, F.col("live").isNotNull(), F.lit("2030-01-01").cast("timestamp")).select("observer", "node", "heartbeat")


def d1_introduction(s, d):
    out = G.introduced(G.merge(X.members(s, d)), "node-new", F.lit("2030-01-01").cast("timestamp"))
    return G.introduced(out, "node-alpha", F.lit("2030-01-01").cast("timestamp")).select("observer", "node", "heartbeat")


def d6_newest_get(s, d):
    o = X.oplog(s, d).where("op = 'PUT'")
    return D.newest_get(o.select("key").distinct(), o.select("node", "key", "value", "seq"), X.nodes(s))


def d8_flush_node(s, d):
    return D.flush_node(X.oplog(s, d), "node-alpha", 499, 1)


def d9_recover_node(s, d):
    return D.visible_by_node(X.oplog(s, d).where("node = 'node-beta'"))


def d19_side_by_side(s, d):
    return D.side_by_side(X.holdings(s, d), "node-alpha", "node-gamma")


QUERIES = {k: v for k, v in list(globals().items()) if k[0] in "fskmlrctgd" and k[1:2].isdigit() and callable(v)}
