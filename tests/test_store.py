"""The store, the binary formats, the fold's rules, and streams."""

import time
from datetime import datetime

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog.functions import clock as C
from tidelog.operators import cluster as D
from tidelog.operators import log as L
from tidelog.operators import membership as G
from tidelog.operators import merkle as T
from tidelog.operators import ring as R
from tidelog.schemas import NODES, OPLOG
from tidelog.sources import codec
from tidelog.sources.store import Store

T0 = datetime(2024, 1, 1)


def log(spark, *ops):
    return spark.createDataFrame([(i, T0, "n", op, k, v) for i, (op, k, v) in ops], OPLOG)


def table(df):
    return {r.key: r.value for r in df.collect()}


def test_flush_then_reopen_keeps_data(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    assert s.flush() is None and s.entry_count() == 0
    s.append(log(spark, (0, ("PUT", "a", "1")), (1, ("PUT", "b", "old")), (2, ("PUT", "e", ""))))
    assert s.flush() == 0
    s.append(log(spark, (3, ("PUT", "b", "new")), (4, ("DELETE", "a", ""))))
    again = Store(spark, str(tmp_path))
    assert again.entry_count() == 2
    assert table(again.table()) == {"b": "new", "e": ""}
    assert again.flush() == 1 and table(again.table()) == {"b": "new", "e": ""}
    assert table(again.get("b")) == {"b": "new"} and table(again.get("a")) == {}
    assert set(table(again.scan("b", "e"))) == {"b", "e"} and table(again.scan("z", "b")) == {}
    assert table(L.visible_rows(L.compact(again.generations(), 1))) == {"b": "new", "e": ""}


def test_insert_and_delete_flags(spark):
    f = L.flagged(log(spark, (0, ("PUT", "k", "1")), (1, ("PUT", "k", "2")), (2, ("DELETE", "k", "")), (3, ("DELETE", "k", "")), (4, ("PUT", "k", "3"))))
    got = [(r.inserted, r.effective) for r in f.orderBy("seq").collect()]
    assert got == [(True, False), (False, False), (False, True), (False, False), (True, False)]


def test_flags_across_slices(spark):
    import random

    rng, ops = random.Random(3), []
    for seq in range(400):
        ops.append((seq, (rng.choice(["PUT", "DELETE"]), "hot" if rng.random() < 0.5 else f"k{rng.randrange(60)}", "v")))
    state, want = set(), []
    for seq, (op, key, _) in ops:
        was = key in state
        want.append((seq, was, op == "PUT" and not was, op == "DELETE" and was))
        (state.add if op == "PUT" else state.discard)(key)
    for size in (1, 7, 64, 1 << 22):
        got = L.flagged(log(spark, *ops), size).select("seq", "existed", "inserted", "effective").orderBy("seq").collect()
        assert [tuple(r) for r in got] == want


def test_siblings_against_every_pair(spark):
    import random

    from tidelog.functions import clock as C

    rng = random.Random(5)
    rows = [(rng.choice("ab"), i, {s: rng.randrange(1, 5) for s in "xyz" if rng.random() < 0.8}) for i in range(80)]
    rows += [("chain", 100 + i, {"x": i}) for i in range(30)] + [("same", 200 + i, {"x": 1}) for i in range(3)] + [("none", 300, {}), ("null", 400, None), (None, 500, {"x": 1})]
    before = lambda p, q: p != q and all(n <= q.get(s, 0) for s, n in p.items()) and any(n > p.get(s, 0) for s, n in q.items())
    known = [r for r in rows if r[0] is not None and r[2] is not None]
    want = {v for k, v, c in rows if k is None or c is None or not any(k == k2 and before(c, c2) for k2, _, c2 in known)}
    got = C.siblings(spark.createDataFrame(rows, "key string, version long, vc map<string,bigint>")).collect()
    assert len(got) == len(want) and {r.version for r in got} == want


pairs = st.lists(st.tuples(st.integers(0, 2**40), st.sampled_from([0, 1]), st.binary(max_size=20), st.binary(max_size=20)), max_size=8)


@given(pairs, st.integers(0, 12))
def test_log_codec_drops_a_torn_tail(records, cut):
    data = b"".join(codec.log_record(*r) for r in records)
    assert list(codec.read_log(data)) == records
    if records and cut:
        assert list(codec.read_log(data[:-cut])) == records[:-1] or cut > len(codec.log_record(*records[-1]))


@given(st.dictionaries(st.binary(max_size=8), st.tuples(st.binary(max_size=8), st.booleans()), max_size=12))
def test_run_codec(rows):
    listed = [(k, *v) for k, v in sorted(rows.items())]
    run = codec.Run(codec.write_run(listed))
    assert run.rows() == listed
    assert all(run.get(r[0]) == r for r in listed) and run.get(b"none-such-key") is None
    assert run.scan(b"a", b"m") == [r for r in listed if b"a" <= r[0] <= b"m"]
    assert codec.Run(b"").rows() == []


def test_binary_files_read(spark, tmp_path):
    rows = log(spark, (0, ("PUT", "key", "välue")), (1, ("DELETE", "key", "")))
    made = b"".join(bytes(r.record) for r in codec.log_bytes(rows).orderBy("seq").collect())
    (tmp_path / "wal.log").write_bytes(made + b"torn")
    got = codec.log_files(spark, str(tmp_path / "wal.log")).orderBy("seq").collect()
    assert [(r.kind, bytes(r.key), bytes(r.value).decode()) for r in got] == [(0, b"key", "välue"), (1, b"key", "")]
    (tmp_path / "sst_0.sst").write_bytes(codec.write_run([(b"a", b"1", False), (b"b", b"", True)]))
    assert [r.is_tombstone for r in codec.run_files(spark, str(tmp_path / "sst_0.sst")).orderBy("seq").collect()] == [False, True]


def names(spark, *n):
    return spark.createDataFrame([(x, i, False) for i, x in enumerate(n)], NODES)


def test_ring_rules(spark):
    keys = spark.range(3000).select(F.concat(F.lit("key-"), "id").alias("key"))
    three, four = R.arcs(R.ring(names(spark, "n1", "n2", "n3", "n3"), 100)), R.arcs(R.ring(names(spark, "n1", "n2", "n3", "n4"), 100))
    placed = R.place(keys, three)
    assert all(500 < r.n_keys < 1500 for r in R.balance(placed).collect())
    moved = R.movement(placed, R.place(keys, four)).where("moved").groupBy("now").count().collect()
    assert [r.now for r in moved] == ["n4"] and moved[0]["count"] < 1200
    with pytest.raises(Exception, match="more replicas than nodes"):
        placed.select(R.replicas(F.col("pref"), 5)).collect()
    with pytest.raises(Exception, match="the ring is empty"):
        R.place(keys, R.arcs(R.ring(names(spark, "n1").where("false"), 10))).collect()
    assert sum(r.positions for r in R.ownership(three).collect()) == 1 << 32


def test_ring_of_one_task_and_of_many_agree(spark, monkeypatch):
    made = lambda: sorted(map(tuple, R.arcs(R.ring(names(spark, "n1", "n2", "n3", "n4"), 30)).collect()))
    one = made()
    monkeypatch.setattr(R, "ONE_TASK", 0)
    assert made() == one and len(one) == 121 and min(one)[0] == -1 and max(one)[1] == R.RING_SIZE
    ends = sorted((hi, lo) for lo, hi, _ in one)
    assert all(lo == before for (_, lo), (before, _) in zip(ends[1:], ends)) and all(len(set(p)) == 4 for *_, p in one)
    single = R.arcs(R.ring(names(spark, "n1"), 1)).collect()
    assert len(single) == 2 and all(r.pref == ["n1"] for r in single)


def test_keys_without_hash_are_not_placed(spark):
    keys = spark.createDataFrame([(None,), ("",), ("k",)], "key string")
    assert {r.key for r in R.place(keys, R.arcs(R.ring(names(spark, "n1", "n2"), 10))).collect()} == {"", "k"}


def test_all_nodes_dead(spark):
    n = names(spark, "a", "b").withColumn("disabled", F.lit(True))
    p = R.place(spark.createDataFrame([("k",)], "key string"), R.arcs(R.ring(n, 10)))
    r = D.put_placement(p, n).first()
    assert r.written == [] and len(r.failed) == 2 and r.handoff == []
    assert D.first_alive(p, n).first().serves is None
    held = spark.createDataFrame([("a", "k", "v")], "node string, key string, value string")
    assert D.failover_get(p, held, n).collect() == []


def test_inventory_of_holders_and_clocks(spark):
    held = spark.createDataFrame([("a", "k", "v"), ("a", "k", "w"), ("b", "other", "x"), ("lost", "k", "v")], "node string, key string, value string")
    clocks = spark.createDataFrame([("k", {"a": 2}), ("ghost", {"b": 1})], "key string, vc map<string,bigint>")
    arcs = R.arcs(R.ring(names(spark, "a", "b"), 10))
    place = lambda keys: R.place(keys, arcs)
    got = {r.key: r for r in D.inventory(held, place, clocks=clocks).collect()}
    assert (sorted(got["k"].holding), got["k"].missing, got["k"].in_sync, got["k"].vc) == (["a"], ["b"], False, {"a": 2})
    assert (got["ghost"].holding, len(got["ghost"].missing), got["ghost"].vc) == ([], 2, {"b": 1})
    assert (got["other"].holding, got["other"].vc) == (["b"], None)
    assert {r.key for r in D.inventory(held, place).collect()} == {"k", "other"}
    n = names(spark, "a", "b")
    assert D.failover_get(place(held.select("key").distinct()), held, n, repeats=True).where("key = 'k'").first().value == "v"


def vc(d):
    return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v).cast("long"))]) if d else F.create_map().cast("map<string,bigint>")


CASES = [({}, {}, "EQUAL"), ({"a": 1}, {"a": 2}, "BEFORE"), ({"a": 1, "b": 1}, {"a": 1}, "AFTER"), ({"a": 2, "b": 1}, {"a": 2, "c": 1}, "CONCURRENT"), ({"a": 1, "b": 0}, {"a": 1}, "EQUAL")]


def test_clock_rules(spark):
    one = spark.range(1)
    for a, b, verdict in CASES:
        r = one.select(C.compare(vc(a), vc(b)).alias("v"), C.descends(vc(a), vc(b)).alias("d"), C.merge(vc(a), vc(b)).alias("m"), C.merge(vc(b), vc(a)).alias("n")).first()
        assert r.v == verdict and r.d == (verdict in ("EQUAL", "AFTER")) and r.m == r.n
    assert one.select(C.prune(vc({"a": 1, "b": 2, "c": 3}), 2).alias("p"), C.prune(vc({"a": 1}), 0).alias("z")).first() == ({"c": 3, "b": 2}, {})


def test_repair_leaves_no_difference(spark):
    a = spark.createDataFrame([("k1", "x"), ("k2", "y")], "key string, value string")
    b = spark.createDataFrame([("k2", "other"), ("k3", "z")], "key string, value string")
    both = T.repair(a, b)
    assert table(both) == {"k1": "x", "k2": "y", "k3": "z"}
    assert T.diff(T.leaves(both, 4), T.leaves(T.repair(b.where("key <> 'k2'"), a), 4)).isEmpty()
    with pytest.raises(ValueError):
        T.leaves(a, 0)


def test_boundary_of_the_timeout(spark):
    t = spark.sql("SELECT timestamp'2024-01-01 00:00:05' AS now, timestamp'2024-01-01 00:00:00' AS seen, cast(null as timestamp) AS never")
    r = t.select(G.status(F.col("seen"), F.col("now"), 5000), G.status(F.col("seen"), F.col("now"), 4999), G.status(F.col("never"), F.col("now"), 5000)).first()
    assert tuple(r) == ("ALIVE", "DEAD", "DEAD")


def test_equal_counter_does_not_refresh(spark):
    rows = [("o", "n", 5, datetime(2024, 1, 1)), ("o", "n", 5, datetime(2024, 1, 2)), ("o", "n", 3, datetime(2024, 1, 3))]
    r = G.merge(spark.createDataFrame(rows, "observer string, node string, heartbeat long, seen timestamp")).first()
    assert r.heartbeat == 5 and r.last_seen == datetime(2024, 1, 1)


def test_streamed_generations(spark, tmp_path):
    from tidelog.streaming.generations import write_generations

    log(spark, (0, ("PUT", "a", "1")), (1, ("DELETE", "b", ""))).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(OPLOG).parquet(str(tmp_path / "in"))
    write_generations(src, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert table(L.visible_rows(spark.read.parquet(str(tmp_path / "out")))) == {"a": "1"}


def test_streamed_liveness(spark, tmp_path):
    from tidelog.streaming.membership import liveness

    spark.createDataFrame([("o", "n", 1), ("o", "n", 4), ("o", "m", 2)], "observer string, node string, heartbeat long").write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("observer string, node string, heartbeat long").parquet(str(tmp_path / "in"))
    # timers keep an availableNow query open: run by time and stop when the rows are there
    q = liveness(src, 60_000).writeStream.outputMode("update").format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    try:
        end = time.time() + 60
        while q.isActive and spark.table("live").count() < 2 and time.time() < end:
            time.sleep(0.5)
        assert {(r.node, r.heartbeat, r.status) for r in spark.table("live").collect()} == {("n", 4, "ALIVE"), ("m", 2, "ALIVE")}
    finally:
        q.stop()


def test_put_flushes_a_full_table_and_clear_forgets_the_log(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    ops = lambda *rows: spark.createDataFrame([(i, "n", op, k, v) for i, op, k, v in rows], "seq long, node string, op string, key string, value string")
    assert s.put(ops((0, "PUT", "a", "x" * 10)), limit=30) is None and s.entry_count() == 1
    assert s.put(ops((1, "PUT", "b", "y" * 30)), limit=30) == 0 and s.entry_count() == 0
    assert s.replay().isEmpty() and len(s.files()) >= 1 and "gen=0" in s.files()[0]
    s.put(ops((2, "DELETE", "a", ""), (3, "PUT", "c", "z")))
    assert table(s.table()) == {"b": "y" * 30, "c": "z"} and s._read("log", OPLOG).where("ts is null").isEmpty()
    s.clear()
    assert s.entry_count() == 0 and table(Store(spark, str(tmp_path)).table()) == {"a": "x" * 10, "b": "y" * 30}
    assert s.put(ops((4, "PUT", "c", "w")), limit=1) == 1 and table(s.get("c")) == {"c": "w"}


def test_a_demo_of_all_parts(spark):
    """The seven parts in sequence: store rows, ring, clocks, hash trees, membership, log, cluster."""
    now = F.lit("2030-01-01").cast("timestamp")
    nodes = spark.createDataFrame([("n1", 0, False), ("n2", 1, False), ("n3", 2, False)], NODES)
    data = log(spark, (0, ("PUT", "key:1", "val1")), (1, ("PUT", "key:2", "val2")), (2, ("DELETE", "key:1", "")))
    assert table(L.visible(data)) == {"key:2": "val2"}
    placed = R.place(spark.createDataFrame([("key:1",), ("key:2",)], "key string"), R.arcs(R.ring(nodes, 50)))
    puts = D.put_placement(placed, nodes)
    assert all(len(r.written) == 2 and r.failed == [] for r in puts.collect())
    clocks = D.stamped(spark.createDataFrame([], "key string, vc map<string,bigint>"), placed.select("key", F.col("pref")[0].alias("coordinator")))
    assert all(list(r.vc.values()) == [1] for r in clocks.collect())
    a = spark.createDataFrame([(f"key:{i}", f"val{i}") for i in range(1, 5)], "key string, value string")
    b = a.withColumn("value", F.when(F.col("key") == "key:3", "DIVERGENT_VALUE").otherwise(F.col("value")))
    assert T.diff(T.leaves(a, 8), T.leaves(b, 8)).count() == 1 and T.built(T.leaves(a, 8)).first() == (8, False)
    members = G.joined(nodes, now)
    for n in ("n1", "n2", "n3"):
        members = G.introduced(members, n, now)
    beaten = G.rounds(members, nodes, [now, now])
    assert {r.heartbeat for r in beaten.collect()} == {2} and beaten.count() == 9
    killed = D.switched(nodes, spark.createDataFrame([(0, "n2", True)], "seq long, node string, kill boolean"))
    assert {r.node: r.status for r in G.view(beaten, "n1", killed, now, 200).collect()} == {"n1": "ALIVE", "n2": "DEAD", "n3": "ALIVE"}
    holdings = puts.select("key", F.lit("v").alias("value"), F.explode("written").alias("node"))
    found = D.failover_get(placed, holdings, killed, F.lit("n2")).collect()
    assert {r.key for r in found} == {"key:1", "key:2"} and all(r.failover and r.node != "n2" for r in found)
    with pytest.raises(ValueError, match="two nodes"):
        T.node_diff(holdings, nodes.where("ord = 0"))


def test_malformed_escapes_are_kept_one_by_one(spark):
    from tidelog.functions import scalars as S

    rows = ["a%20b%zz+c", "?key=a b", "?key=%zz&x=1", "%", "%4", "%%41", "", None, "?nokey=1&key=2", "\n?key=x\ny&z"]
    got = spark.createDataFrame([(x,) for x in rows], "t string").select(S.url_decode("t"), S.query_parameter("t", "key")).collect()
    assert [r[0] for r in got][:1] + [r[0] for r in got][3:8] == ["a b%zz c", "%", "%4", "%A", "", None]
    assert [r[1] for r in got] == ["", "a b", "%zz", "", "", "", "", None, "1", "x\ny"]
