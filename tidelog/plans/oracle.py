"""DuckDB SQL for the engine's queries, formulated otherwise: ranks where the queries fold, distances where they use
arcs, unpivoted rows where they use maps."""

from __future__ import annotations

NODES = "(VALUES ('node-alpha', 0, false), ('node-beta', 1, true), ('node-gamma', 2, false), ('node-delta', 3, false)) AS n(node, ord, disabled)"
THREE = "(VALUES ('node-alpha'), ('node-beta'), ('node-gamma')) AS n(node)"
FOUR = "(VALUES ('node-alpha'), ('node-beta'), ('node-gamma'), ('node-delta')) AS n(node)"
OPLOG = """oplog AS (SELECT event_id AS seq, ts, CASE event_id % 3 WHEN 0 THEN 'node-alpha' WHEN 1 THEN 'node-beta' ELSE 'node-gamma' END AS node,
  CASE WHEN event_type = 'error' THEN 'DELETE' ELSE 'PUT' END AS op, 'user:' || user_id AS key, CASE WHEN event_type = 'error' THEN '' ELSE props END AS value FROM events),
folded AS (SELECT key, value, op = 'DELETE' AS is_tombstone, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM oplog) WHERE rn = 1),
visible AS (SELECT key, value FROM folded WHERE NOT is_tombstone),
gens AS (SELECT CAST(seq // 1000 AS INTEGER) AS gen, key, value, op = 'DELETE' AS is_tombstone FROM
  (SELECT *, row_number() OVER (PARTITION BY key, seq // 1000 ORDER BY seq DESC) AS rn FROM oplog) WHERE rn = 1)"""
KEYS = "keys AS (SELECT 'order:' || o_orderkey AS key, o_orderkey, o_orderstatus AS value FROM orders)"
SIDES = KEYS + """, a AS (SELECT key, value FROM keys),
b AS (SELECT key, CASE WHEN o_orderkey % 89 = 0 THEN 'MUT' ELSE value END AS value FROM keys WHERE o_orderkey % 97 <> 0)"""


def h32(x: str) -> str:
    return f"('0x' || substr(md5({x}), 1, 8))::BIGINT"


def ring(nodes: str, vnodes: int, name: str = "ring") -> str:
    return f"{name} AS (SELECT pos, max(node) AS node FROM (SELECT {h32('node || chr(35) || i')} AS pos, node FROM {nodes}, range({vnodes}) AS r(i)) GROUP BY pos)"


def walk(nodes: str, vnodes: int = 50, name: str = "walk", keys: str = "keys") -> str:
    """Each key's nodes ranked by clockwise distance."""
    return f"""{ring(nodes, vnodes, name + '_ring')}, {name} AS (SELECT key, node, row_number() OVER (PARTITION BY key ORDER BY d, node) AS place
  FROM (SELECT key, node, min((pos - {h32('key')} + 8589934592) % 4294967296) AS d FROM {keys}, {name}_ring GROUP BY key, node))"""


PLACED = KEYS + ", " + walk(NODES)
HOLDINGS = PLACED + """, holdings AS (SELECT walk.node, key, value FROM walk JOIN keys USING (key)
  WHERE place <= 2 AND (walk.node <> 'node-gamma' OR o_orderkey % 11 <> 0))"""
CLOCKS = "c AS (SELECT user_id AS key, event_type AS server, count(*) AS n FROM events GROUP BY ALL)"
SERVERS = CLOCKS + """, pairs AS (SELECT ka, server, coalesce(x.n, 0) AS a, coalesce(y.n, 0) AS b
  FROM (SELECT u.key AS ka FROM (SELECT DISTINCT key FROM c) u JOIN (SELECT DISTINCT key FROM c) w ON w.key = u.key + 1), (SELECT DISTINCT server FROM c) s
  LEFT JOIN c x ON x.key = ka AND x.server = s.server LEFT JOIN c y ON y.key = ka + 1 AND y.server = s.server)"""
SERVERS = SERVERS.replace("SELECT ka, server,", "SELECT ka, s.server AS server,")


def shown(n: str, server: str = "server") -> str:
    return f"'[' || string_agg({server} || ': ' || {n}, ', ' ORDER BY {server}) || ']'"


VERDICT = "CASE WHEN bool_or({0} > {1}) AND bool_or({0} < {1}) THEN 'CONCURRENT' WHEN bool_or({0} > {1}) THEN 'AFTER' WHEN bool_or({0} < {1}) THEN 'BEFORE' ELSE 'EQUAL' END"


def leaves(side: str, n: int) -> str:
    return f"""{side}_leaf AS (SELECT CAST(i AS INTEGER) AS idx, coalesce(hash, '') AS hash FROM range({n}) AS r(i) LEFT JOIN
  (SELECT bucket, md5(string_agg(hash, '' ORDER BY part)) AS hash FROM (SELECT {h32('key')} % {n} AS bucket, ('0x' || substr(md5(key), 9, 8))::BIGINT % 16 AS part,
     md5(string_agg(key || '=' || value || ';', '' ORDER BY key, value)) AS hash FROM {side} GROUP BY 1, 2) GROUP BY 1) ON bucket = i)"""


def parents(depth: int, side: str = "a", name: str = "l") -> str:
    out = [f"{name}{depth} AS (SELECT {depth} AS level, idx, hash FROM {side}_leaf)"]
    for k in range(depth - 1, -1, -1):
        out.append(
            f"{name}{k} AS (SELECT {k} AS level, x.idx // 2 AS idx, CASE WHEN x.hash = '' AND y.hash = '' THEN '' ELSE md5(x.hash || ':' || y.hash) END AS hash "
            f"FROM {name}{k + 1} x JOIN {name}{k + 1} y ON x.idx % 2 = 0 AND y.idx = x.idx + 1)"
        )
    return ", ".join(out)


def named(n: str) -> str:
    return f"CASE {n} % 3 WHEN 0 THEN 'node-alpha' WHEN 1 THEN 'node-beta' ELSE 'node-gamma' END"


def newest(where: str, by: str = "key") -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY seq DESC) AS rn FROM oplog WHERE {where}) WHERE rn = 1)"


CUT = "seq > coalesce((SELECT max(seq) FROM oplog WHERE seq % 700 = 699), -1)"
MEMBERS = f"""m AS (SELECT observer, node, heartbeat, seen FROM (SELECT {named('event_id')} AS observer, {named('user_id')} AS node, event_id % 70 AS heartbeat, ts AS seen,
  row_number() OVER (PARTITION BY event_id % 3, user_id % 3 ORDER BY event_id % 70 DESC, ts) AS rn FROM events) WHERE rn = 1)"""
SWITCHED = """last AS (SELECT node, arg_max(kill, event_id) AS kill FROM (SELECT event_id, event_type = 'error' AS kill,
  CASE user_id % 4 WHEN 0 THEN 'node-alpha' WHEN 1 THEN 'node-beta' WHEN 2 THEN 'node-gamma' ELSE 'node-lost' END AS node FROM events WHERE event_type IN ('error', 'click')) GROUP BY node),
switched AS (SELECT coalesce(n.node, last.node) AS node, ord, coalesce(kill, disabled) AS disabled FROM """ + NODES + """ FULL JOIN last ON last.node = n.node)"""
KEY_CLOCKS = f"""kc AS (SELECT kind || o_orderkey AS key, {named('o_custkey')} AS server, o_custkey % 5 + 1 AS n FROM orders, (VALUES ('order:', 2), ('ghost:', 50)) AS k(kind, every) WHERE o_orderkey % every = 0)"""
SEEN = "m AS (SELECT observer, node, heartbeat, seen FROM (SELECT CAST(event_id % 3 AS VARCHAR) AS observer, CAST(user_id AS VARCHAR) AS node, event_id % 7 AS heartbeat, ts AS seen, row_number() OVER (PARTITION BY event_id % 3, user_id ORDER BY event_id % 7 DESC, ts) AS rn FROM events) WHERE rn = 1)"
LAST = "z AS (SELECT max(ts) AS as_of FROM events), t AS (SELECT CAST(user_id AS VARCHAR) AS node, max(ts) AS last_seen FROM events GROUP BY 1)"
OVER = "last_seen + INTERVAL 2 HOUR < as_of"
DEAD = "'node-beta'"
STATE = HOLDINGS + ", " + OPLOG + f""", state AS (SELECT node, CASE WHEN disabled THEN 'DEAD' ELSE 'ALIVE' END AS status,
  (SELECT count(*) FROM holdings h WHERE h.node = n.node) AS n_keys, (SELECT count(*) FROM oplog o WHERE o.node = n.node) AS n_log,
  (SELECT count(DISTINCT seq // 1000) FROM oplog o WHERE o.node = n.node) AS n_gens,
  coalesce((SELECT max(event_id % 70) FROM events WHERE event_id % 3 = user_id % 3 AND {named('event_id')} = n.node), 0) AS heartbeat, 4::BIGINT AS ring_nodes FROM {NODES})"""
FNV = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(key, ''), lambda c: ord(c)::BIGINT)), lambda h, x: (xor(h, x) * 16777619) % 4294967296)"

ORACLE_SQL = {
    "f1_ring_hash": f"WITH {KEYS} SELECT key, {h32('key')} AS h FROM keys",
    "f2_bucket": f"WITH {KEYS} SELECT key, CAST({h32('key')} % 1024 AS INTEGER) AS bucket FROM keys",
    "f3_fnv1a": f"WITH {KEYS} SELECT key, {FNV} AS h FROM keys",
    "f4_palette": f"WITH {KEYS} SELECT key, CAST({FNV} % 6 AS INTEGER) AS colour FROM keys",
    "f5_ring_angle": f"WITH {KEYS}, g AS (SELECT key, {h32('key')} / 4294967295.0::DOUBLE * 2 * pi() - pi() / 2 AS r FROM keys) SELECT key, round(230 * cos(r), 6) AS x, round(230 * sin(r), 6) AS y FROM g",
    "f6_json_object": "SELECT event_id, '{\"kind\":\"' || event_type || '\",\"user\":' || user_id || '}' AS body FROM events",
    "f7_json_string": "SELECT event_id, event_type AS kind, '' AS none FROM events",
    "f8_json_int": "SELECT event_id, CAST(user_id AS INTEGER) AS user_id, 7 AS kind FROM events",
    "f11_clock_text": f"WITH {CLOCKS} SELECT key, {shown('n')} AS clock FROM c GROUP BY key",
    "f12_vnode_name": f"SELECT node || '#' || i AS name FROM {NODES}, range(50) AS r(i)",
    "f13_leaf_text": f"WITH {SIDES} SELECT key, format('{{}}={{}};', key, value) AS leaf FROM a",
    "f17_log_line": f"WITH {OPLOG} SELECT seq, CASE WHEN op = 'PUT' THEN 'PUT ' || key || '=' || value || CASE WHEN seq % 5 = 0 THEN ' (Handoff)' ELSE '' END ELSE 'DELETE ' || key || ' (TOMBSTONE)' END AS line FROM oplog",
    "f18_percent": "SELECT 'user:' || user_id AS key, least(100.0::DOUBLE, count(*) / 100 * 100) AS percent FROM events GROUP BY 1",
    "s3_log_replay": f"WITH {OPLOG} SELECT seq, node, op, key, value FROM oplog",
    "s5_entry_count": "SELECT count(*) AS entries FROM events WHERE event_id > 999",
    "s15_seed": f"WITH k AS (SELECT * FROM (VALUES ('user:alice','Alice Smith (ID: 101)'),('user:bob','Bob Jones (ID: 102)'),('order:9901','MacBook Pro M3 + USB-C Hub'),('session:prod_xyz','authenticated_session_token_99')) AS v(key, value)), {walk(THREE, keys='k')} SELECT key, value, string_agg(node, ',' ORDER BY place) FILTER (place <= 2) AS replicas FROM walk JOIN k USING (key) GROUP BY key, value",
    "k1_inserted_flag": f"WITH {OPLOG}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS i FROM oplog) SELECT x.seq, x.key, x.op = 'PUT' AND coalesce(y.op, 'DELETE') = 'DELETE' AS inserted FROM r x LEFT JOIN r y ON y.key = x.key AND y.i = x.i - 1",
    "k2_point_read": f"WITH {OPLOG} SELECT key, value FROM visible WHERE key = 'user:7'",
    "k3_delete_existed": f"WITH {OPLOG}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS i FROM oplog) SELECT x.seq, x.key, coalesce(y.op = 'PUT', false) AS existed FROM r x LEFT JOIN r y ON y.key = x.key AND y.i = x.i - 1 WHERE x.op = 'DELETE'",
    "k4_size": f"WITH {OPLOG} SELECT count(*) AS n FROM visible",
    "k5_empty": f"WITH {OPLOG} SELECT NOT EXISTS (SELECT 1 FROM visible) AS empty",
    "k7_contains": f"WITH {OPLOG} SELECT key FROM visible WHERE key IN (SELECT 'user:' || i FROM range(200) AS r(i))",
    "m1_memtable": f"WITH {OPLOG} SELECT key, value, is_tombstone, seq FROM folded",
    "m4_should_flush": f"WITH {OPLOG} SELECT sum(strlen(key) + strlen(value) + 48) >= 1024 AS should_flush FROM folded",
    "m5_sorted_dump": f"WITH {OPLOG} SELECT key, is_tombstone FROM folded",
    "m7_rows": f"WITH {OPLOG} SELECT count(*) AS n, count(*) FILTER (is_tombstone) AS tombstones, count(*) = 0 AS empty FROM folded",
    "m8_bytes": f"WITH {OPLOG} SELECT CAST(sum(strlen(key) + strlen(value) + 48) AS BIGINT) AS bytes FROM folded",
    "m10_contains": f"WITH {OPLOG} SELECT key FROM folded WHERE key IN (SELECT 'user:' || i FROM range(200) AS r(i))",
    "l1_point_get": f"WITH {OPLOG} SELECT gen, key, value, is_tombstone FROM gens WHERE key = 'user:7'",
    "l2_range_scan": f"WITH {OPLOG} SELECT key, value FROM visible WHERE key >= 'user:1' AND key <= 'user:5'",
    "l4_visible_state": f"WITH {OPLOG} SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY gen DESC) AS rn FROM gens) WHERE rn = 1 AND NOT is_tombstone",
    "l6_flush": f"WITH {OPLOG} SELECT gen, count(*) AS rows, count(*) FILTER (is_tombstone) AS tombstones FROM gens GROUP BY gen",
    "l7_recover": f"WITH {OPLOG} SELECT key, value FROM visible",
    "l9_generations": "SELECT DISTINCT CAST(event_id // 1000 AS INTEGER) AS gen FROM events",
    "l10_compact": f"WITH {OPLOG} SELECT gen, key, value, is_tombstone FROM gens WHERE gen > 4 UNION ALL SELECT 4, key, value, false FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY gen DESC) AS rn FROM gens WHERE gen <= 4) WHERE rn = 1 AND NOT is_tombstone",
    "r1_ring": f"WITH {ring(NODES, 50)} SELECT pos, node FROM ring",
    "r2_removal": f"WITH {ring('(SELECT node FROM ' + NODES + chr(32) + 'WHERE node <> ' + DEAD + ')', 50)} SELECT pos, node FROM ring",
    "r3_owner": f"WITH {PLACED} SELECT key, node AS owner FROM walk WHERE place = 1",
    "r4_replica_nodes": f"WITH {PLACED} SELECT key, string_agg(node, ',' ORDER BY place) AS replicas FROM walk WHERE place <= 3 GROUP BY key",
    "r5_node_count": f"WITH {ring(NODES, 50)} SELECT count(DISTINCT node) AS nodes, false AS empty, bool_or(node = 'node-beta') AS has_beta FROM ring",
    "r8_balance": f"WITH {PLACED} SELECT node, count(*) AS n_keys FROM walk WHERE place = 1 GROUP BY node",
    "r9_movement": f"WITH {KEYS}, {walk(THREE, name='w3')}, {walk(FOUR, name='w4')} SELECT x.node AS was, y.node AS now, count(*) AS n, count(*) FILTER (x.node <> y.node) AS moved FROM w3 x JOIN w4 y USING (key) WHERE x.place = 1 AND y.place = 1 GROUP BY 1, 2",
    "r10_client_ring": f"WITH {ring(NODES, 40)} SELECT pos, ring.node AS node, NOT disabled AS alive FROM ring JOIN {NODES} ON n.node = ring.node",
    "c1_increment": f"WITH {CLOCKS}, i AS (SELECT key, server, sum(n) AS n FROM (FROM c UNION ALL SELECT DISTINCT key, 'view', 1 FROM c) GROUP BY ALL) SELECT key, {shown('n')} AS clock FROM i GROUP BY key",
    "c2_merge": f"WITH {SERVERS} SELECT ka, {shown('greatest(a, b)')} AS clock FROM pairs WHERE a > 0 OR b > 0 GROUP BY ka",
    "c3_clock_compare": f"WITH {SERVERS} SELECT ka, {VERDICT.format('a', 'b')} AS verdict FROM pairs GROUP BY ka",
    "c4_descends": f"WITH {SERVERS} SELECT ka, true AS up, bool_and(a >= b) AS descends FROM pairs GROUP BY ka",
    "c5_counter": f"WITH {CLOCKS} SELECT key, CAST(coalesce(sum(n) FILTER (server = 'view'), 0) AS BIGINT) AS view, 0::BIGINT AS none FROM c GROUP BY key",
    "c6_size": f"WITH {CLOCKS} SELECT key, CAST(count(*) AS INTEGER) AS n, false AS empty FROM c GROUP BY key",
    "c8_prune": f"WITH {CLOCKS}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, server) AS i FROM c) SELECT key, {shown('n')} AS clock FROM r WHERE i <= 3 GROUP BY key",
    "c9_clocks": f"WITH {CLOCKS} SELECT key, server, n FROM c",
    "c10_compare_three": f"WITH p AS (SELECT o_orderkey, unnest([o_orderkey % 4, o_orderkey % 3, o_orderkey % 2]) AS a, unnest([o_custkey % 4, o_custkey % 3, o_custkey % 2]) AS b FROM orders) SELECT o_orderkey, {VERDICT.format('a', 'b')} AS verdict FROM p GROUP BY o_orderkey",
    "c11_merge_increment": f"WITH {SERVERS} SELECT ka, {shown('(greatest(a, b) + CASE WHEN server = ' + chr(39) + 'click' + chr(39) + ' THEN 1 ELSE 0 END)')} AS clock FROM pairs WHERE a > 0 OR b > 0 OR server = 'click' GROUP BY ka",
    "c13_decrement": f"WITH {CLOCKS} SELECT key, CAST(greatest(0, coalesce(sum(n) FILTER (server = 'error'), 0) - 20) AS BIGINT) AS n FROM c GROUP BY key",
    "c14_merge_all": f"WITH {CLOCKS}, g AS (SELECT key % 10 AS key, server, max(n) AS n FROM c GROUP BY ALL) SELECT key, {shown('n')} AS clock FROM g GROUP BY key",
    "c15_siblings": f"WITH {CLOCKS}, u AS (SELECT DISTINCT key FROM c), x AS (SELECT p.key AS v, q.key AS w, coalesce(i.n, 0) AS a, coalesce(j.n, 0) AS b FROM u p JOIN u q ON p.key % 10 = q.key % 10 AND p.key <> q.key CROSS JOIN (SELECT DISTINCT server FROM c) s LEFT JOIN c i ON i.key = p.key AND i.server = s.server LEFT JOIN c j ON j.key = q.key AND j.server = s.server), l AS (SELECT v, w FROM x GROUP BY v, w HAVING bool_and(a <= b) AND bool_or(a < b)) SELECT key % 10 AS key, key AS version FROM u WHERE key NOT IN (SELECT v FROM l)",
    "t1_merkle_leaves": f"WITH {SIDES}, {leaves('a', 1024)} SELECT idx, hash FROM a_leaf",
    "t2_merkle_tree": f"WITH {SIDES}, {leaves('a', 8)}, {parents(3)} SELECT level, CAST(idx AS INTEGER) AS idx, hash FROM (FROM l0 UNION ALL FROM l1 UNION ALL FROM l2 UNION ALL FROM l3)",
    "t3_root": f"WITH {SIDES}, {leaves('a', 2)}, {parents(1)} SELECT hash FROM l0",
    "t4_bucket_hash": f"WITH {SIDES}, {leaves('a', 1024)} SELECT hash FROM a_leaf WHERE idx = 17",
    "t5_diff": f"WITH {SIDES}, {leaves('a', 16)}, {leaves('b', 16)} SELECT x.idx FROM a_leaf x JOIN b_leaf y ON x.idx = y.idx WHERE x.hash <> y.hash",
    "t6_merkle_diff": f"WITH {SIDES}, {leaves('a', 1024)}, {leaves('b', 1024)} SELECT x.idx FROM a_leaf x JOIN b_leaf y ON x.idx = y.idx WHERE x.hash <> y.hash",
    "t9_key_diff": f"WITH {SIDES} SELECT a.key, a.value AS a_value, b.value AS b_value FROM a LEFT JOIN b USING (key) WHERE a.value IS DISTINCT FROM b.value",
    "t10_repair": f"WITH {SIDES} SELECT key, value FROM a UNION ALL SELECT key, value FROM b WHERE key NOT IN (SELECT key FROM a)",
    "g3_heartbeat_merge": f"WITH {SEEN} SELECT observer, node, heartbeat, epoch_us(seen) AS seen_us FROM m",
    "g5_failed_nodes": f"WITH {LAST} SELECT node FROM t, z WHERE {OVER}",
    "g6_status": f"WITH {LAST} SELECT CAST(i AS VARCHAR) AS node, CASE WHEN last_seen IS NULL OR {OVER} THEN 'DEAD' ELSE 'ALIVE' END AS status FROM range(200) AS r(i) LEFT JOIN t ON t.node = CAST(i AS VARCHAR), z",
    "g7_add_member": "SELECT CAST(event_id % 3 AS VARCHAR) AS observer, count(DISTINCT user_id) + 1 AS members FROM events GROUP BY 1",
    "g8_remove_member": f"WITH {SEEN} SELECT observer, node FROM m WHERE NOT (node = '1' AND observer <> '1')",
    "g9_member_count": "SELECT CAST(event_id % 3 AS VARCHAR) AS observer, count(DISTINCT user_id) AS members FROM events GROUP BY 1",
    "g10_gossip_round": f"WITH {SEEN}, w AS (SELECT *, heartbeat + CASE WHEN observer = node AND observer <> '1' THEN 1 ELSE 0 END AS beat FROM m), top AS (SELECT node, max(beat) AS top FROM w WHERE observer <> '1' GROUP BY node) SELECT o.observer, top.node, top AS heartbeat, coalesce(top > m.heartbeat, true) AS refreshed FROM (VALUES ('0'), ('2')) AS o(observer) CROSS JOIN top LEFT JOIN m ON m.observer = o.observer AND m.node = top.node UNION ALL SELECT observer, node, heartbeat, false FROM m WHERE observer = '1'",
    "d1_add_node": f"WITH {ring('(SELECT node FROM ' + NODES + chr(32) + 'UNION SELECT ' + chr(39) + 'node-new' + chr(39) + ')', 50)} SELECT node, count(*) AS positions FROM ring GROUP BY node",
    "d3_route": f"WITH {PLACED} SELECT key, CAST(place - 1 AS INTEGER) AS place, node, CASE WHEN node = {DEAD} THEN 'DEAD' ELSE 'ALIVE' END AS status FROM walk WHERE place <= 2",
    "d5_coordinator": f"WITH {PLACED} SELECT key, CASE WHEN o_orderkey % 3 = 0 THEN 'node-beta' ELSE node END AS coordinator FROM walk JOIN keys USING (key) WHERE place = 1",
    "d10_cluster_state": f"WITH {STATE} SELECT * FROM state",
    "d13_summary": f"WITH {STATE} SELECT count(*) AS nodes, count(*) FILTER (status = 'ALIVE') AS alive, count(*) FILTER (status = 'DEAD') AS dead, CAST(sum(n_keys) AS BIGINT) AS n_keys FROM state",
    "d16_log_tail": f"WITH {OPLOG} SELECT seq, key FROM oplog WHERE node = 'node-alpha' ORDER BY seq DESC LIMIT 6",
    "d17_first_alive": f"WITH {PLACED} SELECT key, arg_min(node, place) AS serves FROM walk WHERE node <> {DEAD} GROUP BY key",
    "d18_ownership": f"WITH {ring(NODES, 50)}, q AS (SELECT node, pos, lag(pos) OVER (ORDER BY pos) AS prev FROM ring) SELECT node, CAST(sum(CASE WHEN prev IS NULL THEN pos + 1 + 4294967295 - (SELECT max(pos) FROM ring) ELSE pos - prev END) AS BIGINT) AS positions FROM q GROUP BY node",
    "d21_node_name": "SELECT lower(n_name) AS name FROM nation",
}

INVENTORY = HOLDINGS + ", " + KEY_CLOCKS + ", ak AS (SELECT key FROM holdings UNION SELECT key FROM kc), " + walk(NODES, name="awalk", keys="ak") + """,
q AS (SELECT w.key, w.node, w.place, h.node IS NOT NULL AS held FROM awalk w LEFT JOIN holdings h ON h.key = w.key AND h.node = w.node WHERE place <= 2),
inv AS (SELECT key, max(node) FILTER (place = 1) AS owner, string_agg(node, ',' ORDER BY place) AS targets, coalesce(string_agg(node, ',' ORDER BY place) FILTER (held), '') AS holding,
  coalesce(string_agg(node, ',' ORDER BY place) FILTER (NOT held), '') AS missing, bool_and(held) AS in_sync,
  coalesce((SELECT '[' || string_agg(server || ': ' || n, ', ' ORDER BY server) || ']' FROM kc WHERE kc.key = q.key), '[]') AS clock FROM q GROUP BY key)"""
LINE = "CASE WHEN op = 'PUT' THEN 'PUT ' || key || '=' || value ELSE 'DELETE ' || key || ' (TOMBSTONE)' END"
REVIVED = "(SELECT node FROM switched WHERE NOT disabled)"

ORACLE_SQL |= {
    "f9_url_decode": f"WITH {KEYS} SELECT key, key AS decoded, key || '%zz' AS kept, 'order :' || o_orderkey || '%zzé%4' AS mixed FROM keys",
    "f10_query_parameter": f"WITH {KEYS} SELECT key, key AS k, 'a b' AS node_id, 'a b%zz' || key AS odd, '' AS none FROM keys",
    "f14_now_ms": f"WITH {OPLOG} SELECT seq, epoch_us(ts) // 1000 AS ms, true AS past FROM oplog",
    "f15_monotonic_ms": f"WITH {OPLOG} SELECT seq, CAST(epoch_us(ts) // 1000 - (SELECT min(epoch_us(ts) // 1000) FROM oplog) AS BIGINT) AS ms FROM oplog",
    "f16_verdict_text": f"WITH {KEYS} SELECT key, CASE o_orderkey % 4 WHEN 0 THEN 'EQUAL' WHEN 1 THEN 'BEFORE' WHEN 2 THEN 'AFTER' ELSE 'CONCURRENT' END AS verdict FROM keys",
    "s4_log_truncate": f"WITH {OPLOG} SELECT seq, op, key FROM oplog WHERE {CUT}",
    "s7_run_write": f"WITH {OPLOG} SELECT gen, CAST(sum(33 + 2 * strlen(key) + strlen(value)) + 16 AS BIGINT) AS bytes, count(*) AS rows FROM gens GROUP BY gen",
    "s8_run_index": f"WITH {OPLOG} SELECT gen, key, CAST(coalesce(sum(17 + strlen(key) + strlen(value)) OVER (PARTITION BY gen ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM gens",
    "s10_run_full_scan": f"WITH {OPLOG} SELECT gen, key, value, is_tombstone FROM gens",
    "l1_run_range": f"WITH {OPLOG} SELECT gen, key, value, is_tombstone FROM gens WHERE key >= 'user:1' AND key <= 'user:5'",
    "k6_clear": f"WITH {OPLOG} SELECT key, value FROM {newest(CUT)} WHERE op = 'PUT'",
    "m2_point_read": f"WITH {OPLOG} SELECT key, value, is_tombstone FROM folded WHERE key IN ('user:7', 'user:8', 'user:9')",
    "m3_tombstones": f"WITH {OPLOG} SELECT key, '' AS value, true AS is_tombstone, max(seq) AS seq FROM oplog WHERE op = 'DELETE' GROUP BY key",
    "m6_clear": f"WITH {OPLOG} SELECT key, value, op = 'DELETE' AS is_tombstone FROM {newest(CUT)}",
    "l3_engine_put": f"WITH {OPLOG} SELECT CAST(seq // 100 AS INTEGER) AS gen, CAST(sum(strlen(key) + strlen(value) + 48) AS BIGINT) AS bytes, sum(strlen(key) + strlen(value) + 48) >= 6000 AS flush FROM {newest('true', 'key, seq // 100')} GROUP BY 1",
    "l5_effective_delete": f"WITH {OPLOG}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS i FROM oplog) SELECT x.seq, x.op, x.key FROM r x LEFT JOIN r y ON y.key = x.key AND y.i = x.i - 1 WHERE x.op = 'PUT' OR y.op = 'PUT'",
    "c12_key_clock": f"WITH {INVENTORY} SELECT key, clock, owner, targets FROM inv WHERE key IN ('order:2', 'order:4', 'ghost:50', 'order:3')",
    "t7_bucket_count": "SELECT 16 AS buckets, false AS empty, 'a' AS side UNION ALL SELECT 8, true, 'none'",
    "t9_node_diff": f"WITH {HOLDINGS}, a AS (SELECT key, value FROM holdings WHERE node = 'node-alpha'), b AS (SELECT key, value FROM holdings WHERE node = 'node-beta'), {leaves('a', 8)}, {leaves('b', 8)}, {parents(3)}, {parents(3, 'b', 'r')} SELECT 'node-alpha' AS node_a, 'node-beta' AS node_b, (SELECT hash FROM l0) AS root_a, (SELECT hash FROM r0) AS root_b, x.idx FROM a_leaf x JOIN b_leaf y ON x.idx = y.idx WHERE x.hash <> y.hash",
    "t11_equal_roots": f"WITH {SIDES} SELECT 'a-b' AS pair, NOT EXISTS ((FROM a EXCEPT FROM b) UNION ALL (FROM b EXCEPT FROM a)) AS in_sync UNION ALL SELECT 'a-a', true",
    "g1_self_registration": f"SELECT node AS observer, node, 0::BIGINT AS heartbeat, true AS now FROM {NODES}",
    "g2_own_heartbeat": f"WITH {MEMBERS} SELECT observer, node, heartbeat + CASE WHEN observer = node AND node <> {DEAD} THEN 1 ELSE 0 END AS heartbeat, observer = node AND node <> {DEAD} AS refreshed FROM m",
    "g4_snapshot": f"WITH {MEMBERS} SELECT node, heartbeat, epoch_us(seen) AS seen_us FROM m WHERE observer = 'node-alpha'",
    "g11_rounds": f"WITH {SEEN}, top AS (SELECT node, max(heartbeat + CASE WHEN observer = node THEN 1 ELSE 0 END) + CASE WHEN node IN ('0', '2') THEN 1 ELSE 0 END AS top FROM m WHERE observer <> '1' GROUP BY node) SELECT o.observer, top.node, top AS heartbeat FROM (VALUES ('0'), ('2')) AS o(observer) CROSS JOIN top UNION ALL SELECT observer, node, heartbeat FROM m WHERE observer = '1'",
    "g12_view": f"WITH {MEMBERS} SELECT node, heartbeat, CASE WHEN node = {DEAD} OR epoch_us((SELECT max(ts) FROM events)) // 1000 - epoch_us(seen) // 1000 > 600000 THEN 'DEAD' ELSE 'ALIVE' END AS status FROM m WHERE observer = 'node-gamma'",
    "g13_kill_revive": f"WITH {SWITCHED} SELECT node, disabled FROM switched",
    "g14_revive": f"WITH {MEMBERS}, {SWITCHED} SELECT observer, node, heartbeat + CASE WHEN observer = node AND node IN {REVIVED} THEN 1 ELSE 0 END AS heartbeat FROM m",
    "d1_introduction": f"WITH {MEMBERS} SELECT observer, node, heartbeat FROM m UNION ALL SELECT node, 'node-new', 0 FROM {THREE} UNION ALL SELECT 'node-new', node, 0 FROM {THREE} UNION ALL SELECT 'node-new', 'node-new', 0",
    "d2_remove_node": f"WITH {HOLDINGS}, {OPLOG}, {MEMBERS}, {ring(NODES, 50)} SELECT 'holdings' AS part, count(*) AS n FROM holdings WHERE node <> 'node-alpha' UNION ALL SELECT 'log', count(*) FROM oplog WHERE node <> 'node-alpha' UNION ALL SELECT 'members', count(*) FROM m WHERE node <> 'node-alpha' AND observer <> 'node-alpha' UNION ALL SELECT 'ring', count(*) FROM ring WHERE node <> 'node-alpha'",
    "d4_put_placement": f"WITH {PLACED}, {KEY_CLOCKS}, q AS (SELECT *, sum(CASE WHEN node <> {DEAD} THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY place) AS live FROM walk), up AS (SELECT key, server, CAST(sum(n) AS BIGINT) AS n FROM (SELECT key, server, n FROM kc UNION ALL SELECT key, node, 1 FROM walk WHERE place = 1) GROUP BY ALL), t AS (SELECT key, {shown('n')} AS clock FROM up GROUP BY key) SELECT key, coalesce(string_agg(node, ',' ORDER BY place) FILTER (node <> {DEAD} AND live <= 2), '') AS written, coalesce(string_agg(node, ',' ORDER BY place) FILTER (node = {DEAD} AND place <= 2), '') AS failed, coalesce(string_agg(node, ',' ORDER BY place) FILTER (node <> {DEAD} AND live <= 2 AND place > 2), '') AS handoff, any_value(clock) AS clock FROM q JOIN t USING (key) GROUP BY key",
    "d6_failover_get": f"WITH {HOLDINGS}, ask AS (SELECT key, CASE o_orderkey % 5 WHEN 0 THEN 'node-beta' WHEN 1 THEN 'node-gamma' WHEN 2 THEN 'node-none' END AS asked FROM keys), q AS (SELECT key, w.node, h.value, asked, row_number() OVER (PARTITION BY key ORDER BY CASE WHEN w.node = asked THEN 0 ELSE w.place END) AS i FROM walk w JOIN holdings h USING (key, node) JOIN ask USING (key) WHERE w.node <> {DEAD}) SELECT key, node, value, coalesce(node <> asked, false) AS failover FROM q WHERE i = 1",
    "d6_newest_get": f"WITH {OPLOG} SELECT key, node, value FROM {newest('op = ' + chr(39) + 'PUT' + chr(39) + ' AND node <> ' + DEAD)}",
    "d7_delete_key": f"WITH {OPLOG} SELECT node, key, value FROM {newest('true', 'node, key')} WHERE op = 'PUT' AND key IN ('user:7', 'user:8') AND NOT (node = 'node-alpha' AND key = 'user:7')",
    "d8_flush_node": f"WITH {OPLOG} SELECT 1 AS gen, key, value, op = 'DELETE' AS is_tombstone FROM {newest('node = ' + chr(39) + 'node-alpha' + chr(39) + ' AND seq > 499')}",
    "d9_recover_node": f"WITH {OPLOG} SELECT node, key, value FROM {newest('node = ' + DEAD)} WHERE op = 'PUT'",
    "d11_node_storage": f"WITH {HOLDINGS}, {OPLOG} SELECT 'entry' AS part, key, value AS text FROM holdings WHERE node = 'node-alpha' UNION ALL SELECT 'log', lpad(CAST(seq AS VARCHAR), 19, '0'), {LINE} FROM oplog WHERE node = 'node-alpha' UNION ALL SELECT 'generations', '', CAST(count(DISTINCT seq // 1000) AS VARCHAR) FROM oplog WHERE node = 'node-alpha'",
    "d12_key_inventory": f"WITH {INVENTORY} SELECT key, owner, targets, holding, missing, in_sync, clock FROM inv",
    "d15_chaos": f"WITH {SWITCHED} SELECT CASE WHEN count(*) FILTER (NOT disabled) > 1 THEN arg_max(node, ord) FILTER (NOT disabled) ELSE arg_min(node, ord) FILTER (disabled) END AS node, count(*) FILTER (NOT disabled) > 1 AS disable FROM switched",
    "d19_side_by_side": f"WITH {HOLDINGS} SELECT key, max(value) FILTER (node = 'node-alpha') AS a_value, max(value) FILTER (node = 'node-gamma') AS b_value FROM holdings WHERE node IN ('node-alpha', 'node-gamma') GROUP BY key",
}
