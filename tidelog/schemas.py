"""Schemas of the engine's tables."""

from __future__ import annotations

OPLOG = "seq long, ts timestamp, node string, op string, key string, value string"
GENERATIONS = "gen int, key string, value string, is_tombstone boolean"
RING = "pos long, node string"
HOLDINGS = "node string, key string, value string"
CLOCKS = "key string, vc map<string,bigint>"
MEMBERSHIP = "observer string, node string, heartbeat long, last_seen timestamp"
NODES = "node string, ord int, disabled boolean"
