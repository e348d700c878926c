"""The two binary formats: log records and sorted runs with a dense index and a footer.

Little-endian.  A log record is time (8), kind (1), key length (4), key,
value length (4), value.  A run is rows of key length (8), key, value length (8),
value, tombstone (1); then index rows of key length (8), key, offset (8); then
index offset (8) and row count (8).  A torn last log record is dropped.
"""

from __future__ import annotations

import struct
from bisect import bisect_left
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PUT, DELETE = 0, 1


def log_record(ts: int, kind: int, key: bytes, value: bytes) -> bytes:
    return struct.pack("<QBI", ts, kind, len(key)) + key + struct.pack("<I", len(value)) + value


def read_log(data: bytes) -> Iterator[tuple[int, int, bytes, bytes]]:
    at = 0
    while at + 13 <= len(data):
        ts, kind, n = struct.unpack_from("<QBI", data, at)
        body = at + 13 + n
        if body + 4 > len(data):
            return
        (m,) = struct.unpack_from("<I", data, body)
        if body + 4 + m > len(data):
            return
        yield ts, kind, data[at + 13 : body], data[body + 4 : body + 4 + m]
        at = body + 4 + m


def write_run(rows: list[tuple[bytes, bytes, bool]]) -> bytes:
    body, index = bytearray(), bytearray()
    for key, value, dead in rows:
        index += struct.pack("<Q", len(key)) + key + struct.pack("<Q", len(body))
        body += struct.pack("<Q", len(key)) + key + struct.pack("<Q", len(value)) + value + bytes([dead])
    return bytes(body + index) + struct.pack("<QQ", len(body), len(rows))


class Run:
    def __init__(self, data: bytes):
        self.data, self.keys, self.offsets = data, [], []
        if len(data) < 16:
            return
        at, n = struct.unpack_from("<QQ", data, len(data) - 16)
        for _ in range(n):
            (k,) = struct.unpack_from("<Q", data, at)
            self.keys.append(data[at + 8 : at + 8 + k])
            self.offsets.append(struct.unpack_from("<Q", data, at + 8 + k)[0])
            at += 16 + k

    def row(self, offset: int) -> tuple[bytes, bytes, bool]:
        (k,) = struct.unpack_from("<Q", self.data, offset)
        (v,) = struct.unpack_from("<Q", self.data, offset + 8 + k)
        at = offset + 16 + k
        return self.data[offset + 8 : offset + 8 + k], self.data[at : at + v], bool(self.data[at + v])

    def get(self, key: bytes) -> tuple[bytes, bytes, bool] | None:
        i = bisect_left(self.keys, key)
        return self.row(self.offsets[i]) if i < len(self.keys) and self.keys[i] == key else None

    def scan(self, start: bytes, end: bytes) -> list[tuple[bytes, bytes, bool]]:
        return [self.row(o) for k, o in zip(self.keys, self.offsets) if start <= k <= end]

    def rows(self) -> list[tuple[bytes, bytes, bool]]:
        return [self.row(o) for o in self.offsets]


def _parsed(files: DataFrame, schema: str, parse) -> DataFrame:
    def run(batches):
        import pandas as pd

        names = [c.split()[0] for c in schema.split(", ")]
        for pdf in batches:
            for path, data in zip(pdf["path"], pdf["content"]):
                yield pd.DataFrame([(path, i, *r) for i, r in enumerate(parse(bytes(data)))], columns=names)

    return files.select("path", "content").mapInPandas(run, schema)


def log_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, seq, ts, kind, key, value) of log files; seq is the order in the file.  Keys and values are bytes."""
    files = spark.read.format("binaryFile").load(path)
    return _parsed(files, "path string, seq long, ts long, kind byte, key binary, value binary", read_log)


def run_files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path)
    return _parsed(files, "path string, seq long, key binary, value binary, is_tombstone boolean", lambda d: Run(d).rows())


def run_bytes(gens: DataFrame) -> DataFrame:
    """(path, content): a binary run for each generation of (gen, key, value, is_tombstone), rows in byte order of their keys.

    A run is a flushed memory table, so its size is bounded by the flush threshold.
    """

    def write(pdf):
        import pandas as pd

        rows = sorted((k.encode(), v.encode(), bool(t)) for k, v, t in zip(pdf["key"], pdf["value"], pdf["is_tombstone"]))
        return pd.DataFrame({"path": [str(pdf["gen"].iloc[0])], "content": [write_run(rows)]})

    return gens.select("gen", "key", "value", "is_tombstone").groupBy("gen").applyInPandas(write, "path string, content binary")


ROWS = "path string, seq long, key binary, value binary, is_tombstone boolean"


def run_index(files: DataFrame) -> DataFrame:
    """(path, seq, key, offset) of the runs' indexes."""
    return _parsed(files, "path string, seq long, key binary, offset long", lambda d: zip((r := Run(d)).keys, r.offsets))


def run_get(files: DataFrame, key: str) -> DataFrame:
    """The row of a key in each run that has it, tombstones too: a binary search of the index, one record read."""
    return _parsed(files, ROWS, lambda d: [r for r in [Run(d).get(key.encode())] if r])


def run_scan(files: DataFrame, start: str = "", end: str | None = None) -> DataFrame:
    """Rows of each run with start <= key <= end, tombstones too; all from start on without an end."""
    return _parsed(files, ROWS, lambda d: Run(d).rows() if end is None else Run(d).scan(start.encode(), end.encode()))


def log_bytes(log: DataFrame) -> DataFrame:
    """The log's rows (ts, op, key, value as text) with `record`, their binary form, made of built-in functions."""
    le = lambda x, n: F.unhex(F.concat(*[F.substring(F.lpad(F.hex(x), 2 * n, "0"), 2 * (n - i) - 1, 2) for i in range(n)]))
    kind = F.when(F.col("op") == "DELETE", F.lit(DELETE)).otherwise(F.lit(PUT)).cast("long")
    key, value = F.col("key").cast("binary"), F.col("value").cast("binary")
    size = lambda b: le(F.octet_length(b).cast("long"), 4)
    return log.withColumn("record", F.concat(le(F.unix_millis("ts"), 8), le(kind, 1), size(key), key, size(value), value))
