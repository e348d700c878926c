"""The store on disk: a log in Parquet, generations in Parquet, and a manifest that commits them.

A generation counts once its manifest row is written, after its files; the log up to
the manifest's seq is then done with.  Opening reads the manifest, so flushed data
outlives a restart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import log as ops
from ..schemas import GENERATIONS, OPLOG

MANIFEST = "gen int, through long"


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, part: str, schema: str) -> DataFrame:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{part}")

    def append(self, log: DataFrame) -> None:
        """Add operations (OPLOG); an append never truncates."""
        log.selectExpr(*[c.split()[0] for c in OPLOG.split(", ")]).write.mode("append").parquet(f"{self.path}/log")

    def put(self, ops_: DataFrame, limit: int = 4 << 20, overhead: int = 0) -> int | None:
        """Append operations (seq, node, op, key, value), stamped with the time in ms where they have none, and flush
        once the memory table has `limit` bytes.  The generation flushed, or nothing."""
        if "ts" not in ops_.columns:
            ops_ = ops_.withColumn("ts", F.timestamp_millis(F.unix_millis(F.current_timestamp())))
        self.append(ops_)
        full = ops.should_flush(ops.fold(self.replay()), limit, overhead).first()[0]
        return self.flush() if full else None

    def clear(self) -> None:
        """Be done with the log without writing it: its operations are forgotten, generations stay."""
        through = self.replay().agg(F.max("seq")).first()[0]
        if through is not None:
            self.spark.range(1).selectExpr(f"{self.flushed()[0]} as gen", f"cast({through} as long) as through").write.mode("append").parquet(f"{self.path}/manifest")

    def files(self) -> list[str]:
        """Paths of the committed generations' files."""
        last = self.flushed()[0]
        rows = self._read("sorted", GENERATIONS).where(F.col("gen") <= last)
        return sorted(r.path for r in rows.select(F.input_file_name().alias("path")).distinct().collect())

    def manifest(self) -> DataFrame:
        return self._read("manifest", MANIFEST)

    def flushed(self) -> tuple[int, int]:
        r = self.manifest().agg(F.max("gen").alias("g"), F.max("through").alias("s")).first()
        return (-1 if r.g is None else r.g), (-1 if r.s is None else r.s)

    def replay(self) -> DataFrame:
        """Operations not yet flushed, in order."""
        return self._read("log", OPLOG).where(F.col("seq") > self.flushed()[1])

    def entry_count(self) -> int:
        return self.replay().count()

    def flush(self) -> int | None:
        """Write what is not yet flushed as a generation, sorted by key; nothing for an empty log."""
        rest = self.replay()
        through = rest.agg(F.max("seq")).first()[0]
        if through is None:
            return None
        gen = self.flushed()[0] + 1
        rows = ops.fold(rest.where(F.col("seq") <= through)).select("key", "value", "is_tombstone")
        rows.repartitionByRange("key").sortWithinPartitions("key").write.mode("overwrite").option("parquet.bloom.filter.enabled#key", "true").parquet(f"{self.path}/sorted/gen={gen}")
        self.spark.range(1).selectExpr(f"{gen} as gen", f"cast({through} as long) as through").write.mode("append").parquet(f"{self.path}/manifest")
        return gen

    def generations(self) -> DataFrame:
        """Committed generations, and the log's unflushed rows as the newest."""
        last = self.flushed()[0]
        done = self._read("sorted", GENERATIONS).where(F.col("gen") <= last)
        new = ops.fold(self.replay()).select(F.lit(last + 1).alias("gen"), "key", "value", "is_tombstone")
        return done.select("gen", "key", "value", "is_tombstone").unionByName(new)

    def table(self) -> DataFrame:
        return ops.visible_rows(self.generations())

    def get(self, key: str) -> DataFrame:
        return ops.get(self.generations(), key)

    def scan(self, start: str, end: str) -> DataFrame:
        return ops.scan(self.generations(), start, end)
