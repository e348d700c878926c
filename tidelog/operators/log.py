"""Operation logs folded into keyed state: maps, memory tables, generations.

A log has an explicit order, seq.  Every fold is one max_by per key, so it combines
before the shuffle and a hot key is one row a task.  Tombstones are dropped only after the newest
row of a key is known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def fold(log: DataFrame) -> DataFrame:
    """(key, value, is_tombstone, seq): each key's newest row, tombstones included."""
    row = F.struct(F.when(F.col("op") == "DELETE", "").otherwise(F.col("value")).alias("value"), (F.col("op") == "DELETE").alias("is_tombstone"), "seq")
    return log.groupBy("key").agg(F.max_by(row, "seq").alias("r")).select("key", "r.value", "r.is_tombstone", "r.seq")


def visible(log: DataFrame) -> DataFrame:
    return fold(log).where(~F.col("is_tombstone")).select("key", "value")


def flagged(log: DataFrame, slice_ops: int = 1 << 22) -> DataFrame:
    """The log with what each operation found: existed, inserted (PUT of an absent key), effective (DELETE of a present one).

    A key's operations are ordered inside slices of `slice_ops` sequence numbers, so a hot key is a task a
    slice; a slice's first operation follows the last one of the key's slice before, whose ops are combined first.
    """
    cut = log.withColumn("__slice", F.floor(F.col("seq") / slice_ops))
    before = F.lag("op").over(Window.partitionBy("key", "__slice").orderBy("seq"))
    ends = cut.groupBy("key", "__slice").agg(F.max_by("op", "seq").alias("op"))
    carried = F.lag("op").over(Window.partitionBy("key").orderBy("__slice"))
    ends = ends.select("key", "__slice", carried.alias("__carried")).where("__carried is not null")
    out = cut.withColumn("__before", before).join(ends, ["key", "__slice"], "left")
    out = out.withColumn("existed", F.coalesce(F.coalesce("__before", "__carried") == "PUT", F.lit(False)))
    out = out.withColumn("inserted", (F.col("op") == "PUT") & ~F.col("existed")).withColumn("effective", (F.col("op") == "DELETE") & F.col("existed"))
    return out.select(*log.columns, "existed", "inserted", "effective")


def effective_log(log: DataFrame) -> DataFrame:
    """What a store writes: every PUT, and a DELETE only of a key that is there."""
    return flagged(log).where("op = 'PUT' or effective").drop("existed", "inserted", "effective")


def since_clear(log: DataFrame) -> DataFrame:
    """Operations after the last CLEAR, or all where there is none."""
    last = log.agg(F.max(F.when(F.col("op") == "CLEAR", F.col("seq"))).alias("cut"))
    return log.join(F.broadcast(last), F.lit(True)).where(F.col("cut").isNull() | (F.col("seq") > F.col("cut"))).drop("cut")


def row_bytes(overhead: int) -> Column:
    return F.octet_length("key") + F.octet_length("value") + F.lit(overhead)


def size_bytes(table: DataFrame, overhead: int = 0) -> DataFrame:
    return table.agg(F.coalesce(F.sum(row_bytes(overhead)), F.lit(0)).cast("long").alias("bytes"))


def should_flush(table: DataFrame, limit: int = 4 << 20, overhead: int = 0) -> DataFrame:
    return size_bytes(table, overhead).select((F.col("bytes") >= limit).alias("should_flush"))


def contains(table: DataFrame, keys: DataFrame) -> DataFrame:
    return keys.join(table.select("key"), "key", "left_semi")


def generations(log: DataFrame, every: int) -> DataFrame:
    """(gen, key, value, is_tombstone): the newest row of each key in each run of `every` operations."""
    row = F.struct(F.when(F.col("op") == "DELETE", "").otherwise(F.col("value")).alias("value"), (F.col("op") == "DELETE").alias("is_tombstone"))
    gen = F.floor(F.col("seq") / every).cast("int").alias("gen")
    return log.groupBy(gen, "key").agg(F.max_by(row, "seq").alias("r")).select("gen", "key", "r.value", "r.is_tombstone")


def put_batches(log: DataFrame, every: int, limit: int = 4 << 20, overhead: int = 0) -> DataFrame:
    """(gen, bytes, flush): the memory table that each batch of puts leaves, and whether it is flushed at once."""
    size = generations(log, every).groupBy("gen").agg(F.sum(row_bytes(overhead)).cast("long").alias("bytes"))
    return size.withColumn("flush", F.col("bytes") >= limit)


def merge_on_read(gens: DataFrame) -> DataFrame:
    """(key, value, is_tombstone): the newest generation of each key wins.  A filter on key reaches the scan."""
    row = F.struct("value", "is_tombstone")
    return gens.groupBy("key").agg(F.max_by(row, "gen").alias("r")).select("key", "r.value", "r.is_tombstone")


def visible_rows(gens: DataFrame) -> DataFrame:
    return merge_on_read(gens).where(~F.col("is_tombstone")).select("key", "value")


def get(gens: DataFrame, key: str) -> DataFrame:
    return visible_rows(gens.where(F.col("key") == key))


def scan(gens: DataFrame, start: str, end: str) -> DataFrame:
    """Visible rows with start <= key <= end."""
    return visible_rows(gens.where(F.col("key").between(start, end)))


def compact(gens: DataFrame, through: int) -> DataFrame:
    """Generations up to `through` as one; its tombstones go, since nothing older is left for them to hide."""
    old = merge_on_read(gens.where(F.col("gen") <= through)).where(~F.col("is_tombstone"))
    return gens.where(F.col("gen") > through).unionByName(old.withColumn("gen", F.lit(through)).select("gen", "key", "value", "is_tombstone"))
