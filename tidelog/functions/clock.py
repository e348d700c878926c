"""Vector clocks as map<string, bigint> columns; an absent counter is 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0).cast("long"))


def increment(vc: Column, server: Column) -> Column:
    one = F.create_map(server, F.lit(1).cast("long"))
    return F.map_zip_with(vc, one, lambda k, a, b: _zero(a) + _zero(b))


def merge(a: Column, b: Column) -> Column:
    return F.map_zip_with(a, b, lambda k, x, y: F.greatest(_zero(x), _zero(y)))


def _differences(a: Column, b: Column) -> Column:
    return F.map_values(F.map_zip_with(a, b, lambda k, x, y: _zero(x) - _zero(y)))


def compare(a: Column, b: Column) -> Column:
    d = _differences(a, b)
    more, less = F.exists(d, lambda x: x > 0), F.exists(d, lambda x: x < 0)
    return F.when(more & less, "CONCURRENT").when(more, "AFTER").when(less, "BEFORE").otherwise("EQUAL")


def descends(a: Column, b: Column) -> Column:
    return ~F.exists(_differences(a, b), lambda x: x < 0)


def counter(vc: Column, server: Column | str) -> Column:
    return _zero(F.try_element_at(vc, server if isinstance(server, Column) else F.lit(server)))


def entries(vc: Column) -> Column:
    return F.array_sort(F.map_entries(vc))


def prune(vc: Column, n: int) -> Column:
    """The n highest counters, ties to the smaller server."""
    ranked = F.array_sort(F.transform(F.map_entries(vc), lambda e: F.struct((-e["value"]).alias("r"), e["key"].alias("k"))))
    return F.map_from_entries(F.transform(F.slice(ranked, 1, n), lambda e: F.struct(e["k"], -e["r"])))


def text(vc: Column) -> Column:
    shown = F.transform(entries(vc), lambda e: F.concat(e["key"], F.lit(": "), e["value"].cast("string")))
    return F.concat(F.lit("["), F.array_join(shown, ", "), F.lit("]"))


def collect(events: DataFrame, key: str, server: str) -> DataFrame:
    """Clocks from a table of events: a counter for each (key, server).  Counts combine before the shuffle."""
    n = events.groupBy(F.col(key).alias("key"), F.col(server).alias("server")).agg(F.count("*").alias("n"))
    return n.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("server", "n"))).alias("vc"))


def merge_all(clocks: DataFrame) -> DataFrame:
    """One clock for each key of (key, vc): the greatest counters."""
    flat = clocks.select("key", F.explode("vc").alias("server", "n")).groupBy("key", "server").agg(F.max("n").alias("n"))
    return flat.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("server", "n"))).alias("vc"))


def siblings(versions: DataFrame) -> DataFrame:
    """Versions (key, version, vc) that no other version of their key descends from.

    A key's champion, the version with the greatest sum of counters, drops all that it descends from, one
    comparison a version.  Only versions that are left, the champion's concurrent ones and its equals, are
    compared with each other: whatever a dropped version descends from the champion does too.
    """
    total = F.aggregate(F.map_values("vc"), F.lit(0).cast("long"), lambda s, n: s + n)
    best = versions.groupBy("key").agg(F.max_by("vc", total).alias("top"))
    behind = compare(F.col("vc"), F.col("top")) == "BEFORE"
    left = versions.join(best, "key", "left").where(~F.coalesce(behind, F.lit(False))).select(*versions.columns)
    other = left.select(F.col("key").alias("k2"), F.col("version").alias("v2"), F.col("vc").alias("vc2"))
    beaten = (F.col("key") == F.col("k2")) & (F.col("version") != F.col("v2")) & (compare(F.col("vc"), F.col("vc2")) == "BEFORE")
    return left.join(other, beaten, "left_anti")
