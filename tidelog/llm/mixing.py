"""Operator 4: mixing sources to target weights, DataFrame functions only.

Each source's words form one stream that is cut into fixed-length blocks.  An
output shard draws its source counts from a multinomial; a source's slots go
through a pseudorandom permutation of its block numbers; slots and blocks meet
in a join on (source, block).
"""

from __future__ import annotations

import json
import math
from hashlib import blake2b

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, stored

#: A table of a row or two for each source is broadcast up to so many sources; beyond them it is joined.
MOST_SENT = 100_000
#: Draws find their source by an equality on slices of [0, 1) and a range inside.
SLICES = 4096


def targets(sizes: dict[str | None, int], weights: list[float], share: float, most: float) -> dict[str | None, float]:
    """Words wanted of each source: share of all words by weight, none above `most` times its size.

    Sources take the weights in turn, ordered by code point, null last.  What a
    capped source can't take is shared again among the others by weight.
    """
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] > most * sizes[s] * total]
        if not over:
            out |= {s: left * w[s] / total for s in open_}
            break
        for s in over:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in over)
        open_ -= set(over)
    return out


def _uniform(seed: int, *what) -> int:
    return int.from_bytes(blake2b(repr((seed, *what)).encode(), digest_size=8).digest(), "big")


def _coprime(n: int, start: int) -> int:
    a = start % n or 1
    while math.gcd(a, n) != 1:
        a = a % n + 1
    return a


def _rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def mix_sources(
    spark: SparkSession,
    docs: DataFrame,
    weights: list[float] = (1.0,),
    share: float = 1.0,
    most: float = 2.0,
    block: int = 64,
    shard_slots: int = 4096,
    seed: int = 17,
    carry: tuple = (),
) -> tuple[DataFrame, DataFrame]:
    """Two tables: documents (doc_id, source, size, source_size, target, at, and the columns `carry`) and the mix
    (shard, slot, source_key, block, at, from_word, n_words), a row for each piece of a document that a slot holds.

    `at` is a document's first word in its source's stream; with source_key it
    names the row.  A block is taken floor or ceil of (slots / blocks) times, so no
    document exceeds ceil(target / size) times its words.  Draws depend on seed and
    slot numbers only: reruns agree.

    Documents lie in a source's stream by (hash bucket of doc_id, doc_id): offsets
    come from windows of a few thousand rows and one over bucket totals, so a source
    with a third of all rows is no single task.

    Nulls: a null text has size 0; a null source is a source of its own, ordered
    last; a null doc_id is a row like others.  Documents without words are in no
    piece.  Repeated rows each have their own place.  An empty table gives two
    empty tables.  Only doc_id, text and source are read.
    """
    base = stored(
        spark,
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("source_key"),
            F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            *carry,
        ),
        "mix-sizes",
    )
    # a row for each source: the mix's own plan, made by a loop over sources
    totals = base.groupBy("source_key", "source").agg(F.sum("size").alias("words"), F.count("*").alias("n")).collect()
    sent = F.broadcast if len(totals) <= MOST_SENT else lambda df: df
    sizes = {r.source: r.words for r in totals}
    want = targets(sizes, list(weights), share, most)
    plan, total = [], 0
    for s in sorted(sizes, key=lambda s: (s is None, s or "")):
        blocks = -(-sizes[s] // block)
        slots = min(round(want[s] * blocks / sizes[s]), math.ceil(most * blocks)) if blocks else 0
        plan.append({"source_key": "" if s is None else f"={s}", "source_size": sizes[s], "target": want[s], "blocks": blocks, "slots": slots})
        total += slots

    # Offsets: inside small buckets, then over the totals of buckets.
    many = max(1, sum(r.n for r in totals) // 4096)
    b = base.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(many)))
    inside = Window.partitionBy("source_key", "bucket").orderBy("doc_id", "size", *carry).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = b.groupBy("source_key", "bucket").agg(F.sum("size").alias("words"))
    starts = starts.select("source_key", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("start"))
    facts = _rows(spark, plan, "source_key string, source_size bigint, target double, blocks bigint, slots bigint")
    placed = (
        b.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(starts, ["source_key", "bucket"])
        .join(sent(facts.select("source_key", "source_size", "target")), "source_key")
        .select("doc_id", "source", "source_key", "size", "source_size", "target", (F.col("start") + F.col("inner")).alias("at"), *carry)
    )
    placed = stored(spark, placed, "mix-placed")

    first, last = F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block)
    pieces = placed.where("size > 0").select("source_key", "at", "size", F.explode(F.sequence(first, last)).alias("block"))
    low = F.greatest(F.col("at"), F.col("block") * block)
    high = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block)
    pieces = pieces.select("source_key", "block", "at", (low - F.col("at")).alias("from_word"), (high - low).alias("n_words"))

    # Spark estimates what explode() makes by the few rows it comes from and would broadcast slots or pieces; both grow with the input
    return placed, slots_of(spark, plan, total, shard_slots, seed).hint("merge").join(pieces, ["source_key", "block"])


def slots_of(spark: SparkSession, plan: list[dict], total: int, shard_slots: int, seed: int) -> DataFrame:
    """(shard, slot, source_key, block) for each of the mix's slots."""
    if not total:
        return spark.range(0).select(F.lit("").alias("source_key"), F.col("id").alias("block"), F.col("id").alias("shard"), F.col("id").alias("slot"))
    live = [p for p in plan if p["slots"]]
    cum, bounds = 0, []
    for p in live:
        cum += p["slots"]
        bounds.append(cum / total)
    # Each slot's draw, then the shard's multinomial counts.
    u = (F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 52)) / F.lit(float(1 << 52))).alias("u")
    sent = F.broadcast if len(live) <= MOST_SENT else lambda df: df
    edges = _rows(spark, [{"s": i, "lo": lo, "hi": hi} for i, (lo, hi) in enumerate(zip([0.0, *bounds[:-1]], [*bounds[:-1], 1.0]))], "s int, lo double, hi double")
    edges = edges.withColumn("slice", F.explode(F.sequence(F.floor(F.col("lo") * SLICES), F.least(F.floor(F.col("hi") * SLICES), F.lit(SLICES - 1)))))
    draws = spark.range(total).select(F.floor(F.col("id") / shard_slots).alias("shard"), u).withColumn("slice", F.floor(F.col("u") * SLICES))
    draws = draws.join(sent(edges), "slice").where("lo <= u and u < hi")
    counts = draws.groupBy("shard", "s").agg(F.count("*").alias("n"))
    counts = stored(spark, counts, "mix-counts")
    drawn = {r.s: r.n for r in counts.groupBy("s").agg(F.sum("n").alias("n")).collect()}
    # What was drawn beyond a source's slots goes to the sources that drew too few.
    moves, lacking = [], [[i, drawn.get(i, 0), p["slots"]] for i, p in enumerate(live) if drawn.get(i, 0) < p["slots"]]
    for i, p in enumerate(live):
        at, end = p["slots"], drawn.get(i, 0)
        while at < end:
            to, have, need = lacking[-1]
            k = min(end - at, need - have)
            moves.append({"s": i, "lo": at, "hi": at + k, "dest": to, "shift": have - at})
            at += k
            lacking[-1][1] += k
            if lacking[-1][1] == need:
                lacking.pop()
    run = Window.partitionBy("s").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    slots = counts.select("shard", "s", "n", F.coalesce(F.sum("n").over(run), F.lit(0)).alias("start"))
    # counts are small and would be one task; as many as shuffles have make the slots
    slots = slots.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "shard", "s")
    slots = slots.select("shard", F.col("s").alias("s0"), F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("j0"))
    m = sent(_rows(spark, moves, "s int, lo bigint, hi bigint, dest int, shift bigint"))
    slots = slots.join(m, (F.col("s0") == m.s) & (F.col("j0") >= m.lo) & (F.col("j0") < m.hi), "left").select(
        "shard", "s0", "j0", F.coalesce(m["dest"], F.col("s0")).alias("s"), (F.col("j0") + F.coalesce(m["shift"], F.lit(0))).alias("j")
    )
    # Slot j of a source is block (a * r + b) mod blocks of epoch j div blocks, a without common factor.
    perms = []
    for i, p in enumerate(live):
        n = p["blocks"]
        for e in range(-(-p["slots"] // n)):
            a = _coprime(n, _uniform(seed, p["source_key"], e, "a") % min(n, 1 << 31))
            perms.append({"s": i, "epoch": e, "source_key": p["source_key"], "blocks": n, "a": a, "b": _uniform(seed, p["source_key"], e, "b") % n})
    q = _rows(spark, perms, "s int, epoch bigint, source_key string, blocks bigint, a bigint, b bigint")
    ns = sent(_rows(spark, [{"s": i, "nb": p["blocks"]} for i, p in enumerate(live)], "s int, nb bigint"))
    slots = slots.join(ns, "s").withColumn("epoch", F.floor(F.col("j") / F.col("nb")))
    slots = slots.join(sent(q), ["s", "epoch"])
    # a is below 2**31; a source of 2**32 blocks or more takes 38-digit numbers, which hold the product of any two such
    wide = "decimal(38,0)" if any(p["blocks"] >= 1 << 32 for p in live) else "long"
    a, b, n, j = (F.col(c).cast("decimal(19,0)" if wide != "long" else wide) for c in ("a", "b", "blocks", "j"))
    block = F.pmod((a * F.pmod(j, n)).cast(wide) + b, n).cast("long")
    return slots.select("source_key", block.alias("block"), "shard", F.xxhash64(F.lit(seed), "s0", "j0").alias("slot"))


def taken_words(placed: DataFrame, mix: DataFrame) -> DataFrame:
    """Each document with the words that the mix takes of it, repeats counted."""
    took = mix.groupBy("source_key", "at").agg(F.sum("n_words").alias("taken"))
    key = [F.col("source_key"), F.col("at"), F.col("size") > 0]
    took = took.select(F.col("source_key").alias("k"), F.col("at").alias("a"), "taken")
    return placed.join(took, (key[0] == F.col("k")) & (key[1] == F.col("a")) & key[2], "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source"
    )


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return taken_words(*mix_sources(spark, docs, weights=[3, 1, 2], share=1.5, most=2.0))
