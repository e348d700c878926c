"""Operator 6: reversible line dedup on sharded cuckoo filters and exact reference counts.

Postings (key, doc_id) give an exact table of reference counts (key, documents,
largest doc_id).  Keys at or above the threshold also stand in cuckoo filters, one
small filter for each shard of the key space; a filter takes deletions, so documents can
be inserted and deleted.  A text's lines ask the filters first; only lines that
they know go on to the exact table, which decides.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, ddl, discard, fields, id_text, mixed, rows_of, stored

STRIPPED = b" \t\n\x0b\f\r"
SLOTS = 4


class CuckooFilter:
    """Partial-key cuckoo hashing: 16-bit fingerprints, four slots a bucket, insert, delete, contains."""

    def __init__(self, table: np.ndarray, extra: list[int] | None = None):
        self.table = table
        self.extra = extra or []  # full hashes that found no place: kept exactly

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, keys) / (SLOTS * 0.85)))))
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    def places(self, h: np.ndarray):
        m = np.uint64(len(self.table) - 1)
        h = mixed(h)
        f = (h >> np.uint64(48)).astype(np.uint16)
        f[f == 0] = 1
        one = h & m
        two = one ^ (mixed(f.astype(np.uint64)) & m)
        return f, one.astype(np.int64), two.astype(np.int64)

    def contains(self, h: np.ndarray) -> np.ndarray:
        f, one, two = self.places(h)
        found = (self.table[one] == f[:, None]).any(1) | (self.table[two] == f[:, None]).any(1)
        return found | np.isin(h, np.array(self.extra, np.uint64)) if self.extra else found

    def insert(self, h: np.ndarray) -> None:
        m, rng = len(self.table) - 1, np.random.default_rng(len(h))
        f, one, two = self.places(h)
        jump = {}
        for full, x, a, b in zip(h.tolist(), f.tolist(), one.tolist(), two.tolist()):
            undo, at = [], a
            for spot in (a, b):
                free = np.flatnonzero(self.table[spot] == 0)
                if len(free):
                    self.table[spot, free[0]] = x
                    break
            else:
                for _ in range(200):
                    k = int(rng.integers(SLOTS))
                    undo.append((at, k, int(self.table[at, k])))
                    self.table[at, k], x = x, int(self.table[at, k])
                    if x not in jump:
                        jump[x] = int(mixed(np.array([x], np.uint64))[0]) & m
                    at ^= jump[x]
                    free = np.flatnonzero(self.table[at] == 0)
                    if len(free):
                        self.table[at, free[0]] = x
                        break
                else:
                    for at, k, x in reversed(undo):
                        self.table[at, k] = x
                    self.extra.append(full)

    def delete(self, h: np.ndarray) -> None:
        f, one, two = self.places(h)
        for full, x, a, b in zip(h.tolist(), f.tolist(), one.tolist(), two.tolist()):
            if full in self.extra:
                self.extra.remove(full)
                continue
            for spot in (a, b):
                at = np.flatnonzero(self.table[spot] == x)
                if len(at):
                    self.table[spot, at[0]] = 0
                    break

    def keys(self) -> int:
        return int((self.table > 0).sum()) + len(self.extra)

    def blob(self) -> bytes:
        return len(self.extra).to_bytes(4, "little") + np.array(self.extra, "<u8").tobytes() + self.table.tobytes()

    @classmethod
    def of(cls, blob: bytes) -> CuckooFilter:
        n = int.from_bytes(blob[:4], "little")
        extra = np.frombuffer(blob, "<u8", n, 4).tolist()
        return cls(np.frombuffer(blob, np.uint16, offset=4 + 8 * n).reshape(-1, SLOTS).copy(), extra)


def long_keys(text: bytes, least: int) -> list[tuple[int, bytes | None]]:
    """Each line's key where it has `least` code points or more, else None, in order."""
    out = []
    for line in text.split(b"\n"):
        key = line.strip(STRIPPED)
        if len(key) < least or (not key.isascii() and len(key.decode()) < least):
            out.append((line, None))
        else:
            out.append((line, key.lower()))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _hashes(keys) -> tuple[list[int], list[int]]:
    from xxhash import xxh3_128_intdigest

    whole = [xxh3_128_intdigest(k) for k in keys]
    return [_signed(x >> 64) for x in whole], [_signed(x & (1 << 64) - 1) for x in whole]


class LineIndex:
    """Reference counts of long lines over the documents inserted and not deleted.

    Keys go by their 128-bit hash.  Each table is a stored one; insert() and
    delete() touch the keys of the documents given.  A key's rows are summed
    before the shuffle, so a line in a third of all documents is one row a task.

    A document is a doc_id: rows repeated under one, and rows of several inserts, count
    once for each key that any of them holds.  A null text holds one empty line.  The rows with a null
    doc_id together count as one document, which is never the one that keeps a line.
    """

    #: Filters are asked in rounds; those of one round go to the executors whole and have so many bytes, or are one shard's.
    ROUND_BYTES = 64 << 20
    #: A key with 1 / HEAVY_KEYS of all rows is joined in SALTS parts; there are HEAVY_KEYS such keys at most.
    HEAVY_KEYS, SALTS = 1000, 64

    def __init__(self, spark: SparkSession, least_chars: int = 40, least_docs: int = 5, shard_keys: int = 1 << 16):
        self.spark, self.least_chars, self.least_docs, self.shard_keys = spark, least_chars, least_docs, shard_keys
        self.postings: DataFrame | None = None
        self.counts: DataFrame | None = None
        self.filters: DataFrame | None = None
        self.shards = 1

    def _postings(self, docs: DataFrame, known=None) -> DataFrame:
        """(h1, h2, doc_id) of all long lines, or of those that `known`, a function of batches, lets through: in one Python worker a task."""
        least = self.least_chars
        schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64())])

        def found(batches):
            for ids, texts in rows_of(batches, "doc_id", "text"):
                keys, docs_ = [], []
                for d, t in zip(ids, texts):
                    mine = {k for _, k in long_keys(t, least) if k is not None}
                    keys += mine
                    docs_ += [d] * len(mine)
                yield batch(schema, *_hashes(keys), docs_)

        def run(batches):
            return known(found(batches)) if known else found(batches)

        return id_text(docs).mapInArrow(run, "h1 long, h2 long, doc_id long")

    def _recount(self, change: DataFrame | None) -> None:
        """The exact table and the filters, after `change` (h1, h2, dn, top): top is the largest holder now."""
        least, old = self.least_docs, self.counts
        if old is None:
            new = change.select("h1", "h2", F.col("dn").alias("n"), F.col("top").alias("keep"), F.lit(0).cast("long").alias("was"))
        else:
            new = old.join(change, ["h1", "h2"], "full").select(
                "h1",
                "h2",
                (F.coalesce("n", F.lit(0)) + F.coalesce("dn", F.lit(0))).alias("n"),
                F.when(F.col("dn").isNull(), F.col("keep")).otherwise(F.col("top")).alias("keep"),
                F.coalesce("n", F.lit(0)).alias("was"),
            )
        fresh = stored(self.spark, new.where("n > 0 or was > 0"), "line-counts")
        self.counts = fresh.where("n > 0").select("h1", "h2", "n", "keep")
        frequent = fresh.where(F.col("n") >= least)
        if self.filters is None or frequent.count() > 2 * self.shards * self.shard_keys:
            self.shards = 1 << max(0, int(np.ceil(np.log2(max(1, frequent.count()) / self.shard_keys))))
            self._build(frequent)
        else:
            self._update(fresh.where((F.col("n") >= least) != (F.col("was") >= least)))

    def _sharded(self, df: DataFrame) -> DataFrame:
        return df.withColumn("shard", F.pmod("h1", F.lit(self.shards)).cast("int"))

    def _build(self, frequent: DataFrame) -> None:
        def build(pdf: pd.DataFrame) -> pd.DataFrame:
            h = pdf["h2"].to_numpy().astype(np.uint64)
            f = CuckooFilter.sized(2 * len(h))
            f.insert(h)
            return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "blob": [f.blob()]})

        rows = self._sharded(frequent.select("h1", "h2"))
        self.filters = stored(self.spark, rows.groupBy("shard").applyInPandas(build, "shard int, blob binary"), "line-filters")

    def _update(self, crossed: DataFrame) -> None:
        """Keys that reached the threshold go into their shard's filter, keys that fell below it go out."""
        least = self.least_docs

        def update(have: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
            shard = (have if len(have) else keys)["shard"].iloc[0]
            h, up = keys["h2"].to_numpy().astype(np.uint64), (keys["n"] >= least).to_numpy(bool)
            f = CuckooFilter.of(have["blob"].iloc[0]) if len(have) else CuckooFilter.sized(2 * len(h))
            f.delete(h[~up])
            f.insert(h[up])
            return pd.DataFrame({"shard": [shard], "blob": [f.blob()]})

        rows = self._sharded(crossed.select("h1", "h2", "n"))
        new = self.filters.groupBy("shard").cogroup(rows.groupBy("shard")).applyInPandas(update, "shard int, blob binary")
        self.filters = stored(self.spark, new, "line-filters")

    def insert(self, docs: DataFrame) -> LineIndex:
        rows = self._postings(docs).distinct()
        if self.postings is not None:  # a document that held the line before counts no second time
            held = self.postings.select(*[F.col(c).alias(f"held_{c}") for c in self.postings.columns])
            same = [F.col(c).eqNullSafe(F.col(f"held_{c}")) for c in self.postings.columns]
            rows = rows.join(held, same[0] & same[1] & same[2], "left_anti")
        new = stored(self.spark, rows, "line-postings")
        change = new.groupBy("h1", "h2").agg(F.count("*").alias("dn"), F.max("doc_id").alias("top"))
        if self.counts is not None:
            old = self.counts.select("h1", "h2", "keep")
            change = change.join(old, ["h1", "h2"], "left").select("h1", "h2", "dn", F.greatest("top", "keep").alias("top"))
        self.postings = new if self.postings is None else self.postings.unionByName(new)
        self._recount(change)
        return self

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Take all documents with these doc_ids out again."""
        ids = doc_ids.select(F.col("doc_id").cast("long").alias("gone")).distinct()
        mark = F.col("doc_id").eqNullSafe(F.col("gone"))
        out = self.postings.join(ids, mark, "left_semi").groupBy("h1", "h2").agg((-F.count("*")).alias("dn"))
        rest = stored(self.spark, self.postings.join(ids, mark, "left_anti"), "line-postings")
        top = rest.join(out.select("h1", "h2"), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.max("doc_id").alias("top"))
        change = stored(self.spark, out.join(top, ["h1", "h2"], "left"), "line-change")
        self.postings = rest
        self._recount(change)
        return self

    def _asked(self, docs: DataFrame) -> DataFrame:
        """(h1, h2, doc_id) of lines that the filters know.

        Lines are stored by round of filters and each round's lines meet its filters where they lie, so no filter
        is passed by, no line is shuffled, and an executor holds one round's filters whatever their total.
        """
        sizes = self.filters.select("shard", F.octet_length("blob").alias("n")).orderBy("shard").collect()  # a row a shard
        rounds, now, size = {}, 0, 0
        for r in sizes:
            if size and size + r.n > self.ROUND_BYTES:
                now, size = now + 1, 0
            rounds[r.shard], size = now, size + r.n
        schema, cols = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64())]), "h1 long, h2 long, doc_id long"
        shards = self.shards

        def known_by(sent):
            def known(batches):
                have = {s: CuckooFilter.of(b) for s, b in sent.value.items()}
                for b in batches:
                    h1, h2 = b.column(0).to_numpy(), b.column(1).to_numpy().astype(np.uint64)
                    shard, hit = h1 % shards, np.zeros(len(h1), bool)
                    for s in np.unique(shard).tolist():
                        if s in have:
                            at = np.flatnonzero(shard == s)
                            hit[at] = have[s].contains(h2[at])
                    yield pa.RecordBatch.from_arrays([b.column(i).filter(pa.array(hit)) for i in range(3)], schema=schema)

            return known

        def sent_of(shards_):
            return self.spark.sparkContext.broadcast({r.shard: r.blob for r in self.filters.where(F.col("shard").isin(shards_)).collect()})

        if now == 0:
            return self._postings(docs, known_by(sent_of(list(rounds))))
        # the shards of a round follow each other: its number is that of the last round begun at or below the shard
        first = [min(s for s, x in rounds.items() if x == i) for i in range(1, now + 1)]
        begun = F.array(*[F.lit(x) for x in first])
        rows = self._sharded(self._postings(docs)).withColumn("round", F.size(F.filter(begun, lambda x: x <= F.col("shard")))).drop("shard")
        rows = stored(self.spark, rows, "line-rounds", by="round")
        out = None
        for i in range(now + 1):
            sent = sent_of([s for s, x in rounds.items() if x == i])
            found = stored(self.spark, rows.where(F.col("round") == i).select("h1", "h2", "doc_id").mapInArrow(known_by(sent), cols), "line-known")
            out = found if out is None else out.unionByName(found)
            sent.destroy()
        discard(self.spark, rows)
        return out

    def _salted(self, asked: DataFrame, frequent: DataFrame) -> DataFrame:
        """asked joined with its frequent keys.  Keys with a thousandth of all rows, so a thousand at most, are dealt by doc_id too."""
        total = self.counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
        heavy = F.col("n") * self.HEAVY_KEYS >= F.lit(total)
        known = F.broadcast(frequent.where(heavy).select("h1", "h2", F.lit(True).alias("heavy")))
        dealt = F.when(F.col("heavy"), F.pmod(F.xxhash64("doc_id"), F.lit(self.SALTS))).otherwise(F.lit(0))
        rows = asked.join(known, ["h1", "h2"], "left").select("h1", "h2", "doc_id", dealt.cast("int").alias("salt"))
        salts = F.sequence(F.lit(0), F.when(heavy, F.lit(self.SALTS - 1)).otherwise(F.lit(0)))
        keys = frequent.select("h1", "h2", "keep", F.explode(salts).alias("salt"))
        return rows.join(keys, ["h1", "h2", "salt"])

    def apply(self, docs: DataFrame, carry: tuple = ()) -> DataFrame:
        """(doc_id, n_lines, n_dropped, kept_text) and the binary columns `carry`: a frequent line stays only in its largest doc_id.

        Every line of such a key stays in all rows of that document.  A null or empty text is
        one empty line, which stays.  Rows repeated under one doc_id are treated alike, each with its own
        lines.  An empty table gives no rows.  Only doc_id, text and `carry` are read.
        """
        frequent = self.counts.where(F.col("n") >= self.least_docs).select("h1", "h2", "keep", "n")
        drops = (
            self._salted(self._asked(docs), frequent)
            .where(~F.col("doc_id").eqNullSafe(F.col("keep")))
            .distinct()
            .groupBy("doc_id")
            .agg(F.collect_list(F.struct("h1", "h2")).alias("drop"))
            .select(F.col("doc_id").alias("drop_id"), "drop")
        )
        least = self.least_chars
        texts = id_text(docs, *carry)
        rows = texts.join(drops, texts.doc_id.eqNullSafe(drops.drop_id), "left").select("doc_id", "text", "drop", *carry)
        schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_text", pa.string()), *fields(carry)])

        def rebuild(batches):
            for ids, texts_, drops_, *rest in rows_of(batches, "doc_id", "text", "drop", *carry):
                n, gone, kept = [], [], []
                for t, d in zip(texts_, drops_):
                    if not d:
                        n.append(t.count(b"\n") + 1)
                        gone.append(0)
                        kept.append(t.decode())
                        continue
                    away = {(x["h1"], x["h2"]) for x in d}
                    lines = long_keys(t, least)
                    long = [i for i, (_, k) in enumerate(lines) if k is not None]
                    out = {i for i, h in zip(long, zip(*_hashes([lines[i][1] for i in long]))) if h in away}
                    n.append(len(lines))
                    gone.append(len(out))
                    kept.append(b"\n".join([x for i, (x, _) in enumerate(lines) if i not in out]).decode())
                yield batch(schema, ids, n, gone, kept, *rest)

        return rows.mapInArrow(rebuild, "doc_id long, n_lines long, n_dropped long, kept_text string" + ddl(carry))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = LineIndex(spark, least_chars=40, least_docs=5).insert(docs).apply(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
l AS (
  SELECT r, doc_id, i, line, length(k) >= 40 AS long_key, k
  FROM (SELECT r, doc_id, i, line,
               translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
        FROM (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line,
                     generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d))),
f AS (SELECT k, max(doc_id) AS keep FROM l WHERE long_key GROUP BY k
      HAVING count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) >= 5),
m AS (SELECT l.r, l.doc_id, l.i, l.line, f.k IS NOT NULL AND l.doc_id IS DISTINCT FROM f.keep AS dropped
      FROM l LEFT JOIN f ON l.long_key AND l.k = f.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""
