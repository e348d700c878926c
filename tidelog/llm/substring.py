"""Operator 3: substring dedup by suffix automata of reference shards.

A window is W consecutive words.  Each window is anchored at its minimizer, the
smallest-hashed K-gram inside it, so equal windows have equal anchors.  Windows in
a row with one anchor form a segment with one context (all their words).

1. Anchors are counted.  An anchor seen once has no repeated window; one whose contexts
   are all equal has only repeated windows.
2. What is left, anchors with several contexts, becomes the reference: distinct contexts
   with their counts, in shards by anchor.  Each shard gets a suffix automaton with
   occurrence counts; the contexts are streamed against it, and the matching statistics say
   which windows of W words occur twice or more.  An anchor with more than MOST
   contexts (a passage in a third of all documents has one at either end) goes
   another exact way: its windows are counted, combined before the shuffle.
3. Documents are streamed against the verdicts, and covered words removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, columns_of, id_text, mixed, rolled, rows_of, stirred, stored, word_hashes

#: Anchors with more contexts than this have their windows counted instead.
MOST = 2000
#: Verdicts and anchors go to the executors whole up to this many; beyond, they meet the segments in a join.
MOST_SENT = 2_000_000
SHARD_WORDS = 60_000


class SuffixAutomaton:
    """Suffix automaton of weighted word sequences, with the occurrence count of each state."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]
        self.last, self.ends = 0, 0

    def add(self, words: list[int], weight: int) -> None:
        for w in words:
            self._extend(w, weight)
        self.ends -= 1  # a separator that occurs nowhere else
        self._extend(self.ends, 0)

    def _extend(self, w: int, weight: int) -> None:
        nxt, link, length = self.next, self.link, self.length
        cur, p = len(nxt), self.last
        nxt.append({})
        length.append(length[p] + 1)
        link.append(0)
        self.count.append(weight)
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                self.count.append(0)
                while p != -1 and nxt[p].get(w) == q:
                    nxt[p][w] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        self.last = cur

    def finish(self) -> SuffixAutomaton:
        for s in np.argsort(np.array(self.length), kind="stable")[:0:-1].tolist():
            self.count[self.link[s]] += self.count[s]
        return self

    def occurrences(self, words: list[int], w: int) -> Iterator[int]:
        """For each window of w words: how often it occurs (0 if nowhere), from the matching statistics."""
        nxt, link, length, count = self.next, self.link, self.length, self.count
        s, n = 0, 0
        for i, x in enumerate(words):
            while s and x not in nxt[s]:
                s = link[s]
                n = length[s]
            if x in nxt[s]:
                s, n = nxt[s][x], n + 1
            while s and length[link[s]] >= w:
                s = link[s]
                n = length[s]
            if i >= w - 1:
                yield count[s] if n >= w else 0


def segments(h: np.ndarray, window: int, k: int):
    """(anchor, lo, hi, context): each segment's anchor hash, its first and last window's start, and a hash of its words.

    The words are h[lo : hi + window].  The first and the last window overlap and so hold all of
    them; each is hashed from the K-grams that cover it.
    """
    if len(h) < window:
        none = np.empty(0, np.int64)
        return none.view(np.uint64), none, none, none.view(np.uint64)
    g = rolled(h, k)
    at = np.lib.stride_tricks.sliding_window_view(g, window - k + 1).argmin(1) + np.arange(len(h) - window + 1)
    cut = np.flatnonzero(at[1:] != at[:-1]) + 1
    lo = np.concatenate([[0], cut])
    hi = np.concatenate([cut, [len(at)]]) - 1
    context = (hi - lo).astype(np.uint64)
    for start in (lo, hi):
        for step in (*range(0, window - k, k), window - k):
            context = stirred(context, g[start + step])
    return g[at[lo]], lo, hi, context


def _key(anchor: np.ndarray, context: np.ndarray) -> np.ndarray:
    return mixed(anchor * np.uint64(0x9FB21C651E98DF25) + context)


def _all(n: np.ndarray) -> np.ndarray:
    return (np.int64(1) << n) - 1


def _masks(words: np.ndarray, weights: np.ndarray, window: int) -> list[int]:
    """For contexts (rows of words, with counts), the bits of windows that occur twice or more among them."""
    sam = SuffixAutomaton()
    lists = [np.frombuffer(x, np.int64).tolist() for x in words]
    for x, n in zip(lists, weights):
        sam.add(x, int(n))
    sam.finish()
    return [sum(1 << j for j, n in enumerate(sam.occurrences(x, window)) if n >= 2) for x in lists]


def verdicts(spark: SparkSession, docs: DataFrame, window: int, k: int, most: int = MOST) -> DataFrame:
    """(key, mask): for each anchor and context with a repeated window, which of its windows are repeated."""
    pair = pa.schema([("anchor", pa.int64()), ("context", pa.int64()), ("n_windows", pa.int32())])

    def scan(batches):
        for (texts,) in rows_of(batches, "text"):
            for lo_ in range(0, len(texts), 64):
                cols = [[], [], []]
                for t in texts[lo_ : lo_ + 64]:
                    h = word_hashes(t)
                    a, lo, hi, c = segments(h, window, k)
                    if len(a):
                        cols[0].append(a)
                        cols[1].append(c)
                        cols[2].append(hi - lo + 1)
                if cols[0]:
                    a, c, n = map(np.concatenate, cols)
                    yield batch(pair, pa.array(a.view(np.int64)), pa.array(c.view(np.int64)), pa.array(n.astype(np.int32)))

    found = id_text(docs).select("text").mapInArrow(scan, "anchor long, context long, n_windows int")
    seen = found.groupBy("anchor").agg(
        F.count("*").alias("n"), F.min("context").alias("c0"), F.max("context").alias("c1"), F.min("n_windows").alias("w")
    )
    seen = stored(spark, seen.where("n > 1"), "substring-anchors")
    keyed = pa.schema([("key", pa.int64()), ("mask", pa.int64())])

    def whole(batches):
        for b in batches:
            a, c, n = (b.column(i).to_numpy() for i in range(3))
            yield batch(keyed, pa.array(_key(a.view(np.uint64), c.view(np.uint64)).view(np.int64)), pa.array(_all(n.astype(np.int64))))

    same = seen.where("c0 = c1").select("anchor", "c0", "w").mapInArrow(whole, "key long, mask long")
    several = seen.where("c0 <> c1").select("anchor", "n")
    return same.unionByName(_resolved(spark, docs, several, window, k, most))


def _resolved(spark: SparkSession, docs: DataFrame, several: DataFrame, window: int, k: int, most: int) -> DataFrame:
    """(key, mask) of anchors that have several contexts, by automata, or by counts where there are too many."""
    many = several.count()
    picked = many <= MOST_SENT
    if picked:
        (anchors,) = columns_of(several.select("anchor"))
        sent = spark.sparkContext.broadcast(np.sort(anchors))
    cols = "anchor long, context long, words binary"
    schema = pa.schema([("anchor", pa.int64()), ("context", pa.int64()), ("words", pa.binary())])

    def contexts(batches):
        for (texts,) in rows_of(batches, "text"):
            for lo_ in range(0, len(texts), 256):
                out = [[], [], []]
                for t in texts[lo_ : lo_ + 256]:
                    h = word_hashes(t)
                    a, lo, hi, c = segments(h, window, k)
                    if not len(a):
                        continue
                    a, c = a.view(np.int64), c.view(np.int64)
                    if picked:
                        if not many:
                            continue
                        at = np.searchsorted(sent.value, a)
                        keep = np.flatnonzero(sent.value[np.minimum(at, many - 1)] == a)
                    else:
                        keep = np.arange(len(a))
                    if len(keep):
                        lo, hi = lo[keep], hi[keep]
                        raw = h.tobytes()
                        out[0].append(a[keep])
                        out[1].append(c[keep])
                        out[2] += [raw[8 * x : 8 * (y + window)] for x, y in zip(lo.tolist(), hi.tolist())]
                if out[0]:
                    yield batch(schema, pa.array(np.concatenate(out[0])), pa.array(np.concatenate(out[1])), out[2])

    rows = id_text(docs).select("text").mapInArrow(contexts, cols)
    if not picked:
        rows = rows.join(several.select("anchor"), "anchor")
    # the words follow from the context's hash: any row's will do
    distinct = stored(spark, rows.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.max("words").alias("words")), "substring-contexts")
    sizes = distinct.groupBy("anchor").agg(F.count("*").alias("contexts"))
    total = distinct.agg(F.coalesce(F.sum(F.octet_length("words")), F.lit(0)).alias("b")).first().b
    shards = max(1, total // 8 // SHARD_WORDS)
    crowded = sizes.where(F.col("contexts") > most).select("anchor")

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        mask = _masks(pdf["words"].to_numpy(), pdf["n"].to_numpy(), window)
        key = _key(pdf["anchor"].to_numpy(np.int64).view(np.uint64), pdf["context"].to_numpy(np.int64).view(np.uint64))
        out = pd.DataFrame({"key": key.view(np.int64), "mask": np.array(mask, np.int64)})
        return out[out["mask"] != 0]

    few = distinct.join(crowded, "anchor", "left_anti").withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    judged = few.groupBy("shard").applyInPandas(judge, "key long, mask long")

    one = pa.schema([("key", pa.int64()), ("bit", pa.int32()), ("w", pa.int64()), ("n", pa.int64())])

    def split(batches):
        for cols_ in rows_of(batches, "anchor", "context", "n", "words"):
            for a, c, n, x in zip(*cols_):
                h = np.frombuffer(x, np.uint64)
                lo = np.arange(len(h) - window + 1)
                w = rolled(h, window)
                key = _key(np.array([a], np.int64).view(np.uint64), np.array([c], np.int64).view(np.uint64)).view(np.int64)[0]
                yield batch(one, [int(key)] * len(lo), lo.tolist(), pa.array(w.view(np.int64)), [n] * len(lo))

    windows = distinct.join(crowded, "anchor", "left_semi").mapInArrow(split, "key long, bit int, w long, n long")
    repeated = windows.groupBy("w").agg(F.sum("n").alias("times")).where("times > 1").select("w")
    counted = windows.join(repeated, "w").groupBy("key").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask"))
    return judged.unionByName(counted)


def _covered(n: int, window: int, lo: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Which of n words a repeated window covers."""
    edge = np.zeros(n + 1, np.int32)
    for bit in range(int(mask.max()).bit_length()) if len(mask) else ():
        at = lo[(mask >> bit) & 1 == 1] + bit
        np.add.at(edge, at, 1)
        np.add.at(edge, at + window, -1)
    return np.cumsum(edge[:n]) > 0


def remove_repeats(spark: SparkSession, docs: DataFrame, window: int = 50, k: int = 12, most: int = MOST) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text): words that a repeated window covers are removed, every copy's.

    A window repeats if its words also start anywhere else, the same document
    included; windows are judged on the input.  Kept words are joined by one space.

    A null text has no words; texts shorter than a window keep all.  A null doc_id
    is carried.  A row repeated whole repeats all its windows.  An empty table gives no
    rows.  Only doc_id and text are read.  Words and contexts are compared by
    64-bit hashes, an anchor and its context together.
    """
    if window - k + 1 > 60 or window <= k:
        raise ValueError("window must exceed k by less than 60")
    found = stored(spark, verdicts(spark, docs, window, k, most), "substring-verdicts")
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])
    cols = "doc_id long, n_words long, n_removed long, kept_text string"

    def cut(text, n, gone):
        words = text.split()
        if not gone.any():
            return n, 0, b" ".join(words).decode()
        return n, int(gone.sum()), b" ".join([w for w, x in zip(words, gone.tolist()) if not x]).decode()

    count = found.count()
    if count <= MOST_SENT:
        key, mask = columns_of(found.select("key", "mask"))
        order = np.argsort(key)
        sent = spark.sparkContext.broadcast((key[order], mask[order]))

        def stream(batches):
            keys, masks = sent.value
            for ids, texts in rows_of(batches, "doc_id", "text"):
                for at_ in range(0, len(ids), 256):
                    out = []
                    for t in texts[at_ : at_ + 256]:
                        h = word_hashes(t)
                        a, lo, hi, c = segments(h, window, k)
                        gone = np.zeros(len(h), bool)
                        if len(a) and len(keys):
                            key = _key(a, c).view(np.int64)
                            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                            hit = np.flatnonzero(keys[at] == key)
                            if len(hit):
                                gone = _covered(len(h), window, lo[hit], masks[at[hit]])
                        out.append(cut(t, len(h), gone))
                    yield batch(schema, ids[at_ : at_ + 256], *map(list, zip(*out)))

        return id_text(docs).mapInArrow(stream, cols)

    keyed = pa.schema([("row", pa.int64()), ("lo", pa.int32()), ("key", pa.int64())])

    def place(batches):
        for rows_, texts in rows_of(batches, "row", "text"):
            for r, t in zip(rows_, texts):
                h = word_hashes(t)
                a, lo, hi, c = segments(h, window, k)
                key = _key(a, c).view(np.int64)
                yield batch(keyed, [r] * len(lo), pa.array(lo.astype(np.int32)), pa.array(key))

    texts = id_text(docs).withColumn("row", F.xxhash64("doc_id", "text"))
    hits = texts.select("row", "text").mapInArrow(place, "row long, lo int, key long").join(found, "key").distinct()
    spans = hits.groupBy("row").agg(F.collect_list(F.struct("lo", "mask")).alias("spans"))

    def apply(batches):
        for ids, texts_, spans_ in rows_of(batches, "doc_id", "text", "spans"):
            out = []
            for t, s in zip(texts_, spans_):
                n = len(word_hashes(t))
                lo, mask = (np.array([x[c] for x in s or ()], np.int64) for c in ("lo", "mask"))
                out.append(cut(t, n, _covered(n, window, lo, mask)))
            if out:
                yield batch(schema, ids, *map(list, zip(*out)))

    return texts.join(spans, "row", "left").select("doc_id", "text", "spans").mapInArrow(apply, cols)


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = remove_repeats(spark, docs, window=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
