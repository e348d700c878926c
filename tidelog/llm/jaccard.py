"""Operator 2: n-gram Jaccard join in size-banded tiles.

1. Each document's shingle set is a sorted array of 64-bit hashes.  Documents
   with one set are one class; only its smallest doc_id goes on.
2. A set that must share 85 % of a partner's shares one of the first n - ceil(.85 n) + 1
   shingles of any fixed order.  The order puts frequent shingles last.  Rows that
   meet in such a shingle form a tile; rows are counted after that cut, and a larger tile than
   TILE_ROWS is one for each pair of its blocks.  In a tile only sizes within the band are
   compared, by hashed bitmaps: the bits in which two parity bitmaps differ are a lower bound
   of the symmetric difference, so bit counts bound the overlap from above.
3. What the bitmaps let through links documents into loose groups; inside a group
   (in blocks, if it is large) sorted arrays are intersected exactly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, components, ddl, discard, fields, id_text, rolled, rows_of, stored, word_hashes

#: Rows of a block of a large tile; a pair of blocks is compared in one piece.
TILE_ROWS = 4096
#: Shingles of a loose group that are compared in one piece.
GROUP_WORDS = 1_000_000
#: At most so many frequent shingles go to the executors: the count that makes one frequent rises with the input.
MOST_HOT = 400_000


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct hashes of k-word shingles, A-Z lowered; with fewer words the whole sequence is one."""
    h = word_hashes(text.lower())
    if not len(h):
        return h
    return np.unique(rolled(h, k)) if len(h) >= k else rolled(h, len(h), salt=1 + len(h))


def parity_bits(tokens: np.ndarray) -> np.ndarray:
    """Bit i: whether an odd number of tokens hash to it; half as many bits as tokens or more, a power of two from 64 to 8192."""
    size = 64
    while size < min(8192, len(tokens) // 2):
        size *= 2
    odd = np.bincount((tokens >> np.uint64(20) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


class Sketches:
    """Sizes and bitmaps of many sets, for bounds on pairs.  A longer bitmap folds to a shorter one's length."""

    def __init__(self, sizes: np.ndarray, bitmaps: list[np.ndarray], percent: int):
        self.n, self.percent = sizes, percent
        width = np.array([len(b) for b in bitmaps])
        self.width = width
        self.at = np.zeros(len(sizes), np.int64)
        self.levels: dict[int, np.ndarray] = {}
        for w in np.unique(width).tolist():
            rows = np.flatnonzero(width >= w)
            at = np.full(len(sizes), -1)
            at[rows] = np.arange(len(rows))
            out = np.empty((len(rows), w), np.uint64)
            for r in rows.tolist():
                b = bitmaps[r]
                out[at[r]] = b if len(b) == w else np.bitwise_xor.reduce(b.reshape(-1, w), axis=0)
            self.levels[w] = out
            self.levels[-w] = at

    def may_link(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the bound allows each pair (a[i], b[i])."""
        p, na, nb = self.percent, self.n[a], self.n[b]
        ok = 100 * np.minimum(na, nb) >= p * np.maximum(na, nb)
        at = np.flatnonzero(ok)
        if not len(at):
            return ok
        a, b, both = a[at], b[at], na[at] + nb[at]
        least = -(-p * both // (100 + p))
        most = both - 2 * least
        width = np.minimum(self.width[a], self.width[b])
        for w in np.unique(width).tolist():
            here = np.flatnonzero(width == w)
            rows, place = self.levels[w], self.levels[-w]
            for lo in range(0, len(here), 65_536):
                i = here[lo : lo + 65_536]
                bits = np.bitwise_count(rows[place[a[i]]] ^ rows[place[b[i]]]).sum(1, dtype=np.int64)
                ok[at[i[bits > most[i]]]] = False
        return ok


def linked(n: int, test) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph whose links test(i, others) gives.

    A search visits each row once and asks only about rows not yet reached, so a group of
    mutual copies costs one question a row and no pair is written out.
    """
    rest, edges, queue = np.arange(n), [], []
    while len(rest) or queue:
        if not queue:
            queue, rest = [int(rest[0])], rest[1:]
        i = queue.pop()
        if len(rest):
            hit = test(i, rest)
            for j in rest[hit].tolist():
                edges.append((i, j))
                queue.append(j)
            rest = rest[~hit]
    return edges


def _long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _sets(docs: DataFrame, k: int, below: int, carry: tuple) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("low", pa.list_(pa.int64())), *fields(carry)])

    def run(batches):
        from xxhash import xxh3_128_intdigest

        for ids, texts, *rest in rows_of(batches, "doc_id", "text", *carry):
            for at in range(0, len(ids), 256):
                n, c1, c2, low = [], [], [], []
                for t in texts[at : at + 256]:
                    s = shingle_set(t, k)
                    x = xxh3_128_intdigest(s.tobytes())
                    n.append(len(s))
                    c1.append((x >> 64) - (1 << 63))
                    c2.append((x & (1 << 64) - 1) - (1 << 63))
                    low.append(_long(s[: np.searchsorted(s, np.uint64(below))]))
                yield batch(schema, ids[at : at + 256], n, c1, c2, low, *[r[at : at + 256] for r in rest])

    return id_text(docs, *carry).mapInArrow(run, "doc_id long, n long, c1 long, c2 long, low array<long>" + ddl(carry))


def _shared_bits(spark: SparkSession, repeated: DataFrame, n: int):
    """A bitmap of hashed places that tokens found twice or more occupy; at most 32 MB, so it may let singles through."""
    power = min(28, max(17, int(np.ceil(np.log2(16 * max(1, n))))))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(1 << 16, np.uint8)
        bits[(pdf["token"].to_numpy(np.int64) & 0xFFFF)] = 1
        return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    chunks = repeated.select("token", F.expr(f"cast((token & {(1 << power) - 1}) >> 16 as int)").alias("chunk"))
    whole = np.zeros(1 << (power - 3), np.uint8)
    # at most 4,096 chunks of 8 kB, in one job
    for r in chunks.groupBy("chunk").applyInPandas(build, "chunk int, bits binary").collect():
        whole[r.chunk << 13 : (r.chunk + 1) << 13] = np.frombuffer(r.bits, np.uint8)
    return spark.sparkContext.broadcast((power, whole.tobytes()))


def _postings(texts: DataFrame, k: int, percent: int, below: int, hot, shared) -> DataFrame:
    """(key, node, n, bits): a row for each set and shingle in which it may meet a partner."""
    schema = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("bits", pa.binary())])

    def run(batches):
        tokens = hot.value
        power, raw = shared.value
        place = np.frombuffer(raw, np.uint8)
        for ids, texts_ in rows_of(batches, "doc_id", "text"):
            for at in range(0, len(ids), 128):
                keys, nodes, ns, bits = [], [], [], []
                for d, t in zip(ids[at : at + 128], texts_[at : at + 128]):
                    s = shingle_set(t, k)
                    whole, n = s, len(s)
                    if not n:
                        continue
                    is_hot = np.zeros(n, bool)
                    if len(tokens):
                        is_hot = tokens[np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)] == s
                    s = s[np.argsort(is_hot, kind="stable")[: n + (-percent * n // 100) + 1]]
                    low = (s & np.uint64((1 << power) - 1)).astype(np.int64)
                    keep = (s >= np.uint64(below)) | ((place[low >> 3] >> (low & 7).astype(np.uint8)) & 1 == 1)
                    mine = s[keep]
                    keys.append(mine)
                    nodes += [d] * len(mine)
                    ns += [n] * len(mine)
                    bits += [parity_bits(whole).tobytes()] * len(mine) if len(mine) else []
                if keys:
                    yield batch(schema, pa.array(_long(np.concatenate(keys))), nodes, ns, bits)

    return texts.mapInArrow(run, "key long, node long, n long, bits binary")


def _split(postings: DataFrame) -> DataFrame:
    """postings with each key of over TILE_ROWS rows replaced by keys of its pairs of blocks; a row goes to every pair of its block."""
    rows = postings.groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > TILE_ROWS)
    # a TILE_ROWS-th of all postings at most
    large = F.broadcast(rows.select(F.col("key").alias("large"), F.ceil(F.col("rows") / TILE_ROWS).cast("int").alias("blocks")))
    found = postings.join(large, F.col("key") == F.col("large"), "left")
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.xxhash64("key", F.least(mine, j), F.greatest(mine, j)))
    return found.select(F.explode(F.when(F.col("blocks").isNull(), F.array("key")).otherwise(pairs)).alias("key"), "node", "n", "bits")


def _tile_links(postings: DataFrame, percent: int, partitions: int) -> DataFrame:
    """(a, b): in each tile, edges that join the rows whose bound allows a link."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(key, node, n, bits):
        cut = np.flatnonzero(key[1:] != key[:-1]) + 1
        lo, hi = np.concatenate([[0], cut]), np.concatenate([cut, [len(key)]])
        size = hi - lo
        if not (size > 1).any():
            return None
        used = np.flatnonzero(np.repeat(size > 1, size))
        sk = Sketches(n[used], [np.frombuffer(bits[i], np.uint64) for i in used.tolist()], percent)
        key, node = key[used], node[used]
        out = []
        small = np.repeat(size[size > 1] <= 32, size[size > 1])
        for d in range(1, 32):
            i = np.flatnonzero((key[d:] == key[:-d]) & small[d:]) if d < len(key) else ()
            if not len(i):
                break
            i = i[sk.may_link(i, i + d)]
            out.append(np.stack([node[i], node[i + d]]))
        starts = np.cumsum(size[size > 1]) - size[size > 1]
        for s, m in zip(starts[size[size > 1] > 32].tolist(), size[size > 32].tolist()):
            got = linked(m, lambda i, rest: sk.may_link(np.full(len(rest), s + i), s + rest))
            if got:
                out.append(node[s + np.array(got).T])
        return np.concatenate(out, axis=1) if out else None

    def run(batches):
        held = None
        for b in batches:
            now = [b.column(i) for i in range(4)]
            now = [c.to_numpy() for c in now[:3]] + [now[3].to_pylist()]
            if held:
                now = [np.concatenate([h, c]) for h, c in zip(held[:3], now[:3])] + [held[3] + now[3]]
            last = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0
            held = [c[last:] for c in now]
            got = links(*[c[:last] for c in now]) if last else None
            if got is not None:
                yield batch(schema, pa.array(got[0]), pa.array(got[1]))
        got = links(*held) if held and len(held[0]) else None
        if got is not None:
            yield batch(schema, pa.array(got[0]), pa.array(got[1]))

    dealt = postings.repartition(partitions, "key").sortWithinPartitions("key", "n", "node")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _exact_links(spark: SparkSession, texts: DataFrame, loose: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): edges of spanning forests of the true links inside loose groups (node, n, comp)."""
    room = loose.groupBy("comp").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / GROUP_WORDS)).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    rows = loose.join(room, "comp").select("node", "comp", part.alias("p"), other.alias("q"))
    rows = rows.select("node", "comp", F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"))
    rows = texts.join(rows, F.col("doc_id") == F.col("node")).select("node", "text", "comp", "p", "q")

    def check(pdf: pd.DataFrame) -> pd.DataFrame:
        node = pdf["node"].to_numpy(np.int64)
        sets = [shingle_set(t, k) for t in pdf["text"]]
        order = sorted(range(len(node)), key=lambda i: (len(sets[i]), node[i]))
        node, sets = node[order], [sets[i] for i in order]
        sk = Sketches(np.array([len(s) for s in sets]), [parity_bits(s) for s in sets], percent)

        def test(i, rest):
            ok = sk.may_link(np.full(len(rest), i), rest)
            for j in np.flatnonzero(ok).tolist():
                x, y = sets[i], sets[rest[j]]
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                common = int((y[at] == x).sum())
                ok[j] = 100 * common >= percent * (len(x) + len(y) - common)
            return ok

        edges = linked(len(node), test)
        a, b = node[[e[0] for e in edges]], node[[e[1] for e in edges]]
        return pd.DataFrame({"a": a, "b": b}, dtype="int64")

    return rows.groupBy("comp", "p", "q").applyInPandas(check, "a long, b long")


def near_duplicates(spark: SparkSession, docs: DataFrame, k: int = 5, percent: int = 80, carry: tuple = ()) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of docs, and its binary columns `carry`: component_id is the smallest doc_id reachable by links.

    Two documents link when 100 * |intersection| >= percent * |union| of their
    sets of k-word shingles.  No link is lost: the prefix, the size band and
    the bitmaps only pass over pairs that can't link.

    A null text, or one without words, has an empty set and is linked with nothing.
    With fewer than k words the whole sequence is one shingle.  Equal sets link.
    Rows repeated under one doc_id are one document.  A null doc_id counts as a
    document without partners.  An empty table gives no rows.  Only doc_id and text are read.
    """
    below = int((1 << 64) * min(0.9, (100 - percent) / 100 + 0.1))
    sets = stored(spark, _sets(docs, k, below, carry), "jaccard-sets")
    classes = sets.where("n > 0 and doc_id is not null").groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"))
    classes = stored(spark, classes, "jaccard-classes")

    df = sets.select(F.explode("low").alias("token")).groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    df = stored(spark, df, "jaccard-repeated")
    total = df.agg(F.count("*").alias("n"), F.coalesce(F.sum("df"), F.lit(0)).alias("rows")).first()
    least = max(48, -(-total.rows // MOST_HOT))
    frequent = df.where(F.col("df") >= least).select("token").toPandas()
    tokens = frequent["token"].to_numpy(np.int64).view(np.uint64)
    hot = spark.sparkContext.broadcast(np.sort(tokens))
    shared = _shared_bits(spark, df.select("token"), total.n)

    source = id_text(docs).dropna(subset=["doc_id"])
    reps = classes.select(F.col("rep").alias("doc_id"))
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    postings = _postings(source.join(reps, "doc_id", "left_semi"), k, percent, below, hot, shared)
    postings = stored(spark, postings, "jaccard-postings")
    edges = stored(spark, _tile_links(_split(postings), percent, partitions), "jaccard-loose")
    discard(spark, postings)
    loose = components(spark, edges).join(classes.select(F.col("rep").alias("node"), "n"), "node")
    found = stored(spark, _exact_links(spark, source, loose, k, percent), "jaccard-links")
    comps = components(spark, found)

    named = classes.join(comps, F.col("rep") == F.col("node"), "left").select(
        F.col("c1").alias("k1"), F.col("c2").alias("k2"), F.coalesce("comp", "rep").alias("component")
    )
    return sets.join(named, (F.col("c1") == F.col("k1")) & (F.col("c2") == F.col("k2")) & F.col("doc_id").isNotNull(), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), *carry
    )


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4, percent=85)
