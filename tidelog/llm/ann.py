"""Operator 5: approximate nearest neighbours by learned partitions.

On a bounded sample a neighbour graph is built and split into balanced parts with few cut
edges.  A small classifier learns a vector's part.  Every row is indexed under its most
probable part; a query goes to several of its most probable parts, whose rows are
ranked by their exact inner products.  How many parts a query asks is measured: a bounded
set of rows that the classifier was not fit on is searched in the whole table, and the
fewest parts that hold the wanted share of their true neighbours are asked.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

#: Rows that the partition is learned from, picked by a hash of their id: the bound of the fit.
SAMPLE = 8192
#: Rows, none of them in the sample, whose true neighbours set the number of parts asked.
ASKED = 256
#: Parts lie in so many bins; a task ranks a block of a bin's rows, so a query's finds leave it once for all its parts there.
BINS, BLOCK_ROWS, BLOCK_QUERIES = 8, 16_384, 8192


def usable(vectors: DataFrame, key: str = "vec_id", value: str = "embedding") -> DataFrame:
    """(vec_id, v, d) of vectors of d numbers that are neither null nor zero and hold only finite numbers."""
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(value).cast("array<double>").alias("v"))
    rows = rows.where(
        F.col("vec_id").isNotNull()
        & F.col("v").isNotNull()
        & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
        & F.exists("v", lambda x: x != 0)
    )
    return rows.withColumn("d", F.size("v"))


def balanced_parts(x: np.ndarray, parts: int, neighbours: int = 16, rounds: int = 12) -> np.ndarray:
    """A balanced partition of the inner-product neighbour graph: halving along main directions, then moves of
    rows to the part that holds most of their neighbours, while it has room."""
    n = len(x)
    near = np.empty((n, min(neighbours, n - 1)), np.int64)
    for lo in range(0, n, 1024):
        sim = x[lo : lo + 1024] @ x.T
        sim[np.arange(len(sim)), lo + np.arange(len(sim))] = -np.inf
        near[lo : lo + 1024] = np.argpartition(-sim, near.shape[1] - 1, axis=1)[:, : near.shape[1]]
    part, todo, given = np.zeros(n, np.int64), [(np.arange(n), parts)], 0
    while todo:
        rows, k = todo.pop()
        if k == 1:
            part[rows] = given
            given += 1
            continue
        z = x[rows] - x[rows].mean(0)
        along = z @ np.linalg.svd(z.T @ z)[0][:, 0]
        order = rows[np.argsort(along, kind="stable")]
        cut = len(order) * (k // 2) // k
        todo += [(order[cut:], k - k // 2), (order[:cut], k // 2)]
    most = math.ceil(1.1 * n / parts)
    size = np.bincount(part, minlength=parts)
    for _ in range(rounds):
        votes = np.zeros((n, parts), np.int32)
        for j in range(near.shape[1]):
            np.add.at(votes, (np.arange(n), part[near[:, j]]), 1)
            np.add.at(votes, (near[:, j], part), 1)
        best = votes.argmax(1)
        gain = votes[np.arange(n), best] - votes[np.arange(n), part]
        moved = 0
        for i in np.argsort(-gain, kind="stable").tolist():
            if gain[i] <= 0:
                break
            if size[best[i]] < most:
                size[part[i]] -= 1
                size[best[i]] += 1
                part[i] = best[i]
                moved += 1
        if not moved:
            break
    return part


class Router:
    """A classifier with one hidden layer: the chance of each part for a vector."""

    def __init__(self, weights: list[np.ndarray]):
        self.weights = weights

    @classmethod
    def fit(cls, x: np.ndarray, part: np.ndarray, parts: int, hidden: int = 128, epochs: int = 40, seed: int = 5) -> Router:
        rng = np.random.default_rng(seed)
        scale = 1 / max(1e-12, float(np.abs(x).std()))
        w = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(2 / hidden), (hidden, parts)), np.zeros(parts)]
        m, v, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for lo in range(0, len(x), 256):
                i = order[lo : lo + 256]
                a = x[i] * scale
                h = np.maximum(0, a @ w[0] + w[1])
                z = h @ w[2] + w[3]
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(i)), part[i]] -= 1
                p /= len(i)
                back = (p @ w[2].T) * (h > 0)
                t += 1
                for k, g in enumerate((a.T @ back, back.sum(0), h.T @ p, p.sum(0))):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    w[k] = w[k] - 0.003 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        w[0] = w[0] * scale
        return cls(w)

    def logits(self, x: np.ndarray) -> np.ndarray:
        w = self.weights
        return np.maximum(0, x @ w[0] + w[1]) @ w[2] + w[3]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64)


def _depths(placed: DataFrame, ids: np.ndarray, ask: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """For each of the true k neighbours, among all rows, of the vectors `ask`: its part's place (0 first) in the asker's order."""

    def best(batches):
        score = np.full((len(ask), k), -np.inf)
        vec, part = np.zeros(score.shape, np.int64), np.zeros(score.shape, np.int64)
        for pdf in batches:
            if not len(pdf):
                continue
            sim = ask @ _matrix(pdf["v"]).T
            here = pdf["vec_id"].to_numpy(np.int64)
            sim[ids[:, None] == here[None, :]] = -np.inf
            all_ = np.hstack([score, sim])
            top = np.argpartition(-all_, k - 1, axis=1)[:, :k]
            wide = lambda kept, new: np.take_along_axis(np.hstack([kept, np.broadcast_to(new, sim.shape)]), top, 1)
            vec, part = wide(vec, here), wide(part, pdf["part"].to_numpy(np.int64))
            score = np.take_along_axis(all_, top, 1)
        q, j = np.nonzero(score > -np.inf)
        yield pd.DataFrame({"q": q, "vec_id": vec[q, j], "part": part[q, j], "score": score[q, j]})

    found = placed.select("vec_id", "v", "part").mapInPandas(best, "q long, vec_id long, part long, score double")
    first = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    # at most ASKED * k rows
    rows = found.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k).select("q", "part").toPandas()
    return place[rows["q"].to_numpy(np.int64), rows["part"].to_numpy(np.int64)]


def _top(q: np.ndarray, qid: np.ndarray, asks: np.ndarray, x: np.ndarray, ids: np.ndarray, part: np.ndarray, k: int) -> pd.DataFrame:
    """Each query's k best rows in the parts that it asks (asks[query, part]), by exactly rounded inner products, ties to the smaller id."""
    order = np.lexsort((ids, part))
    x, ids, part = x[order], ids[order], part[order]
    # of equal vectors (all in one part) only the smallest ids can be among the k best; one more for the query's own row
    _, group = np.unique(x, axis=0, return_inverse=True)
    group = group.ravel()
    by = np.argsort(group, kind="stable")
    start = np.searchsorted(group[by], group[by])
    keep = np.sort(by[np.arange(len(by)) - start <= k])
    x, ids, part = x[keep], ids[keep], part[keep]
    cuts = [(int(p), int(np.searchsorted(part, p)), int(np.searchsorted(part, p, "right"))) for p in np.unique(part)]
    out = []
    for lo in range(0, len(q), 256):
        mine, asked = q[lo : lo + 256], asks[lo : lo + 256]
        sim = np.full((len(mine), len(x)), -np.inf)
        for p, a, b in cuts:
            at = np.flatnonzero(asked[:, p])
            if len(at):
                sim[at, a:b] = mine[at] @ x[a:b].T
        for v, i, s in zip(mine, qid[lo : lo + 256], sim):
            s[ids == i] = -np.inf
            near = np.flatnonzero(s > -np.inf)
            if len(near) > k:
                least = np.partition(s, len(s) - k)[len(s) - k]
                near = np.flatnonzero(s >= least - 1e-9 * (1 + abs(least)))
            exact = [(-math.fsum((v * x[j]).tolist()), int(ids[j])) for j in near.tolist()]
            out += [(int(i), j, -e) for e, j in sorted(exact)[:k]]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})


def nearest(
    spark: SparkSession, vectors: DataFrame, every: int = 20, k: int = 20, part_rows: int = 1024, most_parts: int = 128, wanted: float = 0.93, report: dict | None = None
) -> DataFrame:
    """(query_id, rank, vec_id, score): for rows whose vec_id is divisible by `every`, their k nearest by inner product.

    The router is learned from SAMPLE rows at most; every row is indexed.  Asked are as many parts as hold
    `wanted` of the true neighbours of ASKED rows, and more where these hold fewer than k rows.  A bin's
    rows and queries meet in blocks of bounded size, so a part (or one vector
    repeated in a third of all rows) is spread over tasks.  `report` gets, by dimension: rows, parts, asked, recall.

    Vectors that are null, zero, or hold null or non-finite numbers take no part; nor do rows without
    a vec_id.  Vectors of each dimension are searched among their own kind.  Rows repeated whole count once; rows
    with one vec_id and several vectors are several candidates, and never their own query's.
    An empty table gives no rows.  Other columns are not read.
    """
    rows = stored(spark, usable(vectors).distinct(), "ann-rows")
    asking = F.count_if(F.col("vec_id") % every == 0).alias("asking")
    # a row for each dimension that vectors have
    kinds = rows.groupBy("d").agg(F.count("*").alias("n"), asking).where("asking > 0").orderBy("d").collect()
    found = [_nearest(spark, rows.where(F.col("d") == r.d).select("vec_id", "v"), r.n, every, k, part_rows, most_parts, wanted, report) for r in kinds]
    out = found[0] if found else spark.createDataFrame([], "query_id long, vec_id long, score double")
    for df in found[1:]:
        out = out.unionByName(df)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _nearest(spark: SparkSession, rows: DataFrame, n: int, every: int, k: int, part_rows: int, most_parts: int, wanted: float, report: dict | None) -> DataFrame:
    """(query_id, vec_id, score) of n vectors of one dimension: k for each query and block of rows that it meets."""
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(ASKED + SAMPLE).toPandas()
    x, ids = _matrix(picked["v"]), picked["vec_id"].to_numpy(np.int64)
    held = min(ASKED, len(x) // 5)
    parts = int(max(1, min(most_parts, max(2, n // part_rows), (len(x) - held) // 16)))
    sample = x[held : held + SAMPLE]
    if parts > 1:
        router = Router.fit(sample, balanced_parts(sample, parts), parts)
    else:
        router = Router([np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)])
    sent = spark.sparkContext.broadcast(router)

    def place(batches):
        for pdf in batches:
            if len(pdf):
                order = np.argsort(-sent.value.logits(_matrix(pdf["v"])), axis=1, kind="stable")
                asks = [o.tolist() if i % every == 0 else None for i, o in zip(pdf["vec_id"], order)]
                yield pdf.assign(part=order[:, 0].astype(np.int32), asks=asks)

    placed = stored(spark, rows.mapInPandas(place, "vec_id long, v array<double>, part int, asks array<int>"), "ann-index")
    size = np.zeros(parts, np.int64)
    for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect():
        size[r.part] = r.n
    own = placed.groupBy("vec_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    probes, recall = parts, 1.0
    if parts > 1:
        order = np.argsort(-router.logits(x[:held]), axis=1, kind="stable")
        to = np.empty_like(order)
        np.put_along_axis(to, order, np.arange(parts)[None, :], 1)
        depths = _depths(placed, ids[:held], x[:held], to, k)
        share = np.cumsum(np.bincount(depths, minlength=parts)) / max(1, len(depths))
        probes = min(parts, int(np.searchsorted(share, wanted)) + 1)
        recall = float(share[probes - 1]) if len(depths) else 1.0
    if report is not None:
        report[x.shape[1]] = {"rows": n, "parts": parts, "asked": probes, "recall": recall}

    def ask(batches):
        for pdf in batches:
            out = []
            for i, q, order in zip(pdf["vec_id"], pdf["v"], pdf["asks"]):
                order = np.asarray(order)
                enough = int(np.searchsorted(np.cumsum(size[order]), k + own)) + 1
                mine = order[: max(probes, enough)]
                for b in np.unique(mine % BINS).tolist():
                    out.append((i, q, b, mine[mine % BINS == b].tolist()))
            yield pd.DataFrame(out, columns=["query_id", "q", "bin", "parts"])

    index = placed.select("vec_id", "v", "part", F.pmod("part", F.lit(BINS)).alias("bin"))
    queries = placed.where(F.col("asks").isNotNull()).mapInPandas(ask, "query_id long, q array<double>, bin int, parts array<int>")
    queries = stored(spark, queries, "ann-queries")
    # a row for each bin
    rooms = index.groupBy("bin").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("rb"))
    asked = queries.groupBy("bin").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("qb"))
    rooms = F.broadcast(stored(spark, rooms.join(asked, "bin"), "ann-rooms"))
    dealt = lambda c, b: F.pmod(F.xxhash64(c), F.col(b)).cast("int")
    every_of = lambda b: F.explode(F.sequence(F.lit(0), F.col(b) - 1))
    left = index.join(rooms, "bin").select("bin", dealt("vec_id", "rb").alias("r"), every_of("qb").alias("s"), "vec_id", "v", "part")
    right = queries.join(rooms, "bin").select("bin", every_of("rb").alias("r"), dealt("query_id", "qb").alias("s"), "query_id", "q", "parts")

    def rank(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})
        asks = np.zeros((len(b), parts), bool)
        for i, mine in enumerate(b["parts"]):
            asks[i, mine] = True
        return _top(_matrix(b["q"]), b["query_id"].to_numpy(np.int64), asks, _matrix(a["v"]), a["vec_id"].to_numpy(np.int64), a["part"].to_numpy(np.int64), k)

    on = ["bin", "r", "s"]
    return left.groupBy(*on).cogroup(right.groupBy(*on)).applyInPandas(rank, "query_id long, vec_id long, score double")


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
