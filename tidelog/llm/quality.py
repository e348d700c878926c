"""Operator 1: quality classifier, a regularised quadratic discriminant over document statistics.

Each whole text becomes a few transformed statistics.  Class means and
covariances come from sums over all labelled training rows; covariances are shrunk
towards their diagonal, and Cholesky factors are computed once.  A score is the
logistic of the difference of the two Gaussian log-densities.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, ddl, fields, id_text, rows_of, stored

FEATURES = (
    "log_bytes", "log_words", "word_length", "word_spread", "distinct", "top_word", "adjacent", "upper", "digit", "symbol",
    "punctuation", "wide", "space", "entropy", "log_lines", "line_repeat", "line_length", "symbol_words", "upper_words", "stop_like",
)
_KIND = np.zeros(256, np.int64)  # 0 lower, 1 upper, 2 digit, 3 symbol, 4 plain punctuation, 5 white, 6 wide
_KIND[33:127] = 3
_KIND[97:123] = 0
_KIND[65:91] = 1
_KIND[48:58] = 2
for _c in b".,;:'\"()-?":
    _KIND[_c] = 4
_KIND[:33] = 5
_KIND[127:] = 6


def _rate(x: float) -> float:
    """A share in [0, 1] on a stretched scale that is finite at both ends."""
    return math.log((x + 0.002) / (1.002 - x))


def statistics(text: bytes) -> list[float]:
    """FEATURES of a whole text; defined for the empty one."""
    n = len(text)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    kind = np.bincount(_KIND, weights=counts, minlength=7) / max(1, n)
    p = counts[counts > 0] / max(1, n)
    words = text.split()
    m = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    seen = Counter(words)
    lines = text.split(b"\n")
    odd = sum(v for w, v in seen.items() if not w[-1:].isalnum() and w[-1] < 128 and w[-1:] not in (b".", b",", b";", b":"))
    shout = sum(v for w, v in seen.items() if len(w) > 1 and w.isupper())
    short = sum(v for w, v in seen.items() if len(w) <= 3)
    return [
        math.log1p(n),
        math.log1p(len(words)),
        math.log1p(float(lengths.mean())),
        math.log1p(float(lengths.std())),
        _rate(len(seen) / m),
        _rate(max(seen.values(), default=0) / m),
        _rate(sum(map(bytes.__eq__, words, words[1:])) / m),
        _rate(float(kind[1])),
        _rate(float(kind[2])),
        _rate(float(kind[3])),
        _rate(float(kind[4])),
        _rate(float(kind[6])),
        _rate(float(kind[5])),
        float(-(p * np.log2(p)).sum()) if n else 0.0,
        math.log1p(len(lines)),
        _rate(1 - len(set(lines)) / len(lines)),
        math.log1p(n / len(lines)),
        _rate(odd / m),
        _rate(shout / m),
        _rate(short / m),
    ]


def features(docs: DataFrame, carry: tuple = ()) -> DataFrame:
    """(doc_id, x): statistics of each whole text.  doc_id and the binary columns `carry` are carried, never used."""
    schema = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.float64())), *fields(carry)])

    def run(batches):
        for ids, texts, *rest in rows_of(batches, "doc_id", "text", *carry):
            yield batch(schema, ids, [statistics(t) for t in texts], *rest)

    return id_text(docs, *carry).mapInArrow(run, "doc_id long, x array<double>" + ddl(carry))


@dataclass
class Discriminant:
    """Two shrunk Gaussians with cached Cholesky factors, and the log prior odds of class 1."""

    means: list[np.ndarray]
    inverse: list[np.ndarray]  # inverse of the lower Cholesky factor
    log_det: list[float]
    odds: float
    scale: float

    @classmethod
    def fit(cls, n: list[float], total: list[np.ndarray], square: list[np.ndarray], shrink: float, floor: float = 1e-3, scale: float = 0.25) -> Discriminant:
        """From sums: rows, their vectors, and their outer products, per class.

        The covariance is shrunk by `shrink` towards its diagonal, blended with the
        pooled diagonal by 1 / (1 + n / 50), and `floor` is added.  A class without
        rows takes the pooled sums, and the odds alone decide.
        """
        d = len(FEATURES)
        pooled_n = max(1.0, sum(n))
        mean = sum(total) / pooled_n
        pooled = np.diag(sum(square) / pooled_n - np.outer(mean, mean)).clip(0)
        means, inverse, log_det = [], [], []
        for k in (0, 1):
            m = total[k] / n[k] if n[k] else mean
            cov = square[k] / n[k] - np.outer(m, m) if n[k] else np.diag(pooled)
            own = np.diag(cov).clip(0)
            few = 1 / (1 + n[k] / 50)
            cov = (1 - shrink) * cov + shrink * np.diag(own)
            cov = (1 - few) * cov + few * np.diag(pooled) + floor * np.eye(d)
            low = np.linalg.cholesky(cov)
            means.append(m)
            inverse.append(np.linalg.inv(low))
            log_det.append(float(np.log(np.diag(low)).sum()))
        return cls(means, inverse, log_det, math.log((n[1] + 1) / (n[0] + 1)), scale)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Chance of class 1.  The log-density difference is scaled: statistics of a text aren't Gaussian, and sums of them overstate."""
        part = [-0.5 * (((x - m) @ inv.T) ** 2).sum(1) - ld for m, inv, ld in zip(self.means, self.inverse, self.log_det)]
        z = self.scale * (part[1] - part[0]) + self.odds
        return 1 / (1 + np.exp(-z.clip(-700, 700)))


def held_out(doc_id) -> F.Column:
    """Rows whose crc32 of the doc_id as text leaves 2 modulo 4 aren't trained on; a null doc_id is none of them."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(feats: DataFrame, labels: DataFrame, shrink: float = 0.1) -> Discriminant:
    """From all labelled rows that aren't held out; sums are made in parallel, a row a task reaches the driver's grouping."""
    d = len(FEATURES)
    marks = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("quality").cast("int").alias("quality"))
    rows = feats.join(marks.where("quality in (0, 1)"), F.col("doc_id") == F.col("label_id")).where(~held_out("doc_id"))
    schema = pa.schema([("quality", pa.int32()), ("i", pa.int32()), ("v", pa.float64())])

    def sums(batches):
        acc = np.zeros((2, 1 + d + d * d))
        for x, y in rows_of(batches, "x", "quality"):
            if x:
                x, y = np.array(x), np.array(y)
                for k in (0, 1):
                    z = x[y == k]
                    acc[k] += np.concatenate([[len(z)], z.sum(0), (z.T @ z).ravel()])
        for k in (0, 1):
            yield batch(schema, [k] * acc.shape[1], list(range(acc.shape[1])), acc[k].tolist())

    parts = rows.select("x", "quality").mapInArrow(sums, "quality int, i int, v double").groupBy("quality", "i").agg(F.sum("v").alias("v"))
    acc = np.zeros((2, 1 + d + d * d))
    for r in parts.collect():
        acc[r.quality, r.i] = r.v
    return Discriminant.fit([float(a[0]) for a in acc], [a[1 : 1 + d] for a in acc], [a[1 + d :].reshape(d, d) for a in acc], shrink)


def scored(feats: DataFrame, model: Discriminant, threshold: float = 0.7, carry: tuple = ()) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), *fields(carry)])

    def run(batches):
        for ids, x, *rest in rows_of(batches, "doc_id", "x", *carry):
            if ids:
                yield batch(schema, ids, model.score(np.array(x)).tolist(), *rest)

    out = feats.select("doc_id", "x", *carry).mapInArrow(run, "doc_id long, score double" + ddl(carry))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *carry)


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.7, carry: tuple = ()) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for each row of docs, and its binary columns `carry`.

    Only the text is an input of a score.  Texts are read once; statistics (20
    numbers a document) are stored and used for both the fit and the scores.

    Nulls: a null text scores as the empty one; a null doc_id gets a score and no
    label; labels other than 0 and 1 are left out.  A doc_id with several labels counts
    with each.  Without labels all scores are 0.5.  An empty table gives no rows.
    """
    feats = stored(spark, features(docs, carry), "quality-stats")
    return scored(feats, fit(feats, labels), threshold, carry)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def crc_fold(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % 4
