"""What the training-data operators share: words, shared scratch tables, components.

A word is a run of ``[^\\x20\\x09-\\x0D]+``.  On UTF-8 bytes that is exactly what
``bytes.split()`` yields, and ``bytes.lower()`` maps A-Z only, so the Python
sides of the operators work on the bytes of whole texts.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WORD = "[^\\x20\\x09-\\x0D]+"


#: Folders of stored tables, in the order of writing; empty where discarded.
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or the checkpoint folder set on the context."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return base


def stored(spark: SparkSession, df: DataFrame, tag: str, codec: str = "snappy", by: str | None = None) -> DataFrame:
    """df written to the shared folder, in folders by the column `by` if named, and read back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    out = df.write.option("compression", codec)
    (out.partitionBy(by) if by else out).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._stored_at = path
    return back


def _delete(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete the files of stored() tables that nothing lazy still reads."""
    for df in frames:
        _delete(spark, df._stored_at)
        _WRITTEN[:] = ["" if path == df._stored_at else path for path in _WRITTEN]


def written() -> int:
    """A mark for sweep(): how many tables have been stored so far."""
    return len(_WRITTEN)


def sweep(spark: SparkSession, since: int, *keep: DataFrame) -> None:
    """Delete the tables stored since a mark but those to keep: for when all that read them has been stored."""
    kept = {df._stored_at for df in keep}
    for i in range(since, len(_WRITTEN)):
        if _WRITTEN[i] and _WRITTEN[i] not in kept:
            _delete(spark, _WRITTEN[i])
            _WRITTEN[i] = ""


def columns_of(df: DataFrame) -> list[np.ndarray]:
    """The columns of a table of checked size on the driver, by Arrow: no Python object for each row."""
    table = df.toArrow()
    return [c.combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64) for c in table.columns]


def keyed(docs: DataFrame) -> DataFrame:
    """docs with `__row`, a 128-bit hash of all columns: rows that share it are alike in everything, null or repeated doc_ids or not.

    Operators return it if told to carry it, so that what they say of a row is joined to that row.  The
    columns are hashed where they lie, by two seeds; which of them are null goes in too, since a null leaves a hash as it is.
    """
    columns = [F.col(c) for c in docs.columns]
    nulls = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in columns])
    halves = [F.lpad(F.hex(F.xxhash64(F.lit(seed), nulls, *columns)), 16, "0") for seed in (1, 2)]
    return docs.withColumn("__row", F.unhex(F.concat(*halves)))


def id_text(docs: DataFrame, *carry: str) -> DataFrame:
    """doc_id and the UTF-8 bytes of the text; a null text counts as empty.  Binary columns to carry follow."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"),
        *carry,
    )


def rows_of(batches, *names, most: int = 1024):
    """Python values of the named columns, at most so many rows at a time."""
    for whole in batches:
        for at in range(0, whole.num_rows, most):
            b = whole.slice(at, most)
            yield [b.column(b.schema.get_field_index(n)).to_pylist() for n in names]


def ddl(carry) -> str:
    return "".join(f", {c} binary" for c in carry)


def fields(carry) -> list:
    return [(c, pa.binary()) for c in carry]


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema
    )


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, vectorised (splitmix64's constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\x0b\x0c\r")] = True
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD)]
#: Words up to so many bytes are hashed eight bytes at a time, all texts' words together; longer ones by the library, one by one.
_SHORT = 64
_LOW_BYTES = np.array([(1 << 8 * i) - 1 for i in range(8)], np.uint64)


def stirred(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes, order kept; neither linear nor polynomial in them."""
    x = a * _ODD[0]
    x ^= x >> np.uint64(29)
    x += b
    x *= _ODD[1]
    x ^= x >> np.uint64(32)
    x *= _ODD[2]
    x ^= x >> np.uint64(31)
    return x


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a whole text, without a Python object for each word of up to 64 bytes."""
    if not text:
        return np.empty(0, np.uint64)
    raw = np.frombuffer(text + bytes(8), np.uint8)
    inside = np.zeros(len(text) + 2, np.int8)
    inside[1:-1] = ~_SPACE[raw[: len(text)]]
    step = np.diff(inside)
    lo, size = np.flatnonzero(step == 1), None
    size = np.flatnonzero(step == -1) - lo
    # eight bytes from each place of the text, little-endian
    eight = np.lib.stride_tricks.as_strided(raw, (len(text) + 1, 8), (1, 1))
    out = size.astype(np.uint64)
    at, left, which = lo, size, slice(None)
    for _ in range(_SHORT // 8):
        if not len(at):
            break
        part = np.ascontiguousarray(eight[at]).view("<u8").ravel()
        part = np.where(left < 8, part & _LOW_BYTES[np.minimum(left, 7)], part)
        out[which] = stirred(out[which], part)
        more = np.flatnonzero(left > 8)
        which = more if isinstance(which, slice) else which[more]
        at, left = at[more] + 8, left[more] - 8
    if (size > _SHORT).any():
        from xxhash import xxh3_64_intdigest

        for i in np.flatnonzero(size > _SHORT).tolist():
            out[i] = xxh3_64_intdigest(text[lo[i] : lo[i] + size[i]], seed=0x5EED)
    return out


def rolled(h: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """A hash of each k consecutive word hashes, of pieces whose lengths are powers of two."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, done, piece, size = np.full(n, salt + k, np.uint64), 0, h, 1
    while size <= k:
        if k & size:
            out = stirred(out, piece[done : done + n])
            done += size
        if 2 * size <= k:
            piece = stirred(piece[: len(piece) - size], piece[size:])
        size *= 2
    return out


def _with_least(spark: SparkSession, rows: DataFrame, most: int, hub_rows: int) -> tuple[DataFrame, list[DataFrame]]:
    """rows (u, v) with m, the least v of their u; and the tables that were stored for it.

    rows are at most `most`: where that is below hub_rows no u can have more, and a window is the whole plan.  Else
    a u with over hub_rows rows doesn't gather them in a task: its minimum is sent to where they lie.  There are
    fewer such u than rows / hub_rows, so what is broadcast is 16 bytes for every hub_rows rows at most.
    They are stored first, and rows should be: the driver holds the plan of a round many times over, so it must stay small.
    """
    gathered = lambda df: df.select("u", "v", F.min("v").over(Window.partitionBy("u")).alias("m"))
    if most <= hub_rows:
        return gathered(rows), []
    hubs = rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).where(F.col("n") > hub_rows)
    hubs = stored(spark, hubs.select(F.col("u").alias("hub"), "m"), "hubs")
    if hubs.isEmpty():
        return gathered(rows), [hubs]
    sent = F.broadcast(hubs)
    rest = gathered(rows.join(sent, F.col("u") == F.col("hub"), "left_anti"))
    return rows.join(sent, F.col("u") == F.col("hub")).select("u", "v", "m").union(rest), [hubs]


def components(spark: SparkSession, edges: DataFrame, most_rounds: int = 64, hub_rows: int = 1 << 20) -> DataFrame:
    """(node, comp): each node of edges (a, b) with the smallest node reachable from it.

    Alternating large-star and small-star rounds; every round is a grouping
    with its result stored in the shared folder.  A node's neighbours are never
    gathered in one row, only their minimum is; nor in one task beyond `hub_rows` of them.
    """
    e = stored(
        spark,
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "edges",
    )
    same = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    was = same(e)
    for _ in range(most_rounds):
        n = was[0]  # each edge gives a node one row at most in either star
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: each larger neighbour of u goes to the least of u and its neighbours
        large, gone = _with_least(spark, both, n, hub_rows)
        large = large.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        if n > hub_rows:
            large = stored(spark, large, "edges")
            gone.append(large)
        # small star: each smaller neighbour of u, and u itself, go to u's minimum
        small, more = _with_least(spark, large, n, hub_rows)
        small = (
            small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
            .select("x.u", "x.v")
            .where("u <> v")
            .distinct()
        )
        new = stored(spark, small, "edges")
        now = same(new)
        done, was = now == was, now
        discard(spark, e, *gone, *more)
        e = new
        if done:
            break
    else:
        raise RuntimeError("components did not converge")
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    )
