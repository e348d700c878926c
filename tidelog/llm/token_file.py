"""Operator 9: token ids in binary blocks, coded by a static range asymmetric numeral system.

A file is a folder of blocks.  Each block holds up to BLOCK ids of one bucket's
stream (documents in ascending doc_id, an end id after each), coded in LANES
interleaved states against one frequency table that all blocks share.  A block
carries a checksum of its payload and one of its ids, and checkpoints (state of
all lanes at some steps) from which a reader may start in its middle.  Blocks
are independent: any may be read alone, in parallel.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import byte_chars, vocabulary
from .common import batch, discard, id_text, rows_of, stored

MAGIC = b"TANS1\0"
SCALE, LOW, LANES, BLOCK = 20, 31, 512, 1 << 16
HEAD = struct.Struct("<6sHIIIIII")  # magic, lanes, ids, steps between checkpoints, words, table crc, payload crc, ids crc


class Table:
    """Shared frequencies: symbol counts scaled to 2**SCALE; each symbol that occurs has 1 at least."""

    def __init__(self, counts: np.ndarray):
        freq = np.zeros(len(counts), np.int64)
        on = counts > 0
        if int(on.sum()) > 1 << (SCALE - 1):
            raise ValueError("too many symbols for the table")
        total = float(counts.sum()) or 1.0
        freq[on] = np.maximum(1, np.floor(counts[on] / total * ((1 << SCALE) - int(on.sum()))).astype(np.int64))
        if on.any():
            freq[int(np.argmax(counts))] += (1 << SCALE) - int(freq.sum())
        self.freq = freq.astype(np.uint64)
        self.cum = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        self.crc = zlib.crc32(freq.astype("<u4").tobytes())


def pack(ids: np.ndarray, table: Table, every: int = 64) -> bytes:
    """One block.  Lane k holds ids k, k + LANES, ...; the last row is padded with the block's first id."""
    n = len(ids)
    steps = -(-n // LANES)
    grid = np.full(steps * LANES, ids[0] if n else 0, np.int64)
    grid[:n] = ids
    freq, cum = table.freq[grid].reshape(steps, LANES), table.cum[grid].reshape(steps, LANES)
    if n and not freq.all():
        raise ValueError("an id is not in the shared table")
    x = np.full(LANES, 1 << LOW, np.uint64)
    words, marks, count = [], [], 0
    shift, low32 = np.uint64(LOW + 32 - SCALE), np.uint64(0xFFFFFFFF)
    for t in range(steps - 1, -1, -1):
        f = freq[t]
        over = x >= (f << shift)
        if over.any():
            out = x[over]
            words.append((out & low32).astype("<u4"))
            count += len(out)
            x[over] = out >> np.uint64(32)
        q = x // f
        x = (q << np.uint64(SCALE)) + (x - q * f) + cum[t]
        if t and t % every == 0:
            marks.append((t, count, x.copy()))
    stream = np.concatenate(words[::-1]) if words else np.empty(0, "<u4")
    body = x.astype("<u8").tobytes() + struct.pack("<I", len(marks))
    for t, c, state in reversed(marks):
        body += struct.pack("<II", t, count - c) + state.astype("<u8").tobytes()
    body += stream.tobytes()
    head = HEAD.pack(MAGIC, LANES, n, every, count, table.crc, zlib.crc32(body), zlib.crc32(ids.astype("<u4").tobytes()))
    return head + body


def unpack(blob: bytes, table: Table, first: int = 0) -> np.ndarray:
    """The ids of a block from step `first` on (0 or a checkpoint's); checksums are verified."""
    magic, lanes, n, every, count, tcrc, crc, ids_crc = HEAD.unpack_from(blob)
    body = memoryview(blob)[HEAD.size :]
    if magic != MAGIC or tcrc != table.crc or zlib.crc32(body) != crc:
        raise ValueError("a damaged block, or another table's")
    steps, x, pos = -(-n // lanes), np.frombuffer(body, "<u8", lanes).copy(), 8 * lanes
    (marks,) = struct.unpack_from("<I", body, pos)
    pos, at = pos + 4, 0
    found = first == 0
    for _ in range(marks):
        t, offset = struct.unpack_from("<II", body, pos)
        if t == first:
            x, at, found = np.frombuffer(body, "<u8", lanes, pos + 8).copy(), offset, True
        pos += 8 + 8 * lanes
    if not found:
        raise ValueError("no checkpoint at that step")
    stream = np.frombuffer(body, "<u4", count, pos).astype(np.uint64)
    out = np.empty((steps - first, lanes), np.uint32)
    mask, limit, scale = np.uint64((1 << SCALE) - 1), np.uint64(1 << LOW), np.uint64(SCALE)
    for t in range(steps - first):
        slot = x & mask
        s = table.symbol[slot]
        out[t] = s
        x = table.freq[s] * (x >> scale) + slot - table.cum[s]
        under = np.flatnonzero(x < limit)
        if len(under):
            x[under] = (x[under] << np.uint64(32)) | stream[at : at + len(under)]
            at += len(under)
    ids = out.reshape(-1)[: n - first * lanes]
    if not first and zlib.crc32(ids.astype("<u4").tobytes()) != ids_crc:
        raise ValueError("ids do not match their checksum")
    return ids


def crc32_joined(a: int, b: int, n: int) -> int:
    """crc32 of two byte strings in a row, from their crc32s and the second's length (a matrix over GF(2))."""

    def times(mat, v):
        out, i = 0, 0
        while v:
            if v & 1:
                out ^= mat[i]
            v, i = v >> 1, i + 1
        return out

    odd = [0xEDB88320] + [1 << i for i in range(31)]
    even = [times(odd, c) for c in odd]
    odd = [times(even, c) for c in even]
    while n:
        even = [times(odd, c) for c in odd]
        if n & 1:
            a = times(even, a)
        n >>= 1
        if not n:
            break
        odd = [times(even, c) for c in even]
        if n & 1:
            a = times(odd, a)
        n >>= 1
    return a ^ b


class LibraryIds:
    """Ids of whole texts by the tokenizers library, each distinct word asked for once.

    Where the file's normalizer and pre-tokenizer work on each run of non-white characters
    alone, texts are cut to words on their bytes, many texts at a time, and each distinct word goes
    to the library's model.  That holds for runs of printable ASCII and of U+00C0 to U+00FF; a run with
    any other character is one unit and goes to the library's whole encoder as it is.  Texts with a
    special token's string, and files of another kind, are encoded whole.  What is remembered is
    bounded: two generations of `most` words each, none over 256 bytes.
    """

    PIECE = 4 << 20  # bytes cut at a time; a longer text is taken in pieces that end at white space

    def __init__(self, path: str, most: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model, self.most = self.library.model, most
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        spec = json.loads(self.library.to_str())
        self.by_run = _cuts_runs(spec)
        self.special = re.compile(b"|".join(re.escape(t["content"].encode()) for t in spec["added_tokens"]) or rb"(?!)").search
        self.plain = re.compile(rb"(?:[!-~]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch
        self.chars = dict(enumerate(byte_chars()))
        self.words: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids_of(self, keys: list[bytes]) -> list[bytes]:
        if len(self.words) > self.most:
            self.old, self.words = self.words, {}
        known, found, odd = self.words, list(map(self.words.get, keys)), []
        for i in [i for i, ids in enumerate(found) if ids is None]:
            w = keys[i]
            ids = self.old.get(w)
            if ids is None:
                if not self.plain(w):
                    odd.append(i)
                    continue
                text = w.decode() if w.isascii() else w.decode("latin-1").translate(self.chars)
                ids = array("I", [t.id for t in self.model.tokenize(text)]).tobytes()
            found[i] = ids
            if len(w) <= 256:
                known[w] = ids
        if odd:
            for i, ids in zip(odd, self.whole([keys[i].decode() for i in odd])):
                found[i] = ids
                if len(keys[i]) <= 256:
                    known[keys[i]] = ids
        return found

    def _encode(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece; the pieces together are of bounded size."""
        at = np.cumsum([1] + [len(p) + 1 for p in pieces])
        units, starts = _cut_bytes(b"\n" + b"\n".join(pieces) + b"\n" * 4)
        if not len(starts):
            return [b""] * len(pieces)
        units = units.dictionary_encode()
        which = units.indices.to_numpy()
        ids = self._ids_of(units.dictionary.to_pylist())
        sizes = np.fromiter((len(b) >> 2 for b in ids), np.int64, len(ids))
        first, sizes = (np.cumsum(sizes) - sizes)[which], sizes[which]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        out = np.frombuffer(b"".join(ids), "<u4")[np.repeat(first - ends[:-1], sizes) + np.arange(ends[-1])]
        cuts = ends[np.searchsorted(starts, at)].tolist()
        return [out[lo:hi].tobytes() for lo, hi in zip(cuts, cuts[1:])]

    def encode_bytes(self, texts: list[bytes]) -> list[bytes]:
        """Ids, as little-endian 32-bit integers, of UTF-8 texts."""
        out: list[list[bytes]] = [[] for _ in texts]
        held, whose, size = [], [], 0

        def flush():
            for i, ids in zip(whose, self._encode(held)):
                out[i].append(ids)

        for i, text in enumerate(texts):
            if not self.by_run or self.special(text):
                out[i] += self.whole([text.decode()])
                continue
            for piece in _pieces(text, self.PIECE):
                held.append(piece)
                whose.append(i)
                size += len(piece)
                if size >= self.PIECE:
                    flush()
                    held, whose, size = [], [], 0
        if held:
            flush()
        return [ids[0] if len(ids) == 1 else b"".join(ids) for ids in out]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        return self.encode_bytes([t.encode() for t in texts])


_WHITE, _LETTER, _DIGIT, _SIGN, _ODD = range(5)
_CLASS = np.full(256, _ODD, np.uint8)
_CLASS[33:127] = _SIGN
_CLASS[48:58] = _DIGIT
_CLASS[97:123] = _LETTER
_CLASS[[9, 10, 11, 12, 13, 32]] = _WHITE
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _pieces(text: bytes, most: int):
    """The text in parts of about `most` bytes; no run of non-white characters is cut."""
    lo = 0
    while len(text) - lo > most:
        hi = max(text.rfind(b" ", lo, lo + most), text.rfind(b"\n", lo, lo + most))
        if hi <= lo:
            found = _white(text, lo + most)
            if not found:
                break
            hi = found.start()
        yield text[lo:hi]
        lo = hi
    yield text[lo:]


_white = re.compile(rb"[ \t-\r]").search


def _cut_bytes(data: bytes) -> tuple[pa.Array, np.ndarray]:
    """Words of texts as the file's pattern cuts them, lower-cased, and where each starts.

    data starts with white space and ends with four characters of it.  A run that
    holds anything but printable ASCII and letters from U+00C0 to U+00FF is one unit, unchanged.
    """
    raw = np.frombuffer(data, np.uint8)
    low = _LOWER[raw]
    kind = _CLASS[low]
    lead = np.flatnonzero(low == 0xC3)
    if len(lead):
        upper = lead[(low[lead + 1] < 0x9F) & (low[lead + 1] != 0x97)] + 1
        low[upper] += 32
        lead = lead[~np.isin(low[lead + 1], (0x97, 0xB7))]  # signs of multiplication and division
        kind[lead] = kind[lead + 1] = _LETTER
    inside = kind != _WHITE
    first = np.empty(len(raw), bool)  # of a run
    first[0] = False
    np.greater(inside[1:], inside[:-1], out=first[1:])
    start = np.empty(len(raw), bool)  # of a word
    start[0] = False
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start |= kind == _DIGIT
    start &= inside
    quote = np.flatnonzero(low == 0x27)
    quote = quote[kind[quote - 1] != _SIGN]
    for end in (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d"):
        here = quote
        for i, c in enumerate(end):
            here = here[low[here + 1 + i] == c]
        start[here + 1] = False
        after = here + 1 + len(end)
        start[after] |= kind[after] == _LETTER
    odd = np.flatnonzero(kind == _ODD)
    if len(odd):
        run = np.cumsum(first)
        bad = np.zeros(run[-1] + 1, bool)
        bad[run[odd]] = True
        at = np.flatnonzero(bad[run] & inside)
        low[at] = raw[at]
        start[at] = first[at]
    offsets = np.append(np.flatnonzero(start[inside]), int(inside.sum())).astype(np.int32)
    units = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(low[inside])])
    return units, np.flatnonzero(start)


def _cuts_runs(spec: dict) -> bool:
    """Whether the file is of the kind that NFC, lower case and a pattern cut, white space dropped."""
    kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
    steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    # fixed values: the tokenizer file's own pattern
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    cut = len(steps) == 2 and steps[0]["type"] == "Split" and steps[0]["pattern"].get("Regex") == pattern and steps[1]["type"] == "ByteLevel"
    return kinds == ["NFC", "Replace", "Lowercase"] and cut and not steps[1]["add_prefix_space"]


@lru_cache(maxsize=2)
def library_ids(path: str) -> LibraryIds:
    return LibraryIds(path)


def _bucketed(docs: DataFrame, size: int) -> DataFrame:
    """Rows dealt by ranges of doc_id, about `size` bytes of texts a partition, each in ascending order.

    The number of partitions follows the bytes.  Equal doc_ids are told apart by a hash of the text, so one id of
    a great many rows isn't one task.
    """
    source = id_text(docs)
    total = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    dealt = source.withColumn("tie", F.xxhash64("text")).repartitionByRange(max(1, -(-total // size)), *order)
    return dealt.sortWithinPartitions(*order).drop("tie")


def tokenized(docs: DataFrame, path: str, end: int, size: int) -> DataFrame:
    """(bucket, seq, at, doc_id, ids): ids with the end id, 16 bits each where the vocabulary allows, in ascending doc_id.

    A bucket is a partition of the range exchange; its number rises with doc_id.
    """
    schema = pa.schema([("bucket", pa.int32()), ("seq", pa.int64()), ("at", pa.int64()), ("doc_id", pa.int64()), ("wide", pa.bool_()), ("ids", pa.binary())])

    def run(batches):
        bpe = library_ids(path)
        wide = max(bpe.size, end + 1) > 1 << 16
        kind = "<u4" if wide else "<u2"
        bucket, seq, at = TaskContext.get().partitionId(), 0, 0
        for ids, texts in rows_of(batches, "doc_id", "text"):
            ends = np.cumsum([len(t) for t in texts])
            lo = 0
            while lo < len(ids):
                # a few MB of texts, one at least
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + bpe.PIECE)))
                seqs, ats, blobs = [], [], []
                for c in bpe.encode_bytes(texts[lo:hi]):
                    seqs.append(seq)
                    ats.append(at)
                    seq, at = seq + 1, at + (len(c) >> 2) + 1
                    blobs.append(np.append(np.frombuffer(c, "<u4"), np.uint32(end)).astype(kind).tobytes())
                yield batch(schema, [bucket] * len(blobs), seqs, ats, ids[lo:hi], [wide] * len(blobs), blobs)
                lo = hi

    return _bucketed(docs, size).mapInArrow(run, "bucket int, seq long, at long, doc_id long, wide boolean, ids binary")


def _ids(blob: bytes, wide: bool) -> np.ndarray:
    return np.frombuffer(blob, "<u4" if wide else "<u2")


def count_tokens(tokens: DataFrame) -> DataFrame:
    """(id, n) over all documents, the end id included."""
    schema = pa.schema([("id", pa.int32()), ("n", pa.int64())])

    def run(batches):
        total = np.zeros(1, np.int64)
        for blobs, wide in rows_of(batches, "ids", "wide"):
            if blobs:
                for lo in range(0, len(blobs), 256):
                    part = np.bincount(_ids(b"".join(blobs[lo : lo + 256]), wide[0]))
                    if len(part) > len(total):
                        part, total = total, part
                    total[: len(part)] += part
        on = np.flatnonzero(total)
        yield batch(schema, pa.array(on, pa.int32()), pa.array(total[on], pa.int64()))

    return tokens.select("ids", "wide").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_tokens(spark: SparkSession, docs: DataFrame, path: str, end: int = 1, size: int = 16 << 20) -> tuple[DataFrame, DataFrame]:
    """Two tables in the shared folder: the shared frequency table (id, n) and the blocks
    (bucket, start, doc_ids, doc_seqs, doc_counts, payload), start counted within the bucket.

    Texts are shuffled once, by ranges of doc_id of about `size` bytes, and encoded once; Spark's commit
    protocol makes a lost executor's blocks appear once.  Blocks are cut within
    what a task reads, so ids beyond a block never wait in its memory.

    A null text is an empty one and still gets its end id; a null doc_id sorts
    first; rows repeated under one doc_id lie side by side, by a hash of the text.  An empty table
    gives no blocks.  Other columns are not read.
    """
    tokens = stored(spark, tokenized(docs, path, end, size), "tokens", "zstd")
    counts = stored(spark, count_tokens(tokens), "token-table")
    # at most one row for each id of the vocabulary
    shared = spark.sparkContext.broadcast(_frequencies(counts))
    schema = pa.schema(
        [("bucket", pa.int32()), ("start", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_seqs", pa.list_(pa.int64())), ("doc_counts", pa.list_(pa.int64())), ("payload", pa.binary())]
    )

    def run(batches):
        table = Table(shared.value)
        now, start, held, parts, docs_in = None, 0, 0, [], []

        def emit(take):
            nonlocal parts, held, start, docs_in
            ids = np.concatenate(parts)
            mine, rest, left = [], [], take
            for d, q, c in docs_in:
                if left:
                    mine.append((d, q, min(c, left)))
                if c > left:
                    rest.append((d, q, c - left))
                left = max(0, left - c)
            row = batch(schema, [now], [start], [[m[0] for m in mine]], [[m[1] for m in mine]], [[m[2] for m in mine]], [pack(ids[:take], table)])
            parts, held, docs_in = ([ids[take:]] if take < len(ids) else []), len(ids) - take, rest
            start += take
            return row

        for cols in rows_of(batches, "bucket", "seq", "at", "doc_id", "wide", "ids"):
            for b, seq, at, d, wide, blob in zip(*cols):
                if b != now or at != start + held:
                    if held:
                        yield emit(held)
                    now, start = b, at
                x = _ids(blob, wide)
                parts.append(x)
                docs_in.append((d, seq, len(x)))
                held += len(x)
                while held >= BLOCK:
                    yield emit(BLOCK)
        if held:
            yield emit(held)

    blocks = tokens.mapInArrow(run, "bucket int, start long, doc_ids array<long>, doc_seqs array<long>, doc_counts array<long>, payload binary")
    blocks = stored(spark, blocks, "token-blocks", "uncompressed")
    discard(spark, tokens)
    return counts, blocks


def _frequencies(counts: DataFrame) -> np.ndarray:
    rows = counts.collect()
    out = np.zeros(max((r.id for r in rows), default=0) + 1, np.int64)
    for r in rows:
        out[r.id] = r.n
    return out


def read_tokens(spark: SparkSession, counts: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, bucket, seq, start, n_tokens, ids_crc32, pieces): documents as the blocks hold them.

    Blocks are decoded in parallel, wherever they lie; what comes of a document
    that spans blocks is joined by its place (bucket, seq).
    """
    shared = spark.sparkContext.broadcast(_frequencies(counts))
    schema = pa.schema([("bucket", pa.int32()), ("seq", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n", pa.int64()), ("crc", pa.int64())])

    def run(batches):
        table = Table(shared.value)
        for cols in rows_of(batches, "bucket", "start", "doc_ids", "doc_seqs", "doc_counts", "payload"):
            for b, start, ids, seqs, ns, blob in zip(*cols):
                raw = unpack(blob, table).astype("<u4").tobytes()
                ends = np.cumsum(ns).tolist()
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends, ns)]
                yield batch(schema, [b] * len(ids), seqs, ids, [start + e - n for e, n in zip(ends, ns)], ns, crc)

    pieces = blocks.mapInArrow(run, "bucket int, seq long, doc_id long, at long, n long, crc long")
    sizes = blocks.groupBy("bucket").agg(F.sum(F.aggregate("doc_counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    # one row for each bucket, that is for each `size` bytes of texts
    before = sizes.select("bucket", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    whole = pieces.groupBy("bucket", "seq").agg(
        F.min("doc_id").alias("doc_id"), F.min("at").alias("at"), F.sum("n").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("at", "n", "crc"))).alias("pieces")
    )
    out = whole.join(before, "bucket").select("doc_id", "bucket", "seq", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "pieces")
    return out


def joined_crc(df: DataFrame) -> DataFrame:
    """read_tokens()'s rows with ids_crc32 of each whole document; only documents in several blocks need Python."""
    one = F.size("pieces") == 1

    @F.pandas_udf("long")
    def join(all_pieces: pd.Series) -> pd.Series:
        out = []
        for pieces in all_pieces:
            crc = int(pieces[0]["crc"])
            for p in pieces[1:]:
                crc = crc32_joined(crc, int(p["crc"]), 4 * int(p["n"]))
            out.append(crc)
        return pd.Series(out, dtype="int64")

    alone = df.where(one).withColumn("ids_crc32", F.col("pieces")[0]["crc"])
    return alone.unionByName(df.where(~one).withColumn("ids_crc32", join("pieces")))


def op9_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts, blocks = write_tokens(spark, docs, vocabulary(), end=1)
    # decoded once: both kinds of rows below read the stored pieces
    docs_read = stored(spark, read_tokens(spark, counts, blocks), "token-docs")
    return joined_crc(docs_read).select("doc_id", "start", "n_tokens", "ids_crc32")
