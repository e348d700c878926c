"""Operator 8: BPE encoding and decoding with a contiguous rank array.

A word's parts and the ranks of its adjacent pairs lie in two short arrays.  The
smallest rank is found by scanning, one boundary is deleted, and the two
neighbouring ranks are refreshed.  Long words use the same order of merges
with a heap, so one very long word isn't quadratic.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from array import array
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, id_text, rows_of

NEVER = 1 << 60
BIG, NOTHING = np.int32((1 << 31) - 1), (1 << 24) - 1
#: Words of more parts than this are merged with a heap.
SHORT = 192
#: White_Space of Unicode; str.split() also splits at \x1c-\x1f, which aren't.
SPACES = "\t-\r \x85\xa0  -     　"


def byte_chars() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b], extra = chr(extra), extra + 1
    return [out[b] for b in range(256)]


class WordBPE:
    """A tokenizer file of kind BPE with word ends: NFC, lower case, white space dropped, byte-level parts.

    Ids are remembered for runs of non-white characters and for words, in two
    generations of `most` entries and one batch's each, so memory is bounded.
    """

    def __init__(self, path: str, most: int = 150_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        self.whole = True
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.rank.setdefault(vocab[a] << 24 | vocab[b], r)
            self.made.append(vocab[a + b])
        chars = byte_chars()
        self.path, self.byte_of = path, {c: b for b, c in enumerate(chars)}
        self.inner = [vocab.get(c) for c in chars]
        self.final = [vocab.get(c + suffix) for c in chars]
        self.whole = None not in self.inner and None not in self.final
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.token = [names.get(i, "") for i in range(max(names) + 1)]
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        head = "'s|'t|'re|'ve|'m|'ll|'d"
        self.ascii = re.compile(head + r"|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII).findall
        self.wide = regex.compile(head + rf"|[\p{{L}}]+|[\p{{N}}]|[^{SPACES}\p{{L}}\p{{N}}]+").findall
        self.spaces = regex.compile(f"[{SPACES}]+")
        self.odd = re.compile("[\x1c-\x1f]")
        # pair -> rank, for lookups of many pairs at once
        self.pairs = np.array(sorted(self.rank), np.int64)
        self.ranks = np.array([self.rank[k] for k in self.pairs.tolist()] + [BIG], np.int32)
        self.made_of = np.array(self.made, np.int64)
        bits = 20
        self.slot_bits, size = bits, 1 << bits
        self.slots = np.full(size, len(self.pairs), np.int32)
        home = self._home(self.pairs)
        for i, h in enumerate(home.tolist()):
            while self.slots[h] != len(self.pairs):
                h = (h + 1) & (size - 1)
            self.slots[h] = i
        self.keys = np.append(self.pairs, -1)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.most = most

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _home(self, pair: np.ndarray) -> np.ndarray:
        return (pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.slot_bits)

    def ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of many pairs, BIG where a pair has none (a hash table, probed in step)."""
        pair = a << 24 | b
        at = self._home(pair).astype(np.int64)
        found = self.slots[at]
        open_ = np.flatnonzero((self.keys[found] != pair) & (found != len(self.pairs)))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.slot_bits) - 1)
            found[open_] = self.slots[at[open_]]
            open_ = open_[(self.keys[found[open_]] != pair[open_]) & (found[open_] != len(self.pairs))]
        return self.ranks[found]

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """Ids of many short words: each row holds one word's parts and adjacent ranks, all rows step together."""
        out: list[bytes] = [b""] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        inner = np.array([-1 if i is None else i for i in self.inner], np.int64)
        final = np.array([-1 if i is None else i for i in self.final], np.int64)
        for lo in range(0, len(order), 4096):
            rows = order[lo : lo + 4096]
            size = np.array([len(words[i]) for i in rows])
            wide = int(size.max())
            raw = np.frombuffer(b"".join(words[i].ljust(wide, b" ") for i in rows), np.uint8).reshape(len(rows), wide)
            parts = np.where(np.arange(wide) < size[:, None], inner[raw], NOTHING)
            end = np.arange(len(rows))
            parts[end, size - 1] = final[raw[end, size - 1]]
            parts = np.hstack([parts, np.full((len(rows), 1), NOTHING)])
            ranks = self.ranks_of(parts[:, :-1].ravel(), parts[:, 1:].ravel()).reshape(len(rows), wide)
            which = np.array(rows)
            while len(which):
                at = ranks.argmin(1)
                each = np.arange(len(which))
                low = ranks[each, at]
                done = low == BIG
                if done.any():
                    left = parts[done]
                    n = (left != NOTHING).sum(1)
                    flat, ends = left[left != NOTHING].astype("<u4").tobytes(), (4 * np.cumsum(n)).tolist()
                    for i, e, k in zip(which[done].tolist(), ends, (4 * n).tolist()):
                        out[i] = flat[e - k : e]
                    go = ~done
                    which, parts, ranks, at, low = which[go], parts[go], ranks[go], at[go], low[go]
                    each = np.arange(len(which))
                    if not len(which):
                        break
                    used = int((parts != NOTHING).sum(1).max())
                    parts, ranks = parts[:, : used + 1], ranks[:, :used]
                parts[each, at] = self.made_of[low]
                # delete boundary at + 1: what follows moves one place to the left
                w = parts.shape[1]
                move = np.arange(w - 1) + (np.arange(w - 1) > at[:, None])
                parts = np.hstack([np.take_along_axis(parts, move, 1), np.full((len(which), 1), NOTHING)])
                move = np.arange(w - 2) + (np.arange(w - 2) >= at[:, None]) if w > 2 else np.zeros((len(which), 0), np.int64)
                ranks = np.hstack([np.take_along_axis(ranks, move, 1), np.full((len(which), 1), BIG, np.int32)])
                ranks[each, at] = self.ranks_of(parts[each, at], parts[each, at + 1])
                has = at > 0
                e, q = each[has], at[has]
                ranks[e, q - 1] = self.ranks_of(parts[e, q - 1], parts[e, q])
        return out

    def merge(self, ids: list[int]) -> list[int]:
        if len(ids) > SHORT:
            return self.merge_long(ids)
        get, made = self.rank.get, self.made
        ranks = [get(a << 24 | b, NEVER) for a, b in zip(ids, ids[1:])]
        while ranks:
            r = min(ranks)
            if r == NEVER:
                break
            i = ranks.index(r)
            ids[i] = made[r]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << 24 | ids[i], NEVER)
            if i < len(ranks):
                ranks[i] = get(ids[i] << 24 | ids[i + 1], NEVER)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        get, made, n = self.rank.get, self.made, len(ids)
        after, prior, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i) for i in range(n - 1) if (r := get(ids[i] << 24 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if not live[i] or j >= n or get(ids[i] << 24 | ids[j]) != r:
                continue
            ids[i], live[j], after[i] = made[r], False, after[j]
            if after[i] < n:
                prior[after[i]] = i
                if (s := get(ids[i] << 24 | ids[after[i]])) is not None:
                    heapq.heappush(heap, (s, i))
            if prior[i] >= 0 and (s := get(ids[prior[i]] << 24 | ids[i])) is not None:
                heapq.heappush(heap, (s, prior[i]))
        return [x for x, ok in zip(ids, live) if ok]

    def pieces(self, s: str) -> list[str]:
        """The words of one run of non-white characters."""
        if s.isascii():
            s = s.lower()
            return [s] if s.isalpha() else self.ascii(s)
        if max(s) > "\u04ff" and any(unicodedata.category(c) == "Cn" for c in s):
            # characters younger than this Unicode table: the library knows how it cuts them
            normal = self.library.normalizer.normalize_str(s)
            return [bytes(map(self.byte_of.__getitem__, p)).decode() for p, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]
        # lower case goes character by character: no final sigma
        return self.wide(unicodedata.normalize("NFC", s).replace("Σ", "σ").lower())

    def _learn(self, chunks: set[str]) -> None:
        known, older, words = self.known, self.older, self.words
        if len(known) > self.most:
            self.older, self.known = known, {k: known[k] for k in self.special if k in known}
            known, older = self.known, self.older
        if len(words) > self.most:
            words.clear()
        for c in self.special:
            known[c] = array("I", [self.special[c]]).tobytes()
        back = chunks.intersection(older) if len(chunks) < len(older) else {c for c in chunks if c in older}
        for c in back:
            known[c] = older[c]
        alone, cut = [], []
        for c in chunks - back:
            if c.isalpha() and c.isascii():
                alone.append(c)
            elif c not in known:
                cut.append(c)
        low = [c.lower() for c in alone]
        split = [self.pieces(c) for c in cut]
        todo = set(low).union(*split).difference(words)
        raw = [w.encode() for w in todo]
        merged = self.merge_many([r if self.whole and len(r) <= SHORT else b" " for r in raw])
        words.update(zip(todo, merged))
        for w, r in zip(todo, raw):
            if not (self.whole and len(r) <= SHORT):
                ids = [self.inner[b] for b in r[:-1]]
                ids.append(self.final[r[-1]])
                words[w] = array("I", self.merge([i for i in ids if i is not None])).tobytes()
        get = words.__getitem__
        known.update(zip(alone, map(get, low)))
        for c, p in zip(cut, split):
            known[c] = get(p[0]) if len(p) == 1 else b"".join(map(get, p))

    def _chunks(self, text: str) -> list[str]:
        if self.at_special and self.at_special.search(text):
            return [x for p in self.at_special.split(text) for x in ([p] if p in self.special else self._chunks(p))]
        return [x for x in self.spaces.split(text) if x] if self.odd.search(text) else text.split()

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian 32-bit integers; the strings of added tokens are those tokens.

        Words not yet known are merged together, a few MB of texts at a time.
        """
        out, held, size = [], [], 0
        for i, t in enumerate(texts):
            held.append(self._chunks(t))
            size += len(t)
            if size > 2_000_000 or i == len(texts) - 1:
                new = set().union(*held).difference(self.known)
                if new:
                    before = self.known
                    self._learn(new)
                    if self.known is not before:  # a new generation began: what these texts need of the last goes on, whatever its size
                        self.known.update((c, before[c]) for c in set().union(*held).difference(self.known))
                get = self.known.__getitem__
                out += [b"".join(map(get, w)) for w in held]
                held, size = [], 0
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def decode(self, ids: bytes) -> str:
        """Tokens joined by a space: the file names no decoder.  Ids out of range have no token."""
        token, n = self.token, len(self.token)
        known = np.frombuffer(ids, "<u4")
        if len(known) and int(known.max()) >= n:
            known = known[known < n]
        return " ".join(map(token.__getitem__, known.tolist()))


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordBPE:
    return WordBPE(path)


def encode(docs: DataFrame, path: str, decoded: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids): ids of each whole text, little-endian unsigned 32-bit.

    With `decoded`, the text that decode() makes of the ids follows, by the same worker.

    One pass without a shuffle; rows stay where they are.  Null and empty
    texts have no ids; a null doc_id and repeated rows pass through; other
    columns are not read.  path must name the same file on every machine.
    """
    more = [("decoded", pa.string())] if decoded else []
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), *more])

    def run(batches):
        bpe = tokenizer(path)
        for ids, texts in rows_of(batches, "doc_id", "text"):
            for lo in range(0, len(ids), 256):
                out = bpe.encode_many([t.decode() for t in texts[lo : lo + 256]])
                back = [list(map(bpe.decode, out))] if decoded else []
                yield batch(schema, ids[lo : lo + 256], [len(x) >> 2 for x in out], out, *back)

    return id_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids binary" + (", decoded string" if decoded else ""))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encode()'s rows with `decoded`, the text of the ids."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])

    def run(batches):
        bpe = tokenizer(path)
        for doc, n, ids in rows_of(batches, "doc_id", "n_tokens", "ids"):
            for lo in range(0, len(doc), 256):
                part = ids[lo : lo + 256]
                yield batch(schema, doc[lo : lo + 256], n[lo : lo + 256], part, [bpe.decode(x) for x in part])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")


def digests(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    return encode(docs, path, decoded=True).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary())
