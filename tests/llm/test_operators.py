"""The training-data operators on small fixtures: brute force, exact round trips, edge cases."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog.llm import ann, bpe, exact_dedup, jaccard, licenses, lines, mixing, quality, substring, token_file
from tidelog.llm.common import components, word_hashes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, bucket long, at long"
A = " ".join(f"w{i % 41}x{i}" for i in range(90))
LINE = "A line that is long enough to be counted as one"
TEXTS = [
    A, A, A.upper(), A + " tail", A.replace("w7x7", "other"), "", None, "  \n\t ", "one two", "One Two", "a b a b " * 40,
    f"{LINE}\nx", f" {LINE.lower()}\t\ny", f"{LINE}\n{LINE}\nz", LINE, f"q\n{LINE}", "Straße ÀÉ İ Σ ΟΔΟΣ " * 9, "ends\n", "word " * 3000, "<|endoftext|> Licensed under the Apache License, Version 2.0.",
    "All rights reserved.\nHe sold his driving license.", " ".join(A.split()[20:60]) + " new words here", "!!! ### 123 don't we'll", "Released under the MIT License.",
]
ROWS = [(i, t, "en", f"s{i % 3}" if i % 5 else None, 0, "h", 7, 9) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "en", "s0", 0, "h", 7, 9), (None, "no id", "en", "s0", 0, "h", 7, 9)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def low(t):
    return (t or "").encode().lower()


def test_exact_dedup(spark, docs, none):
    groups = {}
    for r in ROWS:
        groups.setdefault(low(r[1]), []).append(r[0])
    want = sorted(
        (repr(r[0]), max((x for x in groups[low(r[1])] if x is not None), default=None), len(groups[low(r[1])]), hashlib.sha256(low(r[1])).hexdigest()) for r in ROWS
    )
    for weak in (None, lambda c: F.substring(F.md5(c.cast("binary")), 1, 1)):
        got = exact_dedup.exact_dedup(spark, docs, keep="max", content_hash=weak).collect()
        assert sorted((repr(r.doc_id), r.keep_id, r.group_size, r.text_sha256) for r in got) == want
        assert all(r.kept == (r.doc_id == r.keep_id) for r in got)
    assert exact_dedup.exact_dedup(spark, none).count() == 0


def test_mixing(spark, docs, none):
    placed, mix = mixing.mix_sources(spark, docs, weights=[3, 1, 2], share=1.5, block=16)
    got = mixing.taken_words(placed, mix).collect()
    assert len(got) == len(ROWS) and all(r.taken <= 2 * r["size"] for r in got)
    by = {}
    for r in got:
        t = by.setdefault(r.source, [0, r.target, 0])
        t[0], t[2] = t[0] + r["size"], t[2] + r.taken
    assert all(abs(t[2] - t[1]) <= max(32, 0.03 * t[1]) for t in by.values())
    again = mixing.taken_words(*mixing.mix_sources(spark, docs, weights=[3, 1, 2], share=1.5, block=16)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))
    assert mixing.taken_words(*mixing.mix_sources(spark, none)).count() == 0


def test_targets_are_capped_and_reshared():
    t = mixing.targets({"a": 100, "b": 1000, None: 1000}, [3, 1, 2], 1.5, 2.0)
    assert t["a"] == 200 and abs(sum(t.values()) - 3150) < 1e-6 and abs(t[None] - 2 * t["b"]) < 1e-6


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary())


@pytest.fixture(scope="module")
def own():
    return bpe.WordBPE(bpe.vocabulary(), most=50)


def test_bpe_matches_the_library(spark, docs, library):
    got = {}
    for r in bpe.decode(bpe.encode(docs, bpe.vocabulary()), bpe.vocabulary()).collect():
        got.setdefault(r.doc_id, []).append((np.frombuffer(r.ids, "<u4").tolist(), r.decoded))
    for i, t in [(r[0], r[1]) for r in ROWS]:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert all(x == (ids, library.decode(ids, skip_special_tokens=False)) for x in got[i])
    both = [(r.doc_id, np.frombuffer(r.ids, "<u4").tolist(), r.decoded) for r in bpe.encode(docs, bpe.vocabulary(), decoded=True).collect()]
    assert sorted(both, key=repr) == sorted([(i, *x) for i, rows in got.items() for x in rows], key=repr)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_bpe_on_any_text(library, own, text):
    assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_bpe_of_a_very_long_word(library, own):
    for t in ("ab" * 3000, "x!" * 900, "a" * 5000):
        assert np.frombuffer(own.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_token_file(spark, docs, none, library, monkeypatch):
    monkeypatch.setattr(token_file, "BLOCK", 1024)
    counts, blocks = token_file.write_tokens(spark, docs, bpe.vocabulary(), size=200)
    got = token_file.joined_crc(token_file.read_tokens(spark, counts, blocks)).orderBy("start").collect()
    at = 0
    for r, (i, t) in zip(got, sorted(((x[0], x[1]) for x in ROWS), key=lambda x: (x[0] is not None, x[0] or 0)), strict=True):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_file.read_tokens(spark, *token_file.write_tokens(spark, none, bpe.vocabulary())).count() == 0


@given(st.lists(st.integers(0, 300), max_size=2000), st.integers(0, 1000))
@settings(max_examples=40, deadline=None)
def test_blocks_round_trip(ids, seed):
    x = np.array(ids * 40, np.uint32)
    table = token_file.Table(np.bincount(x, minlength=2))
    blob = token_file.pack(x, table, every=16)
    assert (token_file.unpack(blob, table) == x).all()
    if len(x) > 16 * token_file.LANES:
        assert (token_file.unpack(blob, table, first=16) == x[16 * token_file.LANES :]).all()
    if len(blob) > 80:
        bad = bytearray(blob)
        bad[60 + seed % (len(blob) - 60)] ^= 1
        with pytest.raises(ValueError):
            token_file.unpack(bytes(bad), table)


@given(st.binary(max_size=50), st.binary(max_size=50))
def test_joined_crc(a, b):
    assert token_file.crc32_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def brute_lines(rows):
    keys = {}
    for i, t in rows:
        for x in {k for k in (y.strip(" \t\n\x0b\x0c\r").encode().lower() for y in (t or "").split("\n")) if len(k.decode()) >= 40}:
            keys.setdefault(x, set()).add(i)
    out = []
    for i, t in rows:
        all_ = (t or "").split("\n")
        keep = [y for y in all_ if not (len(h := keys.get(y.strip(" \t\n\x0b\x0c\r").encode().lower(), ())) >= 5 and i != max(x for x in h if x is not None))]
        out.append((repr(i), len(all_), len(all_) - len(keep), "\n".join(keep)))
    return sorted(out)


def test_lines(spark, docs, none):
    rows = [(r[0], r[1]) for r in ROWS]
    ix = lines.LineIndex(spark).insert(docs)
    got = sorted((repr(r.doc_id), *r[1:]) for r in ix.apply(docs).collect())
    assert got == brute_lines(rows) and sum(r[2] for r in got) > 3
    gone = docs.where("doc_id in (14, 15)")
    rest = docs.where("doc_id not in (14, 15) or doc_id is null")
    left = [r for r in rows if r[0] not in (14, 15)]
    assert sorted((repr(r.doc_id), *r[1:]) for r in ix.delete(gone).apply(rest).collect()) == brute_lines(left)
    assert sorted((repr(r.doc_id), *r[1:]) for r in ix.insert(gone).apply(docs).collect()) == got
    assert lines.LineIndex(spark).insert(none).apply(none).count() == 0


def test_cuckoo_filter():
    h = np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64)
    f = lines.CuckooFilter.sized(len(h))
    f.insert(h)
    assert lines.CuckooFilter.of(f.blob()).contains(h).all() and f.keys() == len(h)
    assert f.contains(h + np.uint64(12345)).mean() < 0.01
    f.delete(h[:2500])
    assert f.contains(h[2500:]).all() and f.keys() == 2500 and f.contains(h[:2500]).mean() < 0.01


def brute_repeats(rows, w):
    seen = Counter(tuple(x[j : j + w]) for _, t in rows for x in [(t or "").encode().split()] for j in range(len(x) - w + 1))
    out = []
    for i, t in rows:
        x = (t or "").encode().split()
        gone = [False] * len(x)
        for j in range(len(x) - w + 1):
            if seen[tuple(x[j : j + w])] > 1:
                gone[j : j + w] = [True] * w
        out.append((repr(i), len(x), sum(gone), b" ".join(y for y, g in zip(x, gone) if not g).decode()))
    return sorted(out)


@pytest.mark.parametrize("most", [2000, 1])
@pytest.mark.parametrize("sent", [2_000_000, 0])
def test_substring(spark, docs, none, monkeypatch, most, sent):
    monkeypatch.setattr(substring, "MOST_SENT", sent)
    got = sorted((repr(r.doc_id), *r[1:]) for r in substring.remove_repeats(spark, docs, window=35, most=most).collect())
    assert got == brute_repeats([(r[0], r[1]) for r in ROWS], 35) and sum(r[2] for r in got) > 100
    if most > 1 and sent:
        assert substring.remove_repeats(spark, none, window=35).count() == 0


@given(st.lists(st.lists(st.integers(0, 2), min_size=1, max_size=12), min_size=1, max_size=4), st.integers(1, 4))
def test_automaton_counts(texts, w):
    sam = substring.SuffixAutomaton()
    for t in texts:
        sam.add(t, 1)
    sam.finish()
    n = Counter(tuple(t[j : j + w]) for t in texts for j in range(len(t) - w + 1))
    for t in texts:
        assert list(sam.occurrences(t, w)) == [n[tuple(t[j : j + w])] for j in range(len(t) - w + 1)]


def test_word_hashes_follow_words():
    t = "  Aa b\tAa\x0bb  é é\n".encode()
    h = word_hashes(t).tolist()
    assert len(h) == 6 and h[0] == h[2] and h[1] == h[3] and h[4] == h[5] and len(set(h)) == 3


def brute_components(rows, k, percent):
    sets = []
    for i, t in rows:
        w = low(t).split()
        sets.append((i, {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()))
    comp = {i: i for i, _ in sets}
    for _ in sets:
        for i, a in sets:
            for j, b in sets:
                if a and b and None not in (i, j) and 100 * len(a & b) >= percent * len(a | b):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    return sorted((repr(i), len(s), comp[i]) for i, s in sets)


def test_words_that_mirror_each_other_do_not_collide(spark):
    """Thue-Morse words and their complements meet in every polynomial hash modulo a power of two."""

    def mirrored(n, letters=b"ab"):
        word = bytes(letters[i.bit_count() % 2] for i in range(n))
        return word, word.translate(bytes.maketrans(b"ab", b"ba"))

    for n in (8, 16, 64, 1024, 4096):
        assert len(set(word_hashes(b" ".join(mirrored(n))).tolist())) == 2
    one, two = (x.decode() for x in mirrored(1024))
    words = [f"w{i}" for i in range(34)]
    df = spark.createDataFrame([(1, " ".join([one, *words])), (2, " ".join([two, *words]))], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.near_duplicates(spark, df.select("doc_id", F.substring_index("text", " ", 4).alias("text")), k=4).collect()} == {1: 1, 2: 2}
    assert {r.doc_id: r.n_removed for r in substring.remove_repeats(spark, df, window=35).collect()} == {1: 0, 2: 0}


@pytest.mark.parametrize("tile,group", [(4096, 1_000_000), (2, 100)])
def test_jaccard(spark, docs, none, monkeypatch, tile, group):
    monkeypatch.setattr(jaccard, "TILE_ROWS", tile)
    monkeypatch.setattr(jaccard, "GROUP_WORDS", group)
    got = sorted((repr(r.doc_id), r.n_shingles, r.component_id) for r in jaccard.near_duplicates(spark, docs, k=4, percent=85).collect())
    assert got == brute_components([(r[0], r[1]) for r in ROWS], 4, 85)
    if tile > 2:
        assert jaccard.near_duplicates(spark, none).count() == 0


@pytest.mark.parametrize("hub_rows", [0, 3, 1 << 20])
def test_components_with_hubs(spark, hub_rows):
    import random

    rng = random.Random(7)
    pairs = [(0, i) for i in range(1, 60)] + [(500, i) for i in range(400, 460)] + [(i, i + 1) for i in range(600, 640)]
    pairs += [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(70)] + [(rng.randrange(400, 460), 639)]
    rng.shuffle(pairs)
    root = {n: n for e in pairs for n in e}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.comp for r in components(spark, spark.createDataFrame(pairs, "a long, b long"), hub_rows=hub_rows).collect()}
    alone = {n for n in root if not any(n in e and e[0] != e[1] for e in pairs)}
    assert got == {n: top(n) for n in root if n not in alone}


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7)], "a long, b long")
    got = {r.node: r.comp for r in components(spark, edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 103: 100}


@pytest.mark.parametrize("hub_rows", [8, 1 << 20])
def test_components_keep_plans_small(spark, hub_rows):
    """The driver holds a round's plan many times over: rounds that nested their own parts had 14 to 25 exchanges and took its memory."""
    store = spark._jsparkSession.sharedState().statusStore()
    began = store.executionsCount()
    edges = spark.createDataFrame([(0, i) for i in range(1, 30)] + [(i, i + 1) for i in range(100, 140)], "a long, b long")
    got = {r.node: r.comp for r in components(spark, edges, hub_rows=hub_rows).collect()}
    assert got == {i: 0 for i in range(30)} | {i: 100 for i in range(100, 141)}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    runs = store.executionsList()
    graphs = [store.planGraph(runs.apply(i).executionId()).allNodes() for i in range(began, runs.size())]
    names = [[g.apply(i).name() for i in range(g.size())] for g in graphs]
    assert len(names) > 6
    assert max(sum("Exchange" in x for x in n) for n in names) <= 5
    assert max(len(n) for n in names) <= 60


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    x = [(i, (centres[i % 12] + 0.4 * rng.normal(size=16)).astype(np.float32).tolist()) for i in range(3000)]
    x += [(3000 + i, x[40][1]) for i in range(60)] + [(9000, None), (9020, [0.0] * 16), (9040, [float("nan")] * 16), (9060, [1.0]), (9061, [3.0]), (9062, [2.0]), (None, [1.0] * 16), x[40]]
    df = spark.createDataFrame(x, "vec_id long, embedding array<float>").withColumns({c: F.lit(7) for c in ("d", "part", "score", "rank", "query_id")})
    got, report = {}, {}
    for r in ann.nearest(spark, df, part_rows=256, report=report).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert got.pop(9060) == [(1, 9061, 3.0), (2, 9062, 2.0)]  # among its own dimension
    # the classifier finds the clusters, so few parts are asked
    assert report[16]["parts"] == 11 and report[16]["asked"] <= 5 and report[16]["recall"] >= 0.93
    ids = np.array([i for i, v in x[:3060]])
    m = np.array([v for _, v in x[:3060]], np.float64)
    hit = 0
    for q, found in got.items():
        want = sorted(((-float(s), int(i)) for s, i in zip(m @ m[ids == q][0], ids) if i != q))[:20]
        assert [f[0] for f in found] == list(range(1, 21))
        hit += len({f[1] for f in found} & {w[1] for w in want})
    assert len(got) == 153 and hit / (20 * len(got)) >= 0.9
    same = [f[1] for f in got[40] if f[1] >= 3000]
    assert len(same) > 5 and same == list(range(3000, 3000 + len(same)))
    assert ann.nearest(spark, df.where("vec_id is null")).count() == 0


def test_licenses(spark, docs, none):
    got = {(r.doc_id, r.line_no, r.family) for r in licenses.scan(docs).collect()}
    assert got == {(19, 1, "apache-2.0"), (20, 1, "all-rights-reserved"), (23, 1, "mit")}
    assert licenses.scan(none).count() == 0 and licenses.model().accuracy > 0.9
    for family, texts in licenses.TEMPLATES.items():
        assert all(licenses.model().judge(t.encode(), 0.5, 0.6)[0] == family for t in texts)
    assert all(licenses.model().judge(t.encode(), 0.5, 0.6) is None for t in licenses.OTHER)


def test_quality(spark, docs, none):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.classify(spark, spark.read.parquet(f"{sf}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").collect()
    assert all(quality.crc_fold(r.doc_id) == 2 for r in got) and np.mean([r.predicted == r.quality for r in got]) > 0.9
    odd = spark.createDataFrame([(0, 1), (1, 0), (2, None), (None, 1), (5, 7), (0, 1)], "doc_id long, quality int")
    rows = quality.classify(spark, docs, odd).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality.classify(spark, docs, odd.where("quality > 5")).collect()} == {0.5}
    assert quality.classify(spark, none, odd).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.001"
    start = now = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in cp.STAGES[:3]:
        now = stage(spark, now, sf)
        assert now.columns == start.columns
    text = {r.doc_id: r.text for r in now.collect()}
    mixed = cp.mix(spark, now, sf)
    assert mixed.columns == start.columns
    took = Counter()
    for r in mixed.collect():
        took[r.doc_id] += len(r.text.split())
        assert set(r.text.split()) <= set(text[r.doc_id].split()) and r.n_chars == len(r.text)
    want = {r.doc_id: r.taken for r in mixing.taken_words(*mixing.mix_sources(spark, now, weights=[3, 1, 2], share=1.5)).collect() if r.taken}
    assert took == want
    assert cp.tokens(spark, mixed, sf).count() == mixed.count()


def test_library_ids_of_runs_are_the_librarys_of_texts():
    import random
    from array import array

    from tidelog.llm.bpe import vocabulary
    from tidelog.llm.token_file import LibraryIds

    rnd = random.Random(5)
    signs = "aAbs'tTS<|endoftext|> \x1c\x1d\x85\xa0 ́é Σς9٣,.\x00\x7f漢字ﬁDž🙂"
    texts = ["".join(rnd.choices(signs, k=rnd.randrange(40))) for _ in range(3000)]
    texts += ["", "<|endoftext|>", "x<|startoftext|>y z", "Ab" * 3000, "don't 12 it's,"]
    ids = LibraryIds(vocabulary(), most=50)  # generations change often
    assert ids.by_run
    found = [x for lo in range(0, len(texts), 100) for x in ids.encode_many(texts[lo : lo + 100])]
    assert found == [array("I", e.ids).tobytes() for e in ids.library.encode_batch(texts, add_special_tokens=False)]


def test_heavy_line_keys_are_joined_like_others(spark, monkeypatch):
    from tidelog.llm.lines import LineIndex

    common, rare = "a line that a great many documents hold, word for word", "another line of over forty code points that some hold"
    docs = spark.createDataFrame([(i, f"{common}\nown {i}" + (f"\n{rare}" if i % 8 == 0 else "")) for i in range(60)], "doc_id long, text string")
    for heavy in (0, 2, 1000):
        monkeypatch.setattr(LineIndex, "HEAVY_KEYS", heavy)
        got = {r.doc_id: r.n_dropped for r in LineIndex(spark).insert(docs).apply(docs).collect()}
        assert got == {i: (i != 59) + (i % 8 == 0 and i != 56) for i in range(60)}


def test_words_cut_on_bytes_are_the_librarys():
    import random
    from array import array

    from tidelog.llm.bpe import vocabulary
    from tidelog.llm.token_file import LibraryIds

    rnd = random.Random(7)
    kinds = ("aAbsStTrReEvVlLmMdD'''' 12,.!\n\tÉéß×÷ÀÿÖ", "stredmlv'' ,9é", "J̌ǰIİi̇ aé,\xa0　x'S\n")
    texts = ["".join(rnd.choices(signs, k=rnd.randrange(40))) for signs in kinds for _ in range(1500)]
    texts += ["<|ENDOFTEXT|> É<|ENDOFTEXT|>", "'store's''s I'LL WE'VEd", "é" * 400 + " x"]
    ids = LibraryIds(vocabulary())
    want = [array("I", e.ids).tobytes() for e in ids.library.encode_batch(texts, add_special_tokens=False)]
    for piece in (60, LibraryIds.PIECE):
        ids.PIECE = piece
        assert ids.encode_many(texts) == want


def test_wrapped_notices_are_found_whole(spark):
    gpl = """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version."""
    bsd = """dnl Redistribution and use in source and binary forms, with or without
dnl modification, are permitted provided that the following conditions are met:"""
    mit = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights"""
    apache = """// http://www.apache.org/licenses/
//
// Unless required by applicable law or agreed to in writing, software
// distributed under the License is distributed on an "AS IS" BASIS,
// WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""
    prose = "\n".join(licenses.OTHER)
    texts = [f"/*\n{gpl}\n */\nint x;", bsd, f"{prose}\n{mit}\n{prose}", apache, prose, f"{bsd}\n\n{mit}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.family, r.line_no, r.last_line, r.fresh) for r in licenses.scan(docs).collect()}
    n = len(licenses.OTHER)
    assert got == {
        (0, "gpl-3.0", 2, 5, 4), (1, "bsd-3-clause", 1, 2, 2), (2, "mit", n + 1, n + 3, 3), (3, "apache-2.0", 3, 5, 3), (5, "bsd-3-clause", 1, 2, 2), (5, "mit", 4, 6, 3),
    }
    long = f"{prose} {mit} {prose} {bsd}".replace("\n", " ").encode()
    assert [f[2] for f in licenses.model().find([long], 0.5, 0.6)] == ["bsd-3-clause", "mit"]


def test_each_license_of_a_line_and_no_neighbour():
    def families(text):
        return [f[2] for _, lines_ in licenses.paragraphs(text.encode()) for f in licenses.model().find(lines_, 0.5, 0.6)]

    gpl = "This {} is free software; you can redistribute it and/or\nmodify it under the terms of the GNU {}General Public License as published by\nthe Free Software Foundation; either version {} of the License, or any later version."
    assert families("Licensed under the MIT license or the Apache License, Version 2.0") == ["apache-2.0", "mit"]
    assert families(gpl.format("program", "", "3")) == ["gpl-3.0"] and families("Licensed under the Apache License, v2.0") == ["apache-2.0"]
    assert families("Licensed under CC BY-NC 4.0.") == ["cc-by-nc-4.0"] and families("Licensed under CC BY 4.0.") == ["cc-by-4.0"]
    assert [families(gpl.format(*x)) for x in (("program", "", "2"), ("library", "Lesser ", "2.1"), ("library", "Lesser ", "3"), ("program", "Affero ", "3"))] == [["gpl-2.0"], ["lgpl-2.1"], ["lgpl-3.0"], ["agpl-3.0"]]
    assert families("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0\nInternational License.") == ["cc-by-sa-4.0"]
    assert families("Licensed under CC BY-NC-SA 4.0") == ["cc-by-nc-sa-4.0"] and families("Licensed under the Apache License, Version 1.1") == ["apache-1.1"]
    for other in (gpl.format("program", "", "1"), "Licensed under CC BY-NC-ND 4.0", "Licensed under the Apache License, Version 3.0", "Licensed under the Python License, Version 2.0"):
        assert families(other) == []


def test_texts_with_more_runs_than_are_remembered(library):
    own = bpe.WordBPE(bpe.vocabulary(), most=50)
    texts = [" ".join(f"{kind}{i}" for i in range(at, at + 120)) for kind, at in (("id", 0), ("id", 60), ("n<|endoftext|>", 0), ("é", 0), ("id", 0))]
    for batch_ in ([t] for t in texts), [texts[:2], texts[2:]], [texts * 2]:
        for group in batch_:
            assert [np.frombuffer(x, "<u4").tolist() for x in own.encode_many(group)] == [library.encode(t, add_special_tokens=False).ids for t in group]


def test_large_groups_of_near_copies_are_split(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE_ROWS", 16)
    tiles, links = [], jaccard._tile_links

    def seen(postings, *rest):
        tiles.append(postings.groupBy("key").count().agg(F.max("count")).first()[0])
        return links(postings, *rest)

    monkeypatch.setattr(jaccard, "_tile_links", seen)
    common = " ".join(f"c{i}" for i in range(200))
    rows = [(i, f"{common} own{i}") for i in range(300)] + [(1000 + i, " ".join(f"x{i}y{j}" for j in range(60))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(spark, df, k=4, percent=85).collect()}
    assert got == {i: 0 if i < 1000 else i for i, _ in rows}
    assert len(tiles) == 1 and tiles[0] < 100  # about two blocks of 16, not the group of 300


def test_pipeline_stages_with_null_and_repeated_ids(spark, tmp_path):
    import corpus_pipeline as cp

    columns = "doc_id long, text string, lang string, source string, n_chars long"

    def table(rows):
        return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], columns).repartition(3)

    def kept(df):
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        got = df.collect()
        assert all(r.n_chars == len(r.text or "") for r in got)
        return Counter((r.doc_id, r.text) for r in got)

    # quality: rows of one doc_id, and of none, are judged one by one
    good = [f"In the year {i} the old harbour of the town was quiet, and people came to walk there in the evening. They spoke of the weather, and of ships number {i}." for i in range(12)]
    junk = [f"$$$ {i} >>> !!! ### {i * 7} @@@ ||| {{}} ~~~ %%% ^^^ 000 {i} --- === +++ $$$ !!!" for i in range(12)]
    spark.createDataFrame([(i, int(i < 100)) for i in [*range(8), *range(100, 108)]], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(i, t, "a") for i, t in enumerate(good[:8])] + [(100 + i, t, "a") for i, t in enumerate(junk[:8])]
    rows += [(None, good[8], "a"), (None, junk[8], "a"), (50, good[9], "a"), (50, junk[9], "a"), (51, good[10], "b"), (51, good[10], "b"), (52, junk[10], "b"), (52, junk[10], "b")]
    assert kept(cp.keep_quality(spark, table(rows), str(tmp_path))) == Counter((i, t) for i, t, _ in rows if t in good)

    # lines: what operator 6 keeps of each row
    rows = [(i, f"{LINE}\nown {i}", "a") for i in range(4)] + [(None, f"null\n{LINE}", "a"), (None, None, "a"), (2, f"x\n{LINE}\nsecond text", "a"), (2, "third text", "a"), (9, LINE, "a"), (9, f"{LINE}\n9", "a")]
    want = Counter((i, None if t is None else t if i == 9 else "\n".join(y for y in t.split("\n") if y != LINE)) for i, t, _ in rows)
    assert kept(cp.drop_lines(spark, table(rows), "")) == want

    # near copies: by each row's own group; null doc_ids stay
    other = " ".join(f"o{i}" for i in range(60))
    rows = [(1, A, "a"), (2, A + " tail", "a"), (None, A, "a"), (None, A, "a"), (1, A, "a"), (1, "of its own", "a"), (6, other, "a"), (6, other, "a"), (7, other, "a")]
    assert kept(cp.one_of_each_group(spark, table(rows), "")) == Counter((i, t) for i, t, _ in rows if i not in (2, 7))

    # mix: each row gives its own words, as often as operator 4 takes them
    rows = [(i, n, s) for i, n, s in [(None, 150, "a"), (None, 90, "a"), (None, 70, None), (3, 200, "a"), (3, 130, "b"), (3, 40, "a"), (4, 64, "b"), (4, 64, "b"), (5, 300, None), (6, 0, "a"), (7, 500, "b")]]
    docs = table([(i, " ".join(f"{i}-{n}-{j}" for j in range(n)), s) for i, n, s in rows])
    want = Counter()
    for r in mixing.taken_words(*mixing.mix_sources(spark, docs, weights=[3, 1, 2], share=1.5)).collect():
        want[f"{r.doc_id}-{r['size']}"] += r.taken
    took = Counter(w.rsplit("-", 1)[0] for (_, t), n in kept(cp.mix(spark, docs, "")).items() for w in t.split() * n)
    assert took == +want and {"None-150", "None-90", "3-130"} & set(took)
