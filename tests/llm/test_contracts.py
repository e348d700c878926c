"""What the operators say of odd tables: brute force, repeated rows, clashing columns, very long texts, filters in rounds."""

import hashlib
import math
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm import bpe, common, exact_dedup, jaccard, licenses, lines, mixing, quality, substring, token_file

LINE = "A line that is long enough to be counted as one"
DOCS = "doc_id long, text string, source string"


def test_scores_follow_from_statistics(spark):
    """Operator 1 against its formulas in plain numpy, over all labelled rows."""
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = {r.doc_id: np.array(quality.statistics((r.text or "").encode())) for r in docs.collect()}
    marks = [(r.doc_id, r.quality) for r in labels.collect() if r.doc_id in rows and quality.crc_fold(r.doc_id) != 2]
    density, count = [], []
    for k in (0, 1):
        x = np.array([rows[i] for i, y in marks if y == k])
        count.append(len(x))
        density.append((x.mean(0), np.cov(x.T, bias=True)))
    everything = np.array([rows[i] for i, _ in marks])
    pooled = np.diag(everything.var(0))

    def z(v):
        out = []
        for (mean, cov), n in zip(density, count):
            few = 1 / (1 + n / 50)
            cov = 0.9 * cov + 0.1 * np.diag(np.diag(cov))
            cov = (1 - few) * cov + few * pooled + 1e-3 * np.eye(len(v))
            out.append(-0.5 * (v - mean) @ np.linalg.solve(cov, v - mean) - 0.5 * np.linalg.slogdet(cov)[1])
        return 0.25 * (out[1] - out[0]) + math.log((count[1] + 1) / (count[0] + 1))

    got = quality.classify(spark, docs.withColumns({"x": F.lit(1), "score": F.lit("a")}), labels.withColumn("text", F.lit("q"))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.score == pytest.approx(1 / (1 + math.exp(-max(-700, min(700, z(rows[r.doc_id]))))), abs=1e-6)
        assert r.predicted == (r.score >= 0.7) and r.held_out == (quality.crc_fold(r.doc_id) == 2)


def test_mix_follows_from_its_blocks(spark):
    """Operator 4: taken words recomputed from the blocks drawn; each block is drawn floor or ceil times."""
    rows = [(i, " ".join(f"w{j}" for j in range((i * 37) % 211)), "abc"[i % 3] if i % 7 else None) for i in range(120)]
    df = spark.createDataFrame(rows, DOCS).withColumns({"size": F.lit("x"), "block": F.lit(1), "shard": F.lit(2)}).repartition(5)
    placed, mix = mixing.mix_sources(spark, df, weights=[3, 1, 2], share=1.5, block=16, shard_slots=32)
    drawn = Counter((r.source_key, r.block) for r in mix.select("source_key", "block", "shard", "slot").distinct().collect())
    spots = sorted(((r.source_key, r["at"], r["size"], r.doc_id, r.target, r.source_size) for r in placed.collect()), key=repr)
    for key in {s[0] for s in spots}:
        at = 0
        for s in sorted((s for s in spots if s[0] == key and s[2]), key=lambda s: s[1]):
            assert s[1] == at  # documents lie one after another
            at += s[2]
        share = next(s[4] / s[5] for s in spots if s[0] == key)
        times = [drawn[key, b] for b in range(-(-at // 16))]
        assert min(times) >= math.floor(share) and max(times) <= math.ceil(share)
    want = {s[3]: sum(drawn[s[0], w // 16] for w in range(s[1], s[1] + s[2])) for s in spots}
    assert {r.doc_id: r.taken for r in mixing.taken_words(placed, mix).collect()} == want


def test_many_sources_and_blocks_draw_alike(spark, monkeypatch):
    rows = [(i, "a b c d e f g " * (1 + i % 5), f"s{i % 90}") for i in range(400)]
    df = spark.createDataFrame(rows, DOCS)
    run = lambda: sorted(map(tuple, mixing.taken_words(*mixing.mix_sources(spark, df, block=4)).collect()))
    sent = run()
    monkeypatch.setattr(mixing, "MOST_SENT", 10)
    assert run() == sent and sum(r[4] for r in sent) > 0


def test_permutations_of_a_great_many_blocks(spark):
    n = (1 << 33) + 12345
    plan = [{"source_key": "=a", "source_size": n * 64, "target": 1.0, "blocks": n, "slots": 500}]
    got = mixing.slots_of(spark, plan, 500, 64, 17).collect()
    assert len({r.block for r in got}) == 500 and all(0 <= r.block < n for r in got) and max(r.block for r in got) > 1 << 32


def test_slots_are_never_broadcast_nor_made_by_one_task(spark):
    """Operator 4 and the pipeline's mix: slots grow with the input, though Spark estimates them by the few counts they come from."""
    rows = [(i, "a b c d e f g " * (1 + i % 5), f"s{i % 9}") for i in range(400)]
    placed, mix = mixing.mix_sources(spark, spark.createDataFrame(rows, DOCS), block=4)
    met = mix.groupBy("source_key", "at").agg(F.sum("n_words").alias("words"))
    assert abs(sum(r.words for r in met.collect()) - sum(7 * (1 + i % 5) for i in range(400))) < 9 * 4  # but for sources' last blocks
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "SortMergeJoin [source_key" in plan.split("== Initial Plan ==")[0]
    plan = [{"source_key": "=a", "source_size": 64_000, "target": 64_000.0, "blocks": 1000, "slots": 1000}]
    tasks = mixing.slots_of(spark, plan, 1000, 8, 17).groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).collect()
    assert sum(r.n for r in tasks) == 1000 and len(tasks) == 4


def test_rows_of_one_document_count_once(spark):
    """Operator 6 and its SQL: four rows under one doc_id are one document, whichever insert brought them."""
    rows = [(1, LINE, "a")] * 4 + [(2, LINE, "a")] + [(i, f"{LINE} again", "a") for i in (1, 1, 2, 3, 4)] + [(5, f"x\n{LINE} again", "a"), (6, None, "a"), (7, "", "a")]
    df = spark.createDataFrame(rows, DOCS)
    got = sorted(tuple(r) for r in lines.LineIndex(spark).insert(df).apply(df).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256)).collect())
    assert sum(r[2] for r in got) == 5
    two = lines.LineIndex(spark).insert(df.limit(7)).insert(df)
    assert sorted(r[:3] for r in two.apply(df).select("doc_id", "n_lines", "n_dropped").collect()) == [r[:3] for r in got]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    assert sorted(con.sql(lines.OP6_SQL).fetchall()) == got


def test_filters_are_asked_in_rounds(spark, monkeypatch):
    texts = [(i, "\n".join(f"line {j} of those that are found in a number of documents" for j in range(i % 9 * 20, i % 9 * 20 + 40)), "a") for i in range(90)]
    df = spark.createDataFrame(texts, DOCS).repartition(3)
    run = lambda: sorted(map(tuple, lines.LineIndex(spark, shard_keys=16).insert(df).apply(df).collect()))
    whole, asked = run(), []
    stored = lines.stored
    monkeypatch.setattr(lines, "stored", lambda s, d, tag, **kw: (asked.append(tag), stored(s, d, tag, **kw))[1])
    monkeypatch.setattr(lines.LineIndex, "ROUND_BYTES", 600)
    assert run() == whole and sum(r[2] for r in whole) > 1000 and asked.count("line-known") >= 3


def test_stored_tables_are_swept(spark):
    mark = common.written()
    a, b = (common.stored(spark, spark.range(3), t) for t in "ab")
    common.sweep(spark, mark, b)
    path = spark._jvm.org.apache.hadoop.fs.Path
    there = lambda d: path(d._stored_at).getFileSystem(spark._jsc.hadoopConfiguration()).exists(path(d._stored_at))
    assert not there(a) and there(b) and b.count() == 3


def test_very_long_texts(spark):
    """Texts of several MB: words in rows, one word, and one that repeats itself."""
    many = " ".join(f"w{i * 7919 % 300_007}" for i in range(300_000))
    rows = [(0, many, "a"), (1, "x" * 3_000_000, "a"), (2, "one two three " * 150_000, "b"), (3, many, "b"), (4, many + " more", "b"), (5, None, None)]
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("clash") for c in ("n", "h", "ids", "rep", "key", "row", "sha", "bucket", "norm", "tie")}).repartition(3)
    words = [len((r[1] or "").split()) for r in rows]
    got = {r.doc_id: r.keep_id for r in exact_dedup.exact_dedup(spark, df, keep="max").collect()}
    assert got == {0: 3, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5}
    assert {r.doc_id: r.component_id for r in jaccard.near_duplicates(spark, df, k=4, percent=85).collect()} == {0: 0, 1: 1, 2: 2, 3: 0, 4: 0, 5: 5}
    cut = {r.doc_id: (r.n_words, r.n_removed) for r in substring.remove_repeats(spark, df, window=35).collect()}
    assert cut == {0: (words[0],) * 2, 1: (1, 0), 2: (words[2],) * 2, 3: (words[0],) * 2, 4: (words[4], words[0]), 5: (0, 0)}
    assert [r.taken <= 2 * r["size"] for r in mixing.taken_words(*mixing.mix_sources(spark, df, weights=[3, 1, 2], share=1.5)).collect()] == [True] * 6
    kept = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in lines.LineIndex(spark).insert(df).apply(df).collect()}
    assert kept == {r[0]: (1, 0, r[1] or "") for r in rows}
    assert licenses.scan(df).count() == 0
    assert all(0 <= r.score <= 1 for r in quality.classify(spark, df, spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int")).collect())
    counts, blocks = token_file.write_tokens(spark, df, bpe.vocabulary(), size=1 << 20)
    read = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in token_file.joined_crc(token_file.read_tokens(spark, counts, blocks)).collect()}
    own = {r.doc_id: r.n_tokens + 1 for r in bpe.encode(df, bpe.vocabulary()).collect()}
    assert {i: n for i, (n, _) in read.items()} == own and read[0] == read[3]


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert bpe.digests(spark, none, bpe.vocabulary()).count() == 0
    import corpus_pipeline as cp

    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.count() == 0


def test_equal_hashes_of_different_texts_are_told_apart(spark):
    rows = [(i, f"text {i % 7}", "a") for i in range(40)]
    got = exact_dedup.exact_dedup(spark, spark.createDataFrame(rows, DOCS), content_hash=lambda c: F.unhex(F.lit("00"))).collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got} == {(i, i % 7, len(range(i % 7, 40, 7))) for i in range(40)}
    assert {r.text_sha256 for r in got} == {hashlib.sha256(f"text {i}".encode()).hexdigest() for i in range(7)}
