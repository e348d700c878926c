"""A training corpus from raw documents: STAGES, each an operator of tidelog.llm.

Every stage reads all that the one before it kept, and its decisions take effect.
All but the last return the columns of documents.

Decisions are made for rows and joined to rows (`keyed`): a row with a null or
repeated doc_id gets what its operator says of that row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import bpe, jaccard, lines, mixing, quality
from tidelog.llm.common import keyed, stored, sweep, written


def _without(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Keyed docs without the rows found, and without the key."""
    gone = found.select(F.col("__row").alias("__gone")).distinct()
    return docs.join(gone, F.col("__row") == F.col("__gone"), "left_anti").drop("__row")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts.  A document is rejected below 0.5: clean ones stay.

    Each row is judged by its own text, whatever its doc_id.
    """
    docs = keyed(docs)
    found = quality.classify(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.5, carry=("__row",))
    return _without(docs, found.where("predicted = 0"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long lines found in five documents or more stay in one of them, that with the largest doc_id; n_chars follows the text.

    Rows under one doc_id are one document and keep or lose the line together; the rows with a null
    doc_id are one document, which loses it.
    """
    columns, docs = docs.dtypes, keyed(docs)
    found = lines.LineIndex(spark).insert(docs).apply(docs, carry=("__row",)).where("n_dropped > 0")
    # rows of one key have one doc_id and one text, so one kept text
    found = found.select(F.col("__row").alias("__id"), F.col("kept_text").alias("__kept")).dropDuplicates(["__id"])
    kept = docs.join(found, F.col("__row") == F.col("__id"), "left")
    text = F.coalesce("__kept", "text")
    out = [text.alias(c) if c == "text" else F.when(F.col("__kept").isNull(), F.col(c)).otherwise(F.char_length("__kept").cast(t)).alias(c) if c == "n_chars" else F.col(c) for c, t in columns]
    return kept.select(*out)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that near-duplicate links join, the one with the smallest doc_id stays.

    Rows repeated under one doc_id are one document to the operator, so all rows under that
    smallest doc_id stay; a row under another one goes if the group of its own text has a smaller doc_id.  Rows with a null
    doc_id have no partners and stay.
    """
    docs = keyed(docs)
    found = jaccard.near_duplicates(spark, docs, k=5, percent=80, carry=("__row",))
    return _without(docs, found.where("component_id <> doc_id"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as documents: the words taken of a document, a row for each time a run of its blocks is taken.

    Runs are whole documents where every block is taken alike; the times a
    document is taken in whole are that many rows.  A part of a document is a row of its own
    with the words of the blocks that were taken once more.

    A row with a null or repeated doc_id has its own place in its source and gives its own words.  Of rows alike
    in all columns any one stands for each of their places.
    """
    columns, docs = docs.dtypes, keyed(docs)
    placed, taken = mixing.mix_sources(spark, docs, weights=[3, 1, 2], share=1.5, most=2.0, carry=("__row",))
    times = taken.groupBy("source_key", "at", "from_word", "n_words").agg(F.count("*").alias("times"))
    pieces = times.groupBy("source_key", "at").agg(F.sort_array(F.collect_list(F.struct("from_word", "n_words", "times"))).alias("pieces"))
    rows = placed.where("size > 0").select("source_key", "at", F.col("__row").alias("__id"))
    rows = rows.join(pieces, ["source_key", "at"]).select("__id", "pieces")
    out = docs.dropDuplicates(["__row"]).join(rows, F.col("__row") == F.col("__id"))
    most = F.array_max(F.transform("pieces", lambda p: p["times"])).cast("int")
    out = out.withColumn("__take", F.explode(F.sequence(F.lit(1), most))).withColumn("__words", F.regexp_extract_all("text", F.lit("([^\\x20\\x09-\\x0D]+)"), F.lit(1)))
    used = F.filter("pieces", lambda p: p["times"] >= F.col("__take"))
    words = F.flatten(F.transform(used, lambda p: F.slice("__words", (p["from_word"] + 1).cast("int"), p["n_words"].cast("int"))))
    whole = F.size(words) == F.size("__words")
    out = out.withColumn("__text", F.when(whole, F.col("text")).otherwise(F.array_join(words, " ")))
    return out.select(*[F.col("__text").alias(c) if c == "text" else F.char_length("__text").cast(t).alias(c) if c == "n_chars" else F.col(c) for c, t in columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the corpus is trained on: ids of each row's text, 32-bit little-endian."""
    return bpe.encode(docs, bpe.vocabulary())


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", one_of_each_group),
    ("mixing sources to target weights", mix),
    ("BPE encoding", tokens),
]

#: No SQL: the classifier, the mix and the encoding have none.  Tests compare stages with brute-force versions of their decisions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after another; what a stage stored on its way is deleted once its rows are.

    An empty table goes through all stages; so do nulls, empty texts and repeated rows, as each stage says.
    """
    docs, mark = spark.read.parquet(f"{sf_dir}/documents.parquet"), written()
    for name, stage in STAGES:
        docs = stored(spark, stage(spark, docs, sf_dir), name.replace(" ", "-"))
        sweep(spark, mark, docs)
    return docs
