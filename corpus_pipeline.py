"""A corpus from documents to token ids: quality, near duplicates, repeated passages, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each stage's result as Parquet to the shared folder and gives it to the next.
Rows of one doc_id and text count as one document from the second stage on;
different texts of one id are documents of their own.

Every stage reads the columns of documents alone, so others of any name are no
trouble, and gives an empty table for an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, minhash, mixing, quality, substring
from tidemark.llm.storage import materialise, read, settled
from tidemark.session import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Models and hash choices are not SQL; tests/llm/test_pipeline.py has a brute-force version of all that follows the model.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject.

    Null and empty texts and null metadata are scored like any other. Repeated
    rows score alike, and all of them stay or go. A document whose score is the
    threshold stays; so do all where no labels of both classes exist.
    """
    docs = docs.select(*COLUMNS)
    model = quality.train(docs, read(ship(spark), sf_dir, "labels"))
    return quality.score(docs, model).where("kept").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each component at 0.8 over five-word shingles.

    Null, empty and blank texts have no shingles and stay, as do documents without
    an id. Of repeated rows (one id and text) one is left; of near texts under one
    id, the one with the smallest hash.
    """
    ship(spark)
    docs = docs.select(*COLUMNS)
    one = ["doc_id", "copy"]
    gone = settled(lambda: minhash.judged_copies(docs).where("NOT kept").select(*one).distinct(), "gone")
    docs = docs.withColumn("copy", F.xxhash64("text"))
    out = docs.join(gone, one, "left_anti").select(*COLUMNS, "copy")
    repeated = materialise(docs.where("doc_id IS NOT NULL").groupBy(*one).count().where("count > 1").select(*one), "repeated")
    if not repeated.head(1):
        return out.select(*COLUMNS)
    several = out.join(repeated, one, "left_semi").dropDuplicates(one)
    return out.join(repeated, one, "left_anti").select(*COLUMNS).union(several.select(*COLUMNS))


def strip_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words that an earlier one has; documents with nothing left go.

    Null and empty texts have no passages: they stay, with an empty text. Rows of
    one id never take words from each other; rows without an id keep all words.
    Texts that lose nothing stay as they are, with their white space.
    """
    ship(spark)
    out = substring.strip_repeats(docs, give="text", carry=("lang", "source"))
    out = out.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    return out.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes.

    Null, empty and blank texts have no words and are not taken. A null source is a
    source. Repeated rows (one id, source and text) each have their own turn in the
    order; ties go by id, size and text, so which of equal rows is taken doesn't show.
    """
    docs = docs.select(*COLUMNS)
    same = ["doc_id", "source", "copy_key"]
    counts = F.sum(F.col("taken").cast("int")).alias("copies"), F.sum((F.col("copy") == 1).cast("int")).alias("rows")
    copies = settled(lambda: mixing.mix(docs).groupBy(*same).agg(*counts).where("copies > 0"), "copies").alias("c")
    rows = docs.withColumn("copy_key", F.xxhash64("text")).alias("d")
    rows = rows.join(copies, [F.col(f"d.{k}").eqNullSafe(F.col(f"c.{k}")) for k in same]).select("d.*", "c.copies", "c.rows")
    if copies.where("rows > 1").head(1):
        rows = rows.where("rows = 1").unionByName(rows.where("rows > 1").dropDuplicates(same))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mix, and whether they decode to its text.

    A null text counts as empty and has no ids. Repeated rows stay, each with its ids.
    """
    ship(spark)
    coded = bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, carry=("doc_id", "source", "text"))
    whole = F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "utf-8")
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", whole.alias("decodes"))


STAGES = [
    ("quality classifier", keep_quality),
    ("minhash near-dedup", drop_near_duplicates),
    ("substring dedup", strip_passages),
    ("mixing sources", mix_sources),
    ("byte-level bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = read(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
