"""The corpus pipeline: cleaned, deduplicated, mixed and packed documents.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns the columns of
documents, except the last, which returns one row per packed piece. A document without words, or whose
text is null, does not pass the first stage; what each stage does with other odd rows is told by the
operator it calls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import line_dedup, minhash_dedup, packing, quality_rules, source_mixing
from spanloom.llm.common import Scratch, ready, table
from spanloom.llm.queries import domain_labels, vocabulary

#: Shares of tokens after mixing, of the total in which clean tokens come once on average.
SHARES = {"clean": 0.99, "toxic": 0.01}
#: Words that a worker remembers while it packs.
WORDS_KEPT = 200_000


def counted(docs: DataFrame) -> DataFrame:
    """``docs`` with n_chars as its text now is."""
    return docs.withColumn("n_chars", F.char_length("text").cast("bigint"))


def slim(spark: SparkSession) -> SparkSession:
    """``ready``, with still smaller batches: the stages share workers, and whole rows go through them."""
    ready(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    return spark


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail the rules go from the text, documents that are rejected go altogether."""
    slim(spark)
    return counted(quality_rules.clean(docs))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more share go from every text."""
    return counted(line_dedup.dedup_lines(docs, min_docs=10, min_chars=1))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word shingle similarity 0.8 stays."""
    return minhash_dedup.drop_near_duplicates(docs, width=5, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mixture's rates say, on average."""
    labels = domain_labels(table(spark, sf_dir, "labels"))
    return source_mixing.mixed(docs, labels, SHARES, anchor="clean")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequence and place."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), capacity=2048, kept=WORDS_KEPT)


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Shingle similarity, the classifier and the tokenizer cannot be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written before the next one reads it."""
    scratch = Scratch(slim(spark))
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
