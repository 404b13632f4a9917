"""A training-corpus pipeline: five stages, each over all that the one before kept.

ORACLE_SQL is None: a trained classifier and a latent search are not SQL. tests/llm/test_pipeline.py holds
the stages against brute force, or planted cases where they are learned.

In every stage: an empty table gives an empty table; columns beyond those of documents play no part;
a row with a null doc_id is a row like any other, ranked last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common as C
from tidemark.llm.op1_substring import substring_dedup
from tidemark.llm.op2_bpe import bpe_encode, default_tokenizer
from tidemark.llm.op3_jaccard import near_duplicate_filter
from tidemark.llm.op5_quality import quality_filter
from tidemark.llm.op10_decontaminate import decontaminate

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
CARRIED = ["lang", "source"]
CARRIED_SCHEMA = "lang string, source string"
ORACLE_SQL = None


def _carried() -> list:
    rest = F.from_json("rest", CARRIED_SCHEMA)
    return [rest[c].alias(c) for c in CARRIED]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    Null and empty texts, and those of white space, have no votes and fall to the scorer's bias, all alike; so do repeated rows.
    """
    return quality_filter(docs.select(*COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8): the smallest doc_id's.

    Null and wordless texts are near to nothing and stay. Of repeated rows, and of rows that tie by doc_id, one stays.
    """
    kept = near_duplicate_filter(docs.select(*COLUMNS), size=5, num=8, den=10, carry=CARRIED)
    return kept.select("doc_id", "text", *_carried(), F.length("text").cast("long").alias("n_chars"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of 50-word passages that a smaller doc_id holds too; emptied documents go.

    Words are joined by one space. Null texts stay null, and texts that were empty before stay. Rows of one doc_id keep
    what they share.
    """
    found = substring_dedup(docs.select(*COLUMNS), carry=CARRIED)
    found = found.filter(~((F.col("n_removed") > 0) & (F.col("kept") == "")))
    return found.select("doc_id", F.col("kept").alias("text"), *_carried(), F.length("kept").cast("long").alias("n_chars"))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none and stay; all rows of a leaking doc_id go, one without a doc_id stays."""
    return decontaminate(docs.select(*COLUMNS), C.table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether they decode to it. A null text counts as empty; repeated rows are encoded each."""
    found = bpe_encode(docs.select(*COLUMNS), default_tokenizer(), carry=["text", *CARRIED])
    rest = F.from_json("rest", "text string, " + CARRIED_SCHEMA)
    return found.select("doc_id", rest["lang"].alias("lang"), rest["source"].alias("source"), "ids", F.size("ids").cast("long").alias("n_tokens"), (F.col("decoded") == F.coalesce(rest["text"], F.lit(""))).alias("exact"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("benchmark_leaks", benchmark_leaks), ("encoded", encoded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written and read again."""
    docs = C.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        new = C.written(stage(spark, docs, sf_dir))
        if k:
            C.dropped(docs)
        docs = new
    return docs
