"""A training-data pipeline over ``documents``: each stage reads what the one before wrote.

Defined results, for every stage: an empty table gives an empty table; columns
besides id, text and ``n_chars`` may have any names and come through unchanged
(the last stage returns only ids and tokens); null and empty texts are kept and
stay as they are; whole texts are read whatever their length. Rows that share an
id or have none are rows of their own, but for the near copies (see there).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import bpe, decontaminate, jaccard, suffixes, toxicity
from weftline.llm.common import materialise, table

#: The fewest words of a passage that is not to occur twice.
PASSAGE_WORDS = 51


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold; repeated rows go or stay together, labels without a document count for nothing."""
    return toxicity.drop_toxic(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: at least 80 % of their five-word shingles in common.

    The smallest id of a group stays, with all rows of that id; rows without an id stay. Texts without words link with nothing.
    """
    return jaccard.keep_one(docs, percent=80, words=5)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of over 50 words, or of 400 bytes, that occur more than once; ``n_chars`` follows.

    Every occurrence goes, the first too: a text all of which occurs elsewhere becomes empty, and its row stays.
    """
    return suffixes.remove_repeats(docs, words=PASSAGE_WORDS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of the benchmark occurs; items without words have no window, items of under ten words are one."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row; none for a null or empty text."""
    return bpe.encode(docs).select("doc_id", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("suffix_array_dedup", remove_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("bpe", encode),
]

#: Nearest neighbours, components and merged suffixes have no SQL form; tests/llm/test_pipeline.py holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
