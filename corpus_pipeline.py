"""The corpus pipeline: documents of known languages, without near copies, with pseudonyms, mixed, and encoded.

STAGES are (name, function) pairs. Each function takes (spark, docs, sf_dir) and works on all that the one before it
kept. All but the last return the columns of documents, whatever further columns there are. An empty table goes through
all stages. SQL can't express the stages, so ORACLE_SQL is None and tests/llm compares the pipeline with a brute-force
version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import langid, mixing, neardup, pieces, pii
from palimpsest.llm.common import checkpointed, table
from palimpsest.llm.queries import pii_key

#: Near copies share this part (in hundredths) of their 5-word shingles.
NEAR_PERCENT = 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those that are like no language more than noise is.

    A null or empty text goes; short texts with a letter stay. Repeated rows are judged alike, each by its text alone. A
    null doc_id or lang teaches nothing and changes nothing else. Without any labelled row nothing stays.
    """
    return langid.keep_known(docs, *langid.train(docs.where(~langid.held_out(F.col("doc_id")))))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, that with the smallest doc_id.

    Texts without words all stay. Rows that repeat a doc_id stay once for each text that is kept; a null doc_id is kept
    only where its group has no other.
    """
    return neardup.keep_one(docs, NEAR_PERCENT)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by pseudonyms of the same format; no row goes. n_chars is that of the new text, null for null.

    Equal texts get equal new ones, in repeated rows too.
    """
    return pii.pseudonymise(docs, pii_key(spark)).withColumn("n_chars", F.length("text").cast("long"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source up to its target size, each row as often as the balanced sample has it.

    A null source is a source; a null or empty text has no words and counts as a document. Rows that repeat an id, or
    are wholly equal, are each a unit of the sample.
    """
    return mixing.apply_mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, samples (distinct sampled segmentations) and whether they all decode to the text.

    A null text has null samples. Rows with the same doc_id and text have the same samples.
    """
    return pieces.encode(docs, ["doc_id", "lang", "source"], check=True)


STAGES = [("language", language), ("near copies", near_copies), ("pseudonyms", pseudonyms), ("mixture", mixture), ("encoded", encoded)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
