"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir), works on all documents that the one
before kept, and returns the columns of ``documents``; the last one returns
the pieces of the packed sequences.

Defined results: a null or empty text, or one without a letter, goes in the
language stage; rows with equal ids and texts go through the first two stages
each, with the same result, and the near-dedup stage keeps one of them; rows
with equal ids and other texts count as one document there; rows with a null
id link with nothing and stay, one for each text; a null language or source
stays null; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillpoint.llm import decontamination, language_id, line_dedup, near_dedup, packing
from tillpoint.llm.common import read_table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
SHINGLE_WORDS = 5
PLAIN_BITS = 8
SLACK_BITS = 64


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language.  Rejected are those without a letter, and
    those that plain bytes code in ``SLACK_BITS`` bits fewer than any language's
    statistics.  The slack is on the whole text, so a short one with a number or
    a key in it stays, while an unlearned language exceeds it within a line."""
    known = language_id.identify(docs, keep=COLUMNS[2:])
    excess = (F.col("bits_per_byte") - PLAIN_BITS) * F.octet_length("text")
    return known.filter((F.col("lang_pred") != language_id.UNDETERMINED) & (excess < SLACK_BITS)).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that stand elsewhere before; one that loses
    all its lines goes."""
    cleaned = line_dedup.drop_repeats(docs.select(*COLUMNS))
    changed = F.col("removed_lines") > 0
    return (cleaned.filter(~changed | (F.trim("text") != ""))
            .withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
            .select(*COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each near-duplicate group."""
    kept = near_dedup.near_groups(docs, SHINGLE_WORDS).filter("kept").select(F.col("doc_id").alias("id")).distinct()
    return (docs.join(kept, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
            .dropDuplicates(["doc_id", "text"]).select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark", "item_id", "text")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("language", language), ("line_dedup", lines), ("near_dedup", near_duplicates),
          ("decontamination", decontaminate), ("packing", pack)]

# Neither language models nor sketches nor tokenizers are SQL; the tests hold
# every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", *COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
