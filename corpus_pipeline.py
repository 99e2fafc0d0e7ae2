"""From raw documents to training sequences: five stages, each one of the corpus operators.

Every stage takes (spark, docs, sf_dir) and returns the documents that it keeps; the last returns packed pieces. A runner
writes each stage's rows and reads them again as the next stage's docs.

For all stages: a null text has no words; a null id is kept as it is and takes no other row along; rows that repeat an id are
documents of their own; other columns are handed on, whatever their names; an empty table gives an empty result; very long
texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import bayes_dedup, curriculum, exact_dedup, genetic_packing, quality
from gridloom.llm.common import ready, table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier rejects go.

    A null, empty or blank text is rejected. The verdict is a text's, so repeated rows and equal texts share it; where no
    text is more likely bad than good, all others stay.
    """
    ready(spark)
    return quality.keep_good(docs)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased, null as empty) the smallest id stays, null after all ids.

    Of rows that repeat the staying id with an equal text one stays; another text of that id is a document of its own.
    """
    ready(spark)
    return exact_dedup.drop_exact_duplicates(docs, keep="min")


def unlike_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the smallest id stays, null after all ids, of its texts the one with the smallest hash.

    A text without words is like no other and stays; of rows that agree in id and text one stays.
    """
    ready(spark)
    return bayes_dedup.drop_near_duplicates(docs)


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources take their target shares; a document that is used twice occurs twice.

    The null source is one of its own, last in order; a text without words is used once; rows that agree in id, source and
    text are used as often together as the plan says.
    """
    ready(spark)
    return curriculum.take_mix(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens.

    A null or empty text is one piece of length 1; repeated rows are packed as often as they come.
    """
    ready(spark)
    return genetic_packing.pack(docs)


STAGES = [
    ("quality_classifier", good_documents),
    ("exact_dedup", distinct_documents),
    ("minhash_near_dedup", unlike_documents),
    ("curriculum_mix", mixed_documents),
    ("genetic_packing", packed_sequences),
]

#: The classifier is fitted, so SQL cannot state the rows; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
