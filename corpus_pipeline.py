"""A training-data pipeline: five stages over `documents`, each reading what the one before it wrote.

Every stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the
columns of `documents`. SQL can express neither the classifier nor the tokenizer: there is no ORACLE_SQL; tests hold the
stages against brute force.

Rows with a null id or text, empty texts, repeated rows and columns of any further name pass through every stage: a text that is null or
empty is judged by the classifier's intercept alone, is never near another or contaminated, is not rewritten, and has no tokens; of
equal texts with words one row stays. Empty tables give empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queuemill.llm import byte_bpe, decontamination, ngram_join, pii, toxicity
from queuemill.llm.queries import PSEUDONYM_KEY, TOKENS
from queuemill.runtime import materialise, table

ORACLE_SQL = None

#: Near duplicates: word shingles of five, similarity 0.8 or more.
SHINGLE, PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier, trained on the labelled ones among them, predicts toxic."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of documents connected by links the one with the smallest id stays; texts without words stay."""
    return ngram_join.keep_one(docs, SHINGLE, PERCENT)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, also with other numbers or names."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes pseudonyms into `text` and the new length into `n_chars`."""
    out = pii.pseudonymise(docs, PSEUDONYM_KEY)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the decoded bytes."""
    return byte_bpe.round_trip(docs, public_tokenizers.path(TOKENS), public_tokenizers.PATTERN)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated),
          ("personal_data", replace_personal_data), ("tokens", tokenise)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each result is written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
