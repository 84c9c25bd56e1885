"""From raw documents to token ids: language, near-duplicates, benchmark passages, personal data, tokens.

Each stage is written and read again before the next, so that a lost executor costs no more than a stage's own work.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.llm import bpe, decontaminate, language, pii, simhash
from gridlake.llm.common import aside, documents, put_back, staged

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


# Each stage says in its operator's docstring what becomes of null, empty and very long texts, ties, repeated rows and tables
# without rows. All but the last return the columns of their input in order, whatever the names of the others.


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that get a language: null texts, texts without a letter and texts of no known n-gram go."""
    return language.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages cut out; a document left without words goes."""
    return decontaminate.remove_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind."""
    return pii.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs' columns, n_tokens, ids (null text: none) and round_trip, whether the ids decode to the text.

    A column of docs with one of these names (in any case) is carried as docs_<name>.
    """
    made = ("n_tokens", "ids", "round_trip")
    held = aside(docs, ["text"])
    coded = bpe.encode_and_decode(held, RANKS)
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    own = [c.alias(f"docs_{name}") if name.lower() in made else c for name, c in zip(docs.columns, put_back(held, docs.columns, ["text"]))]
    return coded.select(*own, F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("tokens", tokens),
]

#: SimHash components and BPE ids can't be said in SQL; tests hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
