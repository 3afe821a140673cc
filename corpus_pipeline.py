"""From raw documents to encoded training data: five stages, each written as Parquet and read again by the next one.

Defined results are those of the operators: rows with null or empty texts are
rejected by the language stage, every stage works on all that is left, and
columns of documents are passed on as they are, but for text and n_chars,
which the suffix-array stage changes. The n-gram stage leaves one row of each
component of near copies, also where rows repeat an id or have none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import bpe, language, mixing, ngram_join, suffix_dedup
from docloom.llm.common import crc_mod, materialize, read


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language compression can tell."""
    content = language.dictionaries(docs, lambda doc_id: crc_mod(doc_id, 4) != 2)
    return language.keep_identified(docs, content)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return ngram_join.keep_one(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of over 50 words that stand in another document."""
    return suffix_dedup.strip(docs, min_bytes=None, min_words=suffix_dedup.MIN_WORDS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for."""
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, with digests of the ids and of what they decode to."""
    return bpe.encode(docs)


STAGES = [("language ID", by_language), ("n-gram Jaccard join", without_near_copies), ("suffix-array dedup", without_repeats), ("mixing", mixed), ("BPE", encoded)]

#: SQL can express neither the compression classifier nor the suffix and BPE stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"stage{i + 1}")
    return docs
