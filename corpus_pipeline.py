"""A corpus pipeline of five stages; each reads what its predecessor kept, as Parquet.

A stage takes (spark, docs, sf_dir) and returns the documents that stay, with the columns of
``documents``; the last returns token ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumatrace.llm import bpe, decontaminate, language, simhash, substrings
from lumatrace.llm.common import WRITTEN, discard, materialize, read

#: Bytes from which a repeated string is cut: a passage of over 50 words has as many in nearly all languages
#: written with spaces (51 words of the given tables: 1 in 100 has fewer than 244). ``op4`` has its own 400.
PASSAGE_BYTES = 240
#: The near copies' rule: proposals up to 16 bits apart in five words, links from similarity 0.8.
NEAR = simhash.Similar(most=16, share=0.8)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows; those without any letter go.

    If no row has a label there is nothing to learn from, and every document with a letter stays.
    """
    model = language.model_of(docs)
    if not model.labels:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    return language.identify(docs, model).filter(F.col("lang_pred") != language.UNKNOWN).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of least doc_id, of each group that links of five-word similarity 0.8 or more hold together.

    Two fingerprints propose groups (``simhash.Similar``), their shingles are counted (``simhash.verified``).
    """
    return simhash.one_of_each(docs, rule=NEAR).select(docs.columns)


def tidy(cut: DataFrame, columns: list[str]) -> DataFrame:
    return cut.filter(~F.col("emptied")).withColumn("n_chars", F.length("text").cast("long")).select(columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that ``PASSAGE_BYTES``-byte repeats cover; texts of which nothing is left go."""
    return tidy(substrings.cut(substrings.with_repeats(docs, min_len=PASSAGE_BYTES)), docs.columns)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without what they share with benchmark items; texts of which nothing is left go."""
    found = decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))
    at = F.sequence(F.lit(1), F.size("removal_spans") - 1, F.lit(2))
    pairs = F.when(F.size("removal_spans") > 0, F.transform(at, lambda i: F.struct(F.get("removal_spans", i - 1).alias("begin"), F.get("removal_spans", i).alias("end"))))
    return tidy(substrings.cut(found.withColumn("cuts", pairs), spans="cuts"), docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with digests of the ids and of what they decode to."""
    return bpe.tokenize(docs).select("doc_id", "lang", "source", "n_tokens", "token_ids", "ids_sha256", "decoded_sha256")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("repeats", cut_repeats),
    ("benchmark", cut_benchmark),
    ("encode", encode),
]

#: SQL expresses neither the language model nor the byte-level stages; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    first = len(WRITTEN)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs)
            discard(spark, WRITTEN[first:-1])
    return docs
