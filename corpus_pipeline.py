"""Corpus pipeline over documents: each stage calls one operator, its result is written and read again as the next one's input.

Stages give rows back as they were, in all columns, whatever these are named; only text and n_chars change, in the stage that
cuts passages.  Rows with a null id are documents like others, and empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomseq.llm import bpe, decontam, quality, simhash, substring
from loomseq.llm.cluster import unused, written


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labels, doesn't reject.

    Null and empty texts score as one empty line, so all of them stay or all go; each of repeated rows is judged alike.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    score, predicted = unused(docs, "score"), unused(docs, "predicted")
    return quality.score(docs, quality.learn(docs, labels), out=(score, predicted)).where(F.col(predicted) == 1).drop(score, predicted)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: 5-word shingles, similarity 0.8, verified.

    The least id of a group stays, of rows that repeat it the one with the least text (see ``simhash.one_of_each``).  Texts
    without a word (null and empty ones too) are alike, so one of them stays; rows with a null id all stay.
    """
    return simhash.one_of_each(docs)


def distinct_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of 20-word windows that earlier documents have; those that lose all their words go.

    Texts that lose nothing stay as they are (null and empty ones too), of others the words that are left are joined by one space.
    Documents with a null id come after all others; rows that repeat an id are one document, so they keep each other's words.
    """
    names = docs.columns
    words, removed, kept = (unused(docs, c) for c in ("n_words", "n_removed", "kept"))
    found = substring.dedup(docs, window=20, out=(words, removed, kept))
    cut = F.col(removed) > 0
    made = {"text": F.when(cut, F.col(kept)).otherwise(F.col("text"))}
    if "n_chars" in names:
        made["n_chars"] = F.when(cut, F.length(kept).cast("long")).otherwise(F.col("n_chars"))
    return found.where(~cut | (F.col(removed) < F.col(words))).withColumns(made).select(*[F.col(f"`{c}`") for c in names])


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage that is within an edit distance of a fifth of a benchmark item's words from it.

    Null and empty texts, and null and empty items, match nothing; each of repeated rows is judged alike.
    """
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the token ids of their text, as ids, and their number, n_tokens; fails if ids don't decode to the text.

    Null and empty texts have no ids.  Where documents have columns of these names, the new ones get a ``_`` behind theirs.
    """
    copy, decoded, ids, n = (unused(docs, c) for c in ("copy", "decoded", "ids", "n_tokens"))
    both = bpe.round_trip(docs.withColumn(copy, F.col("text")), bpe.default_path(), copy, decoded, ids)
    same = F.col(decoded) == F.coalesce("text", F.lit(""))
    checked = F.when(same, F.col(ids)).otherwise(F.raise_error(F.lit("token ids don't decode to their text")))
    return both.withColumn(ids, checked).withColumn(n, F.size(ids)).drop(decoded)


STAGES = [
    ("quality classifier", good_documents),
    ("SimHash near-dedup", distinct_documents),
    ("substring dedup", distinct_passages),
    ("benchmark decontamination", clean_documents),
    ("BPE encoding and decoding", token_ids),
]

#: SQL can't express the learned and the near-duplicate stages: tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{i}")
    return docs
