"""From raw documents to encoded training documents, in stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's ``docs``. All but the last keep the columns of
documents. Null, empty and letterless texts have no language and go in the first stage.
Repeated rows are one document to the second stage, which keeps or drops all rows of an id;
of groups of near copies the smallest id stays, whatever ties there are. Very long texts go
through whole. An empty table gives an empty result of the same columns, and columns beyond
those of documents, whatever their names, are carried along to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from concord.llm import bpe, decontam, jaccard, langid
from concord.llm.queries import tokenizer
from concord.sources.paths import discard, materialize

#: A document stays if at least this share of its letters is in identified languages.
LEAST_LANGUAGE_SCORE = 0.5
#: Near duplicates: word 5-grams, Jaccard similarity of 0.8 or more.
NEAR = jaccard.Join(words=5, least=80, per=100)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, learnt from their own labels."""
    return langid.keep_identified(docs, langid.train(docs), least_score=LEAST_LANGUAGE_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard.representatives(docs, NEAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item of ``benchmark``."""
    return decontam.clean(docs, decontam.build(spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, and the text they decode to."""
    return bpe.encode_documents(docs, tokenizer("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", encoding),
]

#: Learning, joining by similarity and BPE are not SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: (doc_id, ids, decoded)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name.replace(' ', '-')}")
            discard(before)
    return docs
