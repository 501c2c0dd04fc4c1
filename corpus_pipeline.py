"""From raw documents to token ids: classify, dedup, near-dedup, mix, encode.

STAGES lists (name, function). A function takes (spark, docs, sf_dir) and returns
a DataFrame; run() writes each result as Parquet in the shared folder and reads it
again as the next one's docs. All but the last return the columns of documents.

In every stage null text counts as empty, and columns other than doc_id, text and source pass
unread, whatever their names. The classifier scores empty texts as all others. Exact dedup
leaves one row of all that are equal, so one of rows that repeat as a whole and one of all
empty texts; near-dedup one of each group of linked texts. Of rows with one id and
different texts each is a document of its own, with a null id too. Mixing gives a row as often as its
source's weight asks for, so that ids may repeat from there on. Ties are broken by the
smallest doc_id, nulls last. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from songframe.llm import bpe, exact_dedup, mixing, quality, simhash
from songframe.llm.common import staged, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a classifier trained on labels accepts."""
    return quality.good_documents(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is equal without white space."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more: the cosine of
    their sets of five-word shingles, which is what SimHash estimates."""
    return simhash.drop_near_duplicates(docs, measure="cosine")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's weight asks for."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and their round trip."""
    return bpe.round_trip(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: The classifier and near-dedup are not SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
