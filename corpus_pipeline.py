"""From raw documents to token ids: quality, exact copies, near copies, benchmark passages, encoding.

Each stage takes all that its predecessor kept. The first four return the columns of documents; the last one
returns doc_id, n_tokens, token_ids and whether decoding gave the text back.

Cases: each stage keeps what its operator's module says of nulls, empty texts, ties and repeated rows. Documents
without text are scored like any text; empty texts are copies of each other and have no shingles. Without labels
the first stage rejects nothing unless the smoothed share of good labels is below the threshold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandloom.llm import bpe, decontaminate, exact_dedup, ngram_join, quality
from strandloom.llm.common import staged, table


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on labels outside its held-out fold, does not reject."""
    labels = table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.where(~quality.held_out(labels["doc_id"], 5, 0)))
    return quality.keep_good(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is connected by shingle similarities of 0.8 and more."""
    return ngram_join.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark passage: of an affected document nothing is trained on."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), max_coverage=0.0)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, decoded again as a check."""
    return bpe.encode_checked(docs)


STAGES = [
    ("quality", drop_poor),
    ("exact_dedup", drop_copies),
    ("ngram_join", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("bpe", encode),
]

#: The classifier and the encoder have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
