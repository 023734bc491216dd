"""From raw documents to packed sequences: classify, deduplicate, decontaminate, pack.

Each stage keeps whole rows with the columns of documents, extra ones too, and the last one
gives pieces. A null text is empty: it has the classifier's bias as its score, equals other
empty texts, links with nothing, is never contaminated and packs as its end token. Rows that
agree in text and id stay or go together; of equal texts the largest id stays, of near copies
the least. A null id sorts below all others and is carried along. Empty tables give no rows;
without labels every document is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphstream.llm import decontamination, exact_dedup, jaccard_join, packing, quality
from glyphstream.llm._scratch import input_bytes, materialise, table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal documents the one with the largest doc_id stays."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links join, the one with the least doc_id stays: five words, similarity 0.8 or more."""
    return jaccard_join.keep_one(docs, shingle=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of at most 4096 tokens."""
    packed = packing.pack(docs, packing.tokenizer_file())
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality", classify),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", decontaminate),
    ("packing", pack),
]

# A trained classifier and a tokenizer are beyond SQL; a test holds run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each over what the one before has written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}", input_bytes(docs))
    return STAGES[-1][1](spark, docs, sf_dir)
