"""The corpus pipeline: five stages from raw documents to token ids.

Each stage works on what the one before kept, written as Parquet and read again. Documents without a
language go, then exact copies, then all but one document of each near-duplicate group; the rest is mixed
to the target weights and encoded. All stages but the last return the columns of documents.

Empty tables pass through as empty tables. What each stage makes of nulls, ties and repeated rows is told by
its operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumewatch.llm import bpe, exact, language, mixing, simhash
from plumewatch.llm.frames import documents
from plumewatch.session import scratch_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is null or has no letter go; `lang` takes what is predicted with certainty."""
    return language.known_language(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return exact.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that pairs with five-word similarity 0.8 or more connect the one with the smallest id stays."""
    return simhash.dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.mix(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with the hash of what they decode to."""
    import public_tokenizers

    out = bpe.encode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path(
        "byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decoded="decoded")
    return out.select(
        "doc_id", "lang", "source", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("simhash_dedup", drop_near_copies),
    ("mix", mix_sources),
    ("encode", encode_texts),
]

#: Learned languages, anchors and seeded samples have no SQL form; the tests replay the stages by hand.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
