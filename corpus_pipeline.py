"""The corpus pipeline: quality classifier, exact dedup, n-gram Jaccard join, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read as the next one's docs.
All but the last return the columns of docs. Ids are integers and unique in the first input; empty tables pass through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluentlake.llm import byte_bpe, exact_dedup, jaccard_join, quality_classifier, source_mixing
from fluentlake.llm.shared import delete_since, documents, made, scratch, stored

#: SQL can't express the classifier and what follows it; the stages of dedup, near copies and mixing are tested against brute-force
#: versions or SQL, the classifier's against its operator's scores, the last against the chain of stages.
ORACLE_SQL = None

#: Rows with whole texts that a Python worker gets at once for encoding: its memory, and the JVM's, grow with them.
ROWS = 1000


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the weak-label classifier rejects."""
    return quality_classifier.accepted(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents whose sets of five-word shingles are similar by 0.8 or more, the smallest id stays."""
    found = jaccard_join.near_duplicates(docs, n=5, percent=80)
    dropped = found.where("component_id != doc_id").select(F.col("doc_id").alias("_dropped"))
    return docs.join(dropped, docs["doc_id"] == dropped["_dropped"], "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: once for half of its words or more, twice for one and a half of them.
    A document without words is kept once, as it takes nothing from any share."""
    return source_mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document, and digests of ids and decoded bytes."""
    digests = byte_bpe.round_trip_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return stored(digests, "encoded", batch=ROWS)


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix),
    ("byte-level BPE", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, writing each one's rows to the shared folder before the next. Once they are written,
    the tables that the stage made and the rows of the stage before are deleted."""
    docs, mark = documents(spark, sf_dir), made()
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := scratch(spark, f"stage-{k}"))
        delete_since(spark, mark, keep=(path,))
        docs = spark.read.parquet(path)
    return docs
