"""A corpus pipeline: quality, exact copies, near copies, mixing, tokens."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundphrase.llm import bpe, exact_dedup, minhash, mixing, quality
from groundphrase.operators.lineage import ensure_checkpoint_dir
from groundphrase.sources import table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on these documents' labels, scores 0.7 or more."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, that of the smallest doc_id."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, similarity 0.8 or more."""
    return minhash.drop_near_copies(docs, words=5, threshold=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture: sources by the square root of their counts, blocks of 64."""
    return mixing.mixed(docs)


def placed(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, text and place: the order of the rows in a written table.

    Readers pack files by size, so it is recovered from the number in a file's name and the row's index in the file;
    both have room in a bigint. A name without a number gives null. Of a table that was not written, it is the order
    of the partitions.
    """
    number = lambda pattern: F.regexp_extract("_metadata.file_name", pattern, 1).try_cast("long")
    row = number(r"^part-(\d+)") * 2**40 + number(r"-c(\d+)\.") * 2**30 + F.col("_metadata.row_index")
    columns = ["doc_id", "lang", "source", "text"]
    try:
        return docs.select(*columns, row.alias("place"))
    except AnalysisException:  # no files, or files of a kind without row indices
        return docs.select(*columns, F.monotonically_increasing_id().alias("place"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, place, ids (tokens of the whole text) and decoded (the text that the ids give back).

    Sorted by place, rows are in the order in which docs was written, which is that of the mixture.
    """
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    # workers that other stages have used keep less here: about 100 MB each, for more time
    ids = bpe.encode(placed(docs), ranks, public_tokenizers.PATTERN, decoded_col="decoded", max_states=40_000, max_pieces=60_000)
    return ids.select("doc_id", "lang", "source", "place", "ids", "decoded")


STAGES = [
    ("quality", keep_good),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", tokenise),
]
#: The classifier and the schedule are not SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents; each stage's rows are written to the shared folder and read again by the next.

    The order of the mixture is that of the result's column place.
    """
    ensure_checkpoint_dir(spark)
    root = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
