"""A training corpus from documents, in five stages; each works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framelore.llm import decontam, packing, quality, secrets, simhash
from framelore.llm._store import discard, stored
from framelore.llm.queries import tokenizer


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (junk, toxic, without a word, so null and empty texts too) go.

    Repeated rows are judged one by one, very long texts as a whole; a null id is no matter; an empty table gives none; columns may have any names.
    """
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays, of repeated rows one.

    Rows with one id and texts that are no near duplicates all stay, as do rows with a null id. Null and empty texts are duplicates of each other; very long
    texts are hashed whole; an empty table gives none; columns may have any names.
    """
    return simhash.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    Null and empty texts hold none; repeated rows are judged one by one, very long texts as a whole; a null id is no matter; an empty table gives none, an
    empty benchmark takes none; columns may have any names.
    """
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets, also those inside encodings, are replaced by [SECRET], and n_chars follows; every document stays.

    Null and empty texts and all other columns, whatever their names, are as before; repeated rows each get the same; an empty table gives none.
    """
    return secrets.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences, see packing.pack().

    Null and empty texts are the end sign only; each repeated row is packed; a null id is carried; an empty table gives none; other columns are dropped.
    """
    return packing.pack(docs, tokenizer())


STAGES = [("quality classifier", quality_classifier), ("simhash near-dedup", simhash_dedup), ("benchmark decontamination", decontamination), ("secret scans", secret_scan), ("packing", pack)]

#: SQL cannot express the fitted classifier or the tokenizer; tests/llm holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
