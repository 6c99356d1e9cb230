"""From raw documents to packed training batches, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame. It works on
all that its predecessor kept, and its decisions take effect: language ID drops
texts of no known language, near-dedup keeps one document of each group,
suffix-array dedup cuts repeated passages (all but their first occurrence),
decontamination drops documents with passages of the benchmark, and packing
assigns the rest to batches. All stages but the last return the columns of
``documents``; ``n_chars`` follows the text where that is cut. Nulls, ties,
repeated rows and empty tables are treated as each operator says.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import decontamination, langid, packing, simhash, suffixes
from lexiloom.llm._text import drop, read, shared_folder

#: SQL can't express the stages' models and hashes; they are tested by brute force.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that language ID rejects. Trained on the documents of ``sf_dir``."""
    return langid.keep_known(docs, langid.train(read(spark, sf_dir, "documents")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the least doc_id, of each group of near-duplicates, and one row of it."""
    return simhash.deduplicate(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts copies of passages out of the texts."""
    return suffixes.deduplicate(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows whose text holds a passage of the benchmark."""
    return decontamination.remove(docs, read(spark, sf_dir, "benchmark"))


def batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into token-budget batches of like lengths."""
    return packing.pack(docs)


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", contamination),
    ("packing", batches),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; what each returns is written as Parquet in the cluster's shared folder and read again.

    What a stage wrote is deleted when the next one has been written; the last is what is returned.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            drop(spark, f"{folder}/{k - 1}")
    return docs
