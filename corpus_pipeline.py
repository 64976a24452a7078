"""The corpus pipeline: documents in, packed training sequences out, in five stages of the subpackage gneiss.llm.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept, which was written as Parquet and read again. All
but the last return the columns of documents.

All stages take any table with doc_id and text and pass its other columns on, whatever their names. Null and empty texts are texts
without words: the classifier scores them, near-dedup keeps one of them all, and the others leave them as they are. Rows that are alike
in doc_id and text are one after near-dedup. Very long texts are worked on whole. A null doc_id stays one until near-dedup prefers a
row with an id. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm import decontaminate, packing, quality, simhash, similar, substring_dedup
from gneiss.llm.common import fresh, shared_dir, small_batches, table, without


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; null and empty texts are judged like others."""
    small_batches(spark)
    name = fresh(docs, "quality score")
    rated = quality.with_score(docs, table(spark, sf_dir, "labels"), name=name)
    return rated.where(F.col(f"`{name}`") >= quality.ACCEPT).drop(name)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest doc_id: first of fingerprints within three bits, then of
    texts that share four fifths of their runs of five words."""
    small_batches(spark)
    return similar.keep_unlike(simhash.keep_one(docs))


def substring_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the word runs that an earlier one has; n_chars follows the text."""
    small_batches(spark)
    kept = substring_dedup.remove_repeats(docs).select(*docs.columns)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of any benchmark item: one item's passage is a leak already."""
    small_batches(spark)
    judged = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), least_items=1)
    return without(docs, judged.where("contaminated").select("doc_id").distinct())


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    small_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_filter),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substring_removal),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", pack),
]

#: Fingerprints, a trained network and BPE ids aren't SQL's.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; between them Parquet in the shared folder."""
    docs, folder = table(spark, sf_dir, "documents"), shared_dir(spark)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/stage-{i}")
            docs = spark.read.parquet(f"{folder}/stage-{i}")
    return docs
