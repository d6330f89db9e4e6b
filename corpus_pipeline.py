"""The corpus pipeline: language ID, quality classifier, SimHash near-dedup, best-fit packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm import common, langid, packing, quality, queries, simhash

#: Documents whose language is known with less than this probability go.
LEAST_SURE = 0.5


def _kept(docs: DataFrame, predict, decision: str) -> DataFrame:
    """The rows whose prediction meets ``decision``, with the columns of ``docs`` as they were, even where a prediction's name clashes."""
    found = predict(common.numbered(docs), f"c{docs.columns.index('text')}_").filter(decision)
    return common.renamed(found, docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a language: rejects null texts, texts without letters, and unsure predictions; these only where a language is known."""
    common.ship(spark)
    model = langid.fit(docs.filter(common.crc_mod(F.col("doc_id"), 3) != 1))
    if not model.languages:
        return _kept(docs, langid.with_letters, "lettered")
    return _kept(docs, lambda rows, text: langid.predict(rows, model, text), f"lang_pred <> '{langid.UNKNOWN}' and score >= {LEAST_SURE}")


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the quality classifier predicts to be labelled 1."""
    labels = queries.table(spark, sf_dir, "labels")
    net = quality.fit(docs, labels.filter(common.crc_mod(F.col("doc_id"), 5) != 0))
    return _kept(docs, lambda rows, text: quality.predict(rows, net, text), "predicted = 1")


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each near-duplicate component, that with the smallest id; of equal ids or none, the first row."""
    return simhash.keep_one(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents that are left: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return packing.pack_documents(docs)


STAGES = [("language_id", language), ("quality", good), ("near_dedup", dedup), ("packing", packed)]

#: Trained models, near-duplicates and packing can't be said in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = common.new_path(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
