"""The training-data pipeline: toxicity, exact and near duplicates, source mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazegrid.llm.common import BROADCAST_ROWS, prepare, table, without
from hazegrid.llm.exact_dedup import distinct_documents
from hazegrid.llm.jaccard_join import ngram_jaccard
from hazegrid.llm.mixing import curriculum_mix
from hazegrid.llm.packing import best_fit_packing
from hazegrid.llm.toxicity import reject_toxic
from hazegrid.session import cut_lineage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, does not call toxic. Null and empty texts stay."""
    return reject_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group with equal normalised texts: the smallest id, repeated rows once. Null and empty texts are one group."""
    prepare(spark)
    return distinct_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the smallest id. Documents without words, or without an id, stay;
    an id that is dropped goes with all rows that carry it."""
    prepare(spark)
    found = ngram_jaccard(docs)
    dropped = found.where(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias("__dropped_id")).distinct()
    return without(docs, dropped, "doc_id", "__dropped_id")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, each as often as the mix takes it. Rows that share an id share the positions of one of them."""
    mix = curriculum_mix(docs).where(F.size("positions") > 0)
    places = cut_lineage(mix.groupBy(F.col("doc_id").alias("__placed_id")).agg(F.min(F.struct("size", "positions")).alias("p"))
                         .select("__placed_id", F.col("p.positions").alias("__positions")), "places")
    side = F.broadcast(places) if places.count() <= BROADCAST_ROWS else places
    placed = docs.join(side, F.col("doc_id").eqNullSafe(F.col("__placed_id")))
    return placed.withColumn("__position", F.explode("__positions")).orderBy("__position", "doc_id").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and offset."""
    prepare(spark)
    return best_fit_packing(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]

# The classifier, the shingle hashes of copies and the tokeniser cannot be said in SQL; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed corpus of `documents`. Each stage's result is written to the shared folder before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
