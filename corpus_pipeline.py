"""A corpus pipeline of four stages over ``documents``: quality, near-duplicates, mixing, segmentation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyport.llm import mixing, neardup, quality, sampling
from tallyport.llm.common import store
from tallyport.llm.queries import tokenizer_path

#: SQL has no trained classifier and no sampled segmentations.
ORACLE_SQL = None


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts as good, with all their columns.

    Null and empty texts score by the model's bias alone; repeated rows score alike; columns named as the scores are
    kept as they were; an empty table stays empty.
    """
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.score_documents(docs.select(F.struct(*docs.columns).alias("_doc"), "text"), model)
    return scored.where("predicted = 1").select("_doc.*")


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8): the least doc_id.

    A repeated doc_id stays once: the row whose text has the least hash, ties by the text and by the other columns as
    text, so reruns agree. Documents without words have no duplicates and stay; rows without a doc_id can't be told
    apart and all stay. An empty table stays empty.
    """
    kept = neardup.near_duplicates(docs).where("kept").select(F.col("doc_id").alias("_id")).distinct()
    named = docs.where("doc_id is not null").join(kept, F.col("doc_id") == F.col("_id"), "left_semi")
    rest = [F.col(c).cast("string") for c in docs.columns if c not in ("doc_id", "text")]
    one = named.groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.struct(F.xxhash64("text"), "text", *rest)).alias("_doc"))
    return one.select("_doc.*").unionByName(docs.where("doc_id is null"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document once for each time that the schedule starts it (0 to 3 times), in the schedule's order.

    Rows are dealt by ranges of their slot and sorted in them, so the files in their order hold the sources in step
    with their targets. Documents without words are in no block and go. Rows of a null id, and of an equal id, which the
    stage before leaves out, share the slots of the one among them that starts most often. An empty table stays empty.
    """
    started = mixing.mix_sources(docs).groupBy(F.col("doc_id").alias("_id")).agg(F.max_by("slots", F.struct(F.size("slots"), "slots")).alias("_slots"))
    picked = docs.join(started.where(F.size("_slots") > 0), F.col("doc_id").eqNullSafe(F.col("_id")))
    rows = picked.withColumn("_slot", F.explode("_slots")).repartitionByRange("_slot", "doc_id").sortWithinPartitions("_slot", "doc_id")
    return rows.select(*docs.columns)


def segment(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of every document, as piece ids with their scores.

    Null and empty texts have one segmentation, without ids; copies of a document get equal samples; an empty table
    stays empty.
    """
    return sampling.sample_segmentations(docs, tokenizer_path("piece_bpe_32k.model"), k=2)


STAGES = [
    ("quality classifier", classify),
    ("MinHash near-dedup", dedup),
    ("mixing sources to target weights", mix),
    ("SentencePiece encoding and decoding", segment),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each one's rows are written as Parquet and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
