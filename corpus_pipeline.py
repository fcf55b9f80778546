"""From documents to sampled token ids: identified, without near-duplicates, repeated passages and benchmark texts.

A stage takes (spark, docs, sf_dir), works on all rows of docs, and returns rows with the columns of documents (the last
one: doc_id, text, ids, n_ids). run() writes each stage's rows as Parquet into the shared folder and reads them back.

Rows without doc_id are kept by the second and third stage: they are in no group of duplicates, and lose no passage, as
nothing tells which of two comes first. Rows with one doc_id are versions of one document: near_duplicates keeps each
different text of a document that stays once, and no stage takes one version's text for another's. Null texts and texts
without a letter are rejected by the first stage. An empty table gives empty tables.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontaminate, langid, near_dedup, passage_dedup, pieces
from corpusloom.sources.shared import shared_folder, written

PIECES = "piece_bpe_32k.model"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that language identification rejects."""
    return langid.keep_identified(docs)


def whole(docs: DataFrame) -> DataFrame:
    """doc_id, and row: all columns in one, so no name of theirs clashes with another."""
    return docs.select("doc_id", F.struct(*docs.columns).alias("row"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: the one with the least doc_id. Of its rows, each different text once (the row that sorts first)."""
    classes = near_dedup.near_dedup(docs).where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.col("doc_id") != F.col("class_id")).alias("later"), F.count("*").alias("n")
    )
    odd = written(classes.where("later OR n > 1"))
    kept = whole(docs).join(odd, "doc_id", "left").where("later IS NULL OR NOT later")
    once = kept.where("n IS NULL OR n = 1").select("row.*")
    if odd.where("n > 1 AND NOT later").isEmpty():
        return once
    order = F.struct(*(F.col(f"row.{c}").cast("string") for c in docs.columns if c not in ("doc_id", "text")))
    several = kept.where("n > 1").groupBy("doc_id", "row.text").agg(F.min_by("row", order).alias("row"))
    # written by itself: in one plan with the others, all documents would be shuffled twice at a time
    return once.unionAll(written(several.select("row.*")))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that an earlier document has; n_chars follows the text."""
    cut = passage_dedup.passage_dedup(docs, keep_space=True).where("n_removed > 0 AND doc_id IS NOT NULL")
    cut = cut.select("doc_id", "text_sha256", F.col("kept").cast("string").alias("kept")).dropDuplicates(["doc_id", "text_sha256"])
    # the hash tells rows with one doc_id apart
    both = whole(docs).withColumn("text_sha256", F.sha2(F.col("row.text").cast("binary"), 256)).join(cut, ["doc_id", "text_sha256"], "left")
    new = {
        "text": F.coalesce("kept", "row.text"),
        "n_chars": F.when(F.col("kept").isNotNull(), F.length("kept").cast("long")).otherwise(F.col("row.n_chars"))
    }
    return both.select(*(new[c].alias(c) if c in new else F.col(f"row.{c}") for c in docs.columns))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a window of any benchmark item."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), min_items=1)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, text (decoded from the ids), ids, n_ids."""
    model = public_tokenizers.path(PIECES)
    return pieces.encode_pieces(docs, model, decoded=True).select("doc_id", "text", "ids", F.size("ids").alias("n_ids"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("without_benchmark", without_benchmark),
    ("token_ids", token_ids),
]

#: Language identification and sampled segmentations can't be put in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
