"""A corpus pipeline of five stages. Each is written as Parquet and read again before the next one.

A stage takes all that the one before it kept. The first four return the columns of documents, and whatever further columns
came with them; the last returns the tokens. Rows without a doc_id have no label and no near-duplicate class and pass those
stages by their text alone. Rows that share a doc_id are one document for its class; of those with one text a single row
stays, those with different texts all do. Null and empty texts pass as they are where a stage keeps them; an empty table
gives empty stages.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagewright.llm import mixing, quality_crf
from pagewright.llm.byte_bpe import bpe_encode
from pagewright.llm.near_dedup import near_dedup
from pagewright.llm.substring_dedup import substring_dedup
from pagewright.llm.tables import fresh, held_out, shared_folder, table, vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    model = quality_crf.learn(docs, table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))))
    score, predicted = (fresh(n, docs.columns) for n in ("score", "predicted"))
    return quality_crf.classify(docs, model, names=(score, predicted)).where(F.col(predicted) == 1).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each class; of several rows of that id one for each text."""
    stay = near_dedup(docs).where("doc_id = class_id").select("doc_id").distinct()
    known = docs.join(stay, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return known.unionByName(docs.where("doc_id IS NULL"))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that an earlier one has; n_chars follows."""
    cut = substring_dedup(docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))).select("row", "text")
    value = lambda c: F.col("text") if c == "text" else F.length("text").cast("long") if c == "n_chars" else F.col("row").getField(c)
    return cut.select(*(value(c).alias(c) for c in docs.columns))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, and whether they decode to it."""
    path = vocabulary("byte_bpe_50k.tiktoken")
    coded = bpe_encode(docs.select("doc_id", "lang", "source", "text"), path, decoded=True)
    same = F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("substrings", substrings), ("mixture", mixture), ("tokens", tokens)]

#: A trained classifier and hashed signatures have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage has written goes when the next one is written; the last one stays for the reader."""
    at = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        if before:
            path = spark._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        before = f"{at}/{name}"
    return docs
