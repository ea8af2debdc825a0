"""HTML files and word lists."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def read_html(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, file, html): one row a file, numbered by name. Only the names come together to be numbered."""
    rows = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("html"))
    return rows.join(numbered(rows.select("file")), "file").select("doc_id", "file", "html")


def numbered(files: DataFrame) -> DataFrame:
    """(file, doc_id): a number from 0 on for each name, in order."""
    return files.distinct().select("file", (F.row_number().over(Window.orderBy("file")) - 1).cast("long").alias("doc_id"))


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(word): one word a line, blank lines dropped, with the lower-case forms."""
    return expand(spark.read.text(path).select(F.trim("value").alias("word")).where("word <> ''"))


def expand(words: DataFrame) -> DataFrame:
    return words.unionByName(words.select(F.lower("word").alias("word"))).distinct()


def dictionary_table(spark: SparkSession, words: Iterable[str]) -> DataFrame:
    return expand(spark.createDataFrame([(w,) for w in words], "word string"))


def known_words(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Rows (word, ...) whose lower-case word is in the dictionary."""
    d = dictionary.select(F.col("word").alias("_w"))
    return rows.join(d, F.lower("word") == F.col("_w"), "left_semi")


def longest(dictionary: DataFrame) -> DataFrame:
    return dictionary.agg(F.coalesce(F.max(F.length("word")), F.lit(0)).cast("long").alias("max_word_length"))
