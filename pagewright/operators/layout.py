"""Page text from positioned spans or words: filters, reading order, joining. One aggregation for each page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pagewright.functions.text import tighten_punctuation

PAGE = ("doc_id", "page")


def joined(rows: DataFrame, *order: Column) -> DataFrame:
    """(doc_id, page, text): the texts of each page in order, joined by a space."""
    keys = [k.alias(f"k{i}") for i, k in enumerate(order)]
    return rows.groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*keys, F.col("ord").alias("o"), F.col("text").alias("t")))), lambda x: x["t"]), " ").alias("text"))


def body_by_font(spans: DataFrame, min_size: float = 8.5) -> DataFrame:
    """Spans of at least that font size from top to bottom. spans: (doc_id, page, ord, y1, size, text)."""
    return joined(spans.where(F.col("size") >= min_size), F.col("y1")).withColumn("text", tighten_punctuation(F.col("text")))


def in_body(rows: DataFrame, bottom: str = "y1", footnote_zone: float = 0.25) -> DataFrame:
    """Without what ends below the footnote line."""
    return rows.where(F.col(bottom) <= F.col("page_height") * (1 - footnote_zone))


def column_of() -> Column:
    """0 for the left column of a page, 1 for the right."""
    return F.when((F.col("x0") + F.col("x1")) / 2 < F.col("page_width") / 2, 0).otherwise(1)


def two_column_body(rows: DataFrame, bottom: str = "y1", footnote_zone: float = 0.25, min_size: float | None = None) -> DataFrame:
    """The left column from top to bottom, then the right one, above the footnotes. bottom: y1 of spans, bottom of words."""
    body = in_body(rows, bottom, footnote_zone)
    body = body if min_size is None else body.where(F.col("size") >= min_size)
    return joined(body, column_of(), F.col(bottom), F.col("x0")).withColumn("text", tighten_punctuation(F.col("text")))


def bottom_words(words: DataFrame, n: int = 10) -> DataFrame:
    """The n lowest words of each page in reading order. words: (doc_id, page, ord, x0, top, text); ord of any type that sorts."""
    low = words.withColumn("_k", F.row_number().over(Window.partitionBy(*PAGE).orderBy(F.col("top").desc(), "ord", "x0", "text"))).where(F.col("_k") <= n)
    return joined(low, F.col("top"), F.col("x0"), F.col("_k"))


def bottom_block(blocks: DataFrame) -> DataFrame:
    """The text of the block of each page that starts lowest; of several the first."""
    return blocks.groupBy(*PAGE).agg(F.max_by("text", F.struct("y0", -F.col("ord"), "text")).alias("text"))
