"""Template rows: page labels, each with a placeholder to fill in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagewright.errors import InvalidParameterError
from pagewright.functions.text import PLACEHOLDER_END, roman


def template(spark: SparkSession, n: int, start: int = 1, use_roman: bool = False) -> DataFrame:
    """(ord, page, snippet) for n pages from ``start`` on."""
    if n < 1:
        raise InvalidParameterError("the number of pages must be at least 1")
    page = roman(F.col("id")) if use_roman else F.col("id").cast("string")
    return spark.range(start, start + n).select((F.col("id") - start).cast("int").alias("ord"), page.alias("page"), F.lit(PLACEHOLDER_END).alias("snippet"))
