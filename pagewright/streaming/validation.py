"""Validation counts over references that keep arriving, with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pagewright.functions.text import PLACEHOLDER_END


def running_counts(records: DataFrame, time: str = "arrived", window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Counts of records (snippet, context_before, context_after, arrived) by window; rows later than ``late`` are left out."""
    before, after = F.length(F.coalesce("context_before", F.lit(""))) > 0, F.length(F.coalesce("context_after", F.lit(""))) > 0
    return records.withWatermark(time, late).groupBy(F.window(time, window).alias("window")).agg(
        F.count("*").alias("total_snippets"),
        F.count_if(F.coalesce(F.col("snippet") == PLACEHOLDER_END, F.lit(False))).alias("placeholder_count"),
        F.count_if(before & after).alias("context_full"),
        F.count_if(before != after).alias("context_partial"),
        F.count_if(~before & ~after).alias("context_none"),
    )
