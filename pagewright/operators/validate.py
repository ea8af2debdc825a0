"""Validation of snippets: duplicates, placeholders, context coverage, presence in the HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pagewright.functions.text import PLACEHOLDER_END, html_for_validation


def duplicates(records: DataFrame) -> DataFrame:
    """(snippet, n) of snippets that occur more than once."""
    return records.where("snippet IS NOT NULL").groupBy("snippet").agg(F.count("*").alias("n")).where("n > 1")


def summary(records: DataFrame) -> DataFrame:
    """One row: counts of snippets, distinct ones, placeholders and of context on both, one or neither side."""
    before, after = F.length(F.coalesce("context_before", F.lit(""))) > 0, F.length(F.coalesce("context_after", F.lit(""))) > 0
    # grouped by snippet first, so the distinct count needs no second pass over all rows
    by = records.groupBy("snippet").agg(F.count("*").alias("n"), F.count_if(before & after).alias("full"), F.count_if(before != after).alias("part"))
    return by.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_snippets"),
        F.count("snippet").alias("unique_snippets"),
        F.coalesce(F.sum(F.when(F.col("snippet") == PLACEHOLDER_END, F.col("n"))), F.lit(0)).alias("placeholder_count"),
        F.coalesce(F.sum("full"), F.lit(0)).alias("context_full"),
        F.coalesce(F.sum("part"), F.lit(0)).alias("context_partial"),
        F.coalesce(F.sum(F.col("n") - F.col("full") - F.col("part")), F.lit(0)).alias("context_none"),
    )


def checkable() -> Column:
    """Snippets that are looked for."""
    return (F.length("snippet") > 0) & (F.col("snippet") != PLACEHOLDER_END)


def missing(records: DataFrame, html: DataFrame) -> DataFrame:
    """Records (doc_id, ord, ...) whose snippet is not in the text of their document's html (doc_id, html)."""
    flat = html.select("doc_id", html_for_validation(F.col("html")).alias("_text"))
    joined = records.where(checkable()).join(flat, "doc_id", "left")
    return joined.where(~F.coalesce(F.contains("_text", F.col("snippet")), F.lit(False))).drop("_text")


def match_rate(records: DataFrame, html: DataFrame) -> DataFrame:
    """One row: missing_count and html_match_rate over all documents."""
    flat = html.select("doc_id", html_for_validation(F.col("html")).alias("_text"))
    joined = records.join(flat, "doc_id", "left")
    gone = F.count_if(F.coalesce(checkable(), F.lit(False)) & ~F.coalesce(F.contains("_text", F.col("snippet")), F.lit(False)))
    held = F.count_if(F.coalesce(F.col("snippet") == PLACEHOLDER_END, F.lit(False)))
    n = F.count("*")
    return joined.agg(gone.alias("missing_count"), ((n - gone - held).cast("double") / F.greatest(F.lit(1), n - held).cast("double")).alias("html_match_rate"))


def ready(summary_row: dict) -> bool:
    """No placeholder, no duplicate, and more than 95 of 100 found where HTML was given."""
    return not summary_row["placeholder_count"] and not summary_row.get("n_duplicates") and summary_row.get("html_match_rate", 1.0) > 0.95


def gate(records: DataFrame, html: DataFrame | None = None) -> DataFrame:
    """One row, ready: as ready() says it of all records at once."""
    one = summary(records).select("placeholder_count", (F.col("total_snippets") - F.col("unique_snippets")).alias("n_duplicates"))
    rate = match_rate(records, html).select("html_match_rate") if html is not None else records.agg(F.lit(1.0).alias("html_match_rate"))
    return one.join(rate, F.lit(True)).select(((F.col("placeholder_count") == 0) & (F.col("n_duplicates") == 0) & (F.col("html_match_rate") > 0.95)).alias("ready"))


def results(records: DataFrame, html: DataFrame | None = None) -> dict:
    """All results of one document as a dictionary, for reports. Lists are as long as the document's findings."""
    out = summary(records).first().asDict()
    out["duplicate_snippets"] = {r["snippet"]: r["n"] for r in duplicates(records).collect()}
    out["n_duplicates"] = len(out["duplicate_snippets"])
    if html is not None:
        out["missing_from_html"] = [r["page"] for r in missing(records, html).orderBy("ord").select("page").collect()]
        out["html_match_rate"] = match_rate(records, html).first()["html_match_rate"]
    return out
