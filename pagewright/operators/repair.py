"""Repair of snippets against the HTML text of their document, and segmentation without one.

Snippets and texts meet by document: the text comes to Python once for each document, not once for each snippet.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from pagewright.functions import repair


def by_document(snippets: DataFrame, texts: DataFrame, column: str, kind: str, make: Callable[[str], Callable]) -> DataFrame:
    """snippets (doc_id, snippet, ...) with ``column`` of type ``kind``: make(text) gives the function for the snippets of a document.

    texts: (doc_id, text), one row a document. Snippets of documents without a text get null.
    """
    schema = T.StructType([*(f for f in snippets.schema.fields if f.name != column), T.StructField(column, T._parse_datatype_string(kind))])
    names = [f.name for f in schema.fields]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        text = right["text"].iloc[0] if len(right) and right["text"].iloc[0] is not None else None
        f = make(text) if text is not None else None
        left[column] = pd.Series([f(s) if f is not None and isinstance(s, str) else None for s in left["snippet"]], index=left.index, dtype=object)
        return left[names]

    keep = snippets.drop(column)
    return keep.groupBy("doc_id").cogroup(texts.select("doc_id", "text").groupBy("doc_id")).applyInPandas(run, schema)


def complete_last_words(snippets: DataFrame, texts: DataFrame) -> DataFrame:
    return by_document(snippets, texts, "completed", "string", lambda t: lambda s: repair.complete_last_word(s, t))


def complete_first_words(snippets: DataFrame, texts: DataFrame) -> DataFrame:
    return by_document(snippets, texts, "completed", "string", lambda t: lambda s: repair.complete_first_word(s, t))


def correct_from_anchors(snippets: DataFrame, texts: DataFrame, target: int = 10) -> DataFrame:
    return by_document(snippets, texts, "corrected", "struct<text:string,was_corrected:boolean>", lambda t: lambda s: dict(zip(("text", "was_corrected"), repair.correct_from_anchor(s, t, target), strict=True)))


def clean_snippets(snippets: DataFrame, texts: DataFrame, begin: bool = False, target: int = 10) -> DataFrame:
    return by_document(snippets, texts, "cleaned", "string", (lambda t: lambda s: repair.clean_begin(s, t)) if begin else (lambda t: lambda s: repair.clean_end(s, t, target)))


def fuzzy_match(snippets: DataFrame, texts: DataFrame, least: float = 0.6) -> DataFrame:
    """With match: (text, confidence, cleaned, rounded) of the best window of words; rounded: the confidence to two places, as Python rounds it."""

    def make(text: str):
        m = repair.Matcher(text)

        def match(s: str) -> dict:
            text, confidence, cleaned = m.match(s, least)
            return {"text": text, "confidence": confidence, "cleaned": cleaned, "rounded": round(confidence, 2)}

        return match

    return by_document(snippets, texts, "match", "struct<text:string,confidence:double,cleaned:string,rounded:double>", make)


def indel_ratio(a: Column, b: Column) -> Column:
    """Normalized indel similarity, 0 to 100."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else repair.Query(p).ratio(q) for p, q in zip(x, y, strict=True)], dtype="float64")

    return ratio(a, b)


def segment_words(text: Column, words: Iterable[str] | None = None, most: int = 15) -> Column:
    """Struct (text, confidence, rounded). words: the dictionary, sent to each task; by default, with a warning, a few common Greek words."""
    if words is None:
        warnings.warn("No dictionary is given; a few common Greek words serve instead", UserWarning, stacklevel=2)
    known = repair.dictionary(repair.COMMON_WORDS if words is None else list(words))
    longest = max((len(w) for w in known), default=0)

    @F.pandas_udf("text string, confidence double, rounded double")
    def run(x: pd.Series) -> pd.DataFrame:
        rows = [repair.segment(s, known, longest, most) if s is not None else (None, None) for s in x]
        return pd.DataFrame({"text": [r[0] for r in rows], "confidence": pd.Series([r[1] for r in rows], dtype="float64"), "rounded": pd.Series([None if r[1] is None else round(r[1], 2) for r in rows], dtype="float64")})

    return run(text)
