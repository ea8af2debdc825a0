"""Page references as JSON files: one array of records a file, UTF-8, absent fields left out."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagewright.errors import PageError, SourceNotFoundError
from pagewright.sources.texts import numbered

DDL = "page STRING, snippet STRING, context_before STRING, context_after STRING, note STRING, confidence DOUBLE, method STRING"
FIELDS = [x.split()[0] for x in DDL.split(", ")]


def read_references(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, ord, page, ...): doc_id is a number for each file by name, ord the place in its array."""
    rows = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.from_json("value", f"ARRAY<STRUCT<{DDL}>>", {"mode": "FAILFAST"})).alias("ord", "r"))
    return rows.join(numbered(rows.select("file")), "file").select("doc_id", "ord", *(F.col(f"r.{f}").alias(f) for f in FIELDS))


def record(row: dict) -> dict:
    """A row as JSON has it: pages that are numbers stay numbers, absent fields go."""
    return {k: row[k] for k in FIELDS if row.get(k) is not None}


def write_references(records: DataFrame, path: str, numbers: bool = True) -> int:
    """One document's records, in order, as an indented JSON array. Returns how many. For many documents use write_corpus()."""
    rows = [record(r.asDict()) for r in records.orderBy(*(c for c in ("doc_id", "ord", "page") if c in records.columns)).collect()]
    for r in rows:
        if numbers and str(r.get("page", "")).isdigit():
            r["page"] = int(r["page"])
    try:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(rows, f, indent=2, ensure_ascii=False)
    except OSError as e:
        raise PageError(f"Error saving JSON: {e}") from e
    return len(rows)


def write_corpus(records: DataFrame, path: str) -> None:
    """Records of many documents as JSON lines, null fields left out."""
    records.write.json(path)


def load_local(spark: SparkSession, path: str) -> DataFrame:
    """One local file."""
    if not os.path.exists(path):
        raise SourceNotFoundError(f"File not found: {path}")
    try:
        with open(path, encoding="utf-8") as f:
            rows = json.load(f)
    except ValueError as e:
        raise PageError(f"Error loading JSON: {e}") from e
    cell = lambda r, k: None if r.get(k) is None else float(r[k]) if k == "confidence" else str(r[k])
    return spark.createDataFrame([(0, i, *(cell(r, k) for k in FIELDS)) for i, r in enumerate(rows)], f"doc_id LONG, ord INT, {DDL}")
