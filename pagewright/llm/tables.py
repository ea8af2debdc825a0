"""What the operators share on the Spark side."""

from __future__ import annotations

import contextlib
import ctypes
import math
import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: Text of one task of the operators that deal rows out anew.
TASK_BYTES = 16 << 20
BATCH_ROWS = 500


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or for a local session one of its own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or _java_checkpoint_dir(spark)
    if at is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = f"/tmp/pagewright-{uuid.uuid4().hex}"
        spark.sparkContext.setCheckpointDir(at)
        at = _java_checkpoint_dir(spark)
    elif _java_checkpoint_dir(spark) is None:
        spark.sparkContext.setCheckpointDir(at)
    return at


def _java_checkpoint_dir(spark: SparkSession) -> str | None:
    at = spark.sparkContext._jsc.sc().getCheckpointDir()
    return at.get() if at.isDefined() else None


def checkpoint(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read from there: cuts the lineage and outlives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def mapped(df: DataFrame, run: Callable, schema: str | T.StructType) -> DataFrame:
    """df.mapInArrow() in batches of at most BATCH_ROWS rows, so a batch of long texts is small next to a worker's memory.

    The size is a setting of the session; a smaller one stays. Workers live on after a task, so each gives back at its
    end what it no longer uses.
    """
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)

    def tidy(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return df.mapInArrow(tidy, schema)


def sampled(df: DataFrame, run: Callable, schema: str | T.StructType, tasks: int) -> list:
    """At most ``tasks`` rows of mapped(df, run, schema), where run() reads a bounded head of its partition and gives one row.

    take() asks one partition, then a few more until it has enough, so the cost doesn't grow with the table.
    """
    return mapped(df, run, schema).take(tasks)


def give_back() -> None:
    """Returns free memory of this process to the system, where the C library can."""
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def fresh(name: str, taken: Iterable[str]) -> str:
    """The name, or one like it that no column has, in any case of letters."""
    taken = {t.lower() for t in taken}
    while name.lower() in taken or f"{name}_of".lower() in taken:
        name = f"{name}_"
    return name


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of all texts: one scan that adds up a number per task."""
    return docs.agg(F.sum(F.octet_length(column).cast("long")).alias("n")).first()["n"] or 0


def parts(n_bytes: int, task_bytes: int = TASK_BYTES) -> int:
    return max(1, math.ceil(n_bytes / task_bytes))


def size_in_words(text: Column | str = "text") -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, null: 0, without an array of them."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from: crc32 of the id as text leaves no rest by 5."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), 5) == 0, F.lit(False))


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file; it is installed on every machine and never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)
