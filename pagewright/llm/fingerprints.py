"""Document fingerprints: one-permutation MinHash with optimal densification, packed to low-order bits.

Each 5-word shingle is hashed once; the high bits choose a bin and the bin keeps the least value. An empty bin copies a
bin that has a value: it tries bins in a random order of its own, the same for all documents, so two documents that
agree tend to copy alike. Of each bin BITS low-order bits are kept. Two values that differ share them with probability
2**-BITS, which the likeness takes out again: (share - 2**-BITS) / (1 - 2**-BITS).

A text of one to four words has one shingle. Null and empty texts have no shingle and the fingerprint '': two of them
have likeness 1, one and any other text 0. Equal texts have equal fingerprints; repeated rows and rows of equal or null id
each have a result; a very long text is a step of its own; an empty table gives an empty result.
"""

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from pagewright.llm.arrays import Texts, mix, shingles, steps
from pagewright.llm.tables import mapped, parts, text_bytes

BINS, BITS, SHINGLE, TRIES = 256, 8, 5, 4096
MOST_BUCKETS = 100_000
EMPTY = np.uint64(2**64 - 1)


@functools.cache
def tries() -> np.ndarray:
    """Bin that each empty bin asks in each try."""
    i, j = np.meshgrid(np.arange(BINS, dtype=np.uint64), np.arange(TRIES, dtype=np.uint64))
    return (mix(i * np.uint64(0x9E3779B97F4A7C15) + j + np.uint64(1)) % np.uint64(BINS)).astype(np.int64)


def fingerprints(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(texts, BINS) array of BITS-bit numbers, and whether each text has a shingle."""
    h, doc = shingles(t, SHINGLE)
    least = np.full(t.count * BINS, EMPTY)
    np.minimum.at(least, doc * BINS + (h >> np.uint64(64 - 8)).astype(np.int64), h)
    least = least.reshape(t.count, BINS)
    some = np.bincount(doc, minlength=t.count) > 0
    full = least != EMPTY
    row, bin_ = np.nonzero(~full & some[:, None])
    for asked in tries():
        if not len(row):
            break
        there = asked[bin_]
        ok = full[row, there]
        least[row[ok], bin_[ok]] = least[row[ok], there[ok]]
        row, bin_ = row[~ok], bin_[~ok]
    for r, b in zip(row, bin_, strict=True):  # as good as never: then the next bin with a value
        least[r, b] = least[r, (b + 1 + np.argmax(np.roll(full[r], -b - 1))) % BINS]
    # the bits that chose the bin and the least value are the high ones, so the low ones are even
    return (mix(least) & np.uint64(2**BITS - 1)).astype(np.uint8), some


def likeness(a: np.ndarray, some_a: np.ndarray, b: np.ndarray, some_b: np.ndarray) -> np.ndarray:
    share = (a == b).mean(1)
    chance = 2.0**-BITS
    return np.where(some_a & some_b, np.clip((share - chance) / (1 - chance), 0, 1), (some_a == some_b).astype(float))


def packed(f: np.ndarray, some: np.ndarray) -> list[str]:
    return [x.tobytes().hex() if ok else "" for x, ok in zip(f, some, strict=True)]


def of_texts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    got = [fingerprints(t) for t in steps(pa.array(texts, pa.string()))]
    return np.concatenate([f for f, _ in got]), np.concatenate([s for _, s in got])


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the column fingerprint, in place of an input column of that name."""
    kept = [f for f in docs.schema.fields if f.name != "fingerprint"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in steps(b.column(text)):
                part = b.slice(t.first, t.count)
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), pa.array(packed(*fingerprints(t)), pa.string())], names=[*(f.name for f in kept), "fingerprint"])

    return docs.transform(mapped, run, T.StructType([*kept, T.StructField("fingerprint", T.StringType())]))


def with_next(docs: DataFrame, text: str = "text") -> DataFrame:
    """(bucket, follows, doc_id, text), dealt and sorted so that within a bucket each row is followed by its next document.

    Order: descending doc_id (null last), then text. Buckets are ranges of ids; the row that follows a bucket's last one
    is added to it with ``follows`` set. After the last document comes the first. The driver sees a bound and an id for
    each bucket, at most MOST_BUCKETS.
    """
    rows = docs.select("doc_id", F.coalesce(text, F.lit("")).alias("text"))
    spread = parts(text_bytes(docs, text))
    n = min(MOST_BUCKETS, 4 * spread)
    got = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n)).first()[0] if n > 1 else None
    bounds = np.unique(np.array(got or [], np.int64))

    @F.pandas_udf("long")
    def bucket(ids: pd.Series) -> pd.Series:
        return pd.Series(-np.searchsorted(bounds, ids.fillna(-(2**63)).to_numpy().astype(np.int64), "right").astype(np.int64))

    dealt = rows.withColumn("bucket", bucket("doc_id"))
    heads = sorted((r["bucket"], r["id"]) for r in rows.select("doc_id", bucket("doc_id").alias("bucket")).groupBy("bucket").agg(F.max("doc_id").alias("id")).collect() if r["bucket"] is not None)
    need = [(before, head) for (before, _), (_, head) in zip(heads, heads[1:] + heads[:1], strict=True)]
    wanted = F.broadcast(docs.sparkSession.createDataFrame(need, "bucket long, head long"))
    after = rows.join(wanted, rows["doc_id"].eqNullSafe(wanted["head"])).select("bucket", F.lit(True).alias("follows"), "doc_id", "text")
    return dealt.select("bucket", F.lit(False).alias("follows"), "doc_id", "text").unionByName(after).repartition(min(spread, n), "bucket").sortWithinPartitions("bucket", "follows", F.col("doc_id").desc_nulls_last(), "text")


def edited_pairs(docs: DataFrame, text: str = "text", step: int = 512 << 10) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every document.

    The edited text has its last n_chars // 3 characters replaced by the first as many of the next document.
    """
    kind = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")), *(T.StructField(c, T.DoubleType()) for c in ("near_edited", "near_next"))])

    def made(ids: list, texts: list[str]) -> pa.RecordBatch:
        """Of all but the last, which only follows."""
        cut = [len(x) // 3 for x in texts[:-1]]
        edited = [x[: len(x) - k] + y[:k] for x, y, k in zip(texts, texts[1:], cut, strict=False)]
        f, some = of_texts(texts)
        g, others = of_texts(edited)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids[:-1], pa.int64()),
                pa.array([len(x) for x in texts[:-1]], pa.int64()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited]),
                pa.array(packed(f[:-1], some[:-1]), pa.string()),
                pa.array(packed(g, others), pa.string()),
                pa.array(likeness(f[:-1], some[:-1], g, others)),
                pa.array(likeness(f[:-1], some[:-1], f[1:], some[1:])),
            ],
            names=kind.names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size, now, over = [], [], 0, None, False
        for b in batches:
            for bucket, follows, doc, x in zip(*(b.column(c).to_pylist() for c in ("bucket", "follows", "doc_id", "text")), strict=True):
                if bucket != now:
                    if len(texts) > 1:
                        yield made(ids, texts)
                    ids, texts, size, now, over = [], [], 0, bucket, False
                if over:  # rows of equal id that follow: the first is the next document
                    continue
                over = follows
                ids.append(doc)
                texts.append(x)
                size += len(x)
                if len(texts) > 1 and (size > step or len(texts) > 2048):
                    yield made(ids, texts)
                    ids, texts, size = ids[-1:], texts[-1:], len(texts[-1])
        if len(texts) > 1:
            yield made(ids, texts)

    return with_next(docs, text).transform(mapped, run, kind)
