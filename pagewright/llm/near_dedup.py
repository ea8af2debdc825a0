"""Near-duplicate classes by DartMinHash.

A document is a weighted set: its 5-word shingles with the number of times each occurs. Every element has a region of
its own, as wide as its weight; along the rank axis darts land in each unit of width at random moments, a Poisson process
drawn from hashes of the element alone. A document takes the darts in its regions up to a rank at which about
COORDINATES * (ln COORDINATES + SPARE) of them are expected, deals them to coordinates by hash, and keeps the earliest of
each coordinate. Two documents agree on a coordinate with the probability of their weighted Jaccard similarity, and the
work follows the number of darts, not weight times coordinates. If a coordinate stays empty, the rank is doubled.

Bands of ROWS coordinates are bucket keys. Equal texts are one representative from the start, so groups of copies cost a
row each in one aggregation. Buckets with the same members are kept once. The estimate from all coordinates (BITS bits of
each, corrected for chance) only finds candidates, from ``similarity - SLACK`` up; a link is a pair of which the texts
themselves have a weighted Jaccard similarity of ``similarity`` or more.

1. In each bucket, or block of BUCKET of its members, every member not yet connected is compared with the most central one
   and so on, by signatures alone. The candidates that would connect the bucket, a row a member at most, are verified on
   their texts, and what is verified makes the first components.
2. Buckets in which a candidate failed, and those of several blocks, are searched in full: their members come with the
   hashes of their elements, and every two that are not connected yet meet once, in a block or between two blocks. What
   the estimate lets pass is verified there and then, so again only links that connect are handed on, never pairs. A
   component of more than BUCKET members has blocks of its own, which do not meet each other: the work is the square of the
   members that stay unconnected, times the size of the large components around them. Blocks hold members by the size of
   their texts, so long texts make more blocks, not larger ones.

The links' connected components are the classes, so no class holds together by a pair below ``similarity``. The estimate
from 256 coordinates has a standard deviation of 0.025 at 0.8, so a pair of 0.8 is no candidate in 1 of 30,000 cases; it
shares none of the 30 buckets in 1 of 150,000.

Null texts are empty. Texts without words, and texts too different from all others, are classes of their own, except
that equal texts share one. Texts of one to four words have one shingle. Rows without a doc_id have no class. Rows of
equal doc_id are one document for the links. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pagewright.llm.arrays import Texts, mix, shingles, steps
from pagewright.llm.components import components
from pagewright.llm.tables import checkpoint, mapped

COORDINATES, BANDS, ROWS, BITS, SPARE, SLACK = 256, 30, 5, 8, 3.0, 0.1
BUCKET, HEAVY, LEAVES, SMALL = 1024, 16 << 10, 256, 200_000
U = np.uint64


def _elements(t: Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each unit of weight, and its text, in order of text: the c-th time a shingle occurs is unit c."""
    h, doc = shingles(t, size)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    unit = np.arange(len(h)) - np.repeat(at, np.diff(np.append(at, len(h))))
    return mix(h + unit.astype(U) * U(0x9FB21C651E98DF25)), doc


def signatures(t: Texts, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(texts, COORDINATES) ids of the earliest darts, and whether each text has any."""
    element, doc = _elements(t, size)
    weight = np.bincount(doc, minlength=t.count)
    out = np.zeros((t.count, COORDINATES), U)
    todo = weight > 0
    limit = COORDINATES * (math.log(COORDINATES) + SPARE) / np.maximum(1, weight)
    while todo.any():
        rank = np.full(t.count * COORDINATES, np.inf)
        best = np.zeros(t.count * COORDINATES, U)
        e = element[todo[doc]]
        d = doc[todo[doc]]
        at, thrown, width = np.zeros(len(e)), 0, 1
        while len(e):
            i = np.arange(thrown + 1, thrown + 1 + width, dtype=U)
            dart = mix(e[:, None] + i * U(0xD6E8FEB86659FD93))
            gap = -np.log(((dart >> U(11)).astype(np.float64) + 0.5) / 2.0**53)
            when = at[:, None] + np.cumsum(gap, 1)
            row, col = np.nonzero(when <= limit[d][:, None])
            id_ = mix(dart[row, col] ^ U(0xA0761D6478BD642F))
            cell = d[row] * COORDINATES + (id_ >> U(56)).astype(np.int64) % COORDINATES
            r = when[row, col]
            np.minimum.at(rank, cell, r)
            first = r == rank[cell]
            best[cell[first]] = id_[first]
            at = when[:, -1]
            more = at <= limit[d]
            e, d, at = e[more], d[more], at[more]
            thrown += width
            width = max(1, min(64, 2 * width, (1 << 20) // max(1, len(e))))
        full = np.isfinite(rank.reshape(t.count, COORDINATES)).all(1)
        ready = todo & full
        out[ready] = best.reshape(t.count, COORDINATES)[ready]
        todo &= ~full
        limit = np.where(todo, 2 * limit, limit)
    return out, weight > 0


def bands(ids: np.ndarray) -> np.ndarray:
    """(texts, BANDS) bucket keys."""
    x = ids[:, : BANDS * ROWS].reshape(len(ids), BANDS, ROWS)
    h = np.arange(1, BANDS + 1, dtype=U) * U(0xE7037ED1A0B428DB) + np.zeros((len(ids), 1), U)
    for k in range(ROWS):
        h = mix(h ^ x[:, :, k]) + U(k)
    return h


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated from packed signatures."""
    chance = 2.0**-BITS
    return ((a == b).mean(-1) - chance) / (1 - chance)


def connect(sig: np.ndarray, least: float, label: np.ndarray, side: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what is similar, directly or through others. Members of one label are connected already; only members of different sides are compared."""
    count = np.bincount((np.arange(sig.shape[1]) * 256 + sig).ravel(), minlength=256 * sig.shape[1]).reshape(-1, 256)
    central = (sig == count.argmax(1)).mean(1)
    label, found = label.copy(), []
    for p in np.argsort(-central, kind="stable"):
        apart = label != label[p]
        if not apart.any():
            break
        other = np.flatnonzero(apart & (side != side[p]))
        alike = similarity(sig[other], sig[p])
        near, alike = other[alike >= least], alike[alike >= least]
        for c in np.unique(label[near]):
            same = label[near] == c
            found.append((int(p), int(near[same][alike[same].argmax()])))
        label[np.isin(label, label[near])] = label[p]
    return found


def exact(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sets of elements, sorted and distinct."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def connect_exactly(sig: np.ndarray, elements: list[np.ndarray], limit: float, label: np.ndarray, side: np.ndarray) -> list[tuple[int, int]]:
    """Links of ``limit`` or more that connect the members of different sides, verified. Every pair that they leave unconnected was compared."""
    label, size, found = label.copy(), np.array([len(e) for e in elements]), []
    for p in range(len(sig) - 1):
        other = p + 1 + np.flatnonzero((label[p + 1 :] != label[p]) & (side[p + 1 :] != side[p]))
        other = other[np.minimum(size[other], size[p]) >= limit * np.maximum(size[other], size[p])]
        alike = similarity(sig[other], sig[p])
        near = alike >= limit - SLACK
        for q in other[near][np.argsort(-alike[near], kind="stable")].tolist():
            if label[q] != label[p] and exact(elements[p], elements[q]) >= limit:
                found.append((p, q))
                label[label == label[q]] = label[p]
    return found


def signature_table(docs: DataFrame, size: int = 5) -> DataFrame:
    """(same, doc_id, keys, sig) of one representative, the least doc_id, of each distinct text; same: its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in steps(b.column("text")):
                ids, some = signatures(t, size)
                keys = bands(ids).view(np.int64)
                part = b.slice(t.first, t.count)
                at = np.concatenate([[0], np.cumsum(some * BANDS)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("same"), part.column("doc_id"), pa.ListArray.from_arrays(pa.array(at), pa.array(keys[some].ravel())), pa.array([x.tobytes() for x in ids.astype(np.uint8)], pa.binary())], names=["same", "doc_id", "keys", "sig"])

    every = _hashed(docs).transform(mapped, run, "same binary, doc_id long, keys array<long>, sig binary")
    return every.groupBy("same").agg(F.min(F.struct("doc_id", "keys", "sig")).alias("x")).select("same", "x.*")


def _hashed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.where("doc_id IS NOT NULL").select(F.unhex(F.md5(F.encode(text, "UTF-8"))).alias("same"), "doc_id", text.alias("text"))


def _met(rows: DataFrame, limit: float, exactly: bool = False) -> DataFrame:
    """rows (bucket, x, y, side, doc_id, label, sig) to links (bucket, a, b) among the members of each (bucket, x, y); those of side null are all compared with each other.

    By the estimate, or ``exactly``: then rows have elements as well.
    """
    columns = ["bucket", "x", "y", "side", "doc_id", "label", "sig", *["elements"] * exactly]

    def said(bucket: int, rows: list[tuple]) -> pa.RecordBatch:
        side, ids, label, sigs, *elements = zip(*rows, strict=True)
        sides = np.array([i if s is None else -1 - s for i, s in enumerate(side)])
        sig = np.frombuffer(b"".join(sigs), np.uint8).reshape(len(ids), -1)
        found = connect_exactly(sig, [np.frombuffer(e, U) for e in elements[0]], limit, np.array(label), sides) if exactly else connect(sig, limit - SLACK, np.array(label), sides)
        a, b = [min(ids[i], ids[k]) for i, k in found], [max(ids[i], ids[k]) for i, k in found]
        return pa.RecordBatch.from_arrays([pa.array([bucket] * len(a), pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["bucket", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            for bucket, x, y, *member in zip(*(b.column(c).to_pylist() for c in columns), strict=True):
                if (bucket, x, y) != now:
                    if len(held) > 1:
                        yield said(now[0], held)
                    now, held = (bucket, x, y), []
                held.append(tuple(member))
        if len(held) > 1:
            yield said(now[0], held)

    return rows.select(*columns).repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y", "doc_id").transform(mapped, run, "bucket long, a long, b long")


def _with_elements(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(doc_id, elements): the sorted hashes of the elements of each document in wanted (same, doc_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in steps(b.column("text")):
                element, doc = _elements(t, size)
                element = element[np.lexsort((element, doc))]
                at = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=t.count))])
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(t.first, t.count), pa.array([element[i:j].tobytes() for i, j in zip(at, at[1:], strict=False)], pa.binary())], names=["doc_id", "elements"])

    if wanted.count() <= SMALL:
        wanted = F.broadcast(wanted)
    found = _hashed(docs).join(wanted, ["same", "doc_id"], "left_semi").select("doc_id", "text")
    return found.transform(mapped, run, "doc_id long, elements binary").dropDuplicates(["doc_id"])


def _labelled(members: DataFrame, weights: DataFrame, known: DataFrame) -> DataFrame:
    """members (bucket, doc_id), weights (doc_id, weight) and known (node, component) to (bucket, doc_id, weight, label).

    The label is looked up once for each document, not for each of its buckets. Written, since _pairs_of_blocks() reads it several times.
    """
    each = weights.join(known, F.col("doc_id") == F.col("node"), "left").select("doc_id", "weight", F.coalesce("component", "doc_id").alias("label"))
    return checkpoint(members.join(each, "doc_id").select("bucket", "doc_id", "weight", "label"))


def _pairs_of_blocks(rows: DataFrame) -> DataFrame:
    """rows (bucket, doc_id, weight, label) to rows of _met() in which every two members of a bucket that are not connected meet.

    Members are dealt to blocks of a weight of about BUCKET, and each block meets itself and each other one. A component
    above that in the bucket has blocks of its own, which do not meet each other.
    """
    labels = rows.groupBy("bucket", "label").agg(F.sum("weight").alias("m"))
    apart = labels.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    labels = labels.join(apart, "bucket").select("bucket", "label", "m", F.when(F.col("m") > BUCKET, F.col("label")).alias("own"))
    blocks = labels.groupBy("bucket", "own").agg(F.ceil(F.sum("m") / BUCKET).alias("k"))
    dealt = labels.join(blocks.select(F.col("bucket").alias("_bucket"), F.col("own").alias("_own"), "k"), (F.col("bucket") == F.col("_bucket")) & F.col("own").eqNullSafe(F.col("_own"))).select("bucket", "label", "own", "k")
    number = lambda i: F.xxhash64("bucket", F.coalesce("own", F.lit(0)), F.col("own").isNull(), i)
    rows = rows.join(dealt, ["bucket", "label"]).select("bucket", "doc_id", "label", number(F.pmod(F.xxhash64("doc_id", "bucket"), F.col("k"))).alias("block"))
    every = blocks.select("bucket", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("i")).select("bucket", "own", number(F.col("i")).alias("block"))
    x, y = every.select("bucket", F.col("own").alias("own_x"), F.col("block").alias("x")), every.select("bucket", F.col("own").alias("own_y"), F.col("block").alias("y"))
    meet = x.join(y, "bucket").where("x <= y AND (own_x IS NULL OR own_y IS NULL OR own_x <> own_y)")
    whole = F.when(F.col("x") < F.col("y"), F.lit(0))
    sides = meet.select("bucket", "x", "y", F.col("x").alias("block"), whole.alias("side")).unionByName(meet.where("x < y").select("bucket", "x", "y", F.col("y").alias("block"), F.lit(1).alias("side")))
    return rows.join(sides, ["bucket", "block"]).select("bucket", "x", "y", "side", "doc_id", "label")


def verified(docs: DataFrame, pairs: DataFrame, similarity: float, size: int = 5) -> DataFrame:
    """The pairs (a, b) of which the texts in docs have a weighted Jaccard similarity of ``similarity`` or more. Pairs of very many with one a are dealt to several tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first = None, []
        for batch in batches:
            a, part, b = (batch.column(c).to_pylist() for c in ("a", "part", "b"))
            right = []
            for t in steps(batch.column("text")):
                element, doc = _elements(t, size)
                element = element[np.lexsort((element, doc))]
                at = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=t.count))])
                for i in range(t.count):
                    k, e = t.first + i, element[at[i] : at[i + 1]]
                    if (a[k], part[k]) != now:
                        now, first = (a[k], part[k]), []
                    if b[k] is not None:
                        right += [k] * (max((exact(x, e) for x in first), default=0) >= similarity)
                    elif not any(np.array_equal(x, e) for x in first):
                        first.append(e)
            yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in right], pa.int64()), pa.array([b[k] for k in right], pa.int64())], names=["a", "b"])

    many = pairs.groupBy("a").agg(F.count("*").alias("n"))
    dealt = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / LEAVES)).alias("part"))
    needs = dealt.select("a", "part", "b", F.col("b").alias("doc_id")).unionByName(dealt.select("a", "part", F.lit(None).cast("long").alias("b"), F.col("a").alias("doc_id")).distinct())
    if pairs.count() <= SMALL:
        needs = F.broadcast(needs)
    rows = _hashed(docs).join(needs, "doc_id").select("a", "part", "b", "text")
    return rows.repartition("a", "part").sortWithinPartitions("a", "part", "b").transform(mapped, run, "a long, b long").distinct()


def links(table: DataFrame, docs: DataFrame, similarity: float, size: int = 5) -> DataFrame:
    """(a, b): verified links between representatives."""
    keyed = table.select("doc_id", F.explode("keys").alias("key"))
    buckets = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"), F.bit_xor(F.xxhash64("doc_id")).alias("members"), F.sum(F.hash("doc_id").cast("long")).alias("again")).where("n > 1")
    once = buckets.groupBy("n", "least", "members", "again").agg(F.min("key").alias("key")).select("key", "n")
    sig = table.select("doc_id", "sig")
    every = checkpoint(keyed.join(once, "key").select(F.col("key").alias("bucket"), "doc_id", "n"))
    block = F.pmod(F.xxhash64("doc_id", "bucket"), F.ceil(F.col("n") / BUCKET))
    rows = every.select("bucket", block.alias("x"), block.alias("y"), F.lit(None).cast("int").alias("side"), "doc_id", F.col("doc_id").alias("label"))
    found = checkpoint(_met(rows.join(sig, "doc_id"), similarity))
    right = checkpoint(verified(docs, found.select("a", "b").distinct(), similarity, size))
    large, failed = every.where(F.col("n") > BUCKET).select("bucket"), found.join(right, ["a", "b"], "left_anti").select("bucket")
    members = checkpoint(every.join(large.unionByName(failed).distinct(), "bucket").select("bucket", "doc_id"))
    if members.isEmpty():
        return right
    wanted = members.select("doc_id").distinct().join(table.select("same", "doc_id"), "doc_id")
    elements = checkpoint(_with_elements(docs, wanted, size).join(sig, "doc_id"))
    rows = _labelled(members, elements.select("doc_id", (1 + F.octet_length("elements") / HEAVY).alias("weight")), components(right))
    rest = _met(_pairs_of_blocks(rows).join(elements, "doc_id"), similarity, exactly=True)
    return checkpoint(right.unionByName(rest.select("a", "b").distinct()))


def near_dedup(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """(doc_id, same_text_id, class_id) of each row of docs (doc_id, text) with an id; class_id is the least doc_id of the class."""
    table = checkpoint(signature_table(docs.select("doc_id", "text"), shingle))
    found = components(links(table, docs, similarity, shingle))
    classes = table.select("same", F.col("doc_id").alias("same_text_id")).join(found, F.col("same_text_id") == F.col("node"), "left").select("same", "same_text_id", F.coalesce("component", "same_text_id").alias("class_id"))
    return _hashed(docs).select("same", "doc_id").join(classes, "same").select("doc_id", "same_text_id", "class_id")
