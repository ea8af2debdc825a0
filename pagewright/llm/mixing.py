"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

A source's target over its size is the number of copies each of its documents should have; the whole part is taken and
the fractional part is a probability. Documents of a source are dealt to blocks of about BLOCK rows by a hash. Within a
block, in order of size, a fold pairs the pending document with the next one and moves probability from one to the
other at random, without bias, until one of the two is 0 or 1. So each block decides all its documents but one; those
that are left form the blocks of the next level, up to one document a source. This tree has log(n) / log(BLOCK) levels,
and each shuffles only what the level below left over.

The copies of a source thus add up to its target number within one document, and since pairs have like sizes, the words
do so too. Random numbers are hashes of the ids, so reruns agree.

Equal rows are counted first and numbered, so that each has a place of its own: very many rows without an id, all of one
size, are dealt to blocks like any others. Words are counted once; what the steps use is (doc_id, source, size).

Null texts have size 0; a null source is a source of its own, last in order; repeated rows are drawn one by one; a very
long text counts whole, as one document that is taken or not; an empty table gives an empty result. A source without words
has target 0. Other columns of docs pass through mix(), whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from pagewright.llm.tables import checkpoint, fresh, size_in_words

BLOCK = 256
WEIGHTS = (5, 2, 1)
SEED = 20240229
ITEM = "struct<size:bigint,doc_id:bigint,nth:bigint,p:double>"
RUN = 1024


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, most: int = 3) -> DataFrame:
    """(source, source_size, n_docs, target): sizes has (source, size).

    The sources, by code point with null last, weigh ``weights`` in turn. They share ``share`` of all words; a target
    stops at ``most`` times its source's size, and the rest is shared anew by weight. In order of cap over weight, the
    capped sources come first, so running sums find the level at which no target is above its cap. Windows run over
    one row for each source.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    ranked = by.withColumn("k", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weighed = ranked.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("k") % len(weights) + 1).cast("int"))).withColumn("cap", most * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "k")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    on = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    level = weighed.withColumn("level", (total - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(on))
    capped = level.withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
    final = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), "k", "level"))).over(everything)["level"]
    return capped.select("source", "source_size", "n_docs", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(final * F.col("weight")).alias("target"))


def _uniform(*of: Column) -> Column:
    """In (0, 1), from a hash."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *of), 11).cast("double") + 0.5) / float(1 << 53)


def _fold(items: Column, level: int) -> Column:
    """items: sorted array of ITEM. Struct of the decided ones, with p = 0 or 1, and of the pending one."""
    item = ITEM
    none = F.lit(None).cast(item)
    made = lambda x, p: F.struct(x["size"].alias("size"), x["doc_id"].alias("doc_id"), x["nth"].alias("nth"), p.cast("double").alias("p"))
    start = F.struct(F.array().cast(f"array<{item}>").alias("done"), none.alias("pending"))

    def step(acc: Column, x: Column) -> Column:
        old, eps = acc["pending"], 1e-12
        a, b = old["p"], x["p"]
        u = _uniform(F.lit(level), old["doc_id"], x["doc_id"], old["size"], x["size"], old["nth"], x["nth"])
        low = a + b < 1
        first = F.when(low, u * (a + b) < a).otherwise(u * (2 - a - b) < 1 - b)
        # below 1 together: the one that wins holds both, the other is out; else the one that wins is in, the other holds the rest
        winner, loser = F.when(first, old).otherwise(x), F.when(first, x).otherwise(old)
        settled = F.when(low, made(loser, F.lit(0))).otherwise(made(winner, F.lit(1)))
        rest = F.when(low, made(winner, a + b)).otherwise(made(loser, a + b - 1))
        whole = lambda y: (y["p"] < eps) | (y["p"] > 1 - eps)
        paired = F.struct(
            F.concat(acc["done"], F.array(settled), F.when(whole(rest), F.array(made(rest, F.round(rest["p"])))).otherwise(F.array().cast(f"array<{item}>"))).alias("done"),
            F.when(whole(rest), none).otherwise(rest).alias("pending"),
        )
        alone = F.struct(acc["done"].alias("done"), x.alias("pending"))
        return F.when(whole(x), F.struct(F.concat(acc["done"], F.array(made(x, F.round(b)))).alias("done"), old.alias("pending"))).when(old.isNull(), alone).otherwise(paired)

    return F.aggregate(items, start, step)


def numbered(rows: DataFrame) -> DataFrame:
    """rows (doc_id, source, size) with nth: 0 and on among equal rows. No array is longer than RUN, or a RUN-th of the equal rows."""
    n = rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))
    runs = n.select("doc_id", "source", "size", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RUN))).alias("run"))
    return runs.select("doc_id", "source", "size", F.explode(F.sequence(F.col("run") * RUN, F.least(F.col("n"), (F.col("run") + 1) * RUN) - 1)).alias("nth"))


def draws(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, most: int = 3) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for each row of sizes (doc_id, source, size)."""
    sizes = checkpoint(numbered(sizes.select("doc_id", "source", F.col("size").cast("long").alias("size"))))
    shares = targets(sizes, weights, share, most)
    largest = sizes.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    c = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    c = F.when(F.abs(c - F.round(c)) < 1e-12, F.round(c)).otherwise(c)
    shares = shares.select(F.col("source").alias("of"), "source_size", "target", F.floor(c).alias("whole"), (c - F.floor(c)).alias("p"), F.greatest(F.lit(1), F.ceil(F.col("n_docs") / BLOCK)).alias("blocks"))
    about = F.struct("of", "source_size", "target", "whole")
    rows = sizes.join(shares, sizes["source"].eqNullSafe(shares["of"])).select(about.alias("about"), "blocks", F.struct("size", "doc_id", "nth", "p").alias("item"))
    out, level = None, 0
    n = largest
    while True:
        block = F.pmod(F.xxhash64(F.lit(SEED + level), "item.doc_id", "item.size", "item.nth"), F.col("blocks"))
        folded = rows.groupBy("about", "blocks", block.alias("block")).agg(F.sort_array(F.collect_list("item")).alias("items")).select("about", "blocks", _fold(F.col("items"), level).alias("f"))
        last = n <= BLOCK
        pending = F.col("f.pending")
        ends = F.struct(pending["size"].alias("size"), pending["doc_id"].alias("doc_id"), pending["nth"].alias("nth"), F.when(_uniform(F.lit(level), pending["doc_id"], pending["size"], pending["nth"], pending["p"]) < pending["p"], 1.0).otherwise(0.0).alias("p"))
        items = F.concat("f.done", F.when(pending.isNotNull(), F.array(ends)).otherwise(F.array().cast(f"array<{ITEM}>"))) if last else F.col("f.done")
        done = folded.select("about", F.explode(items).alias("x"))
        out = done if out is None else out.unionByName(done)
        if last:
            break
        rows = folded.where("f.pending IS NOT NULL").select("about", F.greatest(F.lit(1), F.ceil(F.col("blocks") / BLOCK)).alias("blocks"), F.col("f.pending").alias("item"))
        n, level = math.ceil(n / BLOCK), level + 1
    return out.select(F.col("x.doc_id").alias("doc_id"), F.col("about.of").alias("source"), F.col("x.size").alias("size"), "about.source_size", "about.target", (F.col("about.whole") + F.col("x.p")).cast("long").alias("copies"))


def sizes(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select("doc_id", "source", size_in_words(text).alias("size"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, most: int = 3) -> DataFrame:
    """The rows of docs, each as often as it is drawn. Rows with equal doc_id and source are drawn as one."""
    units = sizes(docs).groupBy("doc_id", "source").agg(F.sum("size").alias("size"))
    names = docs.columns
    of_id, of_source, copies = (fresh(n, names) for n in ("drawn_id", "drawn_source", "drawn_copies"))
    drawn = draws(units, weights, share, most).where("copies > 0").select(F.col("doc_id").alias(of_id), F.col("source").alias(of_source), F.sequence(F.lit(1), F.col("copies").cast("int")).alias(copies))
    on = docs["doc_id"].eqNullSafe(drawn[of_id]) & docs["source"].eqNullSafe(drawn[of_source])
    return docs.join(drawn, on).select(*(docs[c] for c in names), F.explode(drawn[copies]).alias(of_id)).select(*names)
