"""Candidate places of snippets in containers, scored by the words around them. All documents in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pagewright.functions import text as t


def candidates(refs: DataFrame, containers: DataFrame) -> DataFrame:
    """(doc_id, ord, container_idx, start, marker_pos, container_text): every occurrence of every snippet, overlapping too.

    refs: (doc_id, ord, snippet); containers: (doc_id, container_idx, text). The join is by document, so it is a hash or
    merge join with ``contains`` as its residual condition.
    """
    r = refs.where("doc_id IS NOT NULL").withColumn("_b", t.break_mark(F.col("snippet"))).where(F.length("_b.search") > 0)
    c = containers.select("doc_id", "container_idx", F.col("text").alias("container_text"))
    pairs = r.join(c, "doc_id").where(F.contains("container_text", F.col("_b.search")))
    at = pairs.withColumn("start", F.explode(t.occurrences(F.col("_b.search"), F.col("container_text"))))
    return at.select(*(f for f in refs.columns), "container_idx", "start", (F.col("start") + F.col("_b.offset")).alias("marker_pos"), F.length("_b.search").alias("length"), "container_text")


def scored(found: DataFrame, n: int = 4) -> DataFrame:
    """With score: how well the words around each place fit context_before and context_after."""
    around = t.html_context(F.col("container_text"), F.col("start"), F.col("length"), n)
    score = t.context_score(F.coalesce("context_before", F.lit("")), F.coalesce("context_after", F.lit("")), F.col("_a.before"), F.col("_a.after"))
    return found.withColumn("_a", around).withColumn("score", score).drop("_a")


def best(found: DataFrame, threshold: float = 0.3) -> DataFrame:
    """One place a snippet: the highest score, the earliest of several; below the threshold the first place."""
    place = ("container_idx", "marker_pos")
    by = Window.partitionBy("doc_id", "ord")
    ranked = found.withColumn("_top", F.row_number().over(by.orderBy(F.col("score").desc(), *place))).withColumn("_first", F.row_number().over(by.orderBy(*place))).withColumn("_best", F.max("score").over(by))
    return ranked.where((F.col("_best") >= threshold) & (F.col("_top") == 1) | (F.col("_best") < threshold) & (F.col("_first") == 1)).drop("_top", "_first", "_best")


def in_node(places: DataFrame, nodes: DataFrame) -> DataFrame:
    """Places with the text node that holds them: start_off < marker_pos <= end_off."""
    n = nodes.select("doc_id", "container_idx", "node_idx", "start_off", "end_off")
    return places.join(n, ["doc_id", "container_idx"]).where("start_off < marker_pos AND marker_pos <= end_off").withColumn("pos_in_node", F.col("marker_pos") - F.col("start_off"))


def occurrence(refs: DataFrame) -> DataFrame:
    """With occurrence: which one of its page label a reference is, in the order of pages. References without page or snippet have none."""
    number, label = t.sort_keys(F.col("page"))
    w = Window.partitionBy("doc_id", "page").orderBy(number, label, "ord")
    valid = F.col("page").isNotNull() & F.col("snippet").isNotNull()
    return refs.withColumn("occurrence", F.when(valid, F.count_if(valid).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))))


def out_of_order(markers: DataFrame) -> DataFrame:
    """With removed: markers (doc_id, pos, label) whose number is below one before them; labels that are no number never are."""
    number = F.when(F.trim("label").rlike(r"^[+-]?[0-9]+\z"), F.trim("label").try_cast("bigint"))
    before = F.max("_n").over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    return markers.withColumn("_n", number).withColumn("removed", F.coalesce(F.col("_n") < F.coalesce(before, F.lit(-1)), F.lit(False))).drop("_n")


def sequential(found: DataFrame, text: Column | None = None) -> DataFrame:
    """First places in document order by a fold: each reference takes its first candidate after the one before it.

    found: (doc_id, ord, container_idx, start, marker_pos), the candidates of references in the order of ord. The fold
    runs over the places alone, inside one aggregation a document: (doc_id, ord, container_idx, marker_pos).
    """
    rows = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "container_idx", "start", "marker_pos"))).alias("c"))
    kind = "struct<ord:int,container_idx:int,marker_pos:int>"
    start = F.struct(F.array().cast(f"array<{kind}>").alias("out"), F.lit(-1).alias("idx"), F.lit(0).alias("pos"), F.lit(-(2**31)).alias("last"))

    def step(acc: Column, x: Column) -> Column:
        after = (x["container_idx"] > acc["idx"]) | (x["container_idx"] == acc["idx"]) & (x["start"] >= acc["pos"])
        take = (x["ord"] != acc["last"]) & after & (x["marker_pos"] > 0)
        one = F.struct(x["ord"].cast("int").alias("ord"), x["container_idx"].cast("int").alias("container_idx"), x["marker_pos"].cast("int").alias("marker_pos"))
        taken = F.struct(F.concat(acc["out"], F.array(one)).alias("out"), x["container_idx"].cast("int").alias("idx"), x["marker_pos"].cast("int").alias("pos"), x["ord"].cast("int").alias("last"))
        return F.when(take, taken).otherwise(acc)

    return rows.select("doc_id", F.inline(F.aggregate("c", start, step)["out"]))
