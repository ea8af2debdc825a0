"""Snippets of pages: one projection over the page texts, with repair against HTML where there is any."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from pagewright.errors import InvalidParameterError
from pagewright.functions import text as t
from pagewright.operators import repair

STRATEGIES = ("end_of_page", "beginning_of_page", "bottom_visual")


@dataclass(frozen=True)
class Options:
    """How snippets are taken.

    default_backend: what the plain backend does, which never reaches fuzzy matching or segmentation. second_backend: what
    the other one does: slashes are always tightened, no context is taken, and the note of a short page says how many words
    it needs.
    """

    snippet_words: int = 10
    min_words: int = 3
    strategy: str = "end_of_page"
    exclude_patterns: tuple[str, ...] = field(default=())
    use_default_excludes: bool = True
    context_words: int = 4
    fuzzy: bool = False
    segment: bool = False
    dictionary: tuple[str, ...] | None = None
    always_tighten: bool = False
    default_backend: bool = False
    second_backend: bool = False

    def __post_init__(self):
        if self.snippet_words < 1:
            raise InvalidParameterError(f"snippet_words must be at least 1, got {self.snippet_words}")
        if self.snippet_words > 1000:
            raise InvalidParameterError(f"snippet_words is too large, at most 1000, got {self.snippet_words}")
        if self.min_words < 1:
            raise InvalidParameterError(f"min_words must be at least 1, got {self.min_words}")
        if self.strategy not in STRATEGIES:
            raise InvalidParameterError(f"strategy must be one of {STRATEGIES}, got {self.strategy}")

    @property
    def patterns(self) -> tuple[str, ...]:
        return (t.EXCLUDE_PATTERNS if self.use_default_excludes else ()) + self.exclude_patterns

    @property
    def begin(self) -> bool:
        return self.strategy == "beginning_of_page"


def page_text(raw: Column, o: Options) -> Column:
    return t.dehyphenate(t.filter_metadata(F.coalesce(raw, F.lit("")), o.patterns))


def extract(pages: DataFrame, options: Options = Options(), html: DataFrame | None = None) -> DataFrame:
    """pages (doc_id, page, text) to records (doc_id, page, snippet, context_before, context_after, note, confidence, method, status).

    html: (doc_id, html). status: successful, insufficient_text, or failed where pages has a column ``note`` and a note from
    its source; context_status: context_extracted, context_partial, context_failed, or null where no context is asked for.
    """
    o = options
    said = F.col("note") if "note" in pages.columns else F.lit(None).cast("string")
    base = pages.select("doc_id", "page", page_text(F.col("text"), o).alias("text"), said.alias("said")).withColumn("w", t.words(F.col("text")))
    enough = (F.size("w") >= o.min_words) & F.col("said").isNull()
    original = t.first_words(F.col("w"), o.snippet_words) if o.begin else t.last_words(F.col("w"), o.snippet_words)
    cut = base.withColumn("original", original).withColumn("snippet", F.when(enough, t.trim_start_boundary(F.col("original")) if o.begin else t.trim_end_boundary(F.col("original"))))
    if html is not None:
        texts = html.select("doc_id", t.html_for_completion(F.col("html")).alias("text"))
        cut = repair.clean_snippets(cut, texts, o.begin, o.snippet_words).withColumn("snippet", F.coalesce("cleaned", "snippet")).drop("cleaned")
    elif o.always_tighten or o.second_backend:
        cut = cut.withColumn("snippet", t.tighten_slashes(t.strip(F.col("snippet"))))
    cut = cut.withColumns({"confidence": F.lit(None).cast("double"), "method": F.lit(None).cast("string")})
    if o.fuzzy and html is not None and not o.default_backend:
        flat = html.select("doc_id", t.html_for_matching(F.col("html")).alias("text"))
        cut = repair.fuzzy_match(cut, flat).withColumns({"snippet": F.when(F.isnull("snippet"), None).otherwise(F.coalesce(t.strip(F.col("match.text")), "snippet")), "confidence": F.col("match.rounded"), "method": F.when(F.col("match").isNotNull(), "html_match")}).drop("match")
    elif o.segment and not o.default_backend:
        cut = cut.withColumn("s", repair.segment_words(F.col("snippet"), o.dictionary, o.snippet_words)).withColumns({"snippet": F.when(F.isnull("snippet"), None).otherwise(t.strip(F.col("s.text"))), "confidence": F.when(F.col("snippet").isNotNull(), F.col("s.rounded")), "method": F.when(F.col("snippet").isNotNull(), "word_segmentation")}).drop("s")
    ok = F.col("snippet").isNotNull()
    words = 0 if o.second_backend else o.context_words
    context = t.page_context(F.col("text"), F.col("original"), words)
    short = F.concat(F.lit("Insufficient text (found "), F.size("w").cast("string"), F.lit(f" words, need {o.min_words})" if o.second_backend else " words)"))
    some = ok & ((F.length("c.before") > 0) | (F.length("c.after") > 0))
    both = (F.length("c.before") > 0) & (F.length("c.after") > 0)
    return cut.withColumn("c", context).select(
        "doc_id",
        "page",
        F.coalesce("snippet", F.lit(t.PLACEHOLDER_BEGIN if o.begin else t.PLACEHOLDER_END)).alias("snippet"),
        F.when(some, F.col("c.before")).alias("context_before"),
        F.when(some, F.col("c.after")).alias("context_after"),
        F.when(~ok, F.coalesce("said", short)).alias("note"),
        "confidence",
        "method",
        F.when(ok, "successful").when(F.col("said").isNotNull(), "failed").otherwise("insufficient_text").alias("status"),
        F.when(ok & F.lit(words > 0), F.when(~some, "context_failed").when(both, "context_extracted").otherwise("context_partial")).alias("context_status"),
    )


def page_range(records: DataFrame, start: int = 1, end: int | None = None, offset: int = 0) -> DataFrame:
    """Pages from start to end as the source numbers them; the offset is added afterwards."""
    some = records.where(F.col("page") >= start)
    some = some if end is None else some.where(F.col("page") <= end)
    return some.withColumn("page", F.col("page") + offset) if offset else some


def stats(records: DataFrame) -> DataFrame:
    """One row of counts."""
    count = lambda c, v: F.count_if(F.coalesce(F.col(c) == v, F.lit(False))).alias(v)
    return records.agg(F.count("*").alias("total_pages"), *(count("status", v) for v in ("successful", "insufficient_text", "failed")), *(count("context_status", v) for v in ("context_extracted", "context_partial", "context_failed")))


def review(records: DataFrame, below: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """Records of low confidence, and one row with the average; a record without confidence counts as 1."""
    c = F.coalesce("confidence", F.lit(1.0))
    return records.where(c < below), records.agg(F.coalesce(F.avg(c), F.lit(0.0)).alias("average_confidence"), F.count_if(c < below).alias("n_low"))
