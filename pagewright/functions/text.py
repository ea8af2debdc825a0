"""Text functions as Column expressions. White space and word characters are Unicode's, spelled out because Java's
\\s and \\w know ASCII only."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column, functions as F

WS = r"[\t-\r\x1c-\x20\x85\p{Z}]"
NOT_WS = r"[^\t-\r\x1c-\x20\x85\p{Z}]"
WORD = r"[\p{L}\p{N}_]"

#: What production tools leave on pages, matched without regard to case; placeholders; noise of layout programs.
EXCLUDE_PATTERNS = (r"[A-Z0-9][A-Za-z0-9\s:./\-]*\.indd\s+\d+", r"\d{1,2}/\d{1,2}/\d{2,4}\s+\d{1,2}:\d{2}\s*(AM|PM)?")
PLACEHOLDER_END, PLACEHOLDER_BEGIN = "PASTE_TEXT_FROM_END_OF_PAGE_HERE", "PASTE_TEXT_FROM_BEGINNING_OF_PAGE_HERE"
NOISE_PATTERNS = (
    r"\d{2}_Layout\s+\d+\s+\d{1,2}/\d{1,2}/\d{2,4}\s+\d{1,2}:\d{2}\s+[AP]M\s+Page\s+\d+",
    r"\d{2}_Layout\s+\d+.*?Page\s+\d+",
    r"Page\s+\d+",
    r"\d{1,2}/\d{1,2}/\d{2,4}\s+\d{1,2}:\d{2}\s+[AP]M",
)
FOOTNOTE_LIST = r"""(?is)<ol[^>]*class="[^"]*_idFootAndEndNoteOLAttrs[^"]*"[^>]*>.*?</ol>"""


def java(pattern: str) -> str:
    """A Python pattern for Java: \\s, \\w and \\d take Unicode's classes."""
    inside = False
    out, i = [], 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two in (r"\s", r"\w", r"\d"):
            body = {r"\s": r"\t-\r\x1c-\x20\x85\p{Z}", r"\w": r"\p{L}\p{N}_", r"\d": r"\p{Nd}"}[two]
            out.append(body if inside else f"[{body}]")
            i += 2
            continue
        if pattern[i] == "\\":
            out.append(two)
            i += 2
            continue
        inside = pattern[i] == "[" or inside and pattern[i] != "]"
        out.append(pattern[i])
        i += 1
    return "".join(out)


def collapse(t: Column) -> Column:
    """Each run of white space becomes one space."""
    return F.regexp_replace(t, WS + "+", " ")


def strip(t: Column) -> Column:
    return F.regexp_replace(t, f"^{WS}+|{WS}+\\z", "")


def rstrip(t: Column) -> Column:
    return F.regexp_replace(t, f"{WS}+\\z", "")


def words(t: Column) -> Column:
    return F.filter(F.split(t, WS + "+"), lambda x: x != "")


def last_words(w: Column, n: int | Column) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return F.array_join(F.slice(w, F.greatest(F.lit(1), F.size(w) - n + 1), n), " ")


def first_words(w: Column, n: int) -> Column:
    return F.array_join(F.slice(w, 1, n), " ")


def rfind(needle: str, t: Column) -> Column:
    """0-based place of the last occurrence, -1 without one."""
    at = F.position(F.lit(needle[::-1]), F.reverse(t))
    return F.when(at > 0, F.length(t) - at - len(needle) + 1).otherwise(-1)


#: EXCLUDE_PATTERNS[0], tried only where a run of its characters begins and going back from the run's end, so the time
#: is in proportion to the text. A match begins at the first letter or digit of a run and ends at the last file name.
_RUN = r"A-Za-z0-9\s:./\-"
FAST = {EXCLUDE_PATTERNS[0]: (rf"((?<![{_RUN}])[\s:./\-]*+)[A-Z0-9][{_RUN}]*\.indd\s+\d+", "$1")}


def filter_metadata(t: Column, patterns: tuple[str, ...] = EXCLUDE_PATTERNS) -> Column:
    """Deletes each pattern, then collapses white space. Without patterns the text stays as it is."""
    for p in patterns:
        fast, kept = FAST.get(p, (p, ""))
        t = F.regexp_replace(t, "(?iu)" + java(fast), kept)
    return strip(collapse(t)) if patterns else t


def dehyphenate(t: Column) -> Column:
    """Joins words that a line break has cut."""
    return F.regexp_replace(t, f"({WORD})-{WS}+({WORD})", "$1$2")


def trim_end_boundary(s: Column) -> Column:
    """Up to the last sentence mark, if that leaves more than a third."""
    best = F.greatest(*(F.when(rfind(b, s) > F.floor(F.length(s) / 3), rfind(b, s)).otherwise(-1) for b in (". ", "; ", ": ", "· ")))
    bare = rstrip(s)
    return F.when(bare.rlike(r"[.;:·]\z"), bare).when(best > 0, rstrip(F.substr(s, F.lit(1), (best + 1).cast("int")))).otherwise(s)


def trim_start_boundary(s: Column) -> Column:
    """From the first letter on, unless it begins with a letter of any script."""
    at = F.regexp_instr(s, F.lit("[A-Za-zΑ-Ωα-ωά-ώ]"))
    return F.when(s.rlike(r"^\p{L}") | (at == 0), s).otherwise(F.substr(s, at))


def tighten_slashes(t: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(t, f"{WS}+/{WS}*", "/"), f"{WS}*/{WS}+", "/")


def tighten_punctuation(t: Column) -> Column:
    return F.regexp_replace(t, f"{WS}+([.,;:!?·])", "$1")


def clean_noise(t: Column) -> Column:
    for p in NOISE_PATTERNS:
        t = F.regexp_replace(t, "(?iu)" + java(p), "")
    return strip(collapse(t))


def page_context(text: Column, snippet: Column, n: int = 4) -> Column:
    """Struct (before, after): up to n words around the first occurrence of the snippet; empty without one."""
    at = F.position(snippet, text)
    none = F.struct(F.lit("").alias("before"), F.lit("").alias("after"))
    if n <= 0:
        return none
    before = words(F.substr(text, F.lit(1), at - 1))
    after = words(F.substr(text, at + F.length(snippet)))
    return F.when((F.length(snippet) == 0) | (at == 0) | F.isnull(at), none).otherwise(F.struct(last_words(before, n).alias("before"), first_words(after, n).alias("after")))


def html_context(text: Column, start: Column, length: Column, n: int = 4) -> Column:
    """Struct (before, after) of up to n words around text[start:start + length], start counted from 0."""
    return F.struct(last_words(words(F.substr(text, F.lit(1), start.cast("int"))), n).alias("before"), first_words(words(F.substr(text, (start + length + 1).cast("int"))), n).alias("after"))


# -- flat HTML text: three views that differ on purpose --------------------------------------------------------------


def html_for_completion(html: Column) -> Column:
    """Without footnote lists, tags removed, white space collapsed."""
    return collapse(F.regexp_replace(F.regexp_replace(html, FOOTNOTE_LIST, ""), "<[^>]+>", ""))


def html_for_matching(html: Column) -> Column:
    """Tags become spaces."""
    return strip(collapse(F.regexp_replace(html, "<[^>]+>", " ")))


def html_for_validation(html: Column) -> Column:
    """Tags removed, white space collapsed, slashes tightened as in snippets."""
    return tighten_slashes(collapse(F.regexp_replace(html, "<[^>]+>", "")))


# -- words without accents, scores -----------------------------------------------------------------------------------


@cache
def _accents() -> tuple[str, str]:
    """Characters that decompose to one base character and marks, and their base."""
    pairs = [(chr(c), "".join(x for x in unicodedata.normalize("NFD", chr(c)) if unicodedata.category(x) != "Mn")) for c in range(0xA0, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and not 0xAC00 <= c < 0xD7A4]
    pairs = [(a, b) for a, b in pairs if a != b and len(b) == 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def normalize_word(w: Column) -> Column:
    """Lower case, without accents."""
    return F.regexp_replace(F.translate(F.lower(w), *_accents()), r"\p{Mn}", "")


def word_set(t: Column) -> Column:
    return F.array_distinct(F.transform(words(t), normalize_word))


def jaccard(a: Column, b: Column) -> Column:
    """Of the two texts' sets of normalized words; 0 if one is empty."""
    x, y = word_set(a), word_set(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def context_score(before: Column, after: Column, found_before: Column, found_after: Column) -> Column:
    """Weighted likeness of the words around a place and the words expected there; a side that nothing is expected on does not count."""
    has_before, has_after = F.length(before) > 0, F.length(after) > 0
    b, a = jaccard(before, found_before), jaccard(after, found_after)
    return F.when(has_before & has_after, F.lit(0.4) * b + F.lit(0.6) * a).when(has_before, b).when(has_after, a).otherwise(0.0)


# -- labels and markers ----------------------------------------------------------------------------------------------

#: The roman numerals that page labels use.
ROMAN = ("i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "xi", "xii", "xiii", "xiv", "xv", "xvi", "xvii", "xviii", "xix", "xx")


def roman(n: Column) -> Column:
    """i to xx; 0 gives xx as counting from the end does, any other number stays decimal."""
    at = F.when(n == 0, len(ROMAN)).otherwise(n).cast("int")
    return F.when(at.between(1, len(ROMAN)), F.get(F.array(*(F.lit(r) for r in ROMAN)), at - 1)).otherwise(n.cast("string"))


def break_mark(snippet: Column) -> Column:
    """Struct (search, offset): the text to search, and where in it the marker goes. 'a|b' puts it between a and b."""
    halves = F.split(snippet, r"\|", 2)
    a, b = strip(halves[0]), strip(F.get(halves, F.lit(1)))
    marked = F.contains(snippet, F.lit("|"))
    return F.struct(F.when(marked, strip(F.concat(a, F.lit(" "), b))).otherwise(snippet).alias("search"), F.when(marked, F.length(a)).otherwise(F.length(snippet)).alias("offset"))


def sort_keys(page: Column) -> tuple[Column, Column]:
    """Pages in order: labels that are no number count as 0, then by label."""
    return F.coalesce(F.when(page.rlike(r"^[0-9]+\z"), page.try_cast("bigint")), F.lit(0)), F.coalesce(page, F.lit(""))


def marker_html(page: Column, occurrence: Column) -> Column:
    """The marker of a page; the k-th of the same label has -k in its id."""
    suffix = F.when(occurrence > 1, F.concat(F.lit("-"), occurrence.cast("string"))).otherwise("")
    safe = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    p = safe(page)
    return F.concat(F.lit('<span id="page'), p, suffix, F.lit('" class="page-number" role="note" aria-label="Page '), p, F.lit('">'), p, F.lit("</span>"))


def occurrences(needle: Column, t: Column) -> Column:
    """Array of the 0-based places of all occurrences, overlapping ones too; none of an empty needle.

    The text is split before each occurrence by one pass of a lookahead; the places are the running sums of the lengths.
    """
    quoted = F.concat(F.lit(r"(?=\Q"), F.replace(needle, F.lit("\\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E)"))
    lengths = F.transform(F.split(t, quoted), F.length)
    start = F.struct(F.when(F.startswith(t, needle), F.array(F.lit(0))).otherwise(F.array().cast("array<int>")).alias("at"), F.lit(0).alias("end"))
    ends = F.aggregate(lengths, start, lambda acc, n: F.struct(F.concat(acc["at"], F.array(acc["end"] + n)).alias("at"), (acc["end"] + n).alias("end")))["at"]
    return F.when((F.length(needle) == 0) | ~F.contains(t, needle), F.array().cast("array<int>")).otherwise(F.slice(ends, F.lit(1), F.size(ends) - 1))


def ngrams(words: Column, n: int) -> Column:
    """Every n words in a row, joined by spaces, in order; an empty array if there are fewer."""
    return F.when(F.size(words) < n, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.concat_ws(" ", *(F.get(words, i + k) for k in range(n)))))
