"""Column functions against plain Python on fixed and random texts."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from pagewright.functions import repair, text as t

PIECES = ["λόγος", "the", "a-", " ", "  ", "\n", " ", "\x1c", ".", "; ", ": ", "· ", "/", " / ", "-", "Ά", "é", "é", "_", "9", "٣", "«", "X.indd 81", "5/1/26 2:15 PM", "Page 12", ",", "ß", "ǆ", "|"]


def texts(n=400):
    rng = random.Random(2)
    return ["", " ", "plain words here", "XRDD 4:2025 SEL.indd 818", ".indd 5 abc", "a: X.indd 1 Y.indd 2 z", *("".join(rng.choices(PIECES, k=rng.randint(0, 14))) for _ in range(n))]


def both(spark, column, plain, values=None):
    values = values or texts()
    df = spark.createDataFrame(list(enumerate(values)), "i int, s string").repartition(2)
    got = {r["i"]: r["x"] for r in df.select("i", column(F.col("s")).alias("x")).collect()}
    for i, s in enumerate(values):
        assert got[i] == plain(s), (s, got[i], plain(s))


def metadata(s):
    for p in t.EXCLUDE_PATTERNS:
        s = re.sub(p, "", s, flags=re.I)
    return re.sub(r"\s+", " ", s).strip()


def end_boundary(s):
    if s.rstrip().endswith((".", ";", ":", "·")):
        return s.rstrip()
    at = max((p for b in (". ", "; ", ": ", "· ") if (p := s.rfind(b)) > len(s) // 3), default=-1)
    return s[: at + 1].rstrip() if at > 0 else s


def start_boundary(s):
    m = re.search("[A-Za-zΑ-Ωα-ωά-ώ]", s)
    return s if not s or s[0].isalpha() or not m else s[m.start() :]


CASES = [
    (t.words, str.split),
    (t.strip, str.strip),
    (t.filter_metadata, metadata),
    (t.dehyphenate, lambda s: re.sub(r"(\w)-\s+(\w)", r"\1\2", s)),
    (t.trim_end_boundary, end_boundary),
    (t.trim_start_boundary, start_boundary),
    (t.tighten_slashes, lambda s: re.sub(r"\s*/\s+", "/", re.sub(r"\s+/\s*", "/", s))),
    (t.tighten_punctuation, lambda s: re.sub(r"\s+([.,;:!?·])", r"\1", s)),
    (t.clean_noise, repair.clean_noise),
    (lambda c: t.last_words(t.words(c), 3), lambda s: " ".join(s.split()[-3:])),
    (lambda c: t.first_words(t.words(c), 3), lambda s: " ".join(s.split()[:3])),
    (lambda c: t.occurrences(F.lit("aa"), c), lambda s: [i for i in range(len(s)) if s.startswith("aa", i)]),
    (t.normalize_word, lambda s: "".join(c for c in unicodedata.normalize("NFD", s.lower()) if unicodedata.category(c) != "Mn")),
]


@pytest.mark.parametrize("k", range(len(CASES)))
def test_like_python(spark, k):
    column, plain = CASES[k]
    values = ["aaaa", "baab", "aa\\Eaa", "", "éaaa"] if k == 11 else [s for s in texts() if k != 12 or "ǆ" not in s]
    both(spark, column, plain, values)


def test_occurrences_of_odd_needles(spark):
    rows = [("a\\Eb a\\Eb", "a\\Eb", [0, 5]), ("x.y.x", ".", [1, 3]), ("abc", "", []), ("(?=", "(?", [0]), ("😀a😀a", "a", [1, 3]), ("aXa", "aXa", [0])]
    got = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, s string, n string, want array<int>").select(t.occurrences(F.col("n"), F.col("s")).alias("x"), "want").collect()
    assert all(r["x"] == r["want"] for r in got)


def test_labels(spark):
    got = [r[0] for r in spark.createDataFrame([(1,), (4,), (20,), (21,), (0,)], "n long").select(t.roman(F.col("n"))).collect()]
    assert got == ["i", "iv", "xx", "21", "xx"]
    m = spark.createDataFrame([("12", 1), ("iv", 2), ("<&>", 1)], "p string, k int").select(t.marker_html(F.col("p"), F.col("k"))).collect()
    assert [r[0] for r in m][:2] == ['<span id="page12" class="page-number" role="note" aria-label="Page 12">12</span>', '<span id="pageiv-2" class="page-number" role="note" aria-label="Page iv">iv</span>']
    assert "&lt;&amp;&gt;" in m[2][0]


@pytest.mark.parametrize(("a", "b", "want"), [("a b", "a b", 1.0), ("a b c d", "a b e f", 2 / 6), ("a", "b", 0.0), ("Λόγος", "λογοσ λόγος", 1 / 2), ("", "a", 0.0)])
def test_jaccard(spark, a, b, want):
    assert abs(spark.createDataFrame([(a, b)], "a string, b string").select(t.jaccard(F.col("a"), F.col("b"))).first()[0] - want) < 1e-12


def test_page_context(spark):
    rows = [("a b c d e f g h i", "e", "a b c d", "f g h i"), ("one x two", "x", "one", "two"), ("x after it", "x", "", "after it"), ("no", "x", "", ""), ("λέξη μία εδώ", "μία", "λέξη", "εδώ"), ("a x b x c", "x", "a", "b x c")]
    got = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, s string, b string, a string").select(t.page_context(F.col("t"), F.col("s")).alias("c"), "b", "a").collect()
    assert all((r["c"]["before"], r["c"]["after"]) == (r["b"], r["a"]) for r in got)
    assert tuple(spark.range(1).select(t.page_context(F.lit("a x b"), F.lit("x"), 0).alias("c")).first()["c"]) == ("", "")


def test_windows_over_all_words(spark, tmp_path):
    from pagewright.plans import catalog

    rows = [(1, " ".join(f"w{i}" for i in range(50))), (2, "a b"), (3, "a  b\nc"), (4, None), (5, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {(d, i, " ".join(w[i : i + 3])) for d, x in rows for w in [(x or "").split()] for i in range(len(w) - 2)}
    found = [tuple(r) for r in catalog.queries()["ngram_windows"](spark, str(tmp_path)).collect()]
    assert len(found) == len(want) and set(found) == want


def test_jaccard_of_whole_texts(spark, tmp_path):
    from pagewright.plans import catalog

    same = " ".join(f"w{i}" for i in range(100))
    rows = [(1, same + " x y"), (2, same + " x z"), (3, None), (5, "x")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r["score"] for r in catalog.queries()["jaccard_context"](spark, str(tmp_path)).collect()}
    assert found.keys() == {1, 2} and abs(found[1] - 101 / 103) < 1e-12 and found[2] == 0
