"""HTML, placement, repair, extraction, validation, sources and the command line."""

import json
import random

import pytest
from pyspark.sql import functions as F

from pagewright import cli, errors
from pagewright.functions import repair
from pagewright.operators import extract as ex, layout, locate, mark, repair as rep, validate
from pagewright.sources import html_tree, pdf, references, texts
from pagewright.sources.template import template

BOOK = "<html><head><title>T</title></head><body><p>First page ends <b>right</b> here. More text.</p><div><p>Second part ends there, and goes on.</p></div><script>x</script></body></html>"
REFS = "doc_id long, ord int, page string, snippet string, context_before string, context_after string"


def place(spark, html, *refs):
    rows = [(1, i, *(list(r) + [None] * (4 - len(r)))) for i, r in enumerate(refs)]
    r, h = spark.createDataFrame(rows, REFS), spark.createDataFrame([(1, html)], "doc_id long, html string")
    out = sorted(mark.place(r, h).collect(), key=lambda x: x["ord"])
    return out, mark.mark(r, h).first()["html"], mark.mark(r, h).first()["out_of_order"]


def test_tree_keeps_what_it_reads():
    for html in (BOOK, '<!DOCTYPE html>\n<p class="a b">x &amp; y &lt;</p>', "<p>a<br/>b<img src=\"q'\"/></p>", "<p>one<p>two", "</b>x</p>"):
        out = html_tree.render(html_tree.parse(html))
        assert html_tree.render(html_tree.parse(out)).replace("\n", "") == out.replace("\n", "")
    root = html_tree.parse("<div>own<p>leaf</p></div><p>a<!-- c --><b>b</b></p><style><p>no</p></style><p>open<p>inner")
    assert [c.get_text() for c in html_tree.containers(root)] == ["leaf", "ab", "inner"]


def test_tables(spark):
    docs = spark.createDataFrame([(1, "<p>ab<i>c</i></p><li>d</li>"), (2, None)], "doc_id long, html string")
    assert [tuple(r) for r in html_tree.container_table(docs).orderBy("container_idx").collect()] == [(1, 0, "p", "abc"), (1, 1, "li", "d")]
    assert [tuple(r) for r in html_tree.node_table(docs).orderBy("container_idx", "node_idx").collect()] == [(1, 0, 0, 0, 2, "ab"), (1, 0, 1, 2, 3, "c"), (1, 1, 0, 0, 1, "d")]


def test_mark_in_order(spark):
    out, html, gone = place(spark, BOOK, ("2", "ends right here."), ("10", "ends there"), ("11", "absent"))
    assert [r["status"] for r in out] == ["found", "found", "not_found"] and gone == 0
    assert 'here. <span id="page2" class="page-number" role="note" aria-label="Page 2">2</span> More' in html
    assert html.index("page2") < html.index("page10") and "there <span" in html


def test_context_chooses(spark):
    html = "<p>red fox same words blue sky</p><p>green hill same words white snow</p>"
    out, marked, _ = place(spark, html, ("1", "same words", "green hill", "white snow"))
    assert (out[0]["container_idx"], out[0]["context_status"], out[0]["score"]) == (1, "context_used", 1.0)
    out, *_ = place(spark, html, ("1", "same words", "none", "such"))
    assert (out[0]["container_idx"], out[0]["context_status"]) == (0, "context_fallback")
    assert place(spark, html, ("1", "same words"), ("2", "same words"), ("3", "same words"))[0][2]["status"] == "not_found"


def test_labels_and_breaks(spark):
    html = "<p>alpha beta gamma delta</p><p>alpha beta</p>"
    out, marked, _ = place(spark, html, ("ii", "alpha beta|gamma"), ("i", "zeta"), ("iii", "alpha beta"), ("iii", None), (None, "alpha"))
    assert out[0]["marker_pos"] == 10 and "beta <span" in marked and ">ii</span> gamma" in marked
    out, marked, _ = place(spark, html, ("7", "alpha"), ("7", "delta"))
    assert [r["occurrence"] for r in out] == [1, 2] and 'id="page7-2"' in marked


def test_out_of_order(spark):
    html = '<p><span class="page-number">9</span> start text end</p><p>tail</p>'
    *_, marked, gone = place(spark, html, ("3", "text"), ("10", "tail"))
    assert gone == 1 and "page3" not in marked and "page10" in marked
    rows = [(1, i, x) for i, x in enumerate(["5", "3", "iv", "5", "9", "4", "10"])]
    out = locate.out_of_order(spark.createDataFrame(rows, "doc_id long, pos int, label string")).orderBy("pos").collect()
    assert [r["removed"] for r in out] == [False, True, False, False, False, True, False]


def test_css(spark):
    h = spark.createDataFrame([(1, BOOK), (2, "<p>no head</p>")], "doc_id long, html string")
    out = {r["doc_id"]: r["html"] for r in mark.mark(spark.createDataFrame([], REFS), h, css=True).collect()}
    assert ".page-number {" in out[1] and out[2] == "<p>no head</p>"


def test_sequential_places(spark):
    rng = random.Random(8)
    rows, refs = [], []
    for d in range(20):
        rows += [(d, k, " ".join(rng.choices("ab cd ef".split(), k=8))) for k in range(4)]
        refs += [(d, i, str(i), " ".join(rng.choices("ab cd ef".split(), k=2))) for i in range(9)]
    c, r = spark.createDataFrame(rows, "doc_id long, container_idx int, text string"), spark.createDataFrame(refs, "doc_id long, ord int, page string, snippet string")
    got = sorted(tuple(x) for x in locate.sequential(locate.candidates(r, c)).collect())
    want = []
    for d in range(20):
        at, pos = -1, 0
        for _, i, _, s in sorted(x for x in refs if x[0] == d):
            for _, k, t in sorted(x for x in rows if x[0] == d):
                start = t.find(s, pos if k == at else 0) if k >= at else -1
                if start >= 0:
                    want.append((d, i, k, start + len(s)))
                    at, pos = k, start + len(s)
                    break
    assert got == sorted(want)


HTML = "το λόγω της μεγάλης σύγχυσης, και αυτό είναι το τέλος της σελίδας εδώ"


@pytest.mark.parametrize(("s", "want"), [("της μεγάλης σύγχ", "της μεγάλης σύγχυσης"), ("το λόγω", "το λόγω"), ("το άγνωστο", "το άγνωστο"), ("το άγνω-", "το άγνω<!-- FIXME -->"), ("το λό-", "το λόγω"), ("", "")])
def test_last_word(s, want):
    assert repair.complete_last_word(s, HTML) == want


def test_first_word_and_anchor():
    assert repair.complete_first_word("γχυσης, και αυτό", HTML) == "σύγχυσης, και αυτό"
    assert repair.complete_first_word("λόγω της", HTML) == "λόγω της"
    assert repair.correct_from_anchor("και αυτό είναι τοτέλος", HTML, 6) == ("και αυτό είναι το", True)
    assert repair.correct_from_anchor("x y z w", HTML) == ("x y z w", False) and repair.correct_from_anchor("a b", HTML)[1] is False
    assert repair.clean_end("το / λό-", None) == "το/λό-"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_fuzzy():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ("".join(rng.choices("abc", k=rng.randint(0, 12))) for _ in range(2))
        assert abs(repair.Query(a).ratio(b) - (200 * lcs(a, b) / (len(a) + len(b)) if a or b else 100)) < 1e-9
    for _ in range(150):
        words = ["".join(rng.choices("abc-", k=rng.randint(1, 4))) for _ in range(rng.randint(1, 12))]
        q = "".join(rng.choices("abc", k=rng.randint(1, 9)))
        best, found, done = 0, "", False
        for k in range(max(1, len(q) // 20), len(words)):
            for i in range(len(words) - k + 1):
                x = repair.normalize("".join(words[i : i + k]))
                if abs(len(x) - len(q)) > len(q) * 0.5:
                    continue
                s = repair.Query(q).ratio(x)
                if s > best:
                    best, found = s, " ".join(words[i : i + k])
                if s > 95:
                    done = True
                    break
            if done:
                break
        assert repair.Matcher(" ".join(words)).best(q) == (found, best)


def test_segmentation(spark):
    known = repair.dictionary(["το", "τέλος", "της", "Σελίδας"])
    assert repair.segment("τοτέλοςτηςσελίδας", known, 7) == ("το τέλος της σελίδας", 1.0)
    assert repair.segment("", known, 7) == ("", 0.0)
    assert repair.segment("xyzτο", known, 7) == ("xyz το", 0.5)
    out = spark.createDataFrame([("τοκαι",), (None,)], "s string").select(rep.segment_words(F.col("s")).alias("r")).collect()
    assert out[0]["r"]["text"] == "το και" and out[1]["r"]["text"] is None


def test_extract(spark):
    pages = spark.createDataFrame([(1, 1, "One two three four five six seven. Eight nine ten eleven twelve"), (1, 2, "two words"), (2, 1, None)], "doc_id long, page int, text string")
    out = {(r["doc_id"], r["page"]): r for r in ex.extract(pages).collect()}
    assert out[1, 1]["snippet"] == "three four five six seven."
    assert out[1, 2]["note"] == "Insufficient text (found 2 words)" and out[1, 2]["snippet"] == "PASTE_TEXT_FROM_END_OF_PAGE_HERE"
    stats = ex.stats(ex.extract(pages)).first().asDict()
    assert (stats["total_pages"], stats["successful"], stats["insufficient_text"]) == (3, 1, 2)
    begin = ex.extract(pages, ex.Options(strategy="beginning_of_page", snippet_words=3)).where("doc_id = 1 AND page = 1").first()
    assert (begin["snippet"], begin["context_before"], begin["context_after"]) == ("One two three", "", "four five six seven.")
    html = spark.createDataFrame([(1, "<p>One two three four five six seven. Eight nine ten eleven twelvefold</p>")], "doc_id long, html string")
    assert ex.extract(pages, ex.Options(), html).where("doc_id = 1 AND page = 1").first()["status"] == "successful"
    fuzzy = ex.extract(pages, ex.Options(fuzzy=True), html).where("page = 1 AND doc_id = 1").first()
    assert fuzzy["method"] == "html_match" and fuzzy["confidence"] > 0.6
    damaged = pages.withColumn("note", F.when(F.col("page") == 2, "Extraction failed: broken"))
    bad = ex.extract(damaged).where("page = 2").first()
    assert (bad["snippet"], bad["note"], bad["status"], bad["context_status"]) == ("PASTE_TEXT_FROM_END_OF_PAGE_HERE", "Extraction failed: broken", "failed", None)
    assert ex.stats(ex.extract(damaged)).first()["failed"] == 1
    second = {(r["doc_id"], r["page"]): r for r in ex.extract(pages.unionByName(spark.createDataFrame([(3, 1, "a b / c d")], pages.schema)), ex.Options(second_backend=True)).collect()}
    assert second[1, 2]["note"] == "Insufficient text (found 2 words, need 3)" and second[3, 1]["snippet"] == "a b/c d"
    assert all(r["context_before"] is None and r["context_status"] is None for r in second.values())
    fuzzy = ex.extract(pages, ex.Options(fuzzy=True, default_backend=True), html).where("page = 1 AND doc_id = 1").first()
    assert fuzzy["method"] is None
    assert [r["page"] for r in ex.page_range(pages, 2, None, 5).select("page").collect()] == [7]


@pytest.mark.parametrize("bad", [{"snippet_words": 0}, {"snippet_words": -5}, {"snippet_words": 1001}, {"min_words": 0}, {"strategy": "x"}])
def test_options(bad):
    with pytest.raises(errors.InvalidParameterError):
        ex.Options(**bad)


def test_confidence_is_rounded_as_python_does(spark):
    """0.625 to 0.62, and every share of words up to 60."""
    known = ["ab"]
    for n in (8, 40, 57):
        rows = [("ab" * a + "x" * (n - a),) for a in range(n + 1)]
        out = spark.createDataFrame(rows, "s string").select("s", rep.segment_words(F.col("s"), known, 1000).alias("r")).collect()
        assert all(r["r"]["rounded"] == round(r["r"]["confidence"], 2) for r in out)
    five = spark.createDataFrame([("ababababab" + "xyzuv",)], "s string").select(rep.segment_words(F.col("s"), known).alias("r")).first()["r"]
    assert (five["confidence"], five["rounded"]) == (0.625, 0.62)


class StubPage:
    def __init__(self, text):
        self.text = text

    def get_text(self):
        if self.text is None:
            raise ValueError("broken page")
        return self.text

    extract_text = get_text


class StubBook(list):
    pages = property(lambda self: self)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        pass


@pytest.mark.parametrize(("backend", "module", "call"), [("pymupdf", "fitz", "open"), ("pdfplumber", "pdfplumber", "open")])
def test_pdf_reader_with_a_stub_library(monkeypatch, tmp_path, backend, module, call):
    """A damaged page is a row with a note; the others follow. Ranges of pages are partitions."""
    import importlib.util
    import sys
    import types

    stub = types.ModuleType(module)
    setattr(stub, call, lambda file: StubBook([StubPage("one two three"), StubPage(None), StubPage("")]))
    monkeypatch.setitem(sys.modules, module, stub)
    found = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: name == module or None if name in pdf.MODULES.values() else found(name, *a))
    (tmp_path / "a.pdf").write_text("")
    assert pdf.choose_backend() == pdf.choose_backend(backend) == backend
    reader = pdf.PdfReader({"path": str(tmp_path), "backend": backend, "pages_per_task": 2})
    parts = reader.partitions()
    assert [(p.first, p.end) for p in parts] == [(0, 2), (2, 3)]
    file = str(tmp_path / "a.pdf")
    assert [x for p in parts for x in reader.read(p)] == [(0, file, 1, "one two three", None), (0, file, 2, "", "Extraction failed: broken page"), (0, file, 3, "", None)]


def test_read_html_numbers_files(spark, tmp_path):
    for n in "cab":
        (tmp_path / f"{n}.html").write_text(f"<p>{n}</p>")
    assert [(r["doc_id"], r["html"]) for r in texts.read_html(spark, str(tmp_path)).orderBy("doc_id").collect()] == [(0, "<p>a</p>"), (1, "<p>b</p>"), (2, "<p>c</p>")]


def test_validate(spark):
    rows = [(1, 0, "1", "a b", "x", "y"), (1, 1, "2", "a b", "x", ""), (1, 2, "3", "PASTE_TEXT_FROM_END_OF_PAGE_HERE", None, None), (1, 3, "4", "not there", None, "z"), (1, 4, "5", None, None, None)]
    r = spark.createDataFrame(rows, REFS)
    h = spark.createDataFrame([(1, "<p>a <i>b</i> c</p>")], "doc_id long, html string")
    got = validate.results(r, h)
    assert (got["total_snippets"], got["unique_snippets"], got["placeholder_count"], got["duplicate_snippets"]) == (5, 3, 1, {"a b": 2})
    assert (got["context_full"], got["context_partial"], got["context_none"]) == (1, 2, 2)
    assert got["missing_from_html"] == ["4"] and got["html_match_rate"] == 0.75 and not validate.ready(got)
    empty = validate.summary(r.where("false")).first().asDict()
    assert set(empty.values()) == {0}


def test_layout(spark):
    rows = [(1, 1, 0, 10.0, 50.0, 100.0, 9.0, "left2"), (1, 1, 1, 310.0, 350.0, 20.0, 9.0, "right1"), (1, 1, 2, 10.0, 50.0, 20.0, 9.0, "left1"), (1, 1, 3, 10.0, 50.0, 100.0, 7.0, "."), (1, 1, 4, 10.0, 50.0, 700.0, 9.0, "note")]
    s = spark.createDataFrame([(*r, 600.0, 800.0) for r in rows], "doc_id long, page int, ord int, x0 double, x1 double, y1 double, size double, text string, page_width double, page_height double")
    assert layout.two_column_body(s).first()["text"] == "left1 left2. right1"
    assert layout.body_by_font(s).first()["text"] == "right1 left1 left2 note"
    assert layout.bottom_words(s.withColumnRenamed("y1", "top"), 2).first()["text"] == "left2 note"


def test_sources(spark, tmp_path):
    refs = [{"page": 3, "snippet": "τέλος"}, {"page": "iv", "snippet": "x", "context_before": ""}]
    (tmp_path / "a.json").write_text(json.dumps(refs, ensure_ascii=False), encoding="utf-8")
    r = references.load_local(spark, str(tmp_path / "a.json"))
    assert references.write_references(r, str(tmp_path / "b.json")) == 2
    assert json.loads((tmp_path / "b.json").read_text(encoding="utf-8")) == refs and "τέλος" in (tmp_path / "b.json").read_text(encoding="utf-8")
    assert [(x["ord"], x["page"]) for x in references.read_references(spark, str(tmp_path / "a.json")).orderBy("ord").collect()] == [(0, "3"), (1, "iv")]
    (tmp_path / "bad.json").write_text("[{")
    with pytest.raises(errors.PageError):
        references.load_local(spark, str(tmp_path / "bad.json"))
    with pytest.raises(errors.PageError):
        references.write_references(r, str(tmp_path / "no" / "x.json"))
    (tmp_path / "w.txt").write_text("Και\n\nτο\n", encoding="utf-8")
    assert {x["word"] for x in texts.read_dictionary(spark, str(tmp_path / "w.txt")).collect()} == {"Και", "και", "το"}
    assert [x["page"] for x in template(spark, 5, 1, True).orderBy("ord").collect()] == ["i", "ii", "iii", "iv", "v"]
    with pytest.raises(errors.SourceNotFoundError):
        pdf.read_pdf(spark, str(tmp_path / "none.pdf"))
    with pytest.raises(errors.MissingDependencyError):
        pdf.choose_backend("nothing")


def test_streaming(spark, tmp_path):
    from pagewright.streaming.validation import running_counts

    src = str(tmp_path / "in")
    spark.sql("SELECT * FROM VALUES ('a', 'x', 'y', timestamp'2024-01-01 00:01:00'), ('PASTE_TEXT_FROM_END_OF_PAGE_HERE', null, '', timestamp'2024-01-01 00:02:00'), ('b', 'x', '', timestamp'2024-01-01 00:11:00') t(snippet, context_before, context_after, arrived)").write.parquet(src)
    s = running_counts(spark.readStream.schema("snippet string, context_before string, context_after string, arrived timestamp").parquet(src))
    q = s.writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    out = spark.table("counts").orderBy("window").collect()
    assert [(r["total_snippets"], r["placeholder_count"], r["context_full"], r["context_partial"]) for r in out] == [(2, 1, 1, 0), (1, 0, 0, 1)]


def test_command_line(spark, tmp_path, capsys):
    out = tmp_path / "σελίδες.json"
    assert cli.main(["generate", "3", str(out), "--roman"]) == 0
    assert [r["page"] for r in json.loads(out.read_text(encoding="utf-8"))] == ["i", "ii", "iii"]
    book, refs = tmp_path / "book.html", tmp_path / "refs.json"
    book.write_text(BOOK, encoding="utf-8")
    refs.write_text(json.dumps([{"page": 1, "snippet": "ends right here."}]))
    assert cli.main(["mark", str(book), str(refs), "--inject-css"]) == 0
    assert "page1" in (tmp_path / "book_with_pages.html").read_text(encoding="utf-8")
    assert cli.main(["validate", str(refs), "--html", str(book)]) == 0
    assert "HTML match rate: 100.0%" in capsys.readouterr().out
    assert cli.main(["validate", str(tmp_path / "none.json")]) == 1
    assert cli.main(["extract", "x.pdf", "y.json"]) == 1
    with pytest.raises(SystemExit):
        cli.main(["--version"])


def test_entry_without_the_training_operators():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {"snippet_end", "html_mark"} <= names and set(__spark_entry__.oracle_sql()) <= names


def oracle_rows(folder, name):
    """What the query's SQL gives over the tables of a folder."""
    import duckdb

    from pagewright.plans import catalog

    con = duckdb.connect()
    for p in folder.iterdir():
        con.execute(f"CREATE VIEW {p.name.split('.')[0]} AS SELECT * FROM read_parquet('{p}/*.parquet')")
    return con.execute(catalog.oracle_sql()[name]).fetchall()


def test_bottom_words_ties_follow_the_input(spark, tmp_path):
    """Twelve lines of one order and number: those of the first file count as the first, though the second is larger and read before it."""
    from pyspark.sql import functions as F

    from pagewright.plans import catalog

    flag = "concat(file, char(CAST(109 - id AS INT)))"
    for file, n in (("a", 12), ("b", 5000)):
        rows = spark.range(n).select(F.lit(80).cast("long").alias("l_orderkey"), F.lit(0).cast("long").alias("l_partkey"), F.when(F.col("id") < 12, 1).otherwise(2).cast("long").alias("l_suppkey"), F.lit(1).alias("l_linenumber"), F.lit(3.0).alias("l_quantity"), F.lit(0.05).alias("l_tax"), F.lit(file).alias("file"), "id")
        rows.withColumn("l_returnflag", F.when(F.col("id") < 12, F.expr(flag)).otherwise(F.lit("z"))).drop("file", "id").coalesce(1).write.parquet(str(tmp_path / file))
        (tmp_path / "in/lineitem.parquet").mkdir(parents=True, exist_ok=True)
        next((tmp_path / file).glob("*.parquet")).rename(tmp_path / f"in/lineitem.parquet/part-{file}.parquet")
    got = {tuple(r) for r in catalog.bottom_words(spark, str(tmp_path / "in")).collect()}
    assert (1, 0, " ".join(f"a{chr(109 - i)}1" for i in range(10))) in got
    assert got == set(oracle_rows(tmp_path / "in", "bottom_words"))


CUT_ENTITIES = "<div><h1 title='&amp'>a &amp;&amp;&amp</h1><p>&copy b &copy; &am &quo &lt c &lt;i&gt; <b>&middot;</b> & d &quot;</p></div>"


def pages_folder(spark, tmp_path):
    spark.createDataFrame([(1, CUT_ENTITIES), (2, "<p>x &amp</p><script>a &amp b</script>")], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    return tmp_path


def test_text_nodes_with_cut_entities(spark, tmp_path):
    """The query decodes those that end in a semicolon, as its SQL does; a marked page holds what HTML makes of them."""
    from pagewright.plans import catalog

    at = pages_folder(spark, tmp_path)
    got = [tuple(r) for r in catalog.html_text_nodes(spark, str(at)).collect()]
    assert (1, 0, 0, 0, 8, "a &&&amp") in got and (2, 0, 0, 0, 6, "x &amp") in got
    assert sorted(got) == sorted(oracle_rows(at, "html_text_nodes"))
    assert html_tree.render(html_tree.parse("<p>a &amp</p>")) == "<p>a &amp;</p>"
    assert html_tree.parse("<p>&notit; &#65; &#x42; &eacute; &eacute</p>", ended=True).get_text() == "&notit; A B é &eacute"


def test_containers_with_cut_entities(spark, tmp_path):
    from pagewright.plans import catalog

    at = pages_folder(spark, tmp_path)
    got = [tuple(r) for r in catalog.html_containers(spark, str(at)).collect()]
    assert (1, 0, "h1", "a &&&amp") in got and sorted(got) == sorted(oracle_rows(at, "html_containers"))
