"""Command line: extract, validate, mark and generate for one document, on a local session."""

from __future__ import annotations

import argparse
import json
import os
import sys
from pathlib import Path

from pagewright import __version__, report
from pagewright.errors import PageError, SourceNotFoundError


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.master(os.environ.get("PAGEWRIGHT_MASTER", "local[*]")).appName("pagewright").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def html_of(spark, path: str):
    if not os.path.exists(path):
        raise SourceNotFoundError(f"HTML file not found: {path}")
    return spark.createDataFrame([(0, Path(path).read_text(encoding="utf-8"))], "doc_id long, html string")


def generate(a) -> str:
    from pagewright.sources import template
    from pagewright.sources.references import write_references

    rows = template.template(session(), a.pages, a.start_page, a.roman)
    n = write_references(rows, a.output, numbers=False)
    return f"Generated {n} entries from page {a.start_page} on: {a.output}"


def mark_file(a) -> str:
    from pagewright.operators import mark
    from pagewright.sources.references import load_local

    spark = session()
    refs, html = load_local(spark, a.json), html_of(spark, a.html)
    out = a.output or str(Path(a.html).with_name(Path(a.html).stem + "_with_pages.html"))
    placed, marked = mark.place(refs, html).cache(), mark.mark(refs, html, a.inject_css).cache()
    Path(out).write_text(marked.first()["html"], encoding="utf-8")
    return report.marking(mark.stats(placed, marked).first().asDict(), [r.asDict() for r in mark.failed(placed).orderBy("ord").collect()]) + f"\nSaved to {out}"


def validate_file(a) -> str:
    from pagewright.operators import validate
    from pagewright.sources.references import load_local

    spark = session()
    return report.validation(validate.results(load_local(spark, a.json), html_of(spark, a.html) if a.html else None))


def extract_file(a) -> str:
    from pagewright.operators import extract as ex, layout
    from pagewright.sources import pdf
    from pagewright.sources.references import write_references

    if not a.html and not a.raw_pdf:
        raise PageError("an HTML file is needed; use --raw-pdf to do without")
    if a.fuzzy_match and not a.html:
        raise PageError("--fuzzy-match needs an HTML file")
    backend = pdf.choose_backend(a.backend) if os.path.exists(a.pdf) else None
    options = ex.Options(default_backend=backend == "pymupdf", second_backend=backend == "pdfplumber", snippet_words=a.words, strategy=a.strategy, exclude_patterns=tuple(a.exclude_pattern or ()), use_default_excludes=not a.no_default_excludes, context_words=a.context_words, fuzzy=a.fuzzy_match, segment=a.segment_words)
    if not os.path.exists(a.pdf):
        raise SourceNotFoundError(f"PDF file not found: {a.pdf}")
    spark = session()
    html = html_of(spark, a.html) if a.html and not a.raw_pdf else None
    if a.two_column:
        rows = pdf.read_pdf(spark, a.pdf, backend, "spans" if backend == "pymupdf" else "words")
        pages = layout.two_column_body(rows, "y1" if backend == "pymupdf" else "bottom", min_size=None if a.include_footnotes or backend != "pymupdf" else a.min_font_size)
    elif backend == "pymupdf" and not a.include_footnotes:
        pages = layout.body_by_font(pdf.read_pdf(spark, a.pdf, backend, "spans"), a.min_font_size)
    elif a.strategy == "bottom_visual":
        pages = layout.bottom_words(pdf.read_pdf(spark, a.pdf, backend, "words"), a.words)
    else:
        pages = pdf.read_pdf(spark, a.pdf, backend)
    every = ex.extract(pages, options, html)
    records = ex.page_range(every, a.start_page, a.end_page, a.page_offset).cache()
    said = [report.extraction(ex.stats(records).first().asDict(), a.context_words)]
    if a.review and a.segment_words:
        low, average = ex.review(records)
        said.insert(0, report.review([r.asDict() for r in low.orderBy("page").limit(11).collect()], average.first()["average_confidence"]))
    n = write_references(records, a.output)
    return "\n".join([*said, f"Saved {n} snippets to {a.output}"])


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pagewright", description="Page markers of printed editions for HTML editions.")
    p.add_argument("--version", action="version", version=f"%(prog)s {__version__}")
    sub = p.add_subparsers(dest="command", required=True)
    g = sub.add_parser("generate", help="a template of page references")
    g.add_argument("pages", type=int)
    g.add_argument("output")
    g.add_argument("--start-page", "-s", type=int, default=1)
    g.add_argument("--roman", "-r", action="store_true")
    g.set_defaults(run=generate)
    m = sub.add_parser("mark", help="place page markers in an HTML file")
    m.add_argument("html")
    m.add_argument("json")
    m.add_argument("output", nargs="?")
    m.add_argument("--inject-css", action="store_true")
    m.add_argument("--verbose", action="store_true")
    m.set_defaults(run=mark_file)
    v = sub.add_parser("validate", help="check snippets")
    v.add_argument("json")
    v.add_argument("--html")
    v.add_argument("--show-duplicates", "-d", action="store_true")
    v.set_defaults(run=validate_file)
    e = sub.add_parser("extract", help="snippets of the pages of a PDF file")
    e.add_argument("pdf")
    e.add_argument("output")
    e.add_argument("html", nargs="?")
    for flag in ("--raw-pdf", "--fuzzy-match", "--segment-words", "--review", "--no-default-excludes", "--include-footnotes", "--two-column"):
        e.add_argument(flag, action="store_true")
    e.add_argument("--words", "-w", type=int, default=10)
    e.add_argument("--strategy", "-s", choices=("end_of_page", "beginning_of_page", "bottom_visual"), default="end_of_page")
    e.add_argument("--backend", "-b", choices=("auto", "pymupdf", "pdfplumber"), default="auto")
    e.add_argument("--start-page", type=int, default=1)
    e.add_argument("--end-page", type=int)
    e.add_argument("--page-offset", type=int, default=0)
    e.add_argument("--language", "-l", choices=("el",), default="el")
    e.add_argument("--exclude-pattern", "-x", action="append")
    e.add_argument("--min-font-size", type=float, default=8.5)
    e.add_argument("--context-words", type=int, default=4)
    e.set_defaults(run=extract_file)
    return p


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    try:
        print(a.run(a))
    except (PageError, json.JSONDecodeError, OSError) as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
