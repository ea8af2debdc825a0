"""PDF files as a Spark data source: one partition for each range of pages, so a long book is read by many tasks.

The libraries that parse PDF are optional; none is imported until a scan asks for it. Format name: ``pages``, options
path, backend (auto, pymupdf, pdfplumber), table (text, spans, words), pages_per_task.
"""

from __future__ import annotations

import glob
import importlib.util
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pagewright.errors import MissingDependencyError, SourceNotFoundError

MODULES = {"pymupdf": "fitz", "pdfplumber": "pdfplumber"}
SCHEMAS = {
    "text": "doc_id long, file string, page int, text string, note string",
    "spans": "doc_id long, file string, page int, ord int, x0 double, y0 double, x1 double, y1 double, size double, text string, page_width double, page_height double",
    "words": "doc_id long, file string, page int, ord int, x0 double, x1 double, top double, bottom double, text string, page_width double, page_height double",
}


def choose_backend(backend: str = "auto") -> str:
    """The backend to use: of several installed the first."""
    have = [b for b, m in MODULES.items() if importlib.util.find_spec(m)]
    if backend == "auto":
        if not have:
            raise MissingDependencyError("No PDF library is installed: install pymupdf or pdfplumber")
        return have[0]
    if backend not in MODULES:
        raise MissingDependencyError(f"Unknown PDF backend: {backend}")
    if backend not in have:
        raise MissingDependencyError(f"{backend} is not installed")
    return backend


class Pages(InputPartition):
    def __init__(self, doc: int, file: str, first: int, end: int):
        super().__init__((doc, file, first, end))
        self.doc, self.file, self.first, self.end = doc, file, first, end


class PdfReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.table = options["path"], options.get("table", "text")
        self.backend, self.step = choose_backend(options.get("backend", "auto")), int(options.get("pages_per_task", 64))

    def _open(self, file: str):
        if self.backend == "pymupdf":
            import fitz

            return fitz.open(file)
        import pdfplumber

        return pdfplumber.open(file)

    def partitions(self) -> list[Pages]:
        files = sorted(glob.glob(os.path.join(self.path, "*.pdf"))) if os.path.isdir(self.path) else sorted(glob.glob(self.path))
        if not files:
            raise SourceNotFoundError(f"PDF file not found: {self.path}")
        out = []
        for doc, f in enumerate(files):
            with self._open(f) as book:
                n = len(book) if self.backend == "pymupdf" else len(book.pages)
            out += [Pages(doc, f, i, min(n, i + self.step)) for i in range(0, n, self.step)]
        return out

    def read(self, p: Pages) -> Iterator[tuple]:
        with self._open(p.file) as book:
            for i in range(p.first, p.end):
                page = book[i] if self.backend == "pymupdf" else book.pages[i]
                yield from getattr(self, f"_{self.backend}")((p.doc, p.file, i + 1), page)

    def _text(self, get) -> tuple[str, str | None]:
        """Text and note: one damaged page gives a row of its own and the scan goes on."""
        try:
            return get() or "", None
        except Exception as e:
            return "", f"Extraction failed: {e}"

    def _pymupdf(self, head: tuple, page) -> Iterator[tuple]:
        if self.table == "text":
            yield (*head, *self._text(page.get_text))
            return
        spans = [s for b in page.get_text("dict")["blocks"] for line in b.get("lines", ()) for s in line["spans"]]
        for k, s in enumerate(spans):
            x0, y0, x1, y1 = map(float, s["bbox"])
            size = (float(page.rect.width), float(page.rect.height))
            yield (*head, k, x0, y0, x1, y1, float(s["size"]), s["text"], *size) if self.table == "spans" else (*head, k, x0, x1, y0, y1, s["text"], *size)

    def _pdfplumber(self, head: tuple, page) -> Iterator[tuple]:
        if self.table == "text":
            yield (*head, *self._text(page.extract_text))
            return
        if self.table == "spans":
            raise MissingDependencyError("spans with font sizes need pymupdf")
        for k, w in enumerate(page.extract_words()):
            yield (*head, k, *(float(w[c]) for c in ("x0", "x1", "top", "bottom")), w["text"], float(page.width), float(page.height))


class PdfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "text")]

    def reader(self, schema) -> PdfReader:
        return PdfReader(self.options)


def read_pdf(spark: SparkSession, path: str, backend: str = "auto", table: str = "text", pages_per_task: int = 64) -> DataFrame:
    if not os.path.exists(path) and not glob.glob(path):
        raise SourceNotFoundError(f"PDF file not found: {path}")
    chosen = choose_backend(backend)
    spark.dataSource.register(PdfSource)
    return spark.read.format("pages").option("path", path).option("backend", chosen).option("table", table).option("pages_per_task", pages_per_task).load()
