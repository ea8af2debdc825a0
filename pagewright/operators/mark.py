"""Placement of page markers and rendering: one sequential fold for each document, all documents in parallel.

The fold holds one tree and its references; texts of other documents never meet in a task's memory at once. Inserted
markers become text that later references see, as they do for a reader of the finished page.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from pagewright.sources import html_tree
from pagewright.sources.html_tree import Node

#: Fixed value: the style of page markers.
CSS = """
.page-number {
    display: inline-block;
    background-color: #e0e0e0;
    color: #333;
    padding: 2px 6px;
    margin: 0 4px;
    border-radius: 3px;
    font-size: 0.85em;
    font-weight: bold;
    vertical-align: middle;
}
"""
PLACED = "doc_id long, ord int, page string, snippet string, occurrence int, container_idx int, marker_pos int, status string, score double, context_status string, last_container int, last_position int"
MARKED = "doc_id long, html string, out_of_order int"


def sort_key(page: str | None, ord_: int) -> tuple:
    p = "" if page is None else str(page)
    return (int(p) if p.isdigit() else 0, p, ord_)


def plain(w: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", w.lower()) if unicodedata.category(c) != "Mn")


def jaccard(a: list[str], b: list[str]) -> float:
    if not a or not b:
        return 0.0
    x, y = {plain(w) for w in a}, {plain(w) for w in b}
    return len(x & y) / len(x | y)


def fits(text: str, start: int, length: int, before: str, after: str, n: int = 4) -> float:
    """How well the words around a place fit the expected ones: two fifths before, three fifths after, or the side that is known."""
    b = jaccard(before.split(), text[:start].split()[-n:])
    a = jaccard(after.split(), text[start + length :].split()[:n])
    return 0.4 * b + 0.6 * a if before and after else a if after else b if before else 0.0


def split_mark(snippet: str) -> tuple[str, int]:
    """Text to search, and where in it the marker goes."""
    if "|" not in snippet:
        return snippet, len(snippet)
    a, b = (x.strip() for x in snippet.split("|", 1))
    return f"{a} {b}".strip(), len(a)


class Document:
    """A tree into which markers are placed from front to back."""

    def __init__(self, html: str):
        self.root = html_tree.parse(html)
        self.containers = html_tree.containers(self.root)
        self.texts = [c.get_text() for c in self.containers]
        self.at, self.pos = -1, 0

    def _node(self, k: int, marker: int) -> tuple[Node, int] | None:
        offset = 0
        for n in html_tree.text_nodes(self.containers[k]):
            if offset < marker <= offset + len(n.text):
                return n, marker - offset
            offset += len(n.text)
        return None

    def first(self, search: str, shift: int) -> tuple | None:
        for k in range(max(0, self.at), len(self.texts)):
            start = self.texts[k].find(search)
            if start >= 0 and k == self.at and start + shift <= self.pos:
                start = self.texts[k].find(search, self.pos)
            if start >= 0 and (found := self._node(k, start + shift)):
                return (*found, k, start + shift)
        return None

    def every(self, search: str, shift: int) -> list[tuple]:
        out = []
        for k in range(max(0, self.at), len(self.texts)):
            start = self.texts[k].find(search)
            while start >= 0:
                marker = start + shift
                if (k != self.at or marker > self.pos) and (found := self._node(k, marker)):
                    out.append((*found, k, marker))
                start = self.texts[k].find(search, start + 1)
        return out

    def place(self, page: str, snippet: str, before: str, after: str, occurrence: int) -> dict:
        search, shift = split_mark(snippet)
        out = {"status": "not_found", "score": None, "context_status": None, "container_idx": None, "marker_pos": None, "last_container": self.at, "last_position": self.pos}
        if not search:
            return out
        if before or after:
            found = self.every(search, shift)
            chosen = found[0] if found else None
            if len(found) > 1:
                scores = [fits(self.texts[k], m - shift, len(search), before, after) for *_, k, m in found]
                best = max(scores)
                out["score"], used = best, best >= 0.3
                out["context_status"] = "context_used" if used else "context_fallback"
                chosen = found[scores.index(best)] if used else found[0]
        else:
            chosen = self.first(search, shift)
        if chosen is None:
            return out
        node, at, k, marker = chosen
        self._insert(node, at, page, occurrence)
        self.texts[k] = self.containers[k].get_text()
        self.at, self.pos = k, marker
        return out | {"status": "found", "container_idx": k, "marker_pos": marker}

    def _insert(self, node: Node, at: int, page: str, occurrence: int) -> None:
        left, right = node.text[:at], node.text[at:]
        mark = Node(node.parent, "span", {"id": f"page{page}" + (f"-{occurrence}" if occurrence > 1 else ""), "class": "page-number", "role": "note", "aria-label": f"Page {page}"})
        mark.children.append(Node(mark, text=page))
        new = [Node(node.parent, text=left if left.endswith(" ") else left + " "), mark]
        if right:
            new.append(Node(node.parent, text=right if right.startswith(" ") else " " + right))
        i = next(i for i, n in enumerate(node.parent.children) if n is node)
        node.parent.children[i : i + 1] = new

    def drop_out_of_order(self) -> int:
        """Markers whose number is below one before them go; what is no number stays and does not count."""
        most, gone = -1, []
        for n in self.root.walk():
            if n.tag == "span" and "page-number" in n.attrs.get("class", "").split():
                try:
                    number = int(n.get_text())
                except ValueError:
                    continue
                if number < most:
                    gone.append(n)
                most = max(most, number)
        for n in gone:
            n.parent.children = [c for c in n.parent.children if c is not n]
        return len(gone)

    def add_css(self) -> None:
        head = next((n for n in self.root.walk() if n.tag == "head"), None)
        if head is not None:
            style = Node(head, "style")
            style.children.append(Node(style, text=CSS, kind="raw"))
            head.children.append(style)


def _records(refs: pd.DataFrame, d: Document) -> list[dict]:
    rows = sorted(({k: None if v is None or isinstance(v, float) and v != v else v for k, v in r.items()} for r in refs.to_dict("records")), key=lambda r: sort_key(r["page"], r["ord"]))
    seen: dict[str, int] = {}
    out = []
    for r in rows:
        base = {"doc_id": r["doc_id"], "ord": r["ord"], "page": r["page"], "snippet": r["snippet"], "occurrence": None}
        if r["page"] is None or r["snippet"] is None:
            out.append(base | {"status": "not_found", "last_container": d.at, "last_position": d.pos})
            continue
        seen[r["page"]] = seen.get(r["page"], 0) + 1
        out.append(base | {"occurrence": seen[r["page"]]} | d.place(r["page"], r["snippet"], r.get("context_before") or "", r.get("context_after") or "", seen[r["page"]]))
    return out


def _refs(refs: DataFrame) -> DataFrame:
    """With all columns of a reference, absent ones null."""
    have = set(refs.columns)
    return refs.select("doc_id", F.col("ord").cast("int").alias("ord"), F.col("page").cast("string").alias("page"), "snippet", *((F.col(c) if c in have else F.lit(None).cast("string")).alias(c) for c in ("context_before", "context_after")))


def place(refs: DataFrame, html: DataFrame) -> DataFrame:
    """refs (doc_id, ord, page, snippet, context_before, context_after) placed in html (doc_id, html): one row a reference."""
    names = [x.split()[0] for x in PLACED.split(", ")]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = _records(left, Document(right["html"].iloc[0] if len(right) else ""))
        out = pd.DataFrame(rows, columns=names)
        return out.astype({c: object for c in ("page", "snippet", "status", "context_status")}).where(out.notna(), None).astype({c: "Int32" for c in ("ord", "occurrence", "container_idx", "marker_pos", "last_container", "last_position")} | {"score": "float64"})

    return _refs(refs).groupBy("doc_id").cogroup(html.select("doc_id", "html").groupBy("doc_id")).applyInPandas(run, PLACED)


def mark(refs: DataFrame, html: DataFrame, css: bool = False) -> DataFrame:
    """html (doc_id, html) with the markers of refs, without those out of order."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for doc, text in zip(right["doc_id"], right["html"], strict=True):
            d = Document(text or "")
            _records(left, d)
            gone = d.drop_out_of_order()
            if css:
                d.add_css()
            out.append((doc, html_tree.render(d.root), gone))
        return pd.DataFrame(out, columns=["doc_id", "html", "out_of_order"])

    return _refs(refs).groupBy("doc_id").cogroup(html.select("doc_id", "html").groupBy("doc_id")).applyInPandas(run, MARKED)


def stats(placed: DataFrame, marked: DataFrame | None = None) -> DataFrame:
    """One row of counts over all documents."""
    count = lambda c, v: F.count_if(F.coalesce(F.col(c) == v, F.lit(False))).alias(v)
    out = placed.agg(*(count("status", v) for v in ("found", "not_found")), F.lit(0).cast("long").alias("multiple_matches"), *(count("context_status", v) for v in ("context_used", "context_fallback")))
    gone = marked.agg(F.coalesce(F.sum("out_of_order"), F.lit(0)).cast("long").alias("out_of_order")) if marked is not None else placed.agg(F.lit(0).cast("long").alias("out_of_order"))
    return out.join(gone, F.lit(True)).withColumn("kept", F.col("found") - F.col("out_of_order"))


def failed(placed: DataFrame) -> DataFrame:
    """The references that no place was found for."""
    return placed.where("status = 'not_found' AND page IS NOT NULL AND snippet IS NOT NULL").select("doc_id", "ord", "page", "snippet", "last_container", "last_position")


