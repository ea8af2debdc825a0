"""HTML documents as trees, containers and text nodes.

The tree follows the lenient rules of a plain tag parser: void elements have no content, an end tag closes up to the
nearest open element of its name and is ignored without one, nothing is closed by implication, script and style are raw
text, entities in text are decoded, and a text of white space alone shrinks to a newline or a space outside pre and
textarea. Comments are not text of a container.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input keygen link menuitem meta param source track wbr basefont bgsound command frame image isindex nextid spacer".split())
#: Elements that hold page text, and those whose content never is.
CONTAINERS = frozenset("p div td th li dd dt h1 h2 h3 h4 h5 h6 blockquote aside article section".split())
HIDDEN = frozenset(("script", "style", "head"))
AMPERSAND = re.compile(r"&(?:(#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);)?")


class Node:
    """An element (tag), or with tag None a piece of text or markup. kind: text, raw, comment or markup."""

    __slots__ = ("attrs", "children", "kind", "parent", "tag", "text")

    def __init__(self, parent: Node | None, tag: str | None = None, attrs: dict | None = None, text: str = "", kind: str = "text"):
        self.parent, self.tag, self.attrs, self.text, self.kind, self.children = parent, tag, attrs or {}, text, kind, []

    def walk(self) -> Iterator[Node]:
        """All below, in document order."""
        stack = self.children[::-1]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(n.children[::-1])

    def inside(self, tags: frozenset) -> bool:
        n = self.parent
        while n is not None:
            if n.tag in tags:
                return True
            n = n.parent
        return False

    def get_text(self) -> str:
        return "".join(n.text for n in self.walk() if n.tag is None and n.kind == "text")


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.now = Node(None, "[document]")
        self.data: list[str] = []

    def flush(self) -> None:
        text = "".join(self.data)
        self.data = []
        if not text:
            return
        keep = self.now.tag in ("pre", "textarea") or self.now.inside(frozenset(("pre", "textarea")))
        if not text.strip("\t\n\f\r\v ") and not keep:
            text = "\n" if "\n" in text else " "
        self.now.children.append(Node(self.now, text=text, kind="raw" if self.now.tag in ("script", "style") else "text"))

    def handle_starttag(self, tag, attrs):
        self.flush()
        node = Node(self.now, tag, {k: "" if v is None else v for k, v in attrs})
        if "class" in node.attrs:
            node.attrs["class"] = " ".join(node.attrs["class"].split())
        self.now.children.append(node)
        if tag not in VOID:
            self.now = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.flush()
        n = self.now
        while n is not None and n.tag != tag:
            n = n.parent
        if n is not None and n.parent is not None:
            self.now = n.parent

    def handle_data(self, data):
        self.data.append(data)

    def _other(self, text: str, kind: str) -> None:
        self.flush()
        self.now.children.append(Node(self.now, text=text, kind=kind))

    def handle_comment(self, data):
        self._other(f"<!--{data}-->", "comment")

    def handle_decl(self, decl):
        self._other(f"<!DOCTYPE {decl[len('DOCTYPE ') :]}>\n" if decl[:8].upper() == "DOCTYPE " else f"<!{decl}>", "markup")

    def unknown_decl(self, data):
        self._other(f"<![{data}]>", "markup")

    def handle_pi(self, data):
        self._other(f"<?{data}>", "markup")


def parse(html: str | None, ended: bool = False) -> Node:
    """The tree. HTML also decodes some entities without their semicolon (``&amp<``); ended: only those with it, others stay as written in texts and attributes."""
    b = _Builder()
    html = html or ""
    if ended:
        html = AMPERSAND.sub(lambda m: m[0] if m[1] and (m[1][0] == "#" or f"{m[1]};" in html5) else f"&amp;{m[0][1:]}", html)
    b.feed(html)
    b.close()
    b.flush()
    return b.root


def containers(root: Node) -> list[Node]:
    """Leaf containers outside script, style and head, in document order."""
    found = [n for n in root.walk() if n.tag in CONTAINERS]
    holds = set()
    for n in found:
        p = n.parent
        while p is not None and id(p) not in holds:
            holds.add(id(p))
            p = p.parent
    return [n for n in found if id(n) not in holds and not n.inside(HIDDEN)]


def text_nodes(container: Node) -> list[Node]:
    return [n for n in container.walk() if n.tag is None and n.kind == "text" and n.parent.tag not in HIDDEN]


def _escape(t: str) -> str:
    return t.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def _attribute(k: str, v: str) -> str:
    v = _escape(v)
    if '"' not in v:
        return f'{k}="{v}"'
    return f"{k}='{v}'" if "'" not in v else f'{k}="{v.replace(chr(34), "&quot;")}"'


def render(root: Node) -> str:
    """HTML of the tree: only &, < and > are escaped."""
    out: list[str] = []
    stack: list[Node | str] = root.children[::-1]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            out.append(n)
        elif n.tag is None:
            out.append(_escape(n.text) if n.kind == "text" else n.text)
        else:
            head = " ".join([n.tag, *(_attribute(k, v) for k, v in n.attrs.items())])
            if n.tag in VOID:
                out.append(f"<{head}/>")
            else:
                out.append(f"<{head}>")
                stack.append(f"</{n.tag}>")
                stack.extend(n.children[::-1])
    return "".join(out)


def container_table(docs: DataFrame, ended: bool = False) -> DataFrame:
    """docs (doc_id, html) to (doc_id, container_idx, tag, text). ended: see parse()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, html in zip(b.column("doc_id").to_pylist(), b.column("html").to_pylist(), strict=True):
                found = containers(parse(html, ended))
                yield pa.RecordBatch.from_arrays([pa.array([doc] * len(found), pa.int64()), pa.array(range(len(found)), pa.int32()), pa.array([c.tag for c in found], pa.string()), pa.array([c.get_text() for c in found], pa.string())], names=["doc_id", "container_idx", "tag", "text"])

    return docs.select("doc_id", "html").mapInArrow(run, "doc_id long, container_idx int, tag string, text string")


def node_table(docs: DataFrame, ended: bool = False) -> DataFrame:
    """docs (doc_id, html) to (doc_id, container_idx, node_idx, start_off, end_off, text). ended: see parse()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, html in zip(b.column("doc_id").to_pylist(), b.column("html").to_pylist(), strict=True):
                rows = []
                for k, c in enumerate(containers(parse(html, ended))):
                    at = 0
                    for i, n in enumerate(text_nodes(c)):
                        rows.append((doc, k, i, at, at + len(n.text), n.text))
                        at += len(n.text)
                cells = list(zip(*rows, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cells, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()), strict=True)], names=["doc_id", "container_idx", "node_idx", "start_off", "end_off", "text"])

    return docs.select("doc_id", "html").mapInArrow(run, "doc_id long, container_idx int, node_idx int, start_off int, end_off int, text string")
