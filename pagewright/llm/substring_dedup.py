"""Substring dedup by relative Lempel-Ziv parsing against an indexed reference.

The reference of a document is every document with a smaller id, held as index blocks. A place in it is (doc_id, word).
Each window of ``window`` words has one anchor, the 5-word run of the least hash in it, and a phrase is the maximal stretch
of windows with one anchor: content decides where phrases are cut, so equal stretches of text are cut alike wherever they
stand. An index block holds, sorted, all phrases of the corpus with its anchors and the first place of each; every
document is parsed against every block that could hold something of it.

- A phrase that the reference has is copied from its first place: so far the factor goes on.
- A phrase whose anchor no other document has ends the factor; no window of it can be in the reference.
- The other phrases stand at factor boundaries. One copy of each is checked there window by window, in a second index, of
  their windows.

The greedy parse of a document then goes through its windows and takes, from each that the reference has, the longest
stretch that runs on both here and at its place there: a factor (start, end, doc_id, at) of ``window`` words or more. The
words under factors are the duplicate spans that are cut out. Because every window belongs to exactly one phrase, a word
goes if and only if a window over it also starts in a document with a smaller id (equality by 64-bit hashes).

Scale: about a fifth of the words become phrases; each costs 28 bytes in one shuffle. Map tasks settle repeats of a phrase
among themselves, so a passage that a third of all rows share costs a row per task. Blocks grow in number with the corpus,
not in size; up to PARTITIONS they are partitions of their own, then groups within partitions. An anchor that very many
documents have, with different words around it, would meet in one block: HOT anchors, those of a share of an evenly drawn
sample, are dealt by phrase instead and their phrases all count as boundaries. Which anchors these are changes the work,
never the result.

Nulls and empty texts have no words and nothing to remove; a very long text is a step of its own. Rows with equal ids count
as one document: none of them is "smaller", so they remove nothing from each other, and if their texts differ each keeps
its own factors. Rows without an id stay as they are and are no reference. An empty table gives an empty result. Other
columns pass through, whatever their names; columns made here replace input columns of the same name.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from pagewright.llm.arrays import Runs, Texts, steps, windows
from pagewright.llm.tables import checkpoint, fresh, mapped, parts

ANCHOR = 5
FLUSH, PARTITIONS, BLOCK_BYTES = 1 << 17, 1 << 15, 8 << 20
SAMPLE, SHARE, LEAST, HOT = 4000, 1 / 500, 8, 4096
INDEX_BITS = np.uint64(28)
LOW = (np.uint64(1) << INDEX_BITS) - np.uint64(1)
#: A phrase: its first word in the document is ``at``.
ENTRY = np.dtype([("anchor", "<u8"), ("phrase", "<u8"), ("doc", "<i8"), ("at", "<u4")])
#: A phrase that stands in the reference, at word ``place`` of ``source``; ``check`` has bits of its hash.
COPY = np.dtype([("doc", "<i8"), ("at", "<u4"), ("check", "<u4"), ("source", "<i8"), ("place", "<u4")])
CELL = [*ENTRY.names, "check", "source", "place"]


class Phrases:
    """The phrases of some texts: first and last window, anchor, text and number within it."""

    def __init__(self, t: Texts, window: int):
        if not 2 * ANCHOR <= window:
            raise ValueError(f"a window takes at least {2 * ANCHOR} words")
        t.words()
        self.runs = Runs(t.word_hashes())
        grams = self.runs.every(ANCHOR)
        at, doc = windows(t.word_at, t.n_words, window)
        span = window - ANCHOR + 1
        ranked = (grams & ~LOW) | np.arange(len(grams), dtype=np.uint64)
        width = 1
        while 2 * width <= span:
            ranked = np.minimum(ranked[: len(ranked) - width], ranked[width:])
            width *= 2
        if width < span:
            ranked = np.minimum(ranked[: len(ranked) - (span - width)], ranked[span - width :])
        anchor = (ranked[at] & LOW).astype(np.int64)
        new = np.ones(len(at), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at))[: len(first)] - 1
        self.begin, self.end, self.doc = at[first], at[last], doc[first]
        self.anchor = grams[anchor[first]]
        self.phrase = self.runs.of(self.begin, self.end + window)
        self.window, self.place = window, self.begin - t.word_at[:-1][self.doc]
        self.at = np.searchsorted(self.doc, np.arange(t.count + 1))

    @functools.cached_property
    def windows(self) -> np.ndarray:
        """Hashes of all windows, by first word."""
        return self.runs.every(self.window)

    def with_place(self, i: int, place: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of text i, the numbers of the phrases that begin at ``place`` and have the bits ``check``, and which of the given ones these are."""
        own = self.place[self.at[i] : self.at[i + 1]]
        k = np.minimum(np.searchsorted(own, place), max(0, len(own) - 1)) + self.at[i]
        ok = np.flatnonzero((self.place[k] == place) & (bits(self.phrase[k]) == check)) if len(own) else np.zeros(0, np.int64)
        return k[ok] if len(ok) else ok, ok


def bits(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(32)).astype(np.int64)


def _settle(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What an earlier document here has too, as COPY, and the other entries, in order of phrase."""
    e = e[np.lexsort((e["at"], e["doc"], e["phrase"]))]
    new = np.ones(len(e), bool)
    new[1:] = e["phrase"][1:] != e["phrase"][:-1]
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    known = np.flatnonzero(e["doc"] > e["doc"][first])
    copy = np.empty(len(known), COPY)
    copy["doc"], copy["at"], copy["check"] = e["doc"][known], e["at"][known], bits(e["phrase"][known])
    copy["source"], copy["place"] = e["doc"][first[known]], e["at"][first[known]]
    return copy, np.delete(e, known)


def hot_anchors(docs: DataFrame, rows: int, window: int) -> np.ndarray:
    """Anchors, at most HOT, of a share of SHARE of about SAMPLE documents, drawn by a hash of the id from the whole table of ``rows`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in steps(b.column("text")):
                p = Phrases(t, window)
                pairs = np.unique(np.stack([p.doc.astype(np.uint64), p.anchor]), axis=1)
                anchor, n = np.unique(pairs[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(n)], names=["anchor", "n"])

    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, rows // SAMPLE))) == 0)
    counts = some.transform(mapped, run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    top = counts.where(F.col("n") >= max(LEAST, int(SHARE * min(rows, SAMPLE)))).orderBy(F.col("n").desc(), "anchor").limit(HOT).collect()
    return np.sort(np.array([r["anchor"] for r in top], np.int64).view(np.uint64))


def _index(docs: DataFrame, window: int, blocks: int, hot: np.ndarray) -> DataFrame:
    """Rows (block, entries). Rows without anchors have what is settled already; they go along to any block."""

    def cell(block: int, x: np.ndarray) -> tuple:
        return block, *(x[c].tobytes() if c in x.dtype.names else b"" for c in CELL)

    def rows(e: np.ndarray) -> Iterator[pa.RecordBatch]:
        copies, e = _settle(e)
        key = np.where(np.isin(e["anchor"], hot), e["phrase"], e["anchor"])
        block = ((key >> np.uint64(20)) % np.uint64(blocks)).astype(np.int32)
        order = np.lexsort((e["at"], e["doc"], block))
        e, block = e[order], block[order]
        at = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(e) else np.zeros(0, int)
        cells = [cell(int(block[i]), e[i:j]) for i, j in zip(at, [*at[1:], len(e)], strict=True)]
        if len(copies):
            copies = copies[np.lexsort((copies["at"], copies["doc"]))]
            cells.append(cell(int(copies["doc"][0] % blocks), copies))
        # columns, not records, lie together: ids repeat, so they shrink to little when Spark compresses its blocks
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*cells, strict=True), (pa.int32(), *[pa.binary()] * len(CELL)), strict=True)], names=["block", *CELL])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            for t in steps(b.column("text")):
                p = Phrases(t, window)
                e = np.empty(len(p.doc), ENTRY)
                e["anchor"], e["phrase"], e["at"], e["doc"] = p.anchor, p.phrase, p.place, ids[t.first + p.doc]
                held.append(e)
                n += len(e)
                if n >= max(FLUSH, min(2 * blocks, 4 * FLUSH)):
                    yield from rows(np.concatenate(held))
                    held, n = [], 0
        if n:
            yield from rows(np.concatenate(held))

    return docs.transform(mapped, run, "block int, " + ", ".join(f"{c} binary" for c in CELL))


#: What _flags() says of a phrase, or found of a window: its first word, bits of its hash, and its place in the reference; no source: a boundary.
FLAG = "at long, check long, source long, place long"


def _flags(index: DataFrame, blocks: int, hot: np.ndarray) -> DataFrame:
    """(doc_id, at, check, source, place) of each phrase that the reference has, and of those at factor boundaries."""

    def entries(b: pa.RecordBatch, i: int, kind: np.dtype) -> np.ndarray:
        raw = {c: np.frombuffer(b.column(c)[i].as_py(), kind[c]) for c in kind.names}
        e = np.empty(len(raw["doc"]), kind)
        for c, v in raw.items():
            e[c] = v
        return e

    def out(copies: np.ndarray, boundary: bool = False) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(copies), 1 << 17):
            x = copies[i : i + (1 << 17)]
            source = [pa.array(x[c].astype(np.int64)) if not boundary else pa.nulls(len(x), pa.int64()) for c in ("source", "place")]
            yield pa.RecordBatch.from_arrays([*(pa.array(x[c].astype(np.int64)) for c in ("doc", "at", "check")), *source], names=["doc_id", "at", "check", "source", "place"])

    def parsed(e: np.ndarray) -> Iterator[pa.RecordBatch]:
        copies, e = _settle(e)
        yield from out(copies)
        e = e[np.argsort(e["anchor"], kind="stable")]
        new = np.ones(len(e), bool)
        new[1:] = e["anchor"][1:] != e["anchor"][:-1]
        heads, group = np.flatnonzero(new), np.cumsum(new) - 1
        # what is settled came from the first of its phrase, so the ones that are left tell of all
        kinds = np.maximum.reduceat(e["phrase"], heads) > np.minimum.reduceat(e["phrase"], heads)
        differ = np.maximum.reduceat(e["doc"], heads) > np.minimum.reduceat(e["doc"], heads)
        b = e[(kinds & differ)[group] | np.isin(e["anchor"], hot)]
        rest = np.empty(len(b), COPY)
        rest["doc"], rest["at"], rest["check"] = b["doc"], b["at"], bits(b["phrase"])
        yield from out(rest, boundary=True)

    def blockwise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for b in batches:
            block = b.column("block").to_numpy()
            for i in range(b.num_rows):
                if not len(b.column("anchor")[i].as_py()):
                    yield from out(entries(b, i, COPY))
                    continue
                if block[i] != now and held:
                    yield from parsed(np.concatenate(held))
                    held = []
                now = block[i]
                held.append(entries(b, i, ENTRY))
        if held:
            yield from parsed(np.concatenate(held))

    return index.repartition(min(blocks, PARTITIONS), "block").sortWithinPartitions("block").transform(mapped, blockwise, f"doc_id long, {FLAG}")


def _listed(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy("doc_id").agg(F.collect_list(F.struct("at", "check", "source", "place")).alias(name)).withColumnRenamed("doc_id", f"{name}_of")


def _fields(cell: pa.Scalar) -> list[np.ndarray] | None:
    """at, check, source, place of a row's flags; a missing source is -1 in ``place``."""
    if not cell.is_valid or not len(cell):
        return None
    x = cell.values
    return [x.field(i).fill_null(-1).to_numpy(zero_copy_only=False) for i in range(4)]


def _windows(flagged: DataFrame, window: int, doc_id: str, text: str, flags: str) -> DataFrame:
    """(hash, doc_id, at): the windows of the phrases at boundaries; at counts words of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, said = b.column(doc_id).fill_null(0).to_numpy(), b.column(flags)
            for t in steps(b.column(text)):
                given = [(i, f) for i in range(t.count) if (f := _fields(said[t.first + i])) is not None]
                if not given:
                    continue
                p = Phrases(t, window)
                n = np.unique(np.concatenate([np.zeros(0, np.int64), *(p.with_place(i, at[place < 0], check[place < 0])[0] for i, (at, check, _, place) in given)]))
                size = p.end[n] - p.begin[n] + 1
                at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(p.begin[n], size)
                doc = np.repeat(p.doc[n], size)
                yield pa.RecordBatch.from_arrays([pa.array(p.windows[at].view(np.int64)), pa.array(ids[t.first + doc]), pa.array(at - t.word_at[:-1][doc])], names=["hash", "doc_id", "at"])

    # no filter and no narrower selection here: so the texts are dealt out once for this and for the last join
    return flagged.transform(mapped, run, "hash long, doc_id long, at long")


def factors(p: Phrases, t: Texts, i: int, window: int, flags: list[np.ndarray] | None, found: list[np.ndarray] | None) -> np.ndarray:
    """The greedy parse of text i: rows (start, end, doc_id, at)."""
    if flags is None and found is None:
        return np.zeros((0, 4), np.int64)
    n = max(0, int(t.n_words[i]) - window + 1)
    source, place, there = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
    if flags is not None:
        at, check, doc, word = (x[flags[3] >= 0] for x in flags)
        k, which = p.with_place(i, at, check)
        size = p.end[k] - p.begin[k] + 1
        inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        w = np.repeat(p.place[k], size) + inner
        source[w], place[w], there[w] = np.repeat(doc[which], size), np.repeat(word[which], size) + inner, True
    if found is not None:
        at, check, doc, word = found
        ok = at < n
        ok[ok] = bits(p.windows[t.word_at[i] + at[ok]]) == check[ok]
        source[at[ok]], place[at[ok]], there[at[ok]] = doc[ok], word[ok], True
    w = np.flatnonzero(there)
    if not len(w):
        return np.zeros((0, 4), np.int64)
    on = (w[1:] == w[:-1] + 1) & (source[w[1:]] == source[w[:-1]]) & (place[w[1:]] == place[w[:-1]] + 1)
    first, last = w[np.append(True, ~on)], w[np.append(~on, True)]
    return np.stack([first, last + window, source[first], place[first]], 1)


def substring_dedup(docs: DataFrame, window: int = 13, joined: bool = False) -> DataFrame:
    """docs (doc_id, text, ...) with the duplicate spans cut out of ``text``, and n_words, n_removed, spans, factors.

    spans: (start, end) in words, what factors cover. factors: the parse, (start, end, doc_id, at). joined: the words that
    stay are joined by one space, else the text between cut spans stays as it was.
    """
    number = {"start": T.LongType(), "end": T.LongType(), "doc_id": T.LongType(), "at": T.LongType()}
    record = lambda *names: T.ArrayType(T.StructType([T.StructField(n, number[n]) for n in names]))
    made = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", record("start", "end")), T.StructField("factors", record(*number))]
    kept = [f for f in docs.schema.fields if f.name not in {m.name for m in made}]
    names = [f.name for f in kept]
    flag, hit = fresh("flags", names), fresh("found", names)
    docs = docs.select(*names)
    known = docs.select("doc_id", "text").where("doc_id IS NOT NULL")
    size = known.agg(F.count("*").alias("rows"), F.sum(F.octet_length("text").cast("long")).alias("n")).first()
    blocks = parts(size["n"] or 0, BLOCK_BYTES)
    hot = hot_anchors(known, size["rows"], window)
    flags = checkpoint(_listed(_flags(_index(known, window, blocks, hot), blocks, hot), flag))
    flagged = docs.join(flags, docs["doc_id"] == flags[f"{flag}_of"], "left").select(*names, flag)
    boundary = _windows(flagged, window, "doc_id", "text", flag)
    first = boundary.groupBy("hash").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.max("doc_id").alias("most")).where("first.doc_id < most").select("hash", "first")
    copied = boundary.join(first, "hash").where("doc_id > first.doc_id").select("doc_id", "at", F.shiftrightunsigned("hash", 32).alias("check"), F.col("first.doc_id").alias("source"), F.col("first.at").alias("place"))
    found = _listed(copied, hit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flags, found = b.column(flag), b.column(hit)
            for t in steps(b.column("text")):
                p = Phrases(t, window)
                parse = [factors(p, t, i, window, _fields(flags[t.first + i]), _fields(found[t.first + i])) for i in range(t.count)]
                texts, spans, removed = [], [], []
                raw = t.data.tobytes()
                for i in range(t.count):
                    a, z = t.word_at[i], t.word_at[i + 1]
                    step = np.zeros(z - a + 1, np.int64)
                    np.add.at(step, parse[i][:, 0], 1)
                    np.add.at(step, parse[i][:, 1], -1)
                    g = np.cumsum(step)[:-1] > 0
                    removed.append(int(g.sum()))
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], g.view(np.int8), [0]])))
                    spans.append([{"start": int(x), "end": int(y)} for x, y in edge.reshape(-1, 2)])
                    lo, hi = int(t.offsets[i]), int(t.offsets[i + 1])
                    if joined:
                        texts.append(b" ".join([raw[x:y] for x, y in zip(t.starts[a:z][~g].tolist(), t.ends[a:z][~g].tolist(), strict=True)]))
                    elif not removed[-1]:
                        texts.append(raw[lo:hi])
                    else:
                        at = [lo]
                        for x, y in edge.reshape(-1, 2):  # from the first word of the span up to the next word that stays
                            at += [int(t.starts[a + x]), int(t.starts[a + y]) if a + y < z else hi]
                        texts.append(b"".join(raw[x:y] for x, y in zip(at[::2], [*at[1::2], hi], strict=True)).rstrip(b"\t\n\v\f\r "))
                part = b.slice(t.first, t.count)
                column = lambda f: pa.array(texts, pa.binary()).cast(pa.string()) if f.name == "text" else part.column(f.name)  # noqa: B023, E731
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in parse])]).astype(np.int32)
                rows = pa.StructArray.from_arrays([pa.array(x) for x in np.ascontiguousarray(np.concatenate([np.zeros((0, 4), np.int64), *parse]).T)], names=[*number])
                yield pa.RecordBatch.from_arrays([*(column(f) for f in kept), pa.array(t.n_words), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.ListArray.from_arrays(pa.array(offsets), rows)], names=[*names, *(m.name for m in made)])

    every = flagged.join(found, flagged["doc_id"] == found[f"{hit}_of"], "left").select(*names, flag, hit)
    return every.transform(mapped, run, T.StructType(kept + made))
