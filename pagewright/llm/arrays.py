"""Whole batches of texts as numpy arrays: words, hashes of words and of runs of words.

Everything here works on one Arrow batch at a time and in steps of about STEP bytes of text, so memory follows the
step (or the longest single text), never the partition. A word is a maximal run of bytes outside 0x09-0x0D and 0x20,
which in UTF-8 is the same as ``[^\\x20\\x09-\\x0D]+`` over code points.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

STEP = 256 << 10
U64 = np.uint64
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
BLOCK = 512
#: Masks of the first 0 to 8 bytes of a little-endian number.
FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def mix(h: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: spreads every input bit over all output bits."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of each pair; the order counts. No sum of parts: every part goes through mix() before the next one meets it."""
    return mix(mix(a + U64(0x9E3779B97F4A7C15)) + b)


def chained(take: Callable[[np.ndarray, int], np.ndarray], count: np.ndarray) -> np.ndarray:
    """A hash of each sequence of ``count`` numbers; take(which, k) gives the k-th number of some of them."""
    h = mix(count.astype(U64) * U64(0xA24BAED4963EE407) + U64(0x8CB92BA72F3D8DD7))
    live, k = np.flatnonzero(count > 0), 0
    while len(live):
        h[live] = combine(h[live], take(live, k))
        k += 1
        live = live[count[live] > k]
    return h


def in_blocks(hashes: Callable[[np.ndarray, np.ndarray], np.ndarray], starts: np.ndarray, ends: np.ndarray, block: int) -> np.ndarray:
    """Hashes of ranges; one longer than ``block`` is the sequence of the hashes of its blocks, so no range takes more than that many steps."""
    long = np.flatnonzero(ends - starts > block)
    if not len(long):
        return hashes(starts, ends)
    n = -(-(ends[long] - starts[long]) // block)
    first = np.cumsum(n) - n
    a = (np.arange(n.sum()) - np.repeat(first, n)) * block + np.repeat(starts[long], n)
    parts = hashes(a, np.minimum(a + block, np.repeat(ends[long], n)))
    out, short = np.empty(len(starts), U64), ends - starts <= block
    out[short] = hashes(starts[short], ends[short])
    out[long] = mix(Runs(parts).of(first, first + n) ^ U64(0xE7037ED1A0B428DB))
    return out


class Texts:
    """Some consecutive texts of a batch: their bytes, words and word hashes."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.data, self.offsets, self.count = first, data, offsets, len(offsets) - 1
        self._lanes = self._words = None

    def words(self) -> None:
        """Sets starts, ends (bytes), word_at (first word of each text, and the number of words), doc (text of each word)."""
        if "starts" in self.__dict__:
            return
        n = len(self.data)
        inside = np.zeros(n + 2, bool)
        np.logical_not(BLANK[self.data], out=inside[1 : n + 1])
        starts, ends = inside[1:] & ~inside[:-1], ~inside[1:] & inside[:-1]
        cut = self.offsets[1:-1]  # a text ends the word before it
        cut = cut[(cut > 0) & (cut < n)]
        cut = cut[inside[cut] & inside[cut + 1]]
        starts[cut] = ends[cut] = True
        self.starts, self.ends = np.flatnonzero(starts), np.flatnonzero(ends)
        self.word_at = np.searchsorted(self.starts, self.offsets)
        self.n_words = np.diff(self.word_at)
        self.doc = np.repeat(np.arange(self.count), self.n_words)

    def slice_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each slice of bytes: its length, and its bytes eight at a time."""
        if self._lanes is None:
            padded = np.zeros(len(self.data) + 8, np.uint8)
            padded[: len(self.data)] = self.data
            self._lanes = np.ndarray((len(self.data) + 1,), "<u8", buffer=padded, strides=(1,))

        def of(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
            size = ends - starts
            return mix(chained(lambda i, k: self._lanes[starts[i] + 8 * k] & FIRST[np.minimum(size[i] - 8 * k, 8)], (size + 7) >> 3) + size.astype(U64))

        return in_blocks(of, starts, ends, 8 * BLOCK)

    def first_bytes(self, starts: np.ndarray, ends: np.ndarray, skip: int = 0) -> np.ndarray:
        """Up to eight bytes of each slice from ``skip`` on, as a number; 0 stands for what is not there."""
        self.slice_hashes(starts[:0], ends[:0])
        return self._lanes[np.minimum(starts + skip, len(self.data))] & FIRST[np.clip(ends - starts - skip, 0, 8)]

    def word_hashes(self) -> np.ndarray:
        if self._words is None:
            self.words()
            self._words = self.slice_hashes(self.starts, self.ends)
        return self._words

    def texts(self) -> list[bytes]:
        raw = self.data.tobytes()
        return [raw[a:b] for a, b in zip(self.offsets[:-1], self.offsets[1:], strict=True)]


class Runs:
    """Hashes of runs of consecutive words, from the hashes of the words."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return in_blocks(lambda a, b: chained(lambda i, k: self.words[a[i] + k], b - a), starts, ends, BLOCK)

    def every(self, size: int) -> np.ndarray:
        """Of the run of ``size`` words from each word on, as far as there are so many; of halves of halves, the last two overlapping."""
        h, width = self.words, 1
        while 2 * width <= size:
            h = combine(h[: max(0, len(h) - width)], h[width:])
            width *= 2
        if width < size:
            h = combine(h[: max(0, len(h) - (size - width))], h[size - width :])
        return h


def windows(word_at: np.ndarray, n_words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of all runs of ``size`` words within one text, and the text of each."""
    n = np.maximum(n_words - size + 1, 0)
    doc = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + word_at[:-1][doc], doc


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def steps(column: pa.Array, step: int = STEP, most: int = 4096) -> Iterator[Texts]:
    """The texts of a column in order, about ``step`` bytes and at most ``most`` texts at a time; a longer text comes alone."""
    data, at = buffers(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, min(i + most, int(np.searchsorted(at, at[i] + step, "right")) - 1))
        yield Texts(i, data[at[i] : at[j]], at[i : j + 1] - at[i])
        i = j


def joined(batches: Iterator[pa.RecordBatch], column: str, size: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes of a column or more, as far as there are so many."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += len(buffers(b.column(column))[0])
        if n >= size:
            yield pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of values[at[i]:at[i + 1]] for each i; empty ranges give 0."""
    total = np.zeros(len(values) + 1, np.int64 if values.dtype != np.float64 else np.float64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def characters(t: Texts) -> np.ndarray:
    """Code points of each text."""
    return sums((t.data & 0xC0) != 0x80, t.offsets)


def shingles(t: Texts, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words, and the text of each; a text with fewer words, but some, is one run."""
    t.words()
    runs = Runs(t.word_hashes())
    at, doc = windows(t.word_at, t.n_words, size)
    short = np.flatnonzero((t.n_words > 0) & (t.n_words < size))
    return np.concatenate([runs.every(size)[at], runs.of(t.word_at[:-1][short], t.word_at[1:][short])]), np.concatenate([doc, short])
