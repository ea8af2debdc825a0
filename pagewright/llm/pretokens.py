"""Pre-tokens of byte-level BPE for a whole batch at once.

The pattern  's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+  gives every text a complete cover, and
where a match begins depends on the classes of a character and its neighbours alone. So the cuts of all texts come from
comparing arrays of classes instead of running a matcher over each text.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pagewright.llm.arrays import Texts

LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3
#: \s: fixed values of Unicode's White_Space.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@functools.cache
def classes() -> np.ndarray:
    """Class of each code point. Python's tables may be older than the libraries': those decide what is unassigned here."""
    kind = {"L": LETTER, "N": NUMBER}
    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    unknown = []
    for c in range(0x40000):  # no later plane has letters or numbers
        g = unicodedata.category(chr(c))
        if g == "Cn":
            unknown.append(c)
        elif g[0] in kind:
            table[c] = kind[g[0]]
    table[WHITE] = SPACE
    import regex
    from tokenizers import pre_tokenizers

    unknown = [ord(c) for c in regex.findall(r"[\p{L}\p{N}]", "".join(map(chr, unknown)))]  # its tables are newer than both

    split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    for mark, k in (("a", LETTER), ("1", NUMBER)):
        pieces = split.pre_tokenize_str("\n".join(mark + chr(c) for c in unknown))
        starts = {a for _, (a, _) in pieces}
        for i, c in enumerate(unknown):
            if 3 * i + 1 not in starts:
                table[c] = k
    return table


def cuts(t: Texts, specials: tuple[bytes, ...] = ()) -> np.ndarray:
    """Bytes at which the pre-tokens of all texts begin, in order. A special string in a text is a pre-token of its own."""
    n = len(t.data)
    if not n:
        return np.zeros(0, np.int64)
    raw = t.data.tobytes()
    at = np.flatnonzero((t.data & 0xC0) != 0x80)
    cp = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    kind = classes()[cp]
    edges, inner = [t.offsets], []
    for s in specials:
        i = raw.find(s)
        while i >= 0:
            if np.searchsorted(t.offsets, i, "right") == np.searchsorted(t.offsets, i + len(s), "left"):
                edges.append(np.array([i, i + len(s)]))
                inner.append((i, i + len(s)))
                i = raw.find(s, i + len(s))
            else:  # from one text into the next
                i = raw.find(s, i + 1)
    m = len(cp)
    edge = np.zeros(m + 1, bool)
    edge[np.searchsorted(at, np.concatenate(edges))] = True
    edge[m] = True
    space = kind == SPACE
    prev_space, prev_kind = np.empty(m, bool), np.empty(m, np.uint8)
    prev_space[0], prev_space[1:] = False, space[:-1]
    prev_kind[0], prev_kind[1:] = 255, kind[:-1]
    blank = cp == 32
    prev_blank = np.empty(m, bool)
    prev_blank[0], prev_blank[1:] = False, blank[:-1]
    next_black = np.zeros(m, bool)  # a character that is no space follows in the same text
    next_black[:-1] = ~space[1:] & ~edge[1:m]
    start = np.where(space, ~prev_space | next_black, np.where(prev_space, ~prev_blank, kind != prev_kind)) | edge[:m]
    for i in np.flatnonzero((cp[:-1] == 39) & start[:-1] & ~edge[1:m]):
        two = chr(cp[i + 1])
        size = 2 if two in "stmd" else 3 if i + 2 < m and not edge[i + 2] and two + chr(cp[i + 2]) in ("re", "ve", "ll") else 0
        if size:
            start[i + 1 : i + size] = False
            if i + size < m:
                start[i + size] = True
    out = at[start]
    for a, b in inner:
        out = out[(out <= a) | (out >= b)]
    return out


def strings(t: Texts, starts: np.ndarray) -> pa.Array:
    """The pre-tokens as an Arrow array over the same bytes."""
    offsets = np.append(starts, len(t.data)).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(t.data))])


def distinct(values: pa.Array) -> tuple[list[bytes], np.ndarray]:
    """The distinct values, and for each value its number among them."""
    d = pc.dictionary_encode(values)
    return d.dictionary.cast(pa.binary()).to_pylist(), d.indices.to_numpy()
