"""Token counts by a two-tier lookup on the map side.

Tier one is a compact open-addressing table of the frequent pre-tokens of up to KEY bytes: the bytes themselves, their
number and the number of tokens per slot, SLOTS slots whatever the corpus, so it can be broadcast. Bytes are compared, so
equal hashes mislead nobody. It is filled from the first ROWS rows of a few partitions (a bounded cost) and looked up for
a whole batch at once. What it misses goes to tier two, a cache of two generations in the worker, and what that misses is
encoded by the library itself. No pre-token is ever shuffled. The sample decides what is fast, never a count.

The library's special strings inside texts are one token each, as it counts them by default. Null texts are empty: no
bytes, no tokens. Repeated rows get equal counts; an empty table gives an empty result; a very long text is a step of its
own. Other columns pass through; n_bytes, n_tokens and over_limit replace input columns of these names.
"""

from __future__ import annotations

import functools
import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from pagewright.llm.arrays import Texts, combine, steps, sums
from pagewright.llm.pretokens import cuts, distinct, strings
from pagewright.llm.tables import mapped, sampled

STEP, CACHE = 1 << 20, 1 << 18
SLOTS, PROBES, KEY, ROWS, TASKS = 1 << 17, 4, 16, 125, 4


class Library:
    """The tokenizer of the library, for pre-tokens of byte-level BPE without normalizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        pre = said["pre_tokenizer"] or {}
        if said["normalizer"] or pre.get("type") != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("only byte-level BPE without a normalizer is cut into pre-tokens here")
        if any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in said["added_tokens"]):
            raise ValueError("added tokens that take in white space or whole words only aren't cut here")
        self.specials = tuple(x["content"].encode() for x in said["added_tokens"])
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.young: dict[bytes, int] = {}
        self.old: dict[bytes, int] = {}

    def _keep(self, piece: bytes, n: int) -> int:
        if len(self.young) >= CACHE:
            self.old, self.young = self.young, {}
        self.young[piece] = n
        return n

    def counts(self, pieces: list[bytes]) -> list[int]:
        """Of each of the pieces, which are distinct."""
        out = [self.young.get(p) for p in pieces]
        for i in [i for i, n in enumerate(out) if n is None and pieces[i] in self.old]:
            out[i] = self.old.get(pieces[i])
            if out[i] is not None:
                self._keep(pieces[i], out[i])
        new = [i for i, n in enumerate(out) if n is None]
        for i, e in zip(new, self.tokenizer.encode_batch_fast([pieces[i].decode() for i in new], add_special_tokens=False), strict=True):
            out[i] = self._keep(pieces[i], len(e))
        return out


@functools.lru_cache(1)
def library(path: str) -> Library:
    return Library(path)


def keys(t: Texts, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The first and the second eight bytes of each slice, its size, and its first slot."""
    a, b, size = t.first_bytes(starts, ends), t.first_bytes(starts, ends, 8), ends - starts
    return a, b, size, (combine(a, b ^ size.astype(np.uint64)) % np.uint64(SLOTS)).astype(np.int64)


def frequent(docs: DataFrame, path: str, text: str = "text") -> tuple[np.ndarray, ...]:
    """Tier one: of each slot the first and the second eight bytes, the size (0: free) and the number of tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib, found, left = library(path), Counter(), ROWS
        for b in batches:
            for t in steps(b.column("text").slice(0, left), STEP):
                pieces, which = distinct(strings(t, cuts(t, lib.specials)))
                found.update({p: n for p, n in zip(pieces, np.bincount(which, minlength=len(pieces)).tolist(), strict=True) if len(p) <= KEY})
            left -= b.num_rows
            if left <= 0:
                break
        if found:
            top = found.most_common(SLOTS // 4)
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in ([p for p, _ in top], [n for _, n in top], lib.counts([p for p, _ in top]))], names=["piece", "seen", "n"])

    seen, tokens = Counter(), {}
    for r in sampled(docs.select(F.col(text).alias("text")), run, "piece array<binary>, seen array<long>, n array<long>", TASKS):
        pieces = [bytes(p) for p in r["piece"]]
        seen.update(dict(zip(pieces, r["seen"], strict=True)))
        tokens |= dict(zip(pieces, r["n"], strict=True))
    first, second, size, n = (np.zeros(SLOTS, k) for k in (np.uint64, np.uint64, np.int64, np.int64))
    top = [p for p, _ in seen.most_common(SLOTS // 4)]
    for t in steps(pa.array(top, pa.binary()), 1 << 30, 1 << 30):
        a, b, length, slot = keys(t, t.offsets[:-1], t.offsets[1:])
        for i, p in enumerate(top):
            for at in range(slot[i], slot[i] + PROBES):
                if not size[at % SLOTS]:
                    first[at % SLOTS], second[at % SLOTS], size[at % SLOTS], n[at % SLOTS] = a[i], b[i], length[i], tokens[p]
                    break
    return first, second, size, n


def token_counts(docs: DataFrame, path: str, limit: int = 1024, text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """docs (or its columns ``keep``) with n_bytes, n_tokens and over_limit, of the whole text."""
    made = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    kept = [f for f in docs.schema.fields if f.name not in {m.name for m in made} and (keep is None or f.name in keep)]
    table = docs.sparkSession.sparkContext.broadcast(frequent(docs, path, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib, (first, second, length, known) = library(path), table.value
        for b in batches:
            for t in steps(b.column(text), STEP):
                starts = cuts(t, lib.specials)
                x, y, size, slot = keys(t, starts, np.append(starts[1:], len(t.data))[: len(starts)])
                n, missed = np.zeros(len(starts), np.int64), np.ones(len(starts), bool)
                for i in range(PROBES):
                    at = (slot + i) % SLOTS
                    hit = missed & (first[at] == x) & (second[at] == y) & (length[at] == size)
                    n[hit] = known[at[hit]]
                    missed &= ~hit
                if missed.any():
                    pieces, which = distinct(strings(t, starts).filter(pa.array(missed)))
                    n[missed] = np.array(lib.counts(pieces))[which]
                tokens = sums(n, np.searchsorted(starts, t.offsets))
                part = b.slice(t.first, t.count)
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), pa.array(np.diff(t.offsets)), pa.array(tokens), pa.array(tokens > limit)], names=[*(f.name for f in kept), *(m.name for m in made)])

    return docs.transform(mapped, run, T.StructType(kept + made))
