"""Quality rules as a short-circuit cascade.

Every rule rejects a text by numbers counted over the whole text. Some of these are results and counted for every text;
what a rule counts beyond them is its own cost. A bounded sample tells that cost, and which texts each rule rejects; the
cascade then begins with the rule that rejects most per cost, goes on with the one that rejects most per cost of what is
left, and so on. A rule's own numbers are counted only for texts that all rules before it kept. The verdict is the
conjunction of the rules, so the order changes the time and never the result.

Nulls and empty texts have no words: all counts are 0 and ``few_words`` rejects them. Rows are judged one by one, so
repeated rows get equal verdicts; a very long text is a step of its own; an empty table gives an empty result; other
columns pass through, except that the columns made here replace input columns of the same name.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from pagewright.llm.arrays import Runs, Texts, characters, mix, steps, sums, windows
from pagewright.llm.tables import mapped, sampled

SYMBOLS = np.zeros(256, np.int64)
SYMBOLS[list(b"#*$%&|<>")] = 1
RUN = 5


def n_words(t: Texts) -> np.ndarray:
    return t.n_words


def word_chars(t: Texts) -> np.ndarray:
    first = (t.data & 0xC0) != 0x80
    total = np.zeros(len(t.data) + 1, np.int64)
    np.cumsum(first, out=total[1:])
    return sums(total[t.ends] - total[t.starts], t.word_at)


def n_symbols(t: Texts) -> np.ndarray:
    return sums(SYMBOLS[t.data], t.offsets)


def lines(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all \\n-split lines, and the text of each. A text of n bytes has a line after its last \\n, empty or not."""
    breaks = np.flatnonzero(t.data == 10)
    ends = np.sort(np.concatenate([breaks, t.offsets[1:]]), kind="stable")
    doc = np.concatenate([np.searchsorted(t.offsets, breaks, "right") - 1, np.arange(t.count)])
    ends = np.concatenate([breaks, t.offsets[1:]])
    order = np.lexsort((ends, doc))
    ends, doc = ends[order], doc[order]
    starts = np.empty_like(ends)
    starts[1:] = np.where(doc[1:] == doc[:-1], ends[:-1] + 1, t.offsets[doc[1:]])
    starts[:1] = 0
    return starts, ends, doc


def worded_lines(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    t.words()
    starts, ends, doc = lines(t)
    some = np.searchsorted(t.starts, ends) > np.searchsorted(t.starts, starts)
    return starts[some], ends[some], doc[some]


def later_equals(keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """True where the same key came before within the same text."""
    h = mix(keys ^ mix(doc.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(h, kind="stable")
    out = np.zeros(len(h), bool)
    out[order[1:]] = h[order][1:] == h[order][:-1]
    return out


def n_dup_lines(t: Texts) -> np.ndarray:
    starts, ends, doc = worded_lines(t)
    return np.bincount(doc[later_equals(t.slice_hashes(starts, ends), doc)], minlength=t.count)


def n_repeat_words(t: Texts) -> np.ndarray:
    at, doc = windows(t.word_at, t.n_words, RUN)
    h = mix(Runs(t.word_hashes()).every(RUN)[at] ^ mix(doc.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    step = np.zeros(len(t.starts) + 1, np.int64)
    np.add.at(step, at[twice], 1)
    np.add.at(step, at[twice] + RUN, -1)
    return sums(np.cumsum(step)[:-1] > 0, t.word_at)


def upper(t: Texts) -> np.ndarray:
    """Of 100 ASCII letters, those in upper case."""
    up = sums((t.data >= 65) & (t.data <= 90), t.offsets)
    low = sums((t.data >= 97) & (t.data <= 122), t.offsets)
    return 100 * up // np.maximum(1, up + low)


def n_worded_lines(t: Texts) -> np.ndarray:
    return np.bincount(worded_lines(t)[2], minlength=t.count)


COUNTS: dict[str, Callable[[Texts], np.ndarray]] = {f.__name__: f for f in (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)}


@dataclass(frozen=True)
class Rule:
    """``rejects`` gets a function that counts by name and gives True for each text to reject."""

    name: str
    rejects: Callable[[Callable[[Callable], np.ndarray]], np.ndarray]


BASE = (
    Rule("few_words", lambda n: n(n_words) < 10),
    Rule("repeats", lambda n: 100 * n(n_repeat_words) > 20 * n(n_words)),
)
RULES = (
    Rule("symbols", lambda n: 100 * n(n_symbols) > 10 * n(n_words)),
    Rule("dup_lines", lambda n: 100 * n(n_dup_lines) > 30 * n(n_worded_lines)),
    Rule("long_words", lambda n: n(word_chars) > 12 * n(n_words)),
    Rule("short_words", lambda n: n(word_chars) < 2 * n(n_words)),
    Rule("shouting", lambda n: n(upper) > 30),
)


def counter(t: Texts, known: dict[str, np.ndarray] | None = None) -> Callable[[Callable], np.ndarray]:
    """Counts each number once."""
    known = {} if known is None else known

    def count(f: Callable) -> np.ndarray:
        if f.__name__ not in known:
            known[f.__name__] = np.asarray(f(t)).astype(np.int64)
        return known[f.__name__]

    return count


def some(t: Texts, which: np.ndarray) -> Texts:
    """The chosen texts alone."""
    a, b = t.offsets[:-1][which], t.offsets[1:][which]
    return Texts(0, np.concatenate([t.data[i:j] for i, j in zip(a, b, strict=True)] or [t.data[:0]]), np.concatenate([[0], np.cumsum(b - a)]))


def verdicts(t: Texts, rules: tuple[Rule, ...], alive: np.ndarray, known: dict[str, np.ndarray]) -> np.ndarray:
    """Number of the first rule that rejects each text, -1 for none; asks only about those alive. known: what is counted already.

    What a rule counts itself is counted for the texts that are left alone, copied together when much is gone.
    """
    first, left = np.full(t.count, -1), np.flatnonzero(alive)
    size = np.diff(t.offsets)
    for k, rule in enumerate(rules):
        if not len(left):
            break

        def count(f: Callable, left: np.ndarray = left) -> np.ndarray:
            if f.__name__ not in known and 4 * size[left].sum() > 3 * len(t.data):
                known[f.__name__] = np.asarray(f(t)).astype(np.int64)
            return known[f.__name__][left] if f.__name__ in known else np.asarray(f(some(t, left))).astype(np.int64)

        bad = rule.rejects(count)
        first[left[bad]] = k
        left = left[~bad]
    return first


def order(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE, text: str = "text", rows: int = 125, tasks: int = 4) -> tuple[Rule, ...]:
    """The rules by rejection per own cost of what the base and the rules before leave, on the first ``rows`` rows of ``tasks`` partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        took, hit, left = np.zeros(len(rules)), [], rows
        for b in batches:
            for t in steps(b.column("text").slice(0, left)):
                known: dict[str, np.ndarray] = {}
                t.words()
                for f in COUNTS.values():
                    counter(t, known)(f)
                bad = [np.logical_or.reduce([np.zeros(t.count, bool), *(r.rejects(counter(t, dict(known))) for r in base)])]
                for k, rule in enumerate(rules):
                    began = time.perf_counter()
                    bad.append(rule.rejects(counter(t, dict(known))))
                    took[k] += time.perf_counter() - began
                hit.append(np.stack(bad))
            left -= b.num_rows
            if left <= 0:
                break
        if hit:
            yield pa.RecordBatch.from_arrays([pa.array([took.tobytes()], pa.binary()), pa.array([np.concatenate(hit, 1).tobytes()], pa.binary())], names=["took", "hit"])

    got = sampled(docs.select(F.col(text).alias("text")), run, "took binary, hit binary", tasks)
    took = sum((np.frombuffer(r["took"]) for r in got), np.zeros(len(rules)))
    hit = np.concatenate([np.zeros((len(rules) + 1, 0), bool), *(np.frombuffer(r["hit"], bool).reshape(len(rules) + 1, -1) for r in got)], 1)
    return ranked(rules, took, hit[1:], ~hit[0])


def ranked(rules: tuple[Rule, ...], took: np.ndarray, hit: np.ndarray, alive: np.ndarray) -> tuple[Rule, ...]:
    """The rules by rejection per cost of what is still alive; then by cost."""
    out, rest, alive = [], list(range(len(rules))), alive.copy()
    while rest:
        k = min(rest, key=lambda k: (-(hit[k] & alive).sum() / max(took[k], 1e-9), took[k], k))
        out.append(rules[k])
        rest.remove(k)
        alive &= ~hit[k]
    return tuple(out)


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE, text: str = "text", reason: bool = False) -> DataFrame:
    """docs with the counts of COUNTS, base_failed and kept; with ``reason`` also the name of the rule that rejected.

    The base rules come first and use the counts that are returned anyway; ``rules`` are asked in the given order
    (see order()) about what the base keeps.
    """
    made = [T.StructField(k, T.LongType()) for k in COUNTS] + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())] + [T.StructField("rejected_by", T.StringType())] * reason
    names = {f.name for f in made}
    kept = [f for f in docs.schema.fields if f.name not in names]
    if text not in {f.name for f in kept}:
        raise ValueError(f"no column {text}, or its name is one of {sorted(names)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in steps(b.column(text)):
                t.words()
                known: dict[str, np.ndarray] = {}
                count = counter(t, known)
                for f in COUNTS.values():
                    count(f)
                fails = [r.rejects(count) for r in base]
                failed = np.logical_or.reduce([np.zeros(t.count, bool), *fails])
                first = verdicts(t, rules, ~failed, known)
                arrays = [pa.array(known[k]) for k in COUNTS] + [pa.array(failed), pa.array(~failed & (first < 0))]
                if reason:
                    said = np.array([*(r.name for r in rules), None], object)[first]
                    for r, bad in reversed(list(zip(base, fails, strict=True))):
                        said[bad] = r.name
                    arrays.append(pa.array(said, pa.string()))
                part = b.slice(t.first, t.count)
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), *arrays], names=[*(f.name for f in kept), *(f.name for f in made)])

    return docs.select(*(f.name for f in kept)).transform(mapped, run, T.StructType(kept + made))
