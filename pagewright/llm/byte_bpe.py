"""Byte-level BPE encoding and decoding with DuckDB recursive queries inside each partition.

Texts are cut into pre-tokens; the distinct ones of a step that are no token as a whole become rows (word, position,
token), one for each byte. A recursive query joins neighbours with the merge table and contracts each word's leftmost
pair of least rank, until no pair is left; a word leaves the recursion as soon as it is done, so a query holds one row for
each token that is left of the words it still works on. Pre-tokens of every length go through DuckDB. For those above
RUNS bytes, in which a pair tends to occur often, the query contracts in one step all occurrences of a word's least pair,
if no pair with the new token has a lower rank, else the leftmost one as well: the same result in fewer steps.

A worker keeps what it has encoded in two generations of CACHE pre-tokens: when the younger one is full the older one
goes, and what is asked for again moves to the younger. Decoding joins token rows with the vocabulary and puts the bytes
together by an ordered aggregation, SLICE ids at a time.

Null texts are empty and give no ids; null ids decode to nothing; null ids inside an array are skipped; repeated rows get
equal ids; an empty table gives an empty result; a very long text is a step of its own. Other columns pass through, and
the columns made here replace input columns of the same name. DuckDB works in memory and writes no files.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from pagewright.llm.arrays import joined, steps
from pagewright.llm.pretokens import cuts, distinct, strings
from pagewright.llm.tables import mapped

STEP, CACHE, WORDS, RUNS, SLICE = 2 << 20, 1 << 18, 1 << 14, 64, 1 << 18
#: Above every rank; a pair is left * WIDE + right; what is least first is rank * WIDE + position.
NONE, WIDE = 1 << 30, 1 << 32

#: t.over: 1 in the rows of words that have no pair left. merges.m: twice the rank, + 1 if the new token has a pair of lower rank.
ENCODE = f"""
WITH RECURSIVE t(word, pos, token, over) AS (
  SELECT word, pos, token, 0 FROM spelled
  UNION ALL
  (WITH best AS (
     SELECT a.word, min(x.m * {WIDE} + a.pos) AS best FROM t a JOIN t b ON b.word * {WIDE} + b.pos = a.word * {WIDE} + a.pos + 1
     JOIN merges x ON x.pair = a.token * {WIDE} + b.token WHERE a.over = 0 AND b.over = 0 GROUP BY a.word)
   SELECT t.word, t.pos - coalesce(t.pos > best % {WIDE}, false)::BIGINT, CASE WHEN t.pos = best % {WIDE} THEN best // {2 * WIDE} ELSE t.token END, CASE WHEN best IS NULL THEN 1 ELSE 0 END
   FROM t LEFT JOIN best USING (word) WHERE t.over = 0 AND (best IS NULL OR t.pos <> best % {WIDE} + 1)))
SELECT word, token FROM t WHERE over = 1 ORDER BY word, pos
"""
#: m: of the pair that a row makes with the next one; -1 in the rows of words that have no pair left.
ENCODE_RUNS = f"""
WITH RECURSIVE t(word, pos, token, m) AS (
  SELECT s.word, s.pos, s.token, coalesce(x.m, {NONE})
  FROM (SELECT *, lead(token) OVER (PARTITION BY word ORDER BY pos) AS next FROM spelled) s LEFT JOIN merges x ON x.pair = s.token * {WIDE} + s.next
  UNION ALL
  (WITH best AS (SELECT word, min(m * {WIDE} + pos) AS best FROM t WHERE m >= 0 GROUP BY word),
   numbered AS (SELECT t.*, best // {WIDE} AS r, best % {WIDE} AS first, row_number() OVER (PARTITION BY word ORDER BY pos) AS n FROM t JOIN best USING (word)),
   chosen AS (SELECT *, m = r AND r < {NONE} AND (r % 2 = 0 OR pos = first)
     AND (n - coalesce(max(CASE WHEN m <> r THEN n END) OVER (PARTITION BY word ORDER BY pos ROWS UNBOUNDED PRECEDING), 0)) % 2 = 1 AS take FROM numbered),
   behind AS (SELECT *, coalesce(lag(take) OVER (PARTITION BY word ORDER BY pos), false) AS gone FROM chosen),
   kept AS (SELECT word, pos, CASE WHEN take THEN r // 2 ELSE token END AS token, r FROM behind WHERE NOT gone),
   pairs AS (SELECT *, lead(token) OVER (PARTITION BY word ORDER BY pos) AS next FROM kept)
   SELECT k.word, k.pos, k.token, CASE WHEN k.r = {NONE} THEN -1 ELSE coalesce(x.m, {NONE}) END FROM pairs k LEFT JOIN merges x ON x.pair = k.token * {WIDE} + k.next))
SELECT word, token FROM t WHERE m = -1 ORDER BY word, pos
"""
#: The aggregation takes its rows in the order of the subquery: one thread, and string_agg keeps the order that it is given.
DECODE = "SELECT doc, string_agg(shown, '') AS shown FROM (SELECT i.doc, v.shown FROM ids i JOIN vocabulary v ON v.id = i.id ORDER BY i.pos) GROUP BY doc ORDER BY doc"


class Coder:
    """The tables of one vocabulary, in a worker."""

    def __init__(self, path: str):
        import duckdb

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        if max(ranks.values()) >= NONE // 2:
            raise ValueError(f"ranks have to be below {NONE // 2}")
        cut = ((a, b, r) for token, r in ranks.items() for i in range(1, len(token)) if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None)
        left, right, merged = np.fromiter(cut, np.dtype((np.int64, 3))).T
        early = np.concatenate([left[merged < left], right[merged < right]])
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.duck = duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})
        joined = pa.table({"pair": left * WIDE + right, "m": 2 * merged + np.isin(merged, early)})  # noqa: F841
        self.duck.execute("CREATE TABLE merges AS SELECT * FROM joined")
        # a byte is shown as a character from U+0100 on: one each, and none is special to SQL
        shown = pa.table({"id": pa.array(list(ranks.values()), pa.int64()), "shown": ["".join(chr(256 + b) for b in t) for t in ranks]})  # noqa: F841
        self.duck.execute("CREATE TABLE vocabulary AS SELECT * FROM shown")
        self.whole = {t: np.int32(r).tobytes() for t, r in ranks.items()}
        self.young: dict[bytes, bytes] = {}  # pre-tokens and their ids, four bytes each
        self.old: dict[bytes, bytes] = {}

    def _contracted(self, pieces: list[bytes], query: str) -> list[bytes]:
        size = np.array([len(p) for p in pieces])
        word = np.repeat(np.arange(len(pieces)), size)
        spelled = pa.table({"word": word, "pos": np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size), "token": self.byte[np.frombuffer(b"".join(pieces), np.uint8)]})  # noqa: F841
        done = self.duck.sql(query).fetchnumpy()
        ids = done["token"].astype(np.int32).tobytes()
        at = (4 * np.searchsorted(done["word"], np.arange(len(pieces) + 1))).tolist()
        return [ids[x:y] for x, y in zip(at, at[1:], strict=False)]

    def _keep(self, piece: bytes, ids: bytes) -> bytes:
        if len(self.young) >= CACHE:
            self.old, self.young = self.young, {}
        self.young[piece] = ids
        return ids

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each piece begin and end, and the ids."""
        whole, young, old = self.whole.get, self.young.get, self.old.get
        out = [whole(p) or young(p) or old(p) for p in pieces]
        if self.old:
            for p, ids in [(p, x) for p, x in zip(pieces, out, strict=True) if p in self.old and p not in self.young]:
                self._keep(p, ids)
        new = [i for i, x in enumerate(out) if x is None]
        for query, which in ((ENCODE, [i for i in new if len(pieces[i]) <= RUNS]), (ENCODE_RUNS, [i for i in new if len(pieces[i]) > RUNS])):
            for k in range(0, len(which), WORDS):
                part = which[k : k + WORDS]
                for i, ids in zip(part, self._contracted([pieces[i] for i in part], query), strict=True):
                    out[i] = self._keep(pieces[i], ids)
        return np.concatenate([[0], np.cumsum([len(x) // 4 for x in out], dtype=np.int64)]), np.frombuffer(b"".join(out), np.int32)

    def decode(self, at: np.ndarray, ids: np.ndarray) -> list[bytes]:
        """Bytes of each range ids[at[i]:at[i + 1]]; one that reaches into several slices is put together from its parts."""
        out: list[list[bytes]] = [[] for _ in range(len(at) - 1)]
        doc = np.repeat(np.arange(len(out)), np.diff(at))
        for k in range(0, len(ids), SLICE):
            table = pa.table({"doc": doc[k : k + SLICE], "pos": np.arange(len(doc[k : k + SLICE])), "id": ids[k : k + SLICE].astype(np.int64)})
            self.duck.register("ids", table)
            for i, shown in self.duck.execute(DECODE).fetchall():
                out[i].append((np.frombuffer(shown.encode("utf-16-le"), np.uint16) - 256).astype(np.uint8).tobytes())
            self.duck.unregister("ids")
        return [b"".join(x) for x in out]


@functools.lru_cache(1)
def coder(path: str) -> Coder:
    return Coder(path)


def gather(at: np.ndarray, flat: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The ranges flat[at[i]:at[i + 1]] for i in which, one after the other."""
    size = np.diff(at)[which]
    end = np.cumsum(size)
    return flat[np.arange(end[-1] if len(end) else 0) - np.repeat(end - size, size) + np.repeat(at[:-1][which], size)]


def bpe_encode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] | None = None, decoded: bool = False) -> DataFrame:
    """docs (or its columns ``keep``) with ids: array of the tokens of the whole text.

    decoded: also what the ids decode to, as bpe_decode() would give it, without a second pass through Python.
    """
    made = [T.StructField("ids", T.ArrayType(T.IntegerType()))] + [T.StructField("decoded", T.BinaryType())] * decoded
    kept = [f for f in docs.schema.fields if f.name not in {m.name for m in made} and (keep is None or f.name in keep)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for b in joined(batches, text, STEP):
            for t in steps(b.column(text), STEP):
                starts = cuts(t)
                pieces, which = distinct(strings(t, starts))
                at, flat = c.encode(pieces)
                ids = gather(at, flat, which)
                n = np.concatenate([[0], np.cumsum(np.diff(at)[which])])[np.searchsorted(starts, t.offsets)]
                part = b.slice(t.first, t.count)
                arrays = [pa.ListArray.from_arrays(pa.array(n.astype(np.int32)), pa.array(ids))] + ([pa.array(c.decode(n, ids), pa.binary())] if decoded else [])
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), *arrays], names=[*(f.name for f in kept), *(m.name for m in made)])

    return docs.transform(mapped, run, T.StructType(kept + made))


def bpe_decode(coded: DataFrame, path: str) -> DataFrame:
    """coded (ids, ...) with decoded: the bytes that the ids stand for."""
    kept = [f for f in coded.schema.fields if f.name != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for b in batches:
            ids = b.column("ids")
            size = np.array([len(x) if x.is_valid else 0 for x in ids], np.int64)
            i = 0
            while i < b.num_rows:
                j = max(i + 1, i + int(np.searchsorted(np.cumsum(size[i:]), STEP // 4, "right")))
                part = b.slice(i, j - i)
                flat = part.column("ids").flatten()
                if flat.null_count:
                    flat = flat.fill_null(-1)
                at = np.concatenate([[0], np.cumsum(size[i:j])])
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), pa.array(c.decode(at, flat.to_numpy()), pa.binary())], names=[*(f.name for f in kept), "decoded"])
                i = j

    return coded.transform(mapped, run, T.StructType([*kept, T.StructField("decoded", T.BinaryType())]))
