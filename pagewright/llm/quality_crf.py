"""Quality of documents by a linear-chain conditional random field over their lines.

Every line with a word gets a label, good or bad. Its features are numbers about the line itself and about the lines
before and after it; the chain adds a weight for each pair of neighbouring labels. Forward-backward gives each line its
marginal probability of being good, the length-weighted mean of which, after a logistic calibration, is the score of the
document. The weights are learned on the driver from at most ``rows`` labelled documents (see learn()); the scores cover
every whole text.

Only documents have labels, so those of lines are hidden. For the first third of the rounds each line is told by its own
features alone, with its document's label: what is rare in good documents looks bad. Then the whole chain learns, and a
line's label is what forward-backward expects of it under the present weights when every line's log-odds are moved by PRIOR
towards its document's label. So a line that looks bad among good ones is marked down, by as much as its neighbours allow.

Inputs of a score are the text alone. Null texts, empty texts and texts without a word have no lines; their share of
good text is 0. Repeated rows get equal scores. An empty table gives an empty result. Other columns pass through; score
and predicted replace input columns of these names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from pagewright.llm.arrays import Texts, steps, sums
from pagewright.llm.quality_rules import SYMBOLS, later_equals, worded_lines
from pagewright.llm.tables import give_back, mapped

OWN = ("words", "symbols", "marks", "upper", "digits", "repeats", "word_length", "dup", "stop")
#: One constant, the line's own numbers, those of its neighbours, and whether it has neighbours.
N_FEATURES = 1 + 3 * len(OWN) + 2
PRIOR = 1.0


def _count(t: Texts, which: str, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    table = np.zeros(256, np.int64)
    table[list(which.encode())] = 1
    total = np.concatenate([[0], np.cumsum(table[t.data])])
    return total[ends] - total[starts]


def line_features(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each line, its text, and its length in bytes."""
    t.words()
    starts, ends, doc = worded_lines(t)
    first, last = np.searchsorted(t.starts, starts), np.searchsorted(t.starts, ends)
    n = last - first
    size = ends - starts
    h = t.word_hashes()
    again = np.zeros(len(h), np.int64)
    again[1:] = h[1:] == h[:-1]
    again = np.concatenate([[0], np.cumsum(again)])
    inner = np.minimum(first + 1, last)
    letters = _count(t, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", starts, ends)
    own = np.stack(
        [
            np.log1p(n) / 4,
            _count(t, "#*$%&|<>", starts, ends) / n,
            _count(t, "!?", starts, ends) / n,
            _count(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", starts, ends) / np.maximum(1, letters),
            _count(t, "0123456789", starts, ends) / np.maximum(1, size),
            (again[last] - again[inner]) / n,
            np.minimum(40, (size - n) / n) / 10,
            later_equals(t.slice_hashes(starts, ends), doc).astype(float),
            np.isin(t.data[t.ends[last - 1] - 1], np.frombuffer(b".!?:;", np.uint8)).astype(float),
        ],
        1,
    ) if len(n) else np.zeros((0, len(OWN)))
    own = np.minimum(own, 4)
    same = doc[1:] == doc[:-1]
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:][same] = own[:-1][same]
    after[:-1][same] = own[1:][same]
    edges = np.zeros((len(own), 2))
    edges[1:, 0], edges[:-1, 1] = same, same
    return np.concatenate([np.ones((len(own), 1)), own, before, after, edges], 1), doc, size


def chains(doc: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """First line of each text, and how many lines it has."""
    n = np.bincount(doc, minlength=count)
    return np.cumsum(n) - n, n


def marginals(good: np.ndarray, pair: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probability that each line is good; of each text the log of the partition sum; of all, the expected pairs of labels.

    good: log-odds of each line for good. pair[a, b]: weight of label b after label a (0 bad, 1 good). All texts go
    forward and backward together, a line at a time; those with fewer lines drop out.
    """
    order = np.argsort(-n, kind="stable")
    first, size = first[order], n[order]
    alpha, beta = np.zeros((len(good), 2)), np.zeros((len(good), 2))
    unary = np.stack([np.zeros_like(good), good], 1)
    longest = int(size[0]) if len(size) else 0
    left = np.searchsorted(-size, -np.arange(longest), "left")  # texts with more than k lines
    for k in range(longest):
        at = first[: left[k]] + k
        alpha[at] = unary[at] + (0 if k == 0 else np.logaddexp(alpha[at - 1, 0, None] + pair[0], alpha[at - 1, 1, None] + pair[1]))
    for k in range(longest - 2, -1, -1):
        at = first[: left[k + 1]] + k
        x = unary[at + 1] + beta[at + 1]
        beta[at] = np.logaddexp(pair[:, 0] + x[:, :1], pair[:, 1] + x[:, 1:])
    ends = first[: np.searchsorted(-size, 0, "left")] + size[size > 0] - 1
    z = np.zeros(len(n))
    z[order[: len(ends)]] = np.logaddexp(alpha[ends, 0], alpha[ends, 1])
    per = np.repeat(z, n)
    p = np.exp(alpha[:, 1] + beta[:, 1] - per)
    inner = np.ones(len(good), bool)
    inner[first[size > 0]] = False
    at = np.flatnonzero(inner)
    pairs = np.exp(alpha[at - 1, :, None] + pair + (unary + beta)[at, None, :] - per[at, None, None]).sum(0) if len(at) else np.zeros((2, 2))
    return p, z, pairs


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    pair: np.ndarray
    slope: float
    shift: float

    def share(self, t: Texts) -> np.ndarray:
        """Length-weighted share of good text of each text."""
        x, doc, size = line_features(t)
        p, *_ = marginals(x @ self.weights, self.pair, *chains(doc, t.count))
        at = np.searchsorted(doc, np.arange(t.count + 1))
        return sums(p * size, at) / np.maximum(1, sums(size.astype(np.int64), at))

    def score(self, t: Texts) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.share(t) + self.shift)))


def fit(x: np.ndarray, first: np.ndarray, n: np.ndarray, size: np.ndarray, label: np.ndarray, rounds: int = 150, decay: float = 1e-3) -> Model:
    """Weights of the greatest penalized likelihood by Adam, then the calibration by Newton's method."""
    y = np.repeat(label, n).astype(float)
    theta = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, rounds + 1):
        good, pair = x @ theta[:-4], theta[-4:].reshape(2, 2)
        p, _, pairs = marginals(good, pair, first, n)
        alone = k <= rounds // 3
        if not alone:  # a step of expectation: the hidden labels of lines, given those of documents
            hidden, _, seen = marginals(good + PRIOR * (2 * y - 1), pair, first, n)
        else:
            hidden, seen = y, pairs
        g = np.concatenate([x.T @ (hidden - p), (seen - pairs).ravel()]) / max(1, len(y)) - decay * theta
        g[1 + len(OWN) :] *= not alone
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta + 0.1 * m / (1 - 0.9**k) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    weights, pair = theta[:-4], theta[-4:].reshape(2, 2)
    p, *_ = marginals(x @ weights, pair, first, n)
    at = np.append(first, len(y))
    share = sums(p * size, at) / np.maximum(1, sums(size, at))
    d, w = np.stack([share, np.ones_like(share)], 1), np.zeros(2)
    for _ in range(50):
        q = 1 / (1 + np.exp(-d @ w))
        w = w + np.linalg.solve((d * (q * (1 - q))[:, None]).T @ d + 1e-3 * np.eye(2), d.T @ (label - q) - 1e-3 * w)
    return Model(weights, pair, float(w[0]), float(w[1]))


def learn(docs: DataFrame, labels: DataFrame, rows: int = 3000, text: str = "text") -> Model:
    """From the labelled documents (labels: doc_id, quality) with the least hashes of doc_id, at most ``rows`` of them.

    Documents with several labels count as good if one label says so. Without labels every text scores one half.
    """
    some = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    picked = docs.sparkSession.createDataFrame(some.collect(), "doc_id long, quality int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, label = b.column("doc_id").to_pylist(), b.column("quality").to_pylist()
            for t in steps(b.column("text")):
                x, doc, size = line_features(t)
                at = np.searchsorted(doc, np.arange(t.count + 1))
                cells = [(ids[t.first + i], label[t.first + i], x[at[i] : at[i + 1]].astype(np.float32).tobytes(), size[at[i] : at[i + 1]].astype(np.int64).tobytes()) for i in range(t.count)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*cells, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["doc_id", "quality", "x", "size"])

    got = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(picked), "doc_id").select("doc_id", "quality", "text").transform(mapped, run, "doc_id long, quality int, x binary, size binary").toPandas()
    got = got.sort_values(["doc_id", "x"]).drop_duplicates("doc_id")
    if not len(got):
        return Model(np.zeros(N_FEATURES), np.zeros((2, 2)), 0.0, 0.0)
    x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(-1, N_FEATURES).astype(float)
    size = np.frombuffer(b"".join(got["size"]), np.int64)
    n = np.array([len(s) // 8 for s in got["size"]])
    model = fit(x, np.cumsum(n) - n, n, size, got["quality"].to_numpy().astype(float))
    del got, x, size
    give_back()
    return model


def classify(docs: DataFrame, model: Model, threshold: float = 0.3, text: str = "text", keep: tuple[str, ...] | None = None, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """docs (or its columns ``keep``) with score (0 to 1) and predicted (1 from ``threshold`` on), under these ``names``."""
    made = [T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())]
    kept = [f for f in docs.schema.fields if f.name not in names and (keep is None or f.name in keep)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in steps(b.column(text)):
                s = model.score(t)
                part = b.slice(t.first, t.count)
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*(f.name for f in kept), *names])

    return docs.transform(mapped, run, T.StructType(kept + made))
