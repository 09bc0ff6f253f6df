"""Quality classifier: a generalised additive model with pairwise interactions.

Features of a text (ratios of characters, words and lines) are cut into bins.
Boosting cycles over the features: in each round a shallow tree of one feature is
fitted to what is not yet explained, and its leaves are added to that feature's
lookup table. The pairs of features that explain most of the rest then get
tables of two dimensions, filled in the same cycles by trees that cut both. A
score is the sum of one entry of each table, passed through the logistic
function; whole batches are scored by adding table entries.

The model is fitted on the driver on a sample of at most ``SAMPLE`` labelled
texts, those with the least hash of their id (a documented bound); every text is
scored whole, in Arrow batches without a shuffle.

Defined results: null and empty texts get a score from their zero features;
labels that are null are not learned from; if no labelled text is left to learn
from, or only one label, all scores are the share of label 1 (0.5 without any);
repeated rows and equal texts (ties) get equal scores, also where ids are null;
texts of any length are measured whole; other columns, of whatever name, are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinspark.llm.common import small_batches

SAMPLE = 6000
BINS = 32
PAIR_BINS = 8
ROUNDS = 120
PAIR_ROUNDS = 40
PAIRS = 6
RATE = 0.15
FEATURES = ("words", "word_length", "symbols", "bangs", "upper", "digits", "letters", "other_bytes", "distinct_words", "top_word", "repeated_next", "lines", "dup_lines", "line_length", "bars", "punctuation", "title_words", "stop_like")

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_CLASSES = {"symbols": b"#*$%&|<>", "bangs": b"!", "upper": bytes(range(65, 91)), "digits": b"0123456789", "letters": bytes([*range(65, 91), *range(97, 123)]), "bars": b"|", "punctuation": b".,;:?"}


def features(text: str | None) -> list[float]:
    text = text or ""
    data = np.frombuffer(text.encode(), np.uint8)
    freq = np.bincount(data, minlength=256)
    size = max(1, len(data))
    share = {k: float(freq[list(v)].sum()) / size for k, v in _CLASSES.items()}
    words = _WORD.findall(text)
    n = max(1, len(words))
    count = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    return [
        float(np.log1p(len(words))), sum(map(len, words)) / n, share["symbols"], share["bangs"], share["upper"], share["digits"], share["letters"],
        float(freq[128:].sum()) / size, len(count) / n, max(count.values(), default=0) / n, sum(map(str.__eq__, words, words[1:])) / n,
        float(np.log1p(len(lines))), 1 - len(set(lines)) / max(1, len(lines)), len(words) / max(1, len(lines)), share["bars"], share["punctuation"],
        sum(map(str.istitle, words)) / n, sum(c for w, c in count.items() if len(w) <= 3) / n,
    ]


def _bins(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(cuts)], 1)


def _leaves(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """A tree of one feature over bins with gradient and curvature sums: the value of every bin."""
    out = np.zeros(len(g))

    def grow(lo: int, hi: int, depth: int) -> None:
        best, at = 1e-9, None
        if depth and hi - lo > 1:
            cg, ch = np.cumsum(g[lo:hi]), np.cumsum(h[lo:hi])
            score = cg[:-1] ** 2 / (ch[:-1] + 1) + (cg[-1] - cg[:-1]) ** 2 / (ch[-1] - ch[:-1] + 1) - cg[-1] ** 2 / (ch[-1] + 1)
            score[(ch[:-1] < 1) | (ch[-1] - ch[:-1] < 1)] = 0
            if score.max() > best:
                at = lo + 1 + int(score.argmax())
        if at is None:
            out[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + 1)
        else:
            grow(lo, at, depth - 1)
            grow(at, hi, depth - 1)

    grow(0, len(g), depth)
    return out


def _pair_leaves(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """The best tree that cuts both features once each (four leaves): its values, and what it gains."""
    cg, ch = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    a, b = np.meshgrid(np.arange(1, g.shape[0]), np.arange(1, g.shape[1]), indexing="ij")

    def parts(c: np.ndarray) -> list[np.ndarray]:
        top, left, whole = c[a, -1], c[-1, b], c[-1, -1]
        return [c[a, b], top - c[a, b], left - c[a, b], whole - top - left + c[a, b]]

    value = [x / (y + 1) for x, y in zip(parts(cg), parts(ch))]
    gain = sum(x * v for x, v in zip(parts(cg), value))
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    out = np.empty(g.shape)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = (v[i, j] for v in value)
    return out, float(gain[i, j])


class Model:
    def __init__(self, x: np.ndarray, y: np.ndarray):
        p = y.mean() if len(y) else 0.5
        self.base = float(np.log(p / (1 - p))) if len(y) and 0 < p < 1 else None
        self.share = float(p)
        if self.base is None:
            return
        n = x.shape[1]
        quantiles = lambda k, v: np.unique(np.quantile(v, np.linspace(0, 1, k + 1)[1:-1]))
        self.cuts = [quantiles(BINS, x[:, k]) for k in range(n)]
        self.pair_cuts = [quantiles(PAIR_BINS, x[:, k]) for k in range(n)]
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        b, pb = _bins(x, self.cuts), _bins(x, self.pair_cuts)
        z = np.full(len(y), self.base)

        def slopes() -> tuple[np.ndarray, np.ndarray]:
            q = 1 / (1 + np.exp(-z))
            return y - q, q * (1 - q)

        for _ in range(ROUNDS):
            for k in range(n):
                g, h = slopes()
                add = RATE * _leaves(np.bincount(b[:, k], g, len(self.tables[k])), np.bincount(b[:, k], h, len(self.tables[k])), 2)
                self.tables[k] += add
                z += add[b[:, k]]

        def sums(i: int, j: int) -> list[np.ndarray]:
            shape = len(self.pair_cuts[i]) + 1, len(self.pair_cuts[j]) + 1
            flat = pb[:, i] * shape[1] + pb[:, j]
            return [np.bincount(flat, s, shape[0] * shape[1]).reshape(shape) for s in slopes()]

        both = [(i, j) for i in range(n) for j in range(i) if len(self.pair_cuts[i]) and len(self.pair_cuts[j])]
        self.pairs = sorted(both, key=lambda p: -_pair_leaves(*sums(*p))[1])[:PAIRS]
        self.pair_tables = [np.zeros((len(self.pair_cuts[i]) + 1, len(self.pair_cuts[j]) + 1)) for i, j in self.pairs]
        for _ in range(PAIR_ROUNDS):
            for (i, j), table in zip(self.pairs, self.pair_tables):
                add = RATE * _pair_leaves(*sums(i, j))[0]
                table += add
                z += add[pb[:, i], pb[:, j]]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.base is None:
            return np.full(len(x), self.share)
        b, pb = _bins(x, self.cuts), _bins(x, self.pair_cuts)
        z = np.full(len(x), self.base)
        for k, t in enumerate(self.tables):
            z += t[b[:, k]]
        for (i, j), t in zip(self.pairs, self.pair_tables):
            z += t[pb[:, i], pb[:, j]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, label: str, learn, sample: int = SAMPLE) -> Model:
    """From the texts of labelled rows for which learn(doc_id) holds."""
    small_batches(docs.sparkSession)
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("y").isNotNull() & learn(F.col("doc_id")))
    known = known.distinct().orderBy(F.xxhash64(F.col("doc_id"), F.lit("quality")), "doc_id", "y").limit(sample)
    found = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # of at most ``sample`` rows
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([features(t.as_py()) for t in b.column(1)], pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    rows = found.select("doc_id", "text", "y").mapInArrow(work, f"doc_id {kind}, y int, x array<double>")
    # Rows of one id are learned from once each, but no more than ``sample`` in all.
    rows = rows.distinct().orderBy(F.xxhash64(F.col("doc_id"), F.lit("quality")), "doc_id", "y", "x").limit(sample).toPandas()
    x = np.array(rows["x"].tolist(), float).reshape(-1, len(FEATURES))
    return Model(x, rows["y"].to_numpy(float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t.as_py()) for t in b.column(1)], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sent.value.score(x))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
