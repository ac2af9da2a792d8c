"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature is cut into quantile bins. Boosting goes round the features in
turn; each step fits a shallow tree to the current gradients over one feature's
bins and adds its leaves to that feature's lookup table. The pairs of features
whose trees lower the loss of what is left most get tables over coarse grids,
grown the same way by trees of depth two. A score is a sum of table cells, so a
batch of documents is scored by vectorised additions.

Inputs are statistics of the whole text alone. Defined cases: a null text is an
empty one, whose features are all zero, and gets a score like any other; null
ids and repeated rows get a row each, and a null id counts as held out; labels
that are missing, or of one class only, give the constant prior; an empty table
gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from ._common import held_out, labelled, table

#: Labelled documents that a model is fitted on, at most (about).
TRAIN_DOCS = 20_000
FEATURES = ("length", "words", "word_length", "upper", "digits", "symbols", "marks", "blanks", "breaks", "bytes_high", "distinct_words", "distinct_triples", "repeated_lines", "marked_words", "caps_words", "lone_symbols")
_SYMBOLS = np.frombuffer(b"#$%&*|@^~<>{}[]\\=+_/", np.uint8)
_MARKS = np.frombuffer(b"!?.,;:", np.uint8)


def features(text: str | None) -> list[float]:
    data = (text or "").encode("utf-8")
    n = len(data)
    if not n:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words, lines = data.split(), data.split(b"\n")
    w = len(words) or 1
    letters = int(counts[65:91].sum() + counts[97:123].sum() + counts[128:].sum()) or 1
    triples = len(set(zip(words, words[1:], words[2:], strict=False))) / max(1, len(words) - 2)
    distinct = set(words)
    marked = sum(1 for x in words if x[-1] in b"!#$%&*") / w
    caps = sum(1 for x in words if x.isupper()) / w
    lone = sum(1 for x in words if len(x) == 1 and not x.isalnum()) / w
    return [
        float(np.log1p(n)), float(np.log1p(len(words))), (n - len(words)) / w, counts[65:91].sum() / letters,
        counts[48:58].sum() / n, counts[_SYMBOLS].sum() / n, counts[_MARKS].sum() / n, (counts[32] + counts[9:14].sum()) / n, counts[10] / n,
        counts[128:].sum() / n, len(distinct) / w, triples, 1 - len(set(lines)) / len(lines), marked, caps, lone,
    ]


@dataclass
class Gam:
    edges: list[np.ndarray]
    intercept: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    grids: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)  # a feature's bins to those of its grids

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        z = np.full(len(x), self.intercept)
        for f, t in enumerate(self.tables):
            z += t[b[:, f]]
        for (f, g), t in zip(self.pairs, self.grids, strict=True):
            z += t[self.coarse[f][b[:, f]], self.coarse[g][b[:, g]]]
        return 1 / (1 + np.exp(-z))


def _cut(g: np.ndarray, h: np.ndarray, penalty: float) -> tuple[float, int]:
    """(gain, bins on the left) of the best cut of gradients along one axis."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + penalty) + gr**2 / (hr + penalty) - g.sum() ** 2 / (h.sum() + penalty)
    gain[(hl < 1) | (hr < 1)] = 0
    at = int(np.argmax(gain))
    return float(gain[at]), at + 1 if gain[at] > 0 else 0


def _shallow(g: np.ndarray, h: np.ndarray, leaves: int, penalty: float) -> np.ndarray:
    """Leaf values per bin of the best-first tree with so many leaves."""
    spans = [(0, len(g))]
    while len(spans) < leaves:
        found = [(*_cut(g[a:b], h[a:b], penalty), a, b) for a, b in spans]
        gain, left, a, b = max(found)
        if gain <= 1e-9:
            break
        spans.remove((a, b))
        spans += [(a, a + left), (a + left, b)]
    out = np.zeros(len(g))
    for a, b in spans:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + penalty)
    return out


def _grid_tree(g: np.ndarray, h: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    """(gain, leaf values per cell) of the better of the two trees of depth two."""
    best = (0.0, np.zeros_like(g))
    for axis in (0, 1):
        a, b = (g, h) if axis == 0 else (g.T, h.T)
        first, left = _cut(a.sum(axis=1), b.sum(axis=1), penalty)
        if not left:
            left = a.shape[0] // 2
        total, out = first, np.zeros_like(a)
        for rows in (slice(0, left), slice(left, None)):
            gs, hs = a[rows].sum(axis=0), b[rows].sum(axis=0)
            gain, at = _cut(gs, hs, penalty)
            total += gain
            for cols in (slice(0, at), slice(at, None)):
                out[rows, cols] = gs[cols].sum() / (hs[cols].sum() + penalty)
        if total > best[0]:
            best = total, out if axis == 0 else out.T
    return best


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.1, bins: int = 64, grid: int = 12, pairs: int = 8, leaves: int = 3, penalty: float = 1.0) -> Gam:
    """x: rows of features; y: 0 or 1. The result doesn't depend on row order."""
    count, width = len(y), len(FEATURES)
    prior = (y.sum() + 0.5) / (count + 1)
    intercept = float(np.log(prior / (1 - prior)))
    if not count or y.min() == y.max():
        return Gam([np.zeros(0)] * width, intercept, [np.zeros(1)] * width)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    model = Gam(edges, intercept, [np.zeros(len(e) + 1) for e in edges])
    b = model.bins(x)
    z = np.full(count, intercept)
    for _ in range(rounds):
        for f, t in enumerate(model.tables):
            p = 1 / (1 + np.exp(-z))
            g, h = (np.bincount(b[:, f], weights=v, minlength=len(t)) for v in (y - p, p * (1 - p)))
            step = rate * _shallow(g, h, leaves, penalty)
            t += step
            z += step[b[:, f]]
    model.coarse = [np.arange(len(t)) * min(grid, len(t)) // len(t) for t in model.tables]
    c = np.stack([model.coarse[f][b[:, f]] for f in range(width)], axis=1)
    sizes = [int(m[-1]) + 1 for m in model.coarse]

    def cells(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        at = c[:, i] * sizes[j] + c[:, j]
        g, h = (np.bincount(at, weights=v, minlength=sizes[i] * sizes[j]).reshape(sizes[i], sizes[j]) for v in (y - p, p * (1 - p)))
        return at, g, h

    gains = sorted(((_grid_tree(*cells(i, j)[1:], penalty)[0], i, j) for i, j in combinations(range(width), 2)), reverse=True)
    model.pairs = [(i, j) for gain, i, j in gains[:pairs] if gain > 0]
    model.grids = [np.zeros((sizes[i], sizes[j])) for i, j in model.pairs]
    for _ in range(rounds // 3):
        for (i, j), t in zip(model.pairs, model.grids, strict=True):
            at, g, h = cells(i, j)
            step = rate * _grid_tree(g, h, penalty)[1]
            t += step
            z += step.reshape(-1)[at]
    return model


def _matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([features(t) for t in texts], np.float64).reshape(-1, len(FEATURES))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", folds: int = 3, fold: int = 1, bound: int = TRAIN_DOCS) -> Gam:
    """A model from the labelled rows whose crc32(doc_id) mod folds isn't fold."""
    names = list(FEATURES)

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), *(pa.array(x[:, f]) for f in range(len(names)))], names=["doc_id", "label", *names])

    rows = labelled(docs, labels, label_col, folds, fold, bound).select("doc_id", "label", "text")
    schema = StructType([rows.schema["doc_id"], rows.schema["label"]])
    for n in names:
        schema.add(n, DoubleType())
    pdf = rows.mapInArrow(run, schema).toPandas().sort_values(["doc_id", *names])
    return fit(pdf[names].to_numpy(np.float64), pdf["label"].to_numpy(np.float64))


def classify(docs: DataFrame, model: Gam, threshold: float = 0.5, score_col: str = "quality_score", kept_col: str = "quality_kept") -> DataFrame:
    """The rows of docs with a score and whether it is kept; own columns of these names give way."""
    docs = docs.drop(score_col, kept_col)
    schema = StructType([*docs.schema.fields]).add(score_col, DoubleType()).add(kept_col, "boolean")
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            s = model.score(_matrix(batch.column(at).to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array(s >= threshold)], schema=pa.schema([*batch.schema, (score_col, pa.float64()), (kept_col, pa.bool_())]))

    return docs.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op3: every document's score; one third of the ids is held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    s = F.col("quality_score")
    return classify(docs, model).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), s.alias("score"), F.when(s >= 0.5, 1).otherwise(0).alias("predicted"))
