"""Toxicity: a bidirectional gated recurrent network with attention pooling.

Each step reads a word: a learned vector for frequent words beside the mean of
learned vectors of its character trigrams. Two gated recurrent layers run over
a window in opposite directions, attention pools their states, and a logistic
unit scores the window. A text is cut into overlapping windows of words that
cover all of it; its score is the highest of any window.

Training is in numpy, by backpropagation through time with Adam, over windows
of a bounded sample of labelled documents. A toxic document doesn't say which of
its windows is toxic: the first epochs take all of them, later ones the highest
scoring window of each, and all windows of other documents are drawn in turn.

Scoring projects each distinct word once and memoises the projection, so a step
costs one gather and one small product per direction. Padding is a word whose
update gate stays shut, so that no masks are needed in the recurrence.

Defined cases: null and empty texts have no window and score 0; null ids and
repeated rows get a row each, and a null id counts as held out; without labels
of both classes every text scores the prior; an empty table gives an empty
result; other columns aren't read.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType
from zlib import crc32

from ._common import held_out, labelled, table

#: Labelled documents that a model is fitted on, at most (about).
TRAIN_DOCS = 4000
WINDOW, STRIDE = 64, 48
WORDS, TRIGRAMS, WORD_DIM, CHAR_DIM, HIDDEN = 20_000, 8192, 8, 8, 8
BATCH, MEMO_WORDS = 2048, 200_000
SHUT = 30.0


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def trigrams(word: str) -> list[int]:
    w = f"<{word}>"
    return [crc32(w[i : i + 3].encode()) % TRIGRAMS for i in range(max(1, len(w) - 2))]


def starts(count: int) -> range:
    """Where the windows over so many words begin; the last one reaches the end."""
    return range(0, max(1, count - (WINDOW - STRIDE)), STRIDE) if count else range(0)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -SHUT, SHUT)))


@dataclass
class Net:
    """Parameters by name; words: frequent word to its row (row 0: all others)."""

    p: dict[str, np.ndarray]
    words: dict[str, int]
    prior: float = 0.0
    trained: bool = True

    def inputs(self, words: list[str], drop: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(vectors, word rows, trigrams, owner of each trigram) of distinct words."""
        rows = np.array([self.words.get(w, 0) for w in words], np.int64)
        if drop is not None:
            rows[drop] = 0
        grams = [trigrams(w) for w in words]
        sizes = np.array([len(g) for g in grams], np.int64)
        flat, owner = np.array([t for g in grams for t in g], np.int64), np.repeat(np.arange(len(words)), sizes)
        chars = np.add.reduceat(self.p["char"][flat], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
        return np.concatenate([self.p["word"][rows], chars], axis=1).astype(np.float32), rows, flat, owner

    def projected(self, x: np.ndarray) -> np.ndarray:
        """(2, words + 1, 3 * HIDDEN); the last row is padding."""
        out = np.zeros((2, len(x) + 1, 3 * HIDDEN), np.float32)
        out[:, :-1] = x @ self.p["in"] + self.p["in_bias"][:, None]
        out[:, -1, :HIDDEN] = SHUT
        return out

    def forward(self, proj: np.ndarray, index: np.ndarray, keep: bool = False):
        """Scores of windows; index: (WINDOW, n) rows of proj. keep: for backward()."""
        steps, n = index.shape
        states, kept = np.zeros((2, steps, n, HIDDEN), np.float32), []
        for d in (0, 1):
            h, u, order = np.zeros((n, HIDDEN), np.float32), self.p["rec"][d], range(steps) if d == 0 else range(steps - 1, -1, -1)
            for t in order:
                g, a = proj[d][index[t]], h @ u
                gates = sigmoid(g[:, : 2 * HIDDEN] + a[:, : 2 * HIDDEN])
                z, r, an = gates[:, :HIDDEN], gates[:, HIDDEN:], a[:, 2 * HIDDEN :]
                c = np.tanh(g[:, 2 * HIDDEN :] + r * an)
                new = c + z * (h - c)
                if keep:
                    kept.append((d, t, h, z, r, an, c))
                states[d, t] = h = new
        pad = index == proj.shape[1] - 1
        e = states[0] @ self.p["att"][:HIDDEN] + states[1] @ self.p["att"][HIDDEN:]
        e = np.where(pad, -np.inf, e)
        w = np.exp(e - e.max(axis=0))
        w /= w.sum(axis=0)
        pooled = np.concatenate([np.einsum("tn,tnh->nh", w, s) for s in states], axis=1)
        score = sigmoid(pooled @ self.p["out"] + self.p["out_bias"][0])
        return (score, states, kept, w, pooled) if keep else score


def _backward(net: Net, x: np.ndarray, proj: np.ndarray, index: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """(gradients, gradient of x) of the weighted mean log loss."""
    score, states, kept, w, pooled = net.forward(proj, index, keep=True)
    p, grad = net.p, {k: np.zeros_like(v) for k, v in net.p.items() if k not in ("word", "char")}
    d_out = ((score - y) * weight / weight.sum()).astype(np.float32)
    grad["out"], grad["out_bias"] = pooled.T @ d_out, np.array([d_out.sum()], np.float32)
    d_pooled = d_out[:, None] * p["out"]
    both = np.concatenate([states[0], states[1]], axis=2)
    d_w = np.einsum("tnh,nh->tn", both, d_pooled)
    d_e = w * (d_w - (w * d_w).sum(axis=0))
    grad["att"] = np.einsum("tn,tnh->h", d_e, both)
    d_states = w[:, :, None] * d_pooled + d_e[:, :, None] * p["att"]
    d_proj = np.zeros((2, *index.shape, 3 * HIDDEN), np.float32)
    carry: dict[int, np.ndarray] = {}
    for d, t, h, z, r, an, c in reversed(kept):
        dh = d_states[t][:, d * HIDDEN : (d + 1) * HIDDEN] + carry.get(d, 0)
        dz, dc = dh * (h - c) * z * (1 - z), dh * (1 - z) * (1 - c * c)
        dr = dc * an * r * (1 - r)
        da = np.concatenate([dz, dr, dc * r], axis=1)
        d_proj[d, t] = np.concatenate([dz, dr, dc], axis=1)
        grad["rec"][d] += h.T @ da
        carry[d] = dh * z + da @ p["rec"][d].T
    flat = index.reshape(-1)
    order = np.argsort(flat, kind="stable")
    rows, first = np.unique(flat[order], return_index=True)
    d_rows = np.zeros((2, len(x) + 1, 3 * HIDDEN), np.float32)
    for d in (0, 1):
        d_rows[d, rows] = np.add.reduceat(d_proj[d].reshape(-1, 3 * HIDDEN)[order], first, axis=0)
    d_rows = d_rows[:, :-1]
    grad["in"], grad["in_bias"] = np.einsum("ue,duh->deh", x, d_rows), d_rows.sum(axis=1)
    return grad, np.einsum("duh,deh->ue", d_rows, p["in"])


def fit(texts: list[str], y: np.ndarray, epochs: int = 8, noisy_epochs: int = 2, batch: int = 256, rate: float = 0.01, seed: int = 11) -> Net:
    """A network from texts and labels 0 or 1; the same for the same input."""
    rng, docs = np.random.default_rng(seed), [words_of(t) for t in texts]
    seen = Counter(w for d in docs for w in set(d))
    common = [w for w, n in sorted(seen.items(), key=lambda x: (-x[1], x[0])) if n >= 5][:WORDS]
    e = WORD_DIM + CHAR_DIM
    draw = lambda *shape, by=0.1: rng.normal(0, by, shape).astype(np.float32)
    p = {"word": draw(len(common) + 1, WORD_DIM), "char": draw(TRIGRAMS, CHAR_DIM), "in": draw(2, e, 3 * HIDDEN, by=0.4), "in_bias": np.zeros((2, 3 * HIDDEN), np.float32), "rec": draw(2, HIDDEN, 3 * HIDDEN, by=0.3), "att": draw(2 * HIDDEN), "out": draw(2 * HIDDEN, by=0.5), "out_bias": np.zeros(1, np.float32)}
    p["word"][0] = 0
    prior = float((y.sum() + 0.5) / (len(y) + 1))
    net = Net(p, {w: i + 1 for i, w in enumerate(common)}, prior)
    if not len(y) or y.min() == y.max():
        net.trained = False
        return net
    found: dict[int, tuple[float, int]] = {}
    windows = [(i, s) for i, d in enumerate(docs) for s in starts(len(d))]
    positive = [k for k, (i, _) in enumerate(windows) if y[i] == 1]
    negative = [k for k, (i, _) in enumerate(windows) if y[i] == 0]
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    step, at = 0, 0
    negative = [negative[i] for i in rng.permutation(len(negative))]
    for epoch in range(epochs):
        chosen, hard = positive, []
        if epoch >= noisy_epochs:
            if (epoch - noisy_epochs) % 2 == 0:
                found = _best(net, docs, windows)
            chosen = [k for i, (v, k) in found.items() if y[i] == 1 and (epoch < noisy_epochs + 2 or v > 0.1)]
            hard = [k for i, (v, k) in found.items() if y[i] == 0]
        share = max(2 * len(chosen), 4000)
        others = hard + [negative[(at + i) % len(negative)] for i in range(min(share, len(negative)))]
        at += share
        rate_now = rate * (1.0 if epoch < noisy_epochs + 2 else 0.3)
        picked = [*chosen, *others]
        picked = [picked[i] for i in rng.permutation(len(picked))]
        size_now = min(batch, max(32, len(picked) // 24))  # small samples take smaller steps, more of them
        for a in range(0, len(picked), size_now):
            part = [(docs[i][s : s + WINDOW], y[i]) for i, s in (windows[k] for k in picked[a : a + size_now])]
            target = np.array([t for _, t in part], np.float32)
            vocabulary = {w: n for n, w in enumerate(dict.fromkeys(w for ws, _ in part for w in ws))}
            index = _index([ws for ws, _ in part], vocabulary, len(vocabulary))
            x, rows, grams, owner = net.inputs(list(vocabulary), rng.random(len(vocabulary)) < 0.3)
            weight = np.where(target == 1, max(1.0, len(others) / max(1, len(chosen)) / 4), 1.0)
            grad, dx = _backward(net, x, net.projected(x), index, target, weight)
            size = np.bincount(owner, minlength=len(vocabulary))
            sparse = {"word": (rows, dx[:, :WORD_DIM]), "char": (grams, (dx[:, WORD_DIM:] / size[:, None])[owner])}
            for name, (where, values) in sparse.items():
                grad[name] = np.zeros_like(p[name])
                np.add.at(grad[name], where, values)
            grad["word"][0] = 0
            step += 1
            for name, g in grad.items():
                m, v = moments[name]
                g = np.clip(g, -1, 1)
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p[name] -= rate_now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def _best(net: Net, docs: list[list[str]], windows: list[tuple[int, int]]) -> dict[int, tuple[float, int]]:
    """The highest score of each document's windows, and that window."""
    best: dict[int, tuple[float, int]] = {}
    for a in range(0, len(windows), BATCH):
        part = windows[a : a + BATCH]
        for k, ((i, _), v) in enumerate(zip(part, _scored(net, [docs[i][s : s + WINDOW] for i, s in part]), strict=True), a):
            if i not in best or v > best[i][0]:
                best[i] = float(v), k
    return best


def _index(windows: list[list[str]], rows: dict[str, int], pad: int) -> np.ndarray:
    out = np.full((len(windows), WINDOW), pad, np.int32)
    for k, ws in enumerate(windows):
        out[k, : len(ws)] = [rows[w] for w in ws]
    return np.ascontiguousarray(out.T)


def _scored(net: Net, windows: list[list[str]]) -> np.ndarray:
    rows = {w: n for n, w in enumerate(dict.fromkeys(w for ws in windows for w in ws))}
    return net.forward(net.projected(net.inputs(list(rows))[0]), _index(windows, rows, len(rows)))


class Scorer:
    """Scores texts with bounded memory: words' projections are memoised."""

    def __init__(self, net: Net):
        self.net, self.rows = net, {}
        self.proj = np.zeros((2, MEMO_WORDS + 1, 3 * HIDDEN), np.float32)
        self.proj[:, -1, :HIDDEN] = SHUT

    def _rows(self, words: list[str]) -> list[int]:
        """Rows of the words' projections; the memo starts anew where it is full."""
        rows = self.rows
        new = [w for w in dict.fromkeys(words) if w not in rows]
        if len(rows) + len(new) > MEMO_WORDS:
            rows.clear()
            new = list(dict.fromkeys(words))
        for at in range(0, len(new), 8192):
            part = new[at : at + 8192]
            self.proj[:, len(rows) : len(rows) + len(part)] = self.net.projected(self.net.inputs(part)[0])[:, :-1]
            rows.update(zip(part, range(len(rows), len(rows) + len(part)), strict=True))
        return [rows[w] for w in words]

    def texts(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts))
        if not self.net.trained:
            return np.where([bool(words_of(t)) for t in texts], self.net.prior, 0.0)
        index, owner = np.full((BATCH, WINDOW), MEMO_WORDS, np.int32), np.zeros(BATCH, np.int64)
        n = 0

        def flush() -> None:
            nonlocal n
            if n:
                score = self.net.forward(self.proj, np.ascontiguousarray(index[:n].T))
                np.maximum.at(out, owner[:n], score)
                index[:] = MEMO_WORDS
                n = 0

        for i, text in enumerate(texts):
            words = words_of(text)
            for block in range(0, len(words), STRIDE * 512):  # whole windows of a long text, block by block
                mine = words[block : block + STRIDE * 512 + WINDOW - STRIDE]
                if block and len(words) - block <= WINDOW - STRIDE:
                    break  # these words ended the last window
                if len(self.rows) + len(mine) > MEMO_WORDS:
                    flush()  # rows may move
                rows = self._rows(mine)
                for s in starts(len(mine)):
                    if s >= STRIDE * 512:
                        break
                    ws = rows[s : s + WINDOW]
                    index[n, : len(ws)] = ws
                    owner[n] = i
                    n += 1
                    if n == BATCH:
                        flush()
        flush()
        return out


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", folds: int = 4, fold: int = 2, bound: int = TRAIN_DOCS) -> Net:
    """A network from the labelled rows whose crc32(doc_id) mod folds isn't fold."""
    rows = labelled(docs, labels, label_col, folds, fold, bound).select("doc_id", "text", "label").toPandas()
    rows = rows.sort_values(["doc_id", "text", "label"])
    return fit(rows["text"].tolist(), rows["label"].to_numpy(np.float32))


def classify(docs: DataFrame, net: Net, score_col: str = "toxicity") -> DataFrame:
    """The rows of docs with a score added; an own column of its name gives way."""
    docs = docs.drop(score_col)
    schema = StructType([*docs.schema.fields]).add(score_col, DoubleType())
    at = docs.columns.index("text")

    def run(batches):
        scorer = Scorer(net)
        for batch in batches:
            s = scorer.texts(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s)], schema=pa.schema([*batch.schema, (score_col, pa.float64())]))

    return docs.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op8: every document's score; a quarter of the ids is held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = train(docs, table(spark, sf_dir, "labels"))
    s = F.col("toxicity")
    return classify(docs, net).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), s.alias("score"), F.when(s >= 0.3, 1).otherwise(0).alias("predicted"))
