"""Document quality from a linear-chain conditional random field over lines.

Every line of a whole text is good or bad. A line's features describe it and its two neighbours (length, symbols, capitals,
digits, word length, repeated words, repeated lines, sentence ends); a transition weight ties neighbouring labels. Forward-backward
gives each line's probability of being good; the average weighted by line length, calibrated on the training documents, is
the document's score.

Training sees documents only: all lines of a document carry its label. At most ``TRAIN_DOCS`` labelled documents of at most
``TRAIN_LINES`` lines, those with the smallest hash of their id, make up the training sample; their line features (a few MB)
come to the driver, which fits the weights. Scoring covers every line of every document and depends on nothing but the text.

A null or empty text is one empty line and gets a score. Without labelled documents every score is 0.5; with labels of one class
only, every score is that class. A document labelled several times counts with its lowest label; null labels and ids do not
count. Repeated rows are scored alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydropanel.llm.common import only_rows, raw_texts, rowwise, start

TRAIN_DOCS = 3000
TRAIN_LINES = 2000
OWN = 17

_SYMBOL, _CAPITAL, _DIGIT, _SPACE, _BAR = range(5)
_CLASS = np.full(256, 5, np.uint8)
for _b in b"*&%$#!<>{}[]_=~^\\@+/":
    _CLASS[_b] = _SYMBOL
_CLASS[ord("A") : ord("Z") + 1] = _CAPITAL
_CLASS[ord("0") : ord("9") + 1] = _DIGIT
for _b in b" \t\r\x0b\x0c":
    _CLASS[_b] = _SPACE
_CLASS[ord("|")] = _BAR


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines (own, previous, next), their lengths, and the lines of each text."""
    lines, counts, words, repeated, seen_before, same = [], [], [], [], [], []
    for t in texts:
        own = t.split(b"\n")
        counts.append(len(own))
        seen, last = set(), None
        for x in own:
            w = x.lower().split()
            words.append(len(w))
            repeated.append(len(w) - len(set(w)))
            seen_before.append(x in seen and len(w) > 0)
            same.append(x == last)
            seen.add(x)
            last = x
        lines += own
    n = len(lines)
    size = np.fromiter(map(len, lines), np.int64, n)
    buffer = np.frombuffer(b"\n".join(lines) + b"\n", np.uint8)
    begin = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    kind = _CLASS[buffer]
    share = [np.add.reduceat(kind == k, begin, dtype=np.int64) / np.maximum(size, 1) for k in range(5)]
    end = buffer[np.maximum(begin + size - 1, 0)]
    words = np.array(words, float)
    dup = np.array(repeated, float) / np.maximum(words, 1)
    f = np.stack(
        [
            np.log1p(size) / 8, np.minimum(words, 50) / 50, np.minimum(size / np.maximum(words, 1), 30) / 10,
            np.sqrt(share[_SYMBOL]), share[_SYMBOL] > 0.03, share[_SYMBOL] > 0.15,
            share[_CAPITAL], share[_CAPITAL] > 0.3, share[_DIGIT], share[_SPACE], np.sqrt(share[_BAR]), share[_BAR] > 0.02,
            dup, (dup > 0.45) & (words > 5), seen_before, same, np.isin(end, list(b".!?")),
        ],
        axis=1,
    ).astype(np.float32)
    counts = np.array(counts)
    return _neighbours(f, counts), size, counts


class Chains:
    """Documents as chains of lines, stepped through side by side, the longest first."""

    def __init__(self, counts: np.ndarray) -> None:
        self.counts = counts
        begin = np.cumsum(counts) - counts
        order = np.argsort(-counts, kind="stable")
        longest = counts[order]
        self.steps = [begin[order[: np.searchsorted(-longest, -t, side="left")]] + t for t in range(int(longest[0]) if len(counts) else 0)]

    def marginals(self, unary: np.ndarray, move: np.ndarray, pairs: bool = False):
        """P(good) per line; with ``pairs`` also the expected number of each transition. ``unary`` is the
        log-odds of good, ``move[a, b]`` the log weight of label b after a."""
        odds = np.exp(np.clip(unary, -30, 30))
        m = np.exp(move)
        n = len(unary)
        ahead, back = np.empty(n), np.full(n, 0.5)  # P(good | lines so far); weight of good from the lines after, normalised
        for t, at in enumerate(self.steps):
            if t == 0:
                good = odds[at] / (1 + odds[at])
            else:
                p = ahead[at - 1]
                g = (p * m[1, 1] + (1 - p) * m[0, 1]) * odds[at]
                good = g / (g + p * m[1, 0] + (1 - p) * m[0, 0])
            ahead[at] = good
        total = np.zeros((2, 2))
        for at in reversed(self.steps[1:]):
            b1, b0 = back[at] * odds[at], 1 - back[at]
            x1, x0 = m[1, 1] * b1 + m[1, 0] * b0, m[0, 1] * b1 + m[0, 0] * b0
            if pairs:
                p = ahead[at - 1]
                w = np.stack([(1 - p) * m[0, 0] * b0, (1 - p) * m[0, 1] * b1, p * m[1, 0] * b0, p * m[1, 1] * b1])
                total += (w / w.sum(0)).sum(1).reshape(2, 2)
            back[at - 1] = x1 / (x1 + x0)
        good = ahead * back
        good = good / (good + (1 - ahead) * (1 - back))
        return (good, total) if pairs else good


@dataclass
class Model:
    weights: np.ndarray
    move: np.ndarray
    slope: float
    shift: float

    def score(self, texts: list[bytes]) -> np.ndarray:
        f, size, counts = line_features(texts)
        return self.documents(f, size, counts)

    def mean(self, f: np.ndarray, size: np.ndarray, counts: np.ndarray) -> np.ndarray:
        good = Chains(counts).marginals(f @ self.weights, self.move)
        weight = size + 1e-3  # empty lines count only where there is nothing else
        begin = np.cumsum(counts) - counts
        return np.add.reduceat(good * weight, begin) / np.add.reduceat(weight, begin)

    def documents(self, f: np.ndarray, size: np.ndarray, counts: np.ndarray) -> np.ndarray:
        p = np.clip(self.mean(f, size, counts), 1e-6, 1 - 1e-6)
        return 1 / (1 + np.exp(-(self.slope * np.log(p / (1 - p)) + self.shift)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, rounds: int = 25) -> np.ndarray:
    """Newton steps of a weighted logistic regression."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(f: np.ndarray, size: np.ndarray, counts: np.ndarray, label: np.ndarray, rounds: int = 60, ridge: float = 1.0) -> Model:
    """Weights from documents' labels; all lines of a document carry its label."""
    f = f.astype(float)
    width = f.shape[1]
    if len(label) == 0 or label.min() == label.max():
        only = 0.0 if len(label) == 0 else (30.0 if label[0] else -30.0)
        return Model(np.zeros(width), np.zeros((2, 2)), 0.0, only)
    y = np.repeat(label, counts).astype(float)
    share = 1 / np.repeat(counts, counts)  # every document weighs the same at the start
    w, move = _logistic(f, y, share, ridge), np.zeros((2, 2))
    chains = Chains(counts)
    inner = np.ones(len(y), bool)
    inner[np.cumsum(counts) - counts] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[at - 1].astype(int), y[at].astype(int)), 1)
    # Gradient ascent of the chain likelihood with adaptive steps, from the weights without transitions.
    theta = np.concatenate([w, move.ravel()])
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, rounds + 1):
        good, moved = chains.marginals(f @ theta[:width], theta[width:].reshape(2, 2), pairs=True)
        g = np.concatenate([f.T @ (y - good), (seen - moved).ravel()]) / len(label) - ridge * theta / len(label)
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        theta = theta + 0.05 * (m1 / (1 - 0.9**k)) / (np.sqrt(m2 / (1 - 0.99**k)) + 1e-8)
    model = Model(theta[:width], theta[width:].reshape(2, 2), 1.0, 0.0)
    p = np.clip(model.mean(f, size, counts), 1e-6, 1 - 1e-6)
    slope, shift = _logistic(np.stack([np.log(p / (1 - p)), np.ones(len(p))], axis=1), label.astype(float), np.ones(len(p)), 0.1)
    return Model(model.weights, model.move, float(slope), float(shift))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", limit: int = TRAIN_DOCS) -> Model:
    """Fit on a bounded sample of the labelled documents."""
    start(docs.sparkSession)
    marked = labels.where(F.col(f"`{key}`").isNotNull() & F.col(f"`{label}`").isNotNull()).groupBy(F.col(f"`{key}`").alias("key")).agg(F.min(F.col(f"`{label}`")).alias("y"))
    known = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    few = F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))), F.lit(0)) < TRAIN_LINES
    # Ids are chosen without the texts; only the texts of the sample are then picked out of a second scan.
    ids = known.where(few).select("key").join(marked, "key").distinct().orderBy(F.xxhash64(F.col("key").cast("string")), "key").limit(limit)
    sample = known.where(few).join(F.broadcast(ids), "key")  # at most ``limit`` ids

    def run(batch) -> dict:
        raw = raw_texts(batch, "text")
        out = [line_features([t]) for t in raw]
        return {"f": [o[0][:, :OWN].tobytes() for o in out], "size": [o[1].tobytes() for o in out]}

    rows = rowwise(sample, ["key", "y", "text"], run, "f binary, size binary", keep=["key", "y"]).dropDuplicates(["key"]).collect()
    rows.sort(key=lambda r: str(r["key"]))
    if not rows:
        return fit(np.zeros((0, 3 * OWN + 3)), np.zeros(0), np.zeros(0, int), np.zeros(0))
    own = [np.frombuffer(r["f"], np.float32).reshape(-1, OWN) for r in rows]
    size = np.concatenate([np.frombuffer(r["size"], np.int64) for r in rows])
    counts = np.array([len(o) for o in own])
    return fit(_neighbours(np.concatenate(own), counts), size, counts, np.array([r["y"] for r in rows]))


def _neighbours(own: np.ndarray, counts: np.ndarray) -> np.ndarray:
    first, last = np.zeros(len(own), bool), np.zeros(len(own), bool)
    first[np.cumsum(counts) - counts] = True
    last[np.cumsum(counts) - 1] = True
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[first], after[last] = 0, 0
    return np.concatenate([own, before, after, first[:, None], last[:, None], np.ones((len(own), 1))], axis=1).astype(np.float32)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score (0 to 1) of every document."""
    start(docs.sparkSession)
    return rowwise(docs, [key, text], lambda batch: {"score": model.score(raw_texts(batch, text))}, "score double", keep=[key])


def keep_good(docs: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """The documents with a score of at least ``least``, unchanged."""
    start(docs.sparkSession)
    return only_rows(docs, [text], lambda batch: model.score(raw_texts(batch, text)) >= least)
